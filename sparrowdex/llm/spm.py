"""SentencePiece encoding and decoding by forward states over a trie of marked words.

Spaces become the mark U+2581, and a text falls apart into units, a run of marks and what follows it, that no piece
crosses. The distinct units of a batch are sorted, so going through them in order is a depth-first walk of their trie:
the forward states of the prefix that a unit shares with the one before it are kept.

A forward state of a unigram model is the best score of a prefix, and its last piece. Of a BPE model, the best sum of
scores is not what the merges give; there the state of a prefix is the last piece of its encoding. A piece t ends the
encoding of prefix + t exactly if the merges of (last piece of the prefix) + t leave the border between the two, so a
state follows from earlier ones as in Viterbi's recurrence and depends on the prefix alone.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MEMO_CHARS, batches_of
from .workspace import lean, small_batches

MARK = "▁"
UNITS_KEPT, PAIRS_KEPT = 300_000, 600_000
_loaded: dict[str, Model] = {}


#: Fixed values of the .model format: the field of the trainer's settings, that of the model's type in it, the types.
TRAINER, TYPE, TYPES = 2, 3, {1: "unigram", 2: "bpe", 3: "word", 4: "char"}


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 8 if key & 7 == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


def kind_of(path: str) -> str:
    """The type that a .model file states; unigram where it states none."""
    with open(path, "rb") as f:
        raw = f.read()
    trainer = next((v for n, v in _fields(raw) if n == TRAINER), b"")
    return TYPES.get(next((v for n, v in _fields(trainer) if n == TYPE), 1), "other")


class Model:
    """A .model file's pieces with forward coding over sorted units, for BPE and unigram models."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        kind = kind_of(path)
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"no BPE or unigram model: {kind}")

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bpe, self.unknown = kind == "bpe", sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.lengths = piece_lengths(self.ids)
        text = [b""] * n
        for p, i in self.ids.items():
            text[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            text[i] = bytes([b])
        self.piece_sizes = np.array([len(t) for t in text], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.units: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: merge the best-scored neighbours, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def border(self, a: str, b: str) -> bool:
        """Whether the merges of a + b give a and b; with an empty a, whether those of b give b."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def encode_sorted(self, units: list[str]):
        """The pieces of each of some sorted units."""
        last: list[str] = [""]  # last[i]: last piece of the prefix of i characters
        total: list[float] = [0.0]  # its score; BPE has none
        step = self.step_bpe if self.bpe else self.step_unigram
        before = ""
        for unit in units:
            same = 0
            for a, b in zip(before, unit):  # noqa: B905  up to the shorter one
                if a != b:
                    break
                same += 1
            del last[same + 1 :], total[same + 1 :]
            step(unit, same + 1, last, total)
            before = unit
            out, i = [], len(unit)
            while i:
                piece = last[i]
                out.append(piece)
                i -= len(piece)
            out.reverse()
            yield out

    def step_bpe(self, unit: str, first: int, last: list[str], total: list[float]):
        """The forward states of the prefixes from `first` characters on."""
        known, pairs, lengths = self.ids, self.pairs, self.lengths
        for i in range(first, len(unit) + 1):
            for n in lengths.get(unit[i - 2 : i], ()) if i > 1 else ():
                if n <= i:
                    t = unit[i - n : i]
                    if t in known:
                        pair = (last[i - n], t)
                        ok = pairs.get(pair)
                        if ok or ok is None and self.border(*pair):
                            last.append(t)
                            break
            else:
                last.append(unit[i - 1])
            total.append(0.0)

    def step_unigram(self, unit: str, first: int, last: list[str], total: list[float]):
        scores = self.scores
        for i in range(first, len(unit) + 1):
            piece = unit[i - 1]
            best = total[i - 1] + scores.get(piece, -1e6)  # an unknown character costs more than any path of pieces
            for n in self.lengths.get(unit[i - 2 : i], ()) if i > 1 else ():
                if n <= i and (t := unit[i - n : i]) in scores and total[i - n] + scores[t] > best:
                    best, piece = total[i - n] + scores[t], t
            last.append(piece)
            total.append(best)

    def to_ids(self, pieces: list[str]) -> bytes:
        """The ids as little-endian 32-bit numbers; a character that is no piece becomes its bytes, or the unknown id."""
        out = [self.ids.get(p) for p in pieces]
        if None in out:
            out = []
            for p in pieces:
                if (i := self.ids.get(p)) is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in p.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return struct.pack(f"<{len(out)}i", *out)

    def values(self, units: list[str]) -> list[bytes]:
        """The ids of each of some distinct units."""
        if len(self.units) >= UNITS_KEPT:  # units that are met again move on, the others go
            self.units, self.older = {}, self.units
        found = list(map(self.units.get, units))
        if self.older:
            for k, u in enumerate(units):
                if found[k] is None and (v := self.older.get(u)) is not None:
                    found[k] = self.units[u] = v
        new = sorted((u, k) for k, u in enumerate(units) if found[k] is None)
        for (u, k), pieces in zip(new, self.encode_sorted([u for u, _ in new]), strict=True):
            found[k] = self.to_ids(pieces)
            if len(u) <= MEMO_CHARS:
                self.units[u] = found[k]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids before each text and in all); a null text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.match_substring(texts, MARK)))
        empty = pc.equal(pc.binary_length(texts), 0)
        usual = pc.if_else(pc.or_(odd, empty), pa.scalar("", pa.large_string()), texts)
        # a line feed is in no piece but its byte's, so a unit may end before it
        parts = pc.split_pattern(pc.replace_substring(usual, "\n", " \n"), " ")
        coded = parts.flatten().dictionary_encode()
        names = [p if p[:1] == "\n" else MARK + p for p in coded.dictionary.to_pylist()]
        strange = {i: [u for u in re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + texts[i].as_py().replace(" ", MARK))] for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        for i in np.flatnonzero(empty.to_numpy(zero_copy_only=False)):
            strange[i] = []
        extra = sorted({u for us in strange.values() for u in us} - set(names)) if strange else []
        values = self.values([*names, *extra])
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if strange:  # put those texts' units where the split has one empty part for each
            at = np.cumsum(counts) - counts
            runs = np.split(which, at[1:])
            place = {u: k for k, u in enumerate([*names, *extra])}
            for i, us in strange.items():
                runs[i] = np.array([place[u] for u in us], which.dtype)
                counts[i] = len(us)
            which = np.concatenate(runs) if len(runs) else which
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        flat = np.frombuffer(b"".join(values), "<i4")
        n = sizes[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of some ids, the first mark of a text included."""
        n = self.piece_sizes[ids]
        ends = np.cumsum(n)
        return self.piece_bytes[np.repeat(self.piece_starts[ids] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()


def piece_lengths(pieces) -> dict[str, list[int]]:
    """Two characters -> the lengths of the pieces that end with them, longest first."""
    ends: dict[str, set[int]] = {}
    for p in pieces:
        if len(p) > 1:
            ends.setdefault(p[-2:], set()).add(len(p))
    return {e: sorted(n, reverse=True) for e, n in ends.items()}


def model(path: str) -> Model:
    if path not in _loaded:
        _loaded[path] = Model(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), round_trip and, if asked, the ids.

    round_trip: the decoded ids are the text's bytes again; false only where the text holds the mark itself. A null or
    empty text has no ids and makes the trip. Null ids and repeated rows stay; other columns are dropped.
    """
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        coder = model(path)
        for b in batches:
            for a, z in batches_of(b.column(1), 4 << 20):
                texts = b.column(1).slice(a, z - a)
                ids, starts = coder.encode(texts)
                raw = texts.cast(pa.binary()).to_pylist()
                parts = [ids[starts[k] : starts[k + 1]] for k in range(z - a)]
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                same = [coder.decode(p) == (b" " + t if t else b"") for p, t in zip(parts, raw, strict=True)]
                yield pa.record_batch([b.column(0).slice(a, z - a), pa.array(np.diff(starts)), pa.array(crc, pa.int64()), pa.array(same)] + [pa.array(parts, pa.list_(pa.int32()))] * with_ids, schema=schema)

    out = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), "id long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and the text of each row's ids; null ids of a row give a null text."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches):
        coder = model(path)
        for b in batches:
            texts = [None if v is None else coder.decode(np.array(v, np.int64)).removeprefix(b" ").decode(errors="replace") for v in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
