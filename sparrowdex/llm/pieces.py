"""Whole-text coding through white-space separated pieces.

The vocabulary's normaliser turns runs of white space into one space and its splitter drops them, so no token and no
normalisation step reaches across ASCII white space: the ids of a text are those of its pieces in order. A batch of texts
is split and its distinct pieces are found in Arrow; a distinct piece that is a word of plain letters, or one and a final
mark, is looked up by its lower-case word. Each worker keeps the ids of the words it met last, twice MEMO_ROWS of them at most.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_ROWS, MEMO_CHARS = 150_000, 64
#: Text that is coded at once.
BATCH_BYTES = 2 << 20
_loaded: dict[str, object] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b < 127 or b > 160 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def tokenizer(path: str):
    """The tokenizer of a .json vocabulary file, one per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: Letters that lower-case one to one, that NFC leaves alone, and that a splitter by letters keeps together.
PLAIN = "^[A-Za-zÀ-ÖØ-öø-į]+$"
#: After a letter, one of these is a pre-token of its own.
MARKS = ".,!?;:"


class Coder:
    def __init__(self, path: str):
        loaded = tokenizer(path)
        self.encode, self.split = loaded.encode, loaded.model.tokenize
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {ord(m): self.by_chain(m) for m in MARKS}

    def by_chain(self, text: str) -> bytes:
        """The ids of any text, by the library's whole chain."""
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_model(self, word: str) -> bytes:
        """The ids of a lower-case word of plain letters: normalised already and one pre-token."""
        tokens = self.split(word.encode().decode("latin-1").translate(BYTE_LETTERS))
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def values(self, keys: list[str], code) -> list[bytes]:
        found = list(map(self.words.get, keys))
        for i, v in enumerate(found):
            if v is None:
                k = keys[i]
                v = self.older.get(k)
                found[i] = v = code(k) if v is None else v
                if len(k) <= MEMO_CHARS:
                    self.words[k] = v
        if len(self.words) > MEMO_ROWS:  # words that are met again move on, the others go
            self.words, self.older = {}, self.words
        return found

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths): each of some distinct pieces is two runs of ids, one row of starts and lengths."""
        word = pc.utf8_rtrim(pieces, MARKS)
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(word)).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(word, PLAIN).to_numpy(zero_copy_only=False) & (tail < 2)
        coded = pc.utf8_lower(word.filter(pa.array(plain))).dictionary_encode()
        rest = np.flatnonzero(~plain)
        runs = [*self.values(coded.dictionary.to_pylist(), self.by_model), *self.values(pieces.take(pa.array(rest)).to_pylist(), self.by_chain), *self.marks.values()]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(pieces), np.int64)
        first[plain] = coded.indices.to_numpy(zero_copy_only=False)
        first[rest] = len(coded.dictionary) + np.arange(len(rest))
        marked = np.flatnonzero(plain & (tail == 1))
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + 1 : pieces.offset + 1 + len(pieces)]
        place = np.zeros(256, np.int64)
        place[list(self.marks)] = len(runs) - len(self.marks) + np.arange(len(self.marks))
        starts, lengths = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        starts[:, 0], lengths[:, 0] = begins[first], sizes[first]
        if len(marked):
            which = place[np.frombuffer(pieces.buffers()[2], np.uint8)[ends[marked] - 1]]
            starts[marked, 1], lengths[marked, 1] = begins[which], sizes[which]
        return np.frombuffer(b"".join(runs), "<u4"), starts, lengths

    def code(self, texts: pa.Array) -> Coded:
        """The ids of all texts; a null text is empty."""
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null("")))
        coded = parts.flatten().dictionary_encode()
        ids, starts, lengths = self.distinct(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[which].ravel()
        ends = np.cumsum(n)
        at = np.repeat(starts[which].ravel() - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        of_text = parts.value_lengths().to_numpy(zero_copy_only=False)
        return Coded(ids[at], np.concatenate([[0], ends[1::2]]), np.concatenate([[0], np.cumsum(of_text)]).astype(np.int64))


class Coded:
    """ids of all texts in a row; ends[i]: ids before piece i; first[d]: number of the first piece of text d."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.ids, self.ends, self.first = ids, ends, first
        self.starts = ends[first]  # ids before text d

    def of(self, d: int) -> np.ndarray:
        return self.ids[self.starts[d] : self.starts[d + 1]]

    def table(self, d: int) -> np.ndarray:
        """Token counts of the prefixes of text d that end with piece 0, 1, ..."""
        return self.ends[self.first[d] + 1 : self.first[d + 1] + 1] - self.starts[d]


def coder(path: str) -> Coder:
    key = f"coder {path}"
    if key not in _loaded:
        _loaded[key] = Coder(path)
    return _loaded[key]


def batches_of(texts: pa.Array, most: int = BATCH_BYTES):
    """(first, last) of runs of texts of about `most` bytes; one long text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > first and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if len(sizes) > first:
        yield first, len(sizes)
