"""Token counts by prefix dynamic programming.

N(k), the token count of a text's first k characters, is stored for every k; a truncation or budget question is read from
that table, and nothing is encoded again. A text's count is its last entry; where only that is asked, the states along a
word are the same, and the entries in between are not kept.

The last token of an encoding follows from earlier states: a token t ends the encoding of prefix + t exactly if the merges
of (last token of the prefix) + t leave the border between the two. So along a word, last(i) and N(i) follow from last(i - n)
and N(i - n), n being the length of a token that ends at i. A prefix is cut off as a text of its own, so its last token is
one that ends a word; there are two states for each i, one for a word that goes on and one for a word that ends. Distinct
words are sorted, and the states of the prefix that two neighbours share are kept.

Words are what the vocabulary's splitter makes of a piece of text without white space; a piece's table is the running sum of
its words' tables, a text's table that of its pieces' tables. A cut inside a word changes no earlier word.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import BYTE_LETTERS, MARKS, MEMO_CHARS, MEMO_ROWS, PLAIN, batches_of, tokenizer
from .workspace import lean, small_batches

#: Fixed values of the vocabulary's splitter.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WORDS = regex.compile("(?P<short>" + "|".join(CONTRACTIONS) + r")|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Lower-cased by what follows it.
SIGMA = "Σ"
NEVER = 1 << 60
PAIRS_KEPT = 400_000


class Counter:
    """Tables of prefix counts under a byte-level BPE vocabulary whose tokens at a word's end have a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = made["model"]
        self.end = model["end_of_word_suffix"]
        if not self.end:
            raise ValueError("the vocabulary does not mark the end of a word")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.vocabulary = model["vocab"]
        self.special = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.open, self.closed = self.lengths(False), self.lengths(True)
        self.whole = tokenizer(path).encode
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[str, str], bool] = {}
        #: the words met last, and those before them: their counts, and the tables of their prefixes
        self.words: tuple[list[dict], list[dict]] = ([{}, {}], [{}, {}])

    def lengths(self, closed: bool) -> dict[str, list[int]]:
        """The last two letters, or three -> the lengths of the tokens that end with them, longest first; without the
        suffix. A token of two letters is one with any letter before."""
        found: dict[str, set[int]] = {}
        for t in self.vocabulary:
            if t.endswith(self.end) == closed:
                t = t.removesuffix(self.end) if closed else t
                if len(t) > 1:
                    found.setdefault(t[-3:], set()).add(len(t))
        short = {t for t in found if len(t) == 2}
        return {k: tuple(sorted(v | ({2} if k[-2:] in short else set()), reverse=True)) + (1,) for k, v in found.items()}

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str, int] | None]:
        """BPE by its definition, the merge of the lowest rank first, the leftmost of equals; and its last merge."""
        parts, made = list(symbols), None
        while len(parts) > 1:
            rank, at = min((self.ranks.get((parts[k], parts[k + 1]), NEVER), k) for k in range(len(parts) - 1))
            if rank == NEVER:
                break
            made = (parts[at], parts[at + 1], rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, made

    def spine(self, token: str, side: int) -> list[tuple[str, int]] | None:
        """The symbols that stand at an edge of a token while it is made, the latest first, each with the rank of the merge
        that takes it in; None for a token that merges do not make. side: 0 for the left edge, 1 for the right one."""
        found = self.spines[side].get(token, ())
        if found == ():
            body = token.removesuffix(self.end) if len(token) > len(self.end) and token.endswith(self.end) else token
            parts, made = self.merged([*body[:-1], token[len(body) - 1 :]])
            if len(parts) > 1:
                found = None
            elif made is None:
                found = [(token, NEVER)]
            else:
                found = [(token, NEVER), (made[side], made[2]), *self.spine(made[side], side)[1:]]
            self.spines[side][token] = found
        return found

    def border(self, a: str, b: str) -> bool:
        """Whether the merges of a and b, a within a word, give a and b; with an empty a, whether those of b give b.

        They do not if some symbol at the right edge of a and one at the left edge of b are there at once when a merge of
        the two is due: one of a lower rank than the merge that takes the first in, and not a higher than the second's (of
        equal merges the leftmost comes first)."""
        left = self.spine(b, 0)
        if left is None or not a:
            return left is not None
        right = self.spine(a, 1)
        ranks = self.ranks
        for x, until in right:
            for y, end in left:
                due = ranks.get((x, y))
                if due is not None and due < until and due <= end:
                    return False
        return True

    def kept(self, pair: tuple[str, str]) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        found = self.pairs[pair] = self.border(*pair)
        return found

    def along(self, words: list[str], every: bool):
        """For each of some sorted words, in letters that stand for bytes: the counts of all its prefixes as whole words, or
        that of the word."""
        last, count, whole = [""], [0], [0]
        known, end, pairs, closed, going, before = self.vocabulary, self.end, self.pairs, self.closed, self.open, ""
        one = (1,)
        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905  up to the shorter one
                if a != b:
                    break
                same += 1
            del last[same + 1 :], count[same + 1 :], whole[same + 1 :]
            size = len(word)
            for i in range(len(last), size):  # within the word
                for n in going.get(word[i - 3 : i] if i > 2 else word[:i]) or going.get(word[i - 2 : i], one):
                    if n <= i and (t := word[i - n : i]) in known:
                        ok = pairs.get(pair := (last[i - n], t))
                        if ok or ok is None and self.kept(pair):
                            break
                else:
                    raise ValueError(f"the vocabulary has no token that ends {word[:i]!r}")
                last.append(t)
                count.append(count[i - n] + 1)
            for i in range(len(whole) if every else size, size + 1):  # at the end of a word
                for n in closed.get(word[i - 3 : i] if i > 2 else word[:i]) or closed.get(word[i - 2 : i] if i > 1 else word[:i], one):
                    if n <= i and (t := word[i - n : i] + end) in known:
                        ok = pairs.get(pair := (last[i - n], t))
                        if ok or ok is None and self.kept(pair):
                            break
                else:
                    raise ValueError(f"the vocabulary has no token that ends {word[:i]!r}")
                if every:
                    whole.append(count[i - n] + 1)
            before = word
            yield np.array(whole, np.int32) if every else count[i - n] + 1

    def of_words(self, words: list[str], every: bool = True) -> list:
        """The counts of the prefixes of 0, 1, ... characters of each of some normalised words, or of the words."""
        memo = self.words[every]
        if len(memo[0]) > MEMO_ROWS:  # words that are met again move on, the others go
            memo[:] = {}, memo[0]
        now, older = memo
        found = list(map(now.get, words))
        new = {}
        for k, f in enumerate(found):
            if f is None:
                w = words[k]
                found[k] = f = older.get(w)
                if f is None:
                    new[w] = None
                else:
                    now[w] = f
        if new:
            letters = sorted((w.encode().decode("latin-1").translate(BYTE_LETTERS), w) for w in new)
            for (_, w), made in zip(letters, self.along([x for x, _ in letters], every), strict=True):
                new[w] = made if not every or w.isascii() else made[np.cumsum([0, *(len(c.encode()) for c in w)])]
                if len(w) <= MEMO_CHARS:
                    now[w] = new[w]
            found = [new[w] if f is None else f for w, f in zip(words, found, strict=True)]
        return found

    def of_piece(self, piece: str) -> np.ndarray:
        """The counts of the prefixes of 0, 1, ... characters of a text without ASCII white space."""
        at, token = min(((k, t) for t in self.special if (k := piece.find(t)) >= 0), key=lambda x: (x[0], -len(x[1])), default=(-1, ""))
        if at >= 0:  # up to its last character, a special token is text like any other
            head = self.of_piece(piece[: at + len(token) - 1])
            return np.concatenate([head, head[at] + 1 + self.of_piece(piece[at + len(token) :])])
        if SIGMA in piece or not unicodedata.is_normalized("NFC", piece):  # what comes later changes what was before
            return np.array([len(self.whole(piece[:k], add_special_tokens=False).ids) for k in range(len(piece) + 1)], np.int32)
        lower = [c.lower() for c in piece]
        text, ends = "".join(lower), np.cumsum([0, *map(len, lower)])
        # N by characters of the lower-cased text; white space and what is in no word adds nothing
        step = np.zeros(len(text) + 1, np.int32)
        spans = [(m.start(), m.end(), m.lastgroup) for m in WORDS.finditer(text)]
        counts = self.of_words([text[a:z] for a, z, _ in spans])
        for (a, z, short), inner in zip(spans, counts, strict=True):
            if short and z - a > 2:  # cut short, it is a mark and a letter
                inner = np.array([0, 1, 2, *inner[3:]], np.int32)
            step[a + 1 : z + 1] = np.diff(inner)
        return np.cumsum(step, dtype=np.int32)[ends]

    def end_of_piece(self, piece: str) -> int:
        """The last entry of a piece's table."""
        at, token = min(((k, t) for t in self.special if (k := piece.find(t)) >= 0), key=lambda x: (x[0], -len(x[1])), default=(-1, ""))
        if at >= 0:
            return self.end_of_piece(piece[:at]) + 1 + self.end_of_piece(piece[at + len(token) :])
        if SIGMA in piece or not unicodedata.is_normalized("NFC", piece):
            return len(self.whole(piece, add_special_tokens=False).ids)
        return sum(self.of_words([m[0] for m in WORDS.finditer("".join(c.lower() for c in piece))], False))

    def of_pieces(self, pieces: pa.Array, every: bool) -> list:
        """The tables of some distinct pieces, or their last entries. A word of plain letters, or one and a final mark, which
        is a token of its own, needs no splitting."""
        word = pc.utf8_rtrim(pieces, MARKS)
        tail = pc.subtract(pc.binary_length(pieces), pc.binary_length(word)).to_numpy(zero_copy_only=False)
        plain = pc.match_substring_regex(word, PLAIN).to_numpy(zero_copy_only=False) & (tail < 2)
        coded = pc.utf8_lower(word.filter(pa.array(plain))).dictionary_encode()
        inner = self.of_words(coded.dictionary.to_pylist(), every)
        own = iter(coded.indices.to_numpy(zero_copy_only=False).tolist())
        rest = iter(pieces.filter(pa.array(~plain)).to_pylist())
        if not every:
            return [inner[next(own)] + n if p else self.end_of_piece(next(rest)) for p, n in zip(plain.tolist(), tail.tolist(), strict=True)]
        tables = [(inner[next(own)], n) if p else (self.of_piece(next(rest)), 0) for p, n in zip(plain.tolist(), tail.tolist(), strict=True)]
        return [np.append(t, t[-1] + 1) if n else t for t, n in tables]


class Tables:
    """The prefix counts of some texts: those of their distinct pieces, and where the pieces are. every: whether all entries
    are wanted, or the last one of each text."""

    def __init__(self, texts: pa.Array, counter: Counter, every: bool = True):
        self.texts = texts.cast(pa.large_string()).fill_null("")
        parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(self.texts))
        coded = parts.flatten().dictionary_encode()
        self.tables = counter.of_pieces(coded.dictionary, every)
        self.which = coded.indices.to_numpy(zero_copy_only=False)
        total = np.array([t[-1] for t in self.tables] if every else self.tables, np.int64)
        self.first = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(total[self.which])])

    def totals(self) -> np.ndarray:
        """N at the end of each text."""
        return np.diff(self.before[self.first])

    def of(self, d: int) -> np.ndarray:
        """N(0), N(1), ... of text d: the count of its first k characters at k."""
        raw = self.texts[d].as_py()
        space = np.frombuffer(raw.encode("utf-32-le"), "<u4")
        space = (space == 0x20) | (space >= 9) & (space <= 13)
        step = np.zeros(len(raw) + 1, np.int64)
        inner = [np.diff(self.tables[w]) for w in self.which[self.first[d] : self.first[d + 1]]]
        step[1:][~space] = np.concatenate(inner) if inner else 0
        return np.cumsum(step)


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def prefix_table(text: str | None, path: str) -> np.ndarray:
    """N(0), N(1), ..., N(length) of a text; null is empty."""
    return Tables(pa.array([text], pa.string()), counter(path)).of(0)


def count_at(table: np.ndarray, chars: int) -> int:
    """Tokens of the first `chars` characters."""
    return int(table[min(chars, len(table) - 1)])


def truncate_at(table: np.ndarray, budget: int) -> int:
    """The most characters that a prefix of at most `budget` tokens can have; a longer prefix can have fewer tokens."""
    least = np.minimum.accumulate(table[::-1])[::-1]  # of this prefix and all longer ones
    return int(np.searchsorted(least, budget, side="right")) - 1


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", with_table: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit) and, if asked, prefix_tokens: the
    token count of each prefix by its length in characters, from 0 on.

    A null or empty text has 0 bytes, 0 tokens and a table of one 0; a null id stays null; repeated rows stay; other
    columns are dropped, whatever their names. path: a byte-level BPE vocabulary of the tokenizers library that drops white
    space, lower-cases after NFC and splits by letters, digits and the rest. A piece that is not in NFC, or holds a capital
    sigma, is encoded once for each of its prefixes.
    """
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())] + [("prefix_tokens", pa.list_(pa.int64()))] * with_table
    schema = pa.schema(fields)

    def run(batches):
        own = counter(path)
        for b in batches:
            for a, z in batches_of(b.column(1), 8 << 20):
                ids, texts = b.column(0).slice(a, z - a), b.column(1).slice(a, z - a)
                found = Tables(texts, own, with_table)
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                tables = [pa.array([found.of(d) for d in range(z - a)], pa.list_(pa.int64()))] if with_table else []
                yield pa.record_batch([ids, sizes, pa.array(found.totals()), *tables], schema=schema)

    spark_schema = "id long, n_bytes long, n_tokens long" + ", prefix_tokens array<long>" * with_table
    out = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), spark_schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *["prefix_tokens"] * with_table)
