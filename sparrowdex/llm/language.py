"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on the executors and sums them by (language, bucket); the driver turns the sums, at most
languages x BUCKETS of them, into a matrix of log probabilities that goes to every task. Scoring hashes a batch of texts
at once in numpy and sums the matrix rows of the buckets that occur.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .workspace import lean, small_batches

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Characters that are hashed at once.
SLICE = 1 << 18
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of its text, whether each text has a letter).

    Texts are lower-cased, everything but letters becomes one boundary mark, and n-grams of the ORDERS are taken within
    words with their boundary marks.
    """
    lowered = [f"\n{t.lower()}\n" if t else "" for t in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, lowered), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letter = letter_table()[np.minimum(code, 0x10FFFF)]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:]  # one mark before and after each word
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    owner, letter = owner[keep], letter[keep]
    n = len(code)
    buckets, owners = [], []
    h, inner = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(1, min(max(ORDERS), n) + 1):
        # h[i]: hash of the k codes from i on; inner[i]: those but the first and the last are letters
        h = h[: n - k + 1] * np.uint64(0x9E3779B97F4A7C15) + (code[k - 1 :] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        inner = inner[: n - k + 1]
        if k > 2:
            inner = inner & letter[k - 2 : n - 1]
        if k in ORDERS:
            good = inner & (letter[: n - k + 1] | letter[k - 1 :] | (k > 2)) & (owner[: n - k + 1] == owner[k - 1 :])
            x = h[good]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((x >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int32))
            owners.append(owner[: n - k + 1][good])
    return (np.concatenate(buckets) if buckets else np.zeros(0, np.int32)), (np.concatenate(owners) if owners else np.zeros(0, np.int32)), has


def slices(texts: list[str | None]):
    """(first, last) of runs of texts of about SLICE characters; one long text is a run of its own."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and held + n > SLICE:
            yield first, i
            first, held = i, 0
        held += n
    if len(texts) > first:
        yield first, len(texts)


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # BUCKETS x languages, log probabilities
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language and its posterior probability; und and 0 without a letter."""
        langs, scores, _ = self.judge(texts)
        return langs, scores

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """predict(), and how many nats the mean n-gram of each text is less likely than that of the language's training
        rows; this doesn't saturate: the posterior only compares the languages that are learned."""
        langs: list[str] = []
        scores: list[float] = []
        gaps: list[float] = []
        usual = (np.exp(self.matrix) * self.matrix).sum(0)
        k = len(self.languages)
        for a, z in slices(texts):
            bucket, owner, has = grams(texts[a:z])
            total = np.zeros((z - a, max(k, 1)))
            for j in range(k):
                total[:, j] = self.prior[j] + np.bincount(owner, self.matrix[:, j][bucket], z - a)
            best = total.argmax(1)
            score = 1 / np.exp(total - total[np.arange(z - a), best][:, None]).sum(1)
            ok = has & (k > 0)
            if k:
                mean = (total[np.arange(z - a), best] - self.prior[best]) / np.maximum(np.bincount(owner, minlength=z - a), 1)
                gaps += np.where(ok, usual[best] - mean, np.inf).tolist()
            else:
                gaps += [np.inf] * (z - a)
            langs += [self.languages[b] if o else "und" for b, o in zip(best, ok, strict=True)]
            scores += np.where(ok, score, 0.0).tolist()
        return langs, scores, gaps


def fit(docs: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """A model of the rows with text and language.

    sample_rows bounds the expected number of rows that are learned from: with more, those with the smallest hash of the
    id are taken, whichever their language. Without rows to learn from, the model knows no language.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    n = docs.where(F.col(lang_col).isNotNull()).count()
    if n > sample_rows:
        rows = rows.where(F.xxhash64("id") < int(-(2**63) + 2**64 * (sample_rows / n)))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in slices(texts):
                bucket, owner, _ = grams(texts[a:z])
                names, which = np.unique(np.array(langs[a:z], object), return_inverse=True)
                for j, name in enumerate(names):
                    mine = bucket[(which == j)[owner]]
                    sums[name] = sums.get(name, 0) + np.bincount(mine, minlength=BUCKETS)
                    seen[name] = seen.get(name, 0) + int((which == j).sum())
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([name] * (len(at) + 1)), pa.array([*at.tolist(), -1], pa.int32()), pa.array([*c[at].tolist(), seen[name]], pa.int64())], names=["lang", "bucket", "n"])

    summed = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    at = {x: j for j, x in enumerate(langs)}
    counts = np.zeros((BUCKETS, len(langs)))
    prior = np.zeros(len(langs))
    col = np.array([at[x] for x in table["lang"].to_pylist()], int)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    real = bucket >= 0
    counts[bucket[real], col[real]] = n[real]
    prior[col[~real]] = n[~real]
    matrix = np.log(counts + smoothing) - np.log((counts + smoothing).sum(0))
    return LanguageModel(langs, matrix, np.log(prior / max(prior.sum(), 1)) if len(langs) else prior)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), gap: bool = False) -> DataFrame:
    """One row per row of docs: id, the columns named in keep, lang_pred and score; with gap, also that of judge().

    A text that is null or has no letter, or any text under a model without languages, is `und` with score 0. Whole
    texts are read, however long. Null ids and repeated rows stay as they are; other columns are dropped.
    """
    seen = docs.sparkSession.sparkContext.broadcast(model)
    kept = small_batches(docs).select(F.col(id_col).alias(id_col), *keep)
    rows = kept if text_col in keep else docs.select(*kept.columns, text_col)
    at, width = rows.columns.index(text_col), len(kept.columns)

    def run(batches):
        for b in batches:
            langs, *numbers = seen.value.judge(b.column(at).cast(pa.string()).to_pylist())
            found = [pa.array(langs, pa.string()), *[pa.array(x, pa.float64()) for x in numbers]]
            yield pa.record_batch([*b.columns[:width], *found[: len(names)]], names=[*b.schema.names[:width], *names])

    names = ["lang_pred", "score", *["gap"] * gap]
    return rows.mapInArrow(lean(run), StructType([*kept.schema.fields, *[StructField(x, DoubleType() if k else StringType()) for k, x in enumerate(names)]]))


def held_out(id_col: str = "doc_id"):
    """crc32(id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
