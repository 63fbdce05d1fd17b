"""Toxicity categories by a classifier chain.

The categories are predicted one after the other; the linear model of a category sees the words of a text and the
probabilities of the categories before it. In training those probabilities are out of fold: each row's come from models
that were fitted without it, so a later model learns how far an earlier one can be trusted. Features are the distinct
words of the whole text and the distinct beginnings of its words, hashed; of these, those that tell some category's rows
best are kept, FEATURES of them at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .language import letter_table, slices
from .linear import Logistic, Sparse, fit_logistic
from .workspace import lean, small_batches

BUCKETS = 1 << 20
BEGINNINGS = (3, 4, 5, 6)
FEATURES = 2048
FOLDS = 3


def word_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct features of each text, sorted: hashed lower-case words and beginnings."""
    lowered = [t.lower() if t else "" for t in texts]
    code = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[np.minimum(code, 0x10FFFF)]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), at, side="right")
    own = code[letter].astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(letter)[at] - 1
    sizes = np.diff(np.append(starts, len(own)))
    # the hash of a run of letters is a polynomial, so that of a beginning is a difference of running sums
    power = np.cumprod(np.full(len(own), 0x9E3779B97F4A7C15, np.uint64))
    inverse = np.cumprod(np.full(len(own), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(own * power)])
    found = []
    for kind, n in ((0, None), *enumerate(BEGINNINGS, 1)):
        which = np.arange(len(at)) if n is None else np.flatnonzero(sizes > n)
        a = starts[which]
        z = a + (sizes[which] if n is None else n)
        h = (sums[z] - sums[a]) * inverse[a] + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(owner[which] * BUCKETS + (h >> np.uint64(44)).astype(np.int64))
    key = np.unique(np.concatenate(found))
    return key // BUCKETS, key % BUCKETS


@dataclass
class Chain:
    categories: list[str]
    place: np.ndarray  # bucket -> column, -1 for features that are not kept
    models: list[Logistic]

    def rows(self, texts: list[str | None]) -> Sparse:
        row, bucket = word_features(texts)
        column = self.place[bucket]
        kept = column >= 0
        return Sparse(len(texts), len(self.models[0].weights) if self.models else 0, row[kept], column[kept])

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row for each text and a column for each category in the order of the chain."""
        out = np.zeros((len(texts), len(self.categories)))
        for a, z in slices(texts):
            x = self.rows(texts[a:z])
            for j, m in enumerate(self.models):
                out[a:z, j] = m.predict(x, logit(out[a:z, :j]))
        return out


def logit(p: np.ndarray) -> np.ndarray:
    """Probabilities on a scale on which a linear model can use them."""
    q = np.clip(p, 0.01, 0.99)
    return np.log(q / (1 - q))


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain over `categories`, columns of labels with 0 or 1 (a number that is not positive counts as 0). The last one
    is what is decided; those before it need be no toxicity categories.

    sample_rows bounds the expected number of labelled rows that are learned from: with more, those with the smallest
    hash of the id are taken. Labels of null ids, without a document, or with a null category say nothing; of repeated
    labels of one id the largest counts. Without labelled rows every probability is 0.5.
    """
    marked = labels.dropna(subset=[id_col, *categories]).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.max((F.col(c) > 0).cast("int")).alias(f"y{j}") for j, c in enumerate(categories)])
    n = marked.count()
    if n > sample_rows:
        marked = marked.where(F.xxhash64("id") < int(-(2**63) + 2**64 * (sample_rows / n)))
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(marked), "id").select("id", "text", F.array(*[f"y{j}" for j in range(len(categories))]).alias("y"))  # sample_rows rows

    def count(batches):
        total = np.zeros((BUCKETS, 1 + len(categories)), np.int32)
        for b in batches:
            ys = np.array(b.column(2).to_pylist(), int).reshape(b.num_rows, len(categories))
            rows = b.column(1).to_pylist()
            for a, z in slices(rows):
                row, bucket = word_features(rows[a:z])
                total[:, 0] += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
                for j in range(len(categories)):
                    total[:, 1 + j] += np.bincount(bucket, ys[a:z][row, j], BUCKETS).astype(np.int32)
        at = np.flatnonzero(total[:, 0])
        for k in range(0, len(at), 100_000):
            part = at[k : k + 100_000]
            yield pa.record_batch([pa.array(part.astype(np.int32)), *[pa.array(total[part, c].astype(np.int64)) for c in range(1 + len(categories))]], names=["bucket", *[f"n{c}" for c in range(1 + len(categories))]])

    names = [f"n{c}" for c in range(1 + len(categories))]
    sums = sample.mapInArrow(lean(count), "bucket int, " + ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    whole = sample.agg(F.count("*"), *[F.sum(F.element_at("y", j + 1)) for j in range(len(categories))]).first()
    size, positive = whole[0], [int(x or 0) for x in whole[1:]]
    # how far the share of a category's rows that have a feature is from that of the others, in standard errors
    gap = [F.abs(F.col(f"n{j + 1}") / F.lit(max(p, 1)) - (F.col("n0") - F.col(f"n{j + 1}")) / F.lit(max(size - p, 1))) / F.sqrt((F.col("n0") + 1) / F.lit((size + 2) * max(min(p, size - p), 1))) for j, p in enumerate(positive)]
    best = sums.where("n0 >= 3").select("bucket", F.greatest(*gap, F.lit(0.0)).alias("gap")).orderBy(F.desc("gap"), "bucket").limit(FEATURES)
    chosen = sorted(best.toArrow()["bucket"].to_pylist())
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def reduce(batches):
        for b in batches:
            rows, out = b.column(1).to_pylist(), []
            for a, z in slices(rows):
                row, bucket = word_features(rows[a:z])
                column = shared.value[bucket]
                row, column = row[column >= 0], column[column >= 0]
                out += np.split(column, np.searchsorted(row, np.arange(1, z - a)))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(out, pa.list_(pa.int32()))], names=["id", "y", "x"])

    table = sample.mapInArrow(reduce, "id long, y array<int>, x array<int>").toArrow().sort_by("id")
    y = np.array(table["y"].to_pylist(), float).reshape(table.num_rows, len(categories))
    xs = table["x"].to_pylist()
    x = Sparse(len(xs), max(len(chosen), 1), np.repeat(np.arange(len(xs)), [len(v) for v in xs]), np.array([c for v in xs for c in v], int))
    return Chain(categories, place, chain_models(x, y))


def chain_models(x: Sparse, y: np.ndarray) -> list[Logistic]:
    """The models of a chain: each is fitted on the words and the out-of-fold probabilities of the categories before."""
    fold = np.random.default_rng(3).permutation(x.rows) % FOLDS
    before, models = np.zeros((x.rows, 0)), []
    for j in range(y.shape[1]):
        dense, unseen = logit(before), np.zeros(x.rows)
        if j + 1 < y.shape[1]:
            for f in range(FOLDS):
                rest = fold != f
                m = fit_logistic(x.take(rest), dense[rest], y[rest, j])
                unseen[~rest] = m.predict(x.take(~rest), dense[~rest])
        models.append(fit_logistic(x, dense, y[:, j]))
        before = np.column_stack([before, unseen])
    return models


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, the columns named in keep, and probabilities p_<category> from the whole text.

    A null or empty text is scored as a text without words; null ids and repeated rows stay; other columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]
    kept = small_batches(docs).select(F.col(id_col).alias(id_col), *keep)
    rows = kept if text_col in keep else docs.select(*kept.columns, text_col)
    at, width = rows.columns.index(text_col), len(kept.columns)
    schema = StructType([*kept.schema.fields, *[StructField(c, DoubleType()) for c in names]])

    def run(batches):
        for b in batches:
            p = shared.value.predict(b.column(at).cast(pa.string()).to_pylist())
            yield pa.record_batch([*b.columns[:width], *[pa.array(p[:, j]) for j in range(len(names))]], names=[*b.schema.names[:width], *names])

    return rows.mapInArrow(lean(run), schema)
