"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Candidate rows become blocks of posting lists: for each term the rows that have it, and their weights; zeros are in no
list. Query rows become blocks of QUERY_ROWS, dealt by a hash of their id. Every query block meets every candidate block:
where all queries together have at most BROADCAST_BYTES, they go to every task and the candidates stay where they are;
beyond, by an equi-join on (query block, salt), with the query blocks copied once per salt and each candidate block once
per query block. A task goes through the terms, scatters the query weights times the posting weights into a dense score
array of SCORE_ROWS queries, partitions it for the k best of each, and a window merges the blocks' winners.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS, CANDIDATE_ROWS, SCORE_ROWS = 8192, 2048, 512
BROADCAST_BYTES = 64 << 20
#: Candidate rows that a salt has at most, on average.
SALT_ROWS = 1 << 20


def quantised(vector: str, scale: int = 256):
    """floor(scale * x) of each component, or null for a vector that is null or holds a null or non-finite component."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(v.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * scale)))


def _packed(ids: np.ndarray, vectors: pa.Array) -> list[pa.Array]:
    """Columns ids, ends, flat of one block."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter((len(x) for x in vectors), np.int64, len(ids)))])
    return [pa.array([np.asarray(x, "<i8").tobytes()]) for x in (ids, ends, vectors.flatten())]


def _candidate_blocks(rows: DataFrame) -> DataFrame:
    """The rows (id, v) of each partition in blocks of CANDIDATE_ROWS at most; block is unique."""

    def run(batches):
        serial = TaskContext.get().partitionId() << 32
        for b in batches:
            for at in range(0, b.num_rows, CANDIDATE_ROWS):
                part = b.slice(at, CANDIDATE_ROWS)
                yield pa.record_batch([pa.array([serial]), *_packed(part.column(0).to_numpy(zero_copy_only=False), part.column(1))], names=["block", "ids", "ends", "flat"])
                serial += 1

    return rows.mapInArrow(run, "block long, ids binary, ends binary, flat binary")


def _query_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The rows (id, v) dealt by a hash of the id into `parts` blocks of about QUERY_ROWS."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                yield pa.record_batch([b.column(0).slice(i, 1), *_packed(np.asarray(b.column(1)[i].values), b.column(2)[i].values)], names=["q_block", "q_ids", "q_ends", "q_flat"])

    dealt = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("q_block")).agg(F.collect_list(F.struct("id", "v")).alias("r"))
    return dealt.select("q_block", "r.id", "r.v").mapInArrow(run, "q_block int, q_ids binary, q_ends binary, q_flat binary")


class Postings:
    """Lists of (row, weight) by term, for rows first to last of a block of sparse vectors; no zeros."""

    def __init__(self, ends: np.ndarray, flat: np.ndarray, first: int = 0, last: int | None = None):
        last = len(ends) - 1 if last is None else last
        part = flat[ends[first] : ends[last]]
        sizes = np.diff(ends[first : last + 1])
        row = np.repeat(np.arange(last - first), sizes)
        term = np.arange(len(part)) - np.repeat(ends[first:last] - ends[first], sizes)
        some = np.flatnonzero(part)
        some = some[np.argsort(term[some], kind="stable")]
        self.n, self.rows, self.weights = last - first, row[some], part[some]
        self.terms, starts = np.unique(term[some], return_index=True)
        self.at = np.append(starts, len(some))

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.rows[self.at[k] : self.at[k + 1]], self.weights[self.at[k] : self.at[k + 1]]


def accumulate(queries: Postings, candidates: Postings) -> np.ndarray:
    """Integer inner products, term after term; a term that either side lacks adds nothing."""
    scores = np.zeros((queries.n, candidates.n), np.int64)
    _, i, j = np.intersect1d(queries.terms, candidates.terms, assume_unique=True, return_indices=True)
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        rows, weights = queries.of(a)
        posted, values = candidates.of(b)
        added = np.multiply.outer(weights, values)
        if len(posted) == candidates.n:  # every candidate has the term
            if len(rows) == queries.n:
                scores += added
            else:
                scores[rows] += added
        else:
            scores[np.ix_(rows, posted)] += added
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query row, candidate column) of each row's k best other ids; ties to the smaller id."""
    for i, s in enumerate(scores):
        at = np.flatnonzero(ids != own[i])
        if len(at) > k:
            cut = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= cut]
        at = at[np.lexsort((ids[at], -s[at]))][:k]
        yield i, at


def top_k(rows: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row where is_query holds, its k best rows with another id.

    Vectors null or holding null or non-finite components, and rows with a null id, take no part on either side. Empty
    vectors score 0. Vectors of unequal length meet on their common components. Repeated rows with one id are each
    a candidate of other ids' queries; a repeated query row gives one answer per id. Fewer rows than k: all of them.
    The components' floors must fit in 32 bits for the score to fit in 64.
    """
    spark = rows.sparkSession
    usable = rows.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v"), is_query.alias("q")).where("id is not null and v is not null")
    asked = usable.where("q").groupBy("id").agg(F.min("v").alias("v"))  # one answer per id
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("v") + 2).alias("words")).first()
    parts = max(1, -(-size.n // QUERY_ROWS))
    blocks = _candidate_blocks(usable.select("id", "v")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asks = _query_blocks(asked, parts)
    if 8 * (size.words or 0) <= BROADCAST_BYTES:
        met = blocks.join(F.broadcast(asks), "q_block")
    else:
        salts = max(spark.sparkContext.defaultParallelism, -(-usable.count() // SALT_ROWS))
        asks = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(asks, ["q_block", "salt"])

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, ends, flat, q_ids, q_ends, q_flat = (np.frombuffer(b.column(c)[r].as_buffer(), "<i8") for c in range(6))
                candidates = Postings(ends, flat)
                for at in range(0, len(q_ids), SCORE_ROWS):
                    own = q_ids[at : at + SCORE_ROWS]
                    scores = accumulate(Postings(q_ends, q_flat, at, at + len(own)), candidates)
                    out: list[list] = [[], [], []]
                    for i, found in best(scores, ids, own, k):
                        out[0] += [own[i]] * len(found)
                        out[1] += ids[found].tolist()
                        out[2] += scores[i, found].tolist()
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["query_id", "id", "score"])

    found = met.select("ids", "ends", "flat", "q_ids", "q_ends", "q_flat").mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
