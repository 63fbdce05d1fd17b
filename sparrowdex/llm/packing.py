"""Packing by Karmarkar-Karp multiway differencing.

A block of documents is packed where it is read; nothing is shuffled. Whole windows are cut from long documents. The
remainders go to ceil(sum / capacity) windows by differencing: two partial partitions with the largest imbalances are
merged, the fullest window of one with the emptiest of the other, until one near-equal partition is left. If one of its
windows exceeds the capacity, the window count rises and differencing starts again. The gaps of at least MIN_GAP tokens
are then filled from the emptiest window, whose rest is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import batches_of, coder
from .workspace import lean, small_batches

#: A smaller gap stays as padding: no snippet of fewer tokens is cut to fill one.
MIN_GAP = 16


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of item numbers with near-equal sums."""
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, x in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = x
        heap.append((-x, i, sums, [None] * (k - 1) + [i]))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        joined = [p if q is None else q if p is None else (p, q) for p, q in zip(x, reversed(y), strict=True)]
        sums -= sums[0]  # only the differences count for what is still to come
        heapq.heappush(heap, (-int(sums[-1]), tie, sums, [joined[i] for i in order]))
        tie += 1

    def items(tree) -> list[int]:
        out, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            elif x is not None:
                out.append(x)
        return sorted(out)

    return [items(t) for t in heap[0][3]] if heap else [[] for _ in range(k)]


def windows(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (document number, start, length), each within the capacity, each token in one piece."""
    out: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        out += [[(d, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rests.append((d, n - n % capacity, n % capacity))
    if not rests:
        return out
    sizes = [r[2] for r in rests]
    k = -(-sum(sizes) // capacity)
    while True:
        bins = difference(sizes, k)
        sums = [sum(sizes[i] for i in b) for b in bins]
        over = sum(max(0, x - capacity) for x in sums)
        if not over:
            break
        k += max(1, over // capacity, k // 64)
    packed = sorted(([rests[i] for i in b] for b in bins if b), key=lambda w: sum(p[2] for p in w))
    while len(packed) > 1:  # the emptiest window fills the gaps of the others
        spare, rest = packed[0], packed[1:]
        gaps = [capacity - sum(p[2] for p in w) for w in rest]
        if max(gaps) < MIN_GAP and sum(p[2] for p in spare) >= capacity - MIN_GAP:
            break
        left = _deal(spare, rest, gaps)
        if left:
            packed = [left, *rest]
            break
        packed = sorted(rest, key=lambda w: sum(p[2] for p in w))
    fill = sum(p[2] for p in packed[0])
    if fill < capacity - MIN_GAP:
        first, packed = packed[0], packed[1:]
        for bit in range(fill.bit_length() - 1, -1, -1):
            if fill >> bit & 1:
                part, first = _split(first, 1 << bit)
                out.append(part)
    return out + packed


def _split(pieces: list, n: int) -> tuple[list, list]:
    """The first n tokens of the pieces, and the rest."""
    head, tail = [], []
    for d, s, size in pieces:
        take = min(n, size)
        if take:
            head.append((d, s, take))
        if size > take:
            tail.append((d, s + take, size - take))
        n -= take
    return head, tail


def _deal(spare: list, rest: list[list], gaps: list[int]) -> list:
    for w, gap in sorted(zip(rest, gaps, strict=True), key=lambda x: -x[1]):
        if gap >= MIN_GAP and spare:
            part, spare = _split(spare, gap)
            w += part
    return spare


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 500, block_tokens: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, the ids.

    Each document is its ids and end_id; a null or empty text is end_id alone. Every id lies in exactly one piece;
    within a sequence, offsets are gapless from 0. A row with a null id is packed like any other and keeps the null;
    repeated rows are packed each. Other columns are dropped. block_docs and block_tokens bound what a task holds; a
    block ends with its partition. A document longer than block_tokens is a block of its own.
    """
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def run(batches):
        code, end = coder(path).code, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId() << 33
        serial = 0
        keys: list = []
        coded: list[bytes] = []
        held = 0

        def flush():
            nonlocal serial, held
            rows = [[] for _ in names]
            ids = []
            for w in windows([len(c) // 4 for c in coded], capacity):
                at = 0
                for d, s, n in w:
                    raw = coded[d][4 * s : 4 * (s + n)]
                    for col, v in zip(rows, (keys[d], s, n, zlib.crc32(raw), len(coded[d]) // 4, part + serial, at), strict=True):
                        col.append(v)
                    if with_ids:
                        ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
                    at += n
                serial += 1
            keys.clear()
            coded.clear()
            held = 0
            return pa.record_batch([pa.array(c, pa.int64()) for c in rows] + [pa.array(ids, pa.list_(pa.int64()))] * with_ids, schema=schema)

        for b in batches:
            for first, last in batches_of(b.column(1)):
                found = code(b.column(1).slice(first, last - first))
                for d, key in enumerate(b.column(0).slice(first, last - first).to_pylist()):
                    raw = found.of(d).tobytes() + end
                    if coded and held + len(raw) > 4 * block_tokens:
                        yield flush()
                    keys.append(key)
                    coded.append(raw)
                    held += len(raw)
                    if len(coded) >= block_docs:
                        yield flush()
        if coded:
            yield flush()

    spark_schema = ", ".join(f"{n} long" for n in names) + ", ids array<long>" * with_ids
    out = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), spark_schema)
    return out.withColumnRenamed("id", id_col)
