"""Bloom filters over identifiers as column expressions, and an exact alternative.

A filter is a struct (bit_count, hash_count, bits array<bigint>). It can only accelerate: the identifier table gives the
same final answers, so queries use the filter where it saves parsing and the table where it is at hand.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Fixed values of the filter format.
RATE, LEAST_BITS, MOST_HASHES = 0.01, 64, 8
FNV_START, FNV_PRIME = 0x811C9DC5, 0x01000193
MIX_FIRST, MIX_SECOND = 0x85EBCA6B, 0xC2B2AE35
MASK = 0xFFFFFFFF


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _times(h: Column, k: int) -> Column:
    """h * k in 32 bits; both halves of k are multiplied apart, as the whole product can exceed 64 bits."""
    high = (h * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF)) * F.lit(0x10000)
    return (h * F.lit(k & 0xFFFF) + high).bitwiseAND(F.lit(MASK))


def units(name: Column | str) -> Column:
    """The UTF-16 units of a name: a character beyond the first plane is two."""
    n = _col(name)
    codes = F.transform(F.when(F.length(n) > 0, F.sequence(F.lit(1), F.length(n))).otherwise(F.array().cast("array<int>")), lambda i: F.ascii(F.substr(n, i, F.lit(1))).cast("long"))
    high = lambda c: F.lit(0xD800).cast("long") + F.shiftright(c - 0x10000, 10)
    low = lambda c: F.lit(0xDC00).cast("long") + (c - 0x10000).bitwiseAND(F.lit(0x3FF).cast("long"))
    wide = lambda codes: F.flatten(F.transform(codes, lambda c: F.when(c > 0xFFFF, F.array(high(c), low(c))).otherwise(F.array(c))))
    return _bound(codes, lambda x: F.when(F.octet_length(n) == F.length(n), x).otherwise(wide(x)))


def hash_one(name: Column | str) -> Column:
    """FNV-1a in 32 bits over the UTF-16 units, as an unsigned number."""
    return F.aggregate(units(name), F.lit(FNV_START).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(MASK)))


def _bound(value: Column, f) -> Column:
    """f(value), the value being computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def hash_two(name: Column | str) -> Column:
    """A mixture of length, first and last unit, made odd, as an unsigned 32-bit number."""
    shifted = lambda h, by: h.bitwiseXOR(F.shiftrightunsigned(h, by))
    start = lambda u: F.when(F.size(u) > 0, ((F.size(u).cast("long") * 31 + F.element_at(u, 1)) * 31 + F.element_at(u, -1))).otherwise(F.lit(0).cast("long")).bitwiseAND(F.lit(MASK))
    h = _bound(units(name), start)
    h = _bound(_bound(h, lambda x: shifted(x, 16)), lambda x: _times(x, MIX_FIRST))
    h = _bound(_bound(h, lambda x: shifted(x, 13)), lambda x: _times(x, MIX_SECOND))
    return _bound(h, lambda x: shifted(x, 16).bitwiseOR(F.lit(1).cast("long")))


def bit_count(n: Column | str) -> Column:
    return F.when(_col(n) == 0, LEAST_BITS).otherwise(F.greatest(F.lit(LEAST_BITS), F.ceil(-_col(n) * F.lit(math.log(RATE)) / F.lit(math.log(2) ** 2)))).cast("int")


def hash_count(n: Column | str) -> Column:
    m = bit_count(n)
    return F.when(_col(n) == 0, 1).otherwise(F.least(F.lit(MOST_HASHES), F.greatest(F.lit(1), F.floor(m / _col(n) * F.lit(math.log(2)) + 0.5)))).cast("int")


def _signed(h: Column) -> Column:
    return F.when(h > 0x7FFFFFFF, h - F.lit(1 << 32)).otherwise(h)


def position(one: Column, two: Column, i: Column, m: Column) -> Column:
    """The i-th bit of a name: floor-modulo of h1 + i * h2 in signed 32-bit arithmetic."""
    return F.pmod(_signed((one + i * two).bitwiseAND(F.lit(MASK))), m.cast("long"))


def positions(name: Column | str, m: Column | str, k: Column | str) -> Column:
    both = F.struct(hash_one(name).alias("one"), hash_two(name).alias("two"))
    return _bound(both, lambda h: F.transform(F.sequence(F.lit(0), _col(k) - 1), lambda i: position(h["one"], h["two"], i, _col(m))))


def build(identifiers: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """One filter per key over its distinct names. Null names say nothing; a key without names has an empty filter.

    Two aggregations that combine before the shuffle: bits meet as (key, word) -> or, never as a list of names.
    """
    rows = identifiers.select(*keys, F.col(name).alias("__name")).distinct()
    sized = rows.groupBy(*keys).agg(F.count("__name").alias("n"))
    sized = sized.select(*keys, bit_count("n").alias("bit_count"), hash_count("n").alias("hash_count"))
    # each name is hashed once, before its bits are told apart
    hashed = rows.where("__name is not null").select(*keys, hash_one("__name").alias("h1"), hash_two("__name").alias("h2")).join(sized, keys)
    each = hashed.select(*keys, "h1", "h2", "bit_count", F.explode(F.sequence(F.lit(0), F.col("hash_count") - 1)).alias("i"))
    bits = each.select(*keys, position(F.col("h1"), F.col("h2"), F.col("i"), F.col("bit_count")).alias("bit"))
    words = bits.groupBy(*keys, F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    maps = words.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.ceil(F.col("bit_count") / 64).cast("int") - 1), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("long")), F.lit(0).cast("long")))
    return sized.join(maps, keys, "left").select(*keys, "bit_count", "hash_count", dense.alias("bits"))


def _hashes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """hash_one and hash_two of non-empty names, a unit of all names at a time."""
    raw = [x.encode("utf-16-le", "surrogatepass") for x in names]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    code = np.frombuffer(b"".join(raw), "<u2").astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    mask, one = np.uint64(MASK), np.full(len(raw), FNV_START, np.uint64)
    left = np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")  # names longer than j
    for j, n in enumerate(left.tolist()):
        some = order[:n]
        one[some] = (one[some] ^ code[starts[some] + j]) * np.uint64(FNV_PRIME) & mask
    h = ((sizes.astype(np.uint64) * np.uint64(31) + code[starts]) * np.uint64(31) + code[starts + sizes - 1]) & mask
    h = (h ^ (h >> np.uint64(16))) * np.uint64(MIX_FIRST) & mask
    h = (h ^ (h >> np.uint64(13))) * np.uint64(MIX_SECOND) & mask
    return one, h ^ (h >> np.uint64(16)) | np.uint64(1)


def build_in_rows(rows: DataFrame, keep: list[str], names: str = "names") -> DataFrame:
    """The columns in keep and the filter of each row over its own array of distinct names: no exchange. Empty and null
    names, and a null array, say nothing."""
    kept = rows.select(*keep)
    schema = StructType([*kept.schema.fields, StructField("bit_count", IntegerType()), StructField("hash_count", IntegerType()), StructField("bits", ArrayType(LongType()))])

    def run(batches):
        for b in batches:
            lists = [[x for x in v or () if x] for v in b.column(len(keep)).to_pylist()]
            n = np.fromiter(map(len, lists), np.int64, len(lists))
            some = np.maximum(n, 1)
            m = np.where(n == 0, LEAST_BITS, np.maximum(LEAST_BITS, np.ceil(-some * math.log(RATE) / math.log(2) ** 2))).astype(np.int64)
            k = np.where(n == 0, 1, np.clip(np.floor(m / some * math.log(2) + 0.5), 1, MOST_HASHES)).astype(np.int64)
            words = -(-m // 64)
            first = np.cumsum(words) - words
            bits = np.zeros(int(words.sum()), np.uint64)
            owner = np.repeat(np.arange(len(lists)), n)
            if len(owner):
                one, two = _hashes([x for v in lists for x in v])
                for i in range(MOST_HASHES):
                    mine = k[owner] > i
                    p = (one[mine] + np.uint64(i) * two[mine] & np.uint64(MASK)).astype(np.uint32).view(np.int32).astype(np.int64) % m[owner[mine]]
                    np.bitwise_or.at(bits, first[owner[mine]] + (p >> 6), np.uint64(1) << (p & 63).astype(np.uint64))
            ends = np.concatenate([[0], np.cumsum(words)]).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.view(np.int64)))
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(m.astype(np.int32)), pa.array(k.astype(np.int32)), made], names=schema.names)

    return rows.select(*keep, names).mapInArrow(run, schema)


def might_contain(name: Column | str, m: Column | str = "bit_count", k: Column | str = "hash_count", bits: Column | str = "bits") -> Column:
    """False only if the name was not added; false for a null or empty name."""
    n = _col(name)
    at = lambda p: F.element_at(_col(bits), (F.floor(p / 64) + 1).cast("int"))
    found = F.forall(positions(n, m, k), lambda p: F.call_function("shiftrightunsigned", at(p), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.when(F.coalesce(F.length(n), F.lit(0)) == 0, False).otherwise(found)
