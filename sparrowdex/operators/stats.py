"""Scan statistics and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def scan_stats(resources: DataFrame, path: str | Column, size: str | Column) -> DataFrame:
    """source_files, class_files, class_bytes; a negative or null size counts as 0."""
    p, n = (F.col(x) if isinstance(x, str) else x for x in (path, size))
    known = F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long")
    return resources.agg(
        F.count_if(F.endswith(p, F.lit(".java"))).alias("source_files"), F.count_if(F.endswith(p, F.lit(".class"))).alias("class_files"),
        F.coalesce(F.sum(F.when(F.endswith(p, F.lit(".class")), known)), F.lit(0)).alias("class_bytes"),
    )


def jar_stats(sources: DataFrame, uri: str = "source_uri", size: str = "length") -> DataFrame:
    return sources.where(F.endswith(F.lower(F.col(uri)), F.lit(".jar"))).agg(F.count("*").alias("jars"), F.coalesce(F.sum(size), F.lit(0)).alias("jar_bytes"))


def top_by_bytes(rows: DataFrame, group: str, size: str | Column, n: int) -> DataFrame:
    """group, count, bytes, average (rounded down) of the n groups with most bytes; ties by the group."""
    s = F.col(size) if isinstance(size, str) else size
    out = rows.groupBy(group).agg(F.count("*").alias("count"), F.sum(s).cast("long").alias("bytes"))
    return out.withColumn("average", F.expr("bytes div count")).orderBy(F.desc("bytes"), group).limit(n)


def retained_bytes(rows: DataFrame, group: str) -> DataFrame:
    """Size of the rows of each group as text, in place of the size of objects in a heap."""
    return rows.groupBy(group).agg(F.count("*").alias("count"), F.sum(F.octet_length(F.to_json(F.struct(*rows.columns)))).cast("long").alias("bytes"))


def coalesced_problems(rows: DataFrame, code: str, message: Column | str, place: Column | str, limit: int | None = None) -> DataFrame:
    """code, message (normalised), count and the first place; most frequent first, ties by message and code."""
    p = F.col(place) if isinstance(place, str) else place
    out = rows.groupBy(F.col(code).alias("code"), names.normal_message(message).alias("message")).agg(F.count("*").alias("count"), F.min(p).alias("first_place"))
    return out if limit is None else out.orderBy(F.desc("count"), "message", "code").limit(limit)


def listed_files(paths: DataFrame, path: str, excluded: list[str]) -> DataFrame:
    """Paths in order, without those that pass through an excluded folder."""
    gone = F.array(*map(F.lit, excluded)).cast("array<string>")
    return paths.where(~F.arrays_overlap(F.split(F.col(path), "/"), gone)).select(path).orderBy(path)
