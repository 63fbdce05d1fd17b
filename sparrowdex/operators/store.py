"""The index as tables: reads, writes by resource, package closure.

Rows are a multiset: a name can have many declarations. A resource is (source_uri, resource_path). Tables written by
`save` are dealt by source and sorted by name, so a point lookup and a prefix search skip row groups by their statistics
and a replacement rewrites its own source only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

RESOURCE = ["source_uri", "resource_path"]


def get_all(types: DataFrame, name: str, key: str = "jvm_name") -> DataFrame:
    return types.where(F.col(key) == name)


def contains(types: DataFrame, name: str, key: str = "jvm_name") -> bool:
    return not get_all(types, name, key).isEmpty()


def known_packages(types: DataFrame, package: str | Column = "package_jvm") -> DataFrame:
    """(package_jvm) of each package that holds a type, and of those above it; the default package is none."""
    p = F.col(package) if isinstance(package, str) else package
    return types.select(p.alias("p")).distinct().select(F.explode(names.ancestors("p")).alias("package_jvm")).distinct()


def has_package(types: DataFrame, package: str) -> bool:
    return not types.where((F.col("package_jvm") == package) | F.startswith(F.col("package_jvm"), F.lit(package + "/"))).isEmpty() if package else False


def list_package(types: DataFrame, package: str | None, recursive: bool = False, column: str = "package_jvm") -> DataFrame:
    """Rows of a package (null: the default one) and, if recursive, of those below it; everything is below the default."""
    p, at = package or "", F.col(column)
    if not recursive:
        return types.where(at == p)
    return types.where((at == p) | F.startswith(at, F.lit(p + "/"))) if p else types.where(at.isNotNull())


def by_prefix(types: DataFrame, prefix: str, key: str = "jvm_name") -> DataFrame:
    """Top-level types whose simple name begins with the prefix."""
    return types.where(~F.contains(F.col(key), F.lit("$")) & F.startswith(names.last_segment(key), F.lit(prefix)))


def search_prefix(types: DataFrame, prefix: str, limit: int, key: str = "jvm_name", ties: tuple[str, ...] = ()) -> DataFrame:
    """The first `limit` of them in order; none for limit <= 0."""
    return by_prefix(types, prefix, key).orderBy(key, *ties).limit(max(limit, 0))


def counts(types: DataFrame, key: str = "jvm_name") -> DataFrame:
    """distinct names and rows."""
    return types.agg(F.countDistinct(key).alias("size"), F.count("*").alias("entry_count"))


def is_empty(*tables: DataFrame) -> bool:
    return all(t.isEmpty() for t in tables)


def filtered(types: DataFrame, predicate: Column | DataFrame) -> DataFrame:
    """Rows by a predicate on the resource columns, or of the resources in a table."""
    return types.join(predicate.select(*RESOURCE).distinct(), RESOURCE, "left_semi") if isinstance(predicate, DataFrame) else types.where(predicate)


def get_modules(modules: DataFrame, name: str) -> DataFrame:
    return modules.where(F.col("name") == name)


def get_module(modules: DataFrame, name: str) -> DataFrame:
    return get_modules(modules, name).orderBy(*RESOURCE).limit(1)


def module_count(modules: DataFrame) -> DataFrame:
    return modules.agg(F.countDistinct("name").alias("module_count"))


# --- writes -----------------------------------------------------------------------------------------------------------


def add(types: DataFrame, rows: DataFrame, key: str = "jvm_name") -> DataFrame:
    """types and the rows that may be types."""
    return types.unionByName(rows.where(~names.is_skipped_name(key)), allowMissingColumns=True)


def add_all(*tables: DataFrame) -> DataFrame:
    """Union of all rows."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def delete_resources(rows: DataFrame, resources: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    return rows.join(resources.select(*key).distinct(), key, "left_anti")


def put_resources(rows: DataFrame, resources: DataFrame, replacement: DataFrame, key: list[str] = RESOURCE) -> DataFrame:
    """rows without those of the resources, and the replacement. Types, modules and filters are replaced alike."""
    return delete_resources(rows, resources, key).unionByName(replacement, allowMissingColumns=True)


def distinct_union(*tables: DataFrame) -> DataFrame:
    return add_all(*tables).distinct()


def save(types: DataFrame, path: str, buckets: int = 64) -> None:
    """Writes a table in folders by a hash of the source, sorted by name within files."""
    table = types.withColumn("bucket", F.pmod(F.xxhash64("source_uri"), F.lit(buckets)).cast("int"))
    table.repartition("bucket", F.pmod(F.xxhash64("jvm_name"), F.lit(16))).sortWithinPartitions("bucket", "jvm_name").write.partitionBy("bucket").mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def save_replacement(spark: SparkSession, path: str, resources: DataFrame, replacement: DataFrame, staging: str, buckets: int = 64) -> None:
    """Replaces resources in a saved table: only the folders of their sources are read and written again."""
    bucket = F.pmod(F.xxhash64("source_uri"), F.lit(buckets)).cast("int")
    touched = [r[0] for r in resources.select(bucket.alias("b")).union(replacement.select(bucket.alias("b"))).distinct().collect()]  # `buckets` at most
    now = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    put_resources(now, resources, replacement.withColumn("bucket", bucket)).write.mode("overwrite").parquet(staging)
    fresh = spark.read.parquet(staging)
    mode = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        fresh.sortWithinPartitions("bucket", "jvm_name").write.partitionBy("bucket").mode("overwrite").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
