"""The workspace manifest: namespaces with sources, classes and dependencies, as rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: Where a manifest is looked for in a root, in this order.
PLACES = ("mbt.json", ".metals/mbt.json")


def find(roots: list[str]) -> str | None:
    """The first manifest in the order of the roots."""
    return next((p for r in roots for place in PLACES if os.path.isfile(p := os.path.join(r, place))), None)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row: namespaces and dependencyModules; keys that are not known are ignored, missing ones null."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def targets(manifest: DataFrame) -> DataFrame:
    """(namespace, ord, sources, classes, dependency_modules, depends_on, image), missing arrays empty, by name."""
    none = F.array().cast("array<string>")
    t = manifest.select(F.posexplode(F.array_sort(F.map_entries(F.coalesce("namespaces", F.create_map().cast(f"map<string,{schemas.MANIFEST_TARGET}>"))), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("ord", "e"))
    image = F.when(F.col("e.value.javaHome").isNotNull(), F.concat(F.lit("jrt://"), F.col("e.value.javaHome")))
    pick = lambda f: F.coalesce(F.col(f"e.value.{f}"), none)
    return t.select(F.col("e.key").alias("namespace"), "ord", pick("sources").alias("sources"), pick("classes").alias("classes"), pick("dependencyModules").alias("dependency_modules"), pick("dependsOn").alias("depends_on"), image.alias("image"))


def modules(manifest: DataFrame) -> DataFrame:
    """(ord, id, jar, sources)."""
    return manifest.select(F.posexplode("dependencyModules").alias("ord", "m")).select("ord", "m.*")


def input_sources(manifest: DataFrame) -> DataFrame:
    """(rank, kind, path): sources and classes of each target, its image, then the jars; each path once, the first wins."""
    t = targets(manifest)
    step = lambda column, kind, k: t.select(F.lit(0).alias("a"), "ord", F.lit(k).alias("b"), F.posexplode(column).alias("c", "path"), F.lit(kind).alias("kind"))
    images = t.where("image is not null").select(F.lit(0).alias("a"), "ord", F.lit(2).alias("b"), F.lit(0).alias("c"), F.col("image").alias("path"), F.lit("image").alias("kind"))
    jars = modules(manifest).where("jar is not null").select(F.lit(1).alias("a"), "ord", F.lit(0).alias("b"), F.lit(0).alias("c"), F.col("jar").alias("path"), F.lit("jar").alias("kind"))
    rows = step("sources", "dir", 0).unionByName(step("classes", "dir", 1)).unionByName(images).unionByName(jars)
    first = rows.groupBy("path").agg(F.min(F.struct("a", "ord", "b", "c", "kind")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("rank"), F.col("at.kind").alias("kind"), "path")  # as many rows as the manifest has paths


def server_sources(manifest: DataFrame) -> DataFrame:
    """(kind, path) as the server flattens it: sources only, images, and the jars that a target names."""
    t = targets(manifest)
    named = t.select(F.explode("dependency_modules").alias("id")).distinct().join(modules(manifest), "id")
    rows = t.select(F.lit("dir").alias("kind"), F.explode("sources").alias("path")).union(t.where("image is not null").select(F.lit("image"), "image")).union(named.where("jar is not null").select(F.lit("jar"), "jar"))
    return rows.distinct()


def source_jars(manifest: DataFrame, exists: DataFrame | None = None) -> DataFrame:
    """(jar, sources): the first sources archive of each jar; with `exists` (path), both files must be there."""
    m = modules(manifest).where("jar is not null and sources is not null")
    if exists is not None:
        m = m.join(exists.select(F.col("path").alias("jar")), "jar", "left_semi").join(exists.select(F.col("path").alias("sources")), "sources", "left_semi")
    return m.groupBy("jar").agg(F.min_by("sources", "ord").alias("sources"))


def options(values: dict | None) -> dict:
    """Options given as numbers or numeric text; what is not known or not a number stays at its default."""
    out = {"candidate_cap": 0, "source": "java", "bytecode": "full"}
    for k, v in (values or {}).items():
        if k in out and isinstance(out[k], int):
            try:
                out[k] = int(float(v))
            except (TypeError, ValueError):
                continue
        elif k in out and isinstance(v, str):
            out[k] = v
    return out
