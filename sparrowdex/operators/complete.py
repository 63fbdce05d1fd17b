"""Completion: prefix search with tiers, shadowing and import edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.flags import PRIVATE, STATIC, has
from .classpath import visible
from .store import by_prefix, search_prefix


def prefix_at(text: Column | str, offset: Column | str) -> Column:
    """(prefix, qualified): the name that ends at the cursor, and whether a dot stands before it."""
    head = F.substr(F.col(text) if isinstance(text, str) else text, F.lit(1), F.col(offset) if isinstance(offset, str) else offset)
    # \z, as $ also holds before a line's end; no run is begun in its middle
    prefix = F.regexp_extract(head, r"(?<![\w$])[0-9]*+([A-Za-z_$][\w$]*+)\z", 1)
    before = F.substr(head, F.lit(1), F.length(head) - F.length(prefix))
    return F.struct(prefix.alias("prefix"), F.rlike(before, F.lit(r"\.\p{Zs}*+\z")).alias("qualified"))


def qualified_members(members: DataFrame, owner: str, prefix: str, static: bool) -> DataFrame:
    """Members of an owner that may be named after a dot: by prefix and access, without constructors."""
    m = members.where((F.col("owner") == owner) & F.startswith(F.col("name"), F.lit(prefix)) & (F.col("name") != "<init>"))
    m = m.where(~has("modifiers", PRIVATE))
    return m.where(has("modifiers", STATIC) | (F.col("kind") == "type")) if static else m.where(~has("modifiers", STATIC) & (F.col("kind") != "type"))


def package_members(types: DataFrame, packages: DataFrame, package: str, prefix: str) -> DataFrame:
    """Packages directly below a package, and its top-level types, by prefix."""
    inner = packages.where(names.package_of("package_jvm") == package).select(names.last_segment("package_jvm").alias("name"), F.lit("package").alias("kind"))
    outer = types.where((F.col("package_jvm") == package) & ~F.contains("jvm_name", F.lit("$"))).select(names.simple_name("jvm_name").alias("name"), F.lit("type").alias("kind"))
    return inner.union(outer).where(F.startswith("name", F.lit(prefix))).distinct()


def dedup_key(kind: Column | str, name: Column | str, params: Column | str) -> Column:
    k, n, p = (F.col(x) if isinstance(x, str) else x for x in (kind, name, params))
    return F.when(k == "method", F.concat(n, F.lit("("), F.array_join(p, ","), F.lit(")"))).otherwise(n)


def in_scope(rows: DataFrame, prefix: str, kind: str = "kind", name: str = "name", key: str | Column = "dedup_key", depth: str = "depth", ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows by prefix, for each key those of the innermost scope only: the first shadows the rest."""
    k = F.col(key) if isinstance(key, str) else key
    found = rows.where(F.startswith(F.col(name), F.lit(prefix))).withColumn("__k", k)
    return found.withColumn("__n", F.row_number().over(Window.partitionBy(kind, "__k").orderBy(depth, *ties))).where("__n = 1").drop("__n", "__k")


def unimported_types(types: DataFrame, prefix: str, path: list[str] | None, package: str, imported: list[str], on_demand: list[str], limit: int = 50, compat: bool = False) -> DataFrame:
    """Types by prefix with `needs_import`, each name once, `limit` at most.

    compat: the limit comes before visibility, as the reference's order of steps has it, and visible types can be missed.
    """
    ties = ("source_uri", "resource_path")
    if compat:
        found = visible(search_prefix(types, prefix, limit, ties=ties), "source_uri", path)
    else:
        found = visible(by_prefix(types, prefix), "source_uri", path)
    each = found.groupBy("jvm_name").agg(F.min(F.struct(*ties)).alias("at")).select("jvm_name", "at.*")
    p = names.package_of("jvm_name")
    known = (p == package) | (p == "java/lang") | F.col("jvm_name").isin(imported) | p.isin(on_demand)
    return each.withColumn("needs_import", ~known).orderBy("jvm_name").limit(limit)


def import_line(lines: DataFrame, keys: list[str], line: str = "line", text: str = "line_text") -> DataFrame:
    """Where an import goes: after the last import, else after the package, else line 0."""
    last = F.max(F.when(F.col(text).rlike(r"^\s*import\s"), F.col(line) + 1))
    package = F.min(F.when(F.col(text).rlike(r"^\s*package\s"), F.col(line) + 1))
    return lines.groupBy(*keys).agg(F.coalesce(last, package, F.lit(0)).alias("insert_line"))


def sort_text(name: Column | str, imported: Column | bool) -> Column:
    """In scope before what has to be imported."""
    tier = F.when(imported if isinstance(imported, Column) else F.lit(imported), "0_").otherwise("1_")
    return F.concat(tier, F.col(name) if isinstance(name, str) else name)


def batch_completion(types: DataFrame, members: DataFrame, prefix: str, path: list[str] | None, type_limit: int = 100, limit: int = 200) -> DataFrame:
    """kind and name: types by prefix, then fields and methods of all owners; the first of a name; `limit` at most."""
    shown = visible(search_prefix(types, prefix, type_limit, ties=("source_uri",)), "source_uri", path).select(F.lit("type").alias("kind"), names.simple_name("jvm_name").alias("name"))
    rest = members.where(F.startswith("name", F.lit(prefix)) & (F.col("name") != "<init>")).select("kind", "name")
    order = F.when(F.col("kind") == "type", 0).when(F.col("kind") == "field", 1).otherwise(2)
    return shown.union(rest).distinct().orderBy(order, "name").limit(limit)
