"""Type hierarchy: supertype edges, one level up or down, and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.descriptors import unnested
from .classpath import rank
from .rounds import keep, release

#: What a declaration extends when it names nothing.
IMPLICIT = {"ENUM": "java/lang/Enum", "RECORD": "java/lang/Record"}
OBJECT, ANNOTATION = "java/lang/Object", "java/lang/annotation/Annotation"


def implicit_super(kind: Column | str, modifiers: Column | str) -> Column:
    k, m = (F.col(x) if isinstance(x, str) else x for x in (kind, modifiers))
    is_enum = (k == "ENUM") | k.isNull() & (m.bitwiseAND(F.lit(0x4000)) != 0)
    return F.when(is_enum, IMPLICIT["ENUM"]).when(k == "RECORD", IMPLICIT["RECORD"]).otherwise(OBJECT)


def erased(sig: Column | str) -> Column:
    """The binary name in a class signature: without L, type arguments and the semicolon; a plain name stays."""
    s = unnested(sig)
    return F.translate(F.regexp_replace(F.regexp_replace(s, "^[LU](.*);$", "$1"), ";$", ""), ".", "$")


def super_edges(types: DataFrame) -> DataFrame:
    """(sub_jvm, super_jvm, kind, ord) of each declaration: its superclass, named or implied, and its interfaces."""
    annotation = F.when((F.col("decl_kind") == "ANNOTATION"), F.array(F.struct(F.lit("interface").alias("kind"), F.lit(ANNOTATION).alias("name"))))
    none = F.array().cast("array<struct<kind:string,name:string>>")
    first = F.array(F.struct(F.lit("class").alias("kind"), F.coalesce(erased("super_sig"), implicit_super("decl_kind", "modifiers")).alias("name")))
    rest = F.transform(F.coalesce("interface_sigs", F.array().cast("array<string>")), lambda i: F.struct(F.lit("interface").alias("kind"), erased(i).alias("name")))
    edges = types.where(F.col("jvm_name") != OBJECT).select(F.col("jvm_name").alias("sub_jvm"), F.posexplode(F.concat(first, rest, F.coalesce(annotation, none))).alias("ord", "e"))
    return edges.select("sub_jvm", F.col("e.name").alias("super_jvm"), F.col("e.kind").alias("kind"), "ord").dropDuplicates(["sub_jvm", "super_jvm"])


def direct_supertypes(edges: DataFrame, name: str | Column, winners: DataFrame | None = None) -> DataFrame:
    """Edges up from a type; with winners, those that lead to a visible declaration, with it."""
    found = edges.where(F.col("sub_jvm") == name)
    return found if winners is None else found.join(winners, found["super_jvm"] == winners["jvm_name"])


def direct_subtypes(edges: DataFrame, name: str, permits: DataFrame | None = None, winners: DataFrame | None = None) -> DataFrame:
    """(sub_jvm, super_jvm, permitted) down from a type: those that it permits, then those that name it; each once.

    permits: (super_jvm, sub_jvm, ord). The inverted edge table stands in for probing filters of all files.
    """
    down = edges.where(F.col("super_jvm") == name).select("sub_jvm", "super_jvm", F.lit(1 << 20).alias("ord"))
    if permits is not None:
        down = permits.where(F.col("super_jvm") == name).select("sub_jvm", "super_jvm", "ord").unionByName(down)
    out = down.groupBy("sub_jvm", "super_jvm").agg(F.min("ord").alias("ord")).withColumn("permitted", F.col("ord") < 1 << 20)
    return out if winners is None else out.join(winners.select(F.col("jvm_name").alias("sub_jvm")), "sub_jvm", "left_semi")


def closure(edges: DataFrame, starts: DataFrame, sub: str = "sub_jvm", sup: str = "super_jvm", at_once: int = 4) -> DataFrame:
    """(start, reached, depth): all supertypes of the starts (column `start`) with the least depth; cycles end.

    Semi-naive: each step joins only what the step before reached first, until nothing is new. A hierarchy is as deep as its
    longest chain; `at_once` steps make a round, whose result is kept.
    """
    pairs = keep(edges.select(F.col(sub).alias("__sub"), F.col(sup).alias("__sup")).distinct())
    first = starts.select("start").distinct().join(pairs, F.col("start") == F.col("__sub")).select("start", F.col("__sup").alias("reached"), F.lit(1).alias("depth"))
    reached, last, depth, used = keep(first), 1, 1, [pairs]
    used.append(reached)
    while True:
        step, more = reached.where(F.col("depth") == last).select("start", "reached"), []
        for _ in range(at_once):  # within a round, what was reached before may be reached again
            depth += 1
            step = step.join(pairs, F.col("reached") == F.col("__sub")).select("start", F.col("__sup").alias("reached")).distinct()
            more.append(step.withColumn("depth", F.lit(depth)))
        found = more[0]
        for m in more[1:]:
            found = found.unionByName(m)
        found = found.groupBy("start", "reached").agg(F.min("depth").alias("depth")).join(reached.select("start", "reached"), ["start", "reached"], "left_anti")
        found = keep(found)
        used.append(found)
        reached = reached.unionByName(found)
        last = depth
        if found.where(F.col("depth") == last).isEmpty():
            return release(used, reached)


CLOSURE_SQL = """
WITH RECURSIVE walk AS (
  SELECT s.start, e.{sup} AS reached, 1 AS depth, array(s.start, e.{sup}) AS path FROM {starts} s JOIN {edges} e ON s.start = e.{sub}
  UNION ALL
  SELECT w.start, e.{sup}, w.depth + 1, array_append(w.path, e.{sup}) FROM walk w JOIN {edges} e ON w.reached = e.{sub}
  WHERE NOT array_contains(w.path, e.{sup})
)
SELECT start, reached, min(depth) AS depth FROM walk GROUP BY start, reached
"""


def entry_for(types: DataFrame, name: str, origin: str | None, path: list[str] | None, uri: str = "source_uri") -> DataFrame:
    """The declaration of an item: that of its own resource if it is visible, else the pick."""
    found = types.where(F.col("jvm_name") == name).withColumn("__rank", rank(uri, path)).where("__rank >= 0")
    own = F.coalesce(F.col("resource_uri") == F.lit(origin), F.lit(False))
    return found.orderBy(own.desc(), "__rank", uri, "resource_path").limit(1).drop("__rank")


def item_key(origin: Column | str, name: Column | str) -> Column:
    o, n = (F.col(x) if isinstance(x, str) else x for x in (origin, name))
    return F.concat(F.lit("T:"), F.coalesce(o, F.lit("")), F.lit("|"), n)


def origin_of_key(key: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.col(key) if isinstance(key, str) else key, r"^T:(.*?)\|(.*)$", 1), F.lit(""))


def name_of_key(key: Column | str) -> Column:
    return F.nullif(F.regexp_extract(F.col(key) if isinstance(key, str) else key, r"^T:(.*?)\|(.*)$", 2), F.lit(""))


def items(types: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Rows to show: name, detail, key and, with locations (jvm_name, line, col), where; `locatable` says whether."""
    shown = types.select("jvm_name", names.simple_name("jvm_name").alias("name"), names.display_name(names.package_of("jvm_name")).alias("detail"), item_key("resource_uri", "jvm_name").alias("key"))
    return shown if locations is None else shown.join(locations, "jvm_name", "left").withColumn("locatable", F.col("line").isNotNull())
