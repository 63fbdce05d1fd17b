"""Name resolution by ordered cascades.

A reference is a row: its context (owner, package, hints) and a simple name. Each cascade gives an ordered array of
candidates; candidates that need a visible declaration are checked against the table of available names by one
equi-join, and the first that holds wins. References are resolved once per distinct context and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .rounds import keep, release

#: Steps of the cascades, in their order: a step in CHECKED must name an available type, others hold as they are.
HIERARCHY = (["sibling", "single", "package", "on_demand", "java_lang"], {"sibling", "single", "package", "on_demand", "java_lang"}, "package")
COMPILER = (["member", "sibling", "single", "package", "on_demand"], {"package", "on_demand"}, "java_lang")
BATCH = (["member", "sibling", "single", "package", "on_demand", "java_lang"], {"sibling", "single", "package", "on_demand", "java_lang"}, "package")
QUALIFY_COMPILER = (["single", "sibling", "on_demand", "package"], {"single", "sibling", "on_demand", "package"}, "self")
SUPER_COMPILER = (["sibling", "single", "package", "on_demand"], {"package", "on_demand"}, None)
SUPER_BATCH = (["sibling", "single", "package", "on_demand"], {"sibling", "single", "package", "on_demand"}, None)


def _in_package(package: Column, simple: Column) -> Column:
    return F.when(package == "", simple).otherwise(F.concat(package, F.lit("/"), simple))


def candidates(steps: list[str], simple: Column, package: Column, siblings: Column, single: Column, on_demand: Column, members: Column) -> Column:
    """Ordered array of (step, name). siblings: array of simple names of the same unit; single: map simple -> name;
    on_demand: array of packages; members: ordered array of names of member types in scope."""
    one = lambda step, value: F.when(value.isNotNull(), F.array(F.struct(F.lit(step).alias("step"), value.alias("name")))).otherwise(F.array().cast("array<struct<step:string,name:string>>"))
    many = lambda step, values: F.coalesce(F.transform(values, lambda v: F.struct(F.lit(step).alias("step"), v.alias("name"))), F.array().cast("array<struct<step:string,name:string>>"))
    made = {
        "member": lambda: many("member", F.filter(members, lambda m: names.simple_name(m) == simple)),
        "sibling": lambda: one("sibling", F.when(F.array_contains(siblings, simple), _in_package(package, simple))),
        "single": lambda: one("single", F.try_element_at(single, simple)),
        "package": lambda: one("package", _in_package(package, simple)),
        "on_demand": lambda: many("on_demand", F.transform(on_demand, lambda p: F.concat(p, F.lit("/"), simple))),
        "java_lang": lambda: one("java_lang", F.concat(F.lit("java/lang/"), simple)),
    }
    return F.concat(*[made[s]() for s in steps])


def resolve(refs: DataFrame, available: DataFrame, cascade: tuple = BATCH, simple: str = "simple", package: str = "source_package", siblings: str = "siblings", single: str = "single_imports", on_demand: str = "on_demand", members: str | None = None) -> DataFrame:
    """refs with `resolved`. available: (jvm_name) of visible declarations.

    The columns of the context may be null: no hints. A null name resolves to null. Where nothing holds, the cascade's
    fallback is taken: the name in its own package, in java/lang, as it is, or null.
    """
    steps, checked, fallback = cascade
    ctx = [c for c in (simple, package, siblings, on_demand, members) if c]
    s, p = F.col(simple), F.coalesce(F.col(package), F.lit(""))
    none = F.array().cast("array<string>")
    made = candidates(steps, s, p, F.coalesce(F.col(siblings), none), F.col(single), F.coalesce(F.col(on_demand), none), F.coalesce(F.col(members), none) if members else none)
    keyed = refs.withColumn("__key", F.xxhash64(*ctx, F.to_json(single)))
    distinct = keyed.dropDuplicates(["__key", simple]).select("__key", simple, F.posexplode(made).alias("__ord", "__c"))
    known = available.select(F.col("jvm_name").alias("__known")).distinct()
    held = distinct.join(known, F.col("__c.name") == F.col("__known"), "left").where(F.col("__known").isNotNull() | ~F.col("__c.step").isin(*checked))
    best = held.groupBy("__key", F.col(simple).alias("__simple")).agg(F.min_by("__c.name", "__ord").alias("__best"))
    last = {"package": _in_package(p, s), "java_lang": F.concat(F.lit("java/lang/"), s), "self": s, None: F.lit(None).cast("string")}[fallback]
    out = keyed.join(best, (keyed["__key"] == best["__key"]) & (F.col(simple) == F.col("__simple")), "left")
    return out.withColumn("resolved", F.coalesce("__best", last)).drop(best["__key"]).drop("__key", "__simple", "__best")


def qualify(refs: DataFrame, available: DataFrame, name: str = "name", cascade: tuple = HIERARCHY, **hints) -> DataFrame:
    """Resolves the outermost segment of a nested name and appends the rest: Outer$Inner -> package/Outer$Inner."""
    cut = refs.withColumn("__outer", names.outermost(name)).withColumn("__rest", F.substr(F.col(name), F.length("__outer") + 1))
    out = resolve(cut, available, cascade, simple="__outer", **hints)
    return out.withColumn("resolved", F.concat("resolved", "__rest")).drop("__outer", "__rest")


def scopes(types: DataFrame, key: str = "jvm_name") -> DataFrame:
    """(type, scope, depth): a type and the types around it, from the inside out."""
    parts = F.split(F.col("__type"), r"\$")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, 1, F.size(parts) - d), "$"))
    rows = types.select(F.col(key).alias("__type")).distinct()
    return rows.select("__type", F.posexplode(levels).alias("depth", "scope")).withColumnRenamed("__type", "type")


def member_in_scope(refs: DataFrame, types: DataFrame, edges: DataFrame) -> DataFrame:
    """refs (type, simple) with `resolved`: the member type of that name in the type, its supertypes, or outwards.

    A walk over supertypes from each enclosing type, breadth first to the end; the nearest scope wins, then the shortest
    walk, then the smallest name. types: (jvm_name); edges: (sub, super). What a walk has reached it does not enter again.
    """
    asked = keep(refs.select("type", "simple").distinct())
    frontier = keep(scopes(asked, "type").select("type", "depth", F.col("scope").alias("at"), F.lit(0).alias("steps")))
    seen, used, steps = frontier, [asked, frontier], 0
    pairs = edges.select(F.col("sub").alias("__sub"), F.col("super").alias("__super")).distinct()
    while not frontier.isEmpty():
        steps += 1
        step = frontier.join(pairs, F.col("at") == F.col("__sub")).select("type", "depth", F.col("__super").alias("at")).distinct()
        frontier = keep(step.join(seen.select("type", "depth", "at"), ["type", "depth", "at"], "left_anti").withColumn("steps", F.lit(steps)))
        used.append(frontier)
        seen = seen.unionByName(frontier)
    known = types.select(F.col("jvm_name").alias("__member")).distinct()
    hits = seen.join(asked, "type").join(known, F.concat("at", F.lit("$"), "simple") == F.col("__member"))
    best = release(used, hits.groupBy("type", "simple").agg(F.min_by("__member", F.struct("depth", "steps", "__member")).alias("resolved")))
    return refs.join(best, ["type", "simple"], "left")
