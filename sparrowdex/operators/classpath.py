"""Ranked resolution along an ordered search path.

A path is a small table (rank, prefix): `MAX_RULES` rows at most. A URI has the rank of the first prefix that it starts
with. The rules are one literal expression, so no join on a prefix is planned. A path of up to `DIRECT_RULES` is tried on
each row, up to the first hit; with a longer one, ranks are found for distinct URIs, which rows meet by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import keep, release

#: A longer path is refused: it would no longer be an expression that every row can be tested by.
MAX_RULES = 10_000
DIRECT_RULES = 32


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def claims(prefix: str, uri: Column | str, separator_aware: bool = False) -> Column:
    """Whether a URI begins with a prefix. By default `src/a` also claims `src/ab`; separator_aware: it does not."""
    u = _col(uri)
    if not separator_aware or prefix.endswith("/"):
        return F.startswith(u, F.lit(prefix))
    return (u == prefix) | F.startswith(u, F.lit(prefix + "/")) | F.startswith(u, F.lit(prefix + "!/"))


def rank(uri: Column | str, path: list[str] | None, separator_aware: bool = False) -> Column:
    """Number of the first prefix that claims the URI, -1 for none or a null URI. No path: 0."""
    u = _col(uri)
    if path is None:
        return F.when(u.isNotNull(), 0).otherwise(-1)
    if len(path) > MAX_RULES:
        raise ValueError(f"a search path has {MAX_RULES} entries at most")
    if not path:
        return F.lit(-1)
    if len(path) <= DIRECT_RULES:
        out = F
        for k, p in enumerate(path):
            out = out.when(claims(p, u, separator_aware), k)
        return F.coalesce(out.otherwise(-1), F.lit(-1))
    # one pass over an array of literals, whatever its length
    rules = F.array(*[F.lit(p) for p in path])
    if separator_aware:
        hits = F.array(*[F.coalesce(claims(p, u, True), F.lit(False)) for p in path])
    else:
        hits = F.transform(rules, lambda p: F.coalesce(F.startswith(u, p), F.lit(False)))
    return (F.array_position(hits, F.lit(True)) - 1).cast("int")


def ranked(rows: DataFrame, uri: str, path: list[str] | None) -> DataFrame:
    """rows with `__rank`, that of their URI."""
    if path is None or len(path) <= DIRECT_RULES:
        return rows.withColumn("__rank", rank(uri, path))
    of_uri = rows.select(F.col(uri).alias("__uri")).distinct().withColumn("__rank", rank("__uri", path))
    return rows.join(of_uri, F.col(uri).eqNullSafe(F.col("__uri"))).drop("__uri")


def visible(rows: DataFrame, uri: str, path: list[str] | None) -> DataFrame:
    """Rows whose URI some entry claims."""
    return ranked(rows, uri, path).where("__rank >= 0").drop("__rank")


def pick(rows: DataFrame, key: str | list[str], uri: str, path: list[str] | None, ties: list[str]) -> DataFrame:
    """The row with the lowest rank for each key, the first in the order of `ties`; keys without a visible row have none.

    A window on the key with a row number: Spark keeps one row per key and task before the shuffle, so a hot key does
    not gather in one task.
    """
    keys = [key] if isinstance(key, str) else key
    order = Window.partitionBy(*keys).orderBy("__rank", *ties)
    claimed = ranked(rows, uri, path).where("__rank >= 0")
    return claimed.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__rank")


def winners(names: DataFrame, rows: DataFrame, key: str, uri: str, path: list[str] | None, ties: list[str]) -> DataFrame:
    """The pick among all rows of each of the given names."""
    return pick(rows.join(names.select(key).distinct(), key, "left_semi"), key, uri, path, ties)


def owning_namespace(uris: DataFrame, uri: str, rules: DataFrame) -> DataFrame:
    """(uri, namespace): that of the lowest rank whose prefix claims the URI, then the smallest; null for none.

    rules: (namespace, rank, prefix). The join on a prefix runs over distinct URIs with the rules broadcast, which are
    counted first; more than MAX_RULES are refused.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"search paths have {MAX_RULES} entries at most")
    distinct = uris.select(F.col(uri).alias("__uri")).distinct()
    hits = distinct.join(F.broadcast(rules.select("namespace", "rank", "prefix")), F.startswith(F.col("__uri"), F.col("prefix")), "left")
    return hits.groupBy("__uri").agg(F.min_by("namespace", F.struct("rank", "namespace")).alias("namespace")).withColumnRenamed("__uri", uri)


def longest_root(uris: DataFrame, uri: str, roots: list[str]) -> DataFrame:
    """(uri, root): the longest of the roots that claims the URI; null for none."""
    if len(roots) > MAX_RULES:
        raise ValueError(f"there can be {MAX_RULES} roots at most")
    longest = sorted(set(roots), key=lambda r: (-len(r), r))
    at = rank(F.col(uri), longest)
    return uris.select(uri).distinct().withColumn("root", F.when(at >= 0, F.element_at(F.array(*map(F.lit, longest)), at + 1)) if longest else F.lit(None).cast("string"))


def find_type(types: DataFrame, name: str, path: list[str] | None, ties: list[str]) -> DataFrame:
    """The declaration that a class name means on a search path: one row or none. Dots may stand for slashes."""
    jvm = name.replace(".", "/")
    return pick(types.where(F.col("jvm_name") == jvm), "jvm_name", "source_uri", path, ties)


def list_types(types: DataFrame, package: str, path: list[str] | None, ties: list[str], recursive: bool = False) -> DataFrame:
    """The declarations of a package that its names mean on a search path."""
    inside = F.col("package_jvm") == package
    if recursive:
        inside = inside | F.startswith("package_jvm", F.lit(package + "/")) if package else F.lit(True)
    return pick(types.where(inside), "jvm_name", "source_uri", path, ties)


def build_path(namespace: DataFrame, targets: DataFrame, modules: DataFrame, transitive: bool = False) -> DataFrame:
    """(namespace, rank, prefix) in the order: own sources, sources of direct dependencies, dependency jars, the image.

    targets: (namespace, sources, depends_on, dependency_modules, image), arrays in their order; modules: (id, jar).
    """
    own = namespace.join(targets, "namespace")
    first = own.select("namespace", F.lit(0).alias("bucket"), F.lit(0).alias("outer"), F.posexplode("sources").alias("inner", "prefix"))
    deps = own.select("namespace", F.posexplode("depends_on").alias("outer", "dependency"))
    if transitive:
        deps, used, known = keep(deps), [], 0
        used.append(deps)
        while (n := deps.count()) > known:
            known = n
            deeper = deps.alias("d").join(targets.alias("t"), F.col("d.dependency") == F.col("t.namespace")).select(F.col("d.namespace"), F.col("d.outer"), F.explode("t.depends_on").alias("dependency"))
            deps = keep(deps.unionByName(deeper).groupBy("namespace", "dependency").agg(F.min("outer").alias("outer")))
            used.append(deps)
        deps = release(used, deps)
    second = deps.join(targets.select(F.col("namespace").alias("dependency"), F.col("sources").alias("theirs")), "dependency").select("namespace", F.lit(1).alias("bucket"), "outer", F.posexplode("theirs").alias("inner", "prefix"))
    third = own.select("namespace", F.posexplode("dependency_modules").alias("outer", "id")).join(modules, "id").select("namespace", F.lit(2).alias("bucket"), "outer", F.lit(0).alias("inner"), F.col("jar").alias("prefix"))
    last = own.where("image is not null").select("namespace", F.lit(3).alias("bucket"), F.lit(0).alias("outer"), F.lit(0).alias("inner"), F.col("image").alias("prefix"))
    rows = first.unionByName(second).unionByName(third).unionByName(last).where("prefix is not null")
    rows = rows.groupBy("namespace", "prefix").agg(F.min(F.struct("bucket", "outer", "inner")).alias("at"))
    return rows.select("namespace", (F.row_number().over(Window.partitionBy("namespace").orderBy("at", "prefix")) - 1).alias("rank"), "prefix")


def module_owns(package: Column | str, packages: Column | str, exports: Column | str, opens: Column | str) -> Column:
    """Whether a module contains, exports or opens a package; null arrays are empty."""
    none = F.array().cast("array<string>")
    union = F.array_union(F.coalesce(_col(packages), none), F.array_union(F.coalesce(_col(exports), none), F.coalesce(_col(opens), none)))
    return F.array_contains(union, _col(package))


def pick_module(modules: DataFrame, name: str, uri: str, path: list[str] | None, ties: list[str]) -> DataFrame:
    """The pick of each module name; rows without a URI pass last, and where nothing is visible the first row wins."""
    order = F.when(F.col(uri).isNull(), F.lit(MAX_RULES)).otherwise(F.when(F.col("__rank") >= 0, F.col("__rank")).otherwise(MAX_RULES + 1))
    rows = ranked(modules, uri, path).withColumn("__rank", order)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(name).orderBy("__rank", *ties))).where("__n = 1").drop("__n", "__rank")


def visible_modules(modules: DataFrame, name: str, uri: str, path: list[str] | None) -> DataFrame:
    return ranked(modules, uri, path).where(F.col(uri).isNull() | (F.col("__rank") >= 0)).select(name).distinct()


def with_fallback(first: DataFrame, second: DataFrame, group: list[str]) -> DataFrame:
    """first, and the rows of second whose group first has no row of."""
    return first.unionByName(second.join(first.select(*group).distinct(), group, "left_anti"), allowMissingColumns=True)
