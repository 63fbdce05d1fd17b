"""Members that a declaration has without naming them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flags import ABSTRACT, ENUM, INTERFACE, PRIVATE, PROTECTED, PUBLIC, STATIC, has
from .hierarchy import implicit_super

MEMBER = ["owner", "kind", "name", "descriptor", "modifiers"]


def _rows(types: DataFrame, name, descriptor, modifiers) -> DataFrame:
    return types.select(F.col("jvm_name").alias("owner"), F.lit("method").alias("kind"), F.lit(name).alias("name"), descriptor.alias("descriptor"), modifiers.cast("long").alias("modifiers"))


def enum_members(types: DataFrame, members: DataFrame) -> DataFrame:
    """values() and valueOf(String) of source enums that have no method of the name."""
    enums = types.where(F.col("decl_kind") == "ENUM")
    self_sig = F.concat(F.lit("L"), F.col("jvm_name"), F.lit(";"))
    made = _rows(enums, "values", F.concat(F.lit("()["), self_sig), F.lit(PUBLIC | STATIC)).union(_rows(enums, "valueOf", F.concat(F.lit("(Ljava/lang/String;)"), self_sig), F.lit(PUBLIC | STATIC)))
    return made.join(members.where("kind = 'method'").select("owner", "name"), ["owner", "name"], "left_anti").select(*MEMBER)


def default_constructors(types: DataFrame, members: DataFrame) -> DataFrame:
    """A constructor without parameters of classes that have none, with the access of the class."""
    plain = types.where(F.coalesce(~F.col("decl_kind").isin("INTERFACE", "ANNOTATION", "ENUM", "RECORD"), F.lit(True)) & ~has("modifiers", INTERFACE) & ~has("modifiers", ENUM))
    made = _rows(plain, "<init>", F.lit("()V"), F.col("modifiers").cast("long").bitwiseAND(F.lit(PUBLIC | PROTECTED | PRIVATE).cast("long")))
    return made.join(members.where("name = '<init>'").select("owner"), "owner", "left_anti").select(*MEMBER)


def record_members(types: DataFrame, members: DataFrame) -> DataFrame:
    """The canonical constructor and an accessor of each component, unless one of that name and descriptor is there.

    types: jvm_name, decl_kind, modifiers, record_components (array of name, sig)."""
    records = types.where((F.col("decl_kind") == "RECORD") & (F.size("record_components") > 0))
    access = F.col("modifiers").cast("long").bitwiseAND(F.lit(PUBLIC | PROTECTED | PRIVATE).cast("long"))
    canonical = _rows(records, "<init>", F.concat(F.lit("("), F.array_join(F.transform("record_components", lambda c: c["sig"]), ""), F.lit(")V")), access)
    one = records.select("jvm_name", F.explode("record_components").alias("c"))
    accessors = one.select(F.col("jvm_name").alias("owner"), F.lit("method").alias("kind"), F.col("c.name").alias("name"), F.concat(F.lit("()"), F.col("c.sig")).alias("descriptor"), F.lit(PUBLIC).cast("long").alias("modifiers"))
    return canonical.union(accessors).join(members.select("owner", "name", "descriptor"), ["owner", "name", "descriptor"], "left_anti").select(*MEMBER)


def synthesized(types: DataFrame, members: DataFrame) -> DataFrame:
    return enum_members(types, members).unionByName(default_constructors(types, members)).unionByName(record_members(types, members))


def with_supers(types: DataFrame) -> DataFrame:
    """Types with the superclass that a declaration implies where it names none."""
    return types.withColumn("super_sig", F.coalesce("super_sig", F.concat(F.lit("L"), implicit_super("decl_kind", "modifiers"), F.lit(";"))))


def or_missing(refs: DataFrame, types: DataFrame, name: str) -> DataFrame:
    """References with their types; `is_missing` where there is none."""
    found = types.withColumn("__there", F.lit(True))
    return refs.join(found, refs[name] == found["jvm_name"], "left").withColumn("is_missing", F.col("__there").isNull()).drop("__there")


def parameters(methods: DataFrame) -> DataFrame:
    """(owner, name, index, parameter, sig): parameters by position, arg<i> where the name is unknown."""
    out = methods.select("owner", "name", F.posexplode("params").alias("index", "p"))
    return out.select("owner", "name", "index", F.coalesce("p.name", F.concat(F.lit("arg"), F.col("index").cast("string"))).alias("parameter"), F.col("p.sig").alias("sig"))


def annotation_targets(types: DataFrame) -> DataFrame:
    """(jvm_name, targets, repeatable): metadata that annotation types carry themselves, as JSON values."""
    value = lambda sig: F.get(F.filter("annotations", lambda a: a["type_sig"] == sig), 0)["values"]["value"]
    return types.where("decl_kind = 'ANNOTATION'").select("jvm_name", value("Ljava/lang/annotation/Target;").alias("targets"), value("Ljava/lang/annotation/Repeatable;").alias("repeatable"))


def nested_types(types: DataFrame, winners: DataFrame) -> DataFrame:
    """(owner, index, nested, is_missing, is_inner): nested types in order with their declarations; is_inner: has an
    enclosing instance."""
    out = types.select(F.col("jvm_name").alias("owner"), F.posexplode_outer("inner_types").alias("index", "nested")).where("nested is not null")
    w = winners.select(F.col("jvm_name").alias("nested"), F.col("modifiers").alias("__m"))
    return out.join(w, "nested", "left").select("owner", "index", "nested", F.col("__m").isNull().alias("is_missing"), (~has(F.coalesce("__m", F.lit(0)), STATIC)).alias("is_inner"))


def type_parameter_bounds(types: DataFrame, winners: DataFrame) -> DataFrame:
    """(owner, index, parameter, all_interfaces): whether all bounds of a type parameter are interfaces."""
    out = types.select(F.col("jvm_name").alias("owner"), F.posexplode("type_params").alias("index", "t")).select("owner", "index", F.col("t.name").alias("parameter"), F.explode_outer("t.bounds").alias("bound"))
    w = winners.select(F.col("jvm_name").alias("__b"), has("modifiers", INTERFACE).alias("__i"))
    joined = out.join(w, F.regexp_extract("bound", "^[LU]([^<;]*)", 1) == F.col("__b"), "left")
    return joined.groupBy("owner", "index", "parameter").agg(F.bool_and(F.coalesce("__i", F.lit(False))).alias("all_interfaces"))


def is_abstract(modifiers) -> F.Column:
    return has(modifiers, ABSTRACT)
