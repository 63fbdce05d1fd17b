"""Annotation values against the methods of their annotation types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.descriptors import erase


def elements(declarations: DataFrame, keys: list[str], column: str = "annotations") -> DataFrame:
    """(keys, annotation, element, value): a row for each element; annotations without elements have none.

    values are JSON: literals, arrays, {"enum", "const"}, {"class"}, {"annotation"} or {"unsupported"}."""
    each = declarations.select(*keys, F.explode(column).alias("a"))
    return each.select(*keys, F.regexp_extract("a.type_sig", "^[LU]([^<;]*)", 1).alias("annotation"), F.explode("a.values").alias("element", "value"))


def coerced(rows: DataFrame, methods: DataFrame) -> DataFrame:
    """rows of elements() as attributes of their annotation types.

    methods: (owner, name, return_sig) of annotation types. An element that the type does not have is dropped, as is a
    value that is not supported; a single value of an array element becomes an array of one; an enum constant without a
    type has that of its element.
    """
    declared = methods.select(F.col("owner").alias("annotation"), F.col("name").alias("element"), "return_sig")
    joined = rows.where(F.get_json_object("value", "$.unsupported").isNull()).join(declared, ["annotation", "element"])
    item = F.regexp_replace("return_sig", r"^\[", "")
    bound = F.when(F.get_json_object("value", "$.const").isNotNull() & F.get_json_object("value", "$.enum").isNull(), F.to_json(F.struct(F.get_json_object("value", "$.const").alias("const"), erase(item).alias("enum")))).otherwise(F.col("value"))
    wrapped = F.when(F.startswith("return_sig", F.lit("[")) & ~F.startswith(bound, F.lit("[")), F.concat(F.lit("["), bound, F.lit("]"))).otherwise(bound)
    return joined.withColumn("value", wrapped).drop("return_sig")


def defaults(methods: DataFrame) -> DataFrame:
    """(annotation, element, value) of elements that have a default."""
    return methods.where("annotation_default is not null").select(F.col("owner").alias("annotation"), F.col("name").alias("element"), F.col("annotation_default").alias("value"))


def with_defaults(rows: DataFrame, uses: DataFrame, keys: list[str], methods: DataFrame) -> DataFrame:
    """rows and, for each use (keys, annotation), the defaults of the elements that it leaves out."""
    missing = uses.select(*keys, "annotation").distinct().join(defaults(methods), "annotation").join(rows, [*keys, "annotation", "element"], "left_anti")
    return rows.select(*keys, "annotation", "element", "value").unionByName(missing)
