"""Descriptors and generic signatures made of signature columns, without leaving generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT = "Ljava/lang/Object;"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unnested(sig: Column | str) -> Column:
    """A signature without type arguments, however deep they are nested: one pass over its brackets."""
    s = _col(sig)
    parts = F.regexp_extract_all(s, F.lit("[<>]|[^<>]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(at: Column, part: Column) -> Column:
        depth = at["depth"] + F.when(part == "<", 1).when(part == ">", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when((at["depth"] == 0) & (part != "<"), F.concat(at["out"], part)).otherwise(at["out"]).alias("out"))

    return F.when(F.contains(s, F.lit("<")), F.aggregate(parts, start, step)["out"]).otherwise(s)


def erase(sig: Column | str) -> Column:
    """The descriptor of a signature: arguments gone, variables and wildcards as Object, unresolved names as classes."""
    s = F.regexp_replace(unnested(sig), r"^(\[*)[-+].*$", f"$1{OBJECT}")
    s = F.regexp_replace(s, r"^(\[*)(?:T[^;]*;|\*)$", f"$1{OBJECT}")
    return F.translate(F.regexp_replace(s, r"^(\[*)U", "$1L"), ".", "$")


def field_descriptor(sig: Column | str) -> Column:
    return erase(sig)


def method_descriptor(params: Column | str, result: Column | str) -> Column:
    """params: array of structs with sig."""
    return F.concat(F.lit("("), F.array_join(F.transform(_col(params), lambda p: erase(p["sig"])), ""), F.lit(")"), erase(result))


def type_parameters(params: Column | str, interfaces: Column | str | None = None) -> Column:
    """<T:bound...> of an array of structs (name, bounds); a first bound that is in `interfaces` (binary names) follows
    two colons. Empty for no parameters."""
    known = F.array().cast("array<string>") if interfaces is None else _col(interfaces)
    first_is_interface = lambda p: F.array_contains(known, F.regexp_extract(F.get(p["bounds"], 0), "^[LU]([^<;]*)", 1))
    one = lambda p: F.concat(p["name"], F.when(first_is_interface(p), ":").otherwise(""), F.array_join(F.transform(p["bounds"], lambda b: F.concat(F.lit(":"), b)), ""))
    joined = F.array_join(F.transform(_col(params), one), "")
    return F.when(F.coalesce(F.size(_col(params)), F.lit(0)) > 0, F.concat(F.lit("<"), joined, F.lit(">"))).otherwise("")


def class_signature(params: Column | str, super_sig: Column | str, interface_sigs: Column | str, interfaces: Column | str | None = None) -> Column:
    """Null where the descriptor says all: no parameters, and no arguments in what the class extends."""
    parts = F.concat(type_parameters(params, interfaces), F.coalesce(_col(super_sig), F.lit(OBJECT)), F.array_join(F.coalesce(_col(interface_sigs), F.array().cast("array<string>")), ""))
    return F.when(F.contains(parts, F.lit("<")), parts)


def method_signature(type_params: Column | str, params: Column | str, result: Column | str, throws: Column | str, interfaces: Column | str | None = None) -> Column:
    """params: array of structs with sig. Thrown types stand only where one of them is a variable."""
    thrown = F.when(F.exists(_col(throws), lambda t: F.startswith(t, F.lit("T"))), F.array_join(F.transform(_col(throws), lambda t: F.concat(F.lit("^"), t)), "")).otherwise("")
    return F.concat(type_parameters(type_params, interfaces), F.lit("("), F.array_join(F.transform(_col(params), lambda p: p["sig"]), ""), F.lit(")"), _col(result), thrown)
