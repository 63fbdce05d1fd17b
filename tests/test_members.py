import json

from pyspark.sql import functions as F

from sparrowdex.functions import descriptors, flags
from sparrowdex.operators import annotations, classpath, xref
from sparrowdex.sources import javasource


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_descriptors_of_columns(spark):
    erase = lambda s: one(spark, descriptors.erase(F.lit(s)))
    assert [erase(s) for s in ("I", "[J", "La/B<TT;Lc/D<*>;>;", "[TT;", "UList<I>;", "La/B<I>.In<J>;", "*", "+La/B;")] == ["I", "[J", "La/B;", "[Ljava/lang/Object;", "LList;", "La/B$In;", "Ljava/lang/Object;", "Ljava/lang/Object;"]
    params = F.array(F.struct(F.lit("TT;").alias("sig")), F.struct(F.lit("[I").alias("sig")))
    assert one(spark, descriptors.method_descriptor(params, F.lit("V"))) == "(Ljava/lang/Object;[I)V"
    bounds = F.array(F.struct(F.lit("T").alias("name"), F.array(F.lit("La/I;"), F.lit("Lb/J;")).alias("bounds")))
    assert one(spark, descriptors.class_signature(bounds, F.lit("La/B<TT;>;"), F.array(F.lit("Lc/C;")), F.array(F.lit("a/I")))) == "<T::La/I;:Lb/J;>La/B<TT;>;Lc/C;"
    assert one(spark, descriptors.class_signature(F.array().cast("array<struct<name:string,bounds:array<string>>>"), F.lit("La/B;"), F.array(F.lit("Lc/C;")))) is None
    assert one(spark, descriptors.method_signature(bounds, params, F.lit("V"), F.array(F.lit("TT;")))) == "<T:La/I;:Lb/J;>(TT;[I)V^TT;"


def test_annotation_attributes(spark):
    source = """package p; @A(names = "x", kind = ONE, sum = 1 + 2, gone = 3) class C {} @interface A { String[] names(); Kind kind(); int sum(); int other() default 7; } enum Kind { ONE }"""
    types, _, _ = javasource.parse(source)
    by = {t["jvm_name"]: t for t in types}
    notes = [(t["jvm_name"], [(f"Lp/{a['type_sig'][1:]}", a["values"]) for a in t["annotations"]]) for t in types]
    uses = spark.createDataFrame(notes, "jvm_name string, annotations array<struct<type_sig:string,values:map<string,string>>>")
    methods = spark.createDataFrame([("p/A", m["name"], m["return_sig"].replace("UKind", "Lp/Kind"), m["annotation_default"]) for m in by["p/A"]["methods"]], "owner string, name string, return_sig string, annotation_default string")
    rows = annotations.coerced(annotations.elements(uses, ["jvm_name"]), methods)
    got = {r.element: json.loads(r.value) for r in rows.collect()}
    assert got == {"names": ["x"], "kind": {"enum": "Lp/Kind;", "const": "ONE"}}
    full = annotations.with_defaults(rows, spark.createDataFrame([("p/C", "p/A")], "jvm_name string, annotation string"), ["jvm_name"], methods)
    assert {r.element for r in full.collect()} == {"names", "kind", "other"}


def test_binary_modifiers(spark):
    note = F.array(F.struct(F.lit(flags.DEPRECATED_SIG).alias("type_sig")))
    none = F.array().cast("array<struct<type_sig:string>>")
    assert one(spark, flags.binary_field_modifiers(F.lit(0), F.lit("INTERFACE"), note)) == flags.PUBLIC | flags.STATIC | flags.FINAL | flags.DEPRECATED_BIT
    assert one(spark, flags.annotation_tags(note)) == flags.TAG_DEPRECATED and one(spark, flags.annotation_tags(none)) == 0
    assert one(spark, flags.binary_method_modifiers(F.lit(0), F.lit(True), F.lit(False), F.lit("INTERFACE"), F.lit(False))) == flags.PUBLIC | flags.ABSTRACT | flags.VARARGS
    assert one(spark, flags.binary_inner_class_modifiers(F.lit(0), F.lit("ENUM"), F.array().cast("array<string>"), none, F.lit(0), F.lit("CLASS"))) & flags.STATIC


def test_find_and_list(spark):
    rows = [("b/", "1", "p/A", "p"), ("a/", "1", "p/A", "p"), ("c/", "2", "p/q/B", "p/q"), ("a/", "3", "p/q/C", "p/q")]
    t = spark.createDataFrame(rows, "source_uri string, resource_path string, jvm_name string, package_jvm string")
    assert classpath.find_type(t, "p.A", ["a/", "b/"], ["resource_path"]).first().source_uri == "a/"
    assert classpath.find_type(t, "p.q.B", ["a/", "b/"], ["resource_path"]).isEmpty()
    assert sorted(r.jvm_name for r in classpath.list_types(t, "p", None, ["source_uri"], recursive=True).collect()) == ["p/A", "p/q/B", "p/q/C"]


def test_published_problems(spark):
    problems = spark.createDataFrame([("u", 5, 6, "late", 1, "s", None), ("u", 1, 2, "early", 2, "s", "c")], "uri string, start_off int, end_off int, message string, severity int, source string, code string")
    got = {r.uri: [p.message for p in r.problems] for r in xref.published(spark.createDataFrame([("u",), ("clean",)], "uri string"), problems).collect()}
    assert got == {"u": ["early", "late"], "clean": []} and xref.synthetic_problem("u", "boom")["severity"] == 1
    spans = spark.createDataFrame([("abc", 0, 9)], "name string, start_off int, end_off int")
    assert xref.name_range(spans).first().start_off == 6
