import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowdex.functions import bloom, flags, names, signatures
from sparrowdex.plans import reference

relaxed = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, names.package_of("n"), n="com/example/Foo$In") == "com/example"
    assert one(spark, names.package_of("n"), n="Foo") == ""
    assert one(spark, names.simple_name("n"), n="com/example/Foo$In") == "In"
    assert one(spark, names.owner_of("n"), n="a/Foo$In$Deep") == "a/Foo$In"
    assert one(spark, names.owner_of("n"), n="a/Foo") is None
    assert one(spark, names.display_name("n"), n="a/Foo$In") == "a.Foo.In"
    assert one(spark, names.ancestors("n"), n="a/b/c") == ["a", "a/b", "a/b/c"]
    assert one(spark, names.ancestors("n"), n="") == []
    assert one(spark, names.jvm_of_dotted("n"), n="java.util.Map.Entry") == "java/util/Map$Entry"
    assert one(spark, names.jvm_of_dotted("n"), n="a.b.c") == "a/b/c"
    assert one(spark, names.jvm_of_dotted("n"), n="Map") == "Map"
    assert one(spark, names.is_skipped_name("n"), n="a/package-info")
    assert one(spark, names.is_skipped_file("n"), n="a/package-info.java")
    assert not one(spark, names.is_skipped_file("n"), n="a/module-info.java")
    assert one(spark, names.is_dotted_name("n"), n="a.b$C") and not one(spark, names.is_dotted_name("n"), n="a..b")


def test_uris(spark):
    cases = [
        ("jar:file:///x/a.jar!/p/A.class", "file:///x/a.jar", "p/A.class"), ("file:///s/p/A.java", "file:///s/", "p/A.java"), ("file:///s/p/A.java", "file:///s", "p/A.java"),
        ("jrt://home!/modules/m/A.class", "jrt://home", "modules/m/A.class"), ("index:///primary/p/A.java", "index:///primary/", "p/A.java"), ("file:///other/A.java", "file:///s/", "file:///other/A.java"),
    ]
    for resource, source, stored in cases:
        assert one(spark, names.compact_uri("r", "s"), r=resource, s=source) == stored
        assert one(spark, names.resolve_uri("s", "r"), r=stored, s=source) == resource
    assert one(spark, names.compact_uri("r", "s"), r="p/A.java", s="file:///s/") == "p/A.java"
    assert one(spark, names.decode_uri("u"), u="a%252Fb%20c+d") == "a/b c d"
    assert one(spark, names.decode_uri("u"), u="100%") == "100%"
    assert one(spark, names.default_path("n", "o"), n="a/Foo$In", o="source") == "a/Foo.java"
    assert one(spark, names.default_path("n", "o"), n="a/Foo$In", o="classfile") == "a/Foo$In.class"
    assert one(spark, names.stored_path("p", "n", "o"), p="a/Foo.java", n="a/Foo", o="source") is None
    assert one(spark, names.effective_path("p", "n", "o"), p="b/X.java", n="a/Foo", o="source") == "b/X.java"
    assert one(spark, names.attached_source("r", "a"), r="jar:file:///x/a.jar!/p/A$In.class", a="file:///x/a-sources.jar") == "jar:file:///x/a-sources.jar!/p/A.java"


@relaxed
@given(source=st.sampled_from(["file:///s/", "file:///s", "file:///x/a.jar", "jrt://home", "index:///p/", "index:///p"]), path=st.from_regex(r"[a-z]{1,5}(/[A-Z][a-z]{0,4}){1,2}\.java", fullmatch=True))
def test_uri_round_trip(spark, source, path):
    full = one(spark, names.join_uri("s", "p"), s=source, p=path)
    stored = one(spark, names.compact_uri("r", "s"), r=full, s=source)
    assert one(spark, names.resolve_uri("s", "p"), s=source, p=stored) == full


def test_messages(spark):
    assert one(spark, names.normal_message("m"), m="cannot find\n  symbol:  x \n location: class A\n\n") == "cannot find | symbol: x"
    assert [one(spark, names.format_bytes("n"), n=n) for n in (512, 1536, 3 * 1024**2, 5 * 1024**3)] == ["512 B", "1.50 KiB", "3.00 MiB", "5.00 GiB"]


def test_flags(spark):
    f = flags
    assert one(spark, f.class_flags("m", "k"), m=1, k="ENUM") == 1 | f.ENUM | f.FINAL
    assert one(spark, f.class_flags("m", F.lit(None).cast("string")), m=0x21 | f.MODULE) == 1 | f.MODULE_FLAG
    assert one(spark, f.inner_class_flags("m", "k", F.lit(0), F.lit("INTERFACE")), m=0, k="CLASS") == f.PUBLIC | f.STATIC
    assert one(spark, f.inner_class_flags("m", "k", F.lit(0), F.lit("CLASS")), m=0, k="RECORD") & f.STATIC
    assert one(spark, f.method_flags(F.lit(0), F.lit(False), F.lit(False), F.lit("INTERFACE"), F.lit(0))) == f.PUBLIC | f.ABSTRACT
    assert one(spark, f.method_flags(F.lit(0), F.lit(True), F.lit(True), F.lit("INTERFACE"), F.lit(0))) == f.PUBLIC | f.DEFAULT_FLAG | f.VARARGS_FLAG
    note = F.array(F.struct(F.lit(f.DEPRECATED_SIG).alias("type_sig"), F.create_map(F.lit("forRemoval"), F.lit("true")).alias("values")))
    assert one(spark, f.with_deprecation(F.lit(0).cast("long"), note)) == f.DEPRECATED_FLAG | f.DEPRECATED_ANNOTATION | f.DEPRECATED_REMOVAL
    sealed = one(spark, f.binary_class_modifiers(F.lit(f.RECORD), F.lit(None).cast("string"), F.array(F.lit("A")), note))
    assert sealed & f.EXTRA_SEALED and sealed & f.EXTRA_RECORD and not sealed & f.RECORD and sealed & f.SUPER
    members = F.array(*[F.struct(F.lit(m).alias("modifiers"), F.lit(n).alias("name")) for m, n in ((2, "hid"), (2, "<init>"), (1, "f"))])
    assert [r["name"] for r in one(spark, f.visible_members(members))] == ["<init>", "f"]


def model_hashes(s: str) -> tuple[int, int]:
    h = 0x811C9DC5
    for c in s:
        h = (h ^ ord(c)) * 0x01000193 & 0xFFFFFFFF
    g = ((len(s) * 31 + ord(s[0])) * 31 + ord(s[-1])) & 0xFFFFFFFF
    g ^= g >> 16
    g = g * 0x85EBCA6B & 0xFFFFFFFF
    g ^= g >> 13
    g = g * 0xC2B2AE35 & 0xFFFFFFFF
    return h, (g ^ g >> 16) | 1


def test_bloom_hashes(spark):
    words = ["foo", "bar", "Baz", "longIdentifierName", "x", "_a1$", "zz" * 40]
    rows = spark.createDataFrame([(w,) for w in words], "name string").select("name", bloom.hash_one("name").alias("a"), bloom.hash_two("name").alias("b")).collect()
    assert {r["name"]: (r["a"], r["b"]) for r in rows} == {w: model_hashes(w) for w in words}


def test_bloom_filters(spark):
    rows = [("a", n) for n in "foo bar Baz longIdentifierName".split()] + [("b", n) for n in "alpha beta gamma delta epsilon zeta eta theta".split()] + [("c", None)]
    built = bloom.build(spark.createDataFrame(rows, "file string, name string"), ["file"])
    hit = lambda file, names_: [built.where(F.col("file") == file).select(bloom.might_contain(F.lit(n)).alias("h")).first()["h"] for n in names_]
    assert all(hit("a", "foo bar Baz longIdentifierName".split()))
    assert sum(hit("b", "absent1 absent2 absent3 notInSet missing zzz qqq".split())) <= 2
    assert hit("c", ["foo"]) == [False] and hit("a", [""]) == [False]
    sizes = {r["file"]: (r["bit_count"], r["hash_count"], len(r["bits"])) for r in built.collect()}
    assert sizes == {"a": (64, 8, 1), "b": (77, 7, 2), "c": (64, 1, 1)}
    assert math.ceil(-8 * math.log(0.01) / math.log(2) ** 2) == 77


@relaxed
@given(st.sets(st.from_regex(r"[A-Za-z_$][A-Za-z0-9_$]{0,12}", fullmatch=True), min_size=1, max_size=30))
def test_bloom_has_no_false_negatives(spark, words):
    built = bloom.build(spark.createDataFrame([(1, w) for w in words], "file int, name string"), ["file"])
    probes = spark.createDataFrame([(1, w) for w in words], "file int, name string")
    assert probes.join(built, "file").where(~bloom.might_contain("name")).isEmpty()


def test_signatures():
    s = signatures
    assert s.parse_field("[[Ljava/lang/String;") == "[[Ljava/lang/String;" and s.parse_field("nonsense") == s.OBJECT
    assert s.parse_method("(I[JLa/B;)V") == (["I", "[J", "La/B;"], "V") and s.parse_method("oops") == ([], "V")
    params, sup, interfaces = s.class_signature("<T:Ljava/lang/Object;U::La/I<TT;>;>La/B<TT;>.In<TU;>;La/C;")
    assert params == [{"name": "T", "bounds": ["Ljava/lang/Object;"]}, {"name": "U", "bounds": ["La/I<TT;>;"]}]
    assert (sup, interfaces) == ("La/B<TT;>.In<TU;>;", ["La/C;"])
    assert s.method_signature("<X:La/E;>(TX;[[TT;)V^TX;") == ([{"name": "X", "bounds": ["La/E;"]}], ["TX;", "[[TT;"], "V", ["TX;"])
    assert s.erase("La/B<TT;>.In<TU;>;") == "La/B$In;" and s.erase("[TT;", {"T": "La/E<TT;>;"}) == "[La/E;" and s.erased_name("[I") is None
    assert s.method_descriptor(["TT;", "I"], "V", {"T": "La/E;"}) == "(La/E;I)V"


def test_formatted_bytes_leaves_out_no_row(spark, tmp_path):
    rows = [(1, 512), (2, 1536), (3, 3 * 1024**2), (4, 5 * 1024**3), (5, None)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.size for r in reference.formatted_bytes(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4)} == {1: "512 B", 2: "1.50 KiB", 3: "3.00 MiB", 4: "5.00 GiB"} and 5 in got
