"""Search path, store, resolution, hierarchy, references: the behaviour that the reference's tests pin down."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparrowdex.operators import classpath, complete, hierarchy, resolve, store, synth, xref

relaxed = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TYPE = "source_uri string, resource_path string, jvm_name string, package_jvm string, modifiers int, decl_kind string"


def types(spark, *rows):
    return spark.createDataFrame([(u, p, n, n.rpartition("/")[0], 0, "CLASS") for u, p, n in rows], TYPE)


def test_multiset_and_packages(spark):
    t = types(spark, ("file:///a/", "com/example/Foo.java", "com/example/Foo"), ("file:///b/", "com/example/Foo.java", "com/example/Foo"), ("file:///a/", "com/example/util/Bar.java", "com/example/util/Bar"))
    assert tuple(store.counts(t).first()) == (2, 3)
    assert store.list_package(t, "com/example").count() == 2 and store.list_package(t, "com", recursive=True).count() == 3
    assert store.get_all(t, "com/example/Foo").count() == 2 and store.contains(t, "com/example/Foo") and not store.contains(t, "com/example/None")
    assert store.has_package(t, "com") and not store.has_package(t, "demo") and store.list_package(t, "com").isEmpty()
    assert sorted(r[0] for r in store.known_packages(t).collect()) == ["com", "com/example", "com/example/util"]
    assert store.list_package(t, None).isEmpty() and store.list_package(t, "", recursive=True).count() == 3
    assert store.is_empty(t.limit(0)) and not store.is_empty(t)


def test_prefix_search(spark):
    t = types(spark, *[("u", f"{n}.java", n) for n in ("com/example/Foo", "com/other/FooBar", "com/example/Baz", "com/example/Foo$Inner")])
    assert [r.jvm_name for r in store.search_prefix(t, "Foo", 10).collect()] == ["com/example/Foo", "com/other/FooBar"]
    many = types(spark, *[("u", f"p/Foo{i}.java", f"p/Foo{i}") for i in range(10)])
    assert store.search_prefix(many, "Foo", 3).count() == 3 and store.search_prefix(many, "Foo", 0).isEmpty() and store.search_prefix(many, "foo", 3).isEmpty()


def test_replace_and_save(spark, tmp_path):
    t = types(spark, ("file:///a/", "Foo.java", "p/Foo"), ("file:///a/", "Other.java", "p/Other"), ("file:///b/", "X.java", "p/X"))
    new = types(spark, ("file:///a/", "Foo.java", "p/FooV2"))
    out = store.put_resources(t, new, new)
    assert sorted(r.jvm_name for r in out.collect()) == ["p/FooV2", "p/Other", "p/X"]
    again = store.put_resources(out, new, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))
    assert [r.jvm_name for r in store.delete_resources(t, new).orderBy("jvm_name").collect()] == ["p/Other", "p/X"]
    path = str(tmp_path / "types")
    store.save(t, path, buckets=4)
    store.save_replacement(spark, path, new, new, str(tmp_path / "staging"), buckets=4)
    assert sorted(r.jvm_name for r in store.load(spark, path).collect()) == ["p/FooV2", "p/Other", "p/X"]
    assert store.add(t, types(spark, ("u", "module-info.class", "module-info"))).count() == 3


def test_shadowing_flips_with_the_order(spark):
    t = types(spark, ("index:///primary/", "D.java", "com/example/Dup"), ("index:///shadowed/", "D.java", "com/example/Dup"), ("index:///none/", "D.java", "com/example/Gone"))
    first = lambda *path: [(r.jvm_name, r.source_uri) for r in classpath.pick(t, "jvm_name", "source_uri", list(path), ["resource_path"]).collect()]
    assert first("index:///primary/", "index:///shadowed/") == [("com/example/Dup", "index:///primary/")]
    assert first("index:///shadowed/", "index:///primary/") == [("com/example/Dup", "index:///shadowed/")]
    assert first() == []
    assert classpath.pick(t, "jvm_name", "source_uri", None, ["source_uri"]).count() == 2
    rank = lambda uri, aware: spark.range(1).select(classpath.rank(F.lit(uri), ["file:///a", "file:///"], aware).alias("r")).first().r
    assert rank("file:///ab/X.java", False) == 0 and rank("file:///ab/X.java", True) == 1 and rank("file:///a/X.java", True) == 0 and rank("jrt:/x", True) == -1


def test_longest_root(spark):
    uris = spark.createDataFrame([("src/nested/com/Foo.java",), ("src/A.java",), ("else/B.java",)], "uri string")
    assert {r.uri: r.root for r in classpath.longest_root(uris, "uri", ["src/", "src/nested/"]).collect()} == {"src/nested/com/Foo.java": "src/nested/", "src/A.java": "src/", "else/B.java": None}


@relaxed
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["x1", "x12", "y", "z"]), st.integers(0, 3)), min_size=1, max_size=20), st.permutations(["x1", "x", "y"]))
def test_pick_is_the_loop(spark, rows, path):
    rank = lambda u: next((i for i, p in enumerate(path) if u.startswith(p)), -1)
    expected = {}
    for k, u, n in sorted(rows, key=lambda r: (rank(r[1]), r[1], r[2])):
        if rank(u) >= 0:
            expected.setdefault(k, (u, n))
    df = spark.createDataFrame(rows, "k string, u string, n int")
    assert {r.k: (r.u, r.n) for r in classpath.pick(df, "k", "u", list(path), ["u", "n"]).collect()} == expected


HIERARCHY = [
    ("demo/Animal", "CLASS", None, []), ("demo/Mammal", "CLASS", "LAnimal;", []), ("demo/Dog", "CLASS", "LMammal;", []), ("demo/Cat", "CLASS", "LMammal;", []),
    ("demo/Pet", "INTERFACE", None, []), ("demo/HouseDog", "CLASS", "LDog;", ["LPet;"]),
]


def edges(spark):
    rows = [(n, k, s and s.replace("L", "Ldemo/"), [i.replace("L", "Ldemo/") for i in x], 0) for n, k, s, x in HIERARCHY]
    return hierarchy.super_edges(spark.createDataFrame(rows, "jvm_name string, decl_kind string, super_sig string, interface_sigs array<string>, modifiers int"))


def test_one_level(spark):
    e = edges(spark).cache()
    up = lambda n: {r.super_jvm for r in hierarchy.direct_supertypes(e, f"demo/{n}").collect()}
    down = lambda n: {r.sub_jvm for r in hierarchy.direct_subtypes(e, f"demo/{n}").collect()}
    assert up("Mammal") == {"demo/Animal"} and up("Animal") == {"java/lang/Object"} and up("HouseDog") == {"demo/Dog", "demo/Pet"}
    assert down("Mammal") == {"demo/Dog", "demo/Cat"} and down("Dog") == {"demo/HouseDog"} and down("Pet") == {"demo/HouseDog"}
    permits = spark.createDataFrame([("demo/Pet", "demo/HouseDog", 0), ("demo/Pet", "demo/Fish", 1)], "super_jvm string, sub_jvm string, ord int")
    assert {(r.sub_jvm, r.permitted) for r in hierarchy.direct_subtypes(e, "demo/Pet", permits).collect()} == {("demo/HouseDog", True), ("demo/Fish", True)}


def test_implicit_supers_and_erasure(spark):
    rows = [("a/E", "ENUM", None, 0), ("a/R", "RECORD", None, 0), ("a/A", "ANNOTATION", None, 0), ("a/B", None, None, 0x4000), ("java/lang/Object", None, None, 0), ("a/G", "CLASS", "Lb/Base<La/X<TT;>;>;", 0)]
    e = hierarchy.super_edges(spark.createDataFrame([(n, k, s, None, m) for n, k, s, m in rows], "jvm_name string, decl_kind string, super_sig string, interface_sigs array<string>, modifiers int"))
    found = {(r.sub_jvm, r.super_jvm) for r in e.collect()}
    assert found == {("a/E", "java/lang/Enum"), ("a/R", "java/lang/Record"), ("a/A", "java/lang/Object"), ("a/A", "java/lang/annotation/Annotation"), ("a/B", "java/lang/Enum"), ("a/G", "b/Base")}


@relaxed
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=16))
def test_closure_is_a_breadth_first_walk(spark, pairs):
    rows = [(str(a), str(b)) for a, b in pairs]
    e = spark.createDataFrame(rows, "sub_jvm string, super_jvm string")
    got = {(r.start, r.reached): r.depth for r in hierarchy.closure(e, e.select(F.col("sub_jvm").alias("start"))).collect()}
    expected = {}
    for start in {a for a, _ in rows}:
        level, depth = {start}, 0
        while level:
            depth += 1
            level = {b for a, b in rows if a in level and (start, b) not in expected}
            expected |= {(start, b): depth for b in level}
    assert got == expected


def test_cascades(spark):
    available = spark.createDataFrame([("p/Same",), ("q/Star",), ("java/lang/String",), ("p/Sib",), ("x/Imp",), ("p/Imp",)], "jvm_name string")
    schema = "simple string, source_package string, siblings array<string>, single_imports map<string,string>, on_demand array<string>"
    refs = spark.createDataFrame([(s, "p", ["Sib"], {"Imp": "x/Imp", "Lost": "gone/Lost"}, ["q"]) for s in ("Same", "Star", "String", "Sib", "Imp", "Lost", "Nowhere")], schema)
    got = lambda c: {r.simple: r.resolved for r in resolve.resolve(refs, available, c).collect()}
    assert got(resolve.BATCH) == {"Same": "p/Same", "Star": "q/Star", "String": "java/lang/String", "Sib": "p/Sib", "Imp": "x/Imp", "Lost": "p/Lost", "Nowhere": "p/Nowhere"}
    assert got(resolve.COMPILER)["Lost"] == "gone/Lost" and got(resolve.COMPILER)["Nowhere"] == "java/lang/Nowhere"
    assert got(resolve.SUPER_BATCH)["Nowhere"] is None and got(resolve.SUPER_BATCH)["String"] is None
    nested = refs.withColumn("name", F.concat("simple", F.lit("$In$Deep")))
    assert {r.simple: r.resolved for r in resolve.qualify(nested, available).collect()}["Star"] == "q/Star$In$Deep"
    empty = spark.createDataFrame([("String", None, None, None, None), (None, None, None, None, None)], schema)
    assert {r.simple: r.resolved for r in resolve.resolve(empty, available).collect()} == {"String": "java/lang/String", None: None}


def test_member_types_in_scope(spark):
    t = spark.createDataFrame([("a/Out",), ("a/Out$In",), ("a/Base",), ("a/Base$M",), ("a/Out$K",)], "jvm_name string")
    e = spark.createDataFrame([("a/Out", "a/Base"), ("a/Base", "a/Loop"), ("a/Loop", "a/Base")], "sub string, super string")
    refs = spark.createDataFrame([("a/Out$In", "M"), ("a/Out$In", "K"), ("a/Out$In", "None")], "type string, simple string")
    assert {r.simple: r.resolved for r in resolve.member_in_scope(refs, t, e).collect()} == {"M": "a/Base$M", "K": "a/Out$K", "None": None}


def test_references_in_two_files(spark):
    texts = spark.createDataFrame([("Greeter.java", "class Greeter {\n  void greet() {}\n}"), ("Main.java", "class Main {\n\n void m(Greeter g) { g.greet(); }\n}"), ("None.java", "class None {}")], "path string, text string")
    ids = xref.identifiers(texts, ["path"])
    assert {r.path for r in xref.candidates(ids.withColumnRenamed("path", "resource_path"), "greet").withColumnRenamed("resource_path", "path").collect()} == {"Greeter.java", "Main.java"}
    places = xref.token_positions(texts, ["path"]).where("name = 'greet'")
    assert {(r.path, r.line, r.col, r.start_off) for r in places.collect()} == {("Greeter.java", 1, 7, 23), ("Main.java", 2, 23, 37)}
    assert sorted(map(tuple, xref.name_positions(texts, ["path"], "greet").collect())) == sorted(map(tuple, places.collect()))
    tricky = spark.createDataFrame([("t", "greet greeting a1greet 9greet _greet greet1\nxgreet greet.greet $greet")], "path string, text string")
    assert sorted(map(tuple, xref.name_positions(tricky, ["path"], "greet").collect())) == sorted(map(tuple, xref.token_positions(tricky, ["path"]).where("name = 'greet'").collect()))
    decl = places.where("path = 'Greeter.java'")
    keys = ["path", "line", "col"]
    assert xref.finalize(places, decl, keys, True).count() == 2 and [r.path for r in xref.finalize(places, decl, keys, False).collect()] == ["Main.java"]


def test_cap_keeps_the_pinned(spark):
    hits = spark.createDataFrame([(i,) for i in range(10)], "id int")
    pinned = spark.createDataFrame([(7,), (99,)], "id int")
    assert {r.id for r in xref.capped(hits, pinned, "id", 4).collect()} == {7, 99, 0, 1}
    assert xref.capped(hits, pinned, "id", 0).count() == 11 and xref.capped(hits, pinned, "id", 1).count() == 2


def test_positions(spark):
    r = random.Random(3)
    texts = [("".join(r.choice("ab1 .\n\ré") for _ in range(60)),) for _ in range(8)] + [("",), ("\n",), ("a",)]
    df = spark.createDataFrame(texts, "text string").withColumn("k", F.monotonically_increasing_id())
    for off in (0, 1, 17, 60):
        for row in df.select("text", xref.position_at("text", F.lit(off)).alias("p"), xref.position_at("text", F.lit(off), False).alias("q")).collect():
            head = row.text[:off]
            assert (row.p.line, row.p.col) == (head.count("\n"), len(head.rpartition("\n")[2])) and row.q.col == len(head.rpartition("\n")[2].replace("\r", ""))
    import re

    got = {(x.k, x.name, x.line, x.col, x.start_off) for x in xref.token_positions(df, ["k"]).collect()}
    want = set()
    for row in df.collect():
        for m in re.finditer(xref.IDENTIFIER, row.text):
            head = row.text[: m.start()]
            want.add((row.k, m[0], head.count("\n"), len(head.rpartition("\n")[2]), m.start()))
    assert got == want


def test_completion(spark):
    at = lambda text: tuple(spark.range(1).select(complete.prefix_at(F.lit(text), F.lit(len(text))).alias("p")).first().p)
    assert at("x = foo.ba") == ("ba", True) and at("x = ba") == ("ba", False) and at("foo.") == ("", True) and at("") == ("", False)
    rows = spark.createDataFrame([("field", "size", "size", 0), ("field", "size", "size", 2), ("method", "sum", "sum(I)", 1), ("method", "sum", "sum(J)", 1), ("field", "other", "other", 0)], "kind string, name string, dedup_key string, depth int")
    assert sorted((r.name, r.dedup_key, r.depth) for r in complete.in_scope(rows, "s").collect()) == [("size", "size", 0), ("sum", "sum(I)", 1), ("sum", "sum(J)", 1)]
    t = types(spark, ("a/", "1", "p/Foo"), ("b/", "1", "p/Foo"), ("c/", "1", "p/FooHidden"), ("a/", "2", "q/FooBar"))
    got = {(r.jvm_name, r.needs_import) for r in complete.unimported_types(t, "Foo", ["a/", "b/"], "p", [], []).collect()}
    assert got == {("p/Foo", False), ("q/FooBar", True)}
    late = complete.unimported_types(t, "Foo", ["a/"], "p", [], [], limit=2, compat=True)
    assert [r.jvm_name for r in late.collect()] == ["p/Foo"]


def test_completion_after_a_line_end(spark):
    """What stands before a line end is no prefix; any space may stand between a dot and the prefix."""
    at = lambda text: tuple(spark.range(1).select(complete.prefix_at(F.lit(text), F.lit(len(text))).alias("p")).first().p)
    for end in ("\n", "\r\n", "\r", "\x85", "\u2028"):
        assert at("x.foo" + end) == ("", False) and at("x." + end) == ("", False)
    assert at("a\nb") == ("b", False) and at("x 12ab$3") == ("ab$3", False) and at("x 12") == ("", False) and at("x.\u00a0 \u3000ab") == ("ab", True)


def test_token_after_a_line_end(spark):
    """A name does not begin before the line end that the offset follows."""
    at = lambda text, k: spark.range(1).select(xref.token_at(F.lit(text), F.lit(k)).alias("t")).first().t
    for end in ("\n", "\r\n", "\r", "\x85", "\u2028"):
        k = len("foo" + end)
        assert tuple(at(f"foo{end}bar", k)) == ("bar", k, k + 3) and at(f"foo{end}", k) is None and at(f"foo{end} ", k) is None
    assert tuple(at("x 12ab", 5)) == ("ab", 4, 6) and at("x 12ab", 3) is None and tuple(at("foo", 0)) == ("foo", 0, 3)


def test_synthesis(spark):
    comps = "array<struct<name:string,sig:string>>"
    t = spark.createDataFrame([("E", "ENUM", 1, None), ("C", "CLASS", 1, None), ("I", "INTERFACE", 1, None), ("R", "RECORD", 1, [("x", "I")]), ("F", None, 0x201, None)], f"jvm_name string, decl_kind string, modifiers int, record_components {comps}")
    none = spark.createDataFrame([("E", "method", "values", "()[LE;"), ("R", "method", "x", "()I")], "owner string, kind string, name string, descriptor string")
    got = {(r.owner, r.name, r.descriptor) for r in synth.synthesized(t, none).collect()}
    assert got == {("E", "valueOf", "(Ljava/lang/String;)LE;"), ("C", "<init>", "()V"), ("R", "<init>", "(I)V")}


def test_symbols(spark):
    key = lambda *a: spark.range(1).select(xref.symbol_key(*[F.lit(x) for x in a[:4]], F.array(*map(F.lit, a[4]))).alias("k")).first().k
    assert key("method", "o", "a/B", "f", ["int", "a/C"]) == "M:o|a/B#f(int,a/C)" and key("type", "o", "a/B", "", [""]) == "T:o|a/B" and key("local", "o", "a/B", "x", [""]) is None
    assert spark.range(1).select(xref.search_name(F.lit("method"), F.lit("a/B$In"), F.lit("<init>")).alias("n")).first().n == "In"
    spans = spark.createDataFrame([("d", "outer", 0, 10), ("d", "inner", 2, 5)], "uri string, name string, start_off int, end_off int")
    asked = spark.createDataFrame([("d", 3), ("d", 5), ("d", 10)], "uri string, offset int")
    got = {r.offset: r.name for r in xref.occurrence_at(asked, spans, "uri").collect()}
    assert got == {3: "inner", 5: "outer"}
    assert {r.offset: r.name for r in xref.occurrence_at(asked, spans, "uri", inclusive_end=True).collect()} == {3: "inner", 5: "inner", 10: "outer"}


def test_nothing_is_cut_off(spark):
    """Chains, nestings and encodings of any depth."""
    from pyspark.sql import functions as F

    from sparrowdex.functions import names
    from sparrowdex.operators import classpath, hierarchy, resolve

    chain = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(109)] + [("t109", "t0")], "sub_jvm string, super_jvm string").coalesce(1)
    got = {r.reached: r.depth for r in hierarchy.closure(chain, spark.createDataFrame([("t0",)], "start string"), at_once=6).collect()}
    assert got == {f"t{i}": i for i in range(1, 110)} | {"t0": 110}
    deep = "a/B"
    for k in range(6):
        deep = f"a/C{k}<L{deep};>" if k else "a/C0<La/B;>"
    sigs = spark.createDataFrame([(f"L{deep};", f"L{deep}.In<TT;>;", "Ux;", "[La/B<*>;")], "a string, b string, c string, d string")
    assert sigs.select(*[hierarchy.erased(c) for c in "abc"]).first() == ("a/C5", "a/C5$In", "x")
    edges = spark.createDataFrame([(f"p/T{i}", f"p/T{i + 1}") for i in range(20)], "sub string, super string").coalesce(1)
    refs = spark.createDataFrame([("p/T0", "M"), ("p/T0", "N")], "type string, simple string")
    found = {r.simple: r.resolved for r in resolve.member_in_scope(refs, spark.createDataFrame([("p/T20$M",)], "jvm_name string"), edges).collect()}
    assert found == {"M": "p/T20$M", "N": None}
    targets = spark.createDataFrame([(f"n{i}", [f"src{i}"], [f"n{i + 1}"] if i < 12 else [], [], None) for i in range(13)], "namespace string, sources array<string>, depends_on array<string>, dependency_modules array<string>, image string")
    path = classpath.build_path(targets.where("namespace = 'n0'").select("namespace"), targets, spark.createDataFrame([], "id string, jar string"), transitive=True)
    assert {r.prefix for r in path.collect()} == {f"src{i}" for i in range(13)}
    text = "a b/c"
    for _ in range(7):
        text = __import__("urllib.parse").parse.quote(text, safe="")
    assert spark.createDataFrame([(text, "100%", "x%zz%20")], "a string, b string, c string").select(names.decode_uri("a"), names.decode_uri("b"), names.decode_uri("c")).first() == ("a b/c", "100%", "x%zz%20")
    uris = [f"file:///{i:03d}/" for i in range(60)]
    rows = spark.createDataFrame([(u + "x", k % 3) for k, u in enumerate(uris)] + [(None, 1), ("other", 2)], "uri string, k int")
    assert {(r.k, r.uri) for r in classpath.pick(rows, "k", "uri", uris[::-1], ["uri"]).collect()} == {(0, uris[57] + "x"), (1, uris[58] + "x"), (2, uris[59] + "x")}


def test_filters_made_in_rows_are_the_same(spark):
    from pyspark.sql import functions as F

    from sparrowdex.functions import bloom

    names = {1: ["a", "bc", "Ünï", "𝒳y", "x" * 300], 2: [], 3: [f"n{i}" for i in range(400)], 4: ["only"]}
    rows = spark.createDataFrame([(k, v) for k, v in names.items()] + [(5, None)], "id int, names array<string>")
    a = {r.id: (r.bit_count, r.hash_count, r.bits) for r in bloom.build_in_rows(rows, ["id"]).collect()}
    b = {r.id: (r.bit_count, r.hash_count, r.bits) for r in bloom.build(rows.select("id", F.explode_outer("names").alias("name")), ["id"]).collect()}
    assert a == b

    def fnv(name):
        h, raw = 0x811C9DC5, name.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
        return h

    flat = spark.createDataFrame([(x,) for v in names.values() for x in v], "n string")
    assert all(r[1] == fnv(r[0]) for r in flat.select("n", bloom.hash_one("n")).collect())
