import glob
import json
import os
import zipfile

import pyspark
import pytest
from pyspark.sql import functions as F

from sparrowdex.operators import classpath, hierarchy
from sparrowdex.sources import classfile, files, image, javasource, manifest

SOURCE = '''
package demo.x; // not a { brace
import java.util.*; import java.util.Map.Entry; import static a.B.c;
/** doc { */
@Deprecated(forRemoval=true) public sealed abstract class Foo<T extends Comparable<T> & java.io.Serializable, U> extends Base<T>.Inner<U> implements List<? super T[]>, Entry permits A, B {
  public static final int X = -1_000, Y[] = {1,2}, Z = 'a'; private int hid; static final String S = "a\\"b{"; long L = 3;
  static { if (true) { } }
  Foo(int a, final String... b) throws java.io.IOException, T { super(); }
  public <K> Map<K, ? extends List<K>> get(@Ann({1,2}) K[] k, int[]... v)[] { return null; }
  private void gone() { class Local {} }
  @interface Ann { int[] value() default {1}; String n() default "x"; }
  enum E implements Runnable { A(1){ void f(){} }, @Deprecated B; E(int... x){} public void run(){} }
  record P(int x, @Ann(3) List<String> y) { P { } static int z; }
  private static class Hidden { class In {} }
  interface I { default int d() { return 1; } int e(); }
}
class Second { String t = """
   text " block { """; }
'''


def test_source_declarations():
    types, _, names = javasource.parse(SOURCE)
    by = {t["jvm_name"]: t for t in types}
    assert list(by) == ["demo/x/Foo", "demo/x/Foo$Ann", "demo/x/Foo$E", "demo/x/Foo$P", "demo/x/Foo$I", "demo/x/Second"]
    foo = by["demo/x/Foo"]
    assert foo["super_sig"] == "LBase$Inner<TU;>;" and foo["interface_sigs"] == ["UList<-[TT;>;", "UEntry;"] and foo["permitted"] == ["A", "B"]
    assert foo["type_params"][0] == {"name": "T", "bounds": ["UComparable<TT;>;", "Ljava/io/Serializable;"]} and foo["type_params"][1]["bounds"] == ["Ljava/lang/Object;"]
    assert [(f["name"], f["sig"], f["const"] and (f["const"]["i"], f["const"]["s"])) for f in foo["fields"]] == [("X", "I", (-1000, None)), ("Y", "[I", None), ("Z", "I", (97, None)), ("S", "UString;", (None, 'a"b{')), ("L", "J", None)]
    init, get = foo["methods"]
    assert (init["name"], init["throws"], init["varargs"]) == ("<init>", ["Ljava/io/IOException;", "TT;"], True)
    assert (get["return_sig"], [p["sig"] for p in get["params"]]) == ("[UMap<TK;+UList<TK;>;>;", ["[TK;", "[[I"])
    assert foo["annotations"] == [{"type_sig": "UDeprecated;", "values": {"forRemoval": "true"}}] and foo["inner_types"] == ["demo/x/Foo$Ann", "demo/x/Foo$E", "demo/x/Foo$P", "demo/x/Foo$I"]
    assert [m["annotation_default"] for m in by["demo/x/Foo$Ann"]["methods"]] == ["[1]", '"x"']
    assert [f["name"] for f in by["demo/x/Foo$E"]["fields"]] == ["A", "B"] and by["demo/x/Foo$E"]["fields"][0]["modifiers"] == 0x4019
    assert [c["sig"] for c in by["demo/x/Foo$P"]["record_components"]] == ["I", "UList<UString;>;"]
    assert [(m["name"], m["has_body"]) for m in by["demo/x/Foo$I"]["methods"]] == [("d", True), ("e", False)]
    assert foo["hints"] == {"source_package": "demo/x", "single_imports": {"Entry": "java/util/Map$Entry"}, "on_demand": ["java/util"], "siblings": ["Foo", "Second"]}
    assert "gone" in names and "doc" not in names and "text" not in names


@pytest.mark.parametrize("text", ["", "package a;", "class", "class A {", "}}}}", "class A { int", "@", "interface I<T", "/* open", 'class A { String s = "'])
def test_broken_sources_end(text):
    try:
        javasource.parse(text)
    except ValueError:
        pass


@pytest.mark.parametrize("text,value", [("0x7f", 127), ("0b101", 5), ("017", 15), ("0xffffffff", -1), ("10L", 10), ("1_000", 1000), ("0", 0)])
def test_integer_literals(text, value):
    assert javasource.number(text, 1)[1] == value


def jar(name):
    return next(iter(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", name))), None) or pytest.skip("no such jar")


def test_class_files_of_a_jar():
    z = zipfile.ZipFile(jar("jackson-annotations-*.jar"))
    parsed = {n: classfile.parse(z.read(n)) for n in z.namelist() if n.endswith(".class")}
    types = {t["jvm_name"]: t for rows, _, _ in parsed.values() for t in rows}
    include = types["com/fasterxml/jackson/annotation/JsonInclude"]
    assert include["modifiers"] & 0x2000 and "com/fasterxml/jackson/annotation/JsonInclude$Include" in include["inner_types"]
    value = next(m for m in include["methods"] if m["name"] == "value")
    assert json.loads(value["annotation_default"]) == {"const": "ALWAYS", "enum": "Lcom/fasterxml/jackson/annotation/JsonInclude$Include;"}
    enum = types["com/fasterxml/jackson/annotation/JsonInclude$Include"]
    assert enum["super_sig"].startswith("Ljava/lang/Enum<") and enum["modifiers"] & 0x4008 == 0x4008
    _, modules, _ = next(p for n, p in parsed.items() if n.endswith("module-info.class"))
    assert modules[0]["name"] == "com.fasterxml.jackson.annotation" and "com/fasterxml/jackson/annotation" in [e["package"] for e in modules[0]["exports"]]


def test_scan_of_archives_and_directories(spark, tmp_path):
    src = tmp_path / "src" / "demo"
    src.mkdir(parents=True)
    for name, decl in {"Animal": "class Animal", "Dog": "class Dog extends Animal", "Bad": "class Bad {"}.items():
        (src / f"{name}.java").write_text(f"package demo;\n{decl} {'{}' if name != 'Bad' else ''}")
    (src / "package-info.java").write_text("package demo;")
    (tmp_path / "broken.jar").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "ok.jar", "w") as z:
        z.write(src / "Dog.java", "demo/Dog.java")
        z.writestr("demo/Broken.class", b"\xca\xfe\xba\xbe")
    parsed = files.scan(spark, [str(tmp_path / "src")], [str(tmp_path)]).cache()
    t = files.type_entries(parsed)
    assert sorted(r.jvm_name for r in t.collect()) == ["demo/Animal", "demo/Bad", "demo/Dog", "demo/Dog"]
    assert {r.resource_uri for r in t.where("jvm_name = 'demo/Dog'").collect()} == {f"file://{tmp_path}/src/demo/Dog.java", f"jar:file://{tmp_path}/ok.jar!/demo/Dog.java"}
    assert sorted((r.resource_path or "") for r in files.failures(parsed).collect()) == ["", "demo/Broken.class"]
    picked = classpath.pick(t, "jvm_name", "source_uri", [f"file://{tmp_path}/src/"], ["resource_path"])
    assert {(r.sub_jvm, r.super_jvm) for r in hierarchy.super_edges(picked).where("sub_jvm = 'demo/Dog'").collect()} == {("demo/Dog", "Animal")}
    assert {r.resource_path for r in files.resource_identifiers(parsed).where("name = 'Animal'").collect()} == {"demo/Animal.java", "demo/Dog.java"}
    assert files.scan(spark).isEmpty() and files.module_entries(parsed).isEmpty()


def test_manifest(spark, tmp_path):
    (tmp_path / ".metals").mkdir()
    path = tmp_path / ".metals" / "mbt.json"
    path.write_text(json.dumps({"namespaces": {"app": {"sources": ["app/src"], "classes": ["app/out"], "dependsOn": ["lib"], "dependencyModules": ["g:a:1"], "javaHome": "/jdk", "unknown": 1}, "lib": {"sources": ["lib/src", "app/src"]}}, "dependencyModules": [{"id": "g:a:1", "jar": "a.jar", "sources": "a-s.jar"}, {"id": "g:a:2", "jar": "a.jar", "sources": "b-s.jar"}]}))
    assert manifest.find([str(tmp_path / "none"), str(tmp_path)]) == str(path)
    m = manifest.read(spark, str(path))
    assert [(r.kind, r.path) for r in manifest.input_sources(m).orderBy("rank").collect()] == [("dir", "app/src"), ("dir", "app/out"), ("image", "jrt:///jdk"), ("dir", "lib/src"), ("jar", "a.jar")]
    assert [tuple(r) for r in manifest.source_jars(m).collect()] == [("a.jar", "a-s.jar")]
    t = manifest.targets(m)
    built = classpath.build_path(t.where("namespace = 'app'").select("namespace"), t, manifest.modules(m).select("id", "jar"))
    assert [r.prefix for r in built.orderBy("rank").collect()] == ["app/src", "lib/src", "a.jar", "jrt:///jdk"]
    assert {tuple(r) for r in manifest.server_sources(m).collect()} == {("dir", "app/src"), ("dir", "lib/src"), ("image", "jrt:///jdk"), ("jar", "a.jar")}
    (tmp_path / "empty.json").write_text("{}")
    empty = manifest.read(spark, str(tmp_path / "empty.json"))
    assert manifest.input_sources(empty).isEmpty() and manifest.source_jars(empty).isEmpty()
    assert manifest.options({"candidate_cap": "12", "source": 3, "x": 1}) == {"candidate_cap": 12, "source": "java", "bytecode": "full"}


def test_source_uri(spark):
    got = lambda p: spark.range(1).select(files.source_uri(F.lit(p)).alias("u")).first().u
    assert got("file:/a/b.jar") == got("/a/b.jar") == got("file:///a/b.jar") == "file:///a/b.jar" and got("hdfs://x/y") == "hdfs://x/y"


def test_java_image(spark):
    import shutil

    java = shutil.which("java")
    home = os.path.dirname(os.path.dirname(os.path.realpath(java))) if java else ""
    if not os.path.exists(f"{home}/lib/modules"):
        pytest.skip("no Java image here")
    one = image.read_image(spark, home).where(F.col("resource_path").rlike("^modules/java.base/(java/util/ArrayList|module-info).class$"))
    parsed = files.parse(one).cache()
    row = files.type_entries(parsed).first()
    assert row.jvm_name == "java/util/ArrayList" and row.super_sig == "Ljava/util/AbstractList<TE;>;" and row.resource_uri == f"jrt://{home}!/modules/java.base/java/util/ArrayList.class"
    module = files.module_entries(parsed).first()
    assert module.name == "java.base" and "java/util" in [e["package"] for e in module.exports] and "java/util" in module.packages


def test_identifiers_and_text_blocks():
    from sparrowdex.sources import javasource

    text = 'package p; class A { static final String S = """\n      one\n        two  \n\n      three""";\n int \U0001d4b3y; // no\n String t = "new"; B.C c; A.In d; }'
    assert javasource.identifiers(text) == ["A", "B", "C", "In", "S", "String", "c", "d", "p", "t", "\U0001d4b3y"]
    types = javasource.parse(text)[0]
    assert types[0]["fields"][0]["const"]["s"] == "one\n  two\n\nthree"
    assert [f["sig"] for f in types[0]["fields"] if f["name"] in ("c", "d")] == ["LB$C;", "Lp/A$In;"]


def test_occurrences_of_a_file():
    from sparrowdex.sources import javasource

    text = "package p;\nimport q.Other;\nimport static q.Util.max;\nclass A<T> extends Other {\n  private Other o;\n  A(int n) { super(n); this.o = null; }\n  int f(java.util.List<String> xs) {\n    for (String x : xs) o.run(x, max(1, 2));\n    return new In(xs).size;\n  }\n  class In { int size; In(Object a) {} }\n}\n"
    got = {(o["line"], o["name"], o["col"]): o for o in javasource.occurrences(text)}
    at = lambda line, name: next(o for (k, n, _), o in sorted(got.items()) if (k, n) == (line, name))
    assert all(text[o["start_off"] : o["end_off"]] == o["name"] for o in got.values())
    assert at(1, "Other")["owner"] == "q/Other" and at(2, "max")["owner"] == "q/Util"
    assert at(5, "A")["is_declaration"] and at(5, "A")["params"] == ["I"] and at(5, "o")["receiver"] == "this"
    run = at(7, "run")
    assert (run["role"], run["receiver"], run["arity"], run["scope"]) == ("method", "Other", 2, "p/A")
    assert at(7, "max")["role"] == "method" and at(7, "x")["role"] == "local" and at(8, "In")["role"] == "type"
    assert at(10, "size")["owner"] == "p/A$In" and at(10, "size")["scope"] == "p/A$In"
