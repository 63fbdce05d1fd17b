"""Queries of the remaining operators over the tables, each with SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import bloom, flags, names
from ..operators import annotations, complete, hierarchy, stats, store, xref
from ..operators.rounds import scratch
from ..sources import manifest
from ..streaming import incremental
from .reference import KIND, _kind, query, table

# --- names ------------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, n IN (2, 3) AS skipped_name, n = 0 AS skipped_file, n = 1 AS module_info FROM (SELECT p_partkey, p_size % 5 AS n FROM part)""")
def skipped_names(spark, sf_dir):
    """Names and files that never become types."""
    made = F.element_at(F.array(*map(F.lit, ["a/package-info.java", "module-info.class", "a/b/package-info", "module-info", "a/Foo"])), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.is_skipped_name(made).alias("skipped_name"), names.is_skipped_file(made).alias("skipped_file"), names.is_module_info(made).alias("module_info"))


@query("""
SELECT p_partkey, 'a/' || w[1] || '/' || upper(w[2][1]) || substr(w[2], 2) || '$' || upper(w[1][1]) || substr(w[1], 2) AS jvm, 'a/' || w[1] || '/' || w[2] AS package_path, true AS dotted, false AS spaced
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def dotted_selections(spark, sf_dir):
    """Dotted selections as binary names; which texts are dotted names."""
    w = F.split("p_name", " ")
    first, second = F.get(w, 0), F.get(w, 1)
    high = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    dotted = F.concat_ws(".", F.lit("a"), first, high(second), high(first))
    return table(spark, sf_dir, "part").select("p_partkey", names.jvm_of_dotted(dotted).alias("jvm"), names.jvm_of_dotted(F.concat_ws(".", F.lit("a"), first, second)).alias("package_path"), names.is_dotted_name(dotted).alias("dotted"), names.is_dotted_name("p_name").alias("spaced"))


@query("SELECT p_partkey, 1 AS line, CAST(length(w[2]) AS INTEGER) AS col, CAST(length(w[2]) + 1 AS INTEGER) AS with_cr FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def columns_without_cr(spark, sf_dir):
    """A carriage return counts in the column for one back end, for the other it does not."""
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("\r\n")), F.lit("\r\nend"))
    at = (F.length("p_name") + 2).cast("int")
    plain, counted = xref.position_at(text, at, count_cr=False), xref.position_at(text, at)
    return table(spark, sf_dir, "part").select("p_partkey", plain["line"].cast("int").alias("line"), plain["col"].cast("int").alias("col"), counted["col"].cast("int").alias("with_cr"))


# --- flags and annotations --------------------------------------------------------------------------------------------

DEPRECATED = "p_partkey % 7 = 0"


def _notes() -> F.Column:
    """Deprecated on each seventh part, for removal on each fourteenth."""
    one = lambda removal: F.array(F.struct(F.lit(flags.DEPRECATED_SIG).alias("type_sig"), F.create_map(F.lit("forRemoval"), F.lit(removal)).alias("values")))
    return F.when(F.col("p_partkey") % 14 == 0, one("true")).when(F.col("p_partkey") % 7 == 0, one("false"))


@query(f"""
SELECT p_partkey, CAST(((f & ~65536) | CASE WHEN (f & 65536) <> 0 THEN 16777216 ELSE 0 END) | CASE WHEN (f & 512) = 0 THEN 32 ELSE 0 END | CASE WHEN p_partkey % 5 = 0 THEN 268435456 ELSE 0 END | CASE WHEN {DEPRECATED} THEN 1048576 ELSE 0 END AS BIGINT) AS class_modifiers,
  CAST(p_size | CASE WHEN k IN ('INTERFACE', 'ANNOTATION') THEN 25 ELSE 0 END | CASE WHEN {DEPRECATED} THEN 1048576 ELSE 0 END AS BIGINT) AS field_modifiers, CAST(CASE WHEN {DEPRECATED} THEN 70368744177664 ELSE 0 END AS BIGINT) AS tags, p_partkey % 5 = 0 AS sealed
FROM (SELECT *, CAST(p_size AS BIGINT) | CASE k WHEN 'INTERFACE' THEN 1536 WHEN 'ENUM' THEN 16400 WHEN 'ANNOTATION' THEN 9728 WHEN 'RECORD' THEN 65552 ELSE 0 END AS f FROM (SELECT *, {KIND} AS k FROM part))""")
def binary_flags(spark, sf_dir):
    """Modifiers as the other back end has them."""
    permitted = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("a/B"))).otherwise(F.array().cast("array<string>"))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", flags.binary_class_modifiers("p_size", _kind(), permitted, _notes()).alias("class_modifiers"), flags.binary_field_modifiers("p_size", _kind(), _notes()).alias("field_modifiers"), flags.annotation_tags(_notes()).alias("tags"), flags.is_sealed(permitted).alias("sealed"))


@query(f"""
SELECT p_partkey, CAST(f | CASE WHEN d AND (f & 3) = 0 AND (f & 7) = 0 THEN 0 ELSE 0 END AS BIGINT) | CASE WHEN dflt THEN 131072 ELSE 0 END AS method_modifiers FROM (
  SELECT p_partkey, dflt, d, g | CASE WHEN d AND NOT b AND (g & 10) = 0 THEN 1024 ELSE 0 END AS f FROM (
    SELECT *, m | CASE WHEN d AND (m & 7) = 0 THEN 1 ELSE 0 END AS g FROM (
      SELECT *, CAST(p_size AS BIGINT) | CASE WHEN p_partkey % 3 = 0 THEN 128 ELSE 0 END AS m, p_partkey % 2 = 0 AS b, p_partkey % 11 = 0 AS dflt, coalesce(k IN ('INTERFACE', 'ANNOTATION'), false) AS d FROM (SELECT *, {KIND} AS k FROM part))))""")
def binary_method_flags(spark, sf_dir):
    """Methods of the other back end: implied access, missing bodies, defaults of annotations."""
    out = flags.binary_method_modifiers("p_size", F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 2 == 0, _kind(), F.col("p_partkey") % 11 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("method_modifiers"))


@query(f"""
SELECT p_partkey, CAST(p_size AS BIGINT) | CASE WHEN {DEPRECATED} THEN 70368744308736 ELSE 0 END | CASE WHEN p_partkey % 14 = 0 THEN 36028797018963968 ELSE 0 END AS flags, {DEPRECATED} AS deprecated FROM part""")
def deprecations(spark, sf_dir):
    """What the Deprecated annotation adds to flags."""
    return table(spark, sf_dir, "part").select("p_partkey", flags.with_deprecation(F.col("p_size").cast("long"), _notes()).alias("flags"), flags.deprecated(_notes()).alias("deprecated"))


@query(f"""
SELECT p_partkey, CAST(f | CASE WHEN i THEN 9 ELSE 0 END | CASE WHEN k IN ('INTERFACE', 'ANNOTATION', 'ENUM', 'RECORD') THEN 8 ELSE 0 END AS BIGINT) AS inner_flags FROM (
  SELECT *, CAST((p_size | CASE k WHEN 'INTERFACE' THEN 1536 WHEN 'ENUM' THEN 16400 WHEN 'ANNOTATION' THEN 9728 WHEN 'RECORD' THEN 65552 ELSE 0 END) & ~32 AS BIGINT) AS f, k IS NOT NULL AND p_partkey % 2 = 0 AS i FROM (SELECT *, {KIND} AS k FROM part))""")
def inner_class_flags(spark, sf_dir):
    """A type within an interface is public and static; some kinds are static anywhere."""
    outer = F.when(F.col("p_partkey") % 2 == 0, "INTERFACE").otherwise("CLASS")
    return table(spark, sf_dir, "part").select("p_partkey", flags.inner_class_flags("p_size", _kind(), F.lit(0), outer).alias("inner_flags"))


@query("""
SELECT p_partkey, len(list_filter(range(0, 4), lambda i: (p_size % (i + 1)) <> 1 OR i = 3)) AS visible FROM (SELECT p_partkey, p_size FROM part)""")
def visible_members(spark, sf_dir):
    """Private members are left out, constructors are not."""
    member = lambda i: F.struct(F.when(F.col("p_size") % (i + 1) == 1, flags.PRIVATE).otherwise(flags.PUBLIC).alias("modifiers"), F.lit("<init>" if i == 3 else f"m{i}").alias("name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(flags.visible_members(F.array(*map(member, range(4))))).cast("long").alias("visible"))


def _annotated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions with an annotation each, and the methods of its type."""
    value = lambda k: F.when(F.col("r_regionkey") % 2 == 0, F.lit('"one"')).otherwise(F.lit('["one","two"]')) if k == "names" else F.lit('{"const":"LOW","enum":null}')
    values = F.create_map(F.lit("names"), value("names"), F.lit("level"), value("level"), F.lit("gone"), F.lit("1"), F.lit("odd"), F.lit('{"unsupported":"1+x"}'))
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.array(F.struct(F.lit("La/Note;").alias("type_sig"), values.alias("values"))).alias("annotations"))
    methods = spark.createDataFrame([("a/Note", "names", "[Ljava/lang/String;", None), ("a/Note", "level", "La/Level;", None), ("a/Note", "odd", "I", None), ("a/Note", "since", "I", "7")], "owner string, name string, return_sig string, annotation_default string")
    return rows, methods


@query("""
SELECT r_regionkey, 'a/Note' AS annotation, e AS element, CASE e WHEN 'names' THEN CASE WHEN r_regionkey % 2 = 0 THEN '["one"]' ELSE '["one","two"]' END WHEN 'level' THEN '{"const":"LOW","enum":"La/Level;"}' ELSE '7' END AS value
FROM region, (VALUES ('names'), ('level'), ('since')) v(e)""")
def annotation_values(spark, sf_dir):
    """Values as attributes of their type: single ones wrapped, unknown and unsupported ones dropped, enum
    constants bound, defaults added."""
    rows, methods = _annotated(spark, sf_dir)
    known = annotations.coerced(annotations.elements(rows, ["r_regionkey"]), methods)
    uses = rows.select("r_regionkey", F.lit("a/Note").alias("annotation"))
    full = annotations.with_defaults(known, uses, ["r_regionkey"], methods.where("name = 'since'"))
    return full.select("r_regionkey", "annotation", "element", "value")


# --- Bloom filter -----------------------------------------------------------------------------------------------------


@query(r"""
WITH names AS (SELECT DISTINCT p_brand, p_name AS name FROM part), sized AS (
  SELECT p_brand, CAST(greatest(64, ceil(-n * ln(0.01) / (ln(2) * ln(2)))) AS BIGINT) AS m, n FROM (SELECT p_brand, count(*) AS n FROM names GROUP BY 1)
), kinds AS (SELECT p_brand, m, CAST(least(8, greatest(1, floor(m / n * ln(2) + 0.5))) AS BIGINT) AS k FROM sized),
one AS (
  SELECT p_brand, name, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) AS BIGINT) AS h1,
    CAST(((length(name) * 31 + ascii(name)) * 31 + ascii(name[-1])) % 4294967296 AS BIGINT) AS s FROM names
), two AS (SELECT *, CAST((xor(s, s >> 16)::HUGEINT * 2246822507) % 4294967296 AS BIGINT) AS a FROM one),
three AS (SELECT *, CAST((xor(a, a >> 13)::HUGEINT * 3266489906 + xor(a, a >> 13)::HUGEINT * 3) % 4294967296 AS BIGINT) AS b FROM two),
hashed AS (SELECT p_brand, h1, xor(b, b >> 16) | 1 AS h2 FROM three),
each AS (SELECT h.p_brand, m, k, (h1 + i * h2) & 4294967295 AS p FROM hashed h JOIN kinds USING (p_brand), LATERAL (SELECT unnest(range(0, k)) AS i)),
bits AS (SELECT DISTINCT p_brand, m, k, (((CASE WHEN p > 2147483647 THEN p - 4294967296 ELSE p END) % m) + m) % m AS bit FROM each)
SELECT p_brand, CAST(m AS INTEGER) AS bit_count, CAST(k AS INTEGER) AS hash_count, CAST(bit AS BIGINT) AS bit FROM bits""")
def bloom_bits(spark, sf_dir):
    """The filter of each brand's part names, bit by bit."""
    built = bloom.build(table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name")), ["p_brand"])
    word = built.select("p_brand", "bit_count", "hash_count", F.posexplode("bits").alias("w", "b"))
    one = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftrightunsigned", F.col("b"), i).bitwiseAND(F.lit(1).cast("long")) == 1))
    return word.select("p_brand", "bit_count", "hash_count", "w", one.alias("i")).select("p_brand", "bit_count", "hash_count", (F.col("w") * 64 + F.col("i")).cast("long").alias("bit"))


@query("SELECT p_brand, CAST(count(DISTINCT p_name) AS BIGINT) AS names, CAST(count(DISTINCT p_name) AS BIGINT) AS found FROM part GROUP BY 1")
def bloom_members(spark, sf_dir):
    """A filter answers yes for each of its names."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name")).distinct()
    probed = p.join(bloom.build(p, ["p_brand"]), "p_brand").select("p_brand", bloom.might_contain("name").alias("hit"))
    return probed.groupBy("p_brand").agg(F.count("*").alias("names"), F.count_if("hit").alias("found"))


# --- manifest ---------------------------------------------------------------------------------------------------------

MANIFEST_SQL = """
WITH t AS (
  SELECT 'ns' || r_regionkey AS ns, r_regionkey AS ord, ['src/' || r_regionkey, 'shared'] AS sources, ['out/' || r_regionkey] AS classes, ['m' || r_regionkey] AS mods, CASE WHEN r_regionkey < 2 THEN 'jrt:///jdk' END AS image FROM region
), m AS (SELECT r_regionkey AS ord, 'm' || r_regionkey AS id, 'lib/' || r_name || '.jar' AS jar, CASE WHEN r_regionkey % 2 = 0 THEN 'lib/' || r_name || '-sources.jar' END AS sources FROM region)
"""


def _manifest(spark, sf_dir) -> DataFrame:
    """One manifest with a namespace and a module for each region."""
    r, k = table(spark, sf_dir, "region"), F.col("r_regionkey").cast("string")
    none = F.lit(None).cast("array<string>")
    target = F.struct(none.alias("compilerOptions"), F.when(F.col("r_regionkey") < 2, "/jdk").alias("javaHome"), F.array(F.concat(F.lit("src/"), k), F.lit("shared")).alias("sources"), F.array(F.concat(F.lit("out/"), k)).alias("classes"), F.array(F.concat(F.lit("m"), k)).alias("dependencyModules"), none.alias("dependsOn"))
    module = F.struct(F.concat(F.lit("m"), k).alias("id"), F.concat(F.lit("lib/"), "r_name", F.lit(".jar")).alias("jar"), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("lib/"), "r_name", F.lit("-sources.jar"))).alias("sources"))
    entries = r.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("ns"), k), target))).alias("namespaces"), F.array_sort(F.collect_list(module)).alias("dependencyModules"))
    return entries.select(F.col("namespaces").cast(f"map<string,{schemas.MANIFEST_TARGET}>").alias("namespaces"), "dependencyModules")


@query(MANIFEST_SQL + """, rows AS (
  SELECT 0 AS a, ord, 0 AS b, generate_subscripts(sources, 1) AS c, unnest(sources) AS path, 'dir' AS kind FROM t UNION ALL SELECT 0, ord, 1, generate_subscripts(classes, 1), unnest(classes), 'dir' FROM t
  UNION ALL SELECT 0, ord, 2, 0, image, 'image' FROM t WHERE image IS NOT NULL UNION ALL SELECT 1, ord, 0, 0, jar, 'jar' FROM m
), firsts AS (SELECT path, min(a * 1000000 + ord * 10000 + b * 100 + c) AS place, arg_min(kind, a * 1000000 + ord * 10000 + b * 100 + c) AS kind FROM rows GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS rank, kind, path FROM firsts""")
def manifest_inputs(spark, sf_dir):
    """What a manifest says is to be indexed, in its order."""
    return manifest.input_sources(_manifest(spark, sf_dir))


@query(MANIFEST_SQL + "SELECT DISTINCT 'dir' AS kind, unnest(sources) AS path FROM t UNION SELECT 'image', image FROM t WHERE image IS NOT NULL UNION SELECT 'jar', jar FROM m")
def manifest_server_inputs(spark, sf_dir):
    """The server's flat list: sources, images, and the jars that targets name."""
    return manifest.server_sources(_manifest(spark, sf_dir))


@query(MANIFEST_SQL + "SELECT jar, sources FROM m WHERE sources IS NOT NULL")
def manifest_source_jars(spark, sf_dir):
    """The archive of sources of a jar."""
    return manifest.source_jars(_manifest(spark, sf_dir))


@query(MANIFEST_SQL + "SELECT ns AS namespace, CAST(ord AS INTEGER) AS ord, CAST(len(sources) AS INTEGER) AS sources, image FROM t")
def manifest_targets(spark, sf_dir):
    """The namespaces of a manifest, written as JSON and read again."""
    path = f"{scratch(spark)}/manifest-{uuid.uuid4().hex[:12]}"
    _manifest(spark, sf_dir).write.json(path)
    return manifest.targets(manifest.read(spark, path)).select("namespace", "ord", F.size("sources").alias("sources"), "image")


# --- hierarchy --------------------------------------------------------------------------------------------------------


@query("""
WITH RECURSIVE edges(a, b) AS (SELECT s_suppkey, CASE WHEN s_suppkey % 40 = 0 THEN (SELECT max(s_suppkey) FROM supplier y WHERE y.s_suppkey // 40 = x.s_suppkey // 40) ELSE s_suppkey - 1 END FROM supplier x),
walk(start, reached, depth) AS (SELECT a, b, 1 FROM edges UNION ALL SELECT w.start, e.b, w.depth + 1 FROM walk w JOIN edges e ON w.reached = e.a WHERE w.depth < 40)
SELECT start, reached, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def closure_of_rings(spark, sf_dir):
    """Closures over rings of 40 and a shorter one, which a walk leaves when it is back."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    ring = F.expr("s_suppkey div 40")
    last = s.groupBy(ring.alias("ring")).agg(F.max("s_suppkey").alias("last"))
    edges = s.join(last, ring == F.col("ring")).select(F.col("s_suppkey").alias("sub_jvm"), F.when(F.col("s_suppkey") % 40 == 0, F.col("last")).otherwise(F.col("s_suppkey") - 1).alias("super_jvm"))
    return hierarchy.closure(edges, s.select(F.col("s_suppkey").alias("start")), at_once=8)


# --- references, problems ---------------------------------------------------------------------------------------------


@query("SELECT n.n_name, s.s_suppkey FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey")
def static_imports(spark, sf_dir):
    """All members of the name that a static import names."""
    imports = table(spark, sf_dir, "nation").select(F.lit("a/Util").alias("owner"), F.col("n_nationkey").alias("name"), "n_name")
    members = table(spark, sf_dir, "supplier").select(F.lit("a/Util").alias("owner"), F.col("s_nationkey").alias("name"), "s_suppkey")
    return xref.static_import_member(imports, members).select("n_name", "s_suppkey")


@query("SELECT p_partkey, CAST(p_size + 20 - length(p_name) AS INTEGER) AS start_off, CAST(p_size + 20 AS INTEGER) AS end_off FROM part")
def name_ranges(spark, sf_dir):
    """The range of the name at the end of a qualified one."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("start_off"), (F.col("p_size") + 20).alias("end_off"))
    return xref.name_range(rows).select("p_partkey", F.col("start_off").cast("int").alias("start_off"), F.col("end_off").cast("int").alias("end_off"))


@query("""
SELECT 'u' || (user_id % 7) AS uri, CAST(count(DISTINCT (event_id % 50, event_type)) FILTER (event_type = 'error') AS INTEGER) AS problems FROM events GROUP BY 1 UNION ALL SELECT 'u99', 0""")
def published_problems(spark, sf_dir):
    """What is published for each open document; nothing clears what was shown."""
    e = table(spark, sf_dir, "events").withColumn("uri", F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")))
    synthetic = xref.synthetic_problem("u99", "gone")
    blank = [F.lit(synthetic[c]).cast("string" if synthetic[c] is None else "int" if isinstance(synthetic[c], int) else "string").alias(c) for c in ("message", "severity", "source", "code")]
    rows = e.where("event_type = 'error'").select("uri", (F.col("event_id") % 50).alias("start_off"), (F.col("event_id") % 50 + 1).alias("end_off"), *blank).distinct()
    opened = e.select("uri").distinct().union(spark.createDataFrame([("u99",)], "uri string"))
    return xref.published(opened, rows).select("uri", F.size("problems").alias("problems"))


@query("SELECT event_type AS code, event_type || ' of ' || (user_id % 5) AS message, count(*) AS count, min(event_id) AS first_place FROM events GROUP BY 1, 2 ORDER BY count DESC, message, code LIMIT 7")
def frequent_problems(spark, sf_dir):
    """The most frequent problems, the first of them."""
    message = F.concat("event_type", F.lit(" of "), (F.col("user_id") % 5).cast("string"))
    return xref.coalesced_problems(table(spark, sf_dir, "events"), "event_type", message, "event_id", limit=7)


@query("SELECT count(*) AS jars, CAST(coalesce(sum(CAST(floor(p_retailprice) AS BIGINT)), 0) AS BIGINT) AS jar_bytes FROM part WHERE p_size % 3 = 0")
def jar_statistics(spark, sf_dir):
    """A3: number and size of the jars among the sources."""
    p = table(spark, sf_dir, "part").select(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".JAR").otherwise("/")).alias("source_uri"), F.floor("p_retailprice").cast("long").alias("length"))
    return stats.jar_stats(p)


@query("SELECT CAST(c_nationkey AS INTEGER) AS scope, c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def file_local_symbols(spark, sf_dir):
    """Occurrences of a local symbol stay within their scope."""
    rows = table(spark, sf_dir, "customer").select(F.lit("f").alias("resource_path"), F.col("c_nationkey").alias("scope"), "c_custkey", "c_name")
    return xref.file_local(rows, "resource_path", "f", "scope", 7).select(F.col("scope").cast("int").alias("scope"), "c_custkey", "c_name")


# --- incremental ------------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'file:///w/src/' ELSE 'file:///w/src/nested/' END AS root, 'com/E' || event_id || '.java' AS resource_path FROM events WHERE user_id % 3 < 2 AND event_type <> 'error'""")
def applicable_events(spark, sf_dir):
    """Events of sources under a root, with the longest root and the path below it."""
    root = F.when(F.col("user_id") % 3 == 0, "file:///w/src/").when(F.col("user_id") % 3 == 1, "file:///w/src/nested/").otherwise("file:///other/")
    end = F.when(F.col("event_type") == "error", ".txt").otherwise(".java")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(root, F.lit("com/E"), F.col("event_id").cast("string"), end).alias("uri"))
    return incremental.applicable(e, ["file:///w/src", "file:///w/src/nested/"]).select("event_id", "root", "resource_path")


def _stream(spark, sf_dir, name: str) -> DataFrame:
    """A table as a stream; one that is a single file is picked out of its folder, as a stream reads folders only."""
    stream = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{sf_dir}/{name}.parquet")
    return stream.option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", False).parquet(sf_dir)


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def streamed_events(spark, sf_dir):
    """File events as a stream; each batch's last events are applied, then listeners are told."""
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex[:12]}"
    told = []
    query_ = incremental.event_stream(_stream(spark, sf_dir, "events"), lambda batch: batch.write.mode("append").parquet(f"{base}/out"), f"{base}/state", ["ts", "event_id"], key="user_id", listeners=(told.append, lambda _: 1 / 0))
    query_.awaitTermination()
    assert told  # the listener before the one that fails
    return incremental.latest(spark.read.parquet(f"{base}/out"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT conv_id AS uri, arg_max(text, turn) AS text, max(turn) AS version FROM conversations GROUP BY 1")
def streamed_documents(spark, sf_dir):
    """Open documents as a stream with state; the last change of each wins."""
    base = f"{scratch(spark)}/documents-{uuid.uuid4().hex[:12]}"
    changes = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("version"), "text", F.lit("change").alias("kind"), F.col("turn").alias("seq"))
    made = incremental.document_store(changes)
    sink = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")
    made.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    last = incremental.latest(spark.read.parquet(f"{base}/out"), "uri", ["batch"])
    return last.select(F.col("uri").cast("long").alias("uri"), "text", "version")


# --- completion -------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, p_size FROM part WHERE starts_with(p_name, 'red') AND p_brand = 'Brand#3') WHERE (p_size & 2) = 0 AND (p_size & 8) = 0""")
def instance_members(spark, sf_dir):
    """K2: members after an expression and a dot: neither private nor static."""
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_name").alias("name"), F.col("p_size").alias("modifiers"), F.lit("field").alias("kind"), "p_partkey")
    return complete.qualified_members(members, "Brand#3", "red", static=False).select("p_partkey", F.col("name").alias("p_name"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || '(' || replace(p_name, ' ', ',') || ')' ELSE p_name END AS dedup_key FROM part")
def completion_keys(spark, sf_dir):
    """K4: methods are told apart by their parameters, others by name."""
    kind = F.when(F.col("p_size") % 2 == 0, "method").otherwise("field")
    return table(spark, sf_dir, "part").select("p_partkey", complete.dedup_key(kind, F.col("p_name"), F.split("p_name", " ")).alias("dedup_key"))


@query("SELECT p_type AS name, p_brand AS source_uri, CAST(min(p_partkey) AS BIGINT) AS resource_path FROM part WHERE p_type = 'PROMO' GROUP BY 1, 2 ORDER BY 2, 3 LIMIT 1")
def module_by_name(spark, sf_dir):
    """The first module of a name."""
    m = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name"), F.col("p_brand").alias("source_uri")).agg(F.min("p_partkey").alias("resource_path"))
    return store.get_module(m, "PROMO")
