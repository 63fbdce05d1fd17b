"""The index operators bound to plain tables, each with SQL that says the same.

Operators take their key columns as arguments, so a table of parts with many rows of one name stands for a table of
declarations with many candidates, document sources for class-path containers, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom, flags, names
from ..operators import classpath, complete, hierarchy, resolve, stats, store, synth, xref
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

ASCII_NAME = "[A-Za-z_][A-Za-z0-9_]*"
BRANDS = ["Brand#2", "Brand#14", "Brand#1", "Brand#7"]
SOURCES = ["src1", "src7", "src15"]
HOSTS = ["https://", "http://", "https://m.", "https://th", "http://th", "https://thther.example.org/"]
RULES = [("alpha", 0, "src1"), ("alpha", 1, "src2"), ("beta", 0, "src2"), ("beta", 1, "src1"), ("gamma", 0, "src")]
WORD = "then"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + ")"


def _rank_sql(uri: str, path: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({uri}, '{p}') THEN {i}" for i, p in enumerate(path)) + " ELSE -1 END"


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- search path ------------------------------------------------------------------------------------------------------


@query(f"""
SELECT p_name, p_brand, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY r, p_partkey) AS n FROM (SELECT *, {_rank_sql("p_brand", BRANDS)} AS r FROM part) WHERE r >= 0
) WHERE n = 1""")
def classpath_pick(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_partkey")
    return classpath.pick(parts, "p_name", "p_brand", BRANDS, ["p_partkey"])


@query(f"SELECT DISTINCT p_brand, CAST({_rank_sql('p_brand', BRANDS)} AS INTEGER) AS rank FROM part")
def classpath_rank(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("rank", classpath.rank("p_brand", BRANDS))


@query(f"SELECT doc_id, source FROM documents WHERE {_rank_sql('source', SOURCES)} >= 0")
def classpath_visible(spark, sf_dir):
    return classpath.visible(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", SOURCES)


@query(f"""
SELECT p_name, p_brand, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY r, p_partkey) AS n FROM (SELECT *, {_rank_sql("p_brand", BRANDS)} AS r FROM part)
  WHERE r >= 0 AND p_name IN (SELECT p_name FROM part WHERE p_size = 50)
) WHERE n = 1""")
def classpath_winners(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return classpath.winners(parts.where("p_size = 50"), parts.select("p_name", "p_brand", "p_partkey"), "p_name", "p_brand", BRANDS, ["p_partkey"])


@query(f"""
SELECT source, arg_min(namespace, {{'rank': rank, 'namespace': namespace}}) AS namespace
FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN {_values(RULES)} r(namespace, rank, prefix) ON starts_with(source, prefix) GROUP BY source""")
def owning_namespace(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "namespace string, rank int, prefix string")
    return classpath.owning_namespace(table(spark, sf_dir, "documents"), "source", rules)


@query(f"""
SELECT url, (SELECT arg_max(r, length(r)) FROM (SELECT unnest({_list_sql(HOSTS)}) AS r) WHERE starts_with(url, r)) AS root FROM (SELECT DISTINCT url FROM pages)""")
def longest_root(spark, sf_dir):
    return classpath.longest_root(table(spark, sf_dir, "pages"), "url", HOSTS)


@query("""
SELECT p_name, p_brand, p_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY CASE WHEN uri IS NULL THEN 10000 WHEN starts_with(uri, 'Brand#3') THEN 0 ELSE 10001 END, p_partkey) AS n
  FROM (SELECT *, CASE WHEN p_size > 3 THEN p_brand END AS uri FROM part)
) WHERE n = 1""")
def module_pick(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("uri", F.when(F.col("p_size") > 3, F.col("p_brand")))
    return classpath.pick_module(parts, "p_name", "uri", ["Brand#3"], ["p_partkey"]).select("p_name", "p_brand", "p_partkey")


@query("SELECT DISTINCT p_name FROM part WHERE p_size <= 3 OR starts_with(p_brand, 'Brand#3')")
def visible_modules(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("uri", F.when(F.col("p_size") > 3, F.col("p_brand")))
    return classpath.visible_modules(parts, "p_name", "uri", ["Brand#3"])


@query("""
WITH first AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size = 1), second AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size = 2)
SELECT * FROM first UNION ALL SELECT * FROM second WHERE p_name NOT IN (SELECT p_name FROM first)""")
def list_with_fallback(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    first, second = (parts.where(F.col("p_size") == k).select("p_name", "p_brand").distinct() for k in (1, 2))
    return classpath.with_fallback(first, second, ["p_name"])


@query("""
SELECT p_partkey, list_contains(list_distinct(list_concat(list_concat(string_split(p_name, ' '), [p_type]), [p_brand])), 'blue') AS owns FROM part""")
def module_owns_package(spark, sf_dir):
    owns = classpath.module_owns(F.lit("blue"), F.split("p_name", " "), F.array("p_type"), F.array("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", owns.alias("owns"))


@query("""
WITH t(namespace, sources, deps, jars, image) AS (
  SELECT 'region' || r_regionkey, ['src/r' || r_regionkey || '/a', 'src/r' || r_regionkey || '/b'], [d FOR d IN ['region' || (r_regionkey + 1), 'region' || (r_regionkey + 2)]], ['j' || r_regionkey, 'j0'], CASE WHEN r_regionkey < 3 THEN 'jrt://home' END FROM region
), m(id, jar) AS (SELECT 'j' || r_regionkey, 'lib/' || r_name || '.jar' FROM region),
rows AS (
  SELECT namespace, 0 AS b, 0 AS o, generate_subscripts(sources, 1) AS i, unnest(sources) AS prefix FROM t
  UNION ALL SELECT d.namespace, 1, d.o, generate_subscripts(t.sources, 1), unnest(t.sources) FROM (SELECT namespace, generate_subscripts(deps, 1) AS o, unnest(deps) AS dep FROM t) d JOIN t ON d.dep = t.namespace
  UNION ALL SELECT j.namespace, 2, j.o, 0, m.jar FROM (SELECT namespace, generate_subscripts(jars, 1) AS o, unnest(jars) AS id FROM t) j JOIN m ON j.id = m.id
  UNION ALL SELECT namespace, 3, 0, 0, image FROM t WHERE image IS NOT NULL
), firsts AS (SELECT namespace, prefix, min(b * 1000000 + o * 1000 + i) AS place FROM rows GROUP BY 1, 2)
SELECT namespace, CAST(row_number() OVER (PARTITION BY namespace ORDER BY place, prefix) - 1 AS INTEGER) AS rank, prefix FROM firsts""")
def classpath_build(spark, sf_dir):
    r, k = table(spark, sf_dir, "region"), F.col("r_regionkey")
    name = lambda n: F.concat(F.lit("region"), n.cast("string"))
    src = lambda end: F.concat(F.lit("src/r"), k.cast("string"), F.lit(end))
    targets = r.select(name(k).alias("namespace"), F.array(src("/a"), src("/b")).alias("sources"), F.array(name(k + 1), name(k + 2)).alias("depends_on"), F.array(F.concat(F.lit("j"), k.cast("string")), F.lit("j0")).alias("dependency_modules"), F.when(k < 3, "jrt://home").alias("image"))
    modules = r.select(F.concat(F.lit("j"), k.cast("string")).alias("id"), F.concat(F.lit("lib/"), "r_name", F.lit(".jar")).alias("jar"))
    return classpath.build_path(targets.select("namespace"), targets, modules)


# --- identifiers and references ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{ASCII_NAME}'))) AS name FROM documents")
def identifier_index(spark, sf_dir):
    return xref.identifiers(table(spark, sf_dir, "documents"), ["doc_id"], pattern=ASCII_NAME)


POSITIONS = f"""
WITH parts AS (
  SELECT doc_id, regexp_extract_all(text, '{ASCII_NAME}') AS n, string_split_regex(text, '{ASCII_NAME}') AS g FROM documents
), each AS (
  SELECT doc_id, unnest(n) AS name, unnest(g[1:len(n)]) AS gap, generate_subscripts(n, 1) AS i FROM parts
), sums AS (
  SELECT *, sum(length(gap) + length(name)) OVER w AS end_off, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER w AS line FROM each WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), begins AS (
  SELECT *, end_off - length(name) AS start_off, max(CASE WHEN contains(gap, chr(10)) THEN end_off - length(name) - length(list_last(string_split(gap, chr(10)))) END) OVER (PARTITION BY doc_id ORDER BY i) AS line_start FROM sums
), places AS (
  SELECT doc_id, name, CAST(line AS INTEGER) AS line, CAST(start_off - coalesce(line_start, 0) AS INTEGER) AS col, CAST(start_off AS INTEGER) AS start_off, CAST(end_off AS INTEGER) AS end_off FROM begins
)
"""


@query(POSITIONS + f"SELECT doc_id, line, col, start_off, end_off FROM places WHERE name = '{WORD}'")
def occurrences(spark, sf_dir):
    return xref.name_positions(table(spark, sf_dir, "documents"), ["doc_id"], WORD, letters="A-Za-z_").drop("name")


@query(f"""
WITH hits AS (SELECT DISTINCT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '{ASCII_NAME}'), '{WORD}')),
pinned AS (SELECT doc_id FROM documents WHERE source = 'src3')
SELECT doc_id, true AS is_pinned FROM pinned UNION ALL
SELECT doc_id, false FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM hits WHERE doc_id NOT IN (SELECT doc_id FROM pinned)) WHERE n <= 200 - (SELECT count(*) FROM pinned)""")
def reference_candidates_capped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = xref.mentioning(docs, ["doc_id"], WORD, pattern=ASCII_NAME)
    return xref.capped(hits, docs.where("source = 'src3'"), "doc_id", 200)


@query(f"""
SELECT DISTINCT doc_id FROM documents WHERE list_contains(regexp_extract_all(text, '{ASCII_NAME}'), '{WORD}') OR source = 'src3'""")
def reference_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = xref.mentioning(docs, ["doc_id"], WORD, pattern=ASCII_NAME)
    return store.distinct_union(hits, docs.where("source = 'src3'").select("doc_id"))


def _references(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The places of the word, and as its declaration the first place of each document."""
    found = xref.name_positions(table(spark, sf_dir, "documents"), ["doc_id"], WORD, letters="A-Za-z_")
    return found, found.groupBy("doc_id").agg(F.min("start_off").alias("start_off"))


FIRST = f"SELECT doc_id, min(start_off) AS start_off FROM places WHERE name = '{WORD}' GROUP BY doc_id"


@query(POSITIONS + f"SELECT DISTINCT doc_id, start_off FROM places WHERE name = '{WORD}' EXCEPT ({FIRST})")
def find_references_minus_decl(spark, sf_dir):
    found, declared = _references(spark, sf_dir)
    return xref.finalize(found, declared, ["doc_id", "start_off"], include=False)


@query(POSITIONS + f"SELECT doc_id, start_off FROM places WHERE name = '{WORD}' UNION ({FIRST})")
def find_references_with_decl(spark, sf_dir):
    found, declared = _references(spark, sf_dir)
    return xref.finalize(found, declared, ["doc_id", "start_off"], include=True)


#: An offset somewhere in each text.
OFFSET = "CAST((doc_id * 7919) % (length(text) + 1) AS INTEGER)"


def _offset() -> Column:
    return F.expr("cast((doc_id * 7919) % (length(text) + 1) as int)")


@query(POSITIONS + f""", asked AS (SELECT doc_id, {OFFSET} AS "offset" FROM documents)
SELECT p.doc_id, "offset", arg_min(name, {{'w': end_off - start_off, 's': start_off}}) AS name, arg_min(start_off, {{'w': end_off - start_off, 's': start_off}}) AS start_off, arg_min(end_off, {{'w': end_off - start_off, 's': start_off}}) AS end_off
FROM asked a JOIN places p ON a.doc_id = p.doc_id AND start_off <= "offset" AND "offset" < end_off GROUP BY p.doc_id, "offset" """)
def occurrence_at_offset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("offset", _offset())
    return docs.select("doc_id", "offset", xref.token_at("text", "offset", letters="A-Za-z_").alias("t")).where("t is not null").select("doc_id", "offset", "t.*")


@query("""
SELECT o_orderkey, "offset", arg_min(n, {'w': e - s, 's': s, 'n': n}) AS name, arg_min(s, {'w': e - s, 's': s, 'n': n}) AS start_off, arg_min(e, {'w': e - s, 's': s, 'n': n}) AS end_off FROM (
  SELECT o_orderkey, CAST(o_custkey % 500 AS INTEGER) AS "offset", CAST(l_linenumber * 60 AS INTEGER) AS s, CAST(l_linenumber * 60 + l_quantity * 8 AS INTEGER) AS e, l_returnflag AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
) WHERE s <= "offset" AND "offset" < e GROUP BY 1, 2""")
def narrowest_occurrence(spark, sf_dir):
    """X2 over a table of occurrences that overlap."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500).cast("int").alias("offset"))
    start = F.col("l_linenumber") * 60
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("name"), start.cast("int").alias("start_off"), (start + F.col("l_quantity") * 8).cast("int").alias("end_off"))
    return xref.occurrence_at(asked, rows, "o_orderkey")


@query(f"""
SELECT doc_id, CAST(length(h) - length(replace(h, chr(10), '')) AS INTEGER) AS line, CAST(length(list_last(string_split(h, chr(10)))) AS INTEGER) AS col FROM (SELECT doc_id, substr(text, 1, {OFFSET}) AS h FROM documents)""")
def position_at_offset(spark, sf_dir):
    at = xref.position_at("text", _offset())
    return table(spark, sf_dir, "documents").select("doc_id", at["line"].cast("int").alias("line"), at["col"].cast("int").alias("col"))


@query("""
SELECT doc_id, CAST(coalesce(list_sum(list_transform(l[1:2], lambda x: length(x) + 1)), 0) + least(7, coalesce(length(l[3]), 0)) AS INTEGER) AS start_off FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def offset_at_position(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", xref.offset_at("text", F.lit(2), F.lit(7)).cast("int").alias("start_off"))


@query("""
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)""")
def line_starts(spark, sf_dir):
    out = xref.line_starts(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "line", F.col("line_start").cast("long").alias("line_start"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'T:' || p_brand || '|' || p_name WHEN p_size % 3 = 1 THEN 'M:' || p_brand || '|' || p_name || '#' || p_type || '(' || array_to_string(string_split(p_name, ' '), ',') || ')' ELSE 'F:' || p_brand || '|' || p_name || '#' || p_type END AS symbol_key FROM part""")
def symbol_keys(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("type"), F.lit("method"), F.lit("field")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", xref.symbol_key(kind, "p_brand", "p_name", "p_type", F.split("p_name", " ")).alias("symbol_key"))


@query("""
SELECT p_partkey, p_name, p_type FROM part WHERE p_brand = 'Brand#2' AND len(string_split(p_name, ' ')) = 2 ORDER BY (string_split(p_name, ' ') = ['red', 'ring']) DESC, p_partkey LIMIT 1""")
def go_to_definition(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.lit("f").alias("name"), F.split("p_name", " ").alias("params"), F.col("p_partkey").alias("ord"), "p_partkey", "p_name", "p_type")
    return xref.definition(members, "Brand#2", "f", ["red", "ring"]).select("p_partkey", "p_name", "p_type")


@query("""
SELECT DISTINCT uri, start_off, CASE WHEN end_off < start_off THEN start_off + 1 ELSE end_off END AS end_off, message, CAST(CASE kind WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'NOTE' THEN 3 ELSE 4 END AS INTEGER) AS severity, 'javac' AS source, code
FROM (SELECT 'u' || (user_id % 7) AS uri, event_id % 50 AS start_off, event_id % 60 AS end_off, event_type AS message, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'NOTE' ELSE 'OTHER' END AS kind, props AS code FROM events) WHERE uri = 'u3'""")
def diagnostics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "WARNING").when(F.col("event_type") == "view", "NOTE").otherwise("OTHER")
    rows = e.select(F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("uri"), (F.col("event_id") % 50).alias("start_off"), (F.col("event_id") % 60).alias("end_off"), F.col("event_type").alias("message"), kind.alias("kind"), F.col("props").alias("code"))
    return xref.diagnostics(rows, "u3", "javac")


# --- hierarchy --------------------------------------------------------------------------------------------------------

EDGES = """
WITH RECURSIVE edges AS (
  SELECT 'n' || n_nationkey AS sub_jvm, 'r' || n_regionkey AS super_jvm FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
)"""


def _edges(spark, sf_dir) -> DataFrame:
    tag = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    link = lambda t, a, k, b, p: table(spark, sf_dir, t).select(tag(a, k).alias("sub_jvm"), tag(b, p).alias("super_jvm"))
    parts = [link("nation", "n", "n_nationkey", "r", "n_regionkey"), link("supplier", "s", "s_suppkey", "n", "s_nationkey"), link("customer", "c", "c_custkey", "n", "c_nationkey")]
    return store.add_all(*parts)


@query(EDGES + " SELECT sub_jvm, super_jvm, false AS permitted FROM edges WHERE super_jvm = 'n3'")
def direct_subtypes(spark, sf_dir):
    return hierarchy.direct_subtypes(_edges(spark, sf_dir), "n3").select("sub_jvm", "super_jvm", "permitted")


@query(EDGES + " SELECT sub_jvm, super_jvm FROM edges WHERE sub_jvm = 'n3' OR sub_jvm = 's7'")
def direct_supertypes(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return hierarchy.direct_supertypes(e, "n3").union(hierarchy.direct_supertypes(e, "s7"))


@query(EDGES + """, walk AS (
  SELECT sub_jvm AS start, super_jvm AS reached, 1 AS depth FROM edges WHERE sub_jvm[1] IN ('s', 'c')
  UNION ALL SELECT w.start, e.super_jvm, w.depth + 1 FROM walk w JOIN edges e ON w.reached = e.sub_jvm
) SELECT start, reached, min(depth) AS depth FROM walk GROUP BY 1, 2""")
def hierarchy_closure(spark, sf_dir):
    e = _edges(spark, sf_dir)
    starts = e.where(F.substring("sub_jvm", 1, 1).isin("s", "c")).select(F.col("sub_jvm").alias("start"))
    return hierarchy.closure(e, starts)


@query("""
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'java/lang/Enum' WHEN p_type = 'PROMO' THEN 'java/lang/Record' ELSE 'java/lang/Object' END AS super_jvm FROM part""")
def implicit_supertypes(spark, sf_dir):
    kind = F.when(F.col("p_type") == "ECONOMY", "ENUM").when(F.col("p_type") == "PROMO", "RECORD").otherwise("CLASS")
    return table(spark, sf_dir, "part").select("p_partkey", hierarchy.implicit_super(kind, F.col("p_size")).alias("super_jvm"))


@query("""
SELECT p_partkey, 'T:' || p_brand || '|' || p_name AS key, p_brand AS origin, p_name AS name FROM part""")
def hierarchy_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("key", hierarchy.item_key("p_brand", "p_name"))
    return p.select("p_partkey", "key", hierarchy.origin_of_key("key").alias("origin"), hierarchy.name_of_key("key").alias("name"))


# --- packages, names, URIs --------------------------------------------------------------------------------------------

PATH = r"regexp_extract(url, '^[a-z]+://([^?#]*)', 1)"


def _paths(spark, sf_dir) -> DataFrame:
    """Pages as declarations: host and folders are the package."""
    path = F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", "url", path.alias("jvm_name"), names.package_of(path).alias("package_jvm"))


@query(f"SELECT page_id FROM (SELECT page_id, regexp_extract({PATH}, '^(.*)/[^/]*$', 1) AS p FROM pages) WHERE p = 'thther.example.org' OR starts_with(p, 'thther.example.org/')")
def package_list_recursive(spark, sf_dir):
    return store.list_package(_paths(spark, sf_dir), "thther.example.org", recursive=True).select("page_id")


@query(f"SELECT page_id FROM pages WHERE regexp_extract({PATH}, '^(.*)/[^/]*$', 1) = 'thther.example.org/en'")
def package_list(spark, sf_dir):
    return store.list_package(_paths(spark, sf_dir), "thther.example.org/en").select("page_id")


@query(f"""
SELECT DISTINCT array_to_string(parts[1:i], '/') AS package_jvm FROM (
  SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT string_split(p, '/') AS parts FROM (SELECT DISTINCT regexp_extract({PATH}, '^(.*)/[^/]*$', 1) AS p FROM pages) WHERE p <> '')
)""")
def package_ancestors(spark, sf_dir):
    return store.known_packages(_paths(spark, sf_dir))


@query("SELECT p_name, p_brand, p_partkey FROM part WHERE starts_with(p_name, 'blue') ORDER BY p_name, p_brand, p_partkey LIMIT 40")
def prefix_search_limit(spark, sf_dir):
    return store.search_prefix(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_partkey"), "blue", 40, "p_name", ("p_brand", "p_partkey"))


@query("SELECT count(DISTINCT p_name) AS size, count(*) AS entry_count FROM part")
def index_counts(spark, sf_dir):
    return store.counts(table(spark, sf_dir, "part"), "p_name")


@query("SELECT * FROM part WHERE p_name = 'red widget'")
def get_all(spark, sf_dir):
    return store.get_all(table(spark, sf_dir, "part"), "red widget", "p_name")


@query("SELECT count(DISTINCT p_type) AS module_count FROM part")
def module_count(spark, sf_dir):
    return store.module_count(table(spark, sf_dir, "part").select(F.col("p_type").alias("name")))


@query("""
SELECT page_id, CASE WHEN starts_with(url, 'https://m.') AND contains(url, '/en/') THEN substr(url, strpos(url, '/en/') + 4) END AS relative, url AS rebuilt
FROM (SELECT page_id, url FROM pages)""")
def uri_relative(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("src", F.when(F.startswith("url", F.lit("https://m.")) & F.contains("url", F.lit("/en/")), F.concat(F.substring_index("url", "/en/", 1), F.lit("/en/"))))
    stored = names.compact_uri("url", "src")
    return p.select("page_id", names.relative_path("url", "src").alias("relative"), names.resolve_uri("src", stored).alias("rebuilt"))


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'jrt:/h!/' || p_name WHEN 1 THEN 'jar:file:///x/' || p_type || '.JAR!/' || p_name WHEN 2 THEN 'file:///x/' || p_type || '/' || p_name ELSE 'index:///' || p_name END AS uri FROM part""")
def uri_join(spark, sf_dir):
    s = F.element_at(F.array(F.lit("jrt:/h"), F.concat(F.lit("file:///x/"), "p_type", F.lit(".JAR")), F.concat(F.lit("file:///x/"), "p_type"), F.lit("index:///")), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.join_uri(s, "p_name").alias("uri"))


@query("""
SELECT page_id, url_decode(url_decode(replace(url_encode(url_encode(url)), '+', '%20'))) AS decoded FROM pages""")
def uri_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", names.decode_uri(F.url_encode(F.url_encode("url"))).alias("decoded"))


@query(f"""
SELECT page_id, list_last(string_split({PATH}, '/')) AS simple_name, regexp_extract({PATH}, '^(.*)/[^/]*$', 1) AS package_jvm, replace({PATH}, '/', '.') AS display_name, {PATH} || '.java' AS default_path FROM pages""")
def declaration_names(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", names.simple_name("jvm_name").alias("simple_name"), "package_jvm", names.display_name("jvm_name").alias("display_name"), names.default_path("jvm_name", F.lit("source")).alias("default_path"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'jar:lib/' || p_brand || '-sources.jar!/' || replace(p_name, ' ', '/') || '.java' END AS source_uri FROM part""")
def attached_sources(spark, sf_dir):
    resource = F.concat(F.lit("jar:lib/"), "p_brand", F.lit(".jar!/"), F.translate("p_name", " ", "/"), F.lit("$In.class"))
    archive = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("lib/"), "p_brand", F.lit("-sources.jar")))
    return table(spark, sf_dir, "part").select("p_partkey", names.attached_source(resource, archive).alias("source_uri"))


# --- writes -----------------------------------------------------------------------------------------------------------


@query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE p_brand NOT IN ('Brand#2', 'Brand#9') UNION ALL SELECT p_partkey + 1000000, 'new ' || p_name, p_brand FROM part WHERE p_brand = 'Brand#2' AND p_size > 25""")
def replace_resource(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    gone = parts.where(F.col("p_brand").isin("Brand#2", "Brand#9"))
    new = parts.where("p_brand = 'Brand#2' AND p_size > 25").select((F.col("p_partkey") + 1000000).alias("p_partkey"), F.concat(F.lit("new "), "p_name").alias("p_name"), "p_brand")
    return store.put_resources(parts.drop("p_size"), gone, new, ["p_brand"])


@query("SELECT p_partkey, p_name FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def delete_resource(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return store.delete_resources(parts, parts.where("p_size = 50"), ["p_brand"]).select("p_partkey", "p_name")


@query("SELECT p_name, p_brand FROM part UNION ALL SELECT p_name, p_type FROM part WHERE p_size < 10")
def union_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return store.add_all(parts.select("p_name", "p_brand"), parts.where("p_size < 10").select("p_name", F.col("p_type").alias("p_brand")))


@query("SELECT p_name, p_brand FROM part UNION SELECT p_name, p_type FROM part WHERE p_size < 10")
def dedupe_union(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return store.distinct_union(parts.select("p_name", "p_brand"), parts.where("p_size < 10").select("p_name", F.col("p_type").alias("p_brand")))


# --- incremental ------------------------------------------------------------------------------------------------------


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_event_wins(spark, sf_dir):
    return incremental.latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""
WITH last AS (SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)
SELECT c_custkey AS user_id, c_name AS content FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last) UNION ALL SELECT user_id, 'v' || event_id FROM last WHERE event_type <> 'error'""")
def apply_file_events(spark, sf_dir):
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("content"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    parse = lambda e: e.select("user_id", F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("content"))
    return incremental.apply_events(now, events, ["ts", "event_id"], parse, key="user_id", change="event_type", deleted="error")


@query("SELECT conv_id, arg_max(text, {'t': turn, 'x': text}) AS text, max(turn) AS turn FROM conversations GROUP BY conv_id")
def latest_version(spark, sf_dir):
    return incremental.latest_versions(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""
SELECT c.conv_id, c.turn FROM conversations c JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) d ON c.conv_id = d.conv_id AND c.turn = d.turn WHERE role = 'user'""")
def version_check(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    now = c.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return incremental.still_current(c.where("role = 'user'").select("conv_id", "turn"), now, "conv_id", "turn")


@query("SELECT CAST(epoch_us(ts) // 60000000 * 60000000 AS BIGINT) AS window_start, count(*) AS events FROM events GROUP BY 1")
def throttle_windows(spark, sf_dir):
    return incremental.throttled(table(spark, sf_dir, "events"), "ts", 60)


# --- statistics -------------------------------------------------------------------------------------------------------


@query("""
SELECT count(*) FILTER (doc_id % 2 = 0) AS source_files, count(*) FILTER (doc_id % 2 = 1) AS class_files, CAST(coalesce(sum(n_chars) FILTER (doc_id % 2 = 1), 0) AS BIGINT) AS class_bytes FROM documents""")
def scan_stats(spark, sf_dir):
    return stats.scan_stats(table(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 2 == 0, "a.java").otherwise("a.class"), "n_chars")


@query("""
SELECT source, count(*) AS count, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(octet_length(encode(text))) // count(*) AS BIGINT) AS average FROM documents GROUP BY source ORDER BY bytes DESC, source LIMIT 10""")
def top_by_bytes(spark, sf_dir):
    return stats.top_by_bytes(table(spark, sf_dir, "documents"), "source", F.octet_length("text"), 10)


@query(r"""
SELECT event_type AS code, message, count(*) AS count, min(event_id) AS first_place FROM (
  SELECT event_type, event_id, array_to_string(list_filter(list_transform(string_split(m, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '' AND NOT starts_with(x, 'location:')), ' | ') AS message
  FROM (SELECT event_type, event_id, 'symbol:   ' || (user_id % 5) || chr(10) || ' location: ' || event_id || chr(10) || 'end' AS m FROM events)
) GROUP BY 1, 2""")
def problem_coalesce(spark, sf_dir):
    message = F.concat(F.lit("symbol:   "), (F.col("user_id") % 5).cast("string"), F.lit("\n location: "), F.col("event_id").cast("string"), F.lit("\nend"))
    return stats.coalesced_problems(table(spark, sf_dir, "events"), "event_type", message, "event_id")


@query("""
SELECT url FROM pages WHERE NOT list_has_any(string_split(url, '/'), ['fr', 'de']) ORDER BY url""")
def listed_files(spark, sf_dir):
    return stats.listed_files(table(spark, sf_dir, "pages"), "url", ["fr", "de"])


def _size_sql(n: str) -> str:
    unit = lambda power, name: f"printf('%.2f {name}', floor({n} * 100.0 / {1024**power} + 0.5) / 100)"
    return f"CASE WHEN {n} < 1024 THEN printf('%d B', {n}) WHEN {n} < {1024**2} THEN {unit(1, 'KiB')} WHEN {n} < {1024**3} THEN {unit(2, 'MiB')} ELSE {unit(3, 'GiB')} END"


@query(f"SELECT doc_id, {_size_sql('n_chars')} AS size, {_size_sql('(n_chars * 1024)')} AS larger, {_size_sql('(n_chars * 1048576)')} AS largest FROM documents")
def formatted_bytes(spark, sf_dir):
    size = lambda k: names.format_bytes(F.col("n_chars") * k)
    return table(spark, sf_dir, "documents").select("doc_id", size(1).alias("size"), size(1024).alias("larger"), size(1048576).alias("largest"))


# --- resolution cascade -----------------------------------------------------------------------------------------------

CASCADE_SQL = """
WITH avail AS (SELECT DISTINCT replace(p_name, ' ', '/') AS jvm_name FROM part WHERE p_size % 2 = 0),
refs AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS simple, string_split(p_name, ' ')[1] AS source_package FROM part),
cand AS (
  SELECT simple, source_package, 0 AS ord, 'blue/' || simple AS name, simple = 'ring' AS applies FROM refs UNION ALL
  SELECT simple, source_package, 1, source_package || '/' || simple, true FROM refs UNION ALL SELECT simple, source_package, 2, 'small/' || simple, true FROM refs UNION ALL
  SELECT simple, source_package, 3, 'red/' || simple, true FROM refs UNION ALL SELECT simple, source_package, 4, 'java/lang/' || simple, true FROM refs
)
SELECT r.simple, r.source_package, coalesce((SELECT arg_min(name, ord) FROM cand c WHERE c.simple = r.simple AND c.source_package = r.source_package AND applies AND name IN (SELECT jvm_name FROM avail)), r.source_package || '/' || r.simple) AS resolved FROM refs r"""


@query(CASCADE_SQL)
def name_cascade(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    available = parts.where("p_size % 2 = 0").select(F.translate("p_name", " ", "/").alias("jvm_name"))
    refs = parts.select(F.get(words, 1).alias("simple"), F.get(words, 0).alias("source_package")).distinct()
    hints = {"siblings": F.lit(None).cast("array<string>"), "single_imports": F.when(F.col("simple") == "ring", F.create_map(F.lit("ring"), F.lit("blue/ring"))), "on_demand": F.array(F.lit("small"), F.lit("red"))}
    return resolve.resolve(refs.withColumns(hints), available).select("simple", "source_package", "resolved")


# --- Bloom filter -----------------------------------------------------------------------------------------------------


@query("""
SELECT DISTINCT p_name, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) AS BIGINT) AS hash_one FROM part""")
def bloom_hash(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_name").distinct().withColumn("hash_one", bloom.hash_one("p_name"))


@query(f"""
SELECT doc_id, list_contains(regexp_extract_all(text, '{ASCII_NAME}'), '{WORD}') AS contained, true AS no_false_negative FROM documents WHERE len(regexp_extract_all(text, '{ASCII_NAME}')) > 0""")
def bloom_probe(spark, sf_dir):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(ASCII_NAME), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("names")).where(F.size("names") > 0)
    hits = bloom.build_in_rows(rows.withColumn("contained", F.array_contains("names", F.lit(WORD))), ["doc_id", "contained"])
    return hits.select("doc_id", "contained", (bloom.might_contain(F.lit(WORD)) | ~F.col("contained")).alias("no_false_negative"))


@query(f"""
SELECT doc_id, CAST(greatest(64, ceil(-n * ln(0.01) / (ln(2) * ln(2)))) AS INTEGER) AS bit_count, CAST(least(8, greatest(1, floor(CAST(greatest(64, ceil(-n * ln(0.01) / (ln(2) * ln(2)))) AS INTEGER) / n * ln(2) + 0.5))) AS INTEGER) AS hash_count
FROM (SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{ASCII_NAME}'))) AS n FROM documents) WHERE n > 0""")
def bloom_sizes(spark, sf_dir):
    n = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(ASCII_NAME), F.lit(0))))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where("n > 0").select("doc_id", bloom.bit_count("n").alias("bit_count"), bloom.hash_count("n").alias("hash_count"))


# --- flags, completion, synthesis -------------------------------------------------------------------------------------

KIND = "CASE p_type WHEN 'ECONOMY' THEN 'ENUM' WHEN 'PROMO' THEN 'INTERFACE' WHEN 'SMALL' THEN 'ANNOTATION' WHEN 'LARGE' THEN 'RECORD' WHEN 'MEDIUM' THEN 'CLASS' END"


def _kind() -> Column:
    return F.when(F.col("p_type") == "ECONOMY", "ENUM").when(F.col("p_type") == "PROMO", "INTERFACE").when(F.col("p_type") == "SMALL", "ANNOTATION").when(F.col("p_type") == "LARGE", "RECORD").when(F.col("p_type") == "MEDIUM", "CLASS")


@query(f"""
SELECT p_partkey, CAST((p_size | CASE k WHEN 'INTERFACE' THEN 1536 WHEN 'ENUM' THEN 16400 WHEN 'ANNOTATION' THEN 9728 WHEN 'RECORD' THEN 65552 ELSE 0 END) & ~32 AS BIGINT) AS class_flags,
  CAST(p_size | CASE WHEN k IN ('INTERFACE', 'ANNOTATION') THEN 25 ELSE 0 END AS BIGINT) AS field_flags,
  CASE WHEN k IN ('INTERFACE', 'ANNOTATION') THEN 'Interface' WHEN k = 'ENUM' THEN 'Enum' ELSE 'Class' END AS symbol_kind,
  CASE WHEN k IN ('INTERFACE', 'ANNOTATION') THEN 'Interface' WHEN k = 'ENUM' THEN 'Enum' WHEN k = 'RECORD' THEN 'Struct' ELSE 'Class' END AS completion_kind
FROM (SELECT *, {KIND} AS k FROM part)""")
def modifier_flags(spark, sf_dir):
    k = _kind()
    return table(spark, sf_dir, "part").select("p_partkey", flags.class_flags("p_size", k).alias("class_flags"), flags.field_flags("p_size", k).alias("field_flags"), flags.symbol_kind("p_size", k).alias("symbol_kind"), flags.completion_kind("p_size", k).alias("completion_kind"))


@query(f"""
SELECT p_partkey, CAST(CASE WHEN i AND NOT b AND (f & 10) = 0 THEN f | 1024 WHEN (i OR (k IS NULL AND (p_size & 512) <> 0)) AND b AND (f & 1034) = 0 THEN f | 8796093022208 ELSE f END AS BIGINT) AS method_flags FROM (
  SELECT *, CASE WHEN i AND (m & 7) = 0 THEN m | 1 ELSE m END AS f FROM (
    SELECT *, CAST(p_size & ~128 AS BIGINT) | CASE WHEN p_partkey % 3 = 0 THEN 17179869184 ELSE 0 END AS m, p_partkey % 2 = 0 AS b, coalesce(k IN ('INTERFACE', 'ANNOTATION'), false) AS i FROM (SELECT *, {KIND} AS k FROM part)))""")
def method_flags(spark, sf_dir):
    out = flags.method_flags("p_size", F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 2 == 0, _kind(), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("method_flags"))


@query("""
SELECT p_type, p_name, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_size, p_partkey) AS n FROM part WHERE starts_with(p_name, 'small')) WHERE n = 1""")
def completion_members(spark, sf_dir):
    return complete.in_scope(table(spark, sf_dir, "part"), "small", kind="p_type", name="p_name", key="p_name", depth="p_size", ties=("p_partkey",)).select("p_type", "p_name", "p_partkey")


@query(r"""
SELECT doc_id, p AS prefix, ends_with(rtrim(substr(h, 1, length(h) - length(p))), '.') AS qualified FROM (SELECT *, regexp_extract(h, '([A-Za-z_$][\w$]*)$', 1) AS p FROM (SELECT doc_id, substr(text, 1, """ + OFFSET + """) AS h FROM documents))""")
def completion_prefix(spark, sf_dir):
    at = complete.prefix_at("text", _offset())
    return table(spark, sf_dir, "documents").select("doc_id", at["prefix"].alias("prefix"), at["qualified"].alias("qualified"))


@query("""
SELECT doc_id, CAST(coalesce(max(CASE WHEN starts_with(x, 'The ') THEN line END), 0) AS INTEGER) AS insert_line FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) GROUP BY doc_id""")
def import_insertion(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    lines = rows.withColumn("line_text", F.when(F.startswith("x", F.lit("The ")), "import a;").otherwise("x;"))
    return complete.import_line(lines, ["doc_id"])


@query("""
SELECT p_name AS jvm_name, source_uri, resource_path, NOT (starts_with(p_name, 'java/lang/') OR p_name = 'blue bolt') AS needs_import FROM (
  SELECT p_name, arg_min(p_brand, {'b': p_brand, 'k': lpad(CAST(p_partkey AS VARCHAR), 12, '0')}) AS source_uri, arg_min(lpad(CAST(p_partkey AS VARCHAR), 12, '0'), {'b': p_brand, 'k': lpad(CAST(p_partkey AS VARCHAR), 12, '0')}) AS resource_path
  FROM part WHERE starts_with(p_name, 'blue') AND starts_with(p_brand, 'Brand#1') GROUP BY p_name) ORDER BY 1 LIMIT 50""")
def completion_unimported(spark, sf_dir):
    types = table(spark, sf_dir, "part").select(F.col("p_name").alias("jvm_name"), F.col("p_brand").alias("source_uri"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("resource_path"))
    return complete.unimported_types(types, "blue", ["Brand#1"], "none", ["blue bolt"], [])


SYNTH = f"""
WITH t AS (SELECT p_name || '/' || p_partkey AS jvm_name, {KIND} AS k, p_size AS m, p_partkey FROM part WHERE p_type <> 'STANDARD'),
has AS (SELECT jvm_name AS owner, CASE WHEN k = 'ENUM' THEN 'values' ELSE '<init>' END AS name, '()V' AS descriptor FROM t WHERE p_partkey % 3 = 0)
"""


@query(SYNTH + """
SELECT jvm_name AS owner, 'method' AS kind, n AS name, replace(d, 'X', jvm_name) AS descriptor, CAST(9 AS BIGINT) AS modifiers FROM t, (VALUES ('values', '()[LX;'), ('valueOf', '(Ljava/lang/String;)LX;')) v(n, d) WHERE k = 'ENUM' AND NOT EXISTS (SELECT 1 FROM has WHERE owner = jvm_name AND name = n)
UNION ALL SELECT jvm_name, 'method', '<init>', '()V', CAST(m & 7 AS BIGINT) FROM t WHERE k = 'CLASS' AND jvm_name NOT IN (SELECT owner FROM has WHERE name = '<init>')
UNION ALL SELECT jvm_name, 'method', '<init>', '(IJ)V', CAST(m & 7 AS BIGINT) FROM t WHERE k = 'RECORD'
UNION ALL SELECT jvm_name, 'method', n, d, CAST(1 AS BIGINT) FROM t, (VALUES ('x', '()I'), ('y', '()J')) v(n, d) WHERE k = 'RECORD'""")
def synth_members(spark, sf_dir):
    kind = _kind()
    p = table(spark, sf_dir, "part").where("p_type <> 'STANDARD'")
    components = F.array(F.struct(F.lit("x").alias("name"), F.lit("I").alias("sig")), F.struct(F.lit("y").alias("name"), F.lit("J").alias("sig")))
    types = p.select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("jvm_name"), kind.alias("decl_kind"), F.col("p_size").alias("modifiers"), F.when(kind == "RECORD", components).alias("record_components"), "p_partkey")
    members = types.where("p_partkey % 3 = 0").select(F.col("jvm_name").alias("owner"), F.lit("method").alias("kind"), F.when(F.col("decl_kind") == "ENUM", "values").otherwise("<init>").alias("name"), F.lit("()V").alias("descriptor"))
    return synth.synthesized(types, members)


@query("""
SELECT r.r_name AS owner, CAST(i - 1 AS INTEGER) AS index, nested, n.n_name IS NULL AS is_missing FROM region r, (VALUES (1, 'NATION_1'), (2, 'NATION_999')) v(i, nested) LEFT JOIN nation n ON n.n_name = nested""")
def nested_types(spark, sf_dir):
    types = table(spark, sf_dir, "region").select(F.col("r_name").alias("jvm_name"), F.array(F.lit("NATION_1"), F.lit("NATION_999")).alias("inner_types"))
    winners = table(spark, sf_dir, "nation").select(F.col("n_name").alias("jvm_name"), F.lit(0).alias("modifiers"))
    return synth.nested_types(types, winners).select("owner", "index", "nested", "is_missing")


@query("SELECT n_name, NOT EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name < 'B') AS is_missing FROM nation")
def missing_types(spark, sf_dir):
    regions = table(spark, sf_dir, "region").where("r_name < 'B'").select(F.col("r_regionkey").cast("string").alias("jvm_name"))
    refs = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("type"))
    return synth.or_missing(refs, regions, "type").select("n_name", "is_missing")


@query("SELECT p_partkey, CAST(i - 1 AS INTEGER) AS index, coalesce(CASE WHEN p_size % 2 = 0 THEN n END, 'arg' || (i - 1)) AS parameter FROM (SELECT p_partkey, p_size, unnest(string_split(p_name, ' ')) AS n, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def parameter_names(spark, sf_dir):
    params = F.transform(F.split("p_name", " "), lambda n: F.struct(F.when(F.col("p_size") % 2 == 0, n).alias("name"), F.lit("I").alias("sig")))
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("owner"), F.lit("f").alias("name"), params.alias("params"))
    return synth.parameters(methods).select(F.col("owner").alias("p_partkey"), "index", "parameter")
