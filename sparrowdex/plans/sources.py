"""Queries over Java sources that are made of the tables: a class for each nation, and its base class for each region.

The sources go through the scan's parser, and the index, bindings, references and hierarchy are made of what it finds; the
SQL knows from the templates what that must be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import classpath, complete, hierarchy, resolve, stats, store, synth, xref
from ..sources import files
from .reference import query, table

ROOT = "file:///src/"
#: {k}, {r}: a nation and its region; {j}, {s}: the next nation and its region.
NATION = """package r{r};
import r{s}.N{j};
/** helper(0) is no use of it. */
public class N{k} extends Base{r} {
  private int size;
  public int grow(int by) {
    size = size + by;
    return helper(by);
  }
  N{k} twin(N{j} other) {
    other.grow(1);
    return this;
  }
}
"""
REGION = """package r{r};
public abstract class Base{r} {
  protected int helper(int x) {
    return x;
  }
  enum Kind { A, B }
  interface Shape<T> extends Comparable<T> { int LIMIT = 7; T area(String[] of, long... more); }
}
"""
JOINED = "(SELECT n.n_nationkey AS k, n.n_regionkey AS r, m.n_nationkey AS j, m.n_regionkey AS s FROM nation n JOIN nation m ON m.n_nationkey = (n.n_nationkey + 1) % (SELECT count(*) FROM nation))"
REGIONS = "(SELECT r_regionkey AS r FROM region)"


def _filled(template: str, **columns):
    """A template with columns in its braces."""
    parts, rest = [], template
    while "{" in rest:
        at = min(i for i in (rest.find("{" + c + "}") for c in columns) if i >= 0) if any("{" + c + "}" in rest for c in columns) else -1
        if at < 0:
            break
        parts += [F.lit(rest[:at]), columns[rest[at + 1]].cast("string")]
        rest = rest[at + 3 :]
    return F.concat(*parts, F.lit(rest))


def resources(spark, sf_dir) -> DataFrame:
    """(source_uri, resource_path, content, error) of all sources."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    count = n.agg(F.count("*").alias("c"))
    each = n.join(F.broadcast(count)).withColumn("j", (F.col("k") + 1) % F.col("c"))  # one row
    each = each.join(n.select(F.col("k").alias("j"), F.col("r").alias("s")), "j")
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"))
    cols = {c: F.col(c) for c in "kjrs"}
    made = each.select(F.concat(F.lit("r"), "r", F.lit("/N"), "k", F.lit(".java")).alias("resource_path"), _filled(NATION, **cols).alias("text"))
    made = made.union(r.select(F.concat(F.lit("r"), "r", F.lit("/Base"), "r", F.lit(".java")), _filled(REGION, r=F.col("r"))))
    return made.select(F.lit(ROOT).alias("source_uri"), "resource_path", F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))


def types(spark, sf_dir) -> DataFrame:
    return files.type_entries(files.parse(resources(spark, sf_dir)))


PATHS = f"""
WITH n AS {JOINED}, b AS {REGIONS}, declared AS (
  SELECT 'r' || r || '/N' || k AS jvm_name, 'r' || r || '/N' || k || '.java' AS resource_path, 'CLASS' AS decl_kind, 1 AS modifiers, 'UBase' || r || ';' AS super_sig, 'r' || r AS package_jvm, 'N' || k AS simple_name, false AS is_nested FROM n
  UNION ALL SELECT 'r' || r || '/Base' || r, 'r' || r || '/Base' || r || '.java', 'CLASS', 1025, NULL, 'r' || r, 'Base' || r, false FROM b
  UNION ALL SELECT 'r' || r || '/Base' || r || '$Kind', 'r' || r || '/Base' || r || '.java', 'ENUM', 0, NULL, 'r' || r, 'Kind', true FROM b
  UNION ALL SELECT 'r' || r || '/Base' || r || '$Shape', 'r' || r || '/Base' || r || '.java', 'INTERFACE', 0, NULL, 'r' || r, 'Shape', true FROM b
)"""


@query(PATHS + " SELECT * FROM declared")
def source_types(spark, sf_dir):
    """The type table of a scan."""
    return types(spark, sf_dir).select("jvm_name", "resource_path", "decl_kind", "modifiers", "super_sig", "package_jvm", "simple_name", "is_nested")


@query(PATHS + f""" SELECT '{ROOT}' || resource_path AS uri, resource_path AS stored, CAST(NULL AS VARCHAR) AS kept, resource_path AS effective FROM declared""")
def stored_paths(spark, sf_dir):
    """A type's path is not stored where its name says it."""
    t = types(spark, sf_dir)
    kept = names.stored_path("resource_path", "jvm_name", F.lit("source"))
    return t.select(files.source_uri("resource_uri").alias("uri"), F.col("resource_path").alias("stored"), kept.alias("kept"), names.effective_path(kept, "jvm_name", F.lit("source")).alias("effective"))


@query(PATHS + """
SELECT jvm_name AS owner, 'method' AS role, 'grow' AS name, 'I' AS params, 1 AS arity, false AS varargs FROM declared WHERE starts_with(simple_name, 'N') AND NOT is_nested
UNION ALL SELECT 'r' || r || '/N' || k, 'method', 'twin', 'LN' || j || ';', 1, false FROM n
UNION ALL SELECT jvm_name, 'method', 'helper', 'I', 1, false FROM declared WHERE modifiers = 1025
UNION ALL SELECT jvm_name, 'field', f, NULL, -1, false FROM declared, (VALUES ('A'), ('B')) v(f) WHERE decl_kind = 'ENUM'
UNION ALL SELECT jvm_name, 'field', 'LIMIT', NULL, -1, false FROM declared WHERE decl_kind = 'INTERFACE'
UNION ALL SELECT jvm_name, 'method', 'area', '[LString;,[J', 2, true FROM declared WHERE decl_kind = 'INTERFACE'""")
def source_members(spark, sf_dir):
    """Visible members with erased parameters; private ones are left out."""
    return xref.members_of(types(spark, sf_dir)).select("owner", "role", "name", F.array_join("params", ",").alias("params"), F.coalesce("arity", F.lit(-1)).alias("arity"), "varargs")


@query(PATHS + """
SELECT jvm_name AS owner, coalesce(super_sig, 'Ljava/lang/' || CASE decl_kind WHEN 'ENUM' THEN 'Enum' ELSE 'Object' END || ';') AS super_sig, CASE WHEN decl_kind = 'INTERFACE' THEN '<T:Ljava/lang/Object;>Ljava/lang/Object;UComparable<TT;>;' END AS class_signature, CASE WHEN decl_kind = 'INTERFACE' THEN '(' || '[UString;' || '[J' || ')TT;' END AS area_signature FROM declared""")
def source_signatures(spark, sf_dir):
    """Generic signatures of classes and methods."""
    from ..functions import descriptors

    t = synth.with_supers(types(spark, sf_dir).withColumn("named", F.col("super_sig")))
    area = F.get(F.filter("methods", lambda m: m["name"] == "area"), 0)
    return t.select(F.col("jvm_name").alias("owner"), "super_sig", descriptors.class_signature("type_params", "named", "interface_sigs").alias("class_signature"), F.when(area.isNotNull(), descriptors.method_signature(area["type_params"], area["params"], area["return_sig"], area["throws"])).alias("area_signature"))


@query(PATHS + """
SELECT resource_path, unnest(list_distinct(['r' || r, 'r' || s, 'N' || j, 'N' || k, 'Base' || r, 'size', 'grow', 'by', 'helper', 'twin', 'other'])) AS name FROM n JOIN declared d ON d.jvm_name = 'r' || r || '/N' || k
UNION ALL SELECT resource_path, unnest(['r' || r, 'Base' || r, 'helper', 'x', 'Kind', 'A', 'B', 'Shape', 'T', 'Comparable', 'LIMIT', 'area', 'String', 'of', 'more']) FROM b JOIN declared d ON d.jvm_name = 'r' || r || '/Base' || r""")
def source_identifiers(spark, sf_dir):
    """B1, B2: the identifiers of a file, without reserved words, comments and literals."""
    return files.resource_identifiers(files.parse(resources(spark, sf_dir))).select("resource_path", "name")


#: line, what stands before the name in it, name, whether it is a declaration, role, symbol
PLACES = """
, here AS (
  SELECT 'r' || r || '/N' || k || '.java' AS resource_path, p.line, length(p.head) AS col, p.name, p.declared AS is_declaration, p.role, p.symbol FROM n, LATERAL (VALUES
    (1, 'import r' || s || '.', 'N' || j, false, 'type', 'T:@|r' || s || '/N' || j),
    (3, 'public class ', 'N' || k, true, 'type', 'T:@|r' || r || '/N' || k), (3, 'public class N' || k || ' extends ', 'Base' || r, false, 'type', 'T:@|r' || r || '/Base' || r),
    (4, '  private int ', 'size', true, 'field', 'F:@|r' || r || '/N' || k || '#size'),
    (5, '  public int ', 'grow', true, 'method', 'M:@|r' || r || '/N' || k || '#grow(I)'), (5, '  public int grow(int ', 'by', false, 'local', NULL),
    (6, '    ', 'size', false, 'field', NULL), (6, '    size = ', 'size', false, 'field', NULL), (6, '    size = size + ', 'by', false, 'local', NULL),
    (7, '    return ', 'helper', false, 'method', 'M:@|r' || r || '/Base' || r || '#helper(I)'), (7, '    return helper(', 'by', false, 'local', NULL),
    (9, '  ', 'N' || k, false, 'type', 'T:@|r' || r || '/N' || k), (9, '  N' || k || ' ', 'twin', true, 'method', 'M:@|r' || r || '/N' || k || '#twin(LN' || j || ';)'),
    (9, '  N' || k || ' twin(', 'N' || j, false, 'type', 'T:@|r' || s || '/N' || j), (9, '  N' || k || ' twin(N' || j || ' ', 'other', false, 'local', NULL),
    (10, '    ', 'other', false, 'local', NULL), (10, '    other.', 'grow', false, 'method', 'M:@|r' || s || '/N' || j || '#grow(I)')
  ) p(line, head, name, declared, role, symbol)
)"""
SYMBOL = f"replace(symbol, '@', '{ROOT}')"


def _occurrences(spark, sf_dir) -> DataFrame:
    return files.occurrences(resources(spark, sf_dir).where(F.col("resource_path").rlike("/N[0-9]+[.]java$")))


@query(PATHS + PLACES + " SELECT resource_path, line, col, name, is_declaration, role FROM here")
def source_occurrences(spark, sf_dir):
    """The names of files with their places and roles."""
    return _occurrences(spark, sf_dir).select("resource_path", "line", "col", "name", "is_declaration", "role")


@query(PATHS + PLACES + f" SELECT resource_path, line, col, {SYMBOL} AS symbol_key FROM here WHERE symbol IS NOT NULL")
def symbol_bindings(spark, sf_dir):
    """What names mean; a private field is no row of the index and binds within its file only."""
    return xref.bound(_occurrences(spark, sf_dir), types(spark, sf_dir)).where("symbol_key is not null").select("resource_path", "line", "col", "symbol_key")


def _references(spark, sf_dir, key: str, name: str, declaration: bool) -> DataFrame:
    found = files.resource_identifiers(files.parse(resources(spark, sf_dir)))
    return xref.references(resources(spark, sf_dir), types(spark, sf_dir), found, key, name, files.occurrences, declaration).select("resource_path", "line", "col")


@query(PATHS + PLACES + f" SELECT resource_path, line, col FROM here WHERE symbol = 'M:@|r1/Base1#helper(I)' UNION ALL SELECT 'r1/Base1.java', 2, length('  protected int ') FROM b WHERE r = 1")
def references_of_a_method(spark, sf_dir):
    """Calls of an inherited method, and its declaration."""
    return _references(spark, sf_dir, f"M:{ROOT}|r1/Base1#helper(I)", "helper", True)


@query(PATHS + PLACES + " SELECT resource_path, line, col FROM here WHERE NOT is_declaration AND symbol = (SELECT 'T:@|r' || r || '/N' || k FROM n WHERE k = 3)")
def references_of_a_type(spark, sf_dir):
    """Uses of a type from other packages; those of its own file are left to the file."""
    region = table(spark, sf_dir, "nation").where("n_nationkey = 3").first().n_regionkey
    return _references(spark, sf_dir, f"T:{ROOT}|r{region}/N3", "N3", False)


@query(PATHS + PLACES + """
SELECT u.resource_path, u.line, u.col, d.resource_path AS to_path, d.line AS to_line, d.col AS to_col FROM here u JOIN here d ON u.symbol = d.symbol AND d.is_declaration WHERE NOT u.is_declaration""")
def definition_places(spark, sf_dir):
    """Where what a name means is declared, nested and inherited members among them."""
    found = xref.bound(_occurrences(spark, sf_dir), types(spark, sf_dir))
    return xref.definitions(found.where("not is_declaration"), found).select("resource_path", "line", "col", "to_path", "to_line", "to_col")


@query(PATHS + f" SELECT DISTINCT 'r' || r || '/Base' || r AS jvm_name, 'Base' || r AS name, 'r' || r AS detail, 'T:{ROOT}r' || r || '/Base' || r || '.java|r' || r || '/Base' || r AS key FROM n")
def prepared_hierarchy(spark, sf_dir):
    """The items of the types that stand after extends."""
    found = xref.bound(_occurrences(spark, sf_dir).where("line = 3 and not is_declaration"), types(spark, sf_dir))
    return xref.prepare_hierarchy(found, types(spark, sf_dir))


@query(PATHS + """
SELECT jvm_name AS sub_jvm, package_jvm || '/Base' || substr(package_jvm, 2) AS super_jvm FROM declared WHERE starts_with(simple_name, 'N') AND NOT is_nested
UNION ALL SELECT jvm_name, 'java/lang/' || CASE decl_kind WHEN 'ENUM' THEN 'Enum' ELSE 'Object' END FROM declared WHERE super_sig IS NULL
UNION ALL SELECT jvm_name, package_jvm || '/Comparable' FROM declared WHERE decl_kind = 'INTERFACE'""")
def source_supertypes(spark, sf_dir):
    """Supertypes by the cascade of a file; what no declaration is known of stays in its own package."""
    return xref.named_edges(types(spark, sf_dir)).select("sub_jvm", "super_jvm")


@query(PATHS + " SELECT jvm_name AS sub_jvm, super_jvm, permitted FROM (SELECT jvm_name, 'r1/Base1' AS super_jvm, jvm_name IN ('r1/N1', 'r1/N2') AS permitted FROM declared WHERE package_jvm = 'r1' AND starts_with(simple_name, 'N') AND NOT is_nested)")
def permitted_subtypes(spark, sf_dir):
    """Subtypes with those that are permitted first, of visible declarations only."""
    t = types(spark, sf_dir)
    permits = t.where("jvm_name in ('r1/N1', 'r1/N2')").select(F.lit("r1/Base1").alias("super_jvm"), F.col("jvm_name").alias("sub_jvm"), F.lit(0).alias("ord"))
    gone = permits.select("super_jvm", F.lit("r9/Gone").alias("sub_jvm"), F.lit(5).alias("ord")).distinct()
    return hierarchy.direct_subtypes(xref.named_edges(t), "r1/Base1", permits.union(gone), t).select("sub_jvm", "super_jvm", "permitted")


@query(PATHS + f" SELECT jvm_name, '{ROOT}' || resource_path AS resource_uri FROM declared WHERE jvm_name = 'r1/Base1'")
def entry_of_an_item(spark, sf_dir):
    """The declaration of a hierarchy item, of its own resource before others."""
    t = types(spark, sf_dir)
    other = t.withColumns({"source_uri": F.lit("file:///first/"), "resource_uri": F.lit("file:///first/x.java")})
    return hierarchy.entry_for(t.union(other), "r1/Base1", f"{ROOT}r1/Base1.java", ["file:///first/", ROOT]).select("jvm_name", "resource_uri")


@query(PATHS + " SELECT resource_path, count(*) AS names FROM declared GROUP BY resource_path HAVING count(*) > 1")
def resource_filter(spark, sf_dir):
    """Declarations of some resources, by a table of them."""
    t = types(spark, sf_dir)
    return store.filtered(t, t.where("decl_kind = 'ENUM'")).groupBy("resource_path").agg(F.count("*").alias("names"))


@query(PATHS + " SELECT jvm_name, resource_path FROM declared WHERE package_jvm = 'r2' AND NOT is_nested")
def package_types(spark, sf_dir):
    """The types of a package on a search path."""
    t = types(spark, sf_dir)
    return classpath.list_types(t.where("not is_nested"), "r2", [ROOT], ["resource_path"]).select("jvm_name", "resource_path")


@query(PATHS + " SELECT jvm_name, resource_path FROM declared WHERE jvm_name = 'r1/Base1'")
def type_by_name(spark, sf_dir):
    """What a dotted class name means."""
    return classpath.find_type(types(spark, sf_dir), "r1.Base1", [ROOT], ["resource_path"]).select("jvm_name", "resource_path")


@query("SELECT 0 AS failures, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS files, (SELECT count(*) FROM nation) + 3 * (SELECT count(*) FROM region) AS types")
def scan_summary(spark, sf_dir):
    """What a scan reports."""
    parsed = files.parse(resources(spark, sf_dir))
    return parsed.agg(F.count_if(F.col("error").isNotNull()).alias("failures"), F.count("*").alias("files"), F.sum(F.size("types")).alias("types"))


@query("SELECT 'r' || r_regionkey || '/Broken.java' AS resource_path, 'members that do not parse: 1' AS error, 1 AS methods FROM region")
def scan_failures(spark, sf_dir):
    """A member that does not parse is told of, and the others are there."""
    r = table(spark, sf_dir, "region")
    text = "class Broken { int good() { return 1; } 5 bad; }"
    made = r.select(F.lit(ROOT).alias("source_uri"), F.concat(F.lit("r"), "r_regionkey", F.lit("/Broken.java")).alias("resource_path"), F.lit(text).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    parsed = files.parse(made)
    rows = files.type_entries(parsed).select("resource_path", F.size("methods").alias("methods"))
    return files.failures(parsed).join(rows, "resource_path").select("resource_path", "error", "methods")


@query("SELECT CAST(octet_length(encode(t)) AS BIGINT) AS bytes FROM (SELECT 'package r1;' || chr(10) || 'public abstract class Base1 {' || chr(10) AS t)")
def resource_text(spark, sf_dir):
    """The text of a resource, here the length of its first two lines."""
    text = files.read_text(resources(spark, sf_dir), f"{ROOT}r1/Base1.java")
    return text.select(F.octet_length(F.concat(F.substring_index("text", "\n", 2), F.lit("\n"))).cast("long").alias("bytes"))


@query(PATHS + " SELECT jvm_name AS owner, 'A,B' AS shown FROM declared WHERE decl_kind = 'ENUM'")
def static_members(spark, sf_dir):
    """K2: members after a type's name and a dot."""
    t = types(spark, sf_dir).where("decl_kind = 'ENUM'")
    members = t.select(F.col("jvm_name").alias("owner"), F.explode("fields").alias("f")).select("owner", "f.name", "f.modifiers", F.lit("field").alias("kind"))
    found = [complete.qualified_members(members, f"r{k}/Base{k}$Kind", "", static=True) for k in range(5)]
    return store.add_all(*found).groupBy("owner").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("shown"))


@query(PATHS + " SELECT 'package' AS kind, 'r' || r AS name FROM b UNION ALL SELECT 'type', simple_name FROM declared WHERE package_jvm = 'r1' AND NOT is_nested AND starts_with(simple_name, 'N')")
def package_completion(spark, sf_dir):
    """K2: packages below the root, and the types of one."""
    t = types(spark, sf_dir)
    packages = store.known_packages(t)
    top = complete.package_members(t.limit(0), packages, "", "r").select("kind", "name")
    return top.union(complete.package_members(t, packages, "r1", "N").select("kind", "name"))


@query(PATHS + """
SELECT kind, name FROM (
  SELECT DISTINCT 'type' AS kind, simple_name AS name, 0 AS o FROM declared WHERE NOT is_nested AND starts_with(simple_name, 'N') UNION ALL
  SELECT * FROM (VALUES ('method', 'Never', 2)) WHERE false
) ORDER BY o, name LIMIT 12""")
def batch_completions(spark, sf_dir):
    """K7, K8, T5: types by prefix, then members, the first of them."""
    t = types(spark, sf_dir)
    members = xref.members_of(t).select(F.col("role").alias("kind"), "name")
    return complete.batch_completion(t, members, "N", [ROOT], limit=12)


@query(PATHS + " SELECT jvm_name, '1_' || simple_name AS sort_text FROM declared WHERE package_jvm <> 'r1' UNION ALL SELECT jvm_name, '0_' || simple_name FROM declared WHERE package_jvm = 'r1'")
def completion_order(spark, sf_dir):
    """K7: what is in scope sorts before what has to be imported."""
    return types(spark, sf_dir).select("jvm_name", complete.sort_text("simple_name", F.col("package_jvm") == "r1").alias("sort_text"))


@query(PATHS + " SELECT jvm_name AS owner, 0 AS index, 'T' AS parameter, false AS all_interfaces FROM declared WHERE decl_kind = 'INTERFACE'")
def parameter_bounds(spark, sf_dir):
    """Whether the bounds of type parameters are interfaces."""
    t = types(spark, sf_dir)
    return synth.type_parameter_bounds(t, t.select("jvm_name", "modifiers"))


@query(PATHS + " SELECT jvm_name, simple_name AS written, CASE WHEN is_nested THEN list_first(string_split(jvm_name, '$')) END AS owner FROM declared")
def enclosing_types(spark, sf_dir):
    """The type around a type."""
    return types(spark, sf_dir).select("jvm_name", names.simple_name("jvm_name").alias("written"), names.owner_of("jvm_name").alias("owner"))


@query(PATHS + " SELECT package_jvm, count(*) AS count FROM declared GROUP BY 1")
def written_and_read(spark, sf_dir):
    """A table that was saved, and read again; declaration files without a type are left out."""
    import uuid

    from ..operators.rounds import scratch

    path = f"{scratch(spark)}/index-{uuid.uuid4().hex[:12]}"
    t = types(spark, sf_dir)
    extra = t.limit(1).withColumn("jvm_name", F.lit("r1/package-info"))
    store.save(store.add(t, extra), path, buckets=4)
    return store.load(spark, path).groupBy("package_jvm").agg(F.count("*").alias("count"))


@query(PATHS + " SELECT package_jvm, count(*) AS count, CAST(sum(CASE decl_kind WHEN 'ENUM' THEN 2 ELSE 1 END) AS BIGINT) AS weight FROM declared GROUP BY 1 ORDER BY weight DESC, package_jvm LIMIT 3")
def retained_sizes(spark, sf_dir):
    """Groups by what their rows take; here enums weigh two."""
    t = types(spark, sf_dir)
    out = stats.top_by_bytes(t, "package_jvm", F.when(F.col("decl_kind") == "ENUM", 2).otherwise(1), 3)
    return out.select("package_jvm", "count", F.col("bytes").alias("weight"))


@query("SELECT 'r' || r_regionkey AS package_jvm, true AS known, false AS other FROM region")
def known_package_names(spark, sf_dir):
    """Whether a package or a type is there."""
    t = types(spark, sf_dir)
    r = table(spark, sf_dir, "region")
    found = store.known_packages(t).withColumn("known", F.lit(True))
    return r.select(F.concat(F.lit("r"), "r_regionkey").alias("package_jvm")).join(found, "package_jvm", "left").select("package_jvm", F.coalesce("known", F.lit(False)).alias("known"), F.lit(store.has_package(t, "r99") or store.contains(t, "r1/Nobody") or store.is_empty(t)).alias("other"))


CASCADES = {
    "hierarchy": (resolve.HIERARCHY, "ORDER"),
    "compiler": (resolve.COMPILER, ""),
    "qualify_compiler": (resolve.QUALIFY_COMPILER, ""),
    "super_compiler": (resolve.SUPER_COMPILER, ""),
    "super_batch": (resolve.SUPER_BATCH, ""),
}


def _cascade_sql(cascade: tuple) -> str:
    """What a cascade says, over the words of part names: the first word is the package, the second the name."""
    steps, checked, fallback = cascade
    made = {"member": ("'m/Outer$' || simple", "simple = 'gear'"), "sibling": ("source_package || '/' || simple", "simple = 'bolt'"), "single": ("'blue/' || simple", "simple = 'ring'"), "package": ("source_package || '/' || simple", "true"), "java_lang": ("'java/lang/' || simple", "true")}
    rows = []
    for k, step in enumerate(steps):
        for name, applies in [("'small/' || simple", "true"), ("'red/' || simple", "true")] if step == "on_demand" else [made[step]]:
            rows.append(f"SELECT simple, source_package, {10 * k + len(rows) % 10} AS ord, {name} AS name FROM refs WHERE {applies}" + (f" AND {name} IN (SELECT jvm_name FROM avail)" if step in checked else ""))
    last = {"package": "r.source_package || '/' || r.simple", "java_lang": "'java/lang/' || r.simple", "self": "r.simple", None: "NULL"}[fallback]
    return f"""
WITH avail AS (SELECT DISTINCT replace(p_name, ' ', '/') AS jvm_name FROM part WHERE p_size % 2 = 0),
refs AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS simple, string_split(p_name, ' ')[1] AS source_package FROM part),
cand AS ({" UNION ALL ".join(rows)}),
best AS (SELECT simple, source_package, arg_min(name, ord) AS name FROM cand GROUP BY 1, 2)
SELECT r.simple, r.source_package, coalesce(b.name, {last}) AS resolved FROM refs r LEFT JOIN best b ON b.simple = r.simple AND b.source_package = r.source_package"""


def _cascade(cascade: tuple):
    def run(spark, sf_dir):
        parts = table(spark, sf_dir, "part")
        words = F.split("p_name", " ")
        available = parts.where("p_size % 2 = 0").select(F.translate("p_name", " ", "/").alias("jvm_name"))
        refs = parts.select(F.get(words, 1).alias("simple"), F.get(words, 0).alias("source_package")).distinct()
        s = F.col("simple")
        hints = {"siblings": F.array(F.lit("bolt")), "single_imports": F.when(s == "ring", F.create_map(F.lit("ring"), F.lit("blue/ring"))), "on_demand": F.array(F.lit("small"), F.lit("red")), "members": F.array(F.lit("m/Outer$gear"))}
        return resolve.resolve(refs.withColumns(hints), available, cascade, members="members").select("simple", "source_package", "resolved")

    return run


for _name, (_steps, _) in CASCADES.items():
    _run = _cascade(_steps)
    _run.__name__ = f"cascade_{_name}"
    _run.__doc__ = "N1 to N8: one of the cascades, with members, siblings, imports and packages."
    query(_cascade_sql(_steps))(_run)


@query("""
SELECT DISTINCT p_name AS name, 'own/' || replace(p_name, ' ', '$') AS resolved FROM part WHERE string_split(p_name, ' ')[1] <> 'red'
UNION ALL SELECT DISTINCT p_name, 'lib/' || replace(p_name, ' ', '$') FROM part WHERE string_split(p_name, ' ')[1] = 'red'""")
def qualified_names(spark, sf_dir):
    """The outermost segment of a nested name is resolved, the rest is kept."""
    refs = table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.translate("p_name", " ", "$").alias("name"))
    none = F.lit(None)
    hints = {"source_package": F.lit("own"), "siblings": none.cast("array<string>"), "single_imports": none.cast("map<string,string>"), "on_demand": F.array(F.lit("lib"))}
    available = refs.sparkSession.createDataFrame([("lib/red",)], "jvm_name string")
    return resolve.qualify(refs.withColumns(hints), available).select(F.col("p_name").alias("name"), "resolved")


@query("""
WITH RECURSIVE up(sub, super) AS (SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n' || r_regionkey FROM region),
walk(type, place, steps) AS (SELECT 's' || s_suppkey, 's' || s_suppkey, 0 FROM supplier UNION ALL SELECT w.type, u.super, w.steps + 1 FROM walk w JOIN up u ON w.place = u.sub WHERE w.steps < 6),
member(name) AS (SELECT 'n' || n_nationkey || '$X' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'r' || r_regionkey || '$X' FROM region),
hits AS (SELECT type, place || '$X' AS name, min(steps) AS steps FROM walk WHERE place || '$X' IN (SELECT name FROM member) GROUP BY 1, 2)
SELECT 's' || s_suppkey AS type, (SELECT arg_min(name, {'s': steps, 'n': name}) FROM hits h WHERE h.type = 's' || s_suppkey) AS resolved FROM supplier""")
def member_scope(spark, sf_dir):
    """The nearest supertype that has a member type of a name; a cycle of regions and nations ends."""
    tag = lambda t, a, k, b, p: table(spark, sf_dir, t).select(F.concat(F.lit(a), k).alias("sub"), F.concat(F.lit(b), p).alias("super"))
    edges = store.add_all(tag("supplier", "s", "s_suppkey", "n", "s_nationkey"), tag("nation", "n", "n_nationkey", "r", "n_regionkey"), tag("region", "r", "r_regionkey", "n", "r_regionkey"))
    has = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey", F.lit("$X")).alias("jvm_name")).union(table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey", F.lit("$X"))))
    refs = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("type"), F.lit("X").alias("simple"))
    return resolve.member_in_scope(refs, has, edges).select("type", "resolved")
