"""Cross references: candidates, exact verification, positions, definitions, diagnostics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.descriptors import erase
from . import hierarchy, resolve, stats

IDENTIFIER = "[A-Za-z_$][A-Za-z0-9_$]*"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def identifiers(texts: DataFrame, keys: list[str], text: str = "text", pattern: str = IDENTIFIER) -> DataFrame:
    """(keys, name): the distinct identifiers of each text; distinct within the row before anything is exchanged."""
    return texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("name"))


def candidates(resource_identifier: DataFrame, name: str, suffix: str | None = ".java", path: str = "resource_path") -> DataFrame:
    """Resources that mention a name, restricted to a suffix of their path."""
    found = resource_identifier.where(F.col("name") == name)
    found = found.where(F.endswith(F.col(path), F.lit(suffix))) if suffix else found
    return found.drop("name").distinct()


def mentioning(texts: DataFrame, keys: list[str], name: str, text: str = "text", pattern: str = IDENTIFIER) -> DataFrame:
    """(keys) of the texts that have a name among their identifiers; those without its letters are not cut up."""
    named = F.array_contains(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.lit(name))
    return texts.where(F.contains(F.col(text), F.lit(name)) & named).select(*keys).distinct()


def capped(hits: DataFrame, pinned: DataFrame, key: str, cap: int) -> DataFrame:
    """(key, is_pinned): the pinned ones, then hits in their order until there are `cap`; cap <= 0: all.

    Only the first `cap` of the hits are wanted, so a sorted limit takes them: each task keeps its own first ones.
    """
    always = pinned.select(F.col(key)).distinct().withColumn("is_pinned", F.lit(True))
    rest = hits.select(F.col(key)).distinct().join(always.select(key), key, "left_anti").withColumn("is_pinned", F.lit(False))
    if cap > 0:
        rest = rest.orderBy(key).limit(max(0, cap - always.count()))
    return always.unionByName(rest)


def verified(candidates_: DataFrame, occurrences: DataFrame, key: str | list[str], symbol: str | Column, include_declarations: bool) -> DataFrame:
    """Occurrences of a symbol in candidate resources, each place once."""
    keys = [key] if isinstance(key, str) else key
    found = occurrences.join(candidates_.select(*keys).distinct(), keys, "left_semi").where(F.col("symbol_key") == symbol)
    return (found if include_declarations else found.where(~F.col("is_declaration"))).distinct()


def finalize(references: DataFrame, declaration: DataFrame, place: list[str], include: bool) -> DataFrame:
    """References with the declaration's place, or without it."""
    if include:
        return references.select(*place).union(declaration.select(*place)).distinct()
    return references.select(*place).distinct().join(declaration.select(*place), place, "left_anti")


def _places(cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, line, col, start_off, end_off) from rows (keys, i, name, gap): the i-th name and the text before it.

    Only numbers go through the exchange: the length of a gap, its line breaks, and what follows the last of them.
    """
    gap = F.col("gap")
    rows = cut.select(*keys, "i", "name", F.length("name").alias("size"), F.length(gap).alias("before"), (F.length(gap) - F.length(F.replace(gap, F.lit("\n"), F.lit("")))).alias("breaks"), F.length(F.substring_index(gap, "\n", -1)).alias("after"))
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end_off", F.sum(F.col("before") + F.col("size")).over(w)).withColumn("line", F.sum("breaks").over(w)).withColumn("start_off", F.col("end_off") - F.col("size"))
    ends = ends.withColumn("line_start", F.coalesce(F.last(F.when(F.col("breaks") > 0, F.col("start_off") - F.col("after")), True).over(w), F.lit(0)))
    return ends.select(*keys, "name", F.col("line").cast("int").alias("line"), (F.col("start_off") - F.col("line_start")).cast("int").alias("col"), F.col("start_off").cast("int").alias("start_off"), F.col("end_off").cast("int").alias("end_off"))


def token_positions(texts: DataFrame, keys: list[str], text: str = "text", pattern: str = IDENTIFIER) -> DataFrame:
    """(keys, name, line, col, start_off, end_off) of each identifier, lines and columns from 0; keys tell texts apart.

    The text is cut at its identifiers once: the k-th gap and the k-th identifier give the offsets by running sums, so
    the work is in proportion to the text.
    """
    named = texts.select(*keys, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("__n"), F.split(F.col(text), pattern).alias("__g"))
    zipped = named.select(*keys, F.posexplode(F.arrays_zip(F.col("__n").alias("n"), F.slice("__g", F.lit(1), F.size("__n")).alias("g"))).alias("i", "z"))
    return _places(zipped.select(*keys, "i", F.col("z.n").alias("name"), F.col("z.g").alias("gap")), keys)


def name_positions(texts: DataFrame, keys: list[str], name: str, text: str = "text", letters: str = "A-Za-z_$") -> DataFrame:
    """The rows of token_positions of one ASCII name: texts without it are passed over, the others are cut at it alone,
    and its offsets are summed up within the row.

    A name does not stand inside a longer one; digits right before it are no part of it. letters: what a name can begin
    with, as a regular expression's range.
    """
    pattern = f"(?<![{letters}0-9])[0-9]*{re.escape(name)}(?![{letters}0-9])"
    held = texts.where(F.contains(F.col(text), F.lit(name)))
    cut = held.select(*keys, F.split(F.col(text), pattern).alias("__g"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("__m")).where(F.size("__m") > 0)
    zipped = F.arrays_zip(F.slice("__g", F.lit(1), F.size("__m")).alias("g"), F.col("__m").alias("m"))
    place = "struct<line:int,col:int,start_off:int,end_off:int>"
    start = F.struct(F.lit(0).alias("off"), F.lit(0).alias("line"), F.lit(0).alias("begin"), F.array().cast(f"array<{place}>").alias("out"))

    def step(at: Column, x: Column) -> Column:
        begin = at["off"] + F.length(x["g"])
        line = at["line"] + F.length(x["g"]) - F.length(F.replace(x["g"], F.lit("\n"), F.lit("")))
        first = F.when(F.contains(x["g"], F.lit("\n")), begin - F.length(F.substring_index(x["g"], "\n", -1))).otherwise(at["begin"])
        end = begin + F.length(x["m"])
        own = F.struct(line.alias("line"), (end - len(name) - first).alias("col"), (end - len(name)).alias("start_off"), end.alias("end_off"))
        return F.struct(end.alias("off"), line.alias("line"), first.alias("begin"), F.concat(at["out"], F.array(own.cast(place))).alias("out"))

    return cut.select(*keys, F.explode(F.aggregate(zipped, start, step)["out"]).alias("p")).select(*keys, F.lit(name).alias("name"), "p.*")


def token_at(text: Column | str, offset: Column | str, letters: str = "A-Za-z_$") -> Column:
    """(name, start_off, end_off) of the identifier around an offset, null for none: the text is cut there, and only the run
    of letters and digits around is looked at."""
    t, at = _col(text), _col(offset)
    # \z, as $ also holds before a line's end; no run is begun in its middle
    left = F.regexp_extract(F.substr(t, F.lit(1), at), rf"(?<![{letters}0-9])[{letters}0-9]*+\z", 0)
    run = F.concat(left, F.regexp_extract(F.substr(t, at + 1), f"^[{letters}0-9]*", 0))
    digits = F.length(F.regexp_extract(run, "^[0-9]*", 0))
    start = at - F.length(left) + digits
    end = at - F.length(left) + F.length(run)
    return F.when((start <= at) & (at < end), F.struct(F.substr(run, digits + 1).alias("name"), start.cast("int").alias("start_off"), end.cast("int").alias("end_off")))


def line_starts(texts: DataFrame, keys: list[str], text: str = "text", count_cr: bool = True) -> DataFrame:
    """(keys, line, line_start, line_text): offsets at which lines begin. count_cr=False: carriage returns do not count
    in columns, so they are left out of the lines' texts (offsets still count them)."""
    lines = F.split(F.col(text), "\n")
    starts = F.transform(lines, lambda x, i: F.struct(F.aggregate(F.slice(lines, 1, i), F.lit(0), lambda a, y: a + F.length(y) + 1).alias("line_start"), (x if count_cr else F.replace(x, F.lit("\r"), F.lit(""))).alias("line_text")))
    rows = texts.select(*keys, F.posexplode(lines).alias("line", "x"))
    if count_cr:
        w = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*keys, "line", F.coalesce(F.sum(F.length("x") + 1).over(w), F.lit(0)).alias("line_start"), F.col("x").alias("line_text"))
    return texts.select(*keys, F.posexplode(starts).alias("line", "s")).select(*keys, "line", "s.line_start", "s.line_text")


def position_at(text: Column | str, offset: Column | str, count_cr: bool = True) -> Column:
    """(line, col) of an offset, both from 0."""
    head = F.substr(_col(text), F.lit(1), _col(offset))
    last = F.substring_index(head, "\n", -1)
    return F.struct((F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).alias("line"), F.length(last if count_cr else F.replace(last, F.lit("\r"), F.lit(""))).alias("col"))


def offset_at(text: Column | str, line: Column | str, col: Column | str) -> Column:
    """The offset of a position: the lengths of the lines before it, and the column, within its line."""
    lines = F.split(_col(text), "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), _col(line)), F.lit(0), lambda a, y: a + F.length(y) + 1)
    here = F.coalesce(F.length(F.try_element_at(lines, _col(line) + 1)), F.lit(0))
    return before + F.least(_col(col), here)


#: Characters of a text that an occurrence is looked up by.
BUCKET = 256


def occurrence_at(queries: DataFrame, occurrences: DataFrame, key: str, inclusive_end: bool = False) -> DataFrame:
    """Queries (key, offset) with the smallest occurrence around the offset, then the first.

    An equi-join on the resource and the bucket of BUCKET characters, with the interval as a condition, so a long text's
    occurrences do not all meet all offsets asked in it.
    """
    first, last = F.floor(F.col("start_off") / BUCKET), F.floor(F.col("end_off") / BUCKET)
    o = occurrences.withColumn("__b", F.explode(F.sequence(first, last))).alias("o")
    q = queries.withColumn("__b", F.floor(F.col("offset") / BUCKET)).alias("q")
    inside = (F.col("o.start_off") <= F.col("q.offset")) & ((F.col("q.offset") <= F.col("o.end_off")) if inclusive_end else (F.col("q.offset") < F.col("o.end_off")))
    found = q.join(o, (F.col(f"q.{key}") == F.col(f"o.{key}")) & (F.col("q.__b") == F.col("o.__b")) & inside)
    return found.groupBy(f"q.{key}", "q.offset").agg(F.min_by(F.struct("o.name", "o.start_off", "o.end_off"), F.struct(F.col("o.end_off") - F.col("o.start_off"), F.col("o.start_off"), F.col("o.name"))).alias("hit")).select(key, "offset", "hit.name", "hit.start_off", "hit.end_off")


def symbol_key(kind: Column | str, origin: Column | str, owner: Column | str, name: Column | str, params: Column | str) -> Column:
    """T:origin|binary, M:origin|owner#name(erased,parameters), F:origin|owner#name; null for file-local symbols."""
    k, head = _col(kind), F.concat(F.coalesce(_col(origin), F.lit("")), F.lit("|"))
    member = F.concat(head, _col(owner), F.lit("#"), _col(name))
    method = F.concat(F.lit("M:"), member, F.lit("("), F.array_join(_col(params), ","), F.lit(")"))
    return F.when(k == "type", F.concat(F.lit("T:"), head, _col(owner))).when(k == "method", method).when(k == "field", F.concat(F.lit("F:"), member))


def search_name(kind: Column | str, owner: Column | str, name: Column | str) -> Column:
    """What a text that uses a symbol must mention: constructors go by the simple name of their class."""
    simple = F.regexp_extract(_col(owner), "([^/$]*)$", 1)
    return F.when((_col(kind) == "type") | (_col(name) == "<init>"), simple).otherwise(_col(name))


def members_of(types: DataFrame) -> DataFrame:
    """(owner, role, name, params, arity, varargs, source_uri) of the fields and methods of a type table, as symbols: the
    parameters are erased."""
    fields = types.select(F.col("jvm_name").alias("owner"), "source_uri", F.explode("fields").alias("x"))
    methods = types.select(F.col("jvm_name").alias("owner"), "source_uri", F.explode("methods").alias("x"))
    none = F.lit(None).cast("array<string>")
    params = F.transform("x.params", lambda q: erase(q["sig"]))
    return fields.select("owner", F.lit("field").alias("role"), "x.name", none.alias("params"), F.lit(None).cast("int").alias("arity"), F.lit(False).alias("varargs"), "source_uri").unionByName(
        methods.select("owner", F.lit("method").alias("role"), "x.name", params.alias("params"), F.size("x.params").alias("arity"), "x.varargs", "source_uri")
    )


def named_edges(types: DataFrame) -> DataFrame:
    """super_edges of a type table with sources in it: names that a file leaves open go through the cascade of that file."""
    edges = hierarchy.super_edges(types)
    sigs = F.concat(F.array("super_sig"), F.coalesce("interface_sigs", F.array().cast("array<string>")))
    each = types.select(F.col("jvm_name").alias("sub_jvm"), "hints.*", F.explode(sigs).alias("sig")).where(F.startswith("sig", F.lit("U")))
    refs = each.withColumn("super_jvm", hierarchy.erased("sig"))
    told = resolve.qualify(refs, types.select("jvm_name"), "super_jvm", resolve.HIERARCHY).select("sub_jvm", "super_jvm", "resolved").distinct()
    return edges.join(told, ["sub_jvm", "super_jvm"], "left").withColumn("super_jvm", F.coalesce("resolved", "super_jvm")).drop("resolved")


def bound(occurrences: DataFrame, types: DataFrame) -> DataFrame:
    """Occurrences (of `files.occurrences`) with `symbol_owner`, `symbol_params` and `symbol_key`, null where the sources do
    not tell what a name means. types: the declarations that are visible, one a name.

    A type's name goes through the cascade of its file. A member is looked for in the type of its receiver or, without
    one, in the types around it from the inside out, each with its supertypes, nearest first; a method by its number of
    arguments, of several with as many the first by its parameters. Locals have no key.
    """
    rows = occurrences.withColumn("__id", F.xxhash64("source_uri", "resource_path", "start_off", "end_off"))
    known = types.select("jvm_name")
    simple = F.when(F.col("role") == "type", F.col("name")).when(~F.col("receiver").isin("this", "super", "?"), F.col("receiver"))
    named = rows.withColumn("__asked", F.when(~F.col("is_declaration"), simple))
    # types around a name are named without their owner
    around = resolve.scopes(rows.where("scope is not null").select("scope").distinct(), "scope").where("depth >= 0").groupBy("type").agg(F.sort_array(F.collect_list(F.struct("depth", F.col("scope").alias("at")))).alias("__s")).withColumnRenamed("type", "scope")
    held = named.join(around, "scope", "left").withColumn("__members", F.transform("__s", lambda s: F.concat(s["at"], F.lit("$"), F.col("__asked"))))
    inner = held.where("__asked is not null").select("__id", F.posexplode("__members").alias("__d", "jvm_name")).join(known, "jvm_name").groupBy("__id").agg(F.min_by("jvm_name", "__d").alias("__inner"))
    told = resolve.resolve(held.where("__asked is not null and owner is null"), known, resolve.COMPILER, simple="__asked").select("__id", "resolved").join(inner, "__id", "left").select("__id", F.coalesce("__inner", "resolved").alias("__type"))
    named = named.join(told, "__id", "left").withColumn("__type", F.when((F.col("role") == "type") & F.col("owner").isNotNull(), F.col("owner")).otherwise(F.col("__type")))
    edges = named_edges(types)
    # where a member is looked for: (type, distance)
    asked = named.where("role in ('method', 'field') and not is_declaration and owner is null")
    out_of = F.when(F.col("receiver").isNull() | (F.col("receiver") == "this") | (F.col("receiver") == "super"), F.col("scope")).otherwise(F.col("__type"))
    asked = asked.withColumn("__start", out_of).where("__start is not null")
    levels = resolve.scopes(asked.select("__start").distinct(), "__start").select(F.col("type").alias("__start"), F.col("scope").alias("start"), F.col("depth").alias("outward"))
    up = hierarchy.closure(edges, levels.select("start"))
    places = levels.select("__start", "outward", F.lit(0).alias("up"), F.col("start").alias("at")).unionByName(levels.join(up, "start").select("__start", "outward", F.col("depth").alias("up"), F.col("reached").alias("at")))
    found = asked.select("__id", "__start", "role", "name", F.col("arity").alias("given"), "receiver").join(places, "__start")
    found = found.where((F.col("outward") == 0) | F.col("receiver").isNull()).where((F.col("up") > 0) | ~F.coalesce(F.col("receiver") == "super", F.lit(False)))
    m = members_of(types)
    met = found.alias("f").join(m.alias("m"), (F.col("f.at") == F.col("m.owner")) & (F.col("f.role") == F.col("m.role")) & (F.col("f.name") == F.col("m.name")))
    fits = F.col("f.given").isNull() | (F.col("m.arity") == F.col("f.given")) | F.col("m.varargs") & (F.col("m.arity") <= F.col("f.given") + 1)
    best = met.where(fits).groupBy("__id").agg(F.min_by(F.struct("m.owner", "m.params"), F.struct("outward", "up", F.coalesce(F.col("m.arity") != F.col("f.given"), F.lit(False)), "m.params", "m.owner")).alias("__m"))
    erased = F.transform("params", lambda x: erase(x))
    out = named.join(best, "__id", "left")
    owner = F.when(F.col("role") == "type", F.col("__type")).when(F.col("role").isin("method", "field"), F.col("__m.owner"))
    out = out.withColumn("symbol_owner", F.when(F.col("is_declaration"), F.col("owner")).otherwise(owner)).withColumn("symbol_params", F.when(F.col("is_declaration"), erased).otherwise(F.col("__m.params")))
    origin = types.select(F.col("jvm_name").alias("symbol_owner"), F.col("source_uri").alias("symbol_origin"))
    out = out.join(origin, "symbol_owner", "left")
    # a constructor is named like its type
    symbol = F.when((F.col("role") == "method") & F.col("is_declaration") & (F.col("name") == names.simple_name("symbol_owner")), F.lit("<init>")).otherwise(F.col("name"))
    key = F.when(F.col("symbol_owner").isNotNull(), symbol_key("role", "symbol_origin", "symbol_owner", symbol, F.coalesce("symbol_params", F.array().cast("array<string>"))))
    return out.withColumn("symbol_key", key).drop("__id", "__asked", "__type", "__m", "symbol_origin")


def references(resources: DataFrame, types: DataFrame, resource_identifier: DataFrame, key: str, name: str, read, include_declaration: bool = False) -> DataFrame:
    """Places of a symbol in all sources that mention its name: only those are read again and bound.

    read: `files.occurrences`; name: `search_name` of the symbol."""
    mentioned = candidates(resource_identifier, name)
    found = bound(read(resources.join(mentioned, ["source_uri", "resource_path"], "left_semi")), types)
    found = found.select("source_uri", "resource_path", "line", "col", "start_off", "end_off", "is_declaration", "symbol_key")
    return verified(mentioned.select("source_uri", "resource_path"), found, ["source_uri", "resource_path"], key, include_declaration).select("source_uri", "resource_path", "line", "col", "start_off", "end_off")


def definitions(occurrence: DataFrame, declared: DataFrame) -> DataFrame:
    """Bound occurrences with the places of the declarations of their symbols. declared: bound occurrences of the resources
    that declare them."""
    place = declared.where("is_declaration").select("symbol_key", F.col("source_uri").alias("to_source"), F.col("resource_path").alias("to_path"), F.col("line").alias("to_line"), F.col("col").alias("to_col"), F.col("start_off").alias("to_start"))
    return occurrence.join(place.where("symbol_key is not null"), "symbol_key")


def prepare_hierarchy(occurrence: DataFrame, types: DataFrame) -> DataFrame:
    """(name, detail, key) of the type that a bound occurrence means: the type itself, or the owner of a member's name."""
    return hierarchy.items(types.join(occurrence.select(F.col("symbol_owner").alias("jvm_name")).distinct(), "jvm_name", "left_semi")).select("jvm_name", "name", "detail", "key")


def definition(members: DataFrame, owner: str, name: str, params: list[str]) -> DataFrame:
    """The member of that owner and name with as many parameters whose simple types are the wanted ones, else the first.

    members: (owner, name, params array of simple type names, ord, place columns)."""
    same = members.where((F.col("owner") == owner) & (F.col("name") == name) & (F.size("params") == len(params)))
    wanted = F.array(*map(F.lit, params)).cast("array<string>")
    return same.orderBy((F.col("params") == wanted).desc(), "ord").limit(1)


def static_import_member(imports: DataFrame, members: DataFrame) -> DataFrame:
    """imports (owner, name) with the places of all members of that name."""
    return imports.join(members, ["owner", "name"])


def file_local(occurrences: DataFrame, key: str, resource, scope: str, scope_id) -> DataFrame:
    return occurrences.where((F.col(key) == resource) & (F.col(scope) == scope_id))


def diagnostics(rows: DataFrame, uri: str, source: str) -> DataFrame:
    """Compiler messages of one resource as rows with ranges: an end before the start becomes one character; a missing
    position is (0, 0); kinds map to severities."""
    severity = F.when(F.col("kind") == "ERROR", 1).when(F.col("kind").isin("WARNING", "MANDATORY_WARNING"), 2).when(F.col("kind") == "NOTE", 3).otherwise(4)
    start = F.coalesce(F.greatest("start_off", F.lit(0)), F.lit(0))
    end = F.when(F.coalesce(F.col("end_off"), F.lit(-1)) < start, start + F.when(F.coalesce("start_off", F.lit(-1)) >= 0, 1).otherwise(0)).otherwise(F.col("end_off"))
    return rows.where(F.col("uri") == uri).select("uri", start.alias("start_off"), end.alias("end_off"), "message", severity.alias("severity"), F.lit(source).alias("source"), "code").distinct()


def synthetic_problem(uri: str, error: str) -> dict:
    """What is published where a compiler fails: one error at the start of the file."""
    return {"uri": uri, "start_off": 0, "end_off": 0, "message": error, "severity": 1, "source": "index", "code": None}


def published(documents: DataFrame, problems: DataFrame, uri: str = "uri") -> DataFrame:
    """(uri, problems): the problems of each open document in order, empty for those without: they clear what was shown."""
    place = F.struct("start_off", "end_off", "message", "severity", "source", "code")
    listed = problems.groupBy(uri).agg(F.sort_array(F.collect_list(place)).alias("problems"))  # as many as one document has
    none = F.array().cast(listed.schema["problems"].dataType)
    return documents.select(uri).distinct().join(listed, uri, "left").withColumn("problems", F.coalesce("problems", none))


def name_range(occurrences: DataFrame) -> DataFrame:
    """Occurrences whose range is that of the name at their end."""
    return occurrences.withColumn("start_off", F.col("end_off") - F.length("name"))


def coalesced_problems(rows: DataFrame, code: str, message: Column | str, place: Column | str, limit: int | None = None) -> DataFrame:
    return stats.coalesced_problems(rows, code, message, place, limit)
