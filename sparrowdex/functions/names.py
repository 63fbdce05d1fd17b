"""Names, paths and URIs as column expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Declaration files that hold no type, and the suffixes of archives.
SKIPPED = ("module-info", "package-info")
ARCHIVES = (".jar", ".jmod", ".zip")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_segment(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def is_skipped_name(jvm: Column | str) -> Column:
    """A JVM name that never becomes a type row."""
    return last_segment(jvm).isin(*SKIPPED)


def is_skipped_file(path: Column | str) -> Column:
    """A file that no parser sees: package-info.java or package-info.class."""
    return last_segment(path).isin("package-info.java", "package-info.class")


def is_module_info(path: Column | str) -> Column:
    return last_segment(path).isin("module-info.java", "module-info.class")


def package_of(jvm: Column | str) -> Column:
    """What stands before the last slash; empty for the default package."""
    return F.regexp_extract(_col(jvm), "^(.*)/[^/]*$", 1)


def simple_name(jvm: Column | str) -> Column:
    """What stands after the last slash or dollar."""
    return F.regexp_extract(_col(jvm), "([^/$]*)$", 1)


def outermost(jvm: Column | str) -> Column:
    return F.substring_index(_col(jvm), "$", 1)


def owner_of(jvm: Column | str) -> Column:
    """The enclosing type, cut at the last dollar; null for a top-level type."""
    return F.when(F.contains(_col(jvm), F.lit("$")), F.regexp_extract(_col(jvm), r"^(.*)\$[^$]*$", 1))


def display_name(jvm: Column | str) -> Column:
    """The dotted name that people read."""
    return F.translate(_col(jvm), "/$", "..")


def ancestors(package: Column | str) -> Column:
    """The package and the packages above it; none for the default package."""
    p = F.split(_col(package), "/")
    return F.when(_col(package) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/")))


def jvm_of_dotted(dotted: Column | str) -> Column:
    """A dotted selection as a JVM name: segments join by a slash up to the first that begins with a capital, then by a
    dollar. All in lower case, it is a package path."""
    parts = F.split(_col(dotted), r"\.")
    starts = F.transform(parts, lambda s: F.substring(s, 1, 1).rlike("[A-Z]"))
    first = F.array_position(starts, F.lit(True)).cast("int")
    head = F.array_join(F.slice(parts, 1, F.when(first > 0, first).otherwise(F.size(parts))), "/")
    tail = F.array_join(F.slice(parts, first + 1, F.greatest(F.size(parts) - first, F.lit(0))), "$")
    return F.when((first > 0) & (first < F.size(parts)), F.concat(head, F.lit("$"), tail)).otherwise(head)


def is_dotted_name(text: Column | str) -> Column:
    return F.coalesce(_col(text).rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*$"), F.lit(False))


# --- URIs -------------------------------------------------------------------------------------------------------------


def is_archive(uri: Column | str) -> Column:
    path = F.lower(F.regexp_extract(_col(uri), "^([^?#]*)", 1))
    return path.endswith(ARCHIVES[0]) | path.endswith(ARCHIVES[1]) | path.endswith(ARCHIVES[2])


def is_absolute(uri: Column | str) -> Column:
    return F.contains(_col(uri), F.lit("://")) | F.startswith(_col(uri), F.lit("jar:"))


def join_uri(source: Column | str, relative: Column | str) -> Column:
    """The URI of a resource inside a source."""
    s, r = _col(source), _col(relative)
    bang, slash = F.concat(s, F.lit("!/"), r), F.concat(s, F.lit("/"), r)
    plain = F.concat(s, r)
    file = F.when(is_archive(s), F.concat(F.lit("jar:"), bang)).when(F.endswith(s, F.lit("/")), plain).otherwise(slash)
    return F.when(F.startswith(s, F.lit("jrt:")), bang).when(F.startswith(s, F.lit("file:")), file).when(F.endswith(s, F.lit("/")), plain).otherwise(bang)


def relative_path(resource: Column | str, source: Column | str) -> Column:
    """The path of a resource inside its source: after the bang, or after the source's own path; null outside of it."""
    r, s = _col(resource), _col(source)
    at = F.instr(r, "!/")
    whole = F.when(F.endswith(s, F.lit("/")), s).otherwise(F.when(F.startswith(s, F.lit("file:")) & F.startswith(r, F.lit("file:")), F.concat(s, F.lit("/"))))
    return F.when(at > 0, F.substr(r, at + 2)).when(F.startswith(r, whole), F.nullif(F.substr(r, F.length(whole) + 1), F.lit("")))


def compact_uri(resource: Column | str, source: Column | str) -> Column:
    """The relative path where joining it to the source gives the resource again, else the resource."""
    rel = F.nullif(relative_path(resource, source), F.lit(""))
    return F.when(is_absolute(resource) & (F.coalesce(_col(source), F.lit("")) != "") & (join_uri(source, rel) == _col(resource)), rel).otherwise(_col(resource))


def resolve_uri(source: Column | str, stored: Column | str) -> Column:
    """The inverse of compact_uri."""
    return F.when(is_absolute(stored) | (F.coalesce(_col(source), F.lit("")) == ""), _col(stored)).otherwise(join_uri(source, stored))


def default_path(jvm: Column | str, origin: Column | str) -> Column:
    """Where a type is expected: its own class file, or the source file of its outermost type."""
    return F.when(_col(origin) == "classfile", F.concat(_col(jvm), F.lit(".class"))).otherwise(F.concat(outermost(jvm), F.lit(".java")))


def stored_path(path: Column | str, jvm: Column | str, origin: Column | str) -> Column:
    """Null where the path is the default one."""
    return F.nullif(_col(path), default_path(jvm, origin))


def effective_path(path: Column | str, jvm: Column | str, origin: Column | str) -> Column:
    return F.coalesce(_col(path), default_path(jvm, origin))


def decode_uri(uri: Column | str) -> Column:
    """Percent-decoding until nothing changes; what cannot be decoded stays."""
    once = lambda x: F.coalesce(F.try_url_decode(x), x)
    u = _col(uri)
    first = once(u)
    # a round that changes something makes the text shorter by two characters at least
    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(first) / 2).cast("int"))), first, lambda x, _: F.when(F.contains(x, F.lit("%")) | F.contains(x, F.lit("+")), once(x)).otherwise(x))
    return F.when(~F.contains(u, F.lit("%")) & ~F.contains(u, F.lit("+")), u).when(F.contains(first, F.lit("%")) | F.contains(first, F.lit("+")), rest).otherwise(first)


def attached_source(resource: Column | str, archive: Column | str) -> Column:
    """The .java file of a .class resource inside the archive of its sources; null without one."""
    inner = F.regexp_replace(F.substring_index(_col(resource), "!/", -1), r"(\$[^/]*)?\.class$", ".java")
    return F.when(F.endswith(_col(resource), F.lit(".class")) & _col(archive).isNotNull(), F.concat(F.lit("jar:"), _col(archive), F.lit("!/"), inner))


# --- messages and sizes -----------------------------------------------------------------------------------------------


def normal_message(text: Column | str) -> Column:
    """Lines without those that only give a location, with single spaces, joined by a bar."""
    trimmed = F.transform(F.split(_col(text), r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(trimmed, lambda x: (x != "") & ~F.startswith(x, F.lit("location:"))), " | ")


def format_bytes(n: Column | str) -> Column:
    b = _col(n).cast("double")
    unit = lambda power, name: F.format_string(f"%.2f {name}", b / 1024**power)
    return F.when(b < 1024, F.format_string("%d B", _col(n).cast("long"))).when(b < 1024**2, unit(1, "KiB")).when(b < 1024**3, unit(2, "MiB")).otherwise(unit(3, "GiB"))
