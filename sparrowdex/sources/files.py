"""Readers of directories and archives, and the scan that makes index rows of them.

Directories are read by Spark's binary file source; archives are opened by the task that got their bytes. Each file is
parsed on its own, so a scan is one pass without an exchange; a file that fails is a row with an error.
"""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .. import schemas
from ..functions import names
from . import classfile, image, javasource

#: Rows of resources that a task hands over at once.
ROWS = 64


def source_uri(path: Column | str) -> Column:
    """`file:/x` and plain paths as file:///x; other URIs stay."""
    p = F.col(path) if isinstance(path, str) else path
    bare = F.regexp_replace(p, "^file:/*", "/")
    return F.when(F.startswith(p, F.lit("file:")) | F.startswith(p, F.lit("/")), F.concat(F.lit("file://"), bare)).otherwise(p)


def read_directory(spark: SparkSession, root: str) -> DataFrame:
    """Resources (source_uri, resource_path, content, error) of a folder: .java and .class files, package-info apart."""
    uri = root.rstrip("/") + "/"
    full = uri if "://" in uri else "file://" + uri
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{java,class}").load(root)
    rows = files.select(F.lit(full).alias("source_uri"), F.substr(source_uri("path"), F.lit(len(full) + 1)).alias("resource_path"), "content", F.lit(None).cast("string").alias("error"))
    return rows.where(~names.is_skipped_file("resource_path"))


def read_archives(spark: SparkSession, path: str, glob: str = "*.{jar,zip,jmod}") -> DataFrame:
    """Resources of archives: their .java and .class entries. An unreadable archive or entry is a row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return expand_archives(files.select(source_uri("path").alias("source_uri"), "content"))


def expand_archives(archives: DataFrame) -> DataFrame:
    """archives: (source_uri, content)."""
    schema = pa.schema([("source_uri", pa.string()), ("resource_path", pa.string()), ("content", pa.binary()), ("error", pa.string())])

    def entries(uri: str, data: bytes):
        try:
            if data[:4] == b"JM\x01\x00":  # a jmod is a zip after four bytes
                data = data[4:]
            archive = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError) as e:
            yield uri, None, None, f"{type(e).__name__}: {e}"
            return
        for info in archive.infolist():
            name = info.filename
            if info.is_dir() or not name.endswith((".java", ".class")) or name.rpartition("/")[2] in ("package-info.java", "package-info.class"):
                continue
            try:
                yield uri, name, archive.read(info), None
            except Exception as e:  # noqa: BLE001
                yield uri, name, None, f"{type(e).__name__}: {e}"

    def run(batches):
        rows: list[tuple] = []
        for b in batches:
            for uri, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for row in entries(uri, data.as_py()):
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("source_uri", "content").mapInArrow(run, schemas.RESOURCE)


def read_jmods(spark: SparkSession, home: str) -> DataFrame:
    """Resources of a Java home's jmods, where it has them instead of, or beside, an image; classes stand below `classes/`."""
    found = read_archives(spark, f"{home.rstrip('/')}/jmods", "*.jmod")
    inner = F.regexp_replace("resource_path", "^classes/", "")
    module = F.regexp_extract("source_uri", r"([^/]*)\.jmod$", 1)
    return found.select(F.lit(f"jrt://{home}").alias("source_uri"), F.concat(F.lit("modules/"), module, F.lit("/"), inner).alias("resource_path"), "content", "error")


def parse(resources: DataFrame, surface_names: bool = False, record_components: bool = True, bytecode: str = "full", source: str = "java") -> DataFrame:
    """One row per resource: types, modules, names, or an error. Unknown back end names mean the default one.

    surface_names or bytecode="surface": names of class files come from their declared surface only.
    record_components=False leaves those of sources empty.
    """
    spark_schema = _parse_datatype_string(schemas.PARSED)
    schema = to_arrow_schema(spark_schema)
    surface = surface_names or bytecode == "surface"

    def one(uri, path, data, error):
        origin = "classfile" if (path or "").endswith(".class") else "source"
        if error is None:
            try:
                types, modules, mentioned, *skipped = classfile.parse(data, surface) if origin == "classfile" else javasource.parse_counted(data.decode("utf-8", "replace"))
                if not record_components and origin == "source":
                    for t in types:
                        t["record_components"] = []
                return uri, path, origin, len(data), types, modules, mentioned, f"members that do not parse: {skipped[0]}" if skipped and skipped[0] else None
            except Exception as e:  # noqa: BLE001  one file's failure is a row of its own
                error = f"{type(e).__name__}: {e}"
        return uri, path, origin, len(data or b""), [], [], [], error

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = [one(*x) for x in zip(*[c.to_pylist() for c in b.slice(at, ROWS).columns], strict=True)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return resources.select("source_uri", "resource_path", "content", "error").mapInArrow(run, spark_schema)


def occurrences(resources: DataFrame) -> DataFrame:
    """(source_uri, resource_path, source_package, siblings, single_imports, on_demand, and the columns of an occurrence) of
    each name in each source: what a file alone tells. Files are read apart, so only those that may mention a name need be
    given (`xref.candidates`)."""
    spark_schema = _parse_datatype_string(schemas.OCCURRENCES)
    schema = to_arrow_schema(spark_schema)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = []
                for uri, path, data in zip(*[c.to_pylist() for c in b.slice(at, ROWS).columns], strict=True):
                    text = (data or b"").decode("utf-8", "replace")
                    rows.append((uri, path, *javasource.context(text), javasource.occurrences(text)))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    sources = resources.where(F.endswith("resource_path", F.lit(".java"))).select("source_uri", "resource_path", "content")
    found = sources.mapInArrow(run, spark_schema)
    return found.select("source_uri", "resource_path", "source_package", "siblings", "single_imports", "on_demand", F.explode("found").alias("o")).select("source_uri", "resource_path", "source_package", "siblings", "single_imports", "on_demand", "o.*")


def type_entries(parsed: DataFrame) -> DataFrame:
    """The type table of parsed resources."""
    t = parsed.select("source_uri", "resource_path", "origin", F.explode("types").alias("t")).select("source_uri", "resource_path", "origin", "t.*")
    t = t.where(~names.is_skipped_name("jvm_name"))
    return t.withColumns({"resource_uri": names.join_uri("source_uri", "resource_path"), "package_jvm": names.package_of("jvm_name"), "simple_name": names.simple_name("jvm_name"), "is_nested": F.contains("jvm_name", F.lit("$"))})


def module_entries(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_uri", "resource_path", F.explode("modules").alias("m")).select("source_uri", "resource_path", "m.*")


def resource_identifiers(parsed: DataFrame) -> DataFrame:
    """(source_uri, resource_path, name): exact, each name of a resource once."""
    return parsed.select("source_uri", "resource_path", F.explode(F.array_distinct("names")).alias("name"))


def failures(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("source_uri", "resource_path", "error")


def scan(spark: SparkSession, directories: list[str] = (), archives: list[str] = (), homes: list[str] = (), **options) -> DataFrame:
    """Parsed resources of archives and Java homes, then directories; an unreadable archive is a row with an error.

    One archive can hold a third of all files, so the entries of archives are dealt anew before they are parsed.
    """
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = [read_archives(spark, a).repartition(n) for a in archives] + [image.read_image(spark, h) for h in homes] + [read_directory(spark, d) for d in directories]
    if not parts:
        return parse(spark.createDataFrame([], schemas.RESOURCE), **options)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return parse(out, **options)


def read_text(resources: DataFrame, uri: str) -> DataFrame:
    """The text of one resource; no row if it is not there."""
    return resources.where(names.join_uri("source_uri", "resource_path") == uri).select(F.decode("content", "UTF-8").alias("text"))
