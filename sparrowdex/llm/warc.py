"""WARC archives with revisit records.

Writing: the payload digest and id of each row are shuffled, without the payloads, to find each digest's first record.
Where the digests with copies are few, they go to every task and the payloads stay where they are; beyond, rows meet them
by a join that deals a digest of very many rows over all tasks. Each record becomes a gzip member of its own, so an
archive can be read from any record on. Spark's text sink writes the members as they are (its commit protocol makes a lost
task safe to run again); as a sink of lines it wants a separator, which is an empty member. A file is what one task has
read, so Spark's partition sizes bound its bytes, and RECORDS_PER_FILE its records.

Reading: archives are read as whole binary files and parsed by Content-Length, so payloads may hold anything. Resolving: a
revisit record has no payload; it is joined, by the id it refers to, with its response.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import lean, spread, stash

MIN_PAYLOAD = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 100_000
#: Digests with copies that go to every task at most.
BROADCAST_DIGESTS = 200_000
#: Records and bytes that a reader hands on at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def headers(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).cast("long").alias("id"), "uri", payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload.cast("binary"), 256).alias("payload_digest"),
    )


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """id, uri, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least min_payload bytes, that with the smallest id is the response, the others
    revisit it. Rows that repeat the id and payload of a response are responses too; a row with a null id is a revisit, or
    a response where all rows of its payload have null ids. A null payload is empty. Other columns are dropped.
    """
    rows = headers(pages.withColumn("uri", F.col(uri_col).cast("string")), id_col, payload_col)
    large = F.col("payload_bytes") >= min_payload
    firsts = rows.where(large).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    firsts = stash(firsts, "warc-firsts")
    several = firsts.where("copies > 1 and first is not null").select("payload_digest", "first")
    if several.count() <= BROADCAST_DIGESTS:
        out = rows.join(F.broadcast(several), "payload_digest", "left")
    else:
        out = spread(rows.where(large), firsts.select("payload_digest", "first"), "payload_digest", "id", like=rows.where(large).select("payload_digest", "id"))
        out = out.unionByName(rows.where(~large).withColumn("first", F.lit(None).cast("long")))
    again = large & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return out.select("id", "uri", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _urn(i):
    return F.concat(F.lit("<urn:x-record:"), i.cast("string"), F.lit(">"))


def member(raw: bytes, level: int = 6) -> bytes:
    """A gzip member."""
    d = zlib.compressobj(level, zlib.DEFLATED, 31)
    return d.compress(raw) + d.flush()


def write(rows: DataFrame, path: str, date: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes the rows of records() as WARC/1.1 archives of gzip members, with fresh headers and the time of writing. A row
    without an id has a random one."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("payload"))
    uri = F.regexp_replace("uri", r"[\x00-\x20]", "%20")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    text = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.coalesce(_urn(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(revisit, PROFILE)), line("WARC-Refers-To", _urn(F.col("refers_to"))), line("Content-Type", F.when(~revisit, "text/html;charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, BATCH_ROWS):
                part = b.column(0).slice(at, BATCH_ROWS)
                yield pa.record_batch([pa.array([member(r.as_buffer()) for r in part], pa.binary())], names=["member"])

    # a cast of binary to string leaves the bytes as they are; the separator is given by a character a byte
    members = rows.select(text.cast("binary").alias("record")).mapInArrow(lean(run), "member binary").select(F.col("member").cast("string").alias("value"))
    sink = members.write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1"))
    sink.option("compression", "none").option("maxRecordsPerFile", records_per_file).text(path)


def parse(chunks):
    """(headers, payload) of each record of a WARC stream; chunks: its bytes, in parts. Header names are lower-cased."""
    held, chunks = bytearray(), iter(chunks)

    def more() -> bool:
        part = next(chunks, None)
        if part is None:
            return False
        held.extend(part)
        return True

    while True:
        while (start := next((i for i, c in enumerate(held) if c not in b"\r\n"), -1)) < 0:
            held.clear()
            if not more():
                return
        del held[:start]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a WARC record ends inside its headers")
        head = bytes(held[:end]).decode().split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {head[0][:40]!r}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}
        size = int(fields["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a WARC record ends inside its payload")
        payload = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        yield fields, payload


def unzipped(raw: bytes, step: int = 1 << 14, part: int = 1 << 20):
    """The bytes of a file, inflated by parts if it is gzipped (any number of members)."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at, held, d = memoryview(raw), 0, b"", None
    while held or at < len(view):
        if not held:  # what a member leaves of a step is all that is copied
            held, at = view[at : at + step], at + step
        d = d or zlib.decompressobj(31)
        out = d.decompress(held, part)
        held = d.unused_data if d.eof else d.unconsumed_tail
        if d.eof:
            d = None
        if out:
            yield out
    if d is not None:
        yield d.flush()


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """id, uri, record_type, refers_to, said_digest, own_bytes, own_digest of each record, and its payload if asked.

    said_digest is the header's; own_bytes and own_digest are computed from the payload that the record itself carries.
    """
    fields = [("id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("said_digest", pa.string()), ("own_bytes", pa.int64()), ("own_digest", pa.string())] + [("payload", pa.string())] * with_payload
    schema = pa.schema(fields)
    number = lambda urn: int(urn[14:-1]) if urn and urn.startswith("<urn:x-record:") else None

    def run(batches):
        for b in batches:
            for raw in b.column(0):
                rows: list[tuple] = []
                held = 0
                for h, p in parse(unzipped(raw.as_buffer().to_pybytes())):
                    rows.append((number(h.get("warc-record-id")), h.get("warc-target-uri"), h["warc-type"], number(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha256:"), len(p), hashlib.sha256(p).hexdigest()) + (p.decode(),) * with_payload)
                    held += len(p) * with_payload
                    if len(rows) == BATCH_ROWS or held > BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").load(path)
    return files.select("content").mapInArrow(lean(run), "id long, uri string, record_type string, refers_to long, said_digest string, own_bytes long, own_digest string" + ", payload string" * with_payload)


def resolve(read_back: DataFrame) -> DataFrame:
    """read() with payload_bytes and payload_digest of the full payload (and the payload, if it was read) of revisits too.

    A revisit whose response is not there, or has another payload, keeps the digest that its header states; its size and
    payload are null.
    """
    carried = [c for c in ("own_bytes", "own_digest", "payload") if c in read_back.columns]
    key = F.concat_ws(" ", "refers_to", "said_digest").alias("key")
    revisits = read_back.where("record_type = 'revisit'").select(key, "id", "uri", "record_type", "refers_to", "said_digest")
    responses = read_back.where("record_type = 'response' and id is not null").select(F.concat_ws(" ", "id", "own_digest").alias("key"), *carried)
    asked = revisits.select("key", "said_digest").distinct().join(responses.dropDuplicates(["key"]), "key", "left")
    asked = asked.withColumn("own_digest", F.coalesce("own_digest", "said_digest")).select("key", *carried)
    full = spread(revisits, asked, "key", "id").select("id", "uri", "record_type", "refers_to", *carried)
    out = read_back.where("record_type = 'response'").select("id", "uri", "record_type", "refers_to", *carried).unionByName(full)
    return out.withColumnRenamed("own_bytes", "payload_bytes").withColumnRenamed("own_digest", "payload_digest")
