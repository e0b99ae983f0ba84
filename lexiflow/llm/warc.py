"""WARC archives: write captures, read records back, assemble transactions.

A capture becomes three records: a request, a response (or a revisit of an earlier response
with the same payload) and metadata; request and metadata name the capture in
``WARC-Concurrent-To``. Spark's own text writer makes the files (one record a row, the
record's closing CRLF CRLF as line separator), so that any file system and the commit protocol
that survives lost executors serve; gzip is per file, so a reader can't seek to a record. A file holds at most ``captures_per_file`` captures;
a reading task has one file in memory, so for payloads of a megabyte and more the number has to be lowered. Reading splits by ``Content-Length``, never by
what a payload contains.

Of captures with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the
smallest id is the response and the others revisit it. The digest counts combine before their shuffle; payloads are shuffled once, by digest, to meet
them, in a join that Spark may split where one digest has very many rows.

Null payloads count as empty, null urls as the empty url; null ids sort last. Rows that repeat an
id and payload are all responses and all come back. An empty table gives an empty archive.
Only the three named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, page string, declared_digest string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1; 160 bits are 32 letters, without padding."""
    hexed = F.sha1(data)
    # ten hexadecimal digits are 40 bits, eight letters; conv() writes base 32 with 0-9 and A-V
    parts = [F.lpad(F.conv(F.substring(hexed, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}")]
    for name, value in headers:
        lines += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    size = F.octet_length(block).cast("string")
    return F.concat(*lines, F.lit("Content-Length: "), size, F.lit(CRLF + CRLF), block)


def plan_captures(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_revisit_bytes: int = 0) -> DataFrame:
    """(_id, _url, _payload, _digest, _key, _first): _first is the group's response, or null."""
    rows = pages.select(
        F.col(id_col).alias("_id"),
        # a header is one line
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]+", " ").alias("_url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("_payload"),
    ).withColumn("_digest", base32_sha1(F.col("_payload").cast("binary")))
    rows = rows.withColumn("_key", F.md5(F.concat_ws("\x01", F.coalesce(F.col("_id").cast("string"), F.lit("null")), "_url", "_digest")))
    order = F.struct(F.col("_id").isNull().alias("_last"), "_id", "_key")
    # grouped by one column more than the join has, so that the join brings exchanges of its own,
    # whose large partitions Spark can split
    groups = (
        rows.where(F.octet_length("_payload") >= min_revisit_bytes)
        .groupBy("_digest", F.octet_length("_payload").alias("_size"))
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select(F.col("_digest").alias("_group"), "_first")
    )
    return rows.join(groups, F.col("_digest") == F.col("_group"), "left").drop("_group")


def capture_records(captures: DataFrame) -> DataFrame:
    """One text row for each record."""
    urn = lambda key, kind: F.concat(F.lit(f"urn:uuid:{kind}-"), key)
    this = urn(F.col("_key"), "capture")
    uri = ("WARC-Target-URI", F.col("_url"))
    date = ("WARC-Date", F.lit("1970-01-01T00:00:00Z"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest"))
    page = F.coalesce(F.col("_id").cast("string"), F.lit(""))
    named = ("X-Page", page)
    http = F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}")
    http_type = lambda what: ("Content-Type", F.lit(f"application/http; msgtype={what}"))
    request = _record("request", urn(F.col("_key"), "request"), [uri, date, ("WARC-Concurrent-To", F.concat(F.lit("<"), this, F.lit(">"))), http_type("request")], F.concat(F.lit("GET "), "_url", F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    response = _record("response", this, [uri, date, digest, named, http_type("response")], F.concat(http, "_payload"))
    of = urn(F.col("_first._key"), "capture")
    revisit = _record(
        "revisit",
        this,
        [uri, date, digest, named, ("WARC-Refers-To", F.concat(F.lit("<"), of, F.lit(">"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), http_type("response")],
        http,
    )
    metadata = _record("metadata", urn(F.col("_key"), "metadata"), [uri, date, ("WARC-Concurrent-To", F.concat(F.lit("<"), this, F.lit(">"))), ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("page: "), page, F.lit(CRLF)))
    is_first = F.col("_first").isNull() | F.col("_id").eqNullSafe(F.col("_first._id"))
    return captures.select(F.explode(F.array(request, F.when(is_first, response).otherwise(revisit), metadata)).alias("value"))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, captures_per_file: int = 1000) -> None:
    captures = plan_captures(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_revisit_bytes=min_revisit_bytes)
    (
        capture_records(captures)
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * captures_per_file)
        .text(path)
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers with lower-case names, block) of each record; a broken tail raises."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if data[at : at + 2] == b"\r\n":  # between records
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size, start = int(headers["content-length"]), end + 4
        if start + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, view[start : start + size]
        at = start + size


def _body(block: memoryview) -> bytes:
    """What follows the HTTP headers."""
    data = bytes(block)
    at = data.find(b"\r\n\r\n")
    return b"" if at < 0 else data[at + 4 :]


def read_archive(spark: SparkSession, path: str, *, with_payload: bool = True) -> DataFrame:
    """A row of RECORD for each record of the files below path, gzipped or not.

    payload_bytes and payload_digest are computed from what is stored."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in RECORD.split(", "))])
        bare = lambda x: x.strip("<>") if x else None
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer().to_pybytes()
                out = []
                for head, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind, body, page = head.get("warc-type"), None, head.get("x-page")
                    if kind == "response":
                        body = _body(block)
                    elif kind == "metadata":
                        fields = dict(x.split(": ", 1) for x in bytes(block).decode().split("\r\n") if ": " in x)
                        page = fields.get("page")
                    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if body is not None else None
                    declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    out.append((kind, bare(head.get("warc-record-id")), bare(head.get("warc-concurrent-to")), bare(head.get("warc-refers-to")), head.get("warc-target-uri"), page, declared, None if body is None else len(body), digest, body if with_payload else None))
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: (capture_id, capture, request, metadata, original).

    Requests and metadata meet their capture by ``concurrent_to``; of several, the one
    with the smallest record id stays. original is the response that a revisit refers to."""
    fields = F.struct(*records.columns)
    captures = records.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), fields.alias("capture"))
    out = captures
    for kind in ("request", "metadata"):
        side = records.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("_to")).agg(F.min_by(fields, "record_id").alias(kind))
        out = out.join(side, F.col("capture_id") == F.col("_to"), "left").drop("_to")
    # a response is its own original, so no key is null; the second grouping column is there as above
    originals = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("_of"), "payload_digest").agg(F.first(fields).alias("original"))
    return out.join(originals.drop("payload_digest"), F.coalesce("capture.refers_to", "capture_id") == F.col("_of"), "left").drop("_of")


def captured(transactions: DataFrame, id_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of assembled captures."""
    whole = lambda name: F.col(f"original.{name}").alias(name)
    as_id = lambda c: F.when(c != "", c.cast(id_type))
    return transactions.select(
        as_id(F.col("metadata.page")).alias("page_id"),
        whole("payload_bytes"),
        whole("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.when(F.col("capture.record_type") == "revisit", as_id(F.col("original.page"))).alias("refers_to"),
    )
