"""Media columns: interleaved document sequences.

A document's HTML becomes an array of structs in page order: text items, and media items with
their reference, caption and position. References of the form ``media:<sha256>`` are resolved
by joining on the digest with a media table, which has one row for each stored object;
positions and captions stay with their reference, resolved or not.

:func:`store_payloads` turns text into media: the UTF-8 bytes, padded with bytes 255 to a
positive multiple of 576, become the samples of an 8-bit greyscale image (portable graymap, 24
samples a row), written losslessly to a table in the shared folder. :func:`read_media` reads
the stored objects back, takes the header off and describes the samples.

Null texts count as empty and give one row of padding. Copies give equal digests, so their
descriptions meet in one row before the join. Very long texts are handled whole, one at
a time. Null html gives an empty sequence. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import few_at_a_time, fresh_path

UNIT = 576
WIDTH = 24
SCHEME = "media:"
ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
DESCRIBED = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class _Sequence(HTMLParser):
    """Text and media items in page order. A figure's caption belongs to its media."""

    BREAKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
    HIDDEN = frozenset(("script", "style", "template", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in ("img", "video", "audio", "source"):
            self.flush()
            given = dict(attrs)
            item = {"position": len(self.items), "kind": "media", "text": None, "ref": given.get("src") or "", "caption": given.get("alt")}
            self.items.append(item)
            if self.figure is not None:
                self.figure.append(item)
        elif tag in self.BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = []
            elif tag == "figcaption":
                self.caption = []

    def handle_startendtag(self, tag, attrs):
        if tag not in self.HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.figure or ():
                item["caption"] = said
            if not self.figure and said:
                self.text.append(said)
        elif tag == "figure":
            self.handle_endtag("figcaption")
            self.figure = None
        elif tag in self.BREAKS:
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.handle_endtag("figure")
    parser.flush()
    return parser.items


def interleave(df: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """(id, items): the ordered text and media structs of each row."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = pa.array([sequence_of(x.as_py()) for x in batch.column(1)], type=kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), items], names=[id_col, "items"])

    shown = df.select(F.col(id_col), F.col(html_col))
    return few_at_a_time(shown).mapInArrow(parse, f"`{id_col}` {shown.schema[0].dataType.simpleString()}, items array<{ITEM}>")


def resolve(sequences: DataFrame, media: DataFrame, *, id_col: str) -> DataFrame:
    """A row for each media item: id, position, caption, ref, and the media table's columns.

    media has a column digest (one row each); references that it lacks keep nulls. The reference
    joins by an exchange of its own on either side, so Spark can split a digest that very
    many documents show."""
    refs = sequences.select(F.col(id_col), F.explode("items").alias("_item")).where("_item.kind = 'media'")
    refs = refs.select(id_col, "_item.position", "_item.caption", "_item.ref", F.when(F.col("_item.ref").startswith(SCHEME), F.expr(f"substring(_item.ref, {len(SCHEME) + 1})")).alias("_digest"))
    return refs.join(media, F.col("_digest") == F.col("digest"), "left").drop("_digest")


def media_html(digest: Column, caption: Column) -> Column:
    return F.concat(F.lit(f'<article><figure><img src="{SCHEME}'), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def as_image(data: bytes) -> bytes:
    """The stored form: a graymap whose samples are the padded bytes."""
    size = max(UNIT, -(-len(data) // UNIT) * UNIT)
    return b"P5\n%d %d\n255\n" % (WIDTH, size // WIDTH) + data + b"\xff" * (size - len(data))


def samples_of(stored: bytes | memoryview) -> memoryview:
    """The samples of a stored graymap."""
    head = bytes(stored[:64]).split(b"\n", 3)
    if head[0] != b"P5" or head[2] != b"255":
        raise ValueError("not an 8-bit graymap")
    width, height = map(int, head[1].split())
    start = len(head[0]) + len(head[1]) + len(head[2]) + 3
    if len(stored) - start != width * height:
        raise ValueError("the graymap is cut off")
    return memoryview(stored)[start:]


def feature_of(samples: memoryview) -> str:
    """Difference hash: the means of 65 equal stretches of samples, each against the next, as 16
    hex digits. Integers throughout, so it is the same everywhere."""
    values = np.frombuffer(samples, np.uint8)
    at = np.arange(65, dtype=np.int64) * len(values) // 65
    sums = np.add.reduceat(values.astype(np.int64), at)
    counts = np.diff(np.append(at, len(values)))
    bits = sums[:-1] * counts[1:] > sums[1:] * counts[:-1]
    return np.packbits(bits).tobytes().hex()


def store_payloads(df: DataFrame, path: str, *, id_col: str, text_col: str) -> None:
    """Write (id, n_bytes, digest, stored) rows; digest is the SHA-256 of the unpadded bytes."""
    kept = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("_data"))

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column(0), batch.column(1)
            for at in range(0, len(data), 256):  # so many at a time are in memory twice
                raw = [x.as_buffer().to_pybytes() for x in data[at : at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array([len(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]), pa.array([as_image(x) for x in raw], pa.binary())],
                    names=[id_col, "n_bytes", "digest", "stored"],
                )

    out = few_at_a_time(kept).mapInArrow(images, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, n_bytes long, digest string, stored binary")
    out.write.option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """DESCRIBED, one row for each digest, computed from the stored bytes."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n_bytes, stored in zip(batch.column(0), batch.column(1), batch.column(2)):
                held = stored.as_buffer().to_pybytes()
                samples = samples_of(held)
                rows.append((digest.as_py(), n_bytes.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(held), hashlib.sha256(held).hexdigest(), feature_of(samples)))
            names = [x.split()[0] for x in DESCRIBED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if isinstance(c[0], int) else pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.int64() if "long" in x else pa.string()) for x in DESCRIBED.split(", ")], names=names)

    described = few_at_a_time(spark.read.parquet(path).select("digest", "n_bytes", "stored")).mapInArrow(describe, DESCRIBED)
    return described.groupBy("digest", "n_bytes").agg(*(F.first(c).alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))).select(*(x.split()[0] for x in DESCRIBED.split(", ")))


def media_columns(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Each row's text as media, referred to from a sequence and resolved: id, position, caption,
    and DESCRIBED."""
    spark = df.sparkSession
    path = fresh_path(spark, "media")
    store_payloads(df, path, id_col=id_col, text_col=text_col)
    pages = spark.read.parquet(path).select(id_col, media_html(F.col("digest"), F.concat(F.lit("text of "), F.col("n_bytes").cast("string"), F.lit(" bytes"))).alias("_html"))
    return resolve(interleave(pages, id_col=id_col, html_col="_html"), read_media(spark, path), id_col=id_col)
