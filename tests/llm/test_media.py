"""Media columns against brute force, and sequences of hand-made pages."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import media

TEXTS = [None, "", "abc", "é" * 288, "x" * 576, "x" * 577, "abc", "long " * 60_000]


def slow(text):
    data = (text or "").encode()
    padded = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
    stored = b"P5\n24 %d\n255\n" % (len(padded) // 24) + padded
    means = []
    for k in range(65):
        a, b = k * len(padded) // 65, (k + 1) * len(padded) // 65
        means.append((sum(padded[a:b]), b - a))
    bits = "".join("1" if means[k][0] * means[k + 1][1] > means[k + 1][0] * means[k][1] else "0" for k in range(64))
    return (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{int(bits, 2):016x}")


def test_texts_as_media(spark):
    rows = [*enumerate(TEXTS), (None, "abc"), (2, "abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as n_bytes", "3 as items")
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    got = sorted((tuple(r) for r in media.media_columns(df, id_col="doc_id", text_col="text").select("doc_id", *names).collect()), key=str)
    assert got == sorted(((i, *slow(t)) for i, t in rows), key=str)
    assert media.media_columns(df.limit(0), id_col="doc_id", text_col="text").count() == 0


def test_sequences_keep_order_positions_and_captions(spark):
    page = '<p>One &amp;\n two<figure><img src="media:aa"><figcaption>A <b>cap</b></figcaption></figure>three<img src="media:zz" alt="alt"><script>no</script>four<img src=media:aa>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "i int, h string")
    sequences = media.interleave(df, id_col="i", html_col="h")
    items = {r.i: [tuple(x) for x in r["items"]] for r in sequences.collect()}
    assert items == {
        1: [(0, "text", "One & two", None, None), (1, "media", None, "media:aa", "A cap"), (2, "text", "three", None, None), (3, "media", None, "media:zz", "alt"), (4, "text", "four", None, None), (5, "media", None, "media:aa", None)],
        2: [],
        3: [],
    }
    table = spark.createDataFrame([("aa", 7)], "digest string, size int")
    got = media.resolve(sequences, table, id_col="i").orderBy("position").select("position", "caption", F.col("size")).collect()
    assert [tuple(r) for r in got] == [(1, "A cap", 7), (3, "alt", None), (5, None, 7)]


def test_stored_form_is_checked():
    assert bytes(media.samples_of(media.as_image(b"abc")))[:4] == b"abc\xff"
    for bad in (b"P6\n24 1\n255\n", media.as_image(b"abc")[:-1]):
        with pytest.raises(ValueError):
            media.samples_of(bad)
