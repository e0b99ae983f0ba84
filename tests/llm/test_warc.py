"""WARC: what is written comes back, and transactions meet."""

import base64
import hashlib

import pytest

from lexiflow.llm import warc


def roundtrip(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as _digest", "2 as record_id", "3 as page").repartition(3)
    warc.write_archive(df, f"{tmp_path}/w", captures_per_file=2, **more)
    return warc.assemble(warc.read_archive(spark, f"{tmp_path}/w"))


ROWS = [
    (5, "http://a/", "same é"), (3, "http://b/", "same é"), (9, "http://c/?q=1", "same é"),
    (1, "http://x/\r\nEvil: 1", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, None, None), (4, "", ""), (7, "http://l/", "x" * 300_000), (8, "http://d/", "twice"), (8, "http://d/", "twice"), (None, "http://n/", "same é"),
]


def test_round_trip(spark, tmp_path):
    done = roundtrip(spark, tmp_path, ROWS)
    got = sorted(map(tuple, warc.captured(done).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        data = (html or "").encode()
        first = min(j for j, _, h in ROWS if j is not None and (h or "") == (html or ""))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str)
    nested = {r.metadata.page: r for r in done.collect()}
    assert nested["5"].request.payload is None and bytes(nested["5"].original.payload).decode() == "same é"
    assert nested["5"].capture.refers_to == nested["3"].capture_id == nested["3"].capture.record_id == nested["3"].request.concurrent_to
    assert bytes(nested["1"].capture.payload) == ROWS[3][2].encode() and nested["1"].capture.target_uri == "http://x/ Evil: 1"


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = warc.captured(roundtrip(spark, tmp_path, ROWS[:3], min_revisit_bytes=100)).collect()
    assert [r.record_type for r in rows] == ["response"] * 3


def test_empty_and_broken(spark, tmp_path):
    assert warc.captured(roundtrip(spark, tmp_path, [])).count() == 0
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"junk"))
