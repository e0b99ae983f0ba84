"""What a worker holds while it rewrites."""

import weakref

import pyarrow as pa

from lexiflow.plans import rewrite as rw


class Result(dict):
    pass


def test_few_results_are_python_objects_at_once():
    alive, most = weakref.WeakSet(), 0

    class Seen(Result):
        __hash__ = object.__hash__

    def convert(text):
        nonlocal most
        alive.add(made := Seen(output=text, match_count=0, matches=[], rules_applied=[], warnings=[]))
        most = max(most, len(alive))
        return made

    texts = [None if k % 7 == 0 else "x" * (rw.SLICE_CHARS // 10) + str(k) for k in range(100)]
    got = rw.in_slices(pa.array(texts, pa.string()), convert)
    assert got.field("output").to_pylist() == texts and most <= 11
    assert len(rw.in_slices(pa.array([], pa.string()), convert)) == 0


def test_batches_are_small(spark):
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], 10_000)
        rw.rewrite(spark.createDataFrame([("a",)], "text string"), rw.Runtime([], [], [], []))
        assert [int(spark.conf.get(k).rstrip("b")) for k in keys] == [rw.BATCH_ROWS, rw.BATCH_BYTES]
        spark.conf.set(keys[0], 10)
        rw.rewrite(spark.createDataFrame([("a",)], "text string"), rw.Runtime([], [], [], []))
        assert spark.conf.get(keys[0]) == "10"
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
