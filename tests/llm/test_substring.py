"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from lexiflow.llm import substring


def slow(rows, size=13):
    first = {}
    split = [(d, [w.decode() for w in (t or "").encode().split()]) for d, t in rows]
    order = lambda d: float("inf") if d is None else d
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(order(d), first.get(k, float("inf")))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < order(d):
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as key", "3 as answer", "4 as _text2").repartition(3)
    got = substring.remove_repeats(df, **more).collect()
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    return sorted((tuple(r)[:4] for r in got), key=str)


def test_random_texts_with_small_alphabets_runs_and_shared_passages(spark):
    for seed, letters in ((1, "ab"), (2, "abcdefgh"), (3, "a")):
        rng = random.Random(seed)
        make = lambda n: [rng.choice(letters) * rng.randint(1, 2) for _ in range(n)]  # noqa: B023, E731
        passages = [make(rng.randint(10, 40)) for _ in range(6)] + [["x"] * 20, ["x", "y"] * 15, ["x", "y", "z"] * 9]
        rows = []
        for d in range(60):
            words = []
            for _ in range(rng.randint(0, 5)):
                words += rng.choice(passages) if rng.random() < 0.5 else make(rng.randint(0, 20))
            rows.append((rng.choice([d, d, 7, None]), " \n".join(words)))
        assert run(spark, rows) == slow(rows)
        assert run(spark, rows, batch_words=50) == slow(rows)


def test_edge_cases(spark):
    long = " ".join(str(i % 5000) for i in range(40_000))
    rows = [(2, None), (1, ""), (3, "a b"), (4, long), (9, long + " end"), (4, long), (5, "é à " * 30), (6, "é à " * 30), (8, "w " * 13), (7, "w " * 12)]
    assert run(spark, rows) == slow(rows)
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_symbols_begin_by_the_six_words_around(spark):
    for seed, letters in ((1, 2), (2, 3), (3, 30)):
        words = np.random.default_rng(seed).integers(0, letters, 3000)
        hashes = np.array([xxhash.xxh3_64_intdigest(b"%d" % w) for w in words], np.uint64)
        starts = substring.symbol_starts(hashes)
        assert 0 < starts.sum() < len(starts)
        for i in range(3, len(words) - 3):
            assert substring.symbol_starts(hashes[i - 3 : i + 3])[3] == starts[i]


def test_windows_that_share_twelve_words_are_told_apart(spark):
    n = 600_000
    same = " ".join(f"w{k}" for k in range(12))
    df = spark.range(n).selectExpr("id as doc_id", f"concat('{same} ', hex(id)) as text")
    got = substring.remove_repeats(df, with_text=False).selectExpr("sum(n_removed) as removed", "count(*) as n").first()
    assert tuple(got) == (0, n)
    again = df.unionByName(df.where("doc_id = 77").selectExpr("1000000L as doc_id", "text"))
    assert [tuple(r) for r in substring.remove_repeats(again, with_text=False).where("n_removed > 0").select("doc_id", "n_removed").collect()] == [(1_000_000, 13)]


def test_ids_are_integers(spark):
    with pytest.raises(TypeError):
        substring.remove_repeats(spark.createDataFrame([("x", "a")], "doc_id string, text string"))
