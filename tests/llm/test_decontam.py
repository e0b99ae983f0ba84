"""Benchmark decontamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lexiflow.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= {str(x) for x in got if x is not None}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _id", "2 as item_id", "3 as run", "4 as size")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as words")
    return sorted((tuple(r) for r in decontam.find_contamination(d, i, **more).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [rng.choice(["ab", "B", "c7", "É", "d"]) for _ in range(n)]
    items = [(rng.choice([k, k, 3, None]), rng.choice(" -.\n").join(make(rng.choice([0, 1, 4, 6, 9, 10, 11, 25])))) for k in range(12)]
    docs = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += make(rng.randint(0, 12))
            if rng.random() < 0.5:
                text += words(rng.choice(items)[1])
        docs.append((rng.choice([d, d, 5, None]), ", ".join(text).upper() if rng.random() < 0.5 else "  ".join(text)))
    assert run(spark, docs, items) == slow(docs, items)
    assert run(spark, docs, items, max_literals=0) == slow(docs, items)


def test_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, None), (2, ""), (3, "...!"), (4, "x " * 40_000 + item), (5, item), (5, item), (None, item.upper()), (6, item[:-14])]
    assert run(spark, docs, [(1, item), (1, item), (2, None), (3, "!")]) == slow(docs, [(1, item), (1, item), (2, None), (3, "!")])
    assert run(spark, docs, []) == slow(docs, [])
    assert run(spark, [], [(1, item)]) == []


def test_equal_windows_have_equal_fingerprints(spark):
    rng = random.Random(4)
    text = [rng.choice("abcdefg") for _ in range(60)]
    rows = [(i, text[i : i + 10], [rng.choice("xyz")] * 3 + text[i : i + 10] + ["q"] * 2) for i in range(50)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    f = lambda c: decontam.fingerprints(F.col(c), 10, 5)
    assert df.select(F.forall(f("a"), lambda x: F.array_contains(f("b"), x)).alias("ok")).where("not ok").count() == 0


def test_clean_rows_without_an_id_or_with_a_shared_one_stay(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(None, "clean"), (None, "x " + item), (None, None), (7, "clean too"), (7, item), (8, item.upper()), (9, "clean")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _key", "2 as n_hit")
    kept = decontam.keep_clean(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((docs[k] for k in (0, 2, 3, 6)), key=str)
