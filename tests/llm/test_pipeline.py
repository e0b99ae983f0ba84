"""Each stage of the pipeline against brute force, on what the stage before has kept."""

import corpus_pipeline
import numpy as np
import sentencepiece
from test_decontam import slow as slow_contamination
from test_secrets import BASE, slow as slow_secrets
from test_similar import slow_groups

from lexiflow.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or name == "tokens"
        docs.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    all_docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if quality.crc_fold(r.doc_id) != 2]
    moments = {}
    for c in (0, 1):
        x = np.array([quality.statistics(all_docs[r.doc_id].text) for r in known if r.quality == c])
        moments[c] = (float(len(x)), x.sum(axis=0), x.T @ x)
    scores = quality.fit(moments).scores(np.array([quality.statistics(r.text) for r in all_docs.values()]))
    assert set(kept["quality"]) == {d for d, s in zip(all_docs, scores) if s >= 0.7}

    before = sorted(kept["quality"])
    root = slow_groups([all_docs[d].text for d in before])
    firsts = {before[r] for r in root}
    assert firsts <= set(kept["near_duplicates"]) and len(kept["near_duplicates"]) - len(firsts) <= 0.05 * (len(before) - len(firsts))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = slow_contamination([(d, r.text) for d, r in kept["near_duplicates"].items()], items)
    assert set(kept["decontamination"]) == {r[0] for r in judged if not r[-1]}

    assert set(kept["secrets"]) == set(kept["decontamination"])
    for d, r in kept["secrets"].items():
        spans = slow_secrets(all_docs[d].text)[-1]
        assert (r.text == all_docs[d].text) == (not spans) and r.n_chars == len(r.text)
        assert not BASE["access"].search(r.text.replace("[secret]", ""))

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    assert all(r.ids == library.encode(kept["secrets"][d].text) for d, r in kept["tokens"].items()) and set(kept["tokens"]) == set(kept["secrets"])


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_chars", "n_tokens", "ids", "lossless"]


def test_edge_cases_through_the_stages(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows, shared ids and clashing column names."""
    import random

    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = [source[r.doc_id] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect() if len(source[r.doc_id].split()) > 60]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    rows = [(None, None), (1, ""), (2, None), (None, good[0]), (None, good[0]), (3, good[1]), (3, good[1]), (3, good[2]), (4, good[3]), (5, good[3] + " more"), (6, f"{good[4]} {item}"), (None, f"{good[5]} {item}"), (7, f"{good[6]} token = \"{'0a1b' * 8}\""), (8, " ".join(good[7:] * 5)), (9, words(2))]
    names = "raw key group node id __id _text host fps label score".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'xx' as lang", "'s' as source", "cast(length(text) as long) as n_chars", *(f"{k} as {n}" for k, n in enumerate(names)))
    columns, sizes = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns or name == "tokens"
        docs.write.parquet(path := f"{tmp_path}/{name}")
        docs, sizes[name] = spark.read.parquet(path), docs
        kept = spark.read.parquet(path).collect()
        if name == "quality":
            scored = {(r.doc_id, r.text) for r in kept}
            assert {(3, good[1]), (3, good[2]), (None, good[0])} <= scored
        elif name == "near_duplicates":
            assert len(kept) == len({(r.doc_id, r.text) for r in kept}) and (5, good[3] + " more") not in {(r.doc_id, r.text) for r in kept}
            assert {(3, good[1]), (3, good[2]), (None, good[0]), (4, good[3])} <= {(r.doc_id, r.text) for r in kept}
        elif name == "decontamination":
            assert {(None, good[0]), (3, good[2])} <= {(r.doc_id, r.text) for r in kept} and not any(item in (r.text or "") for r in kept)
        elif name == "secrets":
            assert not any("0a1b0a1b" in (r.text or "") for r in kept)
    assert all(r.n_tokens == len(r.ids) for r in docs.collect())


def test_empty_tables_through_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(path := f"{tmp_path}/{name}")
        docs = spark.read.parquet(path)
        assert docs.count() == 0


def test_earlier_tables_are_removed(spark):
    import glob

    from lexiflow.llm.common import shared_dir

    corpus_pipeline.run(spark, SF)
    left = [p for name, _ in corpus_pipeline.STAGES for p in glob.glob(f"{shared_dir(spark)}/{name}-*")]
    assert all("/secrets-" in p for p in left)
