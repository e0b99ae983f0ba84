"""Quality classifier: folds, held-out accuracy, and scores against a plain Gaussian density."""

import numpy as np
import pytest

from lexiflow.llm import quality

SF = "/root/testdata/sf0.1"


def test_scores_equal_the_posterior_of_two_gaussians():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 2, 3]
    y = rng.normal(size=(200, 3)) + 1
    model = quality.fit({c: (float(len(z)), z.sum(axis=0), z.T @ z) for c, z in ((0, x), (1, y))})
    n = np.array([300, 200])
    covs = [np.cov(z.T, bias=True) for z in (x, y)]
    pooled = (covs[0] * 300 + covs[1] * 200) / 500
    probe, dens = rng.normal(size=(50, 3)), []
    for c, z in enumerate((x, y)):
        s = 0.8 * covs[c] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.diag(np.diag(s)) + 0.05 * np.eye(3)
        d = probe - z.mean(axis=0)
        dens.append(n[c] / 500 * np.exp(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d)) / np.sqrt(np.linalg.det(s)))
    assert np.allclose(model.scores(probe), dens[1] / (dens[0] + dens[1]))


def test_held_out_accuracy_and_no_use_of_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: quality.crc_fold(i) == 2)).all()
    held = got[got.held_out]
    assert ((held.score >= 0.7) == (held.quality == 1)).mean() > 0.98 and (got.predicted == (got.score >= 0.7)).all()
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - quality else quality end as quality")
    again = quality.classify(docs, turned).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[got.doc_id].to_numpy(), got.score, atol=1e-9)


@pytest.mark.parametrize("rows,score", [([], 0.5), ([(1, 1)], 1.0), ([(1, 0), (2, None)], 0.0)])
def test_edge_cases(spark, rows, score):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (None, "x | " * 50_000), (1, "a b")], "doc_id long, text string").selectExpr("*", "1 as x", "2 as label", "3 as quality")
    labels = spark.createDataFrame(rows, "doc_id long, quality int").selectExpr("*", "'t' as text")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and {r.score for r in got} == {score} and {r.predicted for r in got} == {int(score >= 0.7)}
    assert quality.classify(docs.limit(0), labels).count() == 0


def slow_statistics(text):
    """The statistics, character by character."""
    import math

    text = text or ""
    data = text.encode("utf-8")
    logit = lambda part, whole: math.log((part + 0.5) / (whole - part + 0.5))
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    punct = sum(c in b".,;:?!'\"()-" for c in data)
    letters = {"upper": sum(65 <= c <= 90 for c in data), "lower": sum(97 <= c <= 122 for c in data), "digit": sum(48 <= c <= 57 for c in data), "high": sum(c > 127 for c in data)}
    symbol = sum(c > 32 and c < 128 and not chr(c).isalnum() and c not in b".,;:?!'\"()-" for c in data)
    chars = sum(letters.values()) + punct + symbol
    count = {w: words.count(w) for w in set(words)}
    return [
        math.log1p(len(words)), math.log1p(chars / len(words) if words else 0), logit(letters["upper"], chars), logit(letters["digit"], chars), logit(punct, chars), logit(symbol, chars),
        logit(data.count(b"|"), chars), logit(letters["high"], chars), logit(sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines), len(lines)), logit(len(count), len(words)),
        logit(sum(words[k] == words[k - 1] for k in range(1, len(words))), max(len(words) - 1, 0)), logit(max(count.values(), default=0), len(words)),
        logit(sum(w.isupper() for w in words), len(words)), math.log1p(len(words) / max(len(lines), 1)), logit(len(set(lines)), len(lines)), logit(data.count(b"!"), chars),
    ]


def test_statistics_equal_a_plain_count(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in [t for t in texts if len(t) < 20_000] + [None, "", " \n\t", "A b|c!! 12\nA b|c!! 12\n\né~", "x" * 3000]:
        assert np.allclose(quality.statistics(text), slow_statistics(text), rtol=1e-12, atol=1e-12), text
