"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Statistics come from the whole text alone: sizes, shares of character classes, words and lines,
repetition, and shares of symbols. Shares go through a logit, counts through a logarithm, which makes them
closer to normal. Each class has a mean and a covariance; a covariance is shrunk towards the
pooled one and then towards its own diagonal, plus a floor, so it can be factored also with few
labels or constant statistics. A document's log density in a class is taken from the Mahalanobis
distance, by the class's Cholesky factor, which is computed once and kept; the score is the
posterior of label 1.

The moments are sums, which Spark adds up over all labelled rows: the driver gets one row a class
of FEATURES * (FEATURES + 1) / 2 + FEATURES + 1 numbers, whatever the input's size. Rows held out
(crc32 of the id's text mod 4 is 2) never count. Labels, language, source and id are no input
of a score.

Null and empty texts have the statistics of a text without words and get a score like any other. A null
label doesn't count. Repeated rows repeat. Without labels of both classes the score is the known
class's, or 0.5 with none. An empty table gives an empty result. Very long texts are handled
whole, in stretches. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, few_at_a_time, giving_back

FEATURES = (
    "log_words", "log_mean_word", "upper", "digit", "punct", "symbol", "pipe", "high", "ends_stop", "unique", "repeat_next", "top_word",
    "capital_words", "log_line", "unique_lines", "bang",
)
SHRINK_POOLED, SHRINK_DIAGONAL, FLOOR = 0.2, 0.1, 0.05
HELD_OUT = 2
FOLDS = 4
CUT = 0.7
MAX_BROADCAST = 200_000  # labels

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 sentence punctuation, 5 symbol, 6 white space, 7 beyond ASCII
for _c in range(256):
    _s = chr(_c)
    _KIND[_c] = 7 if _c > 127 else 1 if "a" <= _s <= "z" else 2 if "A" <= _s <= "Z" else 3 if _s.isdigit() else 4 if _s in ".,;:?!'\"()-" else 6 if _s in " \t\n\r\x0b\x0c" else 5 if _c > 32 else 0


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """FEATURES of a text."""
    data = (text or "").encode("utf-8")
    kinds = np.zeros(8, np.int64)
    for at in range(0, len(data), 1 << 20):
        kinds += np.bincount(_KIND[np.frombuffer(data, np.uint8, min(1 << 20, len(data) - at), at)], minlength=8)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, chars = len(words), max(int(kinds[1:6].sum() + kinds[7]), 0)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    capital = sum(map(bytes.isupper, words))
    stops = sum(x.rstrip()[-1:] in b".!?" for x in lines)
    return [
        np.log1p(n),
        np.log1p(chars / n if n else 0.0),
        _logit(kinds[2], chars),
        _logit(kinds[3], chars),
        _logit(kinds[4], chars),
        _logit(kinds[5], chars),
        _logit(data.count(b"|"), chars),
        _logit(kinds[7], chars),
        _logit(stops, len(lines)),
        _logit(len(counts), n),
        _logit(repeated, max(n - 1, 0)),
        _logit(max(counts.values(), default=0), n),
        _logit(capital, n),
        np.log1p(n / max(len(lines), 1)),
        _logit(len(set(lines)), len(lines)),
        _logit(data.count(b"!"), chars),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, inverse of the Cholesky factor, log determinant."""

    priors: tuple[float, ...]
    means: np.ndarray
    inverses: np.ndarray
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Posterior of label 1."""
        if not len(self.means):
            return np.full(len(x), self.priors[1])
        log = np.empty((2, len(x)))
        for c in (0, 1):
            z = (x - self.means[c]) @ self.inverses[c].T
            log[c] = self.priors[c] - 0.5 * (z * z).sum(axis=1) - 0.5 * self.log_dets[c]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
    """moments: for labels 0 and 1 the number of rows, the sums, and the sums of products."""
    none = np.empty((0, 0))
    if len(moments) < 2:
        sure = {0: 0.0, 1: 1.0}.get(next(iter(moments), -1), 0.5)
        return Discriminant((1 - sure, sure), none, none, none)
    n = np.array([moments[c][0] for c in (0, 1)])
    means = np.stack([moments[c][1] / moments[c][0] for c in (0, 1)])
    covs = np.stack([moments[c][2] / moments[c][0] - np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = (covs * n[:, None, None]).sum(axis=0) / n.sum()
    inverses, log_dets = [], []
    for c in (0, 1):
        cov = (1 - SHRINK_POOLED) * covs[c] + SHRINK_POOLED * pooled
        cov = (1 - SHRINK_DIAGONAL) * cov + SHRINK_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
        lower = np.linalg.cholesky(cov)
        inverses.append(np.linalg.inv(lower))
        log_dets.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(tuple(np.log(n / n.sum())), means, np.stack(inverses), np.array(log_dets))


def held_out(id_: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def with_statistics(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, x): x is the array of FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "x"])

    shown = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return few_at_a_time(shown).mapInArrow(giving_back(run), f"`{id_col}` {shown.schema[0].dataType.simpleString()}, x array<double>")


SUMS = "label int, place int, value double"


def _partial(label: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For each label the number of rows, their sums and the sums of their products, by place."""
    for c in (0, 1):
        rows = x[label == c]
        if len(rows):
            sums = np.concatenate(([len(rows)], rows.sum(axis=0), (rows.T @ rows).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), c, np.int32)), pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["label", "place", "value"])


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """labelled: (label, x), or (label, text), whose statistics are then taken on the way, so that one Python worker does
    both. Each batch adds up its own rows before anything is shuffled."""
    k = len(FEATURES)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                given = batch.column(1)
                x = np.array([statistics(t.as_py()) for t in given]) if batch.schema.names[1] == "text" else given.flatten().to_numpy().reshape(-1, k)
                yield from _partial(batch.column(0).to_numpy(), x)

    shown = labelled.where("label in (0, 1)").select(F.col("label").cast("int").alias("label"), *(c for c in ("x", "text") if c in labelled.columns))
    parts = few_at_a_time(shown).mapInArrow(giving_back(partial), SUMS)
    found = parts.groupBy("label", "place").agg(F.sum("value").alias("value")).toPandas()  # 2 * (1 + k + k * k) numbers
    out = {}
    for label, rows in found.groupby("label"):
        v = rows.sort_values("place")["value"].to_numpy()
        out[int(label)] = (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k))
    return out


def classify(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", cut_at: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row of df; labels: (id, label)."""
    seen = cut(with_statistics(df, id_col=id_col, text_col=text_col))
    known = labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).alias("label")).where(~held_out(F.col("_id"))).dropDuplicates()
    model = fit(moments(seen.join(known, F.col(id_col) == F.col("_id")).select("x", "label")))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    scored = seen.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut_at).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", cut_at: float = CUT) -> DataFrame:
    """The rows of df whose score is cut_at or more, with all their columns. The texts aren't
    shuffled: the model comes from one pass over the labelled rows, and a second pass filters."""
    known = labels.select(F.col(label_id_col).alias("_id"), F.col(label_col).alias("label")).where(~held_out(F.col("_id"))).dropDuplicates()
    if known.count() <= MAX_BROADCAST:  # only the labelled texts are looked at
        seen = df.select(F.col(id_col).alias("_of"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), F.col("_of") == F.col("_id")).select("label", "text")
    else:
        seen = with_statistics(df, id_col=id_col, text_col=text_col).join(known, F.col(id_col) == F.col("_id")).select("label", "x")
    model = fit(moments(seen))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.array([statistics(t.as_py()) for t in text])) >= cut_at if len(text) else [], pa.bool_())

    return few_at_a_time(df).where(good(F.col(text_col).cast("string")))


def crc_fold(id_) -> int:
    """The fold of an id, outside Spark."""
    return zlib.crc32(str(id_).encode()) % FOLDS
