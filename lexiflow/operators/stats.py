"""Aggregations of runs: latency figures, counts by category, conversion of DOM text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 100_000
MANY = 20_000  # below so many rows all values are ordered


def latency(df: DataFrame, column: str) -> DataFrame:
    """(n, mean_ms, p95_ms, max_ms); the 95th percentile is the value at place max(int(0.95 n) - 1, 0).

    Exact without a sort of all values: approximate percentiles enclose the place between two values, what is below
    them is counted, and only the distinct values in between are ordered, some hundred-thousandths of all."""
    value = F.col(column)
    near = F.approx_percentile(value, [0.9499, 0.9501], ACCURACY)
    total = df.where(value.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_ms"), F.max(value).alias("max_ms"), F.min(value).alias("_min"), near.alias("_near"))
    place = F.greatest(F.floor(F.col("n") * F.lit(95) / F.lit(100)) - 1, F.lit(0))
    # few rows: from the smallest value on, as the place is lower than the share says
    few = F.col("n") < MANY
    bounds = total.select("*", place.alias("_place"), F.when(few, F.col("_min")).otherwise(F.col("_near")[0]).alias("_low"), F.when(few, F.col("max_ms")).otherwise(F.col("_near")[1]).alias("_high"))
    beside = df.select(value.alias("v")).where("v is not null").join(F.broadcast(bounds.select("_low", "_high")))  # one row
    below = beside.agg(F.count_if(F.col("v") < F.col("_low")).alias("_below"))
    inside = beside.where(F.col("v").between(F.col("_low"), F.col("_high"))).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    upto = inside.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    p95 = upto.crossJoin(bounds.select("_place")).crossJoin(below).where(F.col("upto") + F.col("_below") > F.col("_place")).agg(F.min("v").alias("p95_ms"))  # by one row each
    return total.crossJoin(p95).select("n", "mean_ms", "p95_ms", "max_ms")


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def block_text(html: Column) -> Column:
    """Inline text nodes joined, markup and hidden elements gone."""
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(shown, r"<[^>]*>", " "), r"[ \t\r\n]+", " "))
