"""Rewriting streams. All text operators are stateless, so they run on a streaming relation as they
are; low-confidence rows go to the review queue batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiflow.operators.rules import apply_rules
from lexiflow.plans.rewrite import Runtime, low_confidence, rewrite


def read_texts(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def rewrite_stream(texts: DataFrame, runtime: Runtime, *, text_col: str = "text") -> DataFrame:
    return rewrite(texts, runtime, text_col=text_col)


def rules_stream(texts: DataFrame, rules: list[dict], *, text_col: str = "text") -> DataFrame:
    return apply_rules(texts, rules, text_col=text_col)


def hits_by_window(matches: DataFrame, *, time_col: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Matches counted by source text and event-time window; late rows within the watermark count."""
    return matches.withWatermark(time_col, late).groupBy(F.window(time_col, width), "src").agg(F.count(F.lit(1)).alias("hits"))


def write_with_reviews(rewritten: DataFrame, out: str, queue: str, checkpoint: str, *, text_col: str = "text") -> StreamingQuery:
    """Rewritten rows to parquet at out, low-confidence ones also to the queue. Each batch overwrites
    its own folder, so a batch that runs again after a failure leaves no duplicates."""

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        low_confidence(batch, text_col=text_col).write.mode("overwrite").json(f"{queue}/batch={number}")
        batch.unpersist()

    return rewritten.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
