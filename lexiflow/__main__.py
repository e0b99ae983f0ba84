"""Command line, also for spark-submit: convert texts, compile a lexicon, run the review queue.

    python -m lexiflow convert --data-dir DATA "a text" ...
    python -m lexiflow convert --data-dir DATA --input IN.parquet --output OUT --text-col text
    python -m lexiflow compile --data-dir DATA [--prepare] [--fail-on-lint]
    python -m lexiflow review export|import|apply --data-dir DATA --file FILE
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.operators import review
from lexiflow.plans import artifacts, rewrite
from lexiflow.sources import lexicon as src

# File names.
QUEUE, AUDIT = "review_queue.jsonl", "review_audit.jsonl"


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiflow")
    commands = top.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert")
    convert.add_argument("text", nargs="*")
    convert.add_argument("--input")
    convert.add_argument("--output")
    convert.add_argument("--text-col", default="text")
    convert.add_argument("--trace", action="store_true")
    convert.add_argument("--preserve-spacing", action="store_true")
    convert.add_argument("--enqueue-review", action="store_true")
    convert.add_argument("--owner", default="runtime")
    compile_ = commands.add_parser("compile")
    compile_.add_argument("--prepare", action="store_true")
    queue = commands.add_parser("review")
    queue.add_argument("action", choices=("export", "import", "apply"))
    queue.add_argument("--file", required=True)
    queue.add_argument("--limit", type=int, default=200)
    queue.add_argument("--owner", default="reviewer")
    queue.add_argument("--dry-run", action="store_true")
    for sub in (convert, compile_, queue):
        sub.add_argument("--data-dir", default="data")
        sub.add_argument("--fail-on-lint", action="store_true")
    return top


def enqueue(items: DataFrame, data_dir: str) -> None:
    if not items.isEmpty():
        review.append(review.complete(items, review.canonical(F.to_json(F.struct(*items.columns)))), f"{data_dir}/{QUEUE}")


def convert(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    compiled = artifacts.ensure_ready(spark, args.data_dir, fail_on_lint=args.fail_on_lint)
    runtime = rewrite.build_runtime(compiled, rewrite.Options(preserve_spacing=args.preserve_spacing))
    given = spark.read.parquet(args.input) if args.input else spark.createDataFrame([(" ".join(args.text).strip(),)], f"`{args.text_col}` string")
    done = rewrite.rewrite(given, runtime, text_col=args.text_col)
    if args.enqueue_review:
        items = rewrite.low_confidence(done, text_col=args.text_col, owner=args.owner)
        enqueue(items.withColumn("evidence", F.to_json("evidence")), args.data_dir)
    shown = done if args.trace else done.withColumn("result", F.col("result.output"))
    if args.output:
        shown.write.mode("overwrite").parquet(args.output)
        return []
    return [json.dumps(r.result.asDict(recursive=True), ensure_ascii=False) if args.trace else r.result for r in shown.select("result").collect()]  # the texts of the command line


def compile_(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    make = artifacts.ensure_ready if args.prepare else artifacts.compile_stored
    row = make(spark, args.data_dir, fail_on_lint=args.fail_on_lint).manifest.first().asDict()
    return [f"{k}: {row[k]}" for k in sorted(row)]


def review_(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    if args.action == "import":
        items = review.import_unresolved(spark.read.text(args.file), owner="migration")
        enqueue(items, args.data_dir)
        return [f"imported: {items.count()}"]
    queue = src.read_reviews(spark, f"{args.data_dir}/{QUEUE}")
    if args.action == "export":
        rows = review.pending(queue, args.limit).drop("line_no")
        src.write_json(rows, args.file)
        return [f"exported: {rows.count()}"]
    lexicon_path = f"{args.data_dir}/{artifacts.SOURCES['lexicon']}"
    done = review.resolve(queue, src.read_entries(spark, lexicon_path).drop("line_no"), src.read_decisions(spark, args.file), owner=args.owner)
    told = review.summary(done.outcomes).first().asDict()
    review.store(done, queue_path=f"{args.data_dir}/{QUEUE}", lexicon_path=lexicon_path, audit_path=f"{args.data_dir}/{AUDIT}", dry_run=args.dry_run)
    return [json.dumps(told, ensure_ascii=False)]


def main(argv: list[str] | None = None) -> list[str]:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("lexiflow").getOrCreate()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{args.data_dir}/checkpoint")
    lines = {"convert": convert, "compile": compile_, "review": review_}[args.command](spark, args)
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
