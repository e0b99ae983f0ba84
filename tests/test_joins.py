"""Joins of rules and entries are shuffled, however small a file claims to be."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import lints
from lexiflow.plans import compile as comp
from lexiflow.queries import core, whole


@pytest.fixture(scope="module")
def copied(spark, tmp_path_factory):
    """Many copies of part with shifted keys, in a file that is smaller than Spark's broadcasts."""
    top = str(tmp_path_factory.mktemp("copied"))
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(19))))
    part.withColumn("p_partkey", F.col("p_partkey") + 10_000 * F.col("i")).drop("i").coalesce(1).write.parquet(f"{top}/part.parquet")
    return top


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_masked_rules_are_not_broadcast(spark, copied):
    shown = plan(core.QUERIES["mask_lint"](spark, copied))
    assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_conflicting_rules_are_not_broadcast(spark, copied):
    shown = plan(core.QUERIES["conflict_lint"](spark, copied))
    assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_pairs_are_those_of_all_rules(spark, copied):
    rows = lints.ordered(core.rule_table(spark, copied)).where("type = 'literal' and pattern <> ''").collect()
    want = {(a.rule_id, b.rule_id) for a in rows for b in rows if a.pass_name == b.pass_name and a.place < b.place and b.pattern.startswith(a.pattern)}
    got = [(r.earlier_id, r.later_id) for r in lints.masked_rules(core.rule_table(spark, copied)).collect()]
    assert want and len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("counts", ["entry_count", "mask_warning_count"])
def test_entries_of_the_manifest_are_not_broadcast(spark, copied, counts):
    rows, core_rows = core._parts(spark, copied)
    allow = spark.createDataFrame([], "term string")
    shown = plan(comp.compile_lexicon(rows, core_rows, allow, core.rule_table(spark, copied)).manifest.select(counts))
    # the four named terms, and those of them that are rewritten, may be
    large = [line for line in shown.splitlines() if "BroadcastHashJoin" in line and "term" not in line]
    assert not large, large


@pytest.fixture
def small_broadcasts(spark):
    """Whatever is collected on the driver for a broadcast may have 64 kB."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "65536")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_manifest_collects_no_table(spark, copied, small_broadcasts):
    got = whole.manifest_findings(spark, copied).collect()
    assert len(got) == 1 and got[0].mask_warning_count == lints.masked_rules(core.rule_table(spark, copied)).count() > 0


def test_conflicts_collect_no_table(spark, copied, small_broadcasts):
    rows = [r for r in lints.ordered(core.rule_table(spark, copied)).collect() if r.pattern]
    pairs = [(a, b) for a in rows for b in rows if a.pass_name == b.pass_name and a.place < b.place and a.replacement != b.replacement]
    short = [("short_first", a.rule_id, b.rule_id) for a, b in pairs if a.type == b.type == "literal" and len(a.pattern) < len(b.pattern) and a.pattern in b.pattern]
    chain = [("chain", a.rule_id, b.rule_id) for a, b in pairs if a.replacement and a.replacement == b.pattern]
    got = [(r.kind, r.earlier_id, r.later_id) for r in core.conflict_lint(spark, copied).collect()]
    assert short and chain and sorted(got) == sorted(short + chain)
