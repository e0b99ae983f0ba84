"""Lints over the rule relation, within a pass.

Prefix, containment and chain tests are equality joins on the prefixes or substrings of the later
pattern, whose number depends only on its length; no pair of unrelated rules is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.policy import rule_order

# Fixed values.
DOT_GREEDY = r"(?<!\\)\.(?:\*|\+)"
UNBOUNDED_NEGATION = r"\[\^[^\]]+\]\+"
MANY_LOOKAHEADS = 8


def ordered(rules: DataFrame) -> DataFrame:
    """Enabled rules with their place within the pass."""
    return rules.where("enabled").withColumn("place", F.row_number().over(Window.partitionBy("pass_name").orderBy(*rule_order())))


def _prefixes(pattern: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(pattern)), lambda n: F.substring(pattern, F.lit(1), n))


def _shorter_substrings(pattern: Column) -> Column:
    """Distinct substrings that aren't the whole."""
    at = F.sequence(F.lit(1), F.length(pattern))
    every = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.length(pattern) - i + 1), lambda n: F.substring(pattern, i, n))))
    return F.filter(F.array_distinct(every), lambda s: F.length(s) < F.length(pattern))


def by_shuffle(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle: Spark takes the size of a compressed file for that of its rows, and would collect
    a million of them on the driver for a broadcast."""
    return df.hint("merge")


def _pairs(rules: DataFrame, earlier_key: Column, later_keys: Column, kind: str, literal: bool) -> DataFrame:
    """Pairs of an earlier and a later rule of one pass whose keys meet."""
    kept = ordered(rules).where("pattern <> ''").withColumn("replacement", F.coalesce("replacement", F.lit("")))
    kept = kept.where("type = 'literal'") if literal else kept
    earlier = kept.select("pass_name", earlier_key.alias("key"), F.col("rule_id").alias("earlier_id"), F.col("place").alias("_e"), F.col("replacement").alias("_er")).where("key <> ''")
    later = kept.select("pass_name", F.explode(later_keys).alias("key"), F.col("rule_id").alias("later_id"), F.col("place").alias("_l"), F.col("replacement").alias("_lr"))
    return by_shuffle(earlier).join(later, ["pass_name", "key"]).where("_e < _l").select(F.lit(kind).alias("kind"), "pass_name", "earlier_id", "later_id", "_er", "_lr")


def masked_rules(rules: DataFrame) -> DataFrame:
    """Literal rules behind a literal rule that is a prefix of theirs."""
    return _pairs(rules, F.col("pattern"), _prefixes(F.col("pattern")), "masked", True).drop("_er", "_lr")


def conflicting_rules(rules: DataFrame) -> DataFrame:
    """Literal rules that contain an earlier, shorter one with another replacement; and rules that
    rewrite what an earlier one has written."""
    short = _pairs(rules, F.col("pattern"), _shorter_substrings(F.col("pattern")), "short_first", True)
    chain = _pairs(rules, F.col("replacement"), F.array("pattern"), "chain", False)
    chain = chain.where("_er <> _lr")
    return short.where("_er <> _lr").unionAll(chain).drop("_er", "_lr")


def regex_hazards(rules: DataFrame) -> DataFrame:
    """One row for each hazard of an enabled regex rule."""
    pattern = F.col("pattern")
    tests = [
        ("dot_greedy", pattern.rlike(DOT_GREEDY)),
        ("unbounded_negation", pattern.rlike(UNBOUNDED_NEGATION)),
        ("many_lookaheads", (F.length(pattern) - F.length(F.replace(pattern, F.lit("(?!"), F.lit("")))) / 3 >= MANY_LOOKAHEADS),
        ("deletes_blanks", (F.col("pass_name") != "normalization") & pattern.contains(r"\s+") & (F.coalesce("replacement", F.lit("")) == "")),
    ]
    found = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))
    return rules.where("enabled and type = 'regex' and pattern <> ''").select("pass_name", "rule_id", F.explode(found).alias("hazard"))
