"""Trust, exclusion policy and ranks of lexicon entries, as column expressions over the entry relation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiflow.functions.normalize import HAN, trim_outer
from lexiflow.schema import PASSES, TIERS, TRUSTS, UNRANKED

# Fixed values.
MACHINE_UPDATERS = ("itaigi_full", "itaigi_bot", "codex")
MACHINE_SOURCES = ("review_queue",)
LONG_PHRASE = 8
STRONG_PREFIXES = ("泛指", "比喻", "形容", "表示", "指", "古書上", "傳說中")
SOFT_PREFIXES = ("一種", "一個", "一位", "一條", "一片", "一粒", "一隻", "一頭", "從事", "用來", "使人", "使在", "使勁", "使水")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _stripped(name: str) -> Column:
    return trim_outer(_text(name))


def inferred_trust() -> Column:
    source, by, tier = _stripped("source"), _stripped("updated_by"), _stripped("tier")
    return (
        F.when(source.isin(*MACHINE_SOURCES) & by.isin(*MACHINE_UPDATERS), "machine")
        .when(source.startswith("user:"), "human")
        .when(tier.isin("manual", "manual_hotfix") & (source == "review_queue"), "human")
        .otherwise("seed")
    )


def trust() -> Column:
    given = _stripped("trust")
    return F.when(given.isin(*TRUSTS), given).otherwise(inferred_trust())


def has_context() -> Column:
    return F.col("context").isNotNull() & F.coalesce(*(F.col(f"context.{n}") for n in ("left_regex", "right_regex", "full_regex", "left_literal", "right_literal"))).isNotNull()


def is_trusted_manual() -> Column:
    return F.col("tier").isin("manual", "manual_hotfix") & (_text("trust") == "human")


def is_sentence_override() -> Column:
    return (F.col("level") == "sentence") & is_trusted_manual() & ~has_context() & (F.col("status") == "active")


def _phrase() -> Column:
    return F.col("level").isin("phrase", "sentence")


def _low_trust() -> Column:
    return F.col("tier").isin("base", "domain") & _text("trust").isin("seed", "machine") & _phrase()


def exclusions() -> list[tuple[str, Column]]:
    """(reason, predicate) in the order in which they are tried."""
    src, tgt, length = _text("src"), _text("tgt"), F.length(_text("src"))
    strong, soft = (src.rlike(f"^(?:{'|'.join(p)})") for p in (STRONG_PREFIXES, SOFT_PREFIXES))
    return [
        ("noop_manual_hotfix", (F.col("tier") == "manual_hotfix") & _phrase() & (_text("trust") == "machine") & (src == tgt)),
        ("single_char_machine_override", (_text("trust") == "machine") & _phrase() & (length == 1)),
        ("single_char_low_trust_phrase", _low_trust() & (length == 1)),
        ("low_trust_long_phrase", _low_trust() & (length >= LONG_PHRASE)),
        ("definition_like_low_trust_phrase", _low_trust() & (length >= 4) & (strong | soft & (src.contains("的") | (length >= LONG_PHRASE)))),
        ("non_hanji_target", F.col("tier").isin("base", "domain", "manual_hotfix") & _text("trust").isin("seed", "machine") & F.col("level").isin("phrase", "sentence", "char") & ~tgt.rlike(f"[{HAN}]")),
    ]


def exclusion_reason() -> Column:
    return F.coalesce(*(F.when(test, F.lit(reason)) for reason, test in exclusions()))


def layer_rank() -> Column:
    hotfix = (F.col("tier") == "manual_hotfix") & (_text("trust") == "machine")
    return (
        F.when(F.col("tier") == "blocked", 0)
        .when(is_sentence_override(), 1)
        .when(is_trusted_manual(), 2)
        .when((F.col("tier") == "core") & _phrase(), 3)
        .when((F.col("tier") == "domain") & _phrase(), 4)
        .when((F.col("tier") == "base") & _phrase(), 5)
        .when(hotfix & _phrase(), 6)
        .when(F.col("level") == "char", 7)
        .otherwise(99)
    )


def _index(name: str, order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*map(F.lit, order)), _text(name))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(UNRANKED)


def tier_index() -> Column:
    return _index("tier", TIERS)


def pass_index() -> Column:
    return _index("pass_name", PASSES)


def entry_order() -> list[Column]:
    return [tier_index().asc(), F.col("priority").desc(), F.length("src").desc(), F.col("score").desc(), F.col("entry_id").asc()]


def sort_key() -> list[Column]:
    """The same order as ascending columns, for structs."""
    return [tier_index().alias("_tier"), (-F.col("priority")).alias("_priority"), (-F.length("src")).alias("_length"), (-F.col("score")).alias("_score"), F.col("entry_id")]


def rule_order() -> list[Column]:
    return [pass_index().asc(), F.col("priority").desc(), F.col("rule_id").asc()]
