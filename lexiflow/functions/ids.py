"""Stable ids: a prefix and twelve hex digits of a SHA-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _id(prefix: str, *parts: Column) -> Column:
    # concat_ws leaves nulls out, so they become empty first
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 12))


def entry_id(src: Column, tgt: Column, level: Column, tier: Column, source: Column) -> Column:
    return _id("lx_", src, tgt, level, tier, source)


def rule_id(pass_name: Column, pattern: Column, replacement: Column) -> Column:
    return _id("rl_", pass_name, pattern, replacement)


def review_id(canonical_json: Column) -> Column:
    """canonical_json: the item with sorted keys, ``", "`` and ``": "`` as separators."""
    return _id("rq_", canonical_json)
