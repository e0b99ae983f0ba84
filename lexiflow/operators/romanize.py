"""Romanisation with a pluggable converter, and patches for what it gets wrong."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patches by tone format.
PATCHES = {
    "number": {"妳": "li2", "您": "lin2", "她": "i1", "嗎": "ma0", "嘸": "bo5", "呣": "m7"},
    "mark": {"妳": "lí", "您": "lín", "她": "i", "嗎": "ma", "嘸": "bô", "呣": "m̄"},
    "strip": {"妳": "li", "您": "lin", "她": "i", "嗎": "ma", "嘸": "bo", "呣": "m"},
}


def patch(text: Column, tone_format: str = "number", patches: dict[str, str] | None = None) -> Column:
    """Characters that the converter left, in the order of the map; with numbers also their digit.
    An unknown format takes the number map, but is replaced literally."""
    for char, roman in (patches or PATCHES.get(tone_format, PATCHES["number"])).items():
        if tone_format == "number":
            text = F.regexp_replace(text, re.escape(char) + "[0-9]?", roman.replace("\\", "\\\\").replace("$", "\\$"))
        else:
            text = F.replace(text, F.lit(char), F.lit(roman))
    return text


def romanize(df: DataFrame, convert: Callable[[str], str], *, text_col: str, out_col: str = "romanized", tone_format: str = "number") -> DataFrame:
    """df with out_col: ``convert`` in Arrow batches, then the patches."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: None if t is None else str(convert(t)))

    return df.withColumn(out_col, patch(run(text_col), tone_format))
