"""Phrase matching by leftmost-maximum selection.

With one entry for each source text and no reserved spans, leftmost-maximum is leftmost-longest, and
a trie-shaped regular expression finds it. :func:`replace_phrases` is then one projection without
shuffle or Python; :func:`match_rows` gives the matches with their offsets and meets the
lexicon in a join that Spark broadcasts only below its size threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_INLINE = 500


def trie_pattern(words: list[str]) -> str:
    """A pattern for the words that prefers the longest at every start."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    # deepest nodes first, without recursion: words may be long
    order, waiting = [], [root]
    while waiting:
        order.append(node := waiting.pop())
        waiting += [child for c, child in node.items() if c]
    written: dict[int, str] = {}
    for node in reversed(order):
        arms = [re.escape(c) + written.pop(id(child)) for c, child in sorted(node.items()) if c]
        body = "" if not arms else arms[0] if len(arms) == 1 else "(?:" + "|".join(arms) + ")"
        written[id(node)] = f"(?:{body})?" if arms and "" in node else body
    return written[id(root)]


def best_entries(entries: DataFrame) -> DataFrame:
    """The entry that wins for each source text: by layer rank, priority, score, id. The span
    decides first, but is the same for one source text, so this needs no text at all."""
    order = Window.partitionBy("src").orderBy("layer_rank", F.col("priority").desc(), F.col("score").desc(), "entry_id")
    return entries.where("src <> ''").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _pieces(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def replace_phrases(df: DataFrame, pairs: dict[str, str], *, text_col: str = "text") -> DataFrame:
    """df with every leftmost-longest source text of ``pairs`` replaced."""
    if not pairs:
        return df
    if len(pairs) > MAX_INLINE:
        return _replace_many(df, pairs, text_col)
    pattern, text = trie_pattern(list(pairs)), F.col(text_col)
    table = F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))
    gaps, found = _pieces(text, pattern)
    joined = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.element_at(table, m), F.lit("")))), "")
    return df.withColumn(text_col, F.when(text.rlike(pattern), joined).otherwise(text))


def _replace_many(df: DataFrame, pairs: dict[str, str], text_col: str) -> DataFrame:
    """A literal map is searched linearly; many pairs go through Arrow batches and a hash table."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pattern = re.compile(trie_pattern(list(pairs)))
        for batch in batches:
            yield pd.Series([None if t is None else pattern.sub(lambda m: pairs[m[0]], t) for t in batch], dtype=object)

    return df.withColumn(text_col, run(text_col))


def match_spans(text: Column, pattern: str) -> Column:
    """array of (start, end, src) of the leftmost-longest matches; offsets are code points."""
    gaps, found = _pieces(text, pattern)
    empty = F.array().cast("array<struct<start:int,end:int,src:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["0"])
        end = start + F.coalesce(F.length(pair["1"]), F.lit(0))
        span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), pair["1"].alias("src"))
        return F.struct(end.cast("int").alias("at"), F.when(pair["1"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    zipped = F.arrays_zip(gaps.alias("0"), found.alias("1"))
    spans = F.aggregate(zipped, F.struct(F.lit(0).cast("int").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def match_rows(df: DataFrame, entries: DataFrame, words: list[str], *, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """A row for each match: ids, start, end, src, and the entry's other columns."""
    spans = df.select(*id_cols, F.explode(match_spans(F.col(text_col), trie_pattern(words))).alias("_m")).select(*id_cols, "_m.start", "_m.end", "_m.src")
    return spans.join(entries, "src")


def phrase_hits(df: DataFrame, words: list[str], *, text_col: str = "text") -> DataFrame:
    """(src, hits) over all rows; counts combine before the shuffle."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(trie_pattern(words)), F.lit(0))
    return df.select(F.explode(found).alias("src")).groupBy("src").agg(F.count(F.lit(1)).alias("hits"))


def occurrences(text: Column, words: list[str]) -> Column:
    """array of (start, end, src) of all occurrences, overlapping ones too. For few words:
    each is looked for on its own by a lookahead."""
    each = []
    for word in words:
        spans = match_spans_of(text, word)
        each.append(spans)
    return F.array_sort(F.concat(*each)) if each else F.array().cast("array<struct<start:int,end:int,src:string>>")


def match_spans_of(text: Column, word: str) -> Column:
    """All starts of one word: split before each, the pieces' lengths add up to the starts."""
    empty = F.array().cast("array<struct<start:int,end:int,src:string>>")

    def step(state: Column, piece: Column) -> Column:
        span = F.struct(state["at"].alias("start"), (state["at"] + len(word)).cast("int").alias("end"), F.lit(word).alias("src"))
        return F.struct(
            (state["at"] + F.length(piece)).cast("int").alias("at"), F.when(piece.startswith(word), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans")
        )

    pieces = F.split(text, f"(?={re.escape(word)})", -1)
    spans = F.aggregate(pieces, F.struct(F.lit(0).cast("int").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.contains(word), spans).otherwise(empty)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def leftmost_maximum(spans: Column, reserved: Column) -> Column:
    """The chosen spans: those that overlap a reserved one go; of one start the longest stays; then
    from left to right each that begins at or after the end of the one before."""
    free = F.array_sort(F.transform(F.filter(spans, lambda s: ~F.exists(reserved, lambda r: overlaps(s, r))), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["src"].alias("src"))))
    empty = F.array().cast("array<struct<start:int,end:int,src:string>>")

    def step(state: Column, s: Column) -> Column:
        span = F.struct(s["start"].cast("int").alias("start"), (-s["less"]).cast("int").alias("end"), s["src"].alias("src"))
        taken = F.struct((-s["less"]).cast("int").alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))
        return F.when(s["start"] >= state["at"], taken).otherwise(state)

    return F.aggregate(free, F.struct(F.lit(0).cast("int").alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def splice(text: Column, spans: Column, replacement) -> Column:
    """text with each of the ordered, separate spans replaced by ``replacement(span)``."""
    step = lambda state, s: F.struct(
        s["end"].alias("at"), F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), replacement(s))).alias("out")
    )
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(spans, start, step, lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), ""))


def protected_spans(text: Column, terms: list[str], phrases: Column) -> Column:
    """Spans of protected terms to keep as they are: from the left, the longest term at a start, unless
    a phrase occurrence crosses its edge (a term that is the whole text is always kept)."""
    found = F.array_sort(F.transform(occurrences(text, terms), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["src"].alias("src"))))
    longest = F.filter(found, lambda s: ~F.exists(found, lambda o: (o["start"] == s["start"]) & (o["less"] < s["less"])))
    spans = F.transform(longest, lambda s: F.struct(s["start"].cast("int").alias("start"), (-s["less"]).cast("int").alias("end"), s["src"].alias("src")))
    crossed = lambda s: F.exists(phrases, lambda p: overlaps(p, s) & ~((p["start"] >= s["start"]) & (p["end"] <= s["end"])))
    kept = F.filter(spans, lambda s: ((s["start"] == 0) & (s["end"] == F.length(text))) | ~crossed(s))
    return leftmost_maximum(kept, F.array().cast("array<struct<start:int,end:int,src:string>>"))
