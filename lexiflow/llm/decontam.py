"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are runs of digits, ASCII letters (A-Z lower-cased) and all characters beyond ASCII. A window
is 10 consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
A document's word is hit if it is inside any occurrence of a window.

Winnowing finds the documents worth a look: of the hashes of all runs of k words (k = 5) the smallest
in each stretch of 10 - k + 1 runs is a fingerprint. It depends on the stretch's 10 words
alone, so a document that has a window has the window's fingerprint, too. Documents' distinct
fingerprints are joined with the benchmark's; then the hits are extended: in documents with a
shared fingerprint all windows are compared with the benchmark's as text, so that a chance
equality of hashes can't add anything. Shorter items use the same way with their own length, and
documents are only winnowed for the lengths that occur.

Up to ``MAX_LITERALS`` fingerprints of the benchmark are a set in the plan, and one pass over the texts counts their words
and finds those with a shared fingerprint; only these are kept. Beyond that, fingerprints are joined, and broadcast only if Spark finds them below its size
threshold; the results are the same. A window that many items have is joined to them once a document. Documents are aggregated by their own key,
so a passage in very many documents makes no large group.

Null and empty texts have no words. Null item ids hit words, but are not among the items. Rows that
repeat an id and text each get a result. An empty table on either side gives no hits. Only the id
and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, let, lower_ascii

WINDOW = 10
GRAM = 5
MAX_LITERALS = 50_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")


def places(array: Column, size: int) -> Column:
    """1-based places at which a run of ``size`` elements starts; none in shorter arrays."""
    return F.when(F.size(array) >= size, F.sequence(F.lit(1), F.size(array) - (size - 1))).otherwise(F.array().cast("array<int>"))


def fingerprints(words: Column, window: int, gram: int) -> Column:
    """Distinct winnowed hashes: the smallest of each stretch of window - gram + 1 hashes."""
    return let(words, lambda w: F.array_distinct(_winnowed(w, window, gram)))


def _winnowed(words: Column, window: int, gram: int) -> Column:
    """The same with repeats; words is a lambda's variable."""
    width = window - gram + 1
    hashes = lambda w: F.transform(places(w, gram), lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(gram))))
    least = lambda h: F.transform(places(h, width), lambda i: F.least(*(F.get(h, i + (j - 1)) for j in range(width))) if width > 1 else F.get(h, i - 1))
    return let(hashes(words), least)


def runs(words: Column, size: int) -> Column:
    """Text of each run of ``size`` words, with its 1-based place."""
    return F.transform(places(words, size), lambda i: F.struct(i.alias("at"), F.array_join(F.slice(words, i, F.lit(size)), " ").alias("run")))


def _runs_in(words: Column, size: int) -> Column:
    return let(words, lambda w: runs(w, size))


def benchmark_windows(items: DataFrame, *, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(item_id, size, run, words): distinct windows, with their words."""
    split = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    whole = F.array(F.struct(F.lit(1).alias("at"), F.array_join("words", " ").alias("run")))
    size = F.least(F.size("words"), F.lit(window))
    each = F.when(F.size("words") < window, whole).otherwise(runs(F.col("words"), window))
    return split.select("item_id", size.alias("size"), F.explode(each).alias("_w")).select("item_id", "size", "_w.run").distinct().withColumn("words", F.split("run", " "))


def find_contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_literals: int = MAX_LITERALS
) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs."""
    return judged(docs, items, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, window=window, gram=gram, max_literals=max_literals).drop("_key")


def judged(
    docs: DataFrame, items: DataFrame, *, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, max_literals: int = MAX_LITERALS
) -> DataFrame:
    """:func:`find_contamination` with _key, the hash of the row's text."""
    windows = cut(benchmark_windows(items, id_col=item_col, text_col=item_text_col, window=window))
    sizes = sorted(r.size for r in windows.select(F.col("size")).distinct().collect())  # at most ``window`` numbers
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col), text.alias("_text"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_key"))
    grams = {size: min(gram, size) for size in sizes}
    marks = {size: cut(windows.where(F.col("size") == size).select(F.explode(fingerprints(F.col("words"), size, k)).alias("_mark")).distinct()) for size, k in grams.items()}
    n_marks = sum(m.count() for m in marks.values())

    if n_marks <= max_literals:
        # one pass over the texts: their number of words, and the texts worth a look
        sets = {size: [r[0] for r in m.collect()] for size, m in marks.items()}
        shared = lambda w, size: F.exists(_winnowed(w, size, grams[size]), lambda x: x.isin(sets[size]))
        looked = let(words_of(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.array(*(shared(w, size) for size in sizes)).alias("at")))
        seen = keyed.select(id_col, "_id", "_key", "_text", looked.alias("_l"))
        wanted = F.when(F.exists("_l.at", lambda x: x), F.col("_text"))
        base = cut(seen.select(id_col, "_id", "_key", F.col("_l.n").alias("n_words"), F.col("_l.at").alias("_at"), wanted.alias("_text")))
        texts = {size: base.where(F.get("_at", F.lit(i))).dropDuplicates(["_id", "_key"]) for i, size in enumerate(sizes)}
        counted = base.drop("_text", "_at")
    else:
        # the words are split within the array functions, so the rows that explode makes carry the key alone
        texts = {}
        for size, of_size in marks.items():
            marked = keyed.select("_id", "_key", F.explode(fingerprints(words_of(F.col("_text")), size, grams[size])).alias("_mark"))
            found = cut(marked.join(of_size, "_mark").select("_id", "_key").distinct())
            texts[size] = keyed.join(found, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
        counted = keyed.withColumn("n_words", count_words(F.col("_text"))).drop("_text")

    hits = None
    for size in sizes:
        places_of = texts[size].select("_id", "_key", F.explode(_runs_in(words_of(F.col("_text")), size)).alias("_r")).select("_id", "_key", "_r.at", "_r.run")
        known = windows.where(F.col("size") == size).select("run").distinct()
        here = places_of.join(known, "run").select("_id", "_key", "at", "run", F.lit(size).alias("size"))
        hits = here if hits is None else hits.unionByName(here)
    none, zero = F.sha2(F.lit(""), 256), F.lit(0).cast("long")
    if hits is None:
        return counted.select(id_col, "_key", "n_words", zero.alias("n_hit"), zero.alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    hits = cut(hits)
    covered = hits.groupBy("_id", "_key").agg(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1)).alias("_hits"))
    # a window counts once a document before it meets the items that have it
    meant = hits.select("_id", "_key", "run", "size").distinct().join(windows.select("run", "size", "item_id"), ["run", "size"]).groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"))
    per_doc = cut(
        covered.join(meant, ["_id", "_key"], "left").select(
            "_id",
            "_key",
            F.size(F.array_distinct(F.flatten("_hits"))).cast("long").alias("_n_hit"),
            F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("_n_items"),
            F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("_sha"),
        )
    )
    return counted.join(per_doc, ["_id", "_key"], "left").select(
        id_col,
        "_key",
        "n_words",
        F.coalesce("_n_hit", zero).alias("n_hit"),
        F.coalesce("_n_items", zero).alias("n_items"),
        F.coalesce("_sha", none).alias("items_sha256"),
        (F.coalesce("_n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs without a hit, with all their columns. Each row is judged by its own id and text."""
    hit = judged(docs, items, id_col=id_col, text_col=text_col, **more).where("contaminated").select(F.col(id_col).alias("_goes"), F.col("_key").alias("_gone")).distinct()
    # the row as a whole, so that none of its columns' names can clash
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("of"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    return packed.join(hit, F.col("of").eqNullSafe(F.col("_goes")) & (F.col("key") == F.col("_gone")), "left_anti").select("row.*")
