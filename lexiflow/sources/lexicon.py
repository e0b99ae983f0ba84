"""Readers and writers of lexicon, rule and review data: JSON lines, JSON documents and term lists.

Any path that Spark reads will do. Missing paths give empty relations where noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lexiflow.functions.ids import entry_id, rule_id
from lexiflow.functions.normalize import trim_outer
from lexiflow.operators.policy import trust
from lexiflow.operators.review import canonical, with_ids
from lexiflow.schema import DECISION, ENTRY, LEVELS, PASSES, REVIEW, RULE


def _lines(spark: SparkSession, path: str, missing_ok: bool) -> DataFrame:
    """(line_no, value) of trimmed, non-empty lines. Line numbers count the lines of all files in the order of
    their names, however the files are split: a block's lines are numbered from where the blocks before it end."""
    try:
        text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    except AnalysisException as e:
        if not missing_ok or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line_no long, value string")
    # one row a block: few, whatever their size
    blocks = text.groupBy("_file", "_block").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = text.join(F.broadcast(blocks.select("_file", "_block", "_first", before.alias("_before"))), ["_file", "_block"])
    line_no = (F.col("_before") + F.col("_row") - F.col("_first") + 1).alias("line_no")
    return placed.select(line_no, trim_outer(F.col("value")).alias("value")).where("value <> ''")


def parsed(value: Column, schema: str, strict: bool) -> Column:
    return F.from_json(value, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def read_jsonl(spark: SparkSession, path: str, schema: str, *, comments: bool = True, missing_ok: bool = True) -> DataFrame:
    """Rows of a JSON-lines file, with line_no; malformed lines fail. comments: lines with # are skipped."""
    return _records(_lines(spark, path, missing_ok), comments).select("line_no", parsed(F.col("value"), schema, True).alias("r")).select("line_no", "r.*")


def _records(lines: DataFrame, comments: bool) -> DataFrame:
    """The lines that are records. A filter wouldn't do: Spark may evaluate what comes after it first, and
    a comment is malformed and lacks all that an entry must have. No row of another line leaves explode."""
    is_record = (F.col("value") != "") & ~F.col("value").startswith("#") if comments else F.col("value") != ""
    return lines.select("line_no", F.explode(F.when(is_record, F.array("value"))).alias("value"))


def from_values(df: DataFrame, schema: str, *, lenient: bool = False) -> DataFrame:
    """Rows of a column ``value`` of JSON; with lenient malformed ones are dropped."""
    if not lenient:
        return df.select(parsed(F.col("value"), schema, True).alias("r")).select("r.*")
    got = df.select(parsed(F.col("value"), f"{schema}, _corrupt string", False).alias("r")).select("r.*")
    return got.where("_corrupt is null").drop("_corrupt")


def with_entry_defaults(rows: DataFrame) -> DataFrame:
    default = {"tgt": F.lit(""), "priority": F.lit(0), "score": F.lit(0.0), "status": F.lit("active"), "source": F.lit(""), "updated_by": F.lit("system"), "updated_at": F.lit("")}
    rows = rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in default.items()})
    for name in ("entry_id", "src", "level", "tier"):
        rows = rows.withColumn(name, F.when(F.col(name).isNotNull(), F.col(name)).otherwise(F.raise_error(F.lit(f"an entry lacks {name}"))))
    return rows.withColumn("trust", trust())


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return with_entry_defaults(read_jsonl(spark, path, ENTRY))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, RULE)
    return rows.withColumns({"type": F.coalesce("type", F.lit("literal")), "replacement": F.coalesce("replacement", F.lit("")), "priority": F.coalesce("priority", F.lit(0)), "enabled": F.coalesce("enabled", F.lit(True)), "note": F.coalesce("note", F.lit(""))})


def core_entries(rows: DataFrame) -> DataFrame:
    """Rows of a core lexicon (ENTRY's columns) with its defaults; the tier is always core."""
    strip = lambda c: trim_outer(F.coalesce(F.col(c), F.lit("")))
    level = F.coalesce("level", F.lit("phrase"))
    rows = rows.withColumns({"src": strip("src"), "tgt": strip("tgt"), "level": level, "tier": F.lit("core")})
    bad = (F.col("src") == "") | (F.col("tgt") == "") | ~F.col("level").isin(*LEVELS)
    rows = rows.withColumn("src", F.when(bad, F.raise_error(F.lit("a core entry lacks src or tgt or has no known level"))).otherwise(F.col("src")))
    source = F.coalesce("source", F.lit("core:lexicon"))
    rows = rows.withColumns(
        {"source": source, "priority": F.coalesce("priority", F.when(F.col("level") == "char", 80).otherwise(800)), "score": F.coalesce("score", F.lit(1.0)), "status": F.coalesce("status", F.lit("active")), "trust": F.coalesce("trust", F.lit("human")), "updated_by": F.coalesce("updated_by", F.lit("system")), "updated_at": F.coalesce("updated_at", F.lit(""))}
    )
    return rows.withColumn("entry_id", F.coalesce("entry_id", entry_id(F.col("src"), F.col("tgt"), F.col("level"), F.col("tier"), F.col("source"))))


def read_core(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of core entries; a missing file is an empty core."""
    try:
        return core_entries(spark.read.schema(ENTRY).json(path, multiLine=True, mode="FAILFAST"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return core_entries(spark.createDataFrame([], ENTRY))


def terms_of(lines: DataFrame) -> DataFrame:
    """(term) of a column ``value``: stripped, distinct, without comments."""
    term = trim_outer(F.col("value"))
    return lines.select(term.alias("term")).where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return terms_of(_lines(spark, path, True))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Lines that begin with # aren't comments here, and a missing file is an error."""
    return read_jsonl(spark, path, DECISION, comments=False, missing_ok=False)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Queue rows; evidence is kept as JSON. Items without an id get one from the whole line."""
    lines = _records(_lines(spark, path, True), True)
    rows = lines.select("line_no", "value", parsed(F.col("value"), REVIEW, True).alias("r")).select("line_no", "value", "r.*")
    lacking = F.coalesce("review_id", F.lit("")) == ""
    return with_ids(rows.withColumn("canonical", F.when(lacking, canonical(F.when(lacking, F.col("value")))))).drop("value", "canonical")


def decode_entry_table(artifact: DataFrame) -> DataFrame:
    """A compact table (k: defaults by kind; e: rows that refer to a kind by place) as entries."""
    kinds = artifact.select(F.posexplode("k").alias("_kind", "_k")).select("_kind", "_k.level", "_k.tier", "_k.trust", F.col("_k.priority").alias("_p"), F.col("_k.score").alias("_s"))
    rows = artifact.select(F.posexplode("e").alias("place", "_e")).select("place", "_e.id", "_e.src", "_e.tgt", F.col("_e.kind").alias("_kind"), "_e.priority", "_e.score")
    return rows.join(F.broadcast(kinds), "_kind").select("place", F.col("id").alias("entry_id"), "src", "tgt", "level", "tier", "trust", F.coalesce("priority", "_p").alias("priority"), F.coalesce("score", "_s").alias("score"))


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(value) of a JSON document of any layout, one row a file."""
    return spark.read.text(path, wholetext=True)


def entry_refs(raw: Column, size: int) -> Column:
    """A reference to entries (a place, an entry's id, or a list of both; as JSON text) as an array of (place, id) of
    which one is set; places beyond the table of that size and what is neither are left out."""
    listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    one = lambda r: F.struct(F.when(r.rlike(r"^-?[0-9]{1,9}$"), r.cast("int")).alias("place"), F.when(~r.rlike(r"^-?[0-9]{1,9}$"), r).alias("id"))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), one), lambda r: r["id"].isNotNull() | r["place"].between(0, size - 1))


def _resolved_refs(keyed: DataFrame, raw: str, entries: DataFrame) -> DataFrame:
    """keyed with column place: a row for each entry that the references name, in their order (column at). entries: (place, entry_id)."""
    size = entries.count()
    rows = keyed.select("*", F.posexplode(entry_refs(F.col(raw), size)).alias("at", "_r"))
    named = entries.select(F.col("place").alias("_place"), F.col("entry_id").alias("_id"))
    joined = rows.join(named, F.col("_r.id") == F.col("_id"), "left").withColumn("place", F.coalesce("_r.place", "_place"))
    return joined.where("place is not null").drop("_r", "_id", "_place", raw)


def decode_char_map(document: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, at, place) of a character map, compact (m) or legacy (map); document: (value)."""
    got = document.select(F.from_json("value", "m map<string,string>, map map<string,string>").alias("d"))
    keyed = got.select(F.explode(F.coalesce("d.m", "d.map")).alias("src", "_raw")).where("src <> ''")
    return _resolved_refs(keyed, "_raw", entries)


def decode_override_index(document: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, at, place) of sentence overrides and (at, place) of contextual ones, compact (s, c) or legacy."""
    got = document.select(F.from_json("value", "s map<string,string>, c string, sentence_override_map map<string,string>, contextual_override_ids string").alias("d"))
    keyed = got.select(F.explode(F.coalesce("d.s", "d.sentence_override_map")).alias("src", "_raw")).where("src <> ''")
    listed = got.select(F.coalesce("d.c", "d.contextual_override_ids", F.lit("[]")).alias("_raw"))
    return _resolved_refs(keyed, "_raw", entries), _resolved_refs(listed, "_raw", entries)


def decode_rule_plan(document: DataFrame) -> DataFrame:
    """Rules (RULE's columns and place, the place within the pass) of a rule plan: rows of [pattern, replacement, 1 for a regex, priority] by
    pass (r), or the legacy form, passes by name with objects (id, k, p, r, priority, enabled, note)."""
    legacy = "struct<id:string,k:string,p:string,r:string,rule_id:string,type:string,pattern:string,replacement:string,priority:int,enabled:boolean,note:string>"
    got = document.select(F.from_json("value", f"r array<array<array<string>>>, rules map<string,array<{legacy}>>").alias("d"))
    rows = got.select(F.posexplode("d.r").alias("_pass", "_rows")).where(F.col("_pass") < len(PASSES)).select(F.element_at(F.array(*map(F.lit, PASSES)), F.col("_pass") + 1).alias("pass_name"), F.posexplode("_rows").alias("place", "x"))
    compact = rows.where("size(x) >= 2").select(
        "pass_name", "place", F.col("x")[0].alias("pattern"), F.col("x")[1].alias("replacement"),
        F.when(F.get("x", F.lit(2)) == "1", "regex").otherwise("literal").alias("type"), F.coalesce(F.get("x", F.lit(3)).cast("int"), F.lit(0)).alias("priority"), F.lit(True).alias("enabled"), F.lit("").alias("note"),
    ).withColumn("rule_id", rule_id(F.col("pass_name"), F.col("pattern"), F.col("replacement")))
    old = got.select(F.explode("d.rules").alias("pass_name", "_rows")).select("pass_name", F.posexplode("_rows").alias("place", "x"))
    short = F.col("x.id").isNotNull() & F.col("x.p").isNotNull()
    kind = F.when(short, F.when(F.col("x.k") == "r", "regex").otherwise("literal")).otherwise(F.coalesce("x.type", F.lit("literal")))
    named = old.select(
        "pass_name", "place", F.coalesce("x.p", "x.pattern").alias("pattern"), F.coalesce("x.r", "x.replacement", F.lit("")).alias("replacement"), kind.alias("type"),
        F.coalesce("x.priority", F.lit(0)).alias("priority"), F.coalesce("x.enabled", F.lit(True)).alias("enabled"), F.coalesce("x.note", F.lit("")).alias("note"), F.coalesce("x.id", "x.rule_id").alias("rule_id"),
    )
    return compact.unionByName(named)


def write_jsonl(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row, written as text; nulls are written, too."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def valid_refs(refs: Column, size: int) -> Column:
    """Those elements of an array that are places in a table of that size."""
    return F.filter(refs, lambda i: (i >= 0) & (i < size))
