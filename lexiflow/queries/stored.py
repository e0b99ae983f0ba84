"""Queries that write with the library's sinks and read back with its sources, with DuckDB SQL for what has to come back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import normalize as norm
from lexiflow.operators import dom, review, romanize, rules
from lexiflow.plans import artifacts
from lexiflow.plans import rewrite as rw
from lexiflow.queries import core, whole
from lexiflow.queries.core import IDENTITY_SQL, JUDGE_SQL, OVERRIDE_SQL, RANK_SQL, REASON_SQL, RULES, WITH_TRUST, _resolved, _sql, _table, lexicon, query, rule_table
from lexiflow.sources import lexicon as src
from lexiflow.streaming import rewrite_stream


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share; a local one only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="lexiflow-")
    return f"{top.rstrip('/')}/stored-{uuid.uuid4().hex}"


def as_lines(df: DataFrame) -> DataFrame:
    """(value): a JSON line for each row, and comments and blank lines between them."""
    line = F.to_json(F.struct(*df.columns))
    return df.select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.concat(F.lit(" "), line))).alias("value"))


@query(f"{WITH_TRUST} SELECT entry_id, src, tgt, tier, level, priority, status, trust, ctx AS right_literal FROM l")
def entries_from_lines(spark, sf_dir):
    as_lines(lexicon(spark, sf_dir)).write.text(path := scratch(spark))
    return src.read_entries(spark, path).select("entry_id", "src", "tgt", "tier", "level", "priority", "status", "trust", F.col("context.right_literal").alias("right_literal"))


@query(f"WITH r AS ({RULES}) SELECT rule_id, pass_name, CASE WHEN type = 'regex' THEN 'regex' ELSE 'literal' END AS type, pattern, replacement, CASE WHEN priority > 20 THEN priority ELSE 0 END AS priority, enabled OR priority <= 20 AS enabled FROM r")
def rules_from_lines(spark, sf_dir):
    given = rule_table(spark, sf_dir).withColumns({"type": F.when(F.col("type") == "regex", "regex"), "enabled": F.when(F.col("priority") > 20, F.col("enabled")), "priority": F.when(F.col("priority") > 20, F.col("priority")), "replacement": F.nullif("replacement", F.lit(""))})
    as_lines(given).write.text(path := scratch(spark))
    return src.read_rules(spark, path).select("rule_id", "pass_name", "type", "pattern", "replacement", "priority", "enabled")


@query(f"SELECT row_number() OVER (ORDER BY line_no) AS line_no, review_id, decision, src FROM ({core.DECISIONS})")
def decisions_from_lines(spark, sf_dir):
    given = _sql(spark, sf_dir, core.DECISIONS, "labels").orderBy("line_no")
    src.write_jsonl(given.drop("line_no"), path := scratch(spark))
    return src.read_decisions(spark, path).select("line_no", "review_id", "decision", "src")


ITEM_ID = """'rq_' || substr(sha1('{"doc_id": ' || doc_id || ', "quality": ' || quality || '}'), 1, 12)"""


@query(f"SELECT review_id, status, count(*) AS n FROM (SELECT {ITEM_ID} AS review_id, 'pending' AS status FROM labels UNION ALL SELECT {ITEM_ID}, 'pending' FROM labels WHERE quality = 1) GROUP BY ALL")
def queue_from_lines(spark, sf_dir):
    """Items appended in two goes, of which the first have no id yet."""
    labels, path = _table(spark, sf_dir, "labels").select("doc_id", "quality"), scratch(spark)
    canonical = review.canonical(F.to_json(F.struct("doc_id", "quality")))
    review.append(review.complete(labels, canonical), path)
    review.append(review.complete(labels.where("quality = 1"), canonical), path)
    return src.read_reviews(spark, path).groupBy("review_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'rq_' || substr(sha1('{{"kind": "k", "owner": "' || doc_id || '"}}'), 1, 12) AS review_id, CAST(doc_id AS VARCHAR) AS owner FROM labels""")
def ids_backfilled(spark, sf_dir):
    """Items that were written without ids."""
    _table(spark, sf_dir, "labels").select(F.format_string('{"owner":"%d",   "kind":"k"}', "doc_id").alias("value")).write.text(path := scratch(spark))
    return src.read_reviews(spark, path).select("review_id", "owner")


@query(f"{JUDGE_SQL} SELECT review_id, decision AS action, CAST(CASE WHEN decision = 'disable_base_entry' THEN n_base END AS BIGINT) AS disabled_count FROM j WHERE error IS NULL")
def audit_from_lines(spark, sf_dir):
    review.append(_resolved(spark, sf_dir).audit, path := scratch(spark))
    return spark.read.schema("review_id string, action string, result struct<disabled_count:long>").json(path).select("review_id", "action", "result.disabled_count")


@query(
    f"""{JUDGE_SQL} SELECT entry_id, CASE WHEN tier = 'base' AND src IN (SELECT src FROM j WHERE error IS NULL AND decision = 'disable_base_entry') THEN 'disabled' ELSE 'active' END AS status FROM l
UNION ALL SELECT DISTINCT 'lx_' || substr(sha1(src || '|' || tgt || '|phrase|manual|review_queue'), 1, 12), 'active' FROM j WHERE error IS NULL AND decision = 'add_override'"""
)
def lexicon_after_store(spark, sf_dir):
    """Queue, lexicon and audit as files after the decisions."""
    top = scratch(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{top}/checkpoint")
    review.store(_resolved(spark, sf_dir), queue_path=f"{top}/queue", lexicon_path=f"{top}/lexicon", audit_path=f"{top}/audit")
    return spark.read.schema("entry_id string, status string").json(f"{top}/lexicon")


ALONE = f"{WITH_TRUST}, j AS (SELECT *, CASE WHEN {IDENTITY_SQL} AND NOT {OVERRIDE_SQL} THEN 'identity_passthrough_masked' ELSE {REASON_SQL} END AS reason FROM l)"


def _stored(spark: SparkSession, sf_dir: str) -> artifacts.Compiled:
    top = scratch(spark)
    as_lines(lexicon(spark, sf_dir)).write.text(f"{top}/{artifacts.SOURCES['lexicon']}")
    as_lines(rule_table(spark, sf_dir)).write.text(f"{top}/{artifacts.SOURCES['rules']}")
    artifacts.ensure_ready(spark, top)
    return artifacts.ensure_ready(spark, top)  # read back, not compiled again


@query(f"{ALONE} SELECT entry_id, CAST({RANK_SQL} AS INT) AS layer_rank FROM j WHERE reason IS NULL")
def stored_entries(spark, sf_dir):
    return _stored(spark, sf_dir).entries.select("entry_id", "layer_rank")


@query(f"{ALONE}, r AS ({RULES}) SELECT count(*) AS entry_count, count(*) FILTER (reason IS NULL) AS runtime_entry_count, (SELECT count(*) FROM r) AS rule_count, 'split_char_after_rules' AS lexicon_stage FROM j")
def stored_manifest(spark, sf_dir):
    return _stored(spark, sf_dir).manifest.select("entry_count", "runtime_entry_count", "rule_count", "lexicon_stage")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(count(*) FILTER (p_partkey % 3 <> 0) AS BIGINT) AS absent FROM part")
def documents_from_json(spark, sf_dir):
    """JSON documents written with their nulls and read as whole files."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("name"))
    src.write_json(rows.groupBy(F.col("p_partkey") % 7).agg(F.collect_list(F.struct("p_partkey", "name")).alias("rows")).select("rows"), path := scratch(spark))
    values = src.read_document(spark, path).select(F.explode(F.split(F.trim("value"), "\n")).alias("value")).where("value <> ''")
    parts = values.select(F.explode(F.from_json("value", "rows array<struct<p_partkey:long,name:string>>")["rows"]).alias("r")).select("r.*")
    return parts.agg(F.count(F.lit(1)).alias("n"), F.sum("p_partkey").alias("keys"), F.count_if(F.col("name").isNull()).alias("absent"))


# --- extension points and streams


@query(rf"SELECT doc_id, md5(regexp_replace(replace(replace(replace(text, 'e', '嗎'), '$', '₫'), ' ', '-'), '嗎[0-9]?', 'ma0', 'g')) AS out FROM documents")
def romanized(spark, sf_dir):
    """A converter of one's own, then the patches."""
    docs = _table(spark, sf_dir, "documents").withColumn("text", F.replace(F.replace("text", F.lit("e"), F.lit("嗎")), F.lit("$"), F.lit("₫")))
    return romanize.romanize(docs, lambda t: t.replace(" ", "-"), text_col="text").select("doc_id", F.md5("romanized").alias("out"))


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, 'th', 'é'), '([sz])h', 'é\1', 'g')) AS out FROM documents")
def rule_escapes(spark, sf_dir):
    """Escapes in a regex rule's replacement become characters, those of a literal rule don't."""
    made = [{"rule_id": "a", "pass_name": "grammar", "type": "literal", "pattern": "th", "replacement": r"é"}, {"rule_id": "b", "pass_name": "grammar", "type": "regex", "pattern": "([sz])h", "replacement": r"é\1"}]
    return rules.apply_rules(_table(spark, sf_dir, "documents"), made).select("doc_id", F.md5("text").alias("out"))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    top = scratch(spark)
    runtime = rw.Runtime([whole.entry(c, t, 7, "base") for c, t in zip("aeioué", "ÁÉÍÓÚ_")], [], [], [("xx", False)])
    texts = rewrite_stream.read_texts(spark, f"{sf_dir}/conversations.parquet*", "conv_id long, turn long, text string")
    rewrite_stream.write_with_reviews(rewrite_stream.rewrite_stream(texts, runtime), f"{top}/out", f"{top}/queue", f"{top}/state").awaitTermination()
    return top


CHARACTERS = f"WITH {whole.TALKS}, d AS (SELECT conv_id, turn, text, {whole.tidy_sql("translate(text, 'aeioué', 'ÁÉÍÓÚ_')")} AS done, length(text) - length(translate(text, 'aeioué', '')) AS n FROM c)"


@query(f"{CHARACTERS} SELECT conv_id, turn, md5(done) AS out, CAST(n AS INT) AS n_matches FROM d")
def stream_rewritten(spark, sf_dir):
    """The conversations as a stream of files, rewritten."""
    rows = spark.read.parquet(f"{_streamed(spark, sf_dir)}/out")
    return rows.select("conv_id", "turn", F.md5("result.output").alias("out"), F.col("result.match_count").alias("n_matches"))


@query(f"{CHARACTERS} SELECT 'online_low_confidence' AS kind, count(*) AS n FROM d WHERE n = 0 OR contains(done, 'xx') HAVING count(*) > 0")
def stream_reviews(spark, sf_dir):
    """What the stream put into the review queue."""
    rows = spark.read.schema("kind string").json(f"{_streamed(spark, sf_dir)}/queue")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


BARE = r"regexp_replace(regexp_replace(regexp_replace({html}, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '[ \t\r\n]+', '', 'g')"
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def _plain_sql(text: str) -> str:
    for name, char in ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return text


@query(f"SELECT page_id, md5({whole.tidy_sql(f"translate({_plain_sql(BARE.format(html='html'))}, '0123456789', '零一二三四五六七八九')")}) AS out FROM pages")
def dom_rewritten(spark, sf_dir):
    """Digits rewritten within pages: the texts that are left without markup, whose runs of one punctuation mark become one."""
    runtime = rw.Runtime([whole.entry(str(d), c, 7, "base") for d, c in enumerate("零一二三四五六七八九")], [], [], [])
    pages = dom.rewrite_html(_table(spark, sf_dir, "pages"), runtime)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", ""), "<[^>]*>", ""), r"[ \t\r\n]+", "")
    for name, char in ENTITIES:
        bare = F.replace(bare, F.lit(name), F.lit(char))
    return pages.select("page_id", F.md5(norm.tidy(bare)).alias("out"))
