"""Queries over the driver's tables for every relational and text operator, with DuckDB SQL.

The tables have no lexicon, so one is derived from ``part`` by expressions that both engines
read alike; what an operator computes is written twice, independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import ids
from lexiflow.functions import normalize as norm
from lexiflow.operators import lints, match, policy, review, romanize, rules, stats
from lexiflow.plans import compile as comp
from lexiflow.plans import rewrite as rw
from lexiflow.sources import lexicon as src

LEX = """
SELECT *, CASE k % 5 WHEN 0 THEN '台' || b WHEN 1 THEN b WHEN 2 THEN '' ELSE src END AS tgt FROM (
SELECT p_partkey AS k, p_brand AS b, 'e' || lpad(CAST(p_partkey AS STRING), 7, '0') AS entry_id,
  CASE p_partkey % 8 WHEN 0 THEN '好' WHEN 1 THEN '泛指' || p_name WHEN 2 THEN '一種' || p_type || '的' WHEN 3 THEN p_name
    WHEN 4 THEN 'w' || CAST(p_partkey % 50 AS STRING) WHEN 5 THEN '一個' || CAST(p_size AS STRING) WHEN 6 THEN '什麼' ELSE p_name || CAST(p_size AS STRING) END AS src,
  CASE p_partkey % 6 WHEN 0 THEN 'blocked' WHEN 1 THEN 'manual_hotfix' WHEN 2 THEN 'manual' WHEN 3 THEN 'core' WHEN 4 THEN 'domain' ELSE 'base' END AS tier,
  CASE CAST(floor(p_partkey / 6) AS INT) % 3 WHEN 0 THEN 'sentence' WHEN 1 THEN 'phrase' ELSE 'char' END AS level,
  CAST(p_size * 10 AS INT) AS priority, CAST(p_partkey % 4 AS DOUBLE) AS score,
  CASE WHEN p_partkey % 9 = 0 THEN 'disabled' ELSE 'active' END AS status,
  CASE p_partkey % 7 WHEN 0 THEN 'review_queue' WHEN 1 THEN ' review_queue ' WHEN 2 THEN 'user:ann' WHEN 3 THEN 'seed' ELSE '' END AS source,
  CASE p_partkey % 11 WHEN 0 THEN 'codex' WHEN 1 THEN 'itaigi_bot' ELSE 'ann' END AS updated_by,
  CASE CAST(floor(p_partkey / 18) AS INT) % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'machine' WHEN 2 THEN 'seed' WHEN 3 THEN 'other' ELSE NULL END AS trust,
  CASE WHEN p_partkey % 17 = 0 THEN '。' END AS ctx
FROM part) AS p"""

RULES = """
SELECT 'r' || lpad(CAST(p_partkey AS STRING), 7, '0') AS rule_id,
  CASE p_partkey % 5 WHEN 0 THEN 'normalization' WHEN 1 THEN 'grammar' WHEN 2 THEN 'fluency' WHEN 3 THEN 'punctuation' ELSE 'other' END AS pass_name,
  CASE WHEN p_partkey % 4 = 0 THEN 'regex' ELSE 'literal' END AS type,
  CASE p_partkey % 16 WHEN 0 THEN p_name || '.*' WHEN 4 THEN '[^' || p_brand || ']+' WHEN 8 THEN '\\s+' || p_type WHEN 12 THEN repeat('(?!a)', 8) || p_name
    ELSE substr(p_name, 1, 2 + CAST(p_partkey % 9 AS INT)) || CAST(p_size AS STRING) || substr(p_brand, 7) END AS pattern,
  CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN substr(p_name, 1, 4) || CAST(p_size AS STRING) || substr(p_brand, 7) ELSE p_type END AS replacement,
  CAST(p_size AS INT) AS priority, p_partkey % 7 <> 0 AS enabled, '' AS note
FROM part"""

WORDS = "the then ther and an ing tion tio of on ou her here er der die und un che sch ch que qu le la les des de ment men est es ción ció os osa ado ra ar en ent".split()
PAIRS = {w: w[::-1].upper() for w in WORDS}
BLOCKED = ["the", "que", "sch"]
TERMS = ["her", "there", "ment", "on the", "eau", "de la", "ció"]
TEXT_RULES = [
    {"rule_id": "t1", "pass_name": "grammar", "type": "literal", "pattern": "th", "replacement": "z", "priority": 9},
    {"rule_id": "t2", "pass_name": "grammar", "type": "regex", "pattern": "[zs]e+", "replacement": "<e>", "priority": 8},
    {"rule_id": "t3", "pass_name": "fluency", "type": "regex", "pattern": "([aou])(n+)", "replacement": r"\2\1", "priority": 7},
    {"rule_id": "t4", "pass_name": "fluency", "type": "literal", "pattern": "<e>", "replacement": "e", "priority": 6},
    {"rule_id": "t5", "pass_name": "punctuation", "type": "regex", "pattern": r"\s+$", "replacement": "", "priority": 5},
]
CONTEXTS = [("er", " of", None), ("an", None, " "), ("en", " ", "t"), ("la", "de ", None)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, table: str = "part") -> DataFrame:
    return spark.sql(text.replace(f"FROM {table}", "FROM {_t}"), _t=_table(spark, sf_dir, table))


def lexicon(spark: SparkSession, sf_dir: str, settle_trust: bool = True) -> DataFrame:
    parts = [F.lit(None).cast("string").alias(n) for n in ("left_regex", "right_regex", "full_regex", "left_literal")]
    context = F.when(F.col("ctx").isNotNull(), F.struct(*parts, F.col("ctx").alias("right_literal")))
    rows = _sql(spark, sf_dir, LEX).withColumns({"context": context, "updated_at": F.lit("")}).drop("k", "b", "ctx")
    return rows.withColumn("trust", policy.trust()) if settle_trust else rows


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RULES.replace("'\\s+'", "'\\\\s+'"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


WITH_LEX = f"WITH l0 AS ({LEX})"
# Trusts, updaters, reasons, prefixes, tiers and passes, as in operators/policy.py.
TRUST_SQL = """CASE WHEN coalesce(trust, '') IN ('human', 'machine', 'seed') THEN trust
  WHEN trim(source) = 'review_queue' AND trim(updated_by) IN ('itaigi_full', 'itaigi_bot', 'codex') THEN 'machine'
  WHEN starts_with(trim(source), 'user:') THEN 'human' WHEN tier IN ('manual', 'manual_hotfix') AND trim(source) = 'review_queue' THEN 'human' ELSE 'seed' END"""
WITH_TRUST = f"{WITH_LEX}, l AS (SELECT * REPLACE ({TRUST_SQL} AS trust) FROM l0)"
PHRASE_SQL = "level IN ('phrase', 'sentence')"
LOW_SQL = f"(tier IN ('base', 'domain') AND trust IN ('seed', 'machine') AND {PHRASE_SQL})"
REASON_SQL = f"""CASE WHEN tier = 'manual_hotfix' AND {PHRASE_SQL} AND trust = 'machine' AND src = tgt THEN 'noop_manual_hotfix'
  WHEN trust = 'machine' AND {PHRASE_SQL} AND length(src) = 1 THEN 'single_char_machine_override'
  WHEN {LOW_SQL} AND length(src) = 1 THEN 'single_char_low_trust_phrase' WHEN {LOW_SQL} AND length(src) >= 8 THEN 'low_trust_long_phrase'
  WHEN {LOW_SQL} AND length(src) >= 4 AND (regexp_matches(src, '^(泛指|比喻|形容|表示|指|古書上|傳說中)') OR regexp_matches(src, '^(一種|一個|一位|一條|一片|一粒|一隻|一頭|從事|用來|使人|使在|使勁|使水)') AND (contains(src, '的') OR length(src) >= 8)) THEN 'definition_like_low_trust_phrase'
  WHEN tier IN ('base', 'domain', 'manual_hotfix') AND trust IN ('seed', 'machine') AND NOT regexp_matches(tgt, '[\\x{{3400}}-\\x{{9fff}}\\x{{f900}}-\\x{{faff}}\\x{{20000}}-\\x{{2FA1F}}]') THEN 'non_hanji_target' END"""
OVERRIDE_SQL = "(level = 'sentence' AND tier IN ('manual', 'manual_hotfix') AND trust = 'human' AND ctx IS NULL AND status = 'active')"
RANK_SQL = f"""CASE WHEN tier = 'blocked' THEN 0 WHEN {OVERRIDE_SQL} THEN 1 WHEN tier IN ('manual', 'manual_hotfix') AND trust = 'human' THEN 2
  WHEN tier = 'core' AND {PHRASE_SQL} THEN 3 WHEN tier = 'domain' AND {PHRASE_SQL} THEN 4 WHEN tier = 'base' AND {PHRASE_SQL} THEN 5
  WHEN tier = 'manual_hotfix' AND trust = 'machine' AND {PHRASE_SQL} THEN 6 WHEN level = 'char' THEN 7 ELSE 99 END"""
IDENTITY_SQL = f"(status = 'active' AND tier <> 'blocked' AND {PHRASE_SQL} AND ctx IS NULL AND src <> '' AND src = tgt)"
CORE_SQL = f"(tier = 'core' AND status = 'active' AND {PHRASE_SQL} AND length(src) > 1 AND src = tgt)"
JUDGED = f"{WITH_TRUST}, j AS (SELECT *, CASE WHEN {CORE_SQL} THEN 'core_identity_protected_term' WHEN {IDENTITY_SQL} AND NOT {OVERRIDE_SQL} THEN 'identity_passthrough_masked' ELSE {REASON_SQL} END AS reason FROM l)"
TIER_SQL = "CASE tier WHEN 'blocked' THEN 0 WHEN 'manual_hotfix' THEN 1 WHEN 'manual' THEN 2 WHEN 'core' THEN 3 WHEN 'domain' THEN 4 WHEN 'base' THEN 5 ELSE 999 END"
PASS_SQL = "CASE pass_name WHEN 'normalization' THEN 0 WHEN 'grammar' THEN 1 WHEN 'fluency' THEN 2 WHEN 'punctuation' THEN 3 ELSE 999 END"


# --- text functions


@query(r"SELECT doc_id, md5(regexp_replace(text, '[ \t\x{3000}\x{A0}]+', ' ', 'g')) AS out FROM documents")
def norm_spaces(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.compress_blanks(F.col("text"))).alias("out"))


@query(r"SELECT doc_id, length(regexp_replace(regexp_replace(' ' || text || chr(10) || chr(28), '^[\s\x1c-\x1f]+', ''), '[\s\x1c-\x1f]+$', '')) AS n FROM documents")
def norm_trim(spark, sf_dir):
    padded = F.concat(F.lit(" "), "text", F.lit("\n\x1c"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(norm.trim_outer(padded)).cast("long").alias("n"))


@query("SELECT c_custkey, translate(replace('臺' || c_name, '臺', '台'), '０１２３４５６７８９', '0123456789') AS out FROM customer")
def norm_forms(spark, sf_dir):
    wide = F.concat(F.lit("臺"), F.translate("c_name", "0123456789", "０１２３４５６７８９"))
    return _table(spark, sf_dir, "customer").select("c_custkey", norm.fold_forms(wide).alias("out"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!!+', '!', 'g'), ',,+', ',', 'g'), '\?\?+', '?', 'g'), '。。+', '。', 'g')) AS out FROM documents")
def fold_punctuation(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.tidy(F.col("text"))).alias("out"))


def _han_sql(column: str) -> str:
    digit = lambda e: f"substr('零一二三四五六七八九', CAST({e} AS INT) + 1, 1)"

    def group(g: str) -> str:
        th, h, t, u = f"{g} // 1000", f"({g} // 100) % 10", f"({g} // 10) % 10", f"{g} % 10"
        tens = f"CASE WHEN {t} = 0 THEN CASE WHEN {u} > 0 AND {g} >= 100 THEN '零' ELSE '' END WHEN {t} = 1 AND {g} < 100 THEN '十' ELSE {digit(t)} || '十' END"
        hundreds = f"CASE WHEN {h} = 0 THEN CASE WHEN {t} > 0 AND {g} >= 1000 THEN '零' ELSE '' END ELSE {digit(h)} || '百' END"
        return f"(CASE WHEN {th} > 0 THEN {digit(th)} || '千' ELSE '' END || {hundreds} || {tens} || CASE WHEN {u} > 0 THEN {digit(u)} ELSE '' END)"

    # below 1000 and without tens, the zero of the hundreds place stands for both
    hi, lo = f"({column} // 10000)", f"({column} % 10000)"
    glue = lambda g: f"replace({g}, '零零', '零')"
    return f"CASE WHEN {column} = 0 THEN '零' ELSE CASE WHEN {hi} > 0 THEN {glue(group(hi))} || '萬' ELSE '' END || CASE WHEN {hi} > 0 AND {lo} > 0 AND {lo} < 1000 THEN '零' ELSE '' END || {glue(group(lo))} END"


@query(f"SELECT o_orderkey, {_han_sql('o_orderkey')} AS han FROM orders")
def int_to_han(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select("o_orderkey", norm.int_to_han(F.col("o_orderkey").cast("string")).alias("han"))


@query(f"SELECT o_orderkey, '負' || {_han_sql('CAST(floor(o_totalprice) AS BIGINT)')} || '點零' || substr('零一二三四五六七八九', CAST(o_orderkey % 10 AS INT) + 1, 1) AS han FROM orders")
def number_to_han(spark, sf_dir):
    token = F.concat(F.lit("-"), F.floor("o_totalprice").cast("long").cast("string"), F.lit(".0"), F.pmod("o_orderkey", F.lit(10)).cast("string"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", norm.number_to_han(token).alias("han"))


@query("SELECT p_partkey, 'lx_' || substr(sha1(p_name || '|' || p_brand || '|phrase|base|' || p_type), 1, 12) AS entry_id, 'rl_' || substr(sha1('grammar|' || p_name || '|' || p_brand), 1, 12) AS rule_id FROM part")
def entry_ids(spark, sf_dir):
    made = ids.entry_id(F.col("p_name"), F.col("p_brand"), F.lit("phrase"), F.lit("base"), F.col("p_type"))
    return _table(spark, sf_dir, "part").select("p_partkey", made.alias("entry_id"), ids.rule_id(F.lit("grammar"), F.col("p_name"), F.col("p_brand")).alias("rule_id"))


# --- policy and compile


@query(f"{WITH_TRUST} SELECT entry_id, trust FROM l")
def trust_infer(spark, sf_dir):
    return lexicon(spark, sf_dir, False).select("entry_id", policy.trust().alias("trust"))


@query(f"{WITH_TRUST} SELECT entry_id, {REASON_SQL} AS reason FROM l")
def exclusion_reason(spark, sf_dir):
    return lexicon(spark, sf_dir).select("entry_id", policy.exclusion_reason().alias("reason"))


def _parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = lexicon(spark, sf_dir)
    return rows, rows.where("tier = 'core'")


@query(f"{JUDGED} SELECT entry_id, reason FROM j WHERE reason IS NOT NULL")
def excluded_entries(spark, sf_dir):
    return comp.with_reasons(*_parts(spark, sf_dir)).where("reason is not null").select("entry_id", "reason")


@query(f"{JUDGED} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def excluded_histogram(spark, sf_dir):
    return comp.excluded_reasons(comp.with_reasons(*_parts(spark, sf_dir)))


@query(f"{WITH_TRUST} SELECT entry_id FROM l WHERE {IDENTITY_SQL}")
def identity_passthrough(spark, sf_dir):
    return comp.identity_entries(lexicon(spark, sf_dir)).select("entry_id")


@query(f"{WITH_TRUST} SELECT entry_id, CAST({RANK_SQL} AS INT) AS layer_rank FROM l")
def layer_rank(spark, sf_dir):
    return lexicon(spark, sf_dir).select("entry_id", policy.layer_rank().alias("layer_rank"))


@query(f"{WITH_TRUST} SELECT entry_id, CAST(row_number() OVER (PARTITION BY level ORDER BY {TIER_SQL}, priority DESC, length(src) DESC, score DESC, entry_id) AS INT) AS place FROM l")
def entry_order(spark, sf_dir):
    from pyspark.sql import Window

    return lexicon(spark, sf_dir).select("entry_id", F.row_number().over(Window.partitionBy("level").orderBy(*policy.entry_order())).alias("place"))


@query(f"WITH r AS ({RULES}) SELECT rule_id, CAST(row_number() OVER (PARTITION BY pass_name ORDER BY {PASS_SQL}, priority DESC, rule_id) AS INT) AS place FROM r WHERE enabled")
def rule_order(spark, sf_dir):
    return lints.ordered(rule_table(spark, sf_dir)).select("rule_id", "place")


ORDERED_RULES = f"WITH r AS ({RULES}), o AS (SELECT *, row_number() OVER (PARTITION BY pass_name ORDER BY priority DESC, rule_id) AS place FROM r WHERE enabled AND pattern <> '')"


@query(f"{ORDERED_RULES} SELECT 'masked' AS kind, a.pass_name, a.rule_id AS earlier_id, b.rule_id AS later_id FROM o a JOIN o b ON a.pass_name = b.pass_name AND a.place < b.place AND a.type = 'literal' AND b.type = 'literal' AND starts_with(b.pattern, a.pattern)")
def mask_lint(spark, sf_dir):
    return lints.masked_rules(rule_table(spark, sf_dir))


@query(
    f"""{ORDERED_RULES} SELECT 'short_first' AS kind, a.pass_name, a.rule_id AS earlier_id, b.rule_id AS later_id FROM o a JOIN o b ON a.pass_name = b.pass_name AND a.place < b.place
  AND a.type = 'literal' AND b.type = 'literal' AND length(a.pattern) < length(b.pattern) AND contains(b.pattern, a.pattern) AND a.replacement <> b.replacement
UNION ALL SELECT 'chain', a.pass_name, a.rule_id, b.rule_id FROM o a JOIN o b ON a.pass_name = b.pass_name AND a.place < b.place AND a.replacement <> '' AND a.replacement = b.pattern AND a.replacement <> b.replacement"""
)
def conflict_lint(spark, sf_dir):
    # a rule that writes what it rewrites is no chain, as its two texts are compared
    rows = rule_table(spark, sf_dir)
    return lints.conflicting_rules(rows)


@query(
    f"""WITH r AS ({RULES}), x AS (SELECT * FROM r WHERE enabled AND type = 'regex')
SELECT pass_name, rule_id, 'dot_greedy' AS hazard FROM x WHERE regexp_matches(pattern, '(^|[^\\\\])[.][*+]') UNION ALL SELECT pass_name, rule_id, 'unbounded_negation' FROM x WHERE regexp_matches(pattern, '\\[\\^[^\\]]+\\]\\+')
UNION ALL SELECT pass_name, rule_id, 'many_lookaheads' FROM x WHERE (length(pattern) - length(replace(pattern, '(?!', ''))) / 3 >= 8 UNION ALL SELECT pass_name, rule_id, 'deletes_blanks' FROM x WHERE pass_name <> 'normalization' AND contains(pattern, '\\s+') AND replacement = ''"""
)
def hazard_lint(spark, sf_dir):
    return lints.regex_hazards(rule_table(spark, sf_dir))


@query(f"{WITH_TRUST} SELECT entry_id, CASE WHEN tier = 'core' THEN 'core' ELSE tgt END AS tgt FROM l")
def union_last_wins(spark, sf_dir):
    rows, core = _parts(spark, sf_dir)
    return comp.last_wins(rows, core.withColumn("tgt", F.lit("core"))).select("entry_id", "tgt")


@query(f"{WITH_TRUST} SELECT DISTINCT term FROM (SELECT DISTINCT p_type AS term FROM part UNION ALL SELECT src FROM l WHERE {IDENTITY_SQL} OR {CORE_SQL}) WHERE length(term) > 1")
def protected_terms(spark, sf_dir):
    rows, core = _parts(spark, sf_dir)
    allow = src.terms_of(_table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_type", F.lit(" ")).alias("value")))
    return comp.protected_terms(rows, core, allow)


@query(f"{WITH_TRUST}, r AS ({RULES}), t AS (SELECT unnest(['什麼', '東西', 'w8', 'w12', '泛指']) AS term) SELECT term FROM t WHERE term IN (SELECT src FROM l WHERE status = 'active' AND src <> tgt) OR term IN (SELECT pattern FROM r WHERE enabled AND type = 'literal' AND pattern <> replacement)")
def residual_terms(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in ("什麼", "東西", "w8", "w12", "泛指")], "term string")
    return comp.residual_terms(lexicon(spark, sf_dir).where("status = 'active'"), rule_table(spark, sf_dir), terms)


def _mode_sql(name: str) -> str:
    return f"(SELECT level, tier, trust, {name} AS default_{name} FROM (SELECT *, row_number() OVER (PARTITION BY level, tier, trust ORDER BY n DESC, f) AS k FROM (SELECT level, tier, trust, {name}, count(*) AS n, min(entry_id) AS f FROM l GROUP BY ALL)) WHERE k = 1)"


@query(f"{WITH_TRUST} SELECT level, tier, trust, default_priority, default_score FROM {_mode_sql('priority')} JOIN {_mode_sql('score')} USING (level, tier, trust)")
def kind_defaults(spark, sf_dir):
    return comp.kind_defaults(lexicon(spark, sf_dir))


@query(
    f"""{JUDGED}, r AS ({RULES}), a AS (SELECT DISTINCT p_type AS term FROM part) SELECT count(*) AS entry_count, count(*) FILTER (reason IS NULL) AS runtime_entry_count, count(*) FILTER (reason IS NOT NULL) AS runtime_excluded_entry_count,
  count(*) FILTER (reason IS NULL AND status = 'active') AS active_entry_count, count(*) FILTER (tier = 'core') AS core_entry_count, (SELECT count(*) FROM r) AS rule_count, (SELECT count(*) FROM r WHERE enabled) AS active_rule_count,
  (SELECT count(DISTINCT term) FROM (SELECT term FROM a UNION ALL SELECT src FROM l WHERE {IDENTITY_SQL} OR {CORE_SQL}) WHERE length(term) > 1) AS protected_term_count FROM j"""
)
def manifest_counts(spark, sf_dir):
    rows, core = _parts(spark, sf_dir)
    allow = src.terms_of(_table(spark, sf_dir, "part").select(F.col("p_type").alias("value")))
    names = ["entry_count", "runtime_entry_count", "runtime_excluded_entry_count", "active_entry_count", "core_entry_count", "rule_count", "active_rule_count", "protected_term_count"]
    return comp.compile_lexicon(rows, core, allow, rule_table(spark, sf_dir)).manifest.select(*names)


@query(f"{JUDGED} SELECT entry_id, CAST({RANK_SQL} AS INT) AS layer_rank FROM j WHERE reason IS NULL")
def compiled_entries(spark, sf_dir):
    rows, core = _parts(spark, sf_dir)
    allow = src.terms_of(_table(spark, sf_dir, "part").select(F.col("p_type").alias("value")))
    return comp.compile_lexicon(rows, core, allow, rule_table(spark, sf_dir)).entries.select("entry_id", "layer_rank")


@query(
    """SELECT DISTINCT src, tgt, level, priority, status FROM (SELECT p_name || p_type AS src, p_brand AS tgt, CASE WHEN length(p_name || p_type) >= 12 THEN 'sentence' ELSE 'phrase' END AS level, CAST(CASE WHEN length(p_name || p_type) >= 12 THEN 60 ELSE 40 END AS INT) AS priority, 'active' AS status FROM part
UNION ALL SELECT substr(p_name, 1, 1), p_brand, 'char', CAST(10 AS INT), CASE WHEN substr(p_name, 1, 1) IN ('b', 's') THEN 'active' ELSE 'disabled' END FROM part)"""
)
def migrate_legacy(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    phrases = part.select(F.concat("p_name", "p_type").alias("src"), F.col("p_brand").alias("tgt"))
    chars = part.select(F.substring("p_name", 1, 1).alias("src"), F.col("p_brand").alias("tgt"))
    return comp.migrate_legacy(phrases, chars, spark.createDataFrame([("b",), ("s",)], "term string")).select("src", "tgt", "level", "priority", "status")


# --- matching

ALTERNATION = "(?:" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
MAP_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in PAIRS.items()) + "}"
REPLACED_SQL = f"""list_aggregate(list_transform(list_zip(regexp_split_to_array(text, '{ALTERNATION}'), regexp_extract_all(text, '{ALTERNATION}')), lambda z: z[1] || coalesce({MAP_SQL}[z[2]], '')), 'string_agg', '')"""


@query(f"SELECT doc_id, md5(coalesce({REPLACED_SQL}, '')) AS out FROM documents")
def phrase_replace(spark, sf_dir):
    return match.replace_phrases(_table(spark, sf_dir, "documents"), PAIRS).select("doc_id", F.md5("text").alias("out"))


@query(f"SELECT src, count(*) AS hits FROM (SELECT unnest(regexp_extract_all(text, '{ALTERNATION}')) AS src FROM documents) GROUP BY src")
def phrase_hits(spark, sf_dir):
    return match.phrase_hits(_table(spark, sf_dir, "documents"), WORDS)


@query(
    f"""WITH c AS (SELECT conv_id, turn, regexp_split_to_array(text, '{ALTERNATION}') AS g, regexp_extract_all(text, '{ALTERNATION}') AS m FROM conversations),
s AS (SELECT conv_id, turn, m[i] AS src, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS "start" FROM c, unnest(range(1, len(m) + 1)) AS r(i))
SELECT conv_id, turn, src, "start", CAST("start" + length(src) AS INT) AS "end", upper(reverse(src)) AS tgt FROM s"""
)
def match_trace(spark, sf_dir):
    entries = spark.createDataFrame(list(PAIRS.items()), "src string, tgt string")
    return match.match_rows(_table(spark, sf_dir, "conversations"), entries, WORDS, id_cols=["conv_id", "turn"]).select("conv_id", "turn", "src", "start", "end", "tgt")


@query(f"{WITH_TRUST}, x AS (SELECT *, {RANK_SQL} AS rk FROM l) SELECT src, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rk, priority DESC, score DESC, entry_id) AS n FROM x WHERE src <> '') WHERE n = 1")
def best_entry(spark, sf_dir):
    return match.best_entries(lexicon(spark, sf_dir).withColumn("layer_rank", policy.layer_rank())).select("src", "entry_id")


def _values(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ")"


def _found_sql(name: str, words: list[str]) -> str:
    return f"{name} AS (SELECT conv_id, turn, i - 1 AS s, i - 1 + length(w) AS e FROM conversations, {_values(words)} AS t(w), unnest(range(1, length(text) + 1)) AS r(i) WHERE contains(text, w) AND substr(text, i, length(w)) = w)"


def _fold_sql(source: str) -> str:
    """Spans chosen from the left, written as s-e; for each row."""
    return f"""SELECT conv_id, turn, list_reduce(list({{'at': e, 'out': CAST(s AS VARCHAR)}} ORDER BY s), lambda a, x: CASE WHEN CAST(x.out AS BIGINT) >= a.at THEN {{'at': x.at, 'out': a.out || x.out || '-' || CAST(x.at AS VARCHAR) || ';'}} ELSE a END, {{'at': CAST(0 AS BIGINT), 'out': ''}}).out AS spans
FROM (SELECT conv_id, turn, s, max(e) AS e FROM {source} GROUP BY ALL) GROUP BY ALL"""


def _apart(a: str, b: str) -> str:
    return f"SELECT * FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.s < x.e AND x.s < y.e)"


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(";"))), "")


FREE_WORDS = [w for w in WORDS if w not in BLOCKED]


@query(f"WITH {_found_sql('b', BLOCKED)}, {_found_sql('f', FREE_WORDS)}, k AS ({_apart('f', 'b')}), z AS ({_fold_sql('k')}) SELECT conv_id, turn, coalesce(spans, '') AS spans FROM conversations LEFT JOIN z USING (conv_id, turn)")
def blocked_reserve(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations")
    none = F.array().cast("array<struct<start:int,end:int,src:string>>")
    held = talks.withColumn("_b", match.leftmost_maximum(match.occurrences(F.col("text"), BLOCKED), none)).withColumn("_f", match.occurrences(F.col("text"), FREE_WORDS))
    return held.select("conv_id", "turn", _written(match.leftmost_maximum(F.col("_f"), F.col("_b"))).alias("spans"))


@query(
    f"""WITH {_found_sql('p', WORDS)}, {_found_sql('t0', TERMS)}, t AS (SELECT conv_id, turn, s, max(e) AS e FROM t0 GROUP BY ALL),
k AS (SELECT x.* FROM t x JOIN conversations c USING (conv_id, turn) WHERE (x.s = 0 AND x.e = length(c.text)) OR NOT EXISTS (SELECT 1 FROM p y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.s < x.e AND x.s < y.e AND NOT (y.s >= x.s AND y.e <= x.e))),
z AS ({_fold_sql('k')}) SELECT conv_id, turn, coalesce(spans, '') AS spans FROM conversations LEFT JOIN z USING (conv_id, turn)"""
)
def protected_mask(spark, sf_dir):
    talks = _table(spark, sf_dir, "conversations").withColumn("_p", match.occurrences(F.col("text"), WORDS))
    return talks.select("conv_id", "turn", _written(match.protected_spans(F.col("text"), TERMS, F.col("_p"))).alias("spans"))


# --- rules, rewriting, review

CHAIN_SQL = r"regexp_replace(replace(regexp_replace(regexp_replace(replace(text, 'th', 'z'), '[zs]e+', '<e>', 'g'), '([aou])(n+)', '\2\1', 'g'), '<e>', 'e'), '\s+\z', '')"


@query(f"SELECT doc_id, md5({CHAIN_SQL}) AS out FROM documents")
def rule_chain(spark, sf_dir):
    return rules.apply_rules(_table(spark, sf_dir, "documents"), TEXT_RULES).select("doc_id", F.md5("text").alias("out"))


@query(
    r"""WITH a AS (SELECT text FROM documents), b AS (SELECT replace(text, 'th', 'z') AS text FROM a), c AS (SELECT regexp_replace(text, '[zs]e+', '<e>', 'g') AS text FROM b), d AS (SELECT regexp_replace(text, '([aou])(n+)', '\2\1', 'g') AS text FROM c), e AS (SELECT replace(text, '<e>', 'e') AS text FROM d)
SELECT * FROM (SELECT 't1' AS rule_id, CAST(sum(len(regexp_extract_all(text, 'th'))) AS BIGINT) AS hit_count FROM a UNION ALL SELECT 't2', CAST(sum(len(regexp_extract_all(text, '[zs]e+'))) AS BIGINT) FROM b UNION ALL SELECT 't3', CAST(sum(len(regexp_extract_all(text, '([aou])(n+)'))) AS BIGINT) FROM c
UNION ALL SELECT 't4', CAST(sum(len(regexp_extract_all(text, '<e>'))) AS BIGINT) FROM d UNION ALL SELECT 't5', CAST(sum(len(regexp_extract_all(text, '\s+\z'))) AS BIGINT) FROM e) WHERE hit_count > 0"""
)
def rule_hits(spark, sf_dir):
    return rules.rule_hits(_table(spark, sf_dir, "documents"), TEXT_RULES).select("rule_id", F.col("hit_count").cast("long").alias("hit_count"))


def demo_runtime(spark: SparkSession) -> rw.Runtime:
    entry = lambda w, t, rank, tier: {"entry_id": f"d_{w}", "src": w, "tgt": t, "level": "char" if rank == 7 else "phrase", "tier": tier, "priority": len(w), "context": None, "score": 1.0, "status": "active", "source": "", "trust": "seed", "layer_rank": rank}
    entries = [entry(w, PAIRS[w], 5, "base") for w in FREE_WORDS] + [entry(w, "", 0, "blocked") for w in BLOCKED] + [entry("x", "ks", 7, "base")]
    return rw.Runtime(entries, TERMS, TEXT_RULES, [("heit", True), ("eau", False)])


@query()
def rewrite_full(spark, sf_dir):
    done = rw.rewrite(_table(spark, sf_dir, "documents"), demo_runtime(spark), trace=False)
    return done.select("doc_id", F.col("result.output").alias("output"), F.col("result.match_count").alias("n_matches"), F.col("result.warnings").alias("warnings"), F.transform("result.rules_applied", lambda r: F.concat_ws(":", r["rule_id"], r["hit_count"].cast("string"))).alias("rules"))


QUEUE = """SELECT doc_id AS line_no, 'rq_' || CAST(doc_id % 300 AS STRING) AS review_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN quality = 1 THEN 'pending' ELSE 'resolved' END AS status FROM labels"""
DECISIONS = """SELECT doc_id AS line_no, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'rq_' || CAST(doc_id % 400 AS STRING) END AS review_id,
  CASE doc_id % 4 WHEN 0 THEN 'add_override' WHEN 1 THEN 'disable_base_entry' WHEN 2 THEN 'reject' ELSE CASE WHEN doc_id % 3 = 0 THEN 'oops' ELSE 'add_override' END END AS decision,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'd' || CAST(doc_id % 50 AS STRING) END AS src, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 't' || CAST(doc_id AS STRING) END AS tgt FROM labels"""
BASE_LEX = "SELECT 'b' || CAST(p_partkey AS STRING) AS entry_id, 'd' || CAST(p_partkey % 60 AS STRING) AS src, '' AS tgt, 'phrase' AS level, CASE WHEN p_partkey % 2 = 0 THEN 'base' ELSE 'core' END AS tier, 0 AS priority, 'active' AS status, '' AS source, 'seed' AS trust FROM part"
JUDGE_SQL = f"""WITH RECURSIVE q AS ({QUEUE}), d0 AS ({DECISIONS}), l AS ({BASE_LEX}), i AS (SELECT review_id, arg_max(coalesce(status, ''), line_no) AS st FROM q GROUP BY review_id),
b AS (SELECT src, count(*) AS n FROM l WHERE tier = 'base' GROUP BY src),
d AS (SELECT d0.*, i.st, b.n AS n_base, row_number() OVER (ORDER BY line_no) AS k FROM d0 LEFT JOIN i ON d0.review_id = i.review_id LEFT JOIN b ON d0.src = b.src),
f(k, line_no, error, done, gone) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
  SELECT k, line_no, e, CASE WHEN e IS NULL THEN list_append(done, review_id) ELSE done END, CASE WHEN e IS NULL AND decision = 'disable_base_entry' THEN list_append(gone, src) ELSE gone END FROM (
  SELECT d.*, f.done, f.gone, CASE WHEN d.review_id = '' THEN 'no_review_id' WHEN st IS NULL THEN 'unknown_review_id' WHEN st <> 'pending' OR list_contains(f.done, d.review_id) THEN 'not_pending' WHEN decision = 'oops' THEN 'bad_decision'
    WHEN decision = 'add_override' AND (src IS NULL OR tgt IS NULL) THEN 'incomplete' WHEN decision = 'disable_base_entry' AND (src IS NULL OR n_base IS NULL OR list_contains(f.gone, src)) THEN 'no_hit' END AS e FROM f JOIN d ON d.k = f.k + 1)),
j AS (SELECT d.*, f.error FROM d JOIN f USING (k))"""


def _resolved(spark, sf_dir) -> review.Resolved:
    queue, given = _sql(spark, sf_dir, QUEUE, "labels"), _sql(spark, sf_dir, DECISIONS, "labels")
    rest = {n: F.lit(None).cast(t) for n, t in (x.split() for x in review.decision_schema().split(", ")) if n not in given.columns}
    return review.resolve(queue, _sql(spark, sf_dir, BASE_LEX), given.withColumns(rest), now=F.timestamp_seconds(F.lit(0)))


@query(f"{JUDGE_SQL} SELECT line_no, review_id, error FROM j")
def judge_decisions(spark, sf_dir):
    return _resolved(spark, sf_dir).outcomes.select("line_no", "review_id", "error")


@query(f"{JUDGE_SQL} SELECT count(*) AS total_decisions, count(*) FILTER (error IS NULL) AS applied, count(*) FILTER (error IS NULL AND decision = 'add_override') AS add_override, count(*) FILTER (error IS NULL AND decision = 'disable_base_entry') AS disable_base_entry, count(*) FILTER (error IS NULL AND decision = 'reject') AS reject, string_agg('line ' || k || ': ' || error, ';' ORDER BY k) FILTER (error IS NOT NULL) AS errors FROM j")
def decision_summary(spark, sf_dir):
    return review.summary(_resolved(spark, sf_dir).outcomes).withColumn("errors", F.array_join("errors", ";"))


@query(
    f"""{JUDGE_SQL}, w AS (SELECT DISTINCT src FROM j WHERE error IS NULL AND decision = 'disable_base_entry'), u AS (SELECT DISTINCT src, tgt FROM j WHERE error IS NULL AND decision = 'add_override')
SELECT entry_id, src, CASE WHEN tier = 'base' AND src IN (SELECT src FROM w) THEN 'disabled' ELSE 'active' END AS status, tier, trust FROM l
UNION ALL SELECT 'lx_' || substr(sha1(src || '|' || tgt || '|phrase|manual|review_queue'), 1, 12), src, 'active', 'manual', 'human' FROM u"""
)
def apply_decisions(spark, sf_dir):
    return _resolved(spark, sf_dir).lexicon.select("entry_id", "src", "status", "tier", "trust")


@query(
    f"""{JUDGE_SQL} SELECT q.line_no, q.review_id, CASE WHEN a.review_id IS NULL THEN q.status ELSE 'resolved' END AS status, a.decision, CASE WHEN a.review_id IS NOT NULL THEN 'reviewer' END AS resolved_by, CASE WHEN a.review_id IS NOT NULL THEN '1970-01-01T00:00:00' END AS resolved_at
FROM q LEFT JOIN (SELECT j.review_id, j.decision, x.line_no FROM j JOIN (SELECT review_id, max(line_no) AS line_no FROM q GROUP BY review_id) x USING (review_id) WHERE error IS NULL) a ON q.review_id = a.review_id AND q.line_no = a.line_no"""
)
def queue_after_decisions(spark, sf_dir):
    return _resolved(spark, sf_dir).queue.select("line_no", "review_id", "status", "decision", "resolved_by", "resolved_at")


@query(
    f"""{JUDGE_SQL} SELECT review_id, decision AS action, 'reviewer' AS owner, '' AS reason, '1970-01-01T00:00:00' AS applied_at, CASE decision WHEN 'add_override' THEN 'add_or_update_override' ELSE decision END AS op,
CASE WHEN decision = 'add_override' THEN 'lx_' || substr(sha1(src || '|' || tgt || '|phrase|manual|review_queue'), 1, 12) END AS entry_id, CAST(CASE WHEN decision = 'disable_base_entry' THEN n_base END AS INT) AS disabled_count FROM j WHERE error IS NULL"""
)
def decision_audit(spark, sf_dir):
    return _resolved(spark, sf_dir).audit.select("review_id", "action", "owner", "reason", "applied_at", "result.*")


@query("""SELECT doc_id, 'rq_' || substr(sha1('{"doc_id": ' || doc_id || ', "quality": ' || quality || '}'), 1, 12) AS review_id, '1970-01-01T00:00:00' AS created_at, CASE WHEN toxic = 1 THEN NULL ELSE 'seen' END AS status FROM labels""")
def append_review_items(spark, sf_dir):
    canonical = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "quality": '), F.col("quality").cast("string"), F.lit("}"))
    items = _table(spark, sf_dir, "labels").withColumn("status", F.when(F.col("toxic") != 1, "seen"))
    return review.complete(items, canonical, F.timestamp_seconds(F.lit(0))).select("doc_id", "review_id", "created_at", "status")


@query(f"WITH q AS ({QUEUE}) SELECT line_no, review_id FROM q WHERE coalesce(status, 'pending') = 'pending' ORDER BY line_no LIMIT 200")
def pending_top_n(spark, sf_dir):
    return review.pending(_sql(spark, sf_dir, QUEUE, "labels"), 200).select("line_no", "review_id")


@query("""SELECT doc_id, 'rq_' || substr(sha1('{"doc_id": ' || doc_id || ', "quality": ' || quality || '}'), 1, 12) AS review_id FROM labels""")
def review_ids(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").withColumn("review_id", F.lit(None).cast("string"))
    canonical = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "quality": '), F.col("quality").cast("string"), F.lit("}"))
    return review.with_ids(labels.withColumn("canonical", canonical)).select("doc_id", "review_id")


@query("SELECT count(*) AS n, avg(value) AS mean_ms, (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS c FROM events) WHERE k = greatest(c * 95 // 100 - 1, 0)) AS p95_ms, max(value) AS max_ms FROM events")
def latency_p95(spark, sf_dir):
    return stats.latency(_table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def category_counts(spark, sf_dir):
    return stats.category_counts(_table(spark, sf_dir, "events"), "event_type")


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name || '嗎3 她' || p_size || '嗎', '她[0-9]?', 'i1', 'g'), '嗎[0-9]?', 'ma0', 'g') AS roman FROM part")
def romanize_patch(spark, sf_dir):
    text = F.concat("p_name", F.lit("嗎3 她"), F.col("p_size").cast("string"), F.lit("嗎"))
    return _table(spark, sf_dir, "part").select("p_partkey", romanize.patch(text).alias("roman"))


@query(r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS out FROM pages")
def page_blocks(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(stats.block_text(F.col("html"))).alias("out"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY ALL")
def parse_json_lines(spark, sf_dir):
    rows = src.from_values(_table(spark, sf_dir, "events").select(F.col("props").alias("value")), "k int")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'offline_unresolved' AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events WHERE event_id % 3 > 0 GROUP BY ALL")
def import_unresolved(spark, sf_dir):
    broken = F.when(F.pmod("event_id", F.lit(3)) == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    items = review.import_unresolved(_table(spark, sf_dir, "events").select(broken.alias("value")))
    return items.groupBy("kind", F.get_json_object("evidence", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
