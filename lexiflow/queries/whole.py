"""Queries for normalisation and the whole conversion as they ship, and for sources and artifacts, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import normalize as norm
from lexiflow.operators import review, rules
from lexiflow.plans import compile as comp
from lexiflow.plans import rewrite as rw
from lexiflow.queries.core import BLOCKED, CONTEXTS, CORE_SQL, FREE_WORDS, IDENTITY_SQL, JUDGED, MAP_SQL, OVERRIDE_SQL, PAIRS, RULES, TERMS, TEXT_RULES, TIER_SQL, WITH_TRUST, WORDS, _parts, _table, _values, lexicon, query, rule_table
from lexiflow.sources import lexicon as src

# White space as Python strips it, and what the normaliser takes for blanks, punctuation and Han.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANKS = r"[ \t\x{3000}\x{A0}]"
HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2FA1F}]"
DIGITS = "零一二三四五六七八九"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def spelled_sql(text: str) -> str:
    return f"translate({text}, '0123456789', '{DIGITS}')"


def group_sql(g: str) -> str:
    """A number below 10000 without its leading zeros."""
    digit = lambda e: f"substr('{DIGITS}', CAST({e} AS INT) + 1, 1)"
    th, h, t, u = f"{g} // 1000", f"({g} // 100) % 10", f"({g} // 10) % 10", f"{g} % 10"
    thousands = f"CASE WHEN {th} > 0 THEN {digit(th)} || '千' ELSE '' END"
    hundreds = f"CASE WHEN {h} > 0 THEN {digit(h)} || '百' WHEN {th} > 0 AND {g} % 100 > 0 THEN '零' ELSE '' END"
    tens = f"CASE WHEN {t} = 1 AND {g} < 100 THEN '十' WHEN {t} > 0 THEN {digit(t)} || '十' WHEN {h} > 0 AND {u} > 0 THEN '零' ELSE '' END"
    return f"({thousands} || {hundreds} || {tens} || CASE WHEN {u} > 0 THEN {digit(u)} ELSE '' END)"


def int_han_sql(whole: str) -> str:
    """A string of digits as a numeral; by groups of four up to 10^20."""
    parts = []
    for k, unit in enumerate(("京", "兆", "億", "萬", "")):
        bridge = f"CASE WHEN regexp_matches(substr(p, 1, {4 * k}), '[1-9]') AND (g < 1000 OR ends_with(substr(p, 1, {4 * k}), '0000')) THEN '零' ELSE '' END"
        parts.append(let(f"CAST(substr(p, {4 * k + 1}, 4) AS INT)", "g", f"CASE WHEN g = 0 THEN '' ELSE {bridge} || {group_sql('g')} || '{unit}' END"))
    return let(f"ltrim({whole}, '0')", "w", f"CASE WHEN w = '' THEN '零' WHEN length(w) > 20 THEN {spelled_sql('w')} ELSE {let("lpad(w, 20, '0')", 'p', ' || '.join(parts))} END")


def number_sql(token: str) -> str:
    """Digits, with a point and more digits perhaps."""
    whole, part = f"split_part({token}, '.', 1)", f"split_part({token}, '.', 2)"
    said = f"CASE WHEN {part} = '' AND length({whole}) > 1 AND starts_with({whole}, '0') THEN {spelled_sql(whole)} ELSE {int_han_sql(whole)} END"
    return f"({said} || CASE WHEN {part} <> '' THEN '點' || {spelled_sql(part)} ELSE '' END)"


def numbers_sql(text: str) -> str:
    """A number is a whole run of letters, digits, _ and points, and a sign before it counts if no such run ends at the sign."""
    run = "[A-Za-z0-9_.]+"
    gap, word = "z[1]", "z[2]"
    is_number = f"regexp_full_match(coalesce({word}, ''), '[0-9]+([.][0-9]+)?')"
    signed = f"({is_number} AND right({gap}, 1) IN ('+', '-') AND (length({gap}) > 1 OR i = 1))"
    before = f"CASE WHEN {signed} THEN left({gap}, length({gap}) - 1) || CASE WHEN right({gap}, 1) = '-' THEN '負' ELSE '' END ELSE {gap} END"
    after = f"CASE WHEN {is_number} THEN {number_sql(word)} ELSE coalesce({word}, '') END"
    zipped = f"list_zip(regexp_split_to_array({text}, '{run}'), regexp_extract_all({text}, '{run}'))"
    return f"coalesce(list_aggregate(list_transform({zipped}, lambda z, i: {before} || {after}), 'string_agg', ''), '')"


def norm_sql(text: str) -> str:
    trimmed = f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"
    folded = f"translate(replace({trimmed}, '臺', '台'), '０１２３４５６７８９', '0123456789')"
    closed = f"regexp_replace(regexp_replace({folded}, '{BLANKS}+', ' ', 'g'), ' ?([，。！？；：、]) ?', '\\1', 'g')"
    pair = f"({HAN}) ({HAN})"
    joined = f"regexp_replace(regexp_replace({closed}, '{pair}', '\\1\\2', 'g'), '{pair}', '\\1\\2', 'g')"
    return let(joined, "t", numbers_sql("t"))


def tidy_sql(text: str) -> str:
    out = f"replace(replace({text}, '這馬咧咧', '這馬咧'), '真正真', '真')"
    for mark in ",，。！!？?":
        escaped = "\\" + mark if mark == "?" else mark
        out = f"regexp_replace({out}, '{escaped}{{2,}}', '{mark}', 'g')"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _table(spark, sf_dir, name)


# --- normalisation


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS out FROM documents")
def normalize_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.normalize_text(F.col("text"))).alias("out"))


LETTERS, HAN_LETTERS = "aeiou,.!?", "甲乙丙丁戊，。！？"


@query(f"SELECT doc_id, md5({norm_sql(f"translate(text, '{LETTERS}', '{HAN_LETTERS}') || ' 臺　北 -3.05 +7 007 A12 1,000 --５'")}) AS out FROM documents")
def normalize_han(spark, sf_dir):
    """The same on texts with Han letters and punctuation."""
    text = F.concat(F.translate("text", LETTERS, HAN_LETTERS), F.lit(" 臺　北 -3.05 +7 007 A12 1,000 --５"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm.normalize_text(text)).alias("out"))


BIG = "CAST(o_orderkey AS VARCHAR) || substr(CAST(CAST(o_custkey AS HUGEINT) * 1000003 * (o_orderkey % 7) AS VARCHAR), 1, CAST(o_orderkey % 16 AS INT)) || repeat('0', CAST(o_custkey % 9 AS INT))"


@query(f"SELECT o_orderkey, {int_han_sql(BIG)} AS han FROM orders")
def large_int_to_han(spark, sf_dir):
    product = F.expr("cast(cast(o_custkey as decimal(38,0)) * 1000003 * (o_orderkey % 7) as string)")
    digits = F.concat(F.col("o_orderkey").cast("string"), F.substring(product, F.lit(1), F.pmod("o_orderkey", F.lit(16)).cast("int")), F.repeat(F.lit("0"), F.pmod("o_custkey", F.lit(9)).cast("int")))
    return table(spark, sf_dir, "orders").select("o_orderkey", norm.int_to_han(digits).alias("han"))


# --- the whole conversion

ALT = "(?:" + "|".join(sorted(WORDS, key=lambda w: (-len(w), w))) + ")"
RESIDUAL = [("heit", True), ("eau", False)]


def entry(word: str, tgt: str, rank: int, tier: str, **more) -> dict:
    level = "char" if rank == 7 else "sentence" if rank == 1 else "phrase"
    return {"entry_id": f"d_{word}", "src": word, "tgt": tgt, "level": level, "tier": tier, "priority": len(word), "context": None, "score": 1.0, "status": "active", "source": "", "trust": "seed", "layer_rank": rank} | more


def plain_runtime() -> rw.Runtime:
    return rw.Runtime([entry(w, PAIRS[w], 5, "base") for w in WORDS] + [entry("x", "ks", 7, "base")], [], TEXT_RULES, RESIDUAL)


def _between(text: str, pattern: str, to: str) -> str:
    return f"coalesce(list_aggregate(list_transform(list_zip(regexp_split_to_array({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}')), lambda z: z[1] || coalesce({to}, '')), 'string_agg', ''), '')"


PLAIN = f"""WITH a AS (SELECT doc_id, text, {norm_sql('text')} AS n FROM documents), b AS (SELECT *, {_between('n', ALT, f'{MAP_SQL}[z[2]]')} AS l FROM a),
c1 AS (SELECT *, replace(l, 'th', 'z') AS r1 FROM b), c2 AS (SELECT *, regexp_replace(r1, '[zs]e+', '<e>', 'g') AS r2 FROM c1), c3 AS (SELECT *, regexp_replace(r2, '([aou])(n+)', '\\2\\1', 'g') AS r3 FROM c2),
c4 AS (SELECT *, replace(r3, '<e>', 'e') AS r4 FROM c3), c5 AS (SELECT *, regexp_replace(r4, '{SPACE}+$', '') AS r5 FROM c4), d AS (SELECT *, {tidy_sql("replace(r5, 'x', 'ks')")} AS done FROM c5),
e AS (SELECT *, CASE WHEN contains(done, 'heit') THEN '核心漏轉:heit;' ELSE '' END || CASE WHEN contains(done, 'eau') THEN '華語殘留:eau;' ELSE '' END AS warned, len(regexp_extract_all(n, '{ALT}')) + length(r5) - length(replace(r5, 'x', '')) AS found FROM d)"""
HITS = [("t1", "len(regexp_extract_all(l, 'th'))"), ("t2", "len(regexp_extract_all(r1, '[zs]e+'))"), ("t3", "len(regexp_extract_all(r2, '([aou])(n+)'))"), ("t4", "len(regexp_extract_all(r3, '<e>'))"), ("t5", f"len(regexp_extract_all(r4, '{SPACE}+$'))")]


@query(f"{PLAIN} SELECT doc_id, md5(done) AS out, CAST(found AS INT) AS n_matches, warned AS warnings, {' || '.join(f"CASE WHEN {n} > 0 THEN '{r}:' || {n} || ';' ELSE '' END" for r, n in HITS)} AS rules FROM e")
def rewrite_plain(spark, sf_dir):
    """Normalisation, phrases, rules, characters, clean-up and warnings."""
    done = rw.rewrite(table(spark, sf_dir, "documents"), plain_runtime(), trace=False)
    joined = lambda c: F.concat(F.array_join(c, ";"), F.when(F.size(c) > 0, ";").otherwise(""))
    hits = F.transform("result.rules_applied", lambda r: F.concat_ws(":", r["rule_id"], r["hit_count"].cast("string")))
    return done.select("doc_id", F.md5("result.output").alias("out"), F.col("result.match_count").alias("n_matches"), joined(F.col("result.warnings")).alias("warnings"), joined(hits).alias("rules"))


@query(f"{PLAIN} SELECT 'online_low_confidence' AS kind, 'add_override' AS action, 'runtime' AS owner, 'auto_enqueued_by_runtime' AS reason, 'pending' AS status, md5(text) AS input, md5(done) AS output, CAST(found AS INT) AS match_count, warned AS warnings FROM e WHERE found = 0 OR warned <> ''")
def low_confidence(spark, sf_dir):
    items = rw.low_confidence(rw.rewrite(table(spark, sf_dir, "documents"), plain_runtime()))
    rows = review.complete(items, F.to_json("evidence"))
    warnings = F.concat(F.array_join("evidence.warnings", ";"), F.when(F.size("evidence.warnings") > 0, ";").otherwise(""))
    return rows.select("kind", "action", "owner", "reason", "status", F.md5("evidence.input").alias("input"), F.md5("evidence.output").alias("output"), "evidence.match_count", warnings.alias("warnings"))


TALKS = f"c AS (SELECT conv_id, turn, {norm_sql('text')} AS text FROM conversations)"


def found_sql(name: str, words: list[str]) -> str:
    return f"{name} AS (SELECT conv_id, turn, text, i - 1 AS s, i - 1 + length(w) AS e, w FROM c, {_values(words)} AS t(w), unnest(range(1, length(text) + 1)) AS r(i) WHERE contains(text, w) AND substr(text, i, length(w)) = w)"


def spliced_sql(source: str, to: str, key: str = "conv_id, turn") -> str:
    """Per row of source (text, s, e) the leftmost-longest spans' replacement in the text, and their number."""
    found = "substr(text, CAST(x.s + 1 AS BIGINT), CAST(x.at - x.s AS BIGINT))"
    step = f"CASE WHEN x.s >= a.at THEN {{'at': x.at, 's': x.s, 'n': a.n + 1, 'out': a.out || substr(text, CAST(a.at + 1 AS BIGINT), CAST(x.s - a.at AS BIGINT)) || {to.format(found=found)}}} ELSE a END"
    items = "list({'at': CAST(e AS BIGINT), 's': CAST(s AS BIGINT), 'n': CAST(0 AS BIGINT), 'out': ''} ORDER BY s)"
    return f"SELECT {key}, z.n AS n, z.out || substr(text, CAST(z.at + 1 AS BIGINT)) AS out FROM (SELECT {key}, text, list_reduce(l, lambda a, x: {step}, {{'at': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'out': ''}}) AS z FROM (SELECT {key}, text, {items} AS l FROM (SELECT {key}, text, s, max(e) AS e FROM {source} GROUP BY ALL) GROUP BY ALL))"


def apart_sql(a: str, b: str) -> str:
    return f"SELECT * FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.s < x.e AND x.s < y.e)"


TO_TARGET = f"coalesce({MAP_SQL}[{{found}}], '')".replace("{'", "{{'").replace("'}", "'}}")
OVERRIDES = f"o AS (SELECT text AS src, 'said ' || chr(CAST(65 + max(conv_id) % 26 AS INT)) AS tgt FROM c WHERE conv_id % 3 = 0 GROUP BY text)"


def _talks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", F.md5("result.output").alias("out"), F.col("result.match_count").alias("n_matches"), F.size("result.warnings").alias("n_warnings"))


@query(
    f"""WITH {TALKS}, {OVERRIDES}, {found_sql('b', BLOCKED)}, {found_sql('f', FREE_WORDS)}, k AS ({apart_sql('f', 'b')}), z AS ({spliced_sql('k', TO_TARGET)}), w AS (SELECT conv_id, turn, count(*) AS n FROM b GROUP BY ALL)
SELECT c.conv_id, c.turn, md5({tidy_sql("CASE WHEN w.n IS NULL AND o.src IS NOT NULL THEN o.tgt ELSE coalesce(z.out, c.text) END")}) AS out, CAST(CASE WHEN w.n IS NULL AND o.src IS NOT NULL THEN 1 ELSE coalesce(z.n, 0) END AS INT) AS n_matches, CAST(2 * coalesce(w.n, 0) AS INT) AS n_warnings
FROM c LEFT JOIN o ON c.text = o.src LEFT JOIN z USING (conv_id, turn) LEFT JOIN w USING (conv_id, turn)"""
)
def rewrite_guarded(spark, sf_dir):
    """Blocked spans, exact sentence overrides (which a blocked span forbids) and phrases between them."""
    said = _talks(spark, sf_dir).where("conv_id % 3 = 0").groupBy(norm.normalize_text(F.col("text")).alias("src")).agg(F.concat(F.lit("said "), F.expr("char(65 + max(conv_id) % 26)")).alias("tgt"))
    exact = [entry(r.src, r.tgt, 1, "manual", entry_id="s", trust="human") for r in said.collect() if r.src]
    runtime = rw.Runtime([entry(w, PAIRS[w], 5, "base") for w in FREE_WORDS] + [entry(w, "", 0, "blocked") for w in BLOCKED] + exact, [], [], [])
    return _shown(rw.rewrite(_talks(spark, sf_dir), runtime, trace=False))


@query(
    f"""WITH {TALKS}, {found_sql('p', FREE_WORDS)}, {found_sql('t0', TERMS)}, t AS (SELECT conv_id, turn, text, s, max(e) AS e FROM t0 GROUP BY ALL),
k AS (SELECT x.* FROM t x WHERE (x.s = 0 AND x.e = length(x.text)) OR NOT EXISTS (SELECT 1 FROM p y WHERE y.conv_id = x.conv_id AND y.turn = x.turn AND y.s < x.e AND x.s < y.e AND NOT (y.s >= x.s AND y.e <= x.e))),
h AS (SELECT conv_id, turn, unnest(list_filter(string_split(list_reduce(l, lambda a, x: CASE WHEN x.s >= a.at THEN {{'at': x.at, 's': x.s, 'out': a.out || x.s || '-' || x.at || ';'}} ELSE a END, {{'at': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'out': ''}}).out, ';'), lambda v: v <> '')) AS v FROM (SELECT conv_id, turn, list({{'at': CAST(e AS BIGINT), 's': CAST(s AS BIGINT), 'out': ''}} ORDER BY s) AS l FROM k GROUP BY ALL)),
g AS (SELECT conv_id, turn, CAST(split_part(v, '-', 1) AS BIGINT) AS s, CAST(split_part(v, '-', 2) AS BIGINT) AS e FROM h), q AS ({apart_sql('p', 'g')}), z AS ({spliced_sql('q', TO_TARGET)})
SELECT conv_id, turn, md5({tidy_sql('coalesce(out, text)')}) AS out, CAST(coalesce(n, 0) AS INT) AS n_matches, CAST(0 AS INT) AS n_warnings FROM c LEFT JOIN z USING (conv_id, turn)"""
)
def rewrite_masked(spark, sf_dir):
    """Protected terms, which no phrase enters."""
    runtime = rw.Runtime([entry(w, PAIRS[w], 5, "base") for w in FREE_WORDS], TERMS, [], [])
    return _shown(rw.rewrite(_talks(spark, sf_dir), runtime, trace=False))


MASKS = ("[A-Z][a-z]+", "on [a-z]")


@query(f"WITH {TALKS} SELECT conv_id, turn, md5({tidy_sql(_between('text', '(?:[A-Z][a-z]+|n)', "CASE WHEN z[2] = 'n' THEN '_' ELSE z[2] END"))}) AS out FROM c")
def rewrite_regex_masks(spark, sf_dir):
    """What a configured pattern finds is left alone: every n is rewritten but those in capitalised words."""
    runtime = rw.Runtime([entry("n", "_", 7, "base")], [], [], [], rw.Options(regex_masks=MASKS[:1]))
    done = rw.rewrite(_talks(spark, sf_dir), runtime, trace=False)
    return done.select("conv_id", "turn", F.md5("result.output").alias("out"))


def _context_rows() -> str:
    parts = []
    for w, left, right in CONTEXTS:
        test = [f"w = '{w}'"] + ([f"ends_with(substr(text, 1, s), '{left}')"] if left else []) + ([f"starts_with(substr(text, e + 1), '{right}')"] if right else [])
        parts.append(f"({' AND '.join(test)})")
    return " OR ".join(parts)


@query(
    f"""WITH {TALKS}, {found_sql('a0', [w for w, _, _ in CONTEXTS])}, k AS (SELECT * FROM a0 WHERE {_context_rows()}), z AS ({spliced_sql('k', "upper({found})")})
SELECT conv_id, turn, md5({tidy_sql('coalesce(out, text)')}) AS out, CAST(coalesce(n, 0) AS INT) AS n_matches, CAST(0 AS INT) AS n_warnings FROM c LEFT JOIN z USING (conv_id, turn)"""
)
def rewrite_contexts(spark, sf_dir):
    """Contextual entries by what stands before and behind them."""
    keys = ("left_regex", "right_regex", "full_regex")
    made = [entry(w, w.upper(), 2, "manual", trust="human", context={k: None for k in keys} | {"left_literal": left, "right_literal": right}) for w, left, right in CONTEXTS]
    return _shown(rw.rewrite(_talks(spark, sf_dir), rw.Runtime(made, [], [], []), trace=False))


@query(f"WITH {TALKS} SELECT conv_id, turn, md5({tidy_sql("translate(text, 'aeioué', 'ÁÉÍÓÚ_')")}) AS out, CAST(length(text) - length(translate(text, 'aeioué', '')) AS INT) AS n_matches, CAST(0 AS INT) AS n_warnings FROM c")
def rewrite_characters(spark, sf_dir):
    """Character entries through the last layer."""
    runtime = rw.Runtime([entry(c, t, 7, "base") for c, t in zip("aeioué", "ÁÉÍÓÚ_")], [], [], [])
    return _shown(rw.rewrite(_talks(spark, sf_dir), runtime, trace=False))


# --- rules, sources and compilation

ORDERED_SQL = "o AS (SELECT *, row_number() OVER (PARTITION BY pass_name ORDER BY priority DESC, rule_id) AS place FROM r WHERE enabled AND pattern <> '')"


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{t}', '{a.replace(chr(92) + 'u3000', chr(92) + 'u3000')}', '{b}', {n})" for p, t, a, b, n in rules.DEFAULT_RULES) + ") AS t(pass_name, type, pattern, replacement, priority)")
def default_rules(spark, sf_dir):
    return rules.default_rules(spark).select("pass_name", "type", "pattern", "replacement", "priority")


# What the named token stands for.
@query("SELECT p_partkey, p_name || '(?:我|你|伊|恁|怹|咱|阮|他|她|你們|他們)' AS pattern, '<(?:我|你|伊|恁|怹|咱|阮|他|她|你們|他們)>' AS replacement FROM part")
def expand_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("{{PRONOUN}}")).alias("pattern"), F.lit("<{{PRONOUN}}>").alias("replacement"))
    return rules.expand_tokens(rows)


@query(f"{WITH_TRUST} SELECT kind, src, string_agg(entry_id, ',' ORDER BY {TIER_SQL}, priority DESC, length(src) DESC, score DESC, entry_id) AS entry_ids FROM (SELECT *, 'sentence' AS kind FROM l WHERE {OVERRIDE_SQL} UNION ALL SELECT *, 'context' FROM l WHERE tier IN ('manual', 'manual_hotfix') AND trust = 'human' AND ctx IS NOT NULL AND status = 'active' UNION ALL SELECT *, 'char' FROM l WHERE level = 'char' AND status = 'active') GROUP BY kind, src")
def grouped_entries(spark, sf_dir):
    return comp.grouped_entries(lexicon(spark, sf_dir).where("status = 'active'")).withColumn("entry_ids", F.array_join("entry_ids", ","))


@query(f"{WITH_TRUST} SELECT CAST(max(length(src)) AS INT) AS n FROM l WHERE level IN ('phrase', 'sentence') AND status = 'active' AND ctx IS NULL")
def max_phrase_length(spark, sf_dir):
    return comp.max_phrase_length(lexicon(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT p_name, p_brand FROM part)) + (SELECT count(*) FROM (SELECT DISTINCT substr(p_name, 1, 1), p_brand FROM part)) AS lexicon_entries, (SELECT count(*) FROM part) AS phrase_entries, (SELECT count(*) FROM part) AS char_entries, (SELECT count(*) FROM (SELECT DISTINCT substr(p_name, 1, 1), p_brand FROM part WHERE substr(p_name, 1, 1) IN ('b', 's'))) AS char_active")
def migration_stats(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    phrases, chars = part.select(F.col("p_name").alias("src"), F.col("p_brand").alias("tgt")), part.select(F.substring("p_name", 1, 1).alias("src"), F.col("p_brand").alias("tgt"))
    return comp.migration_stats(comp.migrate_legacy(phrases, chars, spark.createDataFrame([("b",), ("s",)], "term string")), phrases, chars)


@query(
    f"""{JUDGED}, r AS ({RULES}), {ORDERED_SQL}, x AS (SELECT * FROM r WHERE enabled AND type = 'regex') SELECT count(*) FILTER (reason = 'core_identity_protected_term') AS core_identity_protected_entry_count, count(*) FILTER (reason = 'identity_passthrough_masked') AS identity_passthrough_protected_entry_count,
  (SELECT count(*) FROM o a JOIN o b ON a.pass_name = b.pass_name AND a.place < b.place AND a.type = 'literal' AND b.type = 'literal' AND starts_with(b.pattern, a.pattern)) AS mask_warning_count,
  (SELECT count(*) FILTER (regexp_matches(pattern, '(^|[^\\\\])[.][*+]')) + count(*) FILTER (regexp_matches(pattern, '\\[\\^[^\\]]+\\]\\+')) + count(*) FILTER ((length(pattern) - length(replace(pattern, '(?!', ''))) / 3 >= 8) + count(*) FILTER (pass_name <> 'normalization' AND contains(pattern, '\\s+') AND replacement = '') FROM x) AS regex_hazard_count,
  (SELECT count(*) FROM (VALUES ('東西'), ('什麼'), ('為什麼'), ('為何')) AS v(term) WHERE term IN (SELECT src FROM j WHERE reason IS NULL AND status = 'active' AND src <> tgt) OR term IN (SELECT pattern FROM r WHERE enabled AND type = 'literal' AND pattern <> replacement)) AS residual_core_term_count,
  count(*) FILTER ({IDENTITY_SQL} OR {CORE_SQL}) AS identities FROM j"""
)
def manifest_findings(spark, sf_dir):
    rows, core = _parts(spark, sf_dir)
    allow = src.terms_of(table(spark, sf_dir, "part").select(F.col("p_type").alias("value")))
    names = ["core_identity_protected_entry_count", "identity_passthrough_protected_entry_count", "mask_warning_count", "regex_hazard_count", "residual_core_term_count"]
    found = comp.compile_lexicon(rows, core, allow, rule_table(spark, sf_dir)).manifest.select(*names)
    same = comp.identity_entries(rows).select("entry_id").unionByName(comp.core_identities(core).select("entry_id")).distinct().agg(F.count(F.lit(1)).alias("identities"))
    return found.crossJoin(same)  # one row by one row


@query("SELECT p_partkey, p_name AS src, p_brand AS tgt, 'core' AS tier, CASE WHEN p_partkey % 2 = 0 THEN 'char' ELSE 'phrase' END AS level, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size WHEN p_partkey % 2 = 0 THEN 80 ELSE 800 END AS INT) AS priority, 'human' AS trust, 'core:lexicon' AS source, 'lx_' || substr(sha1(p_name || '|' || p_brand || '|' || CASE WHEN p_partkey % 2 = 0 THEN 'char' ELSE 'phrase' END || '|core|core:lexicon'), 1, 12) AS entry_id FROM part")
def core_lexicon(spark, sf_dir):
    """A core lexicon's defaults, with white space around its texts."""
    given = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('\\u001c ', p_name, '\\t') as src", "concat(p_brand, ' ') as tgt", "case when p_partkey % 2 = 0 then 'char' end as level", "case when p_partkey % 3 = 0 then p_size end as priority")
    rest = {n: F.lit(None).cast(t) for n, t in (("entry_id", "string"), ("tier", "string"), ("score", "double"), ("status", "string"), ("source", "string"), ("trust", "string"), ("updated_by", "string"), ("updated_at", "string"))}
    return src.core_entries(given.withColumns(rest)).select("p_partkey", "src", "tgt", "tier", "level", "priority", "trust", "source", "entry_id")


@query("SELECT p_partkey % 5 AS kind, p_partkey AS place, 'k' || p_partkey AS entry_id, p_name AS src, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE CAST((p_partkey % 5) * 10 AS INT) END AS priority FROM part")
def decode_entry_table(spark, sf_dir):
    """A compact entry table of the parts: rows refer to a kind and may leave its defaults out."""
    rows = table(spark, sf_dir, "part").selectExpr("struct(p_partkey, concat('k', p_partkey) as id, p_name as src, '' as tgt, cast(p_partkey % 5 as int) as kind, case when p_partkey % 3 = 0 then p_size end as priority, cast(null as double) as score) as r")
    kinds = spark.createDataFrame([(k, f"l{k}", "base", "seed", 10 * k, 0.5) for k in range(5)], "n int, level string, tier string, trust string, priority int, score double")
    every = F.array_sort(F.collect_list("r"))
    table_ = rows.agg(F.transform(every, lambda r: F.struct(r["id"].alias("id"), r["src"].alias("src"), r["tgt"].alias("tgt"), r["kind"].alias("kind"), r["priority"].alias("priority"), r["score"].alias("score"))).alias("e"))
    k = kinds.agg(F.array_sort(F.collect_list(F.struct("n", "level", "tier", "trust", "priority", "score"))).alias("k"))
    got = src.decode_entry_table(table_.crossJoin(k))  # a document is one row
    return got.select(F.substring("level", 2, 1).cast("long").alias("kind"), F.substring("entry_id", 2, 20).cast("long").alias("place"), "entry_id", "src", "priority")


@query("SELECT chr(CAST(97 + p_partkey % 26 AS INT)) || p_partkey AS src, CAST(p_partkey % 7 AS INT) AS place FROM part WHERE p_partkey % 7 < 5 UNION ALL SELECT chr(CAST(97 + p_partkey % 26 AS INT)) || p_partkey, 0 FROM part")
def decode_char_map(spark, sf_dir):
    """A character map of the parts: references by place, of which some are beyond the table, and by id."""
    refs = F.concat(F.lit("["), F.pmod("p_partkey", F.lit(7)).cast("string"), F.lit(', "lx_0", "lx_none"]'))
    pairs = table(spark, sf_dir, "part").select(F.concat(F.expr("char(97 + p_partkey % 26)"), F.col("p_partkey").cast("string")).alias("k"), refs.alias("v"))
    line = F.concat(F.lit('"'), "k", F.lit('": '), "v")
    document = pairs.agg(F.concat(F.lit('{"v": 2, "m": {'), F.array_join(F.collect_list(line), ", "), F.lit("}}")).alias("value"))
    entries = spark.createDataFrame([(k, f"lx_{k}") for k in range(5)], "place int, entry_id string")
    return src.decode_char_map(document, entries).select("src", "place")


@query("SELECT ['normalization', 'grammar', 'fluency', 'punctuation'][CAST(p_partkey % 4 AS INT) + 1] AS pass_name, p_name || p_partkey AS pattern, p_brand AS replacement, CASE WHEN p_partkey % 2 = 0 THEN 'regex' ELSE 'literal' END AS type, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 0 END AS INT) AS priority, 'rl_' || substr(sha1(['normalization', 'grammar', 'fluency', 'punctuation'][CAST(p_partkey % 4 AS INT) + 1] || '|' || p_name || p_partkey || '|' || p_brand), 1, 12) AS rule_id FROM part")
def decode_rule_plan(spark, sf_dir):
    """A compact rule plan of the parts."""
    cell = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.lit(", 1")).otherwise(F.lit(", 0"))
    row = F.concat(F.lit("["), cell(F.concat("p_name", F.col("p_partkey").cast("string"))), F.lit(", "), cell(F.col("p_brand")), kind, F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat(F.lit(", "), F.col("p_size").cast("string"))).otherwise(""), F.lit("]"))
    rows = table(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(4)).cast("int").alias("k"), row.alias("row"))
    passes = rows.agg(*(F.concat(F.lit("["), F.array_join(F.collect_list(F.when(F.col("k") == k, F.col("row"))), ", "), F.lit("]")).alias(str(k)) for k in range(4)))
    document = passes.select(F.concat(F.lit('{"v": 6, "r": ['), F.concat_ws(", ", "0", "1", "2", "3"), F.lit("]}")).alias("value"))
    return src.decode_rule_plan(document).select("pass_name", "pattern", "replacement", "type", "priority", "rule_id")
