"""Ordered rule passes, as one projection where that is exact.

A regex rule means what Python's ``re`` makes of it. Its parse tree is written out for Java's engine
(:func:`java_pattern`); constructs that the two engines read differently aren't translated. Rules that
all can be translated are composed into nested column expressions, which Spark fuses into one stage; if one can't, or
there are more than ``MAX_CHAIN`` (Spark's plans aren't made for nesting without end), all go through Arrow batches in Python.
Either way gives the same texts and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as parser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.operators.policy import rule_order
from lexiflow.schema import PASSES

MAX_CHAIN = 150
# Fixed values.
TOKENS = {"{{PRONOUN}}": "(?:我|你|伊|恁|怹|咱|阮|他|她|你們|他們)"}
DEFAULT_RULES = [
    # pass_name, type, pattern, replacement, priority
    ("normalization", "literal", "臺", "台", 100),
    ("normalization", "regex", r"[ \t\u3000\xA0]+", " ", 90),
    ("grammar", "regex", r"食飽了沒", "食飽未", 100),
    ("grammar", "regex", r"了沒", "未", 95),
    ("grammar", "regex", r"嗎\??$", "無", 80),
    ("fluency", "regex", r"真好吃", "真好食", 90),
    ("fluency", "regex", r"這馬咧做啥", "這馬咧創啥", 85),
    ("fluency", "regex", r"咧做啥", "咧創啥", 80),
    ("fluency", "literal", "為何", "是按怎", 75),
    ("fluency", "literal", "為什麼", "是按怎", 75),
    ("fluency", "literal", "東西", "物件", 60),
    ("fluency", "literal", "什麼", "啥", 60),
]


def default_rules(spark) -> DataFrame:
    from lexiflow.functions.ids import rule_id

    rows = spark.createDataFrame([(*r, True, "") for r in DEFAULT_RULES], "pass_name string, type string, pattern string, replacement string, priority int, enabled boolean, note string")
    return rows.withColumn("rule_id", rule_id(F.col("pass_name"), F.col("pattern"), F.col("replacement")))


def expand_tokens(rules: DataFrame) -> DataFrame:
    """Named tokens written out in patterns and replacements."""
    for name in ("pattern", "replacement"):
        for token, meant in TOKENS.items():
            rules = rules.withColumn(name, F.replace(F.col(name), F.lit(token), F.lit(meant)))
    return rules


def decode_escapes(replacement: str) -> str:
    r"""\uXXXX and \UXXXXXXXX become characters unless their backslash is itself escaped."""
    return re.sub(r"(?<!\\)((?:\\\\)*)\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))", lambda m: m[1] + chr(int(m[2] or m[3], 16)), replacement)


def plan(rules: DataFrame, skip: tuple[str, ...] = ()) -> list[dict]:
    """Enabled rules in the order in which they apply, on the driver. Unknown passes don't run."""
    kept = expand_tokens(rules).where("enabled and pattern <> ''").where(F.col("pass_name").isin(*(p for p in PASSES if p not in skip)))
    return [r.asDict() for r in kept.orderBy(*rule_order()).collect()]


class Untranslatable(ValueError):
    """A pattern that Java's engine would read differently."""


# What Python takes for white space, digits and word characters, within brackets.
SETS = {
    sre.CATEGORY_SPACE: r"\t-\r\x1c-\x20\x85\xa0  -     　",
    sre.CATEGORY_DIGIT: r"\p{Nd}",
    sre.CATEGORY_WORD: r"\p{L}\p{N}_",
}
INVERSE = {sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE, sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD}


def _char(code: int) -> str:
    return chr(code) if chr(code).isascii() and chr(code).isalnum() else rf"\x{{{code:x}}}"


def _set(items: list) -> str:
    negated = bool(items) and items[0][0] is sre.NEGATE
    parts = []
    for op, value in items[negated:]:
        if op is sre.LITERAL:
            parts.append(_char(value))
        elif op is sre.RANGE:
            parts.append(f"{_char(value[0])}-{_char(value[1])}")
        elif op is sre.CATEGORY and value in SETS:
            parts.append(SETS[value])
        elif op is sre.CATEGORY and value in INVERSE:
            parts.append(f"[^{SETS[INVERSE[value]]}]")
        else:
            raise Untranslatable(f"in a set: {op}")
    return f"[{'^' * negated}{''.join(parts)}]"


def _java(tree) -> str:
    out = []
    for op, value in tree:
        if op is sre.LITERAL:
            out.append(_char(value))
        elif op is sre.NOT_LITERAL:
            out.append(f"[^{_char(value)}]")
        elif op is sre.ANY:
            out.append(r"[^\n]")
        elif op is sre.IN:
            out.append(_set(value))
        elif op is sre.BRANCH:
            out.append("(?:" + "|".join(map(_java, value[1])) + ")")
        elif op is sre.SUBPATTERN and not value[1] and not value[2]:
            out.append(f"({'' if value[0] else '?:'}{_java(value[3])})")
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = value
            if body.getwidth()[0] == 0 and high != 1:
                raise Untranslatable("a repeat of what may be empty")
            most = "" if high is sre.MAXREPEAT else high
            out.append(f"(?:{_java(body)}){{{low},{most}}}" + {sre.MAX_REPEAT: "", sre.MIN_REPEAT: "?", sre.POSSESSIVE_REPEAT: "+"}[op])
        elif op is sre.ATOMIC_GROUP:
            out.append(f"(?>{_java(value)})")
        elif op in (sre.ASSERT, sre.ASSERT_NOT) and value[0] == 1:
            out.append(f"(?{'=' if op is sre.ASSERT else '!'}{_java(value[1])})")
        elif op is sre.GROUPREF:
            out.append(rf"(?:\{value})")
        elif op is sre.AT and value in (sre.AT_BEGINNING, sre.AT_BEGINNING_STRING):
            out.append(r"\A")
        elif op is sre.AT and value is sre.AT_END:
            out.append(r"(?=\n?\z)")
        elif op is sre.AT and value is sre.AT_END_STRING:
            out.append(r"\z")
        else:  # look-behinds and word edges: Java steps back by half a character beyond the basic plane
            raise Untranslatable(str(op))
    return "".join(out)


def java_pattern(pattern: str) -> str:
    """A Python pattern as Java's engine has to be told it; Untranslatable where it can't be."""
    tree = parser.parse(pattern)
    if tree.state.flags & ~re.UNICODE.value:
        raise Untranslatable("flags")
    if tree.getwidth()[0] == 0:
        raise Untranslatable("what may be empty, which Java also finds within a character")
    return _java(tree)


def java_replacement(pattern: str, replacement: str) -> str:
    r"""\1 and \g<n> become group references; what Java would read as one is escaped."""
    out, after_group = [], False
    for part in parser.parse_template(decode_escapes(replacement), re.compile(pattern)):
        if isinstance(part, int):
            out.append(f"${part}" if part else "$0")
            after_group = True
        elif part:
            out.append("".join("\\" + c if c in "$\\" or (after_group and not k and c.isdigit()) else c for k, c in enumerate(part)))
            after_group = False
    return "".join(out)


def native(rules: list[dict]) -> bool:
    """Whether the rules are one projection: few enough, and Java's engine can be told each."""
    try:
        for rule in rules:
            if rule["type"] == "regex":
                java_pattern(rule["pattern"])
    except Untranslatable:
        return False
    return len(rules) <= MAX_CHAIN


def apply_one(text: Column, rule: dict) -> Column:
    if rule["type"] == "regex":
        return F.regexp_replace(text, java_pattern(rule["pattern"]), java_replacement(rule["pattern"], rule["replacement"] or ""))
    return F.replace(text, F.lit(rule["pattern"]), F.lit(rule["replacement"] or ""))


def count_one(text: Column, rule: dict) -> Column:
    if rule["type"] == "regex":
        return F.regexp_count(text, F.lit(java_pattern(rule["pattern"])))
    gone = F.length(text) - F.length(F.replace(text, F.lit(rule["pattern"]), F.lit("")))
    return (gone / len(rule["pattern"])).cast("int")


def python_rule(rule: dict):
    """(text) -> (text, hits), for Arrow batches."""
    if rule["type"] == "regex":
        compiled, to = re.compile(rule["pattern"]), decode_escapes(rule["replacement"] or "")
        return lambda text: compiled.subn(to, text)
    old, new = rule["pattern"], rule["replacement"] or ""
    return lambda text: (text.replace(old, new), text.count(old))


def apply_rules(df: DataFrame, rules: list[dict], *, text_col: str = "text") -> DataFrame:
    """df with text_col rewritten by all rules in turn."""
    if native(rules):
        text = F.col(text_col)
        for rule in rules:
            text = apply_one(text, rule)
        return df.withColumn(text_col, text)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = [python_rule(r) for r in rules]

        def rewrite(text):
            for step in steps if text is not None else ():
                text = step(text)[0]
            return text

        for batch in batches:
            yield batch.map(rewrite)

    return df.withColumn(text_col, run(text_col))


def rule_hits(df: DataFrame, rules: list[dict], *, text_col: str = "text") -> DataFrame:
    """(rule_id, hit_count) summed over all rows: each rule counted on what the rules before it left.

    Each step is a column of its own so that a text is rewritten once, not once for every later rule."""
    if not rules:
        return df.sparkSession.createDataFrame([], "rule_id string, hit_count long")
    if not native(rules):
        return _python_hits(df, rules, text_col)
    step = lambda state, rule: F.struct(apply_one(state["text"], rule).alias("text"), F.concat(state["hits"], F.array(F.coalesce(count_one(state["text"], rule), F.lit(0)))).alias("hits"))
    state = F.array(F.struct(F.col(text_col).alias("text"), F.array().cast("array<int>").alias("hits")))
    for rule in rules:  # bound once by each transform
        state = _bound(state, step, rule)
    counts = df.select(state[0]["hits"].alias("_hits"))
    sums = counts.agg(*(F.sum(F.col("_hits")[k].cast("long")).alias(str(k)) for k in range(len(rules))))
    named = F.array(*(F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.coalesce(F.col(str(k)), F.lit(0)).alias("hit_count")) for k, r in enumerate(rules)))
    return sums.select(F.explode(named).alias("r")).select("r.*").where("hit_count > 0")


def _bound(state: Column, step, rule: dict) -> Column:
    return F.transform(state, lambda s: step(s, rule))


def _python_hits(df: DataFrame, rules: list[dict], text_col: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [python_rule(r) for r in rules]
        for batch in batches:
            hits = [0] * len(steps)
            for text in batch.column(0):
                text = text.as_py()
                for k, step in enumerate(steps if text is not None else ()):
                    text, n = step(text)
                    hits[k] += n
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(hits)), pa.int32()), "n": pa.array(hits, pa.int64())})

    sums = df.select(F.col(text_col).cast("string")).mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("hit_count")).where("hit_count > 0")
    named = df.sparkSession.createDataFrame([(k, r["rule_id"]) for k, r in enumerate(rules)], "place int, rule_id string")
    return named.join(sums, "place").select("rule_id", "hit_count")
