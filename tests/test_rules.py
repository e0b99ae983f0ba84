"""Rules mean what Python's engine makes of them, by either way of running them."""

import random
import re

import pytest

from lexiflow.operators import rules

TEXTS = ["a\x1cb", "naïve café éx", "[a]b[", "1 Ⅷ ② ٣ 10", "a\nb\n", "aab abab xyxy", "", "tab\there　wide\xa0end \n", "𠀀好𠀀 好", "x$1\\y", "the theme then", "aaa,,b", None]
NATIVE = [(r"\s", "_"), (r"[[a]", "<"), (r"\d+", "#"), (r"[^\W\d]+", "w"), (r"b$", "E"), (r"b\Z", "Z"), (r"^a", "A"), (r"(a)(b)?", r"\2\g<1>0"), (r"(?P<x>ab)(?P=x)", r"\g<x>!"), (r".", "."), (r"[\s\d]", ""), (r"(?:好|𠀀)+", "H"), (r"(th)(?=e)", r"\1\1"), (r"a{2,3}?", "$1"), (r"\$\d", r"\\"), (r"[^\s,]*,", r"好"), (r"[a-c&&x]", "&"), (r"(?>a+)b", "P"), (r"a++", "Q"), (r"[]\-^]", "]"), (r"\.", r"\n")]
PYTHON = [(r"\w\b", "W"), (r"(?<=a)b", "L"), (r"(?i)THE", "i"), (r"(?m)^b", "m"), (r"(a*)*b", "r"), (r"(a)?(?(1)b|x)", "c"), (r"x*", "-"), (r"$", "E")]


def rule(pattern, to, kind="regex", k=0):
    return {"rule_id": f"r{k}", "pass_name": "grammar", "type": kind, "pattern": pattern, "replacement": to, "priority": 0}


def want(text, steps):
    for r in steps:
        text = rules.python_rule(r)(text)[0] if text is not None else None
    return text


@pytest.mark.parametrize("pattern, to", NATIVE + PYTHON)
def test_each_pattern_alone_and_among_many(spark, pattern, to):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    idle = [rule(f"never there {k}", "", "literal", k) for k in range(1, rules.MAX_CHAIN + 1)]
    assert rules.native([rule(pattern, to)]) == ((pattern, to) in NATIVE) and not rules.native([rule(pattern, to), *idle])
    for steps in ([rule(pattern, to)], [rule(pattern, to), *idle]):
        got = {r.k: r.text for r in rules.apply_rules(df, steps).collect()}
        assert got == {k: want(t, steps) for k, t in enumerate(TEXTS)}
        hits = {r.rule_id: r.hit_count for r in rules.rule_hits(df, steps).collect()}
        n = sum(len(re.findall(pattern, t)) for t in TEXTS if t is not None)
        assert hits == ({"r0": n} if n else {})


def test_random_chains(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    for _ in range(3):
        steps = [rule(*rng.choice(NATIVE), k=k) for k in range(5)]
        assert {r.k: r.text for r in rules.apply_rules(df, steps).collect()} == {k: want(t, steps) for k, t in enumerate(TEXTS)}
