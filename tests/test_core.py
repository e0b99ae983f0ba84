"""Text operators against small, independent restatements in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexiflow.functions import normalize as norm
from lexiflow.operators import match, review, rules, stats
from lexiflow.plans import compile as comp
from lexiflow.plans import rewrite as rw
from lexiflow.schema import ENTRY
from lexiflow.sources import lexicon as src


def one(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in df.select("i", expression(F.col("t")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "given,wanted",
    [
        ("0 10 110 100010", "零 十 一百一十 十萬零十"),
        ("007 00.5 -3.05 +5", "零零七 零點五 負三點零五 五"),
        ("A12 v1.2 1,000", "A12 v1.2 一,零零零"),
        ("臺北　 車站", "台北車站"),
        ("你好 ， 再見", "你好，再見"),
        ("好\n 好", "好\n 好"),
        ("𠀀 好", "𠀀好"),
        (" １２ ٣ \x1c", "十二 三"),
        ("100000000000000000000 20000300000004", "一零零零零零零零零零零零零零零零零零零零零 二十兆零三億零四"),
        ("12345 10000 10001 10100 1000000000000", "一萬二千三百四十五 一萬 一萬零一 一萬零一百 一兆"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize(spark, given, wanted):
    assert one(spark, norm.normalize_text, [given]) == [wanted]


def test_tidy(spark):
    assert one(spark, norm.tidy, ["這馬咧咧！！！真正真??,,，，。。"]) == ["這馬咧！真?,，。"]


WORDS = ["ab", "abc", "b", "bc", "ca", "cab", "a"]


def greedy(text, words):
    out, at = [], 0
    while at < len(text):
        fit = max((w for w in words if text.startswith(w, at)), key=len, default=None)
        if fit:
            out.append((at, at + len(fit), fit))
        at += len(fit) if fit else 1
    return out


def test_matching_equals_a_greedy_walk(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd😀") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    pairs = {w: w.upper() + "!" for w in WORDS}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    many = pairs | {f"zz{k}": "q" for k in range(match.MAX_INLINE)}
    spans = one(spark, lambda t: match.match_spans(t, match.trie_pattern(WORDS)), texts)
    for table in (pairs, many):
        done = {r.i: r.text for r in match.replace_phrases(df, table).collect()}
        for i, t in enumerate(texts):
            want, at = "", 0
            for s, e, w in greedy(t, WORDS):
                want, at = want + t[at:s] + pairs[w], e
            assert done[i] == want + t[at:]
    assert [[tuple(s) for s in row] for row in spans] == [greedy(t, WORDS) for t in texts]


def slow_choose(length, candidates, reserved):
    """Occupancy by position, candidates by start: the definition, step by step."""
    taken = set()
    for s, e in reserved:
        taken.update(range(s, e))
    out, at = [], 0
    while at < length:
        free = [c for c in candidates if c[0] == at and not taken & set(range(c[0], c[1]))]
        if at in taken or not free:
            at += 1
            continue
        best = min(free, key=lambda c: (-(c[1] - c[0]), *c[2:]))
        out.append(best)
        taken.update(range(best[0], best[1]))
        at = best[1]
    return out


def test_choose_equals_the_definition():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randint(1, 12)
        spans = lambda k: [(s, rng.randint(s + 1, n)) for s in (rng.randrange(n) for _ in range(k))]  # noqa: B023, E731
        held = [c[:2] for c in slow_choose(n, [(s, e, 0) for s, e in spans(rng.randint(0, 3))], [])]
        cands = [(s, e, rng.randint(0, 2), rng.randint(0, 2), 0.0, f"{k}") for k, (s, e) in enumerate(spans(rng.randint(0, 8)))]
        table = {}
        for s, e, rank, priority, score, name in cands:
            table.setdefault(s, []).append((e, {"layer_rank": rank, "priority": -priority, "score": score, "entry_id": name}))
        got = [(s, e, x["entry_id"]) for s, e, x in rw.Runtime.choose(table, sorted(held))]
        assert got == [(c[0], c[1], c[5]) for c in slow_choose(n, cands, held)]


def entry(src_, tgt, level="phrase", tier="base", **more):
    return {"entry_id": f"{tier}:{src_}:{tgt}", "src": src_, "tgt": tgt, "level": level, "tier": tier, "priority": 10, "context": None, "score": 0.0, "status": "active", "source": "", "trust": "seed", "updated_by": "", "updated_at": ""} | more


def compiled(spark, rows, core=(), allow=(), rule_rows=None):
    e = src.with_entry_defaults(spark.createDataFrame(rows, ENTRY))
    c = src.core_entries(spark.createDataFrame(list(core), ENTRY))
    a = spark.createDataFrame([(t,) for t in allow], "term string")
    r = rules.default_rules(spark) if rule_rows is None else spark.createDataFrame(rule_rows, "rule_id string, pass_name string, type string, pattern string, replacement string, priority int, enabled boolean, note string")
    return comp.compile_lexicon(e, c, a, r)


def convert(spark, made, texts, **options):
    runtime = rw.build_runtime(made, rw.Options(**options))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.result for r in rw.rewrite(df, runtime).orderBy("i").collect()]


def test_rewrite_end_to_end(spark):
    rows = [
        entry("今天", "今仔日"),
        entry("今天氣", "毋著", tier="blocked", trust="human"),
        entry("天氣", "天時"),
        entry("很好", "真好"),
        entry("好", "讚", level="char", tier="manual", trust="human"),
        entry("你好嗎。", "食飽未。", level="sentence", tier="manual", trust="human"),
        entry("台北", "台北"),
        entry("行", "走", tier="manual", trust="human", context={"left_regex": None, "right_regex": None, "full_regex": None, "left_literal": "步", "right_literal": None}),
        entry("北車", "北站"),
    ]
    made = compiled(spark, rows, allow=["天然"])
    texts = ["今天天氣很好", "今天氣很好", "你好嗎。", "臺北很好", "台北車站", "步行步行", "為什麼東西好！！", None, ""]
    got = convert(spark, made, texts)
    assert [g.output for g in got[:7]] == ["今仔日天時真讚", "今天氣真讚", "食飽未。", "台北真讚", "台北站站", "步走步走", "是按怎物件讚！"]
    assert got[7].output is None and got[8].output == "" and got[8].matches == []
    assert got[1].warnings == ["blocked:blocked:今天氣:毋著:今天氣"] * 2
    assert [(m.src, m.start, m.end) for m in got[0].matches] == [("今天", 0, 2), ("天氣", 2, 4), ("很好", 4, 6), ("好", 6, 7)]
    assert [(r.pattern, r.hit_count) for r in got[6].rules_applied] == [("為什麼", 1), ("東西", 1)]
    queue = rw.low_confidence(rw.rewrite(spark.createDataFrame([("沒有",), ("今天",)], "text string"), rw.build_runtime(made))).collect()
    assert [q.evidence.input for q in queue] == ["沒有"]
    masked = convert(spark, made, ["x今天y 今天"], regex_masks=("x..", ))
    assert masked[0].output == "x今天y 今仔日"
    assert convert(spark, made, [" 今天  好 "], preserve_spacing=True)[0].output == " 今仔日  讚 "
    m = made.manifest.first()
    assert (m.entry_count, m.identity_passthrough_protected_entry_count, m.protected_term_count) == (9, 1, 2)


def test_protected_spans_equal_the_runtime_mask(spark):
    rng = random.Random(3)
    terms, phrases = ["ab", "abc", "cd", "bcd"], ["bc", "abcd", "d", "cda"]
    runtime = rw.Runtime([{**entry(p, "!"), "layer_rank": 5} for p in phrases], terms, [], [])
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(300)] + ["ab", "abc"]
    spans = one(spark, lambda t: match.protected_spans(t, terms, match.occurrences(t, phrases)), texts)
    for text, row in zip(texts, spans):
        masked, _ = runtime.mask(text)
        kept = [(m.start(), m.end()) for m in re.finditer(r"([-])\1*", masked)]
        assert [(s.start, s.end) for s in row] == kept, text


def test_rules_in_batches_equal_the_chain(spark):
    made = [{"rule_id": str(k), "pass_name": "grammar", "type": "regex" if k % 2 else "literal", "pattern": f"[{chr(97 + k % 20)}]+" if k % 2 else chr(97 + k % 20), "replacement": chr(98 + k % 20), "priority": k} for k in range(40)]
    df = spark.createDataFrame([("the quick brown fox $1",), (None,), ("",)], "text string")
    chain = [r.text for r in rules.apply_rules(df, made).collect()]
    long = made + [{**made[0], "pattern": "￿", "type": "literal"}] * rules.MAX_CHAIN
    assert [r.text for r in rules.apply_rules(df, long).collect()] == chain
    odd = {"type": "regex", "pattern": r"(a)(?P<n>b)", "replacement": r"\2$\g<1>\\"}
    assert one(spark, lambda t: rules.apply_one(t, odd), ["xab"]) == ["x" + re.sub(odd["pattern"], odd["replacement"], "ab")]
    assert rules.decode_escapes(r"　\\u3000\U0001F600") == "　\\\\u3000😀"


def test_sources(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('# c\n\n {"entry_id":"a","src":"x","level":"phrase","tier":"base","trust":" human "}\n', encoding="utf-8")
    row = src.read_entries(spark, str(tmp_path / "e.jsonl")).first()
    assert (row.tgt, row.priority, row.status, row.trust) == ("", 0, "active", "human")
    assert src.read_entries(spark, str(tmp_path / "none.jsonl")).count() == 0 and src.read_allowlist(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        src.read_decisions(spark, str(tmp_path / "none.jsonl"))
    (tmp_path / "core.json").write_text('[{"src":" 他 ","tgt":"伊","level":"char"},{"src":"他們","tgt":"怹","priority":950}]', encoding="utf-8")
    got = {r.src: r for r in src.read_core(spark, str(tmp_path / "core.json")).collect()}
    assert (got["他"].priority, got["他們"].priority, got["他"].tier, got["他"].source) == (80, 950, "core", "core:lexicon")
    src.write_jsonl(spark.createDataFrame([(1, "é")], "a int, b string"), str(tmp_path / "out"))
    src.write_jsonl(spark.createDataFrame([(2, None)], "a int, b string"), str(tmp_path / "out"), append=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_decisions_in_order(spark, tmp_path):
    queue = spark.createDataFrame([(1, "q1", "pending"), (2, "q2", "pending"), (3, "q3", "resolved")], "line_no long, review_id string, status string")
    lex = spark.createDataFrame([("b1", "x", "y", "phrase", "base", 1, "active", "", "seed")], "entry_id string, src string, tgt string, level string, tier string, priority int, status string, source string, trust string")
    fields = review.decision_schema()
    line = lambda n, rid, d, **m: {f.split()[0]: None for f in fields.split(", ")} | {"line_no": n, "review_id": rid, "decision": d} | m
    lines = [line(1, None, "reject"), line(2, "q9", "reject"), line(3, "q3", "reject"), line(4, "q1", "disable_base_entry", src="zz"), line(5, "q1", "disable_base_entry", src="x"), line(6, "q1", "reject"), line(7, "q2", "add_override", src="n", tgt="m")]
    done = review.resolve(queue, lex, spark.createDataFrame(lines, fields))
    told = review.summary(done.outcomes).first()
    assert told.applied == 2 and told.errors == ["line 1: no_review_id", "line 2: unknown_review_id", "line 3: not_pending", "line 4: no_hit", "line 6: not_pending"]
    assert sorted((r.src, r.status) for r in done.lexicon.collect()) == [("n", "active"), ("x", "disabled")] and {i.status for i in done.queue.collect()} == {"resolved"}
    paths = {f"{k}_path": f"{tmp_path}/{k}" for k in ("queue", "lexicon", "audit")}
    for _ in range(2):
        review.store(done, **paths)
    review.store(done, **paths, dry_run=True)
    assert [spark.read.json(f"{tmp_path}/{k}").count() for k in ("queue", "lexicon", "audit")] == [3, 2, 4]


def slow_decisions(items, rows, lines):
    """The loop that decisions stand for."""
    items, rows, errors = {i: s for i, s in items}, [dict(r) for r in rows], []
    for n, x in enumerate(lines, 1):
        if not x["review_id"] or x["review_id"] not in items or items[x["review_id"]] != "pending" or x["decision"] not in review.ACTIONS:
            errors.append(n)
            continue
        if x["decision"] == "add_override":
            if not x["src"] or x["tgt"] is None:
                errors.append(n)
                continue
            new = {"entry_id": x["entry_id"], "src": x["src"], "tgt": x["tgt"], "level": x["level"] or "phrase", "tier": x["tier"] or "manual", "status": "active"}
            old = next((r for r in rows if r["entry_id"] == new["entry_id"]), None)
            old.update(new) if old else rows.append(new)
        elif x["decision"] == "disable_base_entry":
            hit = [r for r in rows if r["tier"] == "base" and r["status"] != "disabled" and (x["entry_id"] and r["entry_id"] == x["entry_id"] or x["src"] and r["src"] == x["src"]) and (not x["level"] or r["level"] == x["level"])]
            for r in hit:
                r["status"] = "disabled"
            if not hit:
                errors.append(n)
                continue
        items[x["review_id"]] = "resolved"
    return errors, sorted((r["entry_id"], r["src"], r["level"], r["tier"], r["status"]) for r in rows), items


def test_decisions_that_meet_each_other(spark):
    rng, fields = random.Random(5), review.decision_schema()
    for _ in range(4):
        items = [(f"q{k}", rng.choice(["pending", "pending", "resolved"])) for k in range(25)]
        rows = [{"entry_id": f"e{k}", "src": rng.choice("abc"), "tgt": "", "level": rng.choice(["phrase", "char"]), "tier": rng.choice(["base", "base", "core"]), "priority": 0, "status": "active", "source": "", "trust": "seed"} for k in range(6)]
        lines = []
        for n in range(40):
            row = {f.split()[0]: None for f in fields.split(", ")} | {"line_no": 3 * n, "review_id": rng.choice(["", None, *(f"q{k}" for k in range(28))]), "decision": rng.choice(["add_override", "disable_base_entry", "disable_base_entry", "reject", "huh"])}
            row |= {"entry_id": f"e{rng.randrange(8)}" if row["decision"] == "add_override" else rng.choice([None, "", f"e{rng.randrange(8)}"]), "src": rng.choice([None, "a", "b", "c"]), "tgt": rng.choice([None, "t"]), "level": rng.choice([None, "phrase", "char"]), "tier": rng.choice([None, "base"])}
            lines.append(row)
        queue = spark.createDataFrame([(n, *i) for n, i in enumerate(items)], "line_no long, review_id string, status string")
        lex = spark.createDataFrame([tuple(r.values()) for r in rows], "entry_id string, src string, tgt string, level string, tier string, priority int, status string, source string, trust string")
        done = review.resolve(queue, lex, spark.createDataFrame(lines, fields))
        errors, after, states = slow_decisions(items, rows, lines)
        assert [r.place for r in done.outcomes.where("error is not null").orderBy("place").collect()] == errors
        assert sorted((r.entry_id, r.src, r.level, r.tier, r.status) for r in done.lexicon.collect()) == after
        assert {r.review_id: r.status for r in done.queue.collect()} == states


def test_items_bring_their_own_columns(spark):
    items = spark.createDataFrame([("x", None), ("y", "rq_1")], "kind string, review_id string")
    got = review.complete(items, F.col("kind")).orderBy("kind").collect()
    assert [(r.review_id, r.status) for r in got] == [(None, "pending"), ("rq_1", "pending")] and got[0].created_at


def test_canonical_json():
    assert review.canonical_json({"b": 1, "a": "é"}) == '{"a": "é", "b": 1}'


def test_streams(spark, tmp_path):
    from lexiflow.streaming import rewrite_stream as rs

    spark.createDataFrame([(1, "ab c"), (2, "zz")], "i int, text string").write.parquet(f"{tmp_path}/in")
    runtime = rw.Runtime([{**entry("ab", "X"), "layer_rank": 5}], [], [], [])
    texts = rs.read_texts(spark, f"{tmp_path}/in", "i int, text string")
    rs.write_with_reviews(rs.rewrite_stream(texts, runtime), f"{tmp_path}/out", f"{tmp_path}/queue", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.result.output for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["X c", "zz"]
    assert spark.read.json(f"{tmp_path}/queue").count() == 1


def test_latency_of_few_rows(spark):
    for values, want in (([3.0, 1.0, 2.0], 2.0), ([5.0], 5.0), ([float(v) for v in range(100)], 94.0)):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        n = len(values)
        assert stats.latency(df, "v").first().p95_ms == sorted(values)[max(int(0.95 * n) - 1, 0)] == want or n == 3


def test_layers_equal_the_choice_among_all_candidates():
    rng = random.Random(11)
    for _ in range(60):
        word = lambda n: "".join(rng.choice("abc") for _ in range(n))
        rows = [{**entry(word(rng.randint(2, 5)), str(k)), "layer_rank": 5, "entry_id": str(k)} for k in range(8)]
        rows += [{**entry(word(rng.randint(1, 3)), "", tier="blocked"), "layer_rank": 0, "entry_id": f"b{k}"} for k in range(rng.randint(0, 2))]
        rows += [{**entry(rng.choice("abc"), "C", level="char"), "layer_rank": 7, "entry_id": "c"}]
        rows += [{**entry(word(2), "X", tier="manual", trust="human", context={"left_literal": rng.choice("abc")}), "layer_rank": 2, "entry_id": "x"}] * rng.randint(0, 1)
        runtime = rw.Runtime([dict(r) for r in rows], [], [], [])
        for _ in range(20):
            text, (low, high, chars) = word(rng.randint(0, 14)), rng.choice([(2, None, False), (1, 1, True), (1, None, True)])
            blocked = runtime.reserve(text)
            found = {}
            for table in (runtime.phrases, *([runtime.chars] if chars else [])):
                for a, b in table.found(text):
                    if low <= b - a <= (high or 99):
                        found.setdefault(a, []).append((b, table.of[text[a:b]][0]))
            for a, b in runtime.contextual.found(text):
                if low <= b - a <= (high or 99):
                    found.setdefault(a, []).extend((b, e) for e in runtime.contextual.of[text[a:b]] if rw.fits(text, a, b, e["context"]))
            want = runtime.choose(found, [(a, b) for a, b, _ in blocked])
            got = runtime.layers(text, low, high, chars, False)[1]
            assert [(m["start"], m["end"], m["entry_id"]) for m in got] == [(a, b, e["entry_id"]) for a, b, e in want]


def test_long_words():
    word = "ab" * 3000
    assert re.compile(match.trie_pattern([word, "ab", word + "c"])).match(word + "c")[0] == word + "c"
