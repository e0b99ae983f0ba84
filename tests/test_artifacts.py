"""Stored artifacts, their decoders, line order and the command line."""

import json

from pyspark.sql import functions as F

from lexiflow.__main__ import main
from lexiflow.plans import artifacts
from lexiflow.plans import compile as comp
from lexiflow.schema import ENTRY
from lexiflow.sources import lexicon as src

ROWS = [
    {"entry_id": "a", "src": "今天", "tgt": "今仔日", "level": "phrase", "tier": "manual", "trust": "human"},
    {"entry_id": "b", "src": "台北", "tgt": "台北", "level": "phrase", "tier": "manual", "trust": "human"},
    {"entry_id": "c", "src": "你好", "tgt": "食飽未", "level": "sentence", "tier": "manual", "trust": "human", "priority": 5},
    {"entry_id": "d", "src": "行", "tgt": "走", "level": "char", "tier": "manual", "trust": "human", "context": {"left_literal": "步"}},
    {"entry_id": "e", "src": "好", "tgt": "讚", "level": "char", "tier": "base", "trust": "seed", "priority": 9},
    {"entry_id": "f", "src": "好", "tgt": "好", "level": "char", "tier": "core", "trust": "seed"},
]


def write(path, rows):
    path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), encoding="utf-8")


def test_compile_again_only_when_a_source_changes(spark, tmp_path):
    write(tmp_path / "lexicon_entries.jsonl", ROWS)
    first = artifacts.ensure_ready(spark, str(tmp_path)).manifest.first()
    assert first.entry_count == 6 and first.rule_count == 12 and first.lexicon_stage == comp.LEXICON_STAGE
    assert artifacts.ensure_ready(spark, str(tmp_path)).manifest.first() == first
    write(tmp_path / "core_lexicon.json", [[{"src": "他", "tgt": "伊"}]])
    second = artifacts.ensure_ready(spark, str(tmp_path))
    assert second.manifest.first().entry_count == 7 and second.manifest.first().version != first.version
    assert second.entries.count() == second.manifest.first().runtime_entry_count


def test_without_a_lexicon_the_legacy_tables_are_migrated(spark, tmp_path):
    phrases = spark.createDataFrame([("很好", "真好"), ("很好", "真好"), ("一二三四五六七八九十一二", "長")], "src string, tgt string")
    chars = spark.createDataFrame([("好", "讚"), ("行", "走")], "src string, tgt string")
    (tmp_path / "char_verified_allowlist.txt").write_text("# c\n好\n", encoding="utf-8")
    made = artifacts.ensure_ready(spark, str(tmp_path), legacy=(phrases, chars))
    assert made.manifest.first().entry_count == 4
    rows = comp.migrate_legacy(phrases, chars, spark.createDataFrame([("好",)], "term string"))
    assert tuple(comp.migration_stats(rows, phrases, chars).first()) == (4, 3, 2, 1)


def test_lines_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    (tmp_path / "q").mkdir()
    for k in range(3):
        (tmp_path / "q" / f"part-{k}.txt").write_text("".join(f"{k * 10_000 + n}\n" for n in range(9_999 - 3_000 * k)), encoding="utf-8")
    for split in ("5000", "134217728"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        lines = src._lines(spark, f"{tmp_path}/q", False).withColumn("value", F.col("value").cast("int"))
        rows = [tuple(r) for r in lines.orderBy("line_no").collect()]
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [n for n, _ in rows] == list(range(1, len(rows) + 1)) and [v for _, v in rows] == sorted(v for _, v in rows)


def test_decoders(spark):
    entries = spark.createDataFrame([(0, "lx_a"), (1, "lx_b"), (2, "lx_c")], "place int, entry_id string")
    doc = lambda x: spark.createDataFrame([(json.dumps(x, ensure_ascii=False),)], "value string")
    got = {r.src: r.place for r in src.decode_char_map(doc({"v": 2, "m": {"好": 1, "行": [2, 9, "lx_a", "lx_z", -1], "": 1}}), entries).where("at < 2").orderBy("at", ascending=False).collect()}
    rows = sorted(tuple(r) for r in src.decode_char_map(doc({"v": 2, "m": {"好": 1, "行": [2, 9, "lx_a", "lx_z", -1], "": 1}}), entries).select("src", "place").collect())
    assert rows == [("好", 1), ("行", 0), ("行", 2)] and got["好"] == 1
    assert [tuple(r) for r in src.decode_char_map(doc({"map": {"x": "lx_c"}}), entries).select("src", "place").collect()] == [("x", 2)]
    sentences, contexts = src.decode_override_index(doc({"s": {"你好": [0, 2]}, "c": [1, "lx_c", 7]}), entries)
    assert sorted(tuple(r) for r in sentences.select("src", "at", "place").collect()) == [("你好", 0, 0), ("你好", 1, 2)] and sorted(r.place for r in contexts.collect()) == [1, 2]
    plan = src.decode_rule_plan(doc({"v": 6, "r": [[["臺", "台"], ["x"]], [["a+", "b", 1, 90]], [], []]})).orderBy("pass_name").collect()
    assert [(r.pass_name, r.place, r.pattern, r.replacement, r.type, r.priority, r.enabled) for r in plan] == [("grammar", 0, "a+", "b", "regex", 90, True), ("normalization", 0, "臺", "台", "literal", 0, True)]
    old = src.decode_rule_plan(doc({"pass_order": ["fluency"], "rules": {"fluency": [{"id": "r1", "k": "r", "p": "x+", "r": "y", "priority": 3}, {"rule_id": "r2", "type": "literal", "pattern": "p", "replacement": "q", "enabled": False}]}})).orderBy("place").collect()
    assert [(r.rule_id, r.type, r.pattern, r.replacement, r.priority, r.enabled) for r in old] == [("r1", "regex", "x+", "y", 3, True), ("r2", "literal", "p", "q", 0, False)]


def test_groups_of_entries(spark):
    rows = src.with_entry_defaults(spark.createDataFrame([{c.split()[0]: None for c in ENTRY.split(", ") if "struct" not in c} | r for r in ({"context": None} | {**r, "context": None if "context" not in r else {k: r["context"].get(k) for k in ("left_regex", "right_regex", "full_regex", "left_literal", "right_literal")}} for r in ROWS)], ENTRY))
    got = {(r.kind, r.src): r.entry_ids for r in comp.grouped_entries(rows).collect()}
    assert got == {("sentence", "你好"): ["c"], ("context", "行"): ["d"], ("char", "行"): ["d"], ("char", "好"): ["f", "e"]}
    assert comp.max_phrase_length(rows).first().n == 2 and comp.max_phrase_length(rows.limit(0)).first().n == 0


def test_command_line(spark, tmp_path):
    write(tmp_path / "lexicon_entries.jsonl", ROWS)
    data = ["--data-dir", str(tmp_path)]
    assert "entry_count: 6" in main(["compile", "--prepare", *data])
    assert main(["convert", *data, "今天", "台北"]) == ["今仔日台北"] or main(["convert", *data, "今天", "台北"]) == ["今仔日 台北"]
    assert json.loads(main(["convert", "--trace", "--enqueue-review", *data, "無"])[0])["output"] == "無"
    assert main(["review", "export", "--file", f"{tmp_path}/pending", *data]) == ["exported: 1"]
    (tmp_path / "unresolved.jsonl").write_text('{"x": 1}\nbroken\n', encoding="utf-8")
    assert main(["review", "import", "--file", f"{tmp_path}/unresolved.jsonl", *data]) == ["imported: 1"]
    items = src.read_reviews(spark, f"{tmp_path}/review_queue.jsonl").orderBy("kind").collect()
    assert [i.kind for i in items] == ["offline_unresolved", "online_low_confidence"] and all(i.review_id.startswith("rq_") and i.created_at for i in items)
    write(tmp_path / "d.jsonl", [{"review_id": items[0].review_id, "decision": "add_override", "src": "無", "tgt": "冇"}, {"review_id": "rq_none", "decision": "reject"}])
    told = json.loads(main(["review", "apply", "--file", f"{tmp_path}/d.jsonl", *data])[0])
    assert told["applied"] == 1 and told["errors"] == ["line 2: unknown_review_id"]
    assert main(["convert", *data, "無"]) == ["冇"] and spark.read.json(f"{tmp_path}/review_audit.jsonl").count() == 1
    spark.createDataFrame([("今天",)], "body string").write.parquet(f"{tmp_path}/in")
    assert main(["convert", *data, "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out", "--text-col", "body"]) == [] and spark.read.parquet(f"{tmp_path}/out").first().result == "今仔日"
