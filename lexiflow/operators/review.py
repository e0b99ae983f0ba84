"""The review queue: complete rows, ids, pending items, decisions and their audit.

The queue and the lexicon are relational. Decisions depend on each other in line order (what a line does to the
queue or the lexicon decides whether a later one may apply), so they fold on the driver: over the decisions, which people write
(``MAX_DECISIONS`` is checked), and the queue and lexicon rows that they name, which two semi-joins find
(``MAX_TOUCHED`` is checked). The effects go back to the whole queue and lexicon as joins."""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexiflow.functions.ids import entry_id, review_id
from lexiflow.operators.policy import trust
from lexiflow.schema import DECISION

MAX_DECISIONS, MAX_TOUCHED = 1_000_000, 5_000_000
TIME = "yyyy-MM-dd'T'HH:mm:ss"
ACTIONS = ("add_override", "disable_base_entry", "reject")


def with_ids(queue: DataFrame, canonical_col: str = "canonical") -> DataFrame:
    """Items without an id get one from their canonical JSON."""
    given = F.when(F.coalesce("review_id", F.lit("")) != "", F.col("review_id"))
    return queue.withColumn("review_id", F.coalesce(given, review_id(F.col(canonical_col))))


def complete(items: DataFrame, as_json: Column, now: Column | None = None) -> DataFrame:
    """Items as rows of the queue. What an item brings itself counts, also a null; else it gets an id
    from its canonical JSON, the time, and the status pending."""
    given = {"review_id": review_id(as_json), "created_at": F.date_format(now if now is not None else F.current_timestamp(), TIME), "status": F.lit("pending")}
    return items.withColumns({k: v for k, v in given.items() if k not in items.columns})


def append(rows: DataFrame, path: str) -> None:
    """Append rows to a queue or an audit of JSON lines; nulls are written, too."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


@F.pandas_udf(StringType())
def canonical(value: pd.Series) -> pd.Series:
    """JSON texts with sorted keys and the separators that ids are made of."""
    return value.map(lambda v: None if v is None else canonical_json(json.loads(v)))


def canonical_json(item: dict) -> str:
    return json.dumps(item, ensure_ascii=False, sort_keys=True)


def pending(queue: DataFrame, limit: int = 200) -> DataFrame:
    """The first pending items in file order; an item without a status is pending."""
    return queue.where("coalesce(status, 'pending') = 'pending'").orderBy("line_no").limit(limit)


def import_unresolved(rows: DataFrame, owner: str = "migration", reason: str = "offline_unresolved") -> DataFrame:
    """JSON values (column ``value``) as review items; malformed ones are left out."""
    kept = rows.where("trim(value) <> ''").where(F.try_parse_json("value").isNotNull())
    return kept.select(F.lit("offline_unresolved").alias("kind"), F.lit("add_override").alias("action"), F.lit(owner).alias("owner"), F.lit(reason).alias("reason"), F.col("value").alias("evidence"), F.lit("pending").alias("status"))


OVERRIDE = "entry_id string, src string, tgt string, level string, tier string, priority int, context string, score double, status string, source string, trust string, updated_by string"
OUTCOME = "line_no long, place int, review_id string, decision string, owner string, reason string, error string, op string, entry_id string, disabled_count int"


@dataclass
class Resolved:
    outcomes: DataFrame  # OUTCOME, one row a decision; error is null where it was applied
    queue: DataFrame  # the whole queue after the decisions
    lexicon: DataFrame  # the whole lexicon after them
    audit: DataFrame  # a row for each applied decision


@dataclass
class _State:
    """What the decisions so far have made of the rows that they name."""

    pending: dict[str, bool]
    rows: dict[str, list[dict]] = field(default_factory=lambda: defaultdict(list))  # by id
    of_src: dict[str, list[dict]] = field(default_factory=lambda: defaultdict(list))
    overrides: dict[str, dict] = field(default_factory=dict)
    disabled: dict[str, str] = field(default_factory=dict)  # to who did it

    def add(self, row: dict) -> None:
        self.rows[row["entry_id"]].append(row)
        self.of_src[row["src"]].append(row)

    def override(self, entry: dict) -> None:
        if held := self.rows[entry["entry_id"]]:
            if held[0] in self.of_src[held[0]["src"]]:
                self.of_src[held[0]["src"]].remove(held[0])
            held[0] |= entry
            self.of_src[entry["src"]].append(held[0])
        else:
            self.add(dict(entry))
        self.overrides[entry["entry_id"]] = self.rows[entry["entry_id"]][0]
        self.disabled.pop(entry["entry_id"], None)

    def disable(self, line: dict) -> int:
        named = self.rows.get(line["entry_id"] or "", []) + (self.of_src.get(line["src"], []) if line["src"] else [])
        hits = {id(r): r for r in named if r["tier"] == "base" and r["status"] != "disabled" and line["level"] in (None, "", r["level"])}
        for r in hits.values():
            r["status"] = "disabled"
            self.disabled[r["entry_id"]] = line["owner"]
        return len(hits)


def _bounded(df: DataFrame, most: int, what: str) -> list[dict]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return [r.asDict() for r in rows]


def with_override_defaults(decisions: DataFrame, owner: str) -> DataFrame:
    """The decisions with the defaults of the entries that they may write, and the writer."""
    rows = decisions.withColumn("owner", F.coalesce(F.when(F.col("owner") != "", F.col("owner")), F.lit(owner)))
    given = {"level": F.lit("phrase"), "tier": F.lit("manual"), "priority": F.lit(100), "score": F.lit(1.0), "status": F.lit("active"), "source": F.lit("review_queue")}
    new = rows.withColumns({k: F.coalesce(F.col(k), v) for k, v in given.items()}).withColumn("updated_by", F.col("owner")).withColumn("trust", trust())
    made = F.coalesce(F.when(F.col("entry_id") != "", F.col("entry_id")), entry_id(F.col("src"), F.col("tgt"), F.col("level"), F.col("tier"), F.col("source")))
    entry = F.struct(*(made.alias(c) if c == "entry_id" else F.col(c) for c in (x.split()[0] for x in OVERRIDE.split(", "))))
    return new.select("line_no", "owner", entry.alias("entry"))


def resolve(queue: DataFrame, lexicon: DataFrame, decisions: DataFrame, *, owner: str = "reviewer", now: Column | None = None) -> Resolved:
    """Apply the decisions in line order. Of queue rows with one id the last counts. A decision that fails
    leaves its item pending; a disabling one that hits no active base entry fails."""
    spark = decisions.sparkSession
    time = F.date_format(now if now is not None else F.current_timestamp(), TIME)
    made = with_override_defaults(decisions, owner)
    lines = _bounded(decisions.select("line_no", "review_id", "decision", "reason", "src", "tgt", "level", "entry_id").join(made, "line_no").orderBy("line_no"), MAX_DECISIONS, "decisions")
    last = Window.partitionBy("review_id").orderBy(F.desc("line_no"))
    named = decisions.select("review_id").where("review_id <> ''").distinct()
    items = queue.join(F.broadcast(named), "review_id", "left_semi").withColumn("_n", F.row_number().over(last)).where("_n = 1").select("review_id", "status")
    state = _State({r["review_id"]: r["status"] == "pending" for r in _bounded(items, MAX_DECISIONS, "queue items")})
    ids = decisions.select(F.col("entry_id").alias("_x")).unionAll(made.select("entry.entry_id")).where("_x <> ''").distinct()
    sources = decisions.where("decision = 'disable_base_entry'").select(F.col("src").alias("_x")).where("_x <> ''").distinct()
    by_id, by_src = (lexicon.join(F.broadcast(x), F.col(c) == F.col("_x"), "left_semi") for x, c in ((ids, "entry_id"), (sources.where("_x is not null"), "src")))
    for row in _bounded(by_id.unionByName(by_src.join(F.broadcast(ids), F.col("entry_id") == F.col("_x"), "left_anti")).select("entry_id", "src", "level", "tier", "status"), MAX_TOUCHED, "entries that decisions name"):
        state.add(row)

    outcomes = []
    for place, line in enumerate(lines, 1):
        rid, action, error, op, entry, n = line["review_id"], line["decision"], None, None, None, None
        if not rid:
            error = "no_review_id"
        elif rid not in state.pending:
            error = "unknown_review_id"
        elif not state.pending[rid]:
            error = "not_pending"
        elif action not in ACTIONS:
            error = "bad_decision"
        elif action == "add_override":
            if not line["src"] or line["tgt"] is None:
                error = "incomplete"
            else:
                new = line["entry"].asDict()
                state.override(new)
                op, entry = "add_or_update_override", new["entry_id"]
        elif action == "disable_base_entry":
            n = state.disable(line)
            op, error = ("disable_base_entry", None) if n else (None, "no_hit")
        else:
            op = "reject"
        if error is None:
            state.pending[rid] = False
        outcomes.append((line["line_no"], place, rid, action, line["owner"], line["reason"], error, op, entry, n))
    told = spark.createDataFrame(outcomes, OUTCOME)
    applied = told.where("error is null")

    done = applied.select("review_id", F.lit("resolved").alias("_status"), F.col("owner").alias("_by"), F.col("decision").alias("_decision"), F.coalesce("reason", F.lit("")).alias("_reason"))
    newest = queue.groupBy("review_id").agg(F.max("line_no").alias("_last"))
    marked = queue.join(done.join(newest, "review_id"), "review_id", "left").withColumn("_hit", F.col("_status").isNotNull() & (F.col("line_no") == F.col("_last")))
    value = {"status": F.col("_status"), "resolved_by": F.col("_by"), "decision": F.col("_decision"), "decision_reason": F.col("_reason"), "resolved_at": time}
    kept = lambda c: F.col(c) if c in queue.columns else F.lit(None).cast("string")
    after = marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(kept(c)) for c, v in value.items()}).drop("_status", "_by", "_decision", "_reason", "_last", "_hit")

    fields = [x.split()[0] for x in OVERRIDE.split(", ")]
    new = spark.createDataFrame([tuple(r.get(f) for f in fields) for r in state.overrides.values()], OVERRIDE).withColumn("updated_at", time)
    if "context" in lexicon.columns:
        new = new.withColumn("context", F.from_json("context", lexicon.schema["context"].dataType))
    gone = spark.createDataFrame([x for x in sorted(state.disabled.items()) if x[0] not in state.overrides], "_gone string, _by string")
    changed = lexicon.join(gone, F.col("entry_id") == F.col("_gone"), "left").join(new.select(F.col("entry_id").alias("_new")), F.col("entry_id") == F.col("_new"), "left_anti")
    # only base rows of an id are disabled
    off = F.col("_gone").isNotNull() & (F.col("tier") == "base")
    to = {"status": F.lit("disabled"), "updated_by": F.col("_by"), "updated_at": time}
    changed = changed.select(*(F.when(off, to[c]).otherwise(F.col(c)).alias(c) if c in to else F.col(c) for c in lexicon.columns))
    rewritten = changed.unionByName(new.select(*(c for c in new.columns if c in lexicon.columns)), allowMissingColumns=True)
    result = F.struct("op", "entry_id", "disabled_count")
    audit = applied.select("review_id", F.col("decision").alias("action"), "owner", F.coalesce("reason", F.lit("")).alias("reason"), time.alias("applied_at"), result.alias("result"))
    return Resolved(told, after, rewritten, audit)


def store(resolved: Resolved, *, queue_path: str, lexicon_path: str, audit_path: str, dry_run: bool = False) -> None:
    """Write what the decisions made: the queue and the lexicon anew, the audit appended if there is something to tell.

    What is written may replace what it was read from, so it is checkpointed first: the session needs a checkpoint folder."""
    if dry_run:
        return
    written = [(df.checkpoint(), path) for df, path in ((resolved.queue, queue_path), (resolved.lexicon, lexicon_path))]
    for df, path in written:
        df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    if not resolved.audit.isEmpty():
        append(resolved.audit, audit_path)


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts of the decisions, and the failed ones as ``line n: error`` in order."""
    ok = F.col("error").isNull()
    failed = F.sort_array(F.collect_list(F.when(~ok, F.struct("place", "error"))))  # at most MAX_DECISIONS
    return outcomes.agg(
        F.count(F.lit(1)).alias("total_decisions"),
        F.count_if(ok).alias("applied"),
        *(F.count_if(ok & (F.col("decision") == a)).alias(a) for a in ACTIONS),
        F.transform(failed, lambda e: F.concat(F.lit("line "), e["place"].cast("string"), F.lit(": "), e["error"])).alias("errors"),
    )


def decision_schema() -> str:
    return f"line_no long, {DECISION}"
