"""Compile a lexicon and its rules into runtime relations.

Everything is a relation until the end: unions, windows, semi and anti joins on ids, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.ids import entry_id
from lexiflow.operators import lints, policy
from lexiflow.operators.rules import expand_tokens
from lexiflow.schema import TRUSTS

# Fixed values.
RESIDUAL_TERMS = ("東西", "什麼", "為什麼", "為何")
LEXICON_STAGE = "split_char_after_rules"
SENTENCE_LENGTH = 12


@dataclass(frozen=True)
class Compiled:
    entries: DataFrame  # runtime entries in order, with layer_rank and place
    excluded: DataFrame  # entry_id, reason
    protected: DataFrame  # term
    residual: DataFrame  # term, is_core
    rules: DataFrame
    manifest: DataFrame


def last_wins(*parts: DataFrame) -> DataFrame:
    """Union by entry_id: of equal ids the row of the last part stays, at the first one's place."""
    tagged = None
    for k, part in enumerate(parts):
        row = part.withColumn("_part", F.lit(k)).withColumn("_row", F.monotonically_increasing_id())
        tagged = row if tagged is None else tagged.unionByName(row, allowMissingColumns=True)
    same = Window.partitionBy("entry_id")
    placed = tagged.withColumn("_first", F.min(F.struct("_part", "_row")).over(same)).withColumn("_n", F.row_number().over(same.orderBy(F.desc("_part"), F.desc("_row"))))
    return placed.where("_n = 1").orderBy("_first").drop("_part", "_row", "_first", "_n")


def identity_entries(entries: DataFrame) -> DataFrame:
    """Active phrases and sentences without context that map to themselves, blocked ones aside."""
    return entries.where("status = 'active' and tier <> 'blocked' and level in ('phrase', 'sentence') and src <> '' and src = tgt").where(~policy.has_context())


def core_identities(core: DataFrame) -> DataFrame:
    return core.where("status = 'active' and level in ('phrase', 'sentence') and length(src) > 1 and src = tgt")


def protected_terms(entries: DataFrame, core: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Distinct terms of two or more characters that rewriting leaves alone, longest first."""
    terms = allowlist.select("term").unionAll(identity_entries(entries).select(F.col("src").alias("term"))).unionAll(core_identities(core).select(F.col("src").alias("term")))
    return terms.where("length(term) > 1").distinct().orderBy(F.length("term").desc(), "term")


def residual_terms(active: DataFrame, rules: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms that an active entry or literal rule rewrites to something else."""
    rewritten = active.where("src <> '' and src <> coalesce(tgt, '')").select(F.col("src").alias("term"))
    literal = rules.where("enabled and type = 'literal' and pattern <> '' and pattern <> coalesce(replacement, '')").select(F.col("pattern").alias("term"))
    return terms.join(lints.by_shuffle(rewritten.unionAll(literal)), "term", "left_semi")


def kind_defaults(entries: DataFrame) -> DataFrame:
    """The most frequent priority and score for each (level, tier, trust); the first seen by id of equals."""
    kind = ["level", "tier", "trust"]
    out = entries.select(*kind).distinct()
    for name in ("priority", "score"):
        counts = entries.groupBy(*kind, name).agg(F.count(F.lit(1)).alias("_n"), F.min("entry_id").alias("_first"))
        order = Window.partitionBy(*kind).orderBy(F.desc("_n"), "_first")
        best = counts.withColumn("_k", F.row_number().over(order)).where("_k = 1").select(*kind, F.col(name).alias(f"default_{name}"))
        out = out.join(best, kind)
    return out


def with_reasons(entries: DataFrame, core: DataFrame) -> DataFrame:
    """Every entry with the reason why it isn't in the runtime lexicon, or null."""
    core_ids = core_identities(core).select("entry_id", F.lit(True).alias("_core"))
    same_ids = identity_entries(entries).select("entry_id", F.lit(True).alias("_same"))
    joined = entries.join(lints.by_shuffle(core_ids.distinct()), "entry_id", "left").join(lints.by_shuffle(same_ids.distinct()), "entry_id", "left")
    reason = (
        F.when(F.col("_core"), "core_identity_protected_term")
        .when(F.col("_same") & ~policy.is_sentence_override(), "identity_passthrough_masked")
        .otherwise(policy.exclusion_reason())
    )
    return joined.withColumn("reason", reason).drop("_core", "_same")


def check_trust(entries: DataFrame) -> DataFrame:
    """Fails when evaluated if a row's trust isn't one of the three."""
    ok = F.coalesce(F.col("trust"), F.lit("")).isin(*TRUSTS)
    return entries.withColumn("trust", F.when(ok, F.col("trust")).otherwise(F.raise_error(F.concat(F.lit("invalid trust in entry "), F.col("entry_id")))))


def count_if(test: Column | str) -> Column:
    return F.count_if(F.expr(test) if isinstance(test, str) else test)


def compile_lexicon(entries: DataFrame, core: DataFrame, allowlist: DataFrame, rules: DataFrame, *, fail_on_lint: bool = False) -> Compiled:
    everything = last_wins(check_trust(entries), core)
    judged = with_reasons(everything, core)
    kept = judged.where("reason is null").drop("reason")
    active = kept.where("status = 'active'")
    rules = expand_tokens(rules)
    named = allowlist.sparkSession.createDataFrame([(t,) for t in RESIDUAL_TERMS], "term string")
    residual = residual_terms(active, rules, named).withColumn("is_core", F.lit(True))
    every_term = named.join(residual, "term", "left").select("term", F.coalesce("is_core", F.lit(False)).alias("is_core"))
    ranked = kept.withColumn("layer_rank", policy.layer_rank())
    protected = protected_terms(entries, core, allowlist)
    found = lints.masked_rules(rules), lints.regex_hazards(rules), lints.conflicting_rules(rules)
    if fail_on_lint and any(not x.isEmpty() for x in found):
        raise ValueError("the rules have lint findings")
    manifest = manifest_of(judged, core, rules, protected, residual, found)
    return Compiled(ranked.orderBy(*policy.entry_order()), judged.where("reason is not null").select("entry_id", "reason"), protected, every_term, rules.orderBy(*policy.rule_order()), manifest.withColumn("lexicon_stage", F.lit(LEXICON_STAGE)))


MANIFEST = {
    "entry_count": "true",
    "runtime_entry_count": "reason is null",
    "runtime_excluded_entry_count": "reason is not null",
    "active_entry_count": "reason is null and status = 'active'",
    "core_identity_protected_entry_count": "reason = 'core_identity_protected_term'",
    "identity_passthrough_protected_entry_count": "reason = 'identity_passthrough_masked'",
}


def manifest_of(judged: DataFrame, core: DataFrame, rules: DataFrame, protected: DataFrame, residual: DataFrame, found: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """One row of counts. Each relation is counted once, in a branch of its own, and the branches' few rows meet in one sum."""
    counts = judged.agg(*(count_if(test).alias(name) for name, test in MANIFEST.items()))
    of_rules = rules.agg(F.count(F.lit(1)).alias("rule_count"), count_if("enabled").alias("active_rule_count"))
    others = zip(("core_entry_count", "protected_term_count", "residual_core_term_count", "mask_warning_count", "regex_hazard_count", "pipeline_conflict_count"), (core, protected, residual, *found))
    parts = [counts, of_rules, *(df.agg(F.count(F.lit(1)).alias(name)) for name, df in others)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.agg(*(F.sum(c).alias(c) for c in every.columns))


def grouped_entries(active: DataFrame) -> DataFrame:
    """(kind, src, entry_ids): active entries by source text, in the order of entries: sentence overrides, contextual ones and characters."""
    kinds = {"sentence": policy.is_sentence_override(), "context": policy.is_trusted_manual() & policy.has_context(), "char": F.col("level") == "char"}
    order = policy.sort_key()
    tagged = active.withColumn("kind", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in kinds.items())))))
    ids = F.sort_array(F.collect_list(F.struct(*order)))
    return tagged.groupBy("kind", "src").agg(F.transform(ids, lambda e: e["entry_id"]).alias("entry_ids"))


def max_phrase_length(entries: DataFrame) -> DataFrame:
    """(n): the longest source text of active phrases and sentences without context; 0 without any."""
    kept = entries.where("level in ('phrase', 'sentence') and status = 'active'").where(~policy.has_context())
    return kept.agg(F.coalesce(F.max(F.length("src")), F.lit(0)).alias("n"))


def migration_stats(migrated: DataFrame, phrases: DataFrame, chars: DataFrame) -> DataFrame:
    """One row: entries written, source rows of phrases and of characters, and active characters."""
    made = migrated.agg(F.count(F.lit(1)).alias("lexicon_entries"), count_if("level = 'char' and status = 'active'").alias("char_active"))
    every = made.unionByName(phrases.agg(F.count(F.lit(1)).alias("phrase_entries")), allowMissingColumns=True).unionByName(chars.agg(F.count(F.lit(1)).alias("char_entries")), allowMissingColumns=True)
    return every.agg(*(F.sum(c).alias(c) for c in ("lexicon_entries", "phrase_entries", "char_entries", "char_active")))


def excluded_reasons(judged: DataFrame) -> DataFrame:
    return judged.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def migrate_legacy(phrases: DataFrame, chars: DataFrame, allowlist: DataFrame) -> DataFrame:
    """(src, tgt) tables of phrases and characters as entries; long phrases are sentences, and
    characters are active if the allowlist has them."""
    long = F.length("src") >= SENTENCE_LENGTH
    phrase = phrases.select("src", "tgt", F.when(long, "sentence").otherwise("phrase").alias("level"), F.when(long, 60).otherwise(40).alias("priority"), F.lit("active").alias("status"), F.lit("legacy:phrase_lexicon").alias("source"))
    known = allowlist.select(F.col("term").alias("src"), F.lit(True).alias("_known")).distinct()
    char = chars.join(known, "src", "left").select("src", "tgt", F.lit("char").alias("level"), F.lit(10).alias("priority"), F.when(F.col("_known"), "active").otherwise("disabled").alias("status"), F.lit("legacy:char_lexicon").alias("source"))
    both = phrase.unionByName(char).withColumn("tier", F.lit("base")).dropDuplicates(["src", "tgt", "level", "tier", "status"])
    return both.withColumns({"entry_id": entry_id(F.col("src"), F.col("tgt"), F.col("level"), F.col("tier"), F.col("source")), "score": F.lit(0.0), "trust": F.lit("seed"), "updated_by": F.lit("migration")})
