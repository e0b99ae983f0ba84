"""The whole rewriting of a text column: normalise, mask, lexicon layers, rules, clean up, unmask.

Normalisation and clean-up are column expressions. What lies between needs blocked, protected and
contextual spans of one text together; it runs in Arrow batches against a runtime that is built from the
compiled relations (a dictionary: its size is checked against ``MAX_ENTRIES`` and ships with the
tasks). Rows are independent, so nothing is shuffled.

Spans are code points. Selection follows from two facts: what was chosen before never overlaps what starts
at or after its end, so only reserved spans limit a candidate; and a protected term is kept exactly if no phrase
occurrence crosses its edge."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions.normalize import normalize_text
from lexiflow.operators import rules as rule_ops
from lexiflow.operators.match import trie_pattern
from lexiflow.plans.compile import Compiled
from lexiflow.schema import HIT, MATCH

MAX_ENTRIES = 2_000_000
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20  # of texts that a worker gets at once
SLICE_CHARS = 100_000  # of texts whose results are Python objects at once
PRIVATE = range(0xE000, 0xF900)
RESULT = f"output string, match_count int, matches array<{MATCH}>, rules_applied array<{HIT}>, warnings array<string>"
SHOWN = ("entry_id", "src", "tgt", "level", "tier")


def _wins(entry: dict) -> tuple:
    """Order of entries of one span."""
    return entry["layer_rank"], -(entry["priority"] or 0), -(entry["score"] or 0.0), entry["entry_id"]


class Table:
    """Source texts with their entries, best first. Those that are looked for within texts (scan) also have a pattern
    of the leftmost-longest ones, one of all starts, and the lengths that begin with a character."""

    def __init__(self, entries: list[dict], scan: bool = True):
        self.of: dict[str, list[dict]] = defaultdict(list)
        for e in sorted(entries, key=_wins):
            if e["src"]:
                self.of[e["src"]].append(e)
        self.of.default_factory = None
        if not scan or not self.of:
            self.longest = self.starts = None
            return
        lengths = defaultdict(set)
        for src in self.of:
            lengths[src[0]].add(len(src))
        self.lengths = {c: sorted(n) for c, n in lengths.items()}
        self.most = max(map(len, self.of))
        pattern = trie_pattern(list(self.of))
        self.longest, self.starts = re.compile(pattern), re.compile(f"(?={pattern})")

    def found(self, text: str) -> Iterator[tuple[int, int]]:
        """All occurrences, by start, then length."""
        for m in self.starts.finditer(text) if self.starts else ():
            start = m.start()
            for n in self.lengths[text[start]]:
                if text[start : start + n] in self.of and start + n <= len(text):
                    yield start, start + n

    def chosen(self, text: str, low: int = 0, high: int | None = None) -> Iterator[tuple[int, int]]:
        """Leftmost-longest occurrences within the bounds."""
        for m in self.longest.finditer(text, low, len(text) if high is None else high) if self.longest else ():
            yield m.span()

    def crosses(self, text: str, edge: int) -> bool:
        """Whether an occurrence begins before the edge and ends behind it."""
        if not self.starts:
            return False
        for start in range(max(0, edge - self.most + 1), edge):
            for n in self.lengths.get(text[start], ()):
                if start + n > edge and text[start : start + n] in self.of:
                    return True
        return False


def fits(text: str, start: int, end: int, context: dict | None) -> bool:
    """Whether what surrounds a span meets all conditions of a context."""
    if not context:
        return True
    left, right = text[:start], text[end:]
    tests = {
        "left_regex": lambda p: re.search(p, left),
        "right_regex": lambda p: re.search(p, right),
        "full_regex": lambda p: re.search(p, text),
        "left_literal": left.endswith,
        "right_literal": right.startswith,
    }
    return all(test(context[name]) for name, test in tests.items() if context.get(name))


@dataclass
class Options:
    preserve_spacing: bool = False
    stage: str = "split_char_after_rules"  # or before_rules
    regex_masks: tuple[str, ...] = ()


@dataclass
class Runtime:
    entries: list[dict]
    protected: list[str]
    rules: list[dict]
    residual: list[tuple[str, bool]]
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        active = [e for e in self.entries if e["status"] == "active"]
        for e in active:
            e["context"] = {k: v for k, v in (e["context"] or {}).items() if v} or None
        override = lambda e: e["layer_rank"] == 1
        phrases = [e for e in active if e["level"] != "char" and not e["context"] and not override(e)]
        chars = [e for e in active if e["level"] == "char"]
        blocked = lambda es: [e for e in es if e["tier"] == "blocked"]
        self.all_phrases = Table(phrases)
        self.phrases = Table([e for e in phrases if e["tier"] != "blocked"])
        self.chars = Table([e for e in chars if len(e["src"]) == 1])
        self.blocked = Table(blocked(phrases) + [e for e in blocked(chars) if len(e["src"]) == 1])
        self.blocked_whole = Table([e for e in blocked(active) if e["level"] == "sentence"], scan=False)
        self.overrides = Table([e for e in active if override(e)], scan=False)
        self.contextual = Table([e for e in active if e["context"] and e["tier"] in ("manual", "manual_hotfix") and e["trust"] == "human"])
        self.terms = Table([{"src": t, "layer_rank": 0, "priority": 0, "score": 0.0, "entry_id": t} for t in self.protected if len(t) > 1])
        self.steps = [(r, rule_ops.python_rule(r)) for r in self.rules if not (self.options.preserve_spacing and r["pass_name"] == "normalization")]
        self.masks = [re.compile(p) for p in self.options.regex_masks]
        self.scopes: dict[tuple, Table] = {}

    def within(self, low: int, high: int | None, chars: bool) -> Table:
        """Phrases, and with chars characters, whose lengths are in scope."""
        key = low, high, chars
        if key not in self.scopes:
            tables = [self.phrases, *([self.chars] if chars else [])]
            self.scopes[key] = Table([e for t in tables for src, es in t.of.items() if len(src) >= low and (high is None or len(src) <= high) for e in es])
        return self.scopes[key]

    @staticmethod
    def choose(candidates: dict[int, list[tuple[int, dict]]], reserved: list[tuple[int, int]]) -> list[tuple[int, int, dict]]:
        """Walk the starts from the left; of one start the longest, then the best, free candidate."""
        chosen, at, k = [], 0, 0
        for start in sorted(candidates):
            while k < len(reserved) and reserved[k][1] <= start:
                k += 1
            wall = reserved[k][0] if k < len(reserved) else None
            if start < at or (wall is not None and wall <= start):
                continue
            free = [c for c in candidates[start] if wall is None or c[0] <= wall]
            if free:
                end, entry = min(free, key=lambda c: (-c[0], *_wins(c[1])))
                chosen.append((start, end, entry))
                at = end
        return chosen

    def reserve(self, text: str) -> list[tuple[int, int, dict]]:
        if text not in self.blocked_whole.of:
            return [(a, b, self.blocked.of[text[a:b]][0]) for a, b in self.blocked.chosen(text)]
        found = defaultdict(list)
        for start, end in self.blocked.found(text):
            found[start].append((end, self.blocked.of[text[start:end]][0]))
        if text in self.blocked_whole.of:
            found[0].append((len(text), self.blocked_whole.of[text][0]))
        return self.choose(found, [])

    @staticmethod
    def said(spans) -> list[str]:
        return [f"blocked:{e['entry_id']}:{e['src']}" for _, _, e in spans]

    @staticmethod
    def trace(start: int, end: int, e: dict) -> dict:
        return {k: e[k] for k in SHOWN} | {"start": start, "end": end, "priority": e["priority"] or 0, "score": e["score"] or 0.0}

    def whole(self, text: str, blocked: list) -> dict | None:
        return None if blocked or not text or text not in self.overrides.of else self.overrides.of[text][0]

    def layers(self, text: str, low: int, high: int | None, chars: bool, sentences: bool) -> tuple[str, list[dict], list[str]]:
        blocked = self.reserve(text)
        warnings = self.said(blocked)
        scope = lambda n: n >= low and (high is None or n <= high)
        if sentences and scope(len(text)) and (e := self.whole(text, blocked)):
            return e["tgt"] or "", [self.trace(0, len(text), e)], warnings
        table = self.within(low, high, chars)
        walls = [(a, b) for a, b, _ in blocked]
        near = [(a, b, [e for e in self.contextual.of[text[a:b]] if fits(text, a, b, e["context"])]) for a, b in self.contextual.found(text) if scope(b - a)]
        if any(es for _, _, es in near):
            found = defaultdict(list)
            for start, end in table.found(text):
                found[start].append((end, table.of[text[start:end]][0]))
            for start, end, es in near:
                found[start] += [(end, e) for e in es]
            chosen = self.choose(found, walls)
        else:
            # what is chosen lies between reserved spans, and is there what the pattern finds
            edges = zip([0, *(b for _, b in walls)], [*(a for a, _ in walls), len(text)])
            chosen = [(a, b, table.of[text[a:b]][0]) for low_, high_ in edges for a, b in table.chosen(text, low_, high_)]
        out, at, traces = [], 0, []
        for start, end, e in chosen:
            out += [text[at:start], e["tgt"] or ""]
            traces.append(self.trace(start, end, e))
            at = end
        return "".join([*out, text[at:]]), traces, warnings

    def mask(self, text: str, heed_phrases: bool = True) -> tuple[str, dict[str, str]]:
        """Protected spans as runs of private-use characters, one for each span."""
        held: dict[str, str] = {}
        free = (chr(c) for c in PRIVATE if chr(c) not in text)

        def hide(original: str) -> str:
            sign = next(free, None)
            if sign is None:
                raise RuntimeError("a text has more protected spans than there are private-use characters")
            held[sign * len(original)] = original
            return sign * len(original)

        for pattern in self.masks:
            text = pattern.sub(lambda m: hide(m[0]) if m[0] else "", text)
        longest = {}
        for start, end in self.terms.found(text):
            longest[start] = end
        if not longest:
            return text, held
        # a phrase overlaps a span without lying in it exactly if it goes across one of the span's edges
        crossed = lambda a, b: heed_phrases and (self.all_phrases.crosses(text, a) or self.all_phrases.crosses(text, b))
        out, at = [], 0
        for start, end in sorted(longest.items()):
            if start >= at and (end - start == len(text) or not crossed(start, end)):
                out += [text[at:start], hide(text[start:end])]
                at = end
        return "".join([*out, text[at:]]), held

    def rewrite_rules(self, text: str) -> tuple[str, list[dict]]:
        hits = []
        for rule, step in self.steps:
            text, n = step(text)
            if n:
                hits.append({k: rule[k] for k in ("rule_id", "pass_name", "type", "pattern", "replacement")} | {"hit_count": n})
        return text, hits

    def convert(self, text: str, trace: bool = True) -> dict:
        """text is normalised."""
        if exact := self.whole(text, blocked := self.reserve(text)):
            masked, held = self.mask(exact["tgt"] or "", heed_phrases=False)
            ruled, hits = self.rewrite_rules(masked)
            done, after, warned = self.layers(ruled, 1, 1, True, False)
            matches, warnings = [self.trace(0, len(text), exact), *after], self.said(blocked) + warned
        else:
            masked, held = self.mask(text)
            if self.options.stage == "split_char_after_rules":
                first, before, warned = self.layers(masked, 2, None, False, True)
                ruled, hits = self.rewrite_rules(first)
                done, after, more = self.layers(ruled, 1, 1, True, False)
                matches, warnings = before + after, warned + more
            else:
                first, matches, warnings = self.layers(masked, 1, None, True, True)
                done, hits = self.rewrite_rules(first)
        done = re.sub(r"([,，。！？!?])\1+", r"\1", done.replace("這馬咧咧", "這馬咧").replace("真正真", "真"))
        warnings = warnings + [f"{'核心漏轉' if core else '華語殘留'}:{term}" for term, core in self.residual if term in done]
        for token in sorted(held, key=len, reverse=True):
            done = done.replace(token, held[token])
        return {"output": done, "match_count": len(matches), "matches": matches if trace else None, "rules_applied": hits, "warnings": warnings}


def build_runtime(compiled: Compiled, options: Options | None = None) -> Runtime:
    """Collect the compiled relations, which are dictionaries of checked size."""
    rows = compiled.entries.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a lexicon of more than {MAX_ENTRIES} entries doesn't fit a task's runtime")
    return Runtime(
        [r.asDict(recursive=True) for r in rows],
        [r.term for r in compiled.protected.collect()],
        rule_ops.plan(compiled.rules),
        [(r.term, r.is_core) for r in compiled.residual.collect()],
        options or Options(),
    )


class _Source:
    """What a runtime is built from. A worker builds it once and keeps it with the broadcast value."""

    def __init__(self, *parts):
        self.parts, self.built = parts, None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.__init__(*parts)

    def runtime(self) -> Runtime:
        if self.built is None:
            self.built = Runtime(*self.parts)
        return self.built


def source_of(runtime: Runtime) -> _Source:
    return _Source(runtime.entries, runtime.protected, runtime.rules, runtime.residual, runtime.options)


FIELDS = [
    ("output", pa.string()),
    ("match_count", pa.int32()),
    ("matches", pa.list_(pa.struct([(n, {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}[t]) for n, t in (x.split(":") for x in MATCH[7:-1].split(","))]))),
    ("rules_applied", pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in (x.split(":") for x in HIT[7:-1].split(","))]))),
    ("warnings", pa.list_(pa.string())),
]


def in_slices(texts: pa.Array, convert) -> pa.Array:
    """convert's results as Arrow structs; some texts at a time, as a match is many times larger as a Python object."""
    slices, done, chars = [], [], 0

    def flush() -> None:
        nonlocal done, chars
        slices.append(pa.StructArray.from_arrays([pa.array([d.get(n) for d in done], k) for n, k in FIELDS], names=[n for n, _ in FIELDS]))
        done, chars = [], 0

    for text in texts:
        done.append(convert(text.as_py()) if text.is_valid else {})
        chars += len(text.as_py() or "")
        if chars >= SLICE_CHARS:
            flush()
    if done or not slices:
        flush()
    return pa.concat_arrays(slices)


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches are small: all matches of a batch's texts come back at once."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < size(spark.conf.get(key)) <= most:
            spark.conf.set(key, most)


def rewrite(df: DataFrame, runtime: Runtime, *, text_col: str = "text", result_col: str = "result", trace: bool = True) -> DataFrame:
    """df with a struct of RESULT; null texts give a null struct's fields. Without trace the matches are counted, not listed."""
    small_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(source_of(runtime))

    def run(texts: pa.Array) -> pa.Array:
        own = held.value.runtime()
        return in_slices(texts, lambda text: own.convert(text, trace))

    spaced = runtime.options.preserve_spacing
    # were it deterministic, Spark would evaluate it once more for each filter on the result
    converted = F.arrow_udf(run, RESULT).asNondeterministic()
    return df.withColumn(result_col, converted(normalize_text(F.col(text_col), compress_spaces=not spaced, trim=not spaced)))


def low_confidence(df: DataFrame, *, text_col: str = "text", result_col: str = "result", owner: str = "runtime") -> DataFrame:
    """Review items for rows without a match or with residual terms."""
    result = F.col(result_col)
    residual = F.exists(result["warnings"], lambda w: w.startswith("華語殘留") | w.startswith("核心漏轉"))
    evidence = F.struct(F.col(text_col).alias("input"), result["output"].alias("output"), result["warnings"].alias("warnings"), F.size(result["matches"]).alias("match_count"), F.transform(result["matches"], lambda m: m["entry_id"]).alias("match_entry_ids"))
    kept = df.where((F.size(result["matches"]) == 0) | residual)
    return kept.select(F.lit("online_low_confidence").alias("kind"), F.lit("add_override").alias("action"), F.lit(owner).alias("owner"), F.lit("auto_enqueued_by_runtime").alias("reason"), evidence.alias("evidence"))
