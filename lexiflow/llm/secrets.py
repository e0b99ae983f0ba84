"""Secret scans with character Markov models, with DataFrame functions only.

Base spans come from three patterns, leftmost and non-overlapping for each: assignments of a value of
12 or more characters to a key word, access keys of 18 or more, hex runs of 16 or more.

The method adds spans of kind ``markov``: of what the base spans leave, runs of 20 or more token
characters whose character transitions are likelier under a model of random strings than under one
of ordinary identifiers. Both are first-order Markov chains over single characters with add-one smoothing,
trained on labelled samples: :func:`labelled_samples` makes random strings and identifiers from a seed (bounded by a parameter), and
:func:`corpus_counts` adds what a bounded sample of ``SAMPLE_ROWS`` rows of a corpus holds: values of base spans
for the one class, other runs of ``MIN_WORD`` or more token characters for the other. A
token's score is the mean log-likelihood ratio of its transitions, and a span needs
``min_score`` or more. The table of log ratios is a literal of CLASSES x CLASSES numbers.

Positions are code points, the end exclusive. They come from what stands between the matches: a
text split at a pattern gives the gaps, and gaps and matches in turn add up to the starts. Running sums and maxima go
by stretches of the square root of their number, and parts of a text are cut from pieces of ``PIECE`` characters, so a text with very
many spans costs little more for each of them. Only texts that hold a candidate at all are split.

Null and empty texts have no spans. Rows are independent; repeated rows repeat. Very long texts are
scanned whole. Only the id and text columns are read; :func:`redact` keeps all columns.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import let

# The contract's patterns, as fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET)
MIN_SCORE = 0.8
MIN_WORD = 8
SAMPLES = 4000
SAMPLE_ROWS = 2000
PIECE = 4096
SYLLABLES = "re in de con pro com ex un dis pre per sub trans inter an er or at en on it is al el ar th st ed es ly ing tion ment ble ter ver der ge be sch ch ou le la que ción os as do co ra ta ma na po li lo se so si no mi".split()
PARTS = "get set is has to from new old max min num user item file path name type code list map key value index count size data time date page host line word text node edge tree table column row field json http url api sql db log err test main init load save read write open close start stop next prev".split()


def labelled_samples(seed: int = 7, n: int = SAMPLES) -> list[tuple[str, int]]:
    """(token, label): 1 for random strings in common alphabets, 0 for identifiers of words and parts."""
    rng, out = random.Random(seed), []
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]
    for k in range(n):
        out.append(("".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randint(20, 64))), 1))
        pieces = [rng.choice(PARTS) if rng.random() < 0.4 else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 7))]
        style = k % 6
        if style == 0:
            token = "_".join(pieces)
        elif style == 1:
            token = "-".join(pieces)
        elif style == 2:
            token = "".join(p.capitalize() for p in pieces)
        elif style == 3:
            token = "/".join(pieces)
        elif style == 4:
            token = "_".join(pieces).upper()
        else:
            token = "".join(pieces)
        if rng.random() < 0.4:  # identifiers end in numbers, or are dated
            token += rng.choice(["_", "-", ""]) + str(rng.randint(1, 20260101))
        if rng.random() < 0.1:
            token = str(rng.randint(10**9, 10**12)) * 2
        out.append(("".join(c for c in token if c in ALPHABET), 0))
    return out


def sample_counts(samples: list[tuple[str, int]]) -> dict[tuple[int, str], float]:
    """Number of each transition (two characters) by label."""
    counts: dict[tuple[int, str], float] = {}
    for token, label in samples:
        for a, b in zip(token, token[1:]):
            counts[label, a + b] = counts.get((label, a + b), 0) + 1
    return counts


def corpus_counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> dict[tuple[int, str], float]:
    """The same of a corpus: of the ``rows`` rows whose ids have the smallest hashes (rows without an id don't count)."""
    chosen = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_chosen")).orderBy(F.xxhash64(F.col(id_col).cast("string"))).limit(rows).distinct()
    sampled = df.join(F.broadcast(chosen), F.col(id_col) == F.col("_chosen"), "left_semi").select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    found = _with_covered(_with_spans(sampled, "__text", BASE, _valued, "__base"), "__text", "__base", None, "__rest")
    words = F.regexp_extract_all("__rest", F.lit(f"[A-Za-z0-9+/_=-]{{{MIN_WORD},}}"), F.lit(0))
    value = lambda s: F.when(s["kind"] == "assign", F.regexp_extract(s["found"], ASSIGN, 2)).otherwise(s["found"])
    labelled = F.concat(F.transform("__base", lambda s: F.struct(F.lit(1).alias("label"), value(s).alias("token"))), F.transform(words, lambda w: F.struct(F.lit(0).alias("label"), w.alias("token"))))
    tokens = found.select(F.explode(labelled).alias("_t")).select("_t.label", "_t.token").where(F.length("token") > 1)
    pairs = tokens.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, F.lit(2)))).alias("pair"))
    # at most 2 * CLASSES * CLASSES rows and some with other characters
    return {(r.label, r.pair): float(r["count"]) for r in pairs.groupBy("label", "pair").count().collect()}


def train(*counts: dict[tuple[int, str], float]) -> list[float]:
    """Log-likelihood ratio of each transition, row by row; characters beyond ALPHABET are skipped."""
    sums = [[1.0] * (CLASSES * CLASSES) for _ in range(2)]
    for found in counts:
        for (label, pair), n in found.items():
            a, b = ALPHABET.find(pair[0]), ALPHABET.find(pair[1])
            if a >= 0 and b >= 0:
                sums[label][a * CLASSES + b] += n
    ratio = []
    for a in range(0, CLASSES * CLASSES, CLASSES):
        ordinary, random_ = (x[a : a + CLASSES] for x in sums)
        ratio += [math.log(y / sum(random_)) - math.log(x / sum(ordinary)) for x, y in zip(ordinary, random_)]
    return [round(x, 6) for x in ratio]


def running(values: Column, merge, zero: Column) -> Column:
    """What ``merge`` makes of each element and all before it. A stretch is as long as the square root of the array."""

    def body(held: Column) -> Column:
        v, s = held["v"], held["s"]
        whole = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / s).cast("int")), lambda b: F.aggregate(F.slice(v, b * s + 1, s), zero, merge))
        step = lambda state, x: F.struct(merge(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        before = F.aggregate(whole, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), step, lambda state: state["out"])
        stretch = lambda i: F.floor(i / s).cast("int")
        each = lambda b: F.transform(v, lambda x, i: merge(F.get(b, stretch(i)), F.aggregate(F.slice(v, stretch(i) * s + 1, F.pmod(i, s) + 1), zero, merge)))
        return let(before, each)

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(F.struct(v.alias("v"), size_of(v).alias("s")), body)))


def size_of(array: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array))).cast("int"))


def _sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b, F.lit(0).cast("long"))


def _maxima(values: Column) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))


def _with(df: DataFrame, *columns: Column) -> DataFrame:
    """df with further columns. Each step has a projection of its own: nested in one expression
    they would be analysed again and again, and evaluated wherever they are named."""
    return df.select("*", *columns)


SPAN = "array<struct<at:bigint,stop:bigint,kind:string,found:string>>"


def _with_spans(df: DataFrame, text: str, kinds: dict[str, str], keep, out: str) -> DataFrame:
    """df with a column of the patterns' matches in the column text: (at, rank, stop, kind, found) in order, 0-based; keep: a predicate on the match."""
    for kind, pattern in kinds.items():
        m, w, e = (f"__{kind}_{x}" for x in "mwe")
        df = _with(df, F.when(F.col(text).rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(m))
        # a match ends after all gaps and matches up to it
        widths = let(F.split(text, pattern, -1), lambda g: F.transform(m, lambda x, i: (F.length(F.get(g, i)) + F.length(x)).cast("long")))  # noqa: B023
        df = _with(df, F.when(F.size(m) > 0, widths).otherwise(F.array().cast("array<bigint>")).alias(w))
        df = _with(df, _sums(F.col(w)).alias(e))

    def placed(kind: str) -> Column:
        ends = F.col(f"__{kind}_e")
        return F.transform(f"__{kind}_m", lambda x, i: F.struct((F.get(ends, i) - F.length(x)).alias("at"), F.get(ends, i).alias("stop"), F.lit(kind).alias("kind"), x.alias("found")))

    df = _with(df, F.filter(F.concat(*map(placed, kinds)), keep).alias("__found"))
    return _with(df, _in_order(F.col("__found")).alias(out)).drop("__found", *(f"__{kind}_{x}" for kind in kinds for x in "mwe"))


def _with_covered(df: DataFrame, text: str, spans: str, mask: str | None, out: str) -> DataFrame:
    """df with the text with the mask for every stretch that spans (in order) cover or touch; without a mask, as many spaces as characters."""
    n = F.size(spans)
    df = _with(df, _maxima(F.transform(spans, lambda x: x["stop"])).alias("__tops"))
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    begins = lambda i: (i == 0) | (F.get(F.col(spans), i)["at"] > F.get("__tops", i - 1))
    starts = F.transform(F.filter(places, begins), lambda i: F.get(F.col(spans), i)["at"])
    stops = F.transform(F.filter(places, lambda i: (i == n - 1) | begins(i + 1)), lambda i: F.get("__tops", i))
    pieces = F.when(n > 0, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = _with(df, starts.alias("__starts"), stops.alias("__stops"), pieces.alias("__pieces"))

    def part(at: Column, stop: Column) -> Column:
        first = F.floor(at / PIECE).cast("int")
        held = F.array_join(F.slice("__pieces", first + 1, F.floor((stop - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(stop > at, F.substring(held, (at - first.cast("long") * PIECE + 1).cast("int"), (stop - at).cast("int"))).otherwise(F.lit(""))

    fill = lambda at, i: F.lit(mask) if mask is not None else F.repeat(F.lit(" "), (F.get("__stops", i) - at).cast("int"))
    cut = F.transform("__starts", lambda at, i: F.concat(part(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("__stops", i - 1)), at), fill(at, i)))
    rest = part(F.element_at("__stops", -1), F.length(text).cast("long"))
    return _with(df, F.when(n > 0, F.concat(F.array_join(cut, ""), rest)).otherwise(F.col(text)).alias(out)).drop("__tops", "__starts", "__stops", "__pieces")


BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}


def _valued(span: Column) -> Column:
    return (span["kind"] != "assign") | (F.length(F.regexp_extract(span["found"], ASSIGN, 2)) >= MIN_VALUE)


def score(token: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the token's transitions."""
    table = F.lit(ratios)
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    codes = lambda t: F.transform(F.split(t, ""), place)

    def mean(c: Column) -> Column:
        pair = lambda i: F.get(table, (F.get(c, i - 1) - 1) * CLASSES + F.get(c, i) - 1)
        return F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + pair(i)) / (F.size(c) - 1)

    return let(codes(token), mean)


def find_spans(df: DataFrame, text_col: str, ratios: list[float], min_score: float = MIN_SCORE) -> DataFrame:
    """df with __text, __base and __added: the whole text, base and added spans."""
    df = _with(df, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    df = _with_spans(df, "__text", BASE, _valued, "__base")
    df = _with_covered(df, "__text", "__base", None, "__rest")
    return _with_spans(df, "__rest", {"markov": TOKEN}, lambda s: score(s["found"], ratios) >= min_score, "__added").drop("__rest")


def _in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["at"].alias("at"), rank(s).alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["found"].alias("found"))))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["stop"].cast("string"))), ",")


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row."""
    shown = df.select(F.col(id_col), F.col(text_col).alias("__given"))
    found = find_spans(shown, "__given", ratios or train(sample_counts(labelled_samples())), min_score)
    every = F.concat("__base", "__added")
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, KINDS), F.sha2(_written(F.col("__base")), 256).alias("base_sha256"), _written(every).alias("spans"))


def redact(df: DataFrame, *, text_col: str = "text", mask: str = "[secret]", ratios: list[float] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """df with the mask in place of every span; spans that overlap or touch become one mask. All
    other columns stay; a null text stays null."""
    # the row as a whole, so that none of its columns' names can clash
    packed = df.select(F.struct("*").alias("__row"), F.col(text_col).alias("__given"))
    found = find_spans(packed, "__given", ratios or train(sample_counts(labelled_samples())), min_score)
    found = _with(found, F.array_sort(F.concat("__base", "__added")).alias("__every"))
    masked = _with_covered(found, "__text", "__every", mask, "__masked")
    return masked.select(*(F.when(F.col("__given").isNotNull(), F.col("__masked")).alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in df.columns))
