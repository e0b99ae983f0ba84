"""URL filter: allow and block entries in a trie over reversed host labels and path segments.

An entry is written ``host/path``; it fits its host and all subdomains of it, for every URL
whose path starts with the entry's path. Of several fitting entries the longest as written wins; of equally
long ones that with the longer host; if an allow and a block entry are written alike, the block entry counts.

Two ways give the same result. Up to ``max_trie_rules`` entries (the proven bound of what is
shipped to executors) the trie is broadcast, so a worker unpacks it once, and probed in Arrow batches.
Beyond it, :func:`judge_by_join` explodes every URL into its (host suffix, path folder) keys,
whose number depends only on the URL, and joins them to the rules by equality.

Null or empty URLs, and URLs without ``://``, have an empty host and path; an entry with an
empty host fits every URL. Repeated rows are judged one by one; an empty table gives an
empty result. Only the id and url columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import lower_ascii

MAX_TRIE_RULES = 200_000


def parse_rule(text: str) -> tuple[str, str]:
    """``host/path`` as (lower-case host, path with its leading slash; may be empty)."""
    at = text.find("/")
    host, path = (text, "") if at < 0 else (text[:at], text[at:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


class UrlTrie:
    """Host nodes lead by label, from the last to the first; each host node that carries entries
    has a root of path nodes. A path's full segments are edges; what follows its last slash
    is a prefix of the URL's next segment and is kept in the node, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, rule in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict must be allow or block: {verdict!r}")
            host, path = parse_rule(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}}
            place = node["paths"]
            *folders, last = path.split("/") if path else [None]
            for segment in folders:
                place = place["next"].setdefault(segment, {"next": {}, "ends": {}})
            if last not in place["ends"] or verdict == "block":
                place["ends"][last] = (rule, verdict)

    @staticmethod
    def _deepest(place: dict, path: str) -> tuple[str, str] | None:
        best = place["ends"].get(None)
        segments = path.split("/")
        for k, segment in enumerate(segments):
            fits = [end for end in place["ends"] if end is not None and segment.startswith(end) and (path or end)]
            if fits:
                best = place["ends"][max(fits, key=len)]
            if k + 1 == len(segments) or (place := place["next"].get(segment)) is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The winning entry as (rule, verdict)."""
        node, best = self.root, None
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            # host nodes come with growing hosts, so of equally long entries the later has the longer host
            if node["paths"] is not None and (found := self._deepest(node["paths"], path)) and (best is None or len(found[0]) >= len(best[0])):
                best = found
            label = next(labels, None)
            node = None if label is None else node["next"].get(label)
        return best


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(_after_scheme(url), r"^[^/?#]*", "")
    return F.regexp_extract(rest, r"^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def judge_by_trie(urls: DataFrame, rules: list[tuple[str, str]], otherwise: str) -> DataFrame:
    held = urls.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        trie = held.value
        for host, path in batches:
            found = [trie.find(h, p) or (None, otherwise) for h, p in zip(host, path)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    return urls.withColumn("_judged", judge("host", "path")).select("*", "_judged.rule", "_judged.verdict").drop("_judged")


def judge_by_join(urls: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """rules: (verdict, rule). Each URL is exploded into its host suffixes and path folders."""
    cut_at = F.instr("rule", "/")
    rule_host = lower_ascii(F.when(cut_at > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")))
    rule_path = F.when(cut_at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    entries = rules.select("rule", "verdict", rule_host.alias("_rule_host"), rule_path.alias("_rule_path")).withColumn(
        "_folder", F.regexp_extract("_rule_path", r"^(.*)/[^/]*$", 1)
    )
    labels = F.split("host", r"\.", -1)
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    parts = F.split("path", "/", -1)
    folders = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i))))
    keyed = urls.withColumn("_row", F.monotonically_increasing_id())
    hits = (
        keyed.withColumn("_suffix", F.explode(F.array_distinct(suffixes)))
        .withColumn("_prefix", F.explode(F.array_distinct(folders)))
        .join(entries, (F.col("_suffix") == F.col("_rule_host")) & (F.col("_prefix") == F.col("_folder")) & F.expr("startswith(path, _rule_path)"))
        .groupBy("_row", *urls.columns)
        .agg(
            F.max_by(
                F.struct("rule", "verdict"),
                F.struct(F.length("rule"), F.length("_rule_host"), F.col("verdict"), F.col("rule")),
            ).alias("_best")
        )
    )
    none = keyed.join(hits.select("_row"), "_row", "left_anti").withColumn("_best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    both = hits.unionByName(none.select(hits.columns))
    return both.select(*urls.columns, "_best.rule", F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))


def filter_urls(df: DataFrame, rules: list[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; rule is null where none fits.

    rules: (allow or block, ``host/path``); otherwise: the verdict where none fits."""
    urls = df.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if len(rules) <= max_trie_rules:
        return judge_by_trie(urls, rules, otherwise)
    entries = df.sparkSession.createDataFrame(pd.DataFrame(rules, columns=["verdict", "rule"]))
    return judge_by_join(urls, entries.dropDuplicates(), otherwise)
