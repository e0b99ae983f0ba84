"""Main text of web pages by equivalence-class template deduction.

Tokens are start tags, told apart by their path of tags and classes, and text blocks, told apart by
their path and text. A token's occurrence vector says how often it occurs in each page of its host;
tokens with equal vectors form an equivalence class. A class is taken if it is large (``MIN_CLASS`` tokens)
and frequent (at least ``MIN_PAGES`` different pages and half of the host's), and valid as far as it nests: each
of its tokens lies directly below another one of it or one of a valid class, the page itself being the first.
Text in elements that pages have in differing numbers (an article's paragraphs) is in a slot, even if it is the same.
The valid classes, nested, are the host's template. Blocks that belong to it (menus, notices, mastheads that
read the same on the pages) are no content, wherever they stand. What remains are the slots: other text
below template tags. The main slot is the template container that holds most of what remains
over the host: the outermost article or main element with half of it, else the deepest container with
nine tenths (h1 headlines weigh ``HEADLINE`` times, so that an article's headline isn't left outside). A page's
text is what remains in the main slot. A page without the host's main slot, or of a host
without a template, uses the same choice over its own tokens.

A slot's text differs from page to page in adverts and comments, too, so that the template can't tell
these from the article. They, and pages without a template, go by what HTML says (elements like
nav, aside, script; roles; hidden) and by names: a class or id all of whose words are known for boilerplate, such
as ``cookie-notice``, not ``with-sidebar`` or ``share-price``. An element that holds a main element, a first headline
or all of the page's text is never taken for boilerplate by its name.

Vectors aren't collected: a token's is folded into two sums of 31-bit hashes of page content and
count, so a host with a third of all pages adds up per batch before anything is shuffled. Pages with equal
html count as one. Only hosts with enough pages are tokenised. A template has no more tokens than the host's
pages have on average twice over, so one task nests a host's. Templates are broadcast only up to ``MAX_HOSTS`` rows and ``MAX_BYTES``.

Null or empty html gives an empty text; a null url or one without a host has no template. Character
references are decoded, white space inside a block becomes one space, blocks are joined
by one newline. Broken and unclosed markup is read as browsers do: closing an element closes
what is open inside it. Pages are parsed whole. Repeated rows repeat; an empty table gives an empty
result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import cut, few_at_a_time
from lexiflow.llm.urlfilter import host_of

MIN_PAGES, MIN_CLASS = 3, 3
MAX_HOSTS, MAX_BYTES = 200_000, 64 << 20
HEADLINE = 20

# HTML's element kinds, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINER = frozenset("body div section td main article".split())
CLOSES_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section div body".split())
DROPPED_TAGS = frozenset("nav footer aside script style noscript template head iframe object svg canvas button select textarea label menu dialog search title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar widget widgets related share sharing social footer comment comments commentlist disqus respond replies login signup search".split()
)
# Words that say nothing about what an element is for.
PLAIN_WORDS = frozenset("site page top bottom left right bar box block wrapper container inner outer content list item items links area section panel global primary secondary".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")
TAG, CONTAINER_TAG, MAIN_TAG, TEXT = range(4)


def _dropped(tag: str, attrs: dict[str, str | None], in_main: bool) -> bool:
    if tag in DROPPED_TAGS or (tag == "header" and not in_main):
        return True
    return (attrs.get("role") or "").lower() in DROPPED_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true"


def _named(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element's name says that it is boilerplate."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag == "form":
        return True
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        words = {w for w in WORDS.findall(name) if not w.isdigit()} - PLAIN_WORDS
        if words and words <= DROPPED_WORDS:
            return True
    return False


class Page(HTMLParser):
    """Nodes in page order (parent, path, depth, kind, dropped, weighted characters), and blocks (node, text).

    Node 0 is the page."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.parent, self.path, self.depth, self.kind, self.dropped, self.main, self.weight = [0], [1], [0], [CONTAINER_TAG], [False], [False], [1]
        self.named, self.mark, self.head = [False], [0], [False]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: dict[str, int] = {}
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        self.feed(html or "")
        self.close()
        self.flush()
        self.drop_named()
        self.chars = self.sums(lambda node, text: len(text) * self.weight[node])

    def sums(self, of) -> list[int]:
        """For each node what its blocks and those below it add up to."""
        out = [0] * len(self.parent)
        for node, text in self.blocks:
            out[node] += of(node, text)
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def drop_named(self) -> None:
        if not any(self.named):
            return
        heads = self.head[:]
        for k in range(len(heads) - 1, 0, -1):
            heads[self.parent[k]] |= heads[k]
        size = self.sums(lambda node, text: len(text))
        for k in range(1, len(self.parent)):
            if self.dropped[self.parent[k]] or (self.named[k] and not heads[k] and size[k] < size[0]):
                self.dropped[k] = True
        self.blocks = [(node, text) for node, text in self.blocks if not self.dropped[node]]

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text and not self.dropped[self.block_node]:
                self.blocks.append((self.block_node, text))

    def handle_data(self, data: str) -> None:
        if not self.text:
            self.block_node = self.stack[-1][1]
        elif self.mark[self.stack[-1][1]] != self.mark[self.block_node]:
            self.flush()
            self.block_node = self.stack[-1][1]
        self.text.append(data)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            if tag in ("br", "wbr") and self.text:
                self.text.append(" " if tag == "br" else "")
            return
        if tag in BLOCK:
            for other in CLOSES_ITSELF.get(tag, ("p",)):
                self.close_open(other, SCOPE)
        given = dict(attrs)
        up = self.stack[-1][1]
        label = f"{tag}.{'.'.join(sorted((given.get('class') or '').split()))}"
        out, named = _dropped(tag, given, self.main[up]), _named(tag, given)
        self.parent.append(up)
        self.path.append(xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), self.path[up] & 0xFFFFFFFF) ^ self.path[up] >> 32)
        self.depth.append(self.depth[up] + 1)
        self.kind.append(MAIN_TAG if tag in ("article", "main") else CONTAINER_TAG if tag in CONTAINER else TAG)
        self.dropped.append(self.dropped[up] or out)
        self.named.append(named)
        # text of one block doesn't run across the edge of what may be dropped
        self.mark.append(len(self.parent) - 1 if out or named else self.mark[up])
        self.head.append(tag in ("h1", "main") and not self.dropped[-1])
        self.main.append(self.main[up] or tag in ("article", "main"))
        self.weight.append(HEADLINE if tag == "h1" else self.weight[up])
        self.stack.append((tag, len(self.parent) - 1))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.handle_starttag("br", [])
        self.close_open(tag)

    def close_open(self, tag: str, scope: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of that tag, if any, unless one of scope is in between."""
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                for name, _ in self.stack[k:]:
                    self.open[name] -= 1
                del self.stack[k:]
                return
            if self.stack[k][0] in scope:
                return

    def tags(self) -> dict[int, list[int]]:
        """path -> [count, characters, depth, kind, parent's path] of all nodes outside boilerplate."""
        out: dict[int, list[int]] = {}
        for path, chars, depth, kind, dropped, up in zip(self.path, self.chars, self.depth, self.kind, self.dropped, self.parent):
            if not dropped:
                got = out.setdefault(path, [0, 0, depth, kind, self.path[up]])
                got[0] += 1
                got[1] += chars
        return out

    def token(self, node: int, text: str) -> int:
        return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), self.path[node])

    def tokens(self) -> dict[int, list[int]]:
        """Those of tags and of text blocks."""
        out = self.tags()
        for node, text in self.blocks:
            got = out.setdefault(self.token(node, text), [0, 0, self.depth[node] + 1, TEXT, self.path[node]])
            got[0] += 1
            got[1] += len(text) * self.weight[node]
        return out

    def own_main(self) -> int:
        """The main slot's path, chosen over this page alone."""
        return main_of([(path, kind, chars, depth) for path, (_, chars, depth, kind, _) in self.tags().items()], self.chars[0])

    def text_in(self, main: int | None = None, template: frozenset[int] = frozenset()) -> str:
        """The text in the main slot but for the template's; in the page's own if main is None or isn't in the page."""
        if main is None or main not in self.path:
            main = self.own_main()
        inside = [self.path[0] == main]
        for k in range(1, len(self.parent)):
            inside.append(inside[self.parent[k]] or self.path[k] == main)
        return "\n".join(text for node, text in self.blocks if inside[node] and (not template or self.token(node, text) not in template))


def main_of(containers: list[tuple[int, int, int, int]], total: int) -> int:
    """The path that suits best as main slot, of (path, kind, characters, depth)."""
    best, at = (-1, 0), 1
    for path, kind, chars, depth in containers:
        if kind == MAIN_TAG and 2 * chars >= total and chars > 0:
            rank = (1, -depth)
        elif kind == CONTAINER_TAG and 10 * chars >= 9 * total:
            rank = (0, depth)
        else:
            continue
        if rank > best:
            best, at = rank, path
    return at


def _signed(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x


TOKEN = "host string, path long, pages double, low long, high long, chars long, depth int, kind int, up long"


def token_counts(pages: DataFrame) -> DataFrame:
    """pages (_host, _key, _share, _html) -> TOKEN rows, added up within each batch; _share is a page's part in its copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in TOKEN.split(", "))])
        for batch in batches:
            sums: dict[tuple[str, int], list] = {}
            for host, key, share, html in zip(*(c.to_pylist() for c in batch.columns)):
                for path, (count, chars, depth, kind, up) in Page(html).tokens().items():
                    got = sums.setdefault((host, path), [0.0, 0, 0, 0, depth, kind, up])
                    hashed = xxhash.xxh64_intdigest(b"%d:%d" % (key, count))
                    got[0] += share
                    got[1] += hashed & 0x7FFFFFFF
                    got[2] += hashed >> 33
                    got[3] += chars
            if sums:
                rows = [(host, _signed(path), *got[:-1], _signed(got[-1])) for (host, path), got in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return few_at_a_time(pages).mapInArrow(run, TOKEN)


def nested(tokens: pd.DataFrame) -> tuple[int, list[int]] | None:
    """A host's frequent tokens -> (path of its main slot, its template's text tokens); None if all text is template."""
    rows = {r.path: r for r in tokens.itertuples()}
    classes: dict[tuple[int, int], list] = {}
    for r in rows.values():
        classes.setdefault((r.low, r.high), []).append(r)
    waiting = [c for c in classes.values() if len(c) >= MIN_CLASS]
    valid, grown = {1}, True
    while grown:
        grown = False
        for c in waiting[:]:
            own, size = {r.path for r in c}, 0
            while size != len(own):
                size = len(own)
                own = {r.path for r in c if r.path in own and (r.path == 1 or r.up in valid or r.up in own)}
            if size >= MIN_CLASS:
                valid |= own
                waiting.remove(c)
                grown = True
    texts = [rows[p] for p in valid if p in rows and rows[p].kind == TEXT]
    left = {r.path: r.chars for r in rows.values() if r.kind != TEXT}
    for t in texts:
        at = t.up
        while at in left:
            left[at] -= t.chars
            if at == 1:
                break
            at = rows[at].up
    if left.get(1, 0) <= 0:
        return None
    containers = [(r.path, r.kind, left[r.path], r.depth) for r in rows.values() if r.path in valid and r.kind in (CONTAINER_TAG, MAIN_TAG)]
    return main_of(sorted(containers), left[1]), sorted(t.path for t in texts)


def templates(counts: DataFrame, hosts: DataFrame) -> DataFrame:
    """TOKEN rows and (host, of), the number of a host's pages -> (host, main, texts): the path of the main slot, and the packed text tokens of the template."""
    summed = counts.groupBy("host", "path").agg(
        F.sum("pages").alias("pages"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("chars").alias("chars"), F.max("depth").alias("depth"), F.max("kind").alias("kind"), F.max("up").alias("up")
    )
    # sums of shares are whole but for rounding
    frequent = summed.where(F.col("pages") >= MIN_PAGES - 0.001).join(hosts, "host").where(2 * F.col("pages") >= F.col("of") - 0.001)

    def nest(tokens: pd.DataFrame) -> pd.DataFrame:
        found = nested(tokens)
        return pd.DataFrame([(tokens["host"].iloc[0], found[0], np.array(found[1], np.int64).tobytes())] if found else [], columns=["host", "main", "texts"])

    return frequent.groupBy("host").applyInPandas(nest, "host string, main long, texts binary")


def extract(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    pages = df.select(F.col(id_col), F.col(url_col), host_of(F.col(url_col)).alias("_host"), html.alias("_html"))
    hashed = pages.where("_host <> ''").withColumn("_key", F.xxhash64("_html"))
    copies = cut(hashed.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("n")))
    hosts = cut(copies.groupBy(F.col("_host").alias("host")).agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= MIN_PAGES))
    again = cut(copies.where("n > 1").join(hosts, F.col("_host") == F.col("host"), "left_semi").select(F.col("_host").alias("_h"), F.col("_key").alias("_k"), "n"))
    few = lambda t: F.broadcast(t) if t.count() <= MAX_HOSTS else t
    wanted = hashed.join(few(hosts), F.col("_host") == F.col("host"), "left_semi").join(few(again), (F.col("_host") == F.col("_h")) & (F.col("_key") == F.col("_k")), "left")
    counts = token_counts(wanted.select("_host", "_key", (1 / F.coalesce("n", F.lit(1))).alias("_share"), "_html"))
    found = cut(templates(counts, hosts))
    size = found.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("texts") + F.length("host") + 16), F.lit(0)).alias("bytes")).first()
    known = F.broadcast(found) if size.rows <= MAX_HOSTS and size.bytes <= MAX_BYTES else found
    placed = pages.join(known, F.col("_host") == F.col("host"), "left").select(id_col, url_col, "_html", "main", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, main, packed in zip(*batch.columns[2:5]):
                template = frozenset(np.frombuffer(packed.as_py(), np.uint64).tolist()) if main.is_valid else frozenset()
                texts.append(Page(html.as_py()).text_in(main.as_py() & 0xFFFFFFFFFFFFFFFF if main.is_valid else None, template))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kinds = [placed.schema[k].dataType.simpleString() for k in (0, 1)]
    return few_at_a_time(placed).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
