"""Rewriting the text of HTML in place.

Text nodes that only inline markup separates are one block: their texts are joined, converted together (so a
phrase may go across markup) and written into the first node, the others become empty. Blocks that the converter leaves as they are
stay as they are, and in others the character references that it leaves keep their spelling. Text in scripts, styles, comments, text areas and editable elements isn't touched."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.plans.rewrite import Runtime, source_of

# HTML's elements that don't end a run of text.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PIECE = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?/]?[A-Za-z][^>]*>", re.S | re.I)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
EDITABLE = re.compile(r"""\scontenteditable(?:\s*=\s*["']?(?:true|["']?[\s>])|[\s>])""", re.I)

# also those names that HTML takes without a semicolon
REFERENCE = re.compile("&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|" + "|".join(map(re.escape, sorted(html5, key=len, reverse=True))) + ")")


def pieces(text: str) -> list[tuple[str, bool]]:
    """(markup or text, whether it is text)."""
    out, at = [], 0
    for m in PIECE.finditer(text):
        if m.start() > at:
            out.append((text[at : m.start()], True))
        out.append((m[0], False))
        at = m.end()
    return [*out, (text[at:], True)] if at < len(text) else out


def blocks(parts: list[tuple[str, bool]]) -> list[list[int]]:
    """Places of the text nodes of each block; nodes of white space alone are in none."""
    out: list[list[int]] = [[]]
    shut: list[str] = []  # open elements from an editable one on
    for k, (part, is_text) in enumerate(parts):
        if is_text:
            if not shut and part.strip():
                out[-1].append(k)
            continue
        tag = TAG.match(part)
        name = tag[2].lower() if tag else ""
        if shut and tag:
            if tag[1] and name in shut:
                del shut[len(shut) - 1 - shut[::-1].index(name) :]
            elif not tag[1] and name not in VOID and not part.endswith("/>"):
                shut.append(name)
        elif tag and not tag[1] and name not in VOID and EDITABLE.search(part):
            shut.append(name)
        if (name not in INLINE or shut) and not part.startswith("<!--") and out[-1]:
            out.append([])
    return [b for b in out if b]


def written(after: str, raw: str) -> str:
    """after as HTML. A character that it has as often as raw is spelled as there, reference by reference."""
    spelled, at = defaultdict(list), 0
    for m in REFERENCE.finditer(raw):
        for char in raw[at : m.start()]:
            spelled[char].append(html.escape(char, quote=False))
        spelled[html.unescape(m[0])].append(m[0])
        at = m.end()
    plain = html.escape(after, quote=False)
    if not at:
        return plain
    for char in raw[at:]:
        spelled[char].append(html.escape(char, quote=False))
    kept = {c: iter(refs) for c, refs in spelled.items() if len(c) == 1 and after.count(c) == len(refs) and any(REFERENCE.match(r) for r in refs)}
    out = "".join(next(kept[c]) if c in kept else html.escape(c, quote=False) for c in after)
    # without its semicolon a reference may have become part of a longer one
    return out if html.unescape(out) == after else plain


def rewrite_text(text: str, convert) -> str:
    parts = pieces(text)
    for block in blocks(parts):
        raw = [parts[k][0] for k in block]
        before = "".join(map(html.unescape, raw))
        after = convert(before)
        if after != before:
            for k in block:
                parts[k] = ("", True)
            parts[block[0]] = (written(after, "".join(raw)), True)
    return "".join(part for part, _ in parts)


def rewrite_html(df: DataFrame, runtime: Runtime, *, html_col: str = "html") -> DataFrame:
    """df with the texts within html_col converted; nulls stay null. Texts aren't normalised, so spacing stays."""
    held = df.sparkSession.sparkContext.broadcast(source_of(runtime))

    def run(pages: pa.Array) -> pa.Array:
        own = held.value.runtime()
        convert = lambda text: own.convert(text, trace=False)["output"]
        return pa.array([rewrite_text(p.as_py(), convert) if p.is_valid else None for p in pages], pa.string())

    return df.withColumn(html_col, F.arrow_udf(run, "string")(F.col(html_col).cast("string")))
