"""Text normalisation as column expressions: one projection, no shuffle, no Python.

Nulls stay null; empty texts stay empty."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PUNCTUATION = "，。！？；：、"
BLANK = r"[ \t\x{3000}\x{A0}]"
HAN = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2FA1F}"
DIGITS = "零一二三四五六七八九"
GROUP_UNITS = ("", "萬", "億", "兆", "京")
NUMBER = r"(?<![A-Za-z0-9_.])[+-]?\p{Nd}+(?:\.\p{Nd}+)?(?![A-Za-z0-9_.])"
REPEATED = "[,，。！？!?]"

_DECIMALS = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]


def trim_outer(text: Column) -> Column:
    """Strip what Python calls white space, which includes U+001C to U+001F."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def fold_forms(text: Column) -> Column:
    return F.translate(F.replace(text, F.lit("臺"), F.lit("台")), "０１２３４５６７８９", "0123456789")


def compress_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}+", " ")


def close_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}*([{PUNCTUATION}]){BLANK}*", "$1")


def close_han(text: Column) -> Column:
    """A lookbehind would miss characters beyond the basic plane, so the left one is captured."""
    return F.regexp_replace(text, f"([{HAN}]){BLANK}+(?=[{HAN}])", "$1")


def spelled(digits: Column) -> Column:
    return F.translate(digits, "0123456789", DIGITS)


def _group(digits: Column) -> Column:
    """Four digits, as 三百零五: write every place, then drop the units of zeros and spare zeros."""
    places = [F.concat(spelled(F.substring(digits, k + 1, F.lit(1))), F.lit(unit)) for k, unit in enumerate("千百十")]
    text = F.regexp_replace(F.concat(*places, spelled(F.substring(digits, F.lit(4), F.lit(1)))), "零[千百十]", "零")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "零+", "零"), "^零|零$", ""), "^一十", "十")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once, which also keeps the generated code small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def int_to_han(digits: Column) -> Column:
    """A string of decimal digits as a Han numeral; digit by digit from 10^20 on."""
    return let(F.regexp_replace(digits, "^0+", ""), lambda value: F.when(value == "", F.lit("零")).when(F.length(value) > 20, spelled(value)).otherwise(let(F.lpad(value, 20, "0"), _grouped)))


def _grouped(padded: Column) -> Column:
    """Twenty digits, not all zero."""
    group = [F.substring(padded, F.lit(4 * k + 1), F.lit(4)) for k in range(5)]
    parts = []
    for k in range(5):
        before = F.substring(padded, F.lit(1), F.lit(4 * k)) if k else F.lit("")
        bridge = before.rlike("[1-9]") & (group[k].startswith("0") | before.endswith("0000")) if k else F.lit(False)
        parts.append(F.when(group[k] == "0000", F.lit("")).otherwise(F.concat(F.when(bridge, F.lit("零")).otherwise(F.lit("")), _group(group[k]), F.lit(GROUP_UNITS[4 - k]))))
    return F.concat(*parts)


def number_to_han(token: Column) -> Column:
    plain = F.translate(token, "".join(_DECIMALS), "".join(str(unicodedata.decimal(c)) for c in _DECIMALS))
    return let(plain, _number)


def _number(plain: Column) -> Column:
    whole, part = F.regexp_extract(plain, r"^[+-]?(\d+)", 1), F.regexp_extract(plain, r"\.(\d+)$", 1)
    literal = (part == "") & (F.length(whole) > 1) & whole.startswith("0")
    tail = F.when(part != "", F.concat(F.lit("點"), spelled(part))).otherwise(F.lit(""))
    said = F.when(literal, spelled(whole)).otherwise(int_to_han(whole))
    return F.concat(F.when(plain.startswith("-"), F.lit("負")).otherwise(F.lit("")), said, tail)


def replace_matches(text: Column, pattern: str, replacement, needs: str | None = None) -> Column:
    """Every match replaced by ``replacement(match)``: gaps and matches, zipped. needs: a cheaper pattern that a text with a match also has."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(gaps, F.transform(found, replacement), lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
    return F.when(text.rlike(needs or pattern), F.array_join(zipped, "")).otherwise(text)


def numbers_to_han(text: Column) -> Column:
    return replace_matches(text, NUMBER, number_to_han, r"\p{Nd}")


def normalize_text(text: Column, *, compress_spaces: bool = True, trim: bool = True) -> Column:
    """Each step is bound once; those for Han texts look first whether there is something to do."""
    if trim:
        text = trim_outer(text)
    text = fold_forms(text)
    if not compress_spaces:
        return let(text, numbers_to_han)
    closed = lambda t: F.when(t.rlike(f"[{PUNCTUATION}]"), close_punctuation(t)).otherwise(t)
    joined = lambda t: F.when(t.rlike(f"[{HAN}]{BLANK}"), close_han(t)).otherwise(t)
    return let(let(let(compress_blanks(text), closed), joined), numbers_to_han)


def tidy(text: Column) -> Column:
    """Clean-up after all rewriting: doubled particles, and runs of one punctuation mark."""
    text = F.replace(F.replace(text, F.lit("這馬咧咧"), F.lit("這馬咧")), F.lit("真正真"), F.lit("真"))
    return F.regexp_replace(text, rf"({REPEATED})\1+", "$1")
