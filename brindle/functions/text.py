"""Text functions as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that Persian text writes in two ways, digits, and the zero-width non-joiner.
ARABIC_DIGITS, PERSIAN_DIGITS = "٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹"
ARABIC, PERSIAN = "يكةۀ", "یکهه"
ZWNJ = "‌"
#: Phrases of a soft 404.
SOFT_404 = ("صفحه مورد نظر یافت نشد", "صفحه یافت نشد", "یافت نشد", "page not found", "not found", "404 error", "page does not exist", "this page doesn't exist", "content not found")
#: What trim drops.
BLANK = " \t\n\r\0\x0b"
OPERATORS = r'[+\-<>()~*"@]+'
TOKEN = r"[\p{L}\p{N}]+"


class Query(NamedTuple):
    """A boolean query: every phrase (words) and every prefix must match."""

    phrases: tuple[tuple[str, ...], ...]
    prefixes: tuple[str, ...]

    @property
    def empty(self) -> bool:
        return not (self.phrases or self.prefixes)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def norm_digits(c: Column) -> Column:
    return F.translate(c, ARABIC_DIGITS + PERSIAN_DIGITS, "0123456789" * 2)


def norm_persian(c: Column) -> Column:
    """One form for letters that have two, ASCII digits, and a space for the zero-width non-joiner."""
    return F.translate(norm_digits(c), ARABIC + ZWNJ, PERSIAN + " ")


def norm_persian_text(s: str) -> str:
    return s.translate(str.maketrans(ARABIC + ZWNJ + ARABIC_DIGITS + PERSIAN_DIGITS, PERSIAN + " " + "0123456789" * 2))


def norm_product(c: Column) -> Column:
    """A product's name for matching: lower case, one form of letters (not of the ezafe he, not of digits), words only."""
    flat = F.translate(F.lower(trim(c)), "يكة" + ZWNJ, "یکه ")
    return F.btrim(F.regexp_replace(F.regexp_replace(flat, r"(?U)[^\p{L}\p{N}\s]+", " "), r"(?U)\s+", " "))


def prepare_query(q: str) -> str:
    """The boolean query of a user's text: phrases first, then words as prefixes, all required; '' if nothing is left."""
    parsed = parse_query(q)
    return " ".join([f'+"{" ".join(p)}"' for p in parsed.phrases] + [f"+{w}*" for w in parsed.prefixes])


def parse_query(q: str) -> Query:
    phrases = tuple(tuple(p.split()) for p in re.findall(r'"([^"]*)"', q) if p.strip())
    rest = re.sub(r'"[^"]*"', " ", q)
    words = tuple(w for w in (re.sub(OPERATORS, "", w) for w in rest.split()) if w)
    return Query(phrases, words)


def keywords(q: str) -> list[str]:
    """The query's words without quotes and operators, in order, once each."""
    return list(dict.fromkeys(w for w in (re.sub(OPERATORS, "", w) for w in q.replace('"', " ").split()) if w))


def _bare_words(c: Column) -> Column:
    """Words without operators, in order."""
    return F.filter(F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, OPERATORS, "")), lambda w: w != "")


def prepare_query_column(c: Column) -> Column:
    """prepare_query for a column of queries; null reads as empty."""
    q = F.coalesce(c, F.lit(""))
    phrases = F.filter(F.transform(F.regexp_extract_all(q, F.lit('"([^"]*)"'), F.lit(1)), lambda p: F.btrim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    words = _bare_words(F.regexp_replace(q, '"[^"]*"', " "))
    return F.array_join(F.concat(F.transform(phrases, lambda p: F.concat(F.lit('+"'), p, F.lit('"'))), F.transform(words, lambda w: F.concat(F.lit("+"), w, F.lit("*")))), " ")


def keywords_column(c: Column) -> Column:
    """keywords for a column of queries; null reads as empty."""
    return F.array_distinct(_bare_words(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit(" "))))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")).cast("long")


def filled(c: Column) -> Column:
    return trim(F.coalesce(c, F.lit(""))) != ""


def soft_404(title: Column, text: Column) -> Column:
    seen = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 500)))
    return F.exists(F.array(*[F.lit(p) for p in SOFT_404]), lambda p: F.contains(seen, p))


def html_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, c).otherwise(F.concat(trim(F.substring(c, 1, n)), F.lit("…")))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the words of the shorter; 0 if either has none. The word "0" doesn't count."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda x: (x != "") & (x != "0")))
    x, y = words(a), words(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))


def direction(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")).rlike("[֐-׿؀-ۿ܀-ݏݐ-ݿࢠ-ࣿיִ-﷿ﹰ-﻿]"), "rtl").otherwise("ltr")


def availability_label(c: Column) -> Column:
    return F.when(c == "in_stock", "موجود").when(c == "out_of_stock", "ناموجود").otherwise("نامشخص")


# ------------------------------------------------------------------ snippets

def snippet(content: Column, words: list[str], length: int = 200) -> Column:
    """A window around the earliest keyword, escaped, with the keywords marked; highlighting follows escaping."""
    clean = trim(F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)\s+", " "))
    if not words:
        return let(clean, lambda c: F.when(c == "", "").otherwise(html_escape(truncate(c, length))))
    pattern = "(?iu)(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", w) for w in words) + ")"

    def start(c: Column) -> Column:
        spots = let(F.lower(c), lambda low: F.array(*[F.nullif(F.locate(w.lower(), low), F.lit(0)) for w in words]))
        return F.greatest(F.lit(0), F.coalesce(F.array_min(spots), F.lit(1)) - 1 - length // 2)

    def cut(c: Column, at: Column) -> Column:
        part = F.concat(F.when(at > 0, "…").otherwise(""), trim(F.substring(c, at + 1, F.lit(length))), F.when(at + length < F.length(c), "…").otherwise(""))
        return F.when(c == "", "").otherwise(F.regexp_replace(html_escape(part), pattern, "<mark>$1</mark>"))

    return let(clean, lambda c: let(start(c), lambda at: cut(c, at)))
