"""Prices: numbers, currencies, formats, and extraction from page text. Amounts are whole Rials."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PERSIAN_DIGITS, norm_digits

#: Confidence of each way to find a price, and the least that is accepted (more than).
CONFIDENCE = {"jsonld": 0.95, "microdata": 0.92, "og": 0.9, "selector": 0.75, "regex_million": 0.65, "regex": 0.55}
LEAST = 0.6
REGEX = r"(?U)([\d,.]+)\s*(میلیون\s*)?(تومان|ریال)"
CANDIDATE = "struct<product_name:string,price:bigint,currency:string,availability:string,image_url:string,confidence:double>"


def parse_number(c: Column) -> Column:
    """The number that a text's digits and dots begin with; 0 if none."""
    digits = F.regexp_replace(norm_digits(c), r"[^0-9.]", "")
    return F.coalesce(F.regexp_extract(digits, r"^(\d*\.?\d*)", 1).try_cast("double"), F.lit(0.0))


def to_rials(amount: Column, currency: Column) -> Column:
    toman = F.upper(F.coalesce(currency, F.lit(""))).isin("IRT", "TOMAN")
    return F.round(F.when(toman, amount * 10).otherwise(amount)).cast("long")


def format_toman(toman: Column) -> Column:
    return F.concat(F.translate(F.format_number(toman, 0), "0123456789", PERSIAN_DIGITS), F.lit(" تومان"))


def from_text(text: Column) -> Column:
    """The first price in plain text as a candidate, null if none. Only amounts in millions are trusted enough later."""
    flat = norm_digits(text)
    number, million, unit = (F.regexp_extract(flat, REGEX, k) for k in (1, 2, 3))
    amount = parse_number(F.replace(number, F.lit(","))) * F.when(million != "", 1e6).otherwise(1.0) * F.when(unit == "تومان", 10.0).otherwise(1.0)
    sure = F.when(million != "", CONFIDENCE["regex_million"]).otherwise(CONFIDENCE["regex"])
    return F.when((number != "") & (amount > 0), F.struct(F.lit("Unknown Product").alias("product_name"), F.round(amount).cast("long").alias("price"), F.lit("toman").alias("currency"), F.lit("unknown").alias("availability"), F.lit(None).cast("string").alias("image_url"), sure.alias("confidence")))


def best(candidates: Column) -> Column:
    """The candidate with the highest confidence, the first among equals, if that is above 0.6."""
    top = F.aggregate(candidates, F.lit(None).cast(CANDIDATE), lambda a, x: F.when(x.isNotNull() & (a.isNull() | (x["confidence"] > a["confidence"])), x).otherwise(a))
    return F.when(top["confidence"] > LEAST, top)
