"""License scans: ordered signature rules over normalised words, gated by keywords, with containment suppression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, pick
from .license_rules import rules

#: Words are runs of characters outside these ASCII ranges, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: What a detection of each priority counts as evidence; a base phrase counts as the highest.
TRUST = (0.3, 0.5, 0.8, 0.95)


def roots() -> list[str]:
    """Strings of which each rule's keyword holds one (keywords that begin with cc have a test of their own): a part
    that many keywords share, or the keyword's longest word."""
    shared = ("licen", "copyright", "gpl", "domain", "creative", "reserved")
    return sorted({next((r for r in shared if r in key), max(key.split(" "), key=len)) for _, _, key, _ in rules() if not key.startswith("cc ")})


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" ")))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(norm: Column, regex: Column) -> Column:
    """(start, end) in words of all matches, which regex holds as its first group after a space. norm is ' w0 w1 ... ', so
    that the spaces before a place are the words before it: they are counted in what lies between the matches and in the
    matches, of which there are few, and no word is looked at by itself."""
    between = F.transform(F.split(norm, regex, -1), _spaces)
    within = F.transform(F.regexp_extract_all(norm, regex, F.lit(1)), lambda m: _spaces(m) + 1)
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.array_append(acc["all"], F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["n"]).alias("end"))).alias("all"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("all"))
    pairs = lambda n: F.zip_with(F.slice(between, F.lit(1), F.size(n)), n, lambda gap, m: F.struct(gap.alias("gap"), m.alias("n")))
    return _let(within, lambda n: F.aggregate(pairs(n), start, step, lambda acc: acc["all"]))


def _detections(norm: Column) -> Column:
    """All places of all rules, distinct, in order of start."""
    table = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(rank).alias("rank"), F.lit(key).alias("key"), F.lit(f" ((?:{regex}))(?= )").alias("regex")) for label, rank, key, regex in rules()])
    open_ = F.filter(table, lambda r: F.contains(norm, r["key"]))
    found = F.flatten(F.transform(open_, lambda r: F.transform(_places(norm, r["regex"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), r["rank"].alias("rank"), r["label"].alias("label")))))
    return _let(F.sort_array(found), lambda s: F.filter(s, lambda x, i: (i == 0) | (x != F.get(s, i - 1))))


def _reach(s: Column, most: Column) -> Column:
    """The smallest power of two k for which detections k places apart start more than `most` words apart."""

    def step(k: Column, j: Column) -> Column:
        near = lambda i: F.get(s, i)["start"] - F.get(s, i - j)["start"] <= most
        return F.when(k > 0, k).when((j >= F.size(s)) | ~F.exists(F.sequence(j, F.greatest(j, F.size(s) - 1)), near), j).otherwise(0)

    return F.aggregate(F.array(*[F.lit(1 << j) for j in range(31)]), F.lit(0), step)


def _surviving(found: Column) -> Column:
    """Without what lies within another detection of higher rank, or of the same rank and longer.

    found is in order of start. No detection is longer than the longest, so that what contains x starts at most that many
    words before x: each detection is compared with those within _reach, which depends on how densely rules match and
    not on the text's length."""
    covers = lambda y, x: (y["start"] <= x["start"]) & (y["end"] >= x["end"]) & ((y["rank"] > x["rank"]) | ((y["rank"] == x["rank"]) & (y["end"] - y["start"] > x["end"] - x["start"])))
    near = lambda s, k, i: F.slice(s, F.greatest(i + 1 - k, F.lit(1)), 2 * k + 1)
    within = lambda s, k: F.filter(s, lambda x, i: ~F.exists(near(s, k, i), lambda y: covers(y, x)))
    longest = lambda s: F.array_max(F.transform(s, lambda x: x["end"] - x["start"]))
    return _let(found, lambda s: _let(_let(longest(s), lambda most: _reach(s, most)), lambda k: within(s, k)))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and
    detections (start and end in words, rank, label; those that survive).

    Words are counted in the whole text; a null text is empty. Base: places where the words of a base phrase stand
    consecutively. The method's own labels come from some 200 signature rules (see license_rules): a cheap test for
    root strings opens a text, a keyword opens each rule, its regex gives places in words, and a place within one of
    higher priority, or of equal priority and longer, is suppressed. Base labels always stay. score is the trust in
    the best evidence, 0 without any.

    All of it is one projection: no shuffle, so neither hot sources nor copies matter, and null or repeated ids, ties
    and repeated rows are each judged by themselves. Work grows with a text's length, not with the square of its
    detections. Empty tables give empty results; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.btrim(F.regexp_replace(lower_ascii(text), GAP, " "))
    out = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.concat(F.lit(" "), words, F.lit(" ")).alias("every"))
    gate = reduce(Column.__or__, [F.contains("every", F.lit(r)) for r in (*roots(), " cc by ")])
    # Phrases and rules look at opened texts only; norm is null in the others.
    out = out.select("doc_id", F.when(F.length("every") > 2, _spaces(F.col("every")) - 1).otherwise(0).cast("long").alias("n_words"), F.when(gate, F.col("every")).alias("norm"))
    count, first, last = [], [], []
    for phrase, _ in BASE:
        hit = F.lit(f" {phrase} ")
        n = F.when(F.contains("norm", hit), F.regexp_count("norm", F.lit(f" {phrase}(?= )"))).otherwise(0)
        count.append(F.when(F.col("norm").isNull(), 0).otherwise(n))
        before = F.substring("norm", F.lit(1), F.instr("norm", hit) - 1)
        back = F.reverse("norm")
        after = F.substring(back, F.lit(1), F.instr(back, F.reverse(hit)) - 1)
        there = F.contains("norm", hit)
        first.append(F.when(there, _spaces(before)))
        last.append(F.when(there, F.col("n_words") - _spaces(after) - len(phrase.split())))
    out = out.withColumns({"counts": F.array(*count), "first_word": F.least(*first).cast("long"), "last_word": F.greatest(*last).cast("long"), "found": F.when(F.col("norm").isNotNull(), _detections(F.col("norm")))})
    out = out.withColumns({"n_base": F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), "base": F.filter(F.array(*[F.when(F.get("counts", F.lit(i)) > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)]), lambda x: x.isNotNull()), "detections": F.coalesce(_surviving(F.col("found")), F.array().cast("array<struct<start:int,end:int,rank:int,label:string>>"))})
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda x: x["label"]))))
    trust = F.array(*[F.lit(t) for t in TRUST])
    best = F.aggregate("detections", F.lit(0.0), lambda a, x: F.greatest(a, F.get(trust, x["rank"])))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.greatest(best, F.when(F.col("n_base") > 0, F.lit(TRUST[-1])).otherwise(0.0)).alias("score"), "detections")
