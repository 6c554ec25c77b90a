"""URL filters, line dedup, mixing, license scans and chat formatting against SQL or brute force, and odd inputs."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import chat, entry, license_rules, licenses, line_dedup, mixing, url_filter

DOCS = "doc_id long, text string, source string, key string, rank int, DROPS int, drops int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql(name, spark, sf, same):
    assert same(entry.queries()[name](spark, sf), entry.oracle_sql()[name])


def docs(spark, rows):
    """Rows of (doc_id, text, source) with further columns whose names clash."""
    return spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], DOCS) if rows else spark.createDataFrame([], DOCS)


def test_urls_odd(spark):
    rows = [(1, None), (1, None), (None, "x"), (2, "http://EXAMPLE.com/en/a"), (3, "http://www.example.com/en/"), (4, "https://a.net/es/"), (5, "http://notcom/"), (6, "http://com"), (7, "a://" + "x." * 3000 + "com/" + "p" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("mine")).withColumn("HOST", F.lit(1))
    rules = url_filter.rules_table(spark)
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()]
    want = [(1, None, "allow"), (1, None, "allow"), (None, None, "allow"), (2, "example.com/en/", "block"), (3, "www.example.com/en/", "allow"), (4, "net/es/", "block"), (5, None, "allow"), (6, None, "allow"), (7, "com/", "allow")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    shuffled = url_filter.judge_urls(pages, rules, broadcast_mb=-1)
    assert sorted(((r["page_id"], r["rule"], r["verdict"]) for r in shuffled.collect()), key=repr) == sorted(want, key=repr)


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOW)
    held = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                held[key(x)].add(i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines(spark):
    a, b, short = "A common line that is well over forty characters long", "ß another line of more than forty code points é", "short line"
    rows = [(i, f"{i}\n {a.upper()}\t\n{short}\n{b}\n", "s") for i in range(6)] + [(3, f"{a}\nrest", "s"), (3, f"{a}\nrest", "s"), (None, f"{a}\nx", "s"), (10, None, "s"), (11, "", "s"), (12, f"{a}\n" * 3000 + b, "s"), (13, f"\x85{a}", None)]
    got = sorted((tuple(r) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()), key=repr)
    assert got == brute_lines(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    full = line_dedup.dedup_lines_keep_columns(docs(spark, rows))
    assert full.columns == docs(spark, rows).columns and full.count() == len(rows)


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in order}
        full |= over


def test_mixing(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix_sizes(table).collect()
    texts = {r["doc_id"]: r for r in table.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        source = texts[r["doc_id"]]["source"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]["text"])) and r["taken"] in {k * r["size"] for k in range(4)}
        sizes[source] += r["size"]
        taken[source] += r["taken"]
    want, largest = brute_targets(sizes), max(r["size"] for r in rows)
    for r in rows:
        assert r["target"] == pytest.approx(want[texts[r["doc_id"]]["source"]], rel=1e-9)
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sizes(table.repartition(3)).collect()))
    mixed = mixing.mix_documents(table)
    assert mixed.columns == table.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r["doc_id"]] += 1
    assert all(got[r["doc_id"]] * r["size"] == r["taken"] for r in rows)


def test_mixing_odd(spark):
    rows = [(1, "a b c", None), (None, "x", "s"), (2, None, "s"), (2, "", "z"), (3, "w " * 50_000, "t"), (3, "w " * 50_000, "t"), (4, "\x0b \t", "s")]
    got = mixing.mix_sizes(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sizes(docs(spark, [])).count() == 0 and mixing.mix_documents(docs(spark, [])).count() == 0
    assert {r["target"] for r in mixing.mix_sizes(docs(spark, [(1, "", "a"), (2, None, "b")])).collect()} == {0.0}


def brute_licenses(text):
    words = re.findall(licenses.GAP.replace("[", "[^", 1), (text or "").translate(LOW))
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    norm = " " + " ".join(words) + " "
    found = {(norm[: m.start()].count(" "), norm[: m.end()].count(" "), rank, label) for label, rank, key, regex in license_rules.rules() if key in norm for m in re.finditer(f" (?:{regex})(?= )", norm)}
    left = {x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and (y[2] > x[2] or y[2] == x[2] and y[1] - y[0] > x[1] - x[0]) for y in found)}
    at = [i for i, _ in base]
    return len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted({x for _, x in base} | {x[3] for x in left}))


def test_licenses(spark, sf):
    odd = [None, "", "...", "MIT License mit license", "é CC-BY\n4.0", "GNU General Public License, version 3 or (at your option) any later version", "ccby cc bye", "Licensed under the Apache License, Version 2.0 " * 50, "x " * 100_000 + "mit license", "gnu general public licenses", "Alle Rechte vorbehalten. All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "CC BY-NC-SA 4.0 International"]
    rows = [(i, t, "s") for i, t in enumerate(odd)] + [(0, None, "s")]
    rng = random.Random(8)
    parts = ["under the Apache License, Version 2.0", "GNU General Public License version 3 or later", "MIT License", "CC BY 4.0", "cc by sa", "some other words", "GPL", "all rights reserved", "copyright 2020"]
    rows += [(500, " ".join(rng.choice(parts) for _ in range(700)), "s"), (501, "MIT License " * 400, "s")]
    rows += [(1000 + r["doc_id"], r["text"], "s") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = licenses.scan_licenses(docs(spark, rows))
    text = defaultdict(list)
    for i, t, _ in rows:
        text[i].append(t)
    for r in got.collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == brute_licenses(text[r["doc_id"]][0]) and 0 <= r["score"] <= 1
    assert got.count() == len(rows) and licenses.scan_licenses(docs(spark, [])).count() == 0


def test_rules():
    rules = license_rules.rules()
    assert len(rules) >= 200 and all(0 <= rank <= 3 and re.compile(regex) for _, rank, _, regex in rules)
    assert all(any(root in key for root in licenses.roots()) or key.startswith("cc ") for _, _, key, _ in rules)


def spelled(regex):
    """Strings that the regex matches, one for each way through its options and branches; a free stretch is "x"."""
    from re import _parser as parser

    def walk(items):
        out = [""]
        for op, arg in items:
            op = str(op)
            if op == "LITERAL":
                ways = [chr(arg)]
            elif op == "IN":
                ways = [chr(v) for k, v in arg if str(k) == "LITERAL"] or (["1"] if "CATEGORY_DIGIT" in str(arg) else ["x"])
                ways = ["x"] if str(arg[0][0]) == "NEGATE" else ways
            elif op in ("NOT_LITERAL", "ANY"):
                ways = ["x"]
            elif op == "SUBPATTERN":
                ways = walk(arg[-1])
            elif op == "BRANCH":
                ways = [x for branch in arg[1] for x in walk(branch)]
            elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                ways = [x * n for x in walk(inner) for n in {low, 1 if (low, high) == (0, 1) else max(low, 1)}]
            else:
                assert op == "ASSERT_NOT", op
                ways = [""]
            out = [a + b for a in out for b in dict.fromkeys(ways)]
        return out

    return [x for x in walk(parser.parse(regex)) if re.fullmatch(regex, x)]


def test_keywords_and_roots_pass_all_that_rules_match():
    roots = licenses.roots()
    for label, _, key, regex in license_rules.rules():
        ways = spelled(regex)
        assert ways and all(key in x for x in ways), (label, key, [x for x in ways if key not in x][:3])
        assert all(any(r in x for r in roots) or " cc by " in f" {x} " for x in ways), (label, regex)


def test_licenses_past_their_keywords(spark):
    holder = "the Regents of the University of California at Berkeley, the Lawrence Berkeley National Laboratory and the International Computer Science Institute"
    bsd = "Neither the name of {} nor the names of its contributors may be used to endorse or promote products"
    texts = ["CreativeML Open RAIL-M", "BigScience OpenRAIL-M License", "the BigCode Open RAIL M", "PostgreSQL Licence", "PostgreSQL License", bsd.format(holder), bsd.format("X"), "Neither the name of Foo may be used. MIT License. " + bsd.format("Bar")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == ["openrail-m"] * 3 + ["postgresql"] * 2 + ["bsd-3-clause"] * 2 + ["bsd-3-clause,mit"]
    many = [(0, "Neither the name of somebody " * 40_000, "s")]
    assert licenses.scan_licenses(docs(spark, many)).first()["labels"] == ""


def test_chat_odd(spark):
    kind = "conv_id long, turn long, role string, text string, chain string"
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "h"), (4, 1, "user", "i"), (5, 0, None, None), (6, 0, "user", "<|im_end|>"), (6, 0, "user", "<|im_end|>"), (None, None, "user", "lost"), (7, 1, "user", "x" * 100_000)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame([(*r, "c") for r in rows], kind)).collect()}
    assert set(got) == {2, 4, 5, 6, 7, None} and got[2]["n_copies"] == 2 and got[6]["n_turns"] == 1
    assert got[2]["rendered"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n" and got[6]["rendered"].count("<|im_end|>") == 1
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17, 1000])
def test_chain(spark, n):
    turns = [("user", f"t{i}") if i % 3 else (None, "é" * i) for i in range(n)]
    last, want = "", []
    for role, text in turns:
        last = hashlib.md5((last + "|".join("-" if x is None else f"{len(x)}:{x}" for x in (role, text))).encode()).hexdigest()
        want.append(last)
    frame = spark.createDataFrame([(turns,)], "turns array<struct<role:string,text:string>>")
    assert frame.select(chat._chain(F.col("turns"))).first()[0] == want


def test_long_inputs_take_no_quadratic_work(spark, tmp_path):
    """Sizes at which work that grows with the square of a text's detections, or of a conversation's turns, takes minutes."""
    text = F.expr("repeat('Licensed under the Apache License, Version 2.0 see the MIT license ', 10000)")
    spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/text")
    r = licenses.scan_licenses(spark.read.parquet(f"{tmp_path}/text")).first()
    assert (r["n_words"], r["n_base"], r["labels"], len(r["detections"])) == (120_000, 20_000, "apache,apache-2.0,mit", 20_000)
    spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(f"{tmp_path}/turns")
    assert [r["n_turns"] for r in chat.format_chats(spark.read.parquet(f"{tmp_path}/turns")).collect()] == [20_000]


def test_digest_columns(spark, sf):
    r = entry.op3_line_dedup(spark, sf).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())
