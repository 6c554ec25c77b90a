"""Media columns, near duplicates, nearest neighbours, SentencePiece, language ID and the pipeline."""

import hashlib
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from brindle.llm import ann, entry, langid, media, neardup, pieces

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, lang string, node int, Node int, media string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", 1, 2, "m") for r in rows], KIND)


# ------------------------------------------------------------------ media

def test_media(spark, sf):
    rows = [(1, None), (1, ""), (None, "x"), (2, "é" * 288), (3, "a" * 577), (3, "a" * 577), (4, "long " * 100_000)]
    got = [r.asDict() for r in media.media_columns(docs(spark, rows)).collect()]
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = media.pad(raw)
        image = media.to_image(payload)
        want.append({"doc_id": i, "n_bytes": len(raw), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(image), "media_sha256": hashlib.sha256(image).hexdigest(), "feature": media.feature(payload), "error": None})
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert media.media_columns(docs(spark, [])).count() == 0
    assert entry.op2_media_columns(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_media_ranges_and_damage(spark, tmp_path):
    folder = tmp_path / "archives"
    assert media.write_archives(docs(spark, [(i, f"text {i} " * 200) for i in range(200)]).coalesce(2), folder.as_uri()) == 200
    small = media.read_archives(spark, folder.as_uri(), splitbytes=3000)
    assert small.rdd.getNumPartitions() > 10 and small.select("doc_id").distinct().count() == 200
    archive = next(folder.glob("*.zip"))
    with zipfile.ZipFile(archive) as z:
        info = z.infolist()[3]
    data = bytearray(archive.read_bytes())
    data[info.header_offset + 100] ^= 255
    archive.write_bytes(data)
    bad = [r["doc_id"] for r in media.media_features(media.read_archives(spark, folder.as_uri())).collect() if r["error"]]
    assert bad == [int(info.filename[:-4])]


# ------------------------------------------------------------------ near duplicates

def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOW))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts, threshold=0.8, corpus=None):
    """Components of weighted Jaccard similarity over all pairs that share a shingle, with weights from exact frequencies
    over the corpus (a list of texts; by default texts)."""
    own, by, parent = {k: shingles(t) for k, t in texts.items()}, defaultdict(list), {k: k for k in texts}
    every = [shingles(t) for t in corpus] if corpus else list(own.values())
    df, n = Counter(x for s in every for x in s), max(sum(1 for s in every if s), 2)
    idf = {x: 1 + neardup.DAMP * round(np.log(n / k) / np.log(n) * (neardup.STEPS - 1)) / (neardup.STEPS - 1) for x, k in df.items()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    first = {}
    for k in sorted(texts):
        join(first.setdefault(texts[k], k), k)
        for x in own[k]:
            by[x].append(k)
    weight = lambda x, m: idf[x] * (1 + np.log(m))
    total = {k: sum(weight(x, m) for x, m in s.items()) for k, s in own.items()}
    for a, b in {(a, b) for ks in by.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}:
        both = sum(weight(x, min(m, own[b][x])) for x, m in own[a].items() if x in own[b])
        if both / (total[a] + total[b] - both) >= threshold:
            join(a, b)
    return {k: find(k) for k in texts}


def test_near_duplicates(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    rng = random.Random(5)
    for i in range(60):  # a hot group of edited copies
        w = texts[5].split(" ")
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        texts[10_000 + i] = " ".join(w)
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_odd(spark):
    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, TWO!"), (6, "one two three"), (7, long_), (8, long_ + " end"), (9, long_), (9, long_), (None, "lonely words that stand by themselves here"), (None, "one two")]
    got = [(r["doc_id"], r["class_id"], r["n_class"]) for r in neardup.classes(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = defaultdict(set)
    for i, c, _ in got:
        by[i].add(c)
    assert by[1] == by[2] == {1} and by[3] == {3} and by[4] == by[5] == {4} and by[6] == {6} and by[7] == by[8] == by[9] == {7}
    kept = neardup.keep_one(docs(spark, rows))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs(spark, rows).columns and sorted(x for x in ids if x) == [1, 3, 4, 6, 7] and ids.count(None) == 1
    assert neardup.classes(docs(spark, [])).count() == 0


def test_near_duplicates_by_weight(spark):
    """Frequencies count: a text isn't one of the text written twice; but it is one of the text with a few words repeated
    300 times."""
    rng = random.Random(7)
    texts = {}
    for k in range(16):
        w = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        for n in (1, 2, 3):
            texts[10 * k + n] = " ".join(w * n)
        texts[10 * k + 4], texts[10 * k + 5] = (" ".join(w[:60] + w[50:55] * n + w[60:]) for n in (0, 300))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)
    assert all(got[10 * k + 1] == got[10 * k + 4] == got[10 * k + 5] != got[10 * k + 2] for k in range(16))


def test_long_words_and_windows(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab c\u00e9.") for _ in range(n)).encode() for n in (0, 1, 700, 3, 0, 2500)] + [b"x" * 900 + b" y z q r x" + b"x" * 300]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = neardup.shingles(data, ends)
    assert [int(whole.tf[a:b].sum()) for a, b in zip(whole.starts[:-1], whole.starts[1:])] == [sum(shingles(t.decode()).values()) for t in texts]
    for window in (1, 7, 64):
        monkeypatch.setattr(neardup, "WINDOW", window)
        assert all((a == b).all() for a, b in zip(whole, neardup.shingles(data, ends), strict=True))


def test_open_buckets_in_blocks(spark, monkeypatch):
    """All texts in one bucket, of which leaders settle little, compared in blocks of few bytes."""
    rng = random.Random(11)
    texts = {}
    for k in range(24):
        w = [f"v{rng.randrange(10**9)}" for _ in range(60)]
        texts[2 * k], texts[2 * k + 1] = " ".join(w), " ".join([*w, "end", str(k)])

    def one_bucket(steps):
        def run(batches):
            import pyarrow as pa

            for x in batches:
                lists = pa.array([[7, *[1000 * (node + 1) + k for k in range(1, neardup.BANDS)]] for node in x["node"].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([x["node"], x["t1"], x["t2"], pa.array([100] * x.num_rows, pa.int32()), lists], ["node", "t1", "t2", "bytes", "bands"])

        return run

    monkeypatch.setattr(neardup, "_signatures", one_bucket)
    for size in (2048, 10):
        monkeypatch.setattr(neardup, "BLOCK", size)
        got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
        assert got == {i: i // 2 * 2 for i in texts}


def test_near_duplicates_of_a_bucket_led_twice(spark, monkeypatch):
    """A leads its bucket by copies and by hash, and is like neither B nor C, which are alike."""

    def one_bucket(steps):
        def run(batches):
            import pyarrow as pa

            for x in batches:
                lists = pa.array([[7, *[1000 * (node + 1) + k for k in range(1, neardup.BANDS)]] for node in x["node"].to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([x["node"], x["t1"], x["t2"], pa.array([100] * x.num_rows, pa.int32()), lists], ["node", "t1", "t2", "bytes", "bands"])

        return run

    monkeypatch.setattr(neardup, "_signatures", one_bucket)
    order = [r["node"] for r in spark.sql("SELECT id AS node FROM range(1, 4) ORDER BY xxhash64(7L, id)").collect()]
    a, b, c = order[0], *sorted(order[1:])
    own = " ".join(f"w{i}" for i in range(200))
    rows = [(a, "quite another text of some words"), (a, "quite another text of some words"), (b, own), (c, own + " end")]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs(spark, rows)).collect()}
    assert got == {a: a, b: b, c: b}


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 2000)]
    a, b = " ".join(words[:1500]).encode(), " ".join(words[300:1800]).encode()
    s = neardup.shingles(np.frombuffer(a + b, np.uint8), np.array([0, len(a), len(a) + len(b)]))
    steps = np.full(1 << neardup.SKETCH_BITS, 7, np.uint8)
    got = neardup.samples(s, steps)
    one, two = (neardup.Shingles(s.hash[x], s.tf[x], np.zeros(x.stop - x.start, int), np.array([0, x.stop - x.start])) for x in (slice(0, s.starts[1]), slice(s.starts[1], s.starts[2])))
    true = neardup.similarities(one, two, steps)[0]
    assert abs((got[:, 0] == got[:, 1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / neardup.SAMPLES)


def test_samples_estimate_similarity_of_large_frequencies():
    alone = np.random.default_rng(3).integers(1, 2**63, 700).astype(np.uint64)
    often = alone[400:]
    parts = [np.sort(np.append(alone[x], often)) for x in (slice(0, 200), slice(200, 400))]
    tf = [np.where(np.isin(p, often), 20_000, 1) for p in parts]
    n = len(parts[0])
    s = neardup.Shingles(np.concatenate(parts), np.concatenate(tf), np.repeat([0, 1], n), np.array([0, n, 2 * n]))
    steps = np.full(1 << neardup.SKETCH_BITS, 7, np.uint8)
    got = neardup.samples(s, steps)
    one, two = (neardup.Shingles(h, f, np.zeros(n, int), np.array([0, n])) for h, f in zip(parts, tf, strict=True))
    true = neardup.similarities(one, two, steps)[0]
    assert true > 0.85 and abs((got[:, 0] == got[:, 1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / neardup.SAMPLES)


# ------------------------------------------------------------------ nearest neighbours

def test_nearest(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in entry.op5_nearest_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in rows if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        cos = {i: float(v @ rows[q] / np.linalg.norm(v) / np.linalg.norm(rows[q])) for i, v in rows.items() if i != q}
        best = sorted(cos, key=lambda i: (-cos[i], i))[:5]
        hit += len({i for i, _ in found} & set(best))
        assert all(abs(cos[i] - s) < 1e-12 for i, s in found) and len(found) == 5
    assert hit / (5 * len(got)) >= 0.9


def test_nearest_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [1.0, nan]), (200, [inf, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1e200, 0.0]), (4, [None, 1.0]), (None, [1.0, 0.0]), (5, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, segment int, v int")
    got = [tuple(r) for r in ann.nearest(frame).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (0, 4, 5, 0.0)]
    assert ann.nearest(frame.limit(0)).count() == 0


# ------------------------------------------------------------------ SentencePiece

def test_pieces(spark, sf):
    model = pieces.read_model(entry.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    letters = "aáeèßtion thé日本🙂\n ▁.,;()<>/=_-+'\"0123456789ABCXYZ‌اب\x00"
    texts = ["", " ", "  a  b ", "a▁b", "x" * 5000, " " * 50 + "q", "<s> </s> <0x0A>", "é" * 3000] + ["".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (0, "")] + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    text = {i: t for i, t in rows}
    out = pieces.encode_texts(docs(spark, rows), model)
    for r in out.collect():
        t = text[r["doc_id"]] or ""
        want = sp.encode(t)
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(want).encode()).hexdigest() and r["lossless"] == ("▁" not in t)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(out, model).collect()}
    assert all(back[i] == (t or "") for i, t in rows if "▁" not in (t or ""))
    assert pieces.encode_texts(docs(spark, []), model).count() == 0


# ------------------------------------------------------------------ language ID

def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in table.collect()}
    rows = entry.op9_language_id(spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.97


def test_language_odd(spark, sf):
    model = entry.language_model(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(1, None), (1, ""), (2, "12 34 !"), (None, "the and of the in that"), (3, "é"), (4, "the of and " * 50_000)]
    got = {(r["doc_id"], r["lang_pred"] == "und", r["score"] == 0) for r in langid.predict(docs(spark, rows), model).collect()}
    assert got == {(1, True, True), (2, True, True), (None, False, False), (3, False, False), (4, False, False)}
    nothing = langid.fit(docs(spark, []))
    assert {r["lang_pred"] for r in langid.predict(docs(spark, rows), nothing).collect()} == {"und"}
    assert langid.predict(docs(spark, []), model).count() == 0
    kept = langid.keep_known(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 3


def test_every_text_with_a_letter_is_kept(spark, sf):
    model = entry.language_model(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(1, "a"), (2, "Z"), (3, "7"), (4, " "), (5, None), (6, "é"), (7, ""), (8, "the of")]
    got = {r["doc_id"] for r in langid.predict(docs(spark, rows), model).collect() if r["lang_pred"] in model.languages and r["score"] > 0}
    assert got == {1, 2, 6, 8}
    for m in (model, langid.fit(docs(spark, []))):
        assert {r["doc_id"] for r in langid.keep_known(docs(spark, rows), m).collect()} == {1, 2, 6, 8}


def test_windows_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(60, 130, n).tolist()) for n in (0, 5, 1, 2, 300, 0, 7, 64, 0)]
    args = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.arange(len(texts)), len(texts)
    whole = langid.gram_table(*args)
    for n in (1, 3, 64):
        monkeypatch.setattr(langid, "WINDOW", n)
        assert (langid.gram_table(*args) == whole).all()
    alone = [langid.gram_table(np.frombuffer(t, np.uint8), np.array([0, len(t)]), np.zeros(1, int), 1) for t in texts]
    assert (np.concatenate(alone) == whole).all() and whole.sum() == sum(max(0, len(t) - 1) + max(0, len(t) - 2) for t in texts) - sum(t[i : i + 2].translate(None, bytes(c for c in range(128) if not chr(c).isalpha())) == b"" for t in texts for i in range(len(t) - 1)) - sum(t[i + 1 : i + 3].translate(None, bytes(c for c in range(128) if not chr(c).isalpha())) == b"" for t in texts for i in range(len(t) - 2))


def test_mixture():
    rng = np.random.default_rng(2)
    words = [[bytes(rng.integers(97, 123, 5).tolist()) for _ in range(50)] for _ in range(3)]
    say = lambda k, n: b" ".join(words[k][i] for i in rng.integers(0, 50, n))
    counts = np.stack([langid.gram_table(np.frombuffer(t, np.uint8), np.array([0, len(t)]), np.zeros(1, int), 1) for t in (say(k, 3000) for k in range(3))], 1) + 0.5
    p = counts / counts.sum(0)
    model = langid.Model(["a", "b", "c"], np.maximum(p / p.max(1, keepdims=True), 1e-9).astype(np.float32))
    texts = [say(0, 100), say(0, 70) + b" " + say(2, 30)]
    share, seen = langid.infer(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert seen.all() and share[0].tolist() == [1, 0, 0] and share[1, 1] == 0 and abs(share[1, 0] - 0.7) < 0.1


def test_mixture_of_many_languages():
    rng = np.random.default_rng(9)
    words = [[bytes(rng.integers(97, 123, 5).tolist()) for _ in range(50)] for _ in range(7)]
    say = lambda k, n: b" ".join(words[k][i] for i in rng.integers(0, 50, n))
    counts = np.stack([langid.gram_table(np.frombuffer(t, np.uint8), np.array([0, len(t)]), np.zeros(1, int), 1) for t in (say(k, 3000) for k in range(7))], 1) + 0.5
    p = counts / counts.sum(0)
    model = langid.Model(list("abcdefg"), np.maximum(p / p.max(1, keepdims=True), 1e-9).astype(np.float32))
    texts = [b" ".join(say(k, 60) for k in some) for some in ((0, 2, 3, 5), (1, 2, 3, 4, 6))]
    share, _ = langid.infer(model, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [np.flatnonzero(x).tolist() for x in share] == [[0, 2, 3, 5], [1, 2, 3, 4, 6]]
    assert abs(share[0, [0, 2, 3, 5]] - 1 / 4).max() < 0.05 and abs(share[1, [1, 2, 3, 4, 6]] - 1 / 5).max() < 0.05


# ------------------------------------------------------------------ pipeline

def test_pipeline(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    frame = table
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stored(stage(spark, frame, sf), "test")
        seen[name] = frame
        assert frame.columns == table.columns
    known = {r["doc_id"] for r in seen["language_id"].collect()}
    assert known == {r["doc_id"] for r in table.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])}
    assert seen["line_dedup"].count() == seen["language_id"].count()
    texts = {r["doc_id"]: r["text"] for r in seen["line_dedup"].collect()}
    assert {r["doc_id"] for r in seen["near_dedup"].collect()} == set(brute_classes(texts).values())
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf)
    assert last.columns == [*table.columns, "n_tokens", "ids", "decoded_sha256", "lossless"] and last.count() == frame.count()
