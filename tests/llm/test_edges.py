"""Cases at the edges of the operators' bounds: beyond broadcasts, blocks and windows, damage, and independent models."""

import hashlib
import random
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import ann, entry, langid, line_dedup, media, mixing, neardup, pieces, url_filter

KIND = "doc_id long, text string, lang string, source string, n_chars long, node int, lines int, media string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 1, 2, "m") for r in rows], KIND)


# ------------------------------------------------------------------ media

def decoded(png):
    """A reader of PNG that shares nothing with the operator: width, height and samples."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, data = 8, b""
    while at < len(png):
        size = int.from_bytes(png[at : at + 4], "big")
        kind, body = png[at + 4 : at + 8].decode(), png[at + 8 : at + 8 + size]
        assert zlib.crc32(png[at + 4 : at + 8 + size]) == int.from_bytes(png[at + 8 + size : at + 12 + size], "big")
        if kind == "IHDR":
            width, height, depth, colour = *struct.unpack(">II", body[:8]), body[8], body[9]
        if kind == "IDAT":
            data += body
        at += 12 + size
    raw = zlib.decompress(data)
    assert (depth, colour) == (8, 0) and len(raw) == height * (width + 1) and not any(raw[:: width + 1])
    return width, height, b"".join(raw[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def test_media_by_an_independent_reader(spark, tmp_path):
    rows = [(1, None), (2, "é" * 288), (3, "a" * 577), (4, "some words " * 999), (None, "x")]
    folder = (tmp_path / "a").as_uri()
    got = {r["doc_id"]: r for r in media.media_columns(docs(spark, rows), folder=folder).collect()}
    for r in media.read_archives(spark, folder).collect():
        raw = ({i: t for i, t in rows}[r["doc_id"]] or "").encode()
        width, height, samples = decoded(bytes(r["media"]))
        assert width == 576 and samples == raw + b"\xff" * (height * 576 - len(raw)) and 0 <= height * 576 - len(raw) < 576 + (not raw)
        own = got[r["doc_id"]]
        assert own["n_bytes"] == len(raw) and own["payload_bytes"] == len(samples) and own["payload_sha256"] == hashlib.sha256(samples).hexdigest()
        assert own["tail_crc32"] == zlib.crc32(samples[-32:]) and own["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and own["media_bytes"] == len(r["media"])
        x = np.frombuffer(samples, np.uint8).astype(float)
        assert own["feature"].startswith(f"mean={x.mean():.4f};std={x.std():.4f};")


def test_media_is_whole_or_fails(spark, tmp_path):
    folder = tmp_path / "a"
    assert media.write_archives(docs(spark, [(i, f"text {i} " * 50) for i in range(40)]).coalesce(2), folder.as_uri()) == 40
    media.check_archives(spark, folder.as_uri())
    archive = sorted(folder.glob("*.zip"))[0]
    whole = archive.read_bytes()
    with zipfile.ZipFile(archive) as z:
        info = z.infolist()[1]
    data = bytearray(whole)
    data[info.header_offset + 100] ^= 255
    archive.write_bytes(data)
    with pytest.raises(Exception, match="can't be read"):
        media.media_features(media.read_archives(spark, folder.as_uri()), whole=True).collect()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("1.png", b"x")
    with pytest.raises(ValueError, match="as written"):
        media.check_archives(spark, folder.as_uri())
    archive.unlink()
    with pytest.raises(ValueError, match="-1 of"):
        media.check_archives(spark, folder.as_uri())


def test_a_retry_succeeds(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("7.png", b"payload")
        info = z.infolist()[0]
    reader = media.ArchiveReader({"path": tmp_path.as_uri()})
    fs, _ = media._open(tmp_path.as_uri())

    class Broken:
        def seek(self, at):
            raise OSError("the connection is gone")

    assert reader._member(fs, str(path), Broken(), info) == (b"payload", None)
    assert reader._member(fs, str(tmp_path / "none.zip"), Broken(), info)[1].startswith("FileNotFoundError")


# ------------------------------------------------------------------ lines, mixing, near duplicates beyond their broadcasts

def test_lines_beyond_the_broadcast(spark, monkeypatch):
    line = "a line that a third of all documents hold, forty code points or more "
    rows = [(i, "\n".join([f"{line}{i % 3}", f"own {i}", f"{line}{i % 3}"])) for i in range(60)] + [(None, line + "0")]
    want = sorted(map(tuple, line_dedup.dedup_lines(docs(spark, rows)).collect()), key=repr)
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", -1)
    assert sorted(map(tuple, line_dedup.dedup_lines(docs(spark, rows)).collect()), key=repr) == want
    assert sum(r[2] for r in want) == 2 * 57 + 1


def test_lengths(spark):
    frame = docs(spark, [(1, "abc"), (2, None), (2, "é"), (2, "é")])
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in line_dedup.with_lengths(frame.withColumn("n_chars", F.lit(9).cast("long"))).na.fill({"text": "-"}).collect())
    assert got == [(1, "abc", 3), (2, "-", 9), (2, "é", 1), (2, "é", 1)]
    assert line_dedup.with_lengths(frame.drop("n_chars")).columns == frame.drop("n_chars").columns
    assert line_dedup.with_lengths(frame.limit(0)).count() == 0


def test_mixing_beyond_the_broadcast(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, mixing.mix_sizes(table).collect()))
    real = mixing._planned
    monkeypatch.setattr(mixing, "_planned", lambda keyed, plan: real(keyed, plan, broadcast_rows=-1))
    assert sorted(map(tuple, mixing.mix_sizes(table).collect())) == want


def test_near_duplicates_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
    rows = [(i, " ".join([*words, f"e{i}"])) for i in range(20)] + [(100 + i, f"other text {i}") for i in range(20)]
    monkeypatch.setattr(neardup, "MOST_BROADCAST", -1)
    got = {r["doc_id"]: (r["class_id"], r["n_class"]) for r in neardup.classes(docs(spark, rows)).collect()}
    assert got == {i: (0, 20) if i < 100 else (i, 1) for i, _ in rows}


# ------------------------------------------------------------------ URLs

def test_rules_with_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.org/y")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "/", "block"), ("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("org", None, "block"), ("org", "/", None)], "host string, path string, verdict string")
    for mb in (8.0, -1):
        got = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, broadcast_mb=mb).na.fill({"rule": "-"}).collect())
        assert got == [(1, "com/", "block"), (1, "com/", "block"), (2, "-", "allow")]


# ------------------------------------------------------------------ nearest neighbours

def brute_nearest(rows, every, k):
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        score[i] = -9
        out[ids[i]] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def test_grouped_vectors_need_few_cells(spark, monkeypatch):
    """Recall and probes at two sizes of a table whose vectors lie in groups: the share of cells falls as it grows."""
    rng, share = np.random.default_rng(4), []
    for n in (2000, 8000):
        centres = rng.normal(size=(n // 25, 32))
        rows = {i: centres[i % len(centres)] + 0.25 * rng.normal(size=32) for i in range(n)}
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
        real, seen = ann._probes, []
        monkeypatch.setattr(ann, "_probes", lambda *a, real=real, seen=seen: seen.append((real(*a), len(a[2]))) or seen[-1][0])
        got = {}
        for r in ann.nearest(frame, every=40, cell_rows=64).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        monkeypatch.setattr(ann, "_probes", real)
        want = brute_nearest(rows, 40, 5)
        assert set(got) == set(want) and np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.95
        share.append(seen[0][0] / seen[0][1])
    assert share[1] < share[0] < 0.5


def test_blocks_segments_and_ties(spark):
    """Many query blocks and segments of one hot cell give what one of each gives, and ties go to the smaller id."""
    rng = np.random.default_rng(5)
    rows = {i: rng.normal(size=8).round(1) for i in range(300)}
    for i in range(100, 112):
        rows[i] = rows[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    plain = [tuple(r) for r in ann.nearest(frame, every=10, share=1.0, caught=1.0).orderBy("query_id", "rank").collect()]
    cut = [tuple(r) for r in ann.nearest(frame, every=10, share=1.0, caught=1.0, segment_rows=7, query_rows=3, least_cells=2, cell_rows=10**6).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in cut] == [r[:3] for r in plain] and [r[2] for r in plain if r[0] == 100] == [101, 102, 103, 104, 105]
    few = [tuple(r)[:3] for r in ann.nearest(frame.where("vec_id < 4"), every=10).orderBy("rank").collect()]
    assert sorted(r[2] for r in few) == [1, 2, 3]


# ------------------------------------------------------------------ SentencePiece

def test_long_units(spark):
    import sentencepiece

    model = pieces.read_model(entry.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/é漢😀"
    texts = ["".join(rng.choice(letters) for _ in range(pieces.PORTION * 3 + 17)), "the" * pieces.PORTION, "word " + "z" * (pieces.PORTION + 1) + " end"]
    for r in pieces.encode_texts(docs(spark, list(enumerate(texts))), model).collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["lossless"]


def test_decoding_odd_ids(spark):
    model = pieces.read_model(entry.MODEL)
    frame = lambda ids: spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    assert pieces.decode_ids(frame(None), model).first()["text"] == "" and pieces.decode_ids(frame([None]), model).first()["text"] == ""
    for bad in ([-1], [32_000]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            pieces.decode_ids(frame(bad), model).collect()
    assert pieces.decode_ids(frame([]).limit(0), model).count() == 0


# ------------------------------------------------------------------ language ID

def plain_mixture(model, text, rounds=6, least=0.02, penalty=3.0):
    """The same mixture by plain loops: n-grams as a list, one language set after the other."""
    fold = lambda b: b if 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32
    x = [fold(b) for b in text.encode()]
    seen = [(x[i] << 8 | x[i + 1]) + (1 << 25) for i in range(len(x) - 1) if (x[i], x[i + 1]) != (32, 32)]
    seen += [x[i] << 16 | x[i + 1] << 8 | x[i + 2] for i in range(len(x) - 2) if (x[i + 1], x[i + 2]) != (32, 32)]
    rows = [model.ratio[(v * 2654435761 % 2**32) >> (32 - langid.BITS)].astype(float) for v in seen]
    langs = range(len(model.languages))

    def em(pi):
        for _ in range(rounds):
            new = [0.0] * len(pi)
            for p in rows:
                total = sum(p[k] * pi[k] for k in langs)
                for k in langs:
                    new[k] += p[k] * pi[k] / max(total, 1e-20) / len(rows)
            pi = new
        return pi

    value = lambda pi, n: sum(np.log(max(sum(p[k] * pi[k] for k in langs), 1e-20)) for p in rows) - n * penalty * np.log(max(len(rows), 2))
    first = em([1 / len(model.languages)] * len(model.languages))
    order = sorted(langs, key=lambda k: -first[k])
    best = None
    for n in range(1, len(order) + 1):
        if n > 1 and first[order[n - 1]] < least:
            break
        own = [first[k] if k in order[:n] else 0.0 for k in langs]
        pi = [float(k == order[0]) for k in langs] if n == 1 else em([v / sum(own) for v in own])
        if best is None or value(pi, n) > best[0]:
            best = (value(pi, n), pi)
    return best[1]


def test_mixtures_by_plain_loops(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = entry.language_model(table)
    texts = [r["text"][:1500] for r in table.orderBy("doc_id").limit(25).collect()]
    texts += [a[:400] + " " + b[:400] + " " + c[:300] for a, b, c in zip(texts, texts[7:], texts[13:], strict=False)] + ["ab", "ééé", "The  of and"]
    ends = np.cumsum([0, *(len(t.encode()) for t in texts)])
    share, _ = langid.infer(model, np.frombuffer("".join(texts).encode(), np.uint8), ends)
    for t, got in zip(texts, share, strict=True):
        assert np.abs(got - plain_mixture(model, t)).max() < 2e-3


def test_counts_are_all_ngrams(spark):
    """What is learned equals counts by plain loops over all rows."""
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abcde é.\n") for _ in range(rng.randrange(300))), rng.choice(["x", "y", None])) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(frame)
    counts = {k: np.zeros(langid.BINS) for k in ("x", "y")}
    fold = lambda b: b if 97 <= b <= 122 or b > 127 else 32
    for _, t, lang in rows:
        if lang:
            b = [fold(c) for c in t.encode()]
            for v in [(p << 8 | q) + (1 << 25) for p, q in zip(b, b[1:], strict=False) if (p, q) != (32, 32)] + [p << 16 | q << 8 | r for p, q, r in zip(b, b[1:], b[2:], strict=False) if (q, r) != (32, 32)]:
                counts[lang][(v * 2654435761 % 2**32) >> (32 - langid.BITS)] += 1
    log_p = np.stack([np.log(counts[k] + 0.5) - np.log(counts[k].sum() + 0.5 * langid.BINS) for k in ("x", "y")], 1)
    assert model.languages == ["x", "y"] and np.allclose(model.ratio, np.maximum(np.exp(log_p - log_p.max(1, keepdims=True)), 1e-9), rtol=1e-5)


def test_more_languages_than_a_model_holds(spark):
    rows = [(i, f"text of language {i} " * (1 + i), f"l{i:02d}") for i in range(20)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=5)
    assert model.languages == [f"l{i}" for i in range(15, 20)]


# ------------------------------------------------------------------ the pipeline

@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "the of and in that")] * 3 + [(None, None), (2, ""), (None, "the of and"), (3, "é" * 5000), (4, " a b " * 20_000)]])
def test_pipeline_odd(spark, sf, rows):
    frame = docs(spark, rows) if rows else spark.createDataFrame([], KIND)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.stored(stage(spark, frame, sf), "odd")
        assert frame.columns == [x.split(" ")[0] for x in KIND.split(", ")]
    last = corpus_pipeline.STAGES[-1][1](spark, frame, sf).collect()
    assert len(last) >= (4 if len(rows) > 2 else 0) and all(r["lossless"] for r in last)


def test_arrow_batches_are_bounded(spark):
    """The session's batches hold a row, or some 2 MB."""
    from brindle.llm.common import BATCH, small_batches

    small_batches(spark)
    sizes = spark.range(3000).select(F.repeat(F.lit("x"), 5000).alias("t")).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) < 1.1 * BATCH
