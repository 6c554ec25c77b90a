"""Near duplicates: consistent weighted samples of TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, frugal, packed, pick, slices, small_batches, stored
from .graph import components
from .langid import _bytes

#: Words a shingle; similarity from which documents are near duplicates.
WORDS, SIMILAR = 5, 0.8
#: Samples are BANDS x ROWS; two texts with similarity 0.8 miss each other in all bands in 0.2 % of cases, with 0.85 in 0.003 %.
BANDS, ROWS = 21, 6
SAMPLES = BANDS * ROWS
#: The document-frequency sketch: 2^SKETCH_BITS counters in blocks of 2^BLOCK_BITS, whatever the corpus.
SKETCH_BITS, BLOCK_BITS = 22, 16
#: IDF is kept in so many steps, and lies between 1 and 1 + DAMP: copies raise the frequency of their own shingles, so
#: that an undamped IDF makes the members of a large group look less alike than those of a small one (see README for
#: figures). A shingle's weight in a text is its IDF times 1 + the logarithm of its frequency there.
STEPS, DAMP = 16, 0.1
#: Logarithms of the weights of term frequencies below this come from a table, the others' are computed.
TF_TABLE = 1024
#: Text ids that are broadcast at most (8 bytes each) to fetch the texts of candidate pairs.
MOST_BROADCAST = 4_000_000
#: Members of an open bucket, and bytes of their texts, that a task holds at once, at most twice over (a block of a single
#: text has that text's bytes).
BLOCK, BLOCK_BYTES = 2048, 2 << 20
#: Bytes whose words are hashed at once, so that a long text takes little more memory than its words do.
WINDOW = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Draws of consistent weighted sampling: r and c from Gamma(2, 1), b uniform. A shingle's draw for a sample is picked by
#: 16 bits of its hash; shingles that share one draw are told apart by their hashes. Draws are in order of their value a at
#: weight 1, which is exponential, and spread evenly over its quantiles; given a, c is a + Exp(1), with e = log(c / a) r is
#: e + Exp(1), and b is 1 - e / r. The least FINE of the first 2^16 are replaced by 2^16 further ones, picked by 16 other
#: bits: the least values decide where one text has many shingles and large frequencies.
DRAWS, FINE = 1 << 16, 256
_AT = (np.arange(DRAWS) + 0.5) / DRAWS
_A = -np.log1p(-np.concatenate([_AT, _AT * FINE / DRAWS]))
_C = _A + _rng.exponential(size=2 * DRAWS)
_E = np.log(_C / _A)
_R = _E + _rng.exponential(size=2 * DRAWS)
_B = (1 - _E / _R).astype(np.float32)
_BASE = (np.log(_C) - _R).astype(np.float32)
_INV, _R = (1 / _R).astype(np.float32), _R.astype(np.float32)
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58], _FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Shingles(NamedTuple):
    """Distinct shingles of some texts, by text: hash, term frequency, text; starts: each text's first (texts + 1)."""

    hash: np.ndarray
    tf: np.ndarray
    of: np.ndarray
    starts: np.ndarray


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the text it is of, a window of the data at a time; a window ends where a word does."""
    hashes, texts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], 0
    border = np.zeros(len(data) + 1, bool)
    border[ends] = True
    while at < len(data):
        to = at + WINDOW
        while to < len(data) and _FOLD[data[to]] and not border[to]:
            to += 1
        to = min(to, len(data))
        x = _FOLD[data[at:to]]
        inner = x != 0
        begin = inner.copy()
        begin[1:] &= ~inner[:-1] | border[at + 1 : to]
        spot = np.flatnonzero(inner)
        if len(spot):
            opens = np.flatnonzero(begin[spot])
            place = spot - np.repeat(spot[opens], np.diff(np.append(opens, len(spot))))
            hashes.append(_mix(np.add.reduceat(_BYTE[place & 63, x[spot]] * (np.uint64(1) + (place >> 6).astype(np.uint64)), opens)))
            texts.append((np.searchsorted(ends, at + spot[opens], "right") - 1).astype(np.int32))
        at = to
    return np.concatenate(hashes), np.concatenate(texts)


def shingles(data: np.ndarray, ends: np.ndarray) -> Shingles:
    """Words are runs of ASCII letters (case folded), digits and non-ASCII characters; a shingle is WORDS of them in
    order, or all words of a text with fewer."""
    texts = len(ends) - 1
    word_hash, of = _word_hashes(data, ends)
    if not len(of):
        return Shingles(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(texts + 1, np.int64))
    n = np.bincount(of, minlength=texts)
    offset = np.concatenate([[0], np.cumsum(n)])
    left = offset[of + 1] - np.arange(len(of))  # words from here to the text's end
    total = np.zeros(len(of), np.uint64)
    for i in range(WORDS):
        part = np.zeros(len(of), np.uint64)
        part[: max(len(of) - i, 0)] = word_hash[i:] * _PLACE[i]
        part[left <= i] = 0
        total += part
    whole = (left >= WORDS) | ((n[of] < WORDS) & (left == n[of]))
    h, of = _mix(total[whole]), of[whole]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    start = np.flatnonzero(new)
    tf = np.diff(np.append(start, len(h)))
    h, of = h[start], of[start]
    return Shingles(h, tf, of, np.searchsorted(of, np.arange(texts + 1)))


# ------------------------------------------------------------------ document frequencies

def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's counters, block by block and compressed; block -1 counts the documents."""
    table, docs = np.zeros(1 << SKETCH_BITS, np.uint32), 0  # a task has fewer than 2^32 texts
    for batch in slices(batches, 1 << 20):
        s = shingles(*_bytes(batch, "text"))
        np.add.at(table, (s.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        docs += int((np.diff(s.starts) > 0).sum())
    if docs:
        yield _block(-1, np.array([docs]))
        for k, part in enumerate(table.reshape(-1, 1 << BLOCK_BITS)):
            yield _block(k, part)


def _block(k: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_pack(part)], pa.binary())], ["block", "counts"])


def _pack(part: np.ndarray) -> bytes:
    """Counts as byte planes, of which the upper ones are mostly zero, compressed."""
    return zlib.compress(np.ascontiguousarray(part.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch["block"].to_pylist(), batch["counts"], strict=True):
            got = _unpack(counts.as_py())
            held[block] = held[block] + got if block in held else got
    for block, counts in held.items():
        yield _block(block, counts)


def idf_steps(texts: DataFrame) -> np.ndarray:
    """For each counter of the sketch its step of IDF (0 to STEPS - 1) from all rows of texts (text, binary).

    A count-min sketch of one row: each shingle's documents are counted at its hash, over every document. A frequency is
    its counter less what the other shingles of the same counter contribute on average, 1 at least (count-mean-min), so
    frequent shingles are seen as such however large the corpus is. Tasks send 2^22 counters in 64 compressed blocks;
    blocks are added one at a time; the driver gets the sum, 4 MB as steps, whatever the input.
    """
    kind = "block int, counts binary"
    part = texts.mapInArrow(frugal(_sketch), kind)
    got = part.repartition(1 << (SKETCH_BITS - BLOCK_BITS), "block").mapInArrow(frugal(_add), kind).collect()
    table, docs = np.zeros(1 << SKETCH_BITS, np.float64), 1
    for r in got:
        if r["block"] < 0:
            docs = int(_unpack(r["counts"])[0])
        else:
            table[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = _unpack(r["counts"])
    return steps_of(table, docs)


def steps_of(table: np.ndarray, docs: int) -> np.ndarray:
    df = np.clip(table - (table.sum() - table) / (len(table) - 1), 1, max(docs, 1))
    rare = np.log(max(docs, 2) / df) / np.log(max(docs, 2))
    return np.rint(np.clip(rare, 0, 1) * (STEPS - 1)).astype(np.uint8)


def tf_weight(tf: np.ndarray) -> np.ndarray:
    return 1 + np.log(np.maximum(tf, 1))


#: Weights by step, and logarithms of weights of steps and term frequencies, for sampling.
_IDF = 1 + DAMP * np.arange(STEPS) / (STEPS - 1)
_LOG_IDF, _LOG_TF = np.log(_IDF).astype(np.float32), np.log(tf_weight(np.arange(TF_TABLE))).astype(np.float32)


def _steps(s: Shingles, steps: np.ndarray) -> np.ndarray:
    return steps[(s.hash >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def weights(s: Shingles, steps: np.ndarray) -> np.ndarray:
    return _IDF[_steps(s, steps)] * tf_weight(s.tf)


# ------------------------------------------------------------------ samples and bands

def _keys(draw: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """For each draw its value log c - r (t - b) - r with t = floor(log w / r + b), in the upper half of 64 bits that sort
    as the values do. The value depends on the weight through t alone."""
    bias = _B[draw]
    value = _BASE[draw] - _R[draw] * (np.floor(log_w * _INV[draw] + bias) - bias)
    bits = value.view(np.uint32)
    return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


#: The keys of all draws for each step of IDF, at term frequency 1.
_TABLE = np.concatenate([_keys(np.arange(2 * DRAWS), np.full(2 * DRAWS, x, np.float32)) for x in _LOG_IDF])


def samples(s: Shingles, steps: np.ndarray) -> np.ndarray:
    """SAMPLES hashes of each text: improved consistent weighted sampling. Each shingle and sample have a draw of r, c and
    b; the shingle with the smallest value (see _keys) wins, and shingle and value, which stands for t, are the sample.
    Texts without shingles have zeros."""
    texts = len(s.starts) - 1
    out = np.zeros((SAMPLES, texts), np.uint64)
    a = 0
    while a < texts:
        # Some texts at a time, so that the arrays stay in the processor's cache.
        b = max(a + 1, int(np.searchsorted(s.starts, s.starts[a] + 16384, "right")) - 1)
        lo, hi = int(s.starts[a]), int(s.starts[b])
        if hi > lo:
            h = s.hash[lo:hi]
            step = _steps(Shingles(h, *[None] * 3), steps)
            row, own = step.astype(np.uint64) << np.uint64(17), h & np.uint64(0xFFFFFFFF)
            many = np.flatnonzero(s.tf[lo:hi] > 1)
            tf = s.tf[lo:hi][many]
            log_tf = _LOG_TF[np.minimum(tf, TF_TABLE - 1)]
            log_tf[tf >= TF_TABLE] = np.log(tf_weight(tf[tf >= TF_TABLE]))
            log_w = _LOG_IDF[step[many]] + log_tf
            has = np.flatnonzero(np.diff(s.starts[a : b + 1]) > 0)
            starts = s.starts[a : b + 1][has] - lo
            for k in range(SAMPLES):
                turned = h * _TURN[k]
                draw = turned >> np.uint64(48)
                fine = np.flatnonzero(draw < FINE)
                draw[fine] = np.uint64(DRAWS) | ((turned[fine] >> np.uint64(32)) & np.uint64(DRAWS - 1))
                key = _TABLE.take((draw | row).view(np.int64))
                if len(many):
                    key[many] = _keys(draw[many].view(np.int64), log_w)
                key |= own
                out[k, a + has] = np.minimum.reduceat(key, starts)
        a = b
    return _mix(out)


def _signatures(steps: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            s = shingles(*_bytes(batch, "text"))
            got = samples(s, steps.value)
            n = batch.num_rows
            bands = np.zeros((n, BANDS), np.uint64)
            for k in range(BANDS):
                total = np.full(n, k + 1, np.uint64)
                for row in got[k * ROWS : (k + 1) * ROWS]:
                    total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + row)
                bands[:, k] = total
            some = np.diff(s.starts) > 0
            flat = pa.array(bands[some].view(np.int64).ravel(), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch["node"], batch["t1"], batch["t2"], pc.binary_length(batch["text"]), lists], ["node", "t1", "t2", "bytes", "bands"])

    return frugal(run)


# ------------------------------------------------------------------ verification

def similarities(a: Shingles, b: Shingles, steps: np.ndarray) -> np.ndarray:
    """Weighted (TF-IDF) Jaccard similarity of the i-th text of a and of b."""
    texts = len(a.starts) - 1
    h, of = np.concatenate([a.hash, b.hash]), np.concatenate([a.of, b.of])
    w = np.concatenate([weights(a, steps), weights(b, steps)])
    order = np.lexsort((h, of))
    h, of, w = h[order], of[order], w[order]
    pair = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1]))
    both = np.bincount(of[pair], weights=np.minimum(w[pair], w[pair + 1]), minlength=texts)
    return both / np.maximum(np.bincount(of, weights=w, minlength=texts) - both, 1e-12)


def _verify(steps: Broadcast, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            a, b = (shingles(*_bytes(batch, k)) for k in ("text_a", "text_b"))
            like = similarities(a, b, steps.value)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(like)], ["a", "b", "similarity"]).filter(pa.array(like >= threshold))

    return frugal(run)


def _texts(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """node and text of the nodes asked for. Ids up to MOST_BROADCAST are broadcast, so that no other text moves; beyond
    that the join shuffles."""
    asked = stored(asked, "nd-asked")
    few = F.broadcast(asked) if asked.count() <= MOST_BROADCAST else asked
    own = stored(texts.join(few, "node", "left_semi"), "nd-texts")
    drop(asked)
    return own


def _links(pairs: DataFrame, texts: DataFrame, steps: Broadcast, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose texts are similar. Only texts in pairs are moved."""
    own = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), texts)
    one = own.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = own.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    links = stored(both.mapInArrow(_verify(steps, threshold), "a long, b long, similarity double").select("a", "b"), "nd-links")
    drop(own)
    return links


def _across(steps: Broadcast, threshold: float):
    """Rows come sorted by bucket and block pair (p, q). Links between members of different components: of one block if p
    and q are the same, else between the two. A pair that shares several buckets is compared in that of its first band.
    The lesser total weight over the greater bounds the similarity from above, so that only pairs within it are compared;
    all of these are, on whole texts."""

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        node, comp, blk = table["node"].to_numpy(), table["component"].to_numpy().copy(), table["blk"].to_numpy()
        band, cross = table["band"][0].as_py(), table["p"][0].as_py() != table["q"][0].as_py()
        bands = pa.concat_arrays(table["bands"].chunks).flatten().to_numpy().reshape(len(node), BANDS)
        s = shingles(*_bytes(pa.RecordBatch.from_arrays([pa.concat_arrays(table["text"].chunks)], ["text"]), "text"))
        w = weights(s, steps.value)
        total, count = np.add.reduceat(w, s.starts[:-1]), np.diff(s.starts)
        order = np.argsort(total, kind="stable")
        sizes = total[order]
        words, word = np.unique(s.hash, return_inverse=True)
        own_w = np.zeros(len(words))
        for r, i in enumerate(order.tolist()):
            # Each pair once, from its lighter text. A part in 10^9 allows for rounding.
            other = order[r + 1 : int(np.searchsorted(sizes, sizes[r] / threshold * (1 + 1e-9), "right"))]
            other = other[comp[other] != comp[i]]
            if cross:
                other = other[blk[other] != blk[i]]
            other = other[(bands[other] == bands[i]).argmax(1) == band]
            if not len(other):
                continue
            mine = slice(s.starts[i], s.starts[i + 1])
            own_w[word[mine]] = w[mine]
            ends = np.cumsum(count[other])
            at = np.arange(ends[-1]) + np.repeat(s.starts[other] - (ends - count[other]), count[other])
            both = np.add.reduceat(np.minimum(w[at], own_w[word[at]]), ends - count[other])
            own_w[word[mine]] = 0
            hit = other[both / (total[i] + total[other] - both) >= threshold]
            for j in hit:
                comp[comp == comp[j]] = comp[i]
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[hit])), pa.array(np.maximum(node[i], node[hit]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch[k].to_numpy() for k in ("bucket", "p", "q")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if last != (key := tuple(keys[:, a].tolist())) and held:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield from compare(pa.Table.from_batches(held))

    return frugal(run)


def _open(shared: DataFrame, same: DataFrame) -> DataFrame:
    """bucket, band, node, bytes and component, and the bucket's size and bytes held, of the buckets of more than two that lie in several components."""
    own = shared.where("n > 2").select("bucket", "band", "node", "bytes").join(same, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum("bytes").alias("held")).where("lo <> hi").select("bucket", "size", "held")
    return own.join(spans, "bucket")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node (doc_id, or a number from 2^62 that the text gives), t1 and t2 (the text's hashes), text as bytes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**61)))
    return pick(docs, doc_id=id_col, text=text_col).select("doc_id", own.alias("node"), F.xxhash64(F.lit(0), text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.cast("binary").alias("text"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id of its class), n_class (rows in the class).

    Texts are near duplicates if the weighted Jaccard similarity of their TF-IDF shingles of five words (the sum of the
    lesser weights over that of the greater ones) is `threshold` or more. Frequencies enter whole, by 1 + their logarithm,
    so that a passage which one text repeats often parts it little from the other, while a text isn't a near duplicate of
    itself written twice; classes are the connected components of that relation and of equality.

    1. A sketch of document frequencies from all documents (see idf_steps) gives each shingle its weight.
    2. 126 consistent weighted samples of each text make 21 band hashes of 6. Exact copies collapse by text hash first.
    3. In each bucket (band hash) every member is paired with the member that has most copies; pairs are verified on
       whole texts, and verified links make components. Where a bucket's members still lie in different components, they
       are paired with a member picked by hash, and at last each pair across components is verified too, within the
       bucket, in pairs of blocks of at most 2,048 texts and about 2 MB, without making a row for each pair. No pair that
       shares a bucket is left out but those already connected and those whose total weights rule the similarity out;
       nothing is capped, and groups of thousands of copies cost a few links a copy.

    Buckets meet by pre-aggregated minima and plain equi-joins, which AQE splits where one is hot. Texts without a word
    are alike only if they are equal. A null text is an empty one. Rows that share a doc_id share a class; a null doc_id
    stands by its text alone, and a class of such rows only has a class_id from 2^62. Empty tables give empty results;
    other columns are ignored.
    """
    _, marks, members = _classes(docs, id_col, text_col, threshold)
    drop(marks)
    size = members.groupBy("class_id").agg(F.sum("n").alias("n_class"))
    per_text = members.join(size, "class_id").select("t1", "t2", "class_id", "n_class")
    own = _rows(docs, id_col, text_col).select("doc_id", "t1", "t2")
    return own.join(per_text, ["t1", "t2"]).select("doc_id", "class_id", "n_class")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = _rows(docs, id_col, text_col)
    steps = spark.sparkContext.broadcast(idf_steps(rows.select("text")))
    marks = stored(rows.select("node", "t1", "t2", "text").mapInArrow(_signatures(steps), "node long, t1 long, t2 long, bytes int, bands array<long>"), "nd-marks")
    exact = marks.groupBy("t1", "t2").agg(F.min("node").alias("node"), F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.first("bands").alias("bands"))
    exact = stored(exact, "nd-exact")
    member = exact.select(F.posexplode("bands").alias("band", "bucket"), "node", "bytes", F.col("n").alias("copies"))
    # The first leader of a bucket is the text with most copies, which is likely to be in the middle of its group.
    buckets = member.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("node")).alias("minus"))).alias("top"), F.count("*").alias("n")).where("n > 1").select("bucket", (-F.col("top.minus")).alias("leader"), "n")
    shared = stored(member.join(buckets, "bucket").drop("copies"), "nd-buckets")
    texts = rows.select("node", "text")
    ordered = [F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")]
    pairs = stored(shared.where("leader <> node").select(*ordered).distinct(), "nd-pairs")
    links = _links(pairs, texts, steps, threshold)
    same = components(links)
    # Buckets of two are done. Larger ones that still span components need their other pairs: first with one member,
    # another in each bucket, which leaves few buckets open, then all pairs across components.
    open_ = _open(shared, same)
    leader = open_.groupBy("bucket").agg(F.min_by(F.struct(F.col("node").alias("leader"), F.col("component").alias("other")), F.xxhash64("bucket", "node")).alias("x")).select("bucket", "x.*")
    more = stored(open_.join(leader, "bucket").where("component <> other").select(*ordered).distinct().join(pairs, ["a", "b"], "left_anti"), "nd-more")
    if more.limit(1).count():
        links, was = stored(links.unionByName(_links(more, texts, steps, threshold)), "nd-links"), links
        drop(was)
        same = components(links)
        open_ = _open(shared, same)
    drop(pairs, more)
    # Open buckets are compared whether or not their second leaders gave pairs: a leader may be the first one again.
    rest = stored(open_, "nd-open")
    if rest.limit(1).count():
        blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("held") / BLOCK_BYTES)).cast("int")
        dealt = rest.withColumn("blk", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        found = _texts(rest.select("node").distinct(), texts)
        own = found.join(exact.select("node", "bands").dropDuplicates(["node"]), "node")
        dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with")).select("bucket", "band", "node", "component", "blk", F.least("blk", "with").alias("p"), F.greatest("blk", "with").alias("q"))
        dealt = dealt.join(own, "node").repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "blk", "node")
        links, was = stored(links.unionByName(dealt.mapInArrow(_across(steps, threshold), "a long, b long")), "nd-links"), links
        drop(was, found)
        same = components(links)
    members = exact.select("t1", "t2", "node", "n").join(same, "node", "left").select("t1", "t2", "node", "n", F.coalesce("component", "node").alias("class_id"))
    members = stored(members, "nd-members")
    drop(exact, shared, links, rest)
    steps.unpersist()
    return rows, marks, members


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """docs with one row of each class (see classes): the row of its smallest doc_id, whole. Of rows that repeat that
    doc_id, one stays; of rows with a null doc_id, one of each text that no other row's class has."""
    names = docs.columns
    _, marks, members = _classes(docs, id_col, text_col, threshold)
    keep = members.where("node = class_id").select(F.col("node").alias("_node"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    repeated = marks.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    rows, unpack = packed(docs)
    text = F.coalesce(F.col("_row")[f"_in{names.index(text_col)}"], F.lit(""))
    doc_id = F.col("_row")[f"_in{names.index(id_col)}"].cast("long")
    rows = rows.select("_row", F.coalesce(doc_id, F.lit(2**62) + F.pmod(F.xxhash64(text), F.lit(2**61))).alias("node"), F.xxhash64(F.lit(0), text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))
    kept = rows.join(keep, (F.col("node") == F.col("_node")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left_semi")
    return unpack(kept.dropDuplicates(["node"]) if repeated else kept)
