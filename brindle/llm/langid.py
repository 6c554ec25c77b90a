"""Language ID: each document is a mixture of languages, fitted by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, packed, pick, slices, small_batches

#: Byte n-grams are hashed into 2^BITS bins; a model holds one float for each bin and language.
BITS = 14
BINS = 1 << BITS
#: Documents that are told apart at once; their bins are counted in one array.
CHUNK = 64
#: Bytes whose n-grams are listed at once, so that the length of a text doesn't matter.
WINDOW = 1 << 18
#: Languages of a model, 64 KB each; of more, those with most n-grams.
MAX_LANGUAGES = 512


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    languages: list[str]
    ratio: np.ndarray  # float32, bins x languages: likelihoods over the largest of the bin


def _bytes(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value begins and the last ends."""
    values = batch[column].cast(pa.large_binary())
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def grams(data: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins of the byte bigrams and trigrams that begin among the first n bytes, and the text each belongs to (of: the
    text of each byte). ASCII capitals count as small letters; other ASCII bytes that are no letters, as one space."""
    x = _FOLD[data]
    mix = lambda v: ((v * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int32)
    two, three = (x[:-1] << 8 | x[1:])[:n], (x[:-2] << 16 | x[1:-1] << 8 | x[2:])[:n]
    # Runs of spaces say nothing.
    same2 = (of[:-1] == of[1:])[:n] & (two != 0x2020)
    same3 = (of[:-2] == of[2:])[:n] & ((three & 0xFFFF) != 0x2020)
    return np.concatenate([mix(two + np.uint32(1 << 25))[same2], mix(three)[same3]]), np.concatenate([of[: len(same2)][same2], of[: len(same3)][same3]])


def gram_table(data: np.ndarray, ends: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Counts of n-grams by group of texts (group: of each text) and bin, a window of the data at a time."""
    counts = np.zeros(groups * BINS, np.int64)
    for at in range(0, len(data), WINDOW):
        lo, hi = np.searchsorted(ends, [at, min(at + WINDOW + 2, len(data))], "right")
        cut = np.clip(ends[lo - 1 : hi + 1], at, min(at + WINDOW + 2, len(data)))
        of = np.repeat(np.arange(lo - 1, lo - 1 + len(cut) - 1, dtype=np.int32), np.diff(cut))
        bins, text = grams(data[at : at + WINDOW + 2], of, WINDOW)
        counts += np.bincount(group[text] * BINS + bins, minlength=groups * BINS)
    return counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language of this task: its n-gram counts, compressed."""
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        codes = batch["lang"].dictionary_encode()
        names = codes.dictionary.to_pylist()
        lang = codes.indices.to_numpy(zero_copy_only=False)
        got = gram_table(*_bytes(batch, "text"), lang.astype(np.int64), len(names)).reshape(-1, BINS)
        for k, name in enumerate(names):
            held[name] = held[name] + got[k] if name in held else got[k].copy()
    for name, counts in held.items():
        yield pa.RecordBatch.from_pylist([{"lang": name, "total": int(counts.sum()), "counts": zlib.compress(counts.astype("<i8").tobytes(), 1)}])



def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, counts in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(counts), "<i8")
            held[name] = held[name] + got if name in held else got.copy()
    for name, counts in held.items():
        yield pa.RecordBatch.from_pylist([{"lang": name, "total": int(counts.sum()), "counts": zlib.compress(counts.tobytes(), 1)}])


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", smooth: float = 0.5, spread: int = 16, most: int = MAX_LANGUAGES) -> Model:
    """Counts the n-grams of every row with a text and a language, by language. Tasks add up their own counts; the sums
    meet in two steps, first dealt by `spread` salts, then by language, always one array at a time. What reaches the
    driver is one array of 2^14 counts a language, for `most` languages at most: where there are more, those with most
    n-grams are learned (ties to the smaller name), and texts in others are read as the nearest of these."""
    rows = pick(labelled, lang=lang_col, text=text_col).dropna().select("lang", F.col("text").cast("binary").alias("text"))
    small_batches(rows.sparkSession)
    kind = "lang string, total long, counts binary"
    part = rows.mapInArrow(frugal(_count), kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
    part = part.repartition(spread, "salt").select("lang", "total", "counts").mapInArrow(frugal(_add), kind)
    got = part.repartition(spread, "lang").mapInArrow(frugal(_add), kind).orderBy(F.col("total").desc(), "lang").limit(most).collect()
    got = sorted(got, key=lambda r: r["lang"])
    if not got:
        return Model([], np.zeros((BINS, 0), np.float32))
    counts = np.stack([np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in got], 1).astype(np.float64)
    log_p = np.log(counts + smooth) - np.log(counts.sum(0) + smooth * BINS)
    return Model([r["lang"] for r in got], np.maximum(np.exp(log_p - log_p.max(1, keepdims=True)), 1e-9).astype(np.float32))


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, of: np.ndarray, pi: np.ndarray, rounds: int) -> np.ndarray:
    """Mixture proportions of each text after some rounds. p: likelihoods of the texts' distinct n-grams by language, n:
    how often each occurs, starts: each text's first, of: the text of each."""
    total = np.add.reduceat(n, starts)[:, None]
    for _ in range(rounds):
        joint = p * pi[of]
        joint *= (n / np.maximum(np.einsum("ij->i", joint), np.float32(1e-20)))[:, None]
        pi = np.add.reduceat(joint, starts, axis=0) / total
    return pi


def _likelihood(p: np.ndarray, n: np.ndarray, starts: np.ndarray, of: np.ndarray, pi: np.ndarray) -> np.ndarray:
    return np.add.reduceat((n * np.log(np.maximum(np.einsum("ij,ij->i", p, pi[of]), np.float32(1e-20)))).astype(np.float64), starts)


def infer(model: Model, data: np.ndarray, ends: np.ndarray, *, rounds: int = 6, least: float = 0.02, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """For each text: proportions (texts x languages, 0 outside the chosen set), and whether it has n-grams. The largest
    proportions of a fit over all languages name nested sets of one language and more; languages below `least` join no
    set, so that there are 1 / `least` sets at most. Each set is fitted anew, and the set with the best penalised likelihood, `penalty` * log(n-grams) a language, is
    chosen."""
    texts, langs = len(ends) - 1, len(model.languages)
    share, seen = np.zeros((texts, langs), np.float32), np.zeros(texts, bool)
    at = 0
    while at < texts and langs:
        # A chunk has a bounded number of texts and, but for a single long text, of bytes.
        to = max(at + 1, min(at + CHUNK, texts, int(np.searchsorted(ends, ends[at] + (1 << 20)))))
        counts = gram_table(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], np.arange(to - at), to - at)
        cell = np.flatnonzero(counts)
        if len(cell):
            text, n = cell >> BITS, counts[cell].astype(np.float32)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            own = text[starts]
            of = np.repeat(np.arange(len(own)), np.diff(np.append(starts, len(cell))))
            p = model.ratio[cell & (BINS - 1)]
            pi = _em(p, n, starts, of, np.full((len(own), langs), 1 / langs, np.float32), rounds)
            order = np.argsort(-pi, axis=1, kind="stable")
            cost = penalty * np.log(np.maximum(np.add.reduceat(n, starts), 2))
            choice = np.zeros_like(pi)
            np.put_along_axis(choice, order[:, :1], 1, 1)
            best = _likelihood(p, n, starts, of, choice) - cost
            for k in range(2, langs + 1):
                wide = np.flatnonzero(np.take_along_axis(pi, order[:, k - 1 : k], 1)[:, 0] >= least)
                if not len(wide):
                    break
                some = np.isin(of, wide)
                of_wide = np.searchsorted(wide, of[some])
                part = (p[some], n[some], np.searchsorted(of_wide, np.arange(len(wide))), of_wide)
                start = np.zeros((len(wide), langs), np.float32)
                np.put_along_axis(start, order[wide, :k], np.take_along_axis(pi[wide], order[wide, :k], 1), 1)
                fitted = _em(*part, start / start.sum(1, keepdims=True), rounds)
                value = _likelihood(*part, fitted) - k * cost[wide]
                better = value > best[wide]
                best[wide[better]], choice[wide[better]] = value[better], fitted[better]
            share[at + own], seen[at + own] = choice, True
        at = to
    return share, seen


def _padded(texts: pa.Array) -> pa.Array:
    """A text of one byte has no n-gram: it gets a space at both ends. All others stay."""
    space, none = pa.scalar(b" ", texts.type), pa.scalar(b"", texts.type)
    return pc.if_else(pc.equal(pc.binary_length(texts), 1), pc.binary_join_element_wise(space, texts, space, none), texts)


def _predictor(learned: Broadcast, text: str | None = None):
    """text: the field of _row that has the text; else it is a column of its own."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = learned.value
        for batch in slices(batches, 2 << 20):
            values = batch if text is None else pa.RecordBatch.from_arrays([pc.fill_null(pc.struct_field(batch["_row"], text), "").cast(pa.binary())], ["text"])
            values = pa.RecordBatch.from_arrays([_padded(values["text"])], ["text"])
            share, seen = infer(model, *_bytes(values, "text"))
            ok = seen & batch["letters"].to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            top = share.argmax(1) if model.languages else np.zeros(len(share), int)
            names = [model.languages[k] if y else "und" for k, y in zip(top, ok, strict=True)]
            score = np.where(ok, share[np.arange(len(share)), top] if model.languages else 0.0, 0.0).astype(np.float64)
            mix = [",".join(f"{model.languages[k]}:{row[k]:.3f}" for k in np.argsort(-row, kind="stable") if row[k] > 0) if y else "" for row, y in zip(share, ok, strict=True)]
            rest = [batch.column(k) for k, name in enumerate(batch.schema.names) if name not in ("text", "letters")]
            kept = [name for name in batch.schema.names if name not in ("text", "letters")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mix, pa.string())], [*kept, "lang_pred", "score", "mixture"])

    return frugal(predict)


def _sent(docs: DataFrame, model: Model) -> Broadcast:
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model)


def _letters(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters")


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score (the proportion of lang_pred), mixture (language:share,...).

    lang_pred is the language with the largest proportion in the chosen set, ties to the smaller name; und with score 0
    if the text is null or has no letter, or nothing was learned. Texts are judged whole, in batches of bounded memory
    and without a shuffle; null or repeated ids and repeated rows are judged each by itself; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("doc_id").schema)
    return rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), _letters(F.col("text"))).mapInArrow(_predictor(_sent(docs, model)), f"{out}, lang_pred string, score double, mixture string")


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is in no language (null, without a letter), also where nothing was learned. All
    columns stay, whatever their names; repeated rows are judged each by itself, and an empty table gives an empty one."""
    rows, unpack = packed(docs)
    at = f"_in{docs.columns.index(text_col)}"
    if not model.languages:
        return unpack(rows.where(_letters(F.col("_row")[at])))
    kind = rows.select("_row").schema[0].dataType.simpleString()
    out = rows.select("_row", _letters(F.col("_row")[at])).mapInArrow(_predictor(_sent(docs, model), at), f"_row {kind}, lang_pred string, score double, mixture string")
    return unpack(out.where(F.col("lang_pred") != "und").select("_row"))
