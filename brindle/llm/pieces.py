"""SentencePiece encoding and decoding: piece occurrences from a suffix array, relaxed from left to right."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, packed, pick, slices, small_batches

BAR, END = "▁", 0xFF
START, NONE = -1, -2
UNIT = re.compile(f"{BAR}*[^{BAR}]+|{BAR}+")
#: Characters of new units that are encoded together, and bytes of a long unit whose suffixes are sorted at once; units
#: and tokens that are remembered at most; odd characters likewise; slots for pairs of pieces whose fit is known.
PORTION, REMEMBERED, TOKENS, ODD, SLOTS = 1 << 16, 300_000, 4_000_000, 50_000, 1 << 20


class Coder:
    """Encodes and decodes with a BPE model that has byte fallback, keeps the text as it is (identity normalisation) and
    adds a dummy prefix; anything else raises ValueError.

    Encoding: a text's units (a run of bars and what follows it up to the next bar; no piece crosses their borders) are
    concatenated, the suffixes of that text are sorted (by eight bytes; longer pieces are compared in full within their
    range), and a binary search for every piece gives the range of its occurrences. These edges, sorted by position, are
    relaxed from left to right, in all units at once: an edge for piece t from i to j is
    taken if the last piece t' before i is compatible with it, that is, if merging the text of t' and t on its own
    yields t' and t. For byte-pair merges in order of score exactly one edge into each position is taken, and the edges
    that lead to a unit's end are its encoding.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bytes_id = {}
        self.pieces: list[str] = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.bytes_id) != 256 or sp.normalize("  a\n ﬁ ") != f"{BAR}{BAR}{BAR}a\n{BAR}ﬁ{BAR}" and sp.normalize("  a\n ﬁ ") != f"{BAR}{BAR}a\n{BAR}ﬁ{BAR}" or sp.encode("a") != sp.encode("a", add_bos=False) or any(re.search(f"[^{BAR}]{BAR}", self.pieces[i]) for i in plain):
            raise ValueError("a model with byte fallback, identity normalisation and pieces within words is needed")
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.ids = {self.pieces[i]: i for i in plain}
        self.n = n
        coded = sorted((self.pieces[i].encode(), i) for i in plain)
        self.width = -(-max(len(b) for b, _ in coded) // 8) * 8
        self.piece_at = np.array([i for _, i in coded])
        self.piece_len = np.array([len(b) for b, _ in coded])
        words = lambda fill: np.frombuffer(b"".join(b.ljust(self.width, fill) for b, _ in coded), ">u8").reshape(-1, self.width // 8).astype(np.uint64)
        self.low, self.high = words(b"\0"), words(b"\xff")
        self.fits: dict[int, bool] = {}
        self.odd: dict[str, int] = {}  # characters that aren't pieces, numbered from n
        self.odd_text: list[str] = []
        self.forget()
        surface = [p.replace(BAR, " ").encode() for p in self.pieces]
        for i in range(n):
            if sp.is_byte(i):
                surface[i] = bytes([int(self.pieces[i][3:5], 16)])
            elif sp.is_control(i):
                surface[i] = b""
            elif sp.is_unknown(i):
                surface[i] = " ⁇ ".encode()
        self.surface = surface

    # -------------------------------------------------------------- encoding

    def _text(self, t: int) -> str:
        return self.pieces[t] if t < self.n else self.odd_text[t - self.n]

    def _merged(self, parts: list[str]) -> list[str]:
        """Byte-pair merges of best score, leftmost first."""
        parts = list(parts)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def forget(self) -> None:
        """Drops the units; what is remembered is bounded, and forgetting it changes no result."""
        self.known: dict[str, int] = {}
        self.pool, self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = 0
        # Pairs of pieces are few and stay; odd characters are numbered in the order in which they come.
        if len(self.odd) > ODD or not hasattr(self, "slot_key"):
            self.odd.clear()
            self.odd_text.clear()
            self.fits.clear()
            self.slot_key, self.slot_fit = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    def _fit(self, key: int) -> bool:
        ok = self.fits.get(key)
        if ok is None:
            x, y = self._text(key >> 32), self._text(key & 0xFFFFFFFF)
            if len(self.fits) > SLOTS // 4:
                self.fits.clear()
            ok = self.fits[key] = self._merged([*(x + y)]) == [x, y]
        return ok

    def _all_fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces is compatible, from a table by hash; pairs that aren't in it are merged once."""
        key = before << 32 | after
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)
        ok = self.slot_fit[slot]
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            fit = np.fromiter(map(self._fit, new.tolist()), bool, len(new))
            ok[miss] = fit[back]
            slot = slot[miss]
            self.slot_key[slot], self.slot_fit[slot] = key[miss], ok[miss]
            # Where two pairs share a slot, key and fit must be of the same pair.
            wrong = self.slot_key[slot] == key[miss]
            self.slot_fit[slot[wrong]] = ok[miss][wrong]
        return ok

    def edges(self, text: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence of a piece in text, a byte array, in no order; only those that start
        before upto, if that is given."""
        wide = np.concatenate([text, np.full(self.width + 8, END, np.uint8)])
        word = lambda at: np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, 8)[at]).view(">u8").ravel().astype(np.uint64)
        long_ = self.piece_len > 8
        at = np.flatnonzero(((text[:upto] & 0xC0) != 0x80) & (text[:upto] != END))  # where characters begin
        keys = word(at)
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        low = np.searchsorted(keys, self.low[:, 0], "left")
        n = np.searchsorted(keys, self.high[:, 0], "right") - low
        hit = np.flatnonzero(n > 0)
        n = n[hit]
        ends = np.cumsum(n)
        start = at[np.arange(ends[-1] if len(ends) else 0) + np.repeat(low[hit] - (ends - n), n)]
        piece = np.repeat(hit, n)
        rest = np.flatnonzero(long_[piece])
        for k in range(1, self.width // 8):
            rest = rest[self.piece_len[piece[rest]] > 8 * k]
            got = word(start[rest] + 8 * k)
            bad = (got < self.low[piece[rest], k]) | (got > self.high[piece[rest], k])
            piece[rest[bad]] = -1
            rest = rest[~bad]
        ok = piece >= 0
        start, piece = start[ok], piece[ok]
        return start, start + self.piece_len[piece], self.piece_at[piece]

    def _with_odd(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray, upto: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The edges, and one for each character that is no piece."""
        first = np.flatnonzero(((text[:upto] & 0xC0) != 0x80) & (text[:upto] != END))
        stop = np.zeros(len(text) + 1, np.int64)
        lead = text[first]
        stop[first] = first + 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(text) + 1, bool)
        single[start[end == stop[start]]] = True
        bare = first[~single[first]]
        if not len(bare):
            return start, end, piece
        codes = []
        raw = text.tobytes()
        for s, e in zip(bare.tolist(), stop[bare].tolist(), strict=True):
            c = raw[s:e].decode()
            if c not in self.odd:
                self.odd[c] = self.n + len(self.odd_text)
                self.odd_text.append(c)
            codes.append(self.odd[c])
        return np.concatenate([start, bare]), np.concatenate([end, stop[bare]]), np.concatenate([piece, np.array(codes)])

    def _spelled(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Odd characters stand for their bytes."""
        if not (ids >= self.n).any():
            return ids, of
        split = [[t] if t < self.n else [self.bytes_id[x] for x in self.odd_text[t - self.n].encode()] for t in ids.tolist()]
        return np.array([t for x in split for t in x]), np.repeat(of, [len(x) for x in split])

    def _remember(self, units: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        have = len(self.known)
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.at) < have + len(units):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.at[have : have + len(units)] = self.used + np.cumsum(n) - n
        self.size[have : have + len(units)] = n
        self.used += len(ids)
        self.known.update(zip(units, range(have, have + len(units)), strict=True))

    def _learn_long(self, unit: str) -> None:
        """Encodes one long unit: edges come from a window of its bytes at a time, and are relaxed position by position.
        Only the last piece before each position and where it starts are held for the whole unit, 8 bytes a byte."""
        text = np.frombuffer((BAR + unit).encode(), np.uint8)
        last, since = np.full(len(text) + 1, NONE, np.int32), np.zeros(len(text) + 1, np.int32)
        last[0] = START
        ahead: dict[int, tuple[int, int]] = {0: (START, 0)}
        fit = self._fit
        for a in range(0, len(text), PORTION):
            upto = min(PORTION, len(text) - a)
            part = text[a : a + upto + self.width]
            start, end, piece = self._with_odd(part, *self.edges(part, upto), upto)
            order = np.argsort(start, kind="stable")
            start, end, piece = start[order], end[order], piece[order]
            cuts = np.append(np.flatnonzero(np.diff(start, prepend=-1)), len(start))
            places, ends, pieces, cuts = (start[cuts[:-1]] + a).tolist(), (end + a).tolist(), piece.tolist(), cuts.tolist()
            for i, at in enumerate(places):
                if at not in ahead:
                    continue
                before, from_ = ahead.pop(at)
                last[at], since[at] = before, from_
                for k in range(cuts[i], cuts[i + 1]):
                    if before == START or fit(before << 32 | pieces[k]):
                        ahead[ends[k]] = (pieces[k], at)
        last[len(text)], since[len(text)] = ahead[len(text)]
        ids = array("i")
        at = len(text)
        while at:
            ids.append(last[at])
            at = int(since[at])
        ids, _ = self._spelled(np.array(ids, np.int64)[::-1], np.zeros(len(ids), np.int64))
        self._remember([unit], ids, np.array([len(ids)]))

    def _learn(self, units: list[str]) -> None:
        """Encodes units, all of them at once, and remembers them."""
        coded = [(BAR + u).encode() for u in units]
        text = np.frombuffer(bytes([END]).join(coded) + bytes([END]), np.uint8)
        start, end, piece = self.edges(text)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        ends = np.cumsum(sizes + 1) - 1
        begins = ends - sizes
        start, end, piece = self._with_odd(text, start, end, piece)
        last, since = np.full(len(text) + 1, NONE, np.int64), np.zeros(len(text) + 1, np.int64)
        last[begins] = START
        # By place in the unit: whatever leads to a place comes before what starts there.
        place = start - np.repeat(begins, sizes + 1)[start]
        order = np.argsort(place << 40 | start)
        start, end, piece, place = start[order], end[order], piece[order], place[order]
        cuts = np.append(np.flatnonzero(np.diff(place, prepend=-1)), len(place))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            before = last[start[a:b]]
            on = np.flatnonzero(before != NONE) + a
            before, after = last[start[on]], piece[on]
            ok = before == START
            inner = np.flatnonzero(~ok)
            if len(inner):
                ok[inner] = self._all_fit(before[inner], after[inner])
            on = on[ok]
            last[end[on]], since[end[on]] = piece[on], start[on]
        # Back from the units' ends. An odd character stands for its bytes.
        steps, at, unit = [], ends.copy(), np.arange(len(units))
        while len(unit):
            steps.append((unit, last[at]))
            at = since[at]
            go = at > begins[unit]
            unit, at = unit[go], at[go]
        of = np.concatenate([u for u, _ in steps])
        ids = np.concatenate([t for _, t in steps])
        order = np.argsort(of << 32 | (len(steps) - np.repeat(np.arange(len(steps)), [len(u) for u, _ in steps])))
        of, ids = of[order], ids[order]
        ids, of = self._spelled(ids, of)
        self._remember(units, ids, np.bincount(of, minlength=len(units)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each text has."""
        flat: list[str] = []
        counts = []
        for t in texts:
            # Every unit begins with a bar, so units are known by what follows it. Words with one space between them, the
            # usual case, need no search.
            if not t:
                units = []
            elif "  " in t or BAR in t or t[0] == " " or t[-1] == " ":
                units = [u[1:] for u in UNIT.findall(BAR + t.replace(" ", BAR))]
            else:
                units = t.split(" ")
            flat += units
            counts.append(len(units))
        if len(self.known) > REMEMBERED or self.used > TOKENS:
            self.forget()
        new, held = [], 0
        for u in {*flat}.difference(self.known):
            if len(u) > PORTION:
                self._learn_long(u)
                continue
            new.append(u)
            held += len(u)
            if held >= PORTION:
                self._learn(new)
                new, held = [], 0
        if new:
            self._learn(new)
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        size = self.size[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.at[which] - (ends - size), size)] if total else np.zeros(0, np.int32)
        text_ends = np.concatenate([[0], ends])[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        return ids, np.diff(text_ends, prepend=0)

    # -------------------------------------------------------------- decoding

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, bars as spaces, without the dummy prefix; bytes that are no UTF-8 become U+FFFD."""
        get = self.surface.__getitem__
        text = b"".join([b"".join(map(get, ids[a : a + PORTION].tolist())) for a in range(0, len(ids), PORTION)]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_CODERS: dict[str, Coder] = {}


def coder(model: bytes) -> Coder:
    """One coder a process and model; what it remembers is bounded and doesn't change results."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODERS:
        _CODERS[key] = Coder(model)
    return _CODERS[key]


def read_model(path: str) -> bytes:
    """The model file, read by the driver and sent with the tasks: executors need no copy."""
    return Path(path).read_bytes()


def _strings(column: pa.Array) -> list[str]:
    return [x.decode(errors="replace") for x in column.to_pylist()]


def _mapper(model: Broadcast, keep: str, text: str | None = None):
    """keep: the column that stays; text: the field of it that has the text, else the text is a column of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model.value)
        # Token ids take more room than texts, so batches are small.
        for batch in slices(batches, 1 << 20):
            values = batch["text"] if text is None else pc.fill_null(pc.struct_field(batch[keep], text), "").cast(pa.binary())
            raw = values.to_pylist()
            coded, sizes = own.encode(_strings(values))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            back = [own.decode(coded[a:b]).encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            arrays = [batch[keep], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(coded, pa.int32())), pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([a == b for a, b in zip(raw, back, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [keep, "n_tokens", "ids", "decoded_sha256", "lossless"])
        own.forget()

    return frugal(run)


def _sent(docs: DataFrame, model: bytes) -> Broadcast:
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(model)


def encode_texts(docs: DataFrame, model: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids, decoded_sha256 (of the ids decoded again) and lossless
    (whether that is the text).

    Whole texts are encoded, in batches of bounded memory (a batch's distinct new units are indexed in portions; a long
    unit's suffixes as well, so that 5 MB without a space take some 250 MB) and without a shuffle; the ids are those of the SentencePiece library. A text with U+2581 is
    read as if that were a space, and isn't lossless. Null and empty texts have no tokens and decode to the empty text.
    Null or repeated ids and repeated rows are judged each by itself; other columns are ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_mapper(_sent(docs, model), "doc_id"), f"doc_id {kind}, n_tokens long, ids array<int>, decoded_sha256 string, lossless boolean")


def decode_ids(rows: DataFrame, model: bytes, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null ids give an empty text, ids outside the vocabulary raise ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in slices(batches):
            texts = []
            for ids in batch["ids"].to_pylist():
                if ids and (min(ids) < 0 or max(ids) >= own.n):
                    raise ValueError("an id is outside the vocabulary")
                texts.append(own.decode(np.array(ids or [], np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    src = pick(rows, doc_id=id_col, ids=ids_col).select("doc_id", F.filter("ids", lambda x: x.isNotNull()).alias("ids"))
    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def encode_columns(docs: DataFrame, model: bytes, *, text_col: str = "text") -> DataFrame:
    """docs with all columns and n_tokens, ids, decoded_sha256 and lossless; such columns of docs are replaced. Nulls, odd
    texts, repeated rows and empty tables as with encode_texts."""
    made = ("n_tokens", "ids", "decoded_sha256", "lossless")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in made])
    rows, _ = packed(docs)
    names = docs.columns
    text = f"_in{names.index(text_col)}"
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_mapper(_sent(docs, model), "_row", text), f"_row {kind}, n_tokens long, ids array<int>, decoded_sha256 string, lossless boolean")
    return out.select(*[F.col("_row")[f"_in{i}"].alias(f"_out{i}") for i in range(len(names))], *made).toDF(*names, *made)
