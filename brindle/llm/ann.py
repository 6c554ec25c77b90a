"""Approximate nearest neighbours by a permutation index with pivot inverted files."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import frugal, pick, slices, small_batches, stored

HITS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, *, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (doubles) of the rows that take part, one a vec_id: null ids, null, empty or zero vectors and those
    with null or non-finite components don't; of several rows of an id, the smallest vector stays."""
    rows = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    rows = column.combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0) if rows.num_chunks else pa.array([], pa.list_(pa.float64()))
    n = np.diff(rows.offsets.to_numpy()) if len(rows) else np.zeros(0, int)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if (n == dim).all():
        return flat.reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    out[np.repeat(np.arange(len(rows)), n), np.concatenate([np.arange(k) for k in n])] = flat
    return out


def _lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their lengths; those whose squares would leave the range of doubles are scaled first, by a power of 2."""
    most = np.abs(x).max(1)
    odd = (most > 1e150) | (most < 1e-150)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(most[odd])[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def permutations(x: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """The `near` nearest pivots of each vector (unit pivots; largest cosine), nearest first, ties to the earlier pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :near]


class Segment:
    """An index of some vectors: for each pivot, the rows that have it among their nearest, with its place in them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, near: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.pivots, self.near = ids[order], pivots, near
        self.x, self.size = _lengths(x[order])
        perm = permutations(self.x / self.size[:, None], pivots, near)
        by = np.argsort(perm, axis=None, kind="stable")
        rows, places = np.divmod(by, perm.shape[1])
        ends = np.searchsorted(perm.ravel()[by], np.arange(len(pivots) + 1))
        self.posts = [(rows[a:b], places[a:b].astype(np.float64)) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def search(self, own: int, q: np.ndarray, size: float, perm: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows (largest cosine, ties to smaller ids) of the `share` with the smallest footrule distance."""
        at = np.concatenate([self.posts[p][0] for p in perm])
        gain = np.concatenate([self.near - i - np.abs(self.posts[p][1] - i) for i, p in enumerate(perm)])
        # Footrule over the query's pivots, a pivot that a row lacks counting as place `near`: less gain, more distance.
        rank = -np.bincount(at, weights=gain, minlength=len(self.ids)) * len(self.ids) + np.arange(len(self.ids))
        most = min(len(rank), max(k + 1, math.ceil(share * len(rank))))
        rows = np.argpartition(rank, most - 1)[:most] if most < len(rank) else np.arange(len(rank))
        rows = rows[self.ids[rows] != own]
        score = (self.x[rows] * q).sum(1) / (self.size[rows] * size)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows][best], score[best]


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and unit vectors of a batch."""
    x = _matrix(pa.chunked_array([batch["v"]]), dim)
    scaled, size = _lengths(x)
    return batch["vec_id"].to_numpy(), x, scaled / size[:, None]


def _ordered(base: Broadcast, dim: int, most: int, rows_in: dict[int, int] | None = None, least: int = 0):
    """Adds to each vector the `most` nearest leading pivots, nearest first; with rows_in, as many more as have `least`
    vectors in their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            order = permutations(_vectors(batch, dim)[2], base.value, len(base.value)).astype(np.int32)
            n = np.full(len(order), most)
            if rows_in is not None:
                held = np.array([rows_in.get(c, 0) for c in range(len(base.value))])
                n = np.maximum(n, (np.cumsum(held[order], axis=1) < least).sum(1) + 1)
            n = np.minimum(n, order.shape[1])
            flat = order[np.arange(order.shape[1])[None, :] < n[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists], ["vec_id", "v", "cells"])

    return frugal(run)


def _true_ranks(asked: Broadcast, dim: int, k: int):
    """For each sampled query (id, unit vector, ranks of the cells) the task's k nearest vectors: score, and their cell's
    rank in the query's order of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, ranks = asked.value
        best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        for batch in slices(batches):
            vec_id, _, x = _vectors(batch, dim)
            cell = batch["cell"].to_numpy()
            scores = x @ q.T
            for i, own in enumerate(ids):
                score = np.where(vec_id == own, -np.inf, scores[:, i])
                top = np.argpartition(-score, min(k, len(score)) - 1)[:k]
                score, found, rank = (np.concatenate(z) for z in zip(best[i], (score[top], vec_id[top], ranks[i][cell[top]]), strict=True))
                few = np.lexsort((found, -score))[:k]
                best[i] = (score[few], found[few], rank[few])
        for own, (score, found, rank) in zip(ids, best, strict=True):
            some = np.isfinite(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), own)), pa.array(score[some]), pa.array(found[some]), pa.array(rank[some])], ["query_id", "score", "vec_id", "rank"])

    return frugal(run)


def _probes(cells: DataFrame, asked: DataFrame, base: np.ndarray, dim: int, k: int, sampled: int, caught: float) -> int:
    """How many cells a query must look into to hold a share `caught` of its true k nearest, measured by brute force over
    all vectors for the `sampled` queries with the smallest hashes; all cells if there is no query."""
    spark = cells.sparkSession
    rows = asked.orderBy(F.xxhash64(F.lit(9), "vec_id"), "vec_id").limit(sampled).select("vec_id", "v").collect()
    if not rows:
        return len(base)
    q = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        q[i, : len(r["v"])] = r["v"]
    q, size = _lengths(q)
    q = q / size[:, None]
    order = permutations(q, base, len(base))
    ranks = np.zeros_like(order)
    np.put_along_axis(ranks, order, np.arange(len(base))[None, :], 1)
    sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows]), q, ranks))
    near = cells.mapInArrow(_true_ranks(sent, dim, k), "query_id long, score double, vec_id long, rank long")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    found = np.sort([r["rank"] for r in near.withColumn("place", place).where(F.col("place") <= k).select("rank").collect()])  # sampled x k at most
    return int(found[max(0, math.ceil(caught * len(found)) - 1)]) + 1 if len(found) else len(base)


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, pivots: int = 256, near: int = 64, share: float = 0.7, caught: float = 0.985, sampled: int = 128, segment_rows: int = 4096, query_rows: int = 8192, cell_rows: int = 1024, least_cells: int = 32) -> DataFrame:
    """The k nearest by cosine of each query (vec_id divisible by `every`): query_id, rank (from 1), vec_id, score.

    Pivots are the vectors with the `pivots` smallest hashes of their ids, a bounded sample; nothing else is sampled for
    the index, and every vector is indexed. A vector is represented by its `near` nearest pivots in order, and is dealt to
    the cell of the nearest of the leading pivots (one for `cell_rows` vectors, `least_cells` to `pivots` in all). Cells are
    cut by a hash of the id into segments of about `segment_rows`, and the queries that look into a cell into blocks of
    `query_rows`, so that a cell which holds a third of all vectors is many small tasks.

    A query looks into the cells of its nearest leading pivots only. Their number is measured, not set: for `sampled`
    queries the true neighbours are found by brute force, and as many cells are probed as hold a share `caught` of them.
    Vectors that lie in groups need few cells, so that work stays far below the square; vectors without structure need
    most of them. In each segment a task builds the pivot inverted files, sums up footrule distances from the lists of the
    query's pivots, reranks the `share` of the segment with the smallest footrule by the exact cosine of the original
    vectors in double precision, and returns its k best, from which the k best of all follow. A task holds one segment and
    one block, whatever the input's size.

    See usable() for rows that take no part and for repeated ids. Vectors of different lengths are compared as if the
    shorter ended in zeros. A query never finds its own id. Cells are added until they hold 4 x k vectors, or all, so
    that a query finds k, or all candidates if there are fewer. Equal vectors
    have equal scores, ties go to the smaller vec_id. Empty tables give empty results; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = stored(usable(vectors, id_col=id_col, vector_col=vector_col), "vectors")
    facts = own.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    n, dim = facts["n"], facts["dim"] or 1
    sample = own.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(pivots).select("v").collect()
    base = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        base[i, : len(r["v"])] = r["v"]
    _, first = np.unique(base, axis=0, return_index=True)
    base = base[np.sort(first)]
    if len(base):
        x, size = _lengths(base)
        base = x / size[:, None]
    near = min(near, len(base))
    lead = base[: max(1, min(pivots, max(least_cells, math.ceil(n / cell_rows))))]
    leading = spark.sparkContext.broadcast(lead)
    kind = "vec_id long, v array<double>, cells array<int>"
    cells = stored(own.mapInArrow(_ordered(leading, dim, 1), kind).select("vec_id", "v", F.col("cells")[0].alias("cell")), "cells")
    asked = own.where(F.pmod("vec_id", F.lit(every)) == 0)
    probes = len(lead) if n * share <= 4 * k else _probes(cells, asked, lead, dim, k, sampled, caught)
    # A row a cell: pivots at most.
    rows_in = {r["cell"]: r["n"] for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asked = stored(asked.mapInArrow(_ordered(leading, dim, max(1, probes), rows_in, 4 * k), kind), "asked")
    asked_in = {r["cell"]: r["n"] for r in asked.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = [(c, math.ceil(m / segment_rows), math.ceil(asked_in[c] / query_rows)) for c, m in sorted(rows_in.items()) if c in asked_in]
    shape = F.broadcast(spark.createDataFrame(sizes, "cell int, parts int, blocks int"))

    def find(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if index.num_rows and asked.num_rows:
            segment = Segment(index["vec_id"].to_numpy(), _matrix(index["v"], dim), base, near)
            q, size = _lengths(_matrix(asked["v"], dim))
            perm = permutations(q / size[:, None], base, near)
            for i, query in enumerate(asked["vec_id"].to_numpy()):
                ids, score = segment.search(query, q[i], size[i], perm[i], k, share)
                out["query_id"].append(np.full(len(ids), query))
                out["vec_id"].append(ids)
                out["score"].append(score)
        join = lambda a, kind: np.concatenate(a).astype(kind) if a else np.zeros(0, kind)
        return pa.table({"query_id": join(out["query_id"], np.int64), "vec_id": join(out["vec_id"], np.int64), "score": join(out["score"], np.float64)})

    key = ["cell", "part", "block"]
    every_one = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda seed, c: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(c)).cast("int")
    index = cells.join(shape, "cell").select("cell", dealt(5, "parts").alias("part"), every_one("blocks").alias("block"), "vec_id", "v")
    asked = asked.select("vec_id", "v", F.explode("cells").alias("cell")).join(shape, "cell").select("cell", every_one("parts").alias("part"), dealt(7, "blocks").alias("block"), "vec_id", "v")
    hits = index.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(find, HITS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
