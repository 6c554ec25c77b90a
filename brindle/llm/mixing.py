"""Mixing sources to target weights: a hypergeometric splitting tree deals blocks of the sources to output shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import packed, pick, stored

#: The weights that sources get in turn, and how often a source may be repeated at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words are runs of characters other than \x20 and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A source is dealt in so many blocks; a block that is taken in part is cut at one of so many bins.
BLOCKS, BINS = 64, 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (doc_id, source, text) with size, block and bin: a permutation of each source, from a hash of the row."""
    spot = F.xxhash64(F.lit(seed), "doc_id", "source", F.xxhash64("text"))
    return rows.withColumns({"size": size_of(F.col("text")), "block": F.pmod(spot, F.lit(BLOCKS)).cast("int"), "bin": F.pmod(F.shiftrightunsigned(spot, 20), F.lit(BINS)).cast("int")})


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """sources (source, source_size) with place (from 1, by code point, null last), weight and target.

    Targets are the weights' shares of all sizes; none is above `most` times its source's size, and the excess is
    reshared by weight. That is a level L with target = min(weight * L, most * size): with the sources in the order in
    which they reach their limit, L is the largest of the levels that follow from taking the first k as limited.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    shares = sources.withColumn("place", place).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1))
    limit = F.col("source_size") * float(most)
    first = W.orderBy(limit / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy()
    shares = shares.withColumns({"limit": limit, "total": F.sum(F.col("source_size").cast("double")).over(everything), "all_weight": F.sum("weight").over(everything), "limited": F.sum(limit).over(first), "limited_weight": F.sum("weight").over(first)})
    rest = F.col("all_weight") - F.col("limited_weight")
    level = F.greatest(F.col("total") / F.col("all_weight"), F.when(rest > 0, (F.col("total") - F.col("limited")) / rest))
    shares = shares.withColumn("level", F.max(level).over(everything))
    return shares.select("source", "source_size", "place", "weight", F.least(F.col("weight") * F.col("level"), "limit").alias("target"))


def _draw(all_: Column, own: Column, n: Column, u: Column) -> Column:
    """How many of `own` marked ones are among n drawn of `all_`, hypergeometric, by inversion at u in [0, 1)."""
    low, high, rest = F.greatest(F.lit(0), own - (all_ - n)), F.least(own, n), all_ - n
    ratio = F.when(own <= rest, F.aggregate(F.sequence(F.lit(0), own), F.lit(1.0), lambda a, j: F.when(j < own, a * (rest - j) / (all_ - j)).otherwise(a)))
    ratio = ratio.otherwise(F.aggregate(F.sequence(F.lit(0), rest), F.lit(1.0), lambda a, j: F.when(j < rest, a * (own - j) / (all_ - j)).otherwise(a)))

    def step(s: Column, k: Column) -> Column:
        below = s["below"] + s["p"]
        after = s["p"] * (own - k) * (n - k) / ((k + 1) * (all_ - own - n + k + 1))
        return F.struct(after.alias("p"), below.alias("below"), (s["n"] + F.when(below <= u, 1).otherwise(0)).alias("n"))

    start = F.struct(ratio.alias("p"), F.lit(0.0).alias("below"), F.lit(0).alias("n"))
    return F.least(high, low + F.aggregate(F.sequence(low, high), start, step, lambda s: s["n"]))


def _split(seed: int, level: int):
    """A fold over a node's sources: how many block copies of each go left, given what is left of all and of the half."""

    def step(s: Column, x: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), x["place"]), F.lit(2**53)).cast("double") / float(2**53)
        k = _draw(s["all"], x["k"], s["n"], u).cast("int")
        return F.struct((s["all"] - x["k"]).alias("all"), (s["n"] - k).alias("n"), F.array_append(s["left"], k).alias("left"))

    return step


def _quotas(units: DataFrame, depth: int, seed: int) -> DataFrame:
    """units (place, k: block copies of a source) with ends: the sum of the source's quotas up to each of 2^depth shards.

    Each node of the tree splits its block copies into two halves; what each source gives to the left half is
    multivariate hypergeometric, drawn source by source. Quotas of the leaves add up to k exactly. A node is one row
    with one entry a source.
    """
    node = units.agg(F.sort_array(F.collect_list(F.struct("place", "k"))).alias("own")).where(F.size("own") > 0).select(F.lit(0).alias("node"), "own")
    for level in range(depth):
        total = F.aggregate("own", F.lit(0), lambda a, x: a + x["k"])
        node = node.withColumn("total", total)

        start = F.struct(F.col("total").alias("all"), F.expr("cast((total + 1) div 2 as int)").alias("n"), F.array().cast("array<int>").alias("left"))
        node = node.withColumn("left", F.aggregate("own", start, _split(seed, level), lambda s: s["left"]))
        go = F.zip_with("own", "left", lambda x, k: F.struct(x["place"].alias("place"), k.alias("k")))
        stay = F.zip_with("own", "left", lambda x, k: F.struct(x["place"].alias("place"), (x["k"] - k).alias("k")))
        node = node.select("node", F.posexplode(F.array(go, stay)).alias("side", "own")).select((F.col("node") * 2 + F.col("side")).alias("node"), "own")
    leaves = node.select("node", F.explode("own").alias("x")).select("node", "x.place", "x.k")
    ends = leaves.withColumn("end", F.sum("k").over(W.partitionBy("place").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int"))
    return ends.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def plan_mix(keyed: DataFrame, *, shard_bits: int = 3, seed: int = 17) -> DataFrame:
    """keyed (source, size, block, bin) to one row for each source and block: source, block, source_size, target, epochs
    (copies that all of its documents get), cut (documents with a bin up to it get one more), units (epoch, shard)."""
    bins = keyed.groupBy("source", "block", "bin").agg(F.sum("size").alias("size"))
    blocks = stored(bins.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    shares = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")))
    shares = shares.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")).withColumn("more", F.col("target") - F.col("epochs") * F.col("source_size"))
    shares = shares.select(F.col("source").alias("_source"), "source_size", "place", "target", "epochs", "more")
    order = W.partitionBy("place").orderBy(F.xxhash64(F.lit(seed + 1), "place", "block"), "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    dealt = blocks.join(shares, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("end", F.sum("block_size").over(order))
    dealt = stored(dealt.withColumn("need", F.greatest(F.lit(0.0), F.least(F.col("block_size").cast("double"), F.col("more") - (F.col("end") - F.col("block_size"))))).drop("end", "more"), "mix-dealt")
    part = dealt.where((F.col("need") > 0) & (F.col("need") < F.col("block_size"))).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "place", "need")
    inner = bins.join(part, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    middle = F.sum("size").over(W.partitionBy("place", "block").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") / 2
    cuts = inner.withColumn("middle", middle).where(F.col("middle") <= F.col("need")).groupBy("place", "block").agg(F.max("bin").alias("part_cut"))
    cut = F.when(F.col("need") <= 0, -1).when(F.col("need") >= F.col("block_size"), BINS).otherwise(F.coalesce("part_cut", F.lit(-1)))
    dealt = dealt.join(cuts, ["place", "block"], "left").withColumn("cut", cut.cast("int")).drop("part_cut", "need")
    copies = dealt.select("place", "block", F.explode(F.sequence(F.lit(0), F.col("epochs") + F.when(F.col("cut") >= 0, 1).otherwise(0))).alias("epoch")).where("epoch > 0")
    quotas = _quotas(copies.groupBy("place").agg(F.count("*").cast("int").alias("k")), shard_bits, seed)
    turn = F.row_number().over(W.partitionBy("place").orderBy(F.xxhash64(F.lit(seed + 2), "place", "block", "epoch"), "block", "epoch"))
    units = copies.withColumn("turn", turn).join(quotas, "place").withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("turn"))))
    units = units.groupBy("place", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("units"))
    return stored(dealt.join(units, ["place", "block"], "left").select("source", "block", "source_size", "target", "epochs", "cut", F.coalesce("units", F.array().cast("array<struct<epoch:int,shard:int>>")).alias("units")), "mix-plan")


def _planned(keyed: DataFrame, plan: DataFrame, broadcast_rows: int = 64_000) -> DataFrame:
    """keyed rows with their block's plan and their own copies. The plan has BLOCKS rows a source at most; it is
    broadcast up to `broadcast_rows` of about 200 bytes, and joined by shuffle (blocks part hot sources) beyond."""
    own = plan.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "source_size", "target", "epochs", "cut", "units")
    if plan.count() <= broadcast_rows:
        own = F.broadcast(own)
    out = keyed.join(own, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    return out.withColumn("copies", F.col("epochs") + F.when(F.col("bin") <= F.col("cut"), 1).otherwise(0))


def mix_sizes(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shard_bits: int = 3, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, shards (where its copies go, in order).

    Sources, in the order of their code points with null last, weigh 5, 2 and 1 in turn; see targets(). Each source is
    permuted by a hash of its rows into 64 blocks of 4,096 bins. Whole epochs of the source are taken as often as they
    fit into its target, then further blocks in permuted order, the last one up to the bin nearest to the target. The
    splitting tree (see _quotas) deals exact numbers of each source's block copies to the 2^shard_bits output shards, and
    the copies are drawn in a permuted order, so that no two shards get the same one.

    The first aggregation is by source, block and bin, with a partial sum before its shuffle; what remains has at most
    64 x 4,096 rows a source, and windows see at most 64 blocks, or 4,096 bins, of a source at once: a source with a
    third of all rows meets no single task. Sources as such (one small row each) are ranked in one task.

    A null text has size 0; null sources are one source; null and repeated ids are fine, but equal rows share one fate.
    If all sizes are 0, targets are 0. Empty tables give empty results; other columns are ignored.
    """
    keyed = stored(_keyed(pick(docs, doc_id=id_col, source=source_col, text=text_col), seed).drop("text"), "mix-sizes")
    out = _planned(keyed, plan_mix(keyed, shard_bits=shard_bits, seed=seed))
    shards = F.transform(F.slice("units", F.lit(1), F.col("copies")), lambda x: x["shard"].cast("string"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), F.array_join(shards, ",").alias("shards"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shard_bits: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of docs, one row for each copy taken, in shards and shuffled locally.

    Rows are dealt by range of (shard, random key), so that a shard may span tasks, and sorted in each task: reading the
    output in order reads shard after shard, each in random order. Cases are as in mix_sizes()."""
    names = docs.columns
    rows, unpack = packed(docs)
    rows = rows.select("_row", *[F.col("_row")[f"_in{names.index(c)}"].alias(k) for k, c in (("doc_id", id_col), ("source", source_col), ("text", text_col))])
    plan = plan_mix(stored(_keyed(rows.drop("_row"), seed).drop("text", "doc_id"), "mix-sizes"), shard_bits=shard_bits, seed=seed)
    out = _planned(_keyed(rows, seed).drop("size"), plan)
    out = out.select("_row", "doc_id", "block", "bin", F.explode(F.slice("units", F.lit(1), F.col("copies"))).alias("unit"))
    out = out.select("_row", F.col("unit.shard").alias("shard"), F.xxhash64(F.lit(seed + 3), "doc_id", "block", "bin", "unit.epoch").alias("spot"))
    return unpack(out.repartitionByRange("shard", "spot").sortWithinPartitions("shard", "spot"))
