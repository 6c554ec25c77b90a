"""Product entity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_product, token_overlap

#: Candidates a name, and the overlap that a match must exceed.
CANDIDATES, LIKE = 20, 0.8
#: Characters of a word's start that blocks tell apart; it decides on work only.
BLOCK = 32


def candidates(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names (name_id, name_normalized) with up to 20 products (id, name_normalized) each that have every word of the
    name as a prefix of one of theirs; relevance is the number of matching words of the product.

    Blocks are the starts of words that names ask for, whole words mostly. A name meets products in its rarest block only,
    counted over the catalogue's words, so that a word that most products have (a brand, a kind), or letters that most
    words begin with, pair nothing; its other words are then looked for in the products met. Distinct names are resolved
    once."""
    split = F.array_distinct(F.filter(F.split("name_normalized", " "), lambda w: w != ""))
    own = catalogue.select("id", "name_normalized").distinct().withColumn("words", split)
    worded = own.select("id", F.col("name_normalized").alias("candidate"), "words", F.explode("words").alias("word"))
    asked = names.select("name_normalized").distinct().withColumn("prefixes", split)
    starts = asked.select("name_normalized", "prefixes", F.explode(F.transform("prefixes", lambda p: F.substring(p, 1, BLOCK))).alias("block"))
    firsts = F.transform(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("word"))), lambda n: F.substring("word", F.lit(1), n))
    blocks = worded.groupBy("word").agg(F.count("*").alias("n")).select("word", "n", F.explode(firsts).alias("block")).join(starts.select("block").distinct(), "block", "left_semi")
    size = blocks.groupBy("block").agg(F.sum("n").alias("size"))
    rarest = starts.join(size, "block", "left")
    rarest = rarest.groupBy("name_normalized", "prefixes").agg(F.min(F.struct(F.coalesce("size", F.lit(0)).alias("size"), "block")).alias("x")).select("name_normalized", "prefixes", "x.block")
    hits = F.transform("prefixes", lambda p: F.size(F.filter("words", lambda w: w.startswith(p))))
    met = rarest.join(blocks.select("block", "word"), "block").join(worded, "word")
    met = met.where(F.col("word") == F.get(F.filter("words", lambda w: w.startswith(F.col("block"))), F.lit(0)))  # a product once
    met = met.withColumn("hits", hits).where(F.forall("hits", lambda n: n > 0))
    met = met.withColumn("relevance", F.aggregate("hits", F.lit(0).cast("long"), lambda a, n: a + n))
    top = F.row_number().over(W.partitionBy("name_normalized").orderBy(F.col("relevance").desc(), "id"))
    return met.withColumn("place", top).where(F.col("place") <= CANDIDATES).select("name_normalized", "id", "candidate", "relevance", "place")


def match_static(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each name's best candidate by overlap, then place, if the overlap exceeds 0.8: name_normalized, id, similarity."""
    scored = candidates(names, catalogue).withColumn("similarity", token_overlap(F.col("name_normalized"), F.col("candidate")))
    best = scored.groupBy("name_normalized").agg(F.max(F.struct("similarity", (-F.col("place")).alias("p"), "id")).alias("x"))
    return best.select("name_normalized", F.col("x.id").alias("id"), F.round("x.similarity", 6).alias("similarity")).where(F.col("x.similarity") > LIKE)


def match_or_create(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """names (name_id, name) with product_id: the catalogue's match, else that of the first name of the batch (by
    name_id) that it matches, else itself as a new product (a negative id, from name_id).

    Names are resolved together, not one after the other, which differs in two cases only: a name that matches both the
    catalogue and a product that an earlier name of the batch would have made gets the catalogue's, even if the other is
    more alike; and of a chain of new names each of which is like the next, a name joins the best match among all new
    names of the batch, not among those that became products."""
    rows = names.select("name_id", norm_product(F.col("name")).alias("name_normalized"))
    known = match_static(rows, catalogue).select("name_normalized", F.col("id").alias("_known"))
    rest = rows.join(known, "name_normalized", "left")
    fresh = rest.where("_known is null").groupBy("name_normalized").agg(F.min("name_id").alias("id"))
    inner = match_static(fresh, fresh).select("name_normalized", F.col("id").alias("_inner"))
    firsts = fresh.join(inner, "name_normalized", "left").select("name_normalized", (-1 - F.least("id", F.coalesce("_inner", "id"))).alias("_new"))
    return rest.join(firsts, "name_normalized", "left").select("name_id", "name_normalized", F.coalesce("_known", "_new").alias("product_id"))
