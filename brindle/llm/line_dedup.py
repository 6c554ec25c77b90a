"""Line dedup: lines found in many documents stay in one document only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, packed, pick, stored

#: A key's hash: two 64-bit hashes with different leading values, 128 bits together.
HASH = ("h1", "h2")
#: Common hashes that are broadcast at most (some 60 bytes each), and parts of each hash beyond that.
MOST_BROADCAST, SALTS = 500_000, 16


def _hashes(c: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), c).alias(h) for i, h in enumerate(HASH)]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """docs (doc_id, text and others) with lines, an array, and drops: sorted positions, from 0, of the lines that go."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.withColumns({"t1": F.xxhash64(F.lit(0), text), "t2": F.xxhash64(F.lit(1), text)})
    lines = base.select("doc_id", "t1", "t2", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    # Long lines are hashed once, for the count and for the places; 40 bytes a line.
    lines = stored(lines.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "pos", *_hashes(F.col("key"))), "line-hashes")
    # Distinct documents in two steps: by key and document, then by key; both are pre-aggregated before their shuffle.
    common = lines.groupBy(*HASH, "doc_id").agg(F.lit(1).alias("one")).where("doc_id is not null").groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs).drop("n_docs")
    hits = _places(lines, stored(common, "line-common")).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    hits = hits.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("drops")).select(F.col("doc_id").alias("_hit_id"), F.col("t1").alias("_hit1"), F.col("t2").alias("_hit2"), "drops")
    # The lines are split before the join, so that no later projection splits the text once for each slice.
    ready = base.withColumn("lines", F.split(text, "\n", -1)).drop("text")
    return ready.join(hits, F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.col("t1") == F.col("_hit1")) & (F.col("t2") == F.col("_hit2")), "left").drop("_hit_id", "_hit1", "_hit2", "t1", "t2")


def _places(lines: DataFrame, common: DataFrame) -> DataFrame:
    """lines whose hash is common, with its keeper. Up to MOST_BROADCAST common hashes are broadcast, so that no line moves;
    beyond that both sides are dealt by hash and one of SALTS parts, so that a line of a third of all documents goes to
    many tasks."""
    if common.count() <= MOST_BROADCAST:
        return lines.join(F.broadcast(common), list(HASH))
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = lines.withColumn("salt", F.pmod(F.xxhash64("t1", "t2", "pos"), F.lit(SALTS)).cast("int"))
    return own.join(salted, [*HASH, "salt"]).drop("salt")


def _kept() -> Column:
    """The lines between the dropped positions, joined: work in proportion to the lines, however many are dropped."""
    n, drops, lines = F.size("lines"), F.col("drops"), F.col("lines")
    runs = F.transform(F.sequence(F.lit(0), F.size(drops)), lambda i: F.when(i == 0, F.slice(lines, F.lit(1), F.get(drops, F.lit(0)))).otherwise(F.slice(lines, F.get(drops, i - 1) + 2, F.coalesce(F.get(drops, i), n) - F.get(drops, i - 1) - 1)))
    return F.array_join(F.when(drops.isNull(), lines).otherwise(F.flatten(runs)), "\n")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (before), n_dropped, text (what stays).

    Texts are split at \\n; a null or empty text is one empty line. Lines whose key (see line_key) has `min_chars`
    code points or more and is found in `min_docs` documents or more go, except all of them in the largest doc_id
    that holds the key. The others stay in their order, joined by \\n; a document that loses all lines has an empty text.

    Lines are exploded with their positions, hashed to 128 bits, and documents are counted for each hash; only the
    positions of lines that go return to the documents, and each text is reassembled by position in its own row.
    A line that a third of all documents hold is pre-aggregated before each shuffle; the join that finds its places
    broadcasts the common hashes up to a bound that is checked, and is salted beyond it.

    Documents are told apart by doc_id: rows that repeat a doc_id count once for a key, and each is returned. A null
    doc_id counts as no document; its common lines go, as it is never the largest.
    Empty tables give empty results; other columns are ignored.
    """
    marked = _marked(pick(docs, doc_id=id_col, text=text_col), min_chars, min_docs)
    return marked.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"), _kept().alias("text"))


def dedup_lines_keep_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the text replaced by what dedup_lines() leaves of it; all other columns as they were. A null text
    stays null if no line of it goes."""
    names = docs.columns
    rows, unpack = packed(docs)
    at = f"_in{names.index(text_col)}"
    marked = _marked(rows.select(F.col("_row")[f"_in{names.index(id_col)}"].alias("doc_id"), F.col("_row")[at].alias("text"), F.col("_row").dropFields(at).alias("_rest"), F.col("_row")[at].isNull().alias("_null")), min_chars, min_docs)
    full = marked.select("_rest", F.when(~F.col("_null"), _kept()).alias("_text"))
    return unpack(full.select(F.col("_rest").withField(at, F.col("_text")).alias("_row")))


def with_lengths(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with length_col counted anew from the text, where docs have such a column (a null text keeps its length). Null or
    repeated rows are each counted by themselves; an empty table stays empty; other columns stay, whatever their names."""
    if length_col not in docs.columns:
        return docs
    rows, unpack = packed(docs)
    text, at = f"_in{docs.columns.index(text_col)}", f"_in{docs.columns.index(length_col)}"
    kind = docs.schema.fields[docs.columns.index(length_col)].dataType
    fresh = F.coalesce(F.length(F.col("_row")[text]).cast(kind), F.col("_row")[at])
    return unpack(rows.select(F.col("_row").withField(at, fresh).alias("_row")))
