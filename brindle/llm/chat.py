"""Chat formatting: snapshots of a growing conversation collapse into its longest form, which is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

ROLES = ("system", "user", "assistant", "tool")


def _chain(turns: Column) -> Column:
    """Rolling hashes: the i-th covers the roles and texts of turns 1 to i. Lengths keep the fields apart.

    A fold copies what it has gathered at each step, so turns are folded in chunks of about the root of their number."""

    def step(acc: Column, t: Column) -> Column:
        field = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
        link = F.md5(F.concat(acc["last"], field(t["role"]), F.lit("|"), field(t["text"])))
        return F.struct(link.alias("last"), F.array_append(acc["all"], link).alias("all"))

    def add(acc: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(acc["last"].alias("last"), F.array().cast("array<string>").alias("all")), step)
        return F.get(F.transform(F.array(inner), lambda x: F.struct(x["last"].alias("last"), F.array_append(acc["all"], x["all"]).alias("all"))), F.lit(0))

    width = F.ceil(F.sqrt(F.size(turns))).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.size(turns), width), lambda at: F.slice(turns, at, width))
    start = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("all"))
    return F.flatten(F.aggregate(chunks, start, add, lambda acc: acc["all"]))


def render(turns: Column, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Turns in the ChatML layout. Marker strings inside a text are parted by a zero-width space, so that a text
    can't forge a turn. A null role reads unknown; a null text is empty."""
    safe = lambda c: F.replace(F.replace(c, F.lit(begin), F.lit(begin[:1] + "​" + begin[1:])), F.lit(end), F.lit(end[:1] + "​" + end[1:]))
    one = lambda t: F.concat(F.lit(begin), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(t["text"], F.lit(""))), F.lit(end), F.lit("\n"))
    return F.array_join(F.transform(turns, one), "")


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each maximal conversation: conv_id, n_turns, n_copies, chat_hash, rendered.

    A conversation is its roles and texts in the order of turn (then role, then text; null turns first). One that is
    the same as another, or a prefix of a longer one, is a snapshot and goes: the smallest conv_id stands for equal
    ones and n_copies counts them. Rolling hashes of each prefix (MD5 chained over length-prefixed fields) identify
    snapshots: equal conversations are grouped by their full hash, distinct proper-prefix hashes form the other side of
    an anti-join. Both sides are distinct before they meet, so that a first turn or a conversation that a third of all
    rows share is one key with one row on each side.

    Rows that repeat (conv_id, turn, role, text) count once. Turns with a null conv_id form one conversation, of which
    nothing is known but its turns; it stands for equal ones only if there is no other. Null roles and texts are values
    of their own for comparison and are rendered as unknown and empty. Empty tables give empty results; other columns
    are ignored. A conversation is one row here, so its turns must fit into a task.
    """
    rows = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(2**62))).alias("turn"), "role", "text"))).alias("turns"))
    convs = convs.withColumn("chain", _chain(F.col("turns")))
    convs = convs.withColumn("chat_hash", F.element_at("chain", -1))
    short = convs.select(F.explode(F.slice("chain", F.lit(1), F.size("chain") - 1)).alias("chat_hash")).distinct()
    whole = convs.groupBy("chat_hash").agg(F.count("*").alias("n_copies"), F.min("conv_id").alias("conv_id"))
    longest = whole.join(short, "chat_hash", "left_anti")
    texts = convs.select(F.col("conv_id").alias("_id"), "turns")
    out = longest.join(texts, F.col("conv_id").eqNullSafe(F.col("_id")))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", "chat_hash", render(F.col("turns")).alias("rendered"))
