"""Chat formatting of the longest snapshots of logged conversations.

Logs often hold a conversation again and again as it grows. Every turn prefix of every
conversation gets a rolling hash; a conversation whose hash is that of a shorter prefix
of another one is a snapshot of that and goes, in an anti-join. Of equal conversations
the smallest id stays. The rest is rendered. All of it is DataFrame functions.

Turns are ordered by turn, then role, then text, null first. A turn given twice counts
once. Null roles and texts count as such when conversations are compared, and are
rendered empty. Rows without a conversation id are the turns of one conversation, whose
id is null. Other columns of the table are not looked at. Prefixes are told apart by 128
bits. A conversation is rendered into one row, so it must fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import checkpointed

# The marks of the ChatML format.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    """Depends on the place, so that the exclusive or of a prefix depends on the order."""
    missing = F.lit("\x00missing")
    return F.xxhash64(
        F.lit(seed), "position", F.coalesce("role", missing), F.lit("\x00"), F.coalesce("text", missing)
    )


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, position, p1, p2, last): the hash of each turn prefix."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    same = F.lit(True)
    for column in ("turn", "role", "text"):
        same &= F.col(column).eqNullSafe(F.lag(column).over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("repeated", same & (F.row_number().over(order) > 1))
        .filter("NOT repeated")
        .withColumn("position", F.row_number().over(order).cast("long"))
        .withColumn("h1", _turn_hash(1))
        .withColumn("h2", _turn_hash(2))
        .select(
            "conv_id",
            "position",
            F.bit_xor("h1").over(so_far).alias("p1"),
            F.bit_xor("h2").over(so_far).alias("p2"),
            F.lead("position").over(order).isNull().alias("last"),
        )
    )


def maximal(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, n_copies) of the conversations that no other one continues."""
    found = checkpointed(prefixes(turns))
    keys = ["position", "p1", "p2"]
    # Both sides are reduced before their shuffle, so a frequent start or copy is no hot key.
    whole = (
        found.filter("last").groupBy(keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    )
    continued = found.filter("NOT last").select(keys).distinct()
    return whole.join(continued, keys, "left_anti").select(
        "conv_id", F.col("position").alias("n_turns"), "n_copies"
    )


def _escaped(text: Column) -> Column:
    """A text cannot open or close a turn of its own."""
    text = F.coalesce(text, F.lit(""))
    for mark in (BEGIN, END):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("|", " |", 1)))
    return text


def render(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, n_copies, text), one per maximal conversation of ``turns``.

    ``turns`` has (conv_id, turn, role, text).
    """
    kept = maximal(turns).withColumnRenamed("conv_id", "kept_id")
    of_kept = turns.select("conv_id", "turn", "role", "text").join(
        kept, F.col("conv_id").eqNullSafe(F.col("kept_id"))
    )
    rendered = F.transform(
        F.array_distinct(F.sort_array("turns")),
        lambda turn: F.concat(
            F.lit(BEGIN), _escaped(turn["role"]), F.lit("\n"), _escaped(turn["text"]), F.lit(f"{END}\n")
        ),
    )
    return (
        of_kept.groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(rendered, "").alias("text"))
    )
