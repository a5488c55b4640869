"""Chat logs: snapshots that prefix longer conversations collapse, the rest is rendered. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the rendered form.
TURN_FORMAT = "<|%s|>\n%s<|end|>\n"
ROLE_OF_NULL = "unknown"


def _turns(log: DataFrame) -> DataFrame:
    """Turns numbered inside their conversation, with rolling hashes of the turns so far.

    A turn's hash holds its place, so the exclusive or of the first k hashes identifies the first k turns; two
    lanes of 64 bits. The window needs one pass over the conversation's sorted turns and no list of them.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lane = lambda salt: F.xxhash64(F.lit(salt), F.col("place"), F.col("role"), F.col("text"))
    return (
        log.withColumn("place", F.row_number().over(order))
        .withColumn("hash_a", F.bit_xor(lane(1)).over(so_far))
        .withColumn("hash_b", F.bit_xor(lane(2)).over(so_far))
        .withColumn("n_turns", F.count(F.lit(1)).over(Window.partitionBy("conv_id")))
    )


def _rendered() -> Column:
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda t: F.format_string(TURN_FORMAT, t["role"], t["text"]))
    return F.array_join(parts, "")


def maximal_conversations(
    log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, n_turns, n_chars, rendered) of every logged conversation that prefixes no other.

    A conversation goes when its turns (role and text) are the first turns of a longer one, or when an equal
    one has a smaller id. Null roles become 'unknown', null texts empty ones; turns with a null or the same
    number are ordered by role and text. Rows with a null id form one conversation, which is kept before all
    others. Repeated rows are turns of their own. Extra columns are ignored; an empty log gives no rows.

    Prefix hashes are made distinct before the anti-join, so a first turn that many share is one row there.
    """
    rows = log.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(ROLE_OF_NULL)).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    turns = _turns(rows)
    keys = ["place", "hash_a", "hash_b"]
    inner = turns.where(F.col("place") < F.col("n_turns")).groupBy(*keys).agg(F.lit(True).alias("inner")).drop("inner")
    ends = turns.where(F.col("place") == F.col("n_turns")).groupBy(*keys).agg(
        F.min_by(F.struct("conv_id"), F.struct(F.col("conv_id").isNotNull(), F.col("conv_id"))).alias("first")
    )
    maximal = ends.join(inner, keys, "left_anti").select(F.col("first.conv_id").alias("conv_id"))
    # the null conversation is matched too
    whole = turns.join(maximal.withColumnRenamed("conv_id", "kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    return (
        whole.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), _rendered().alias("rendered"))
        .select("conv_id", "n_turns", F.char_length("rendered").cast("long").alias("n_chars"), "rendered")
    )
