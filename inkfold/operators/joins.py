"""Shuffle joins by a key that may be hot on one side."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.ordered import match_keys
from inkfold.operators.sizes import row_bytes
from inkfold.session import written

#: A key with more rows than this is spread over one part for every so many of them.
HOT_ROWS = 1_000_000
#: So many keys are small enough to send to every executor.
BROADCAST_KEYS = 10_000


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """``(key, _rows, _bytes)``: one pass over the rows, combined before the shuffle, and written.

    What is asked about the rows next, their size and their hot keys, is answered from it.
    """
    size = F.sum(row_bytes(rows)).alias("_bytes")
    return written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), size), "counted")


def hot_parts(counts: DataFrame, key: str, limit: int) -> DataFrame | None:
    """``(key, _parts)`` of the keys with more than ``limit`` rows, null among them; None if there are none.

    There are at most as many as all rows over ``limit``, and they are broadcast only if they are few.
    """
    parts = F.ceil(F.col("_rows") / limit).cast("bigint").alias("_parts")
    hot = counts.where(F.col("_rows") > limit).select(key, parts)
    number = hot.count()
    if not number:
        return None
    return F.broadcast(hot) if number <= BROADCAST_KEYS else hot


def spread_hot(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """The rows with ``_part``: those of hot keys are dealt in turn, so equal rows spread like others.

    Their numbers are written with them, so that a task run again deals them out the same way.
    """
    numbered = match_keys(rows, hot, [key], "left").withColumn("_row", F.monotonically_increasing_id())
    part = F.coalesce(F.pmod(F.col("_row"), F.col("_parts")), F.lit(0).cast("bigint"))
    return written(numbered, "spread").withColumn("_part", part).drop("_row", "_parts")


def salted_join(
    many: DataFrame,
    few: DataFrame,
    key: str,
    limit: int = HOT_ROWS,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Inner, left or left anti join for a side in which some keys have more than ``limit`` rows.

    The rows of such keys are spread over as many parts as they have limits of rows, and only the
    matching rows of the other side are repeated, once per part. Without hot keys it is a plain join.
    ``many`` is read twice, once to count its keys and once to join; with ``counts`` it is read once.
    """
    hot = hot_parts(key_counts(many.select(key), key) if counts is None else counts, key, limit)
    if hot is None:
        return many.join(few, key, how)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1).cast("bigint")) - 1))
    copies = few.join(hot, key, "left").withColumn("_part", each).drop("_parts")
    return spread_hot(many, hot, key).join(copies, [key, "_part"], how).drop("_part")
