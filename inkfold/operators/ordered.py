"""Ordered work inside groups that may hold a large share of all rows.

Groups of up to ``limit`` rows are handled by one plain grouping or window. Larger groups are
range-partitioned, so that no task ever holds one whole, and stitched together by offsets.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.session import written

GROUP_ROWS = 2000
# A group with more than this share of all rows is hot: there are fewer than 1 / share of them.
HOT_SHARE = 1 / 10_000


def heavy_keys(
    df: DataFrame, keys: list[str], limit: int, share: float = HOT_SHARE, *, weight: Column | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Keys with more than ``limit`` rows: the hot ones, small enough to broadcast, and others.

    A row counts ``weight`` times where that is given. None stands for no such keys. A key that is not among the hot ones has at most ``share`` of
    all rows, so a shuffle by key is even enough for it. Counts are combined before the shuffle.
    """
    number = F.count(F.lit(1)) if weight is None else F.sum(weight.cast("bigint"))
    counts = df.groupBy(*keys).agg(number.alias("_rows"))
    seen = counts.agg(F.sum("_rows").alias("rows"), F.max("_rows").alias("top")).first()
    if (seen["top"] or 0) <= limit:
        return None, None
    heavy = written(counts.where(F.col("_rows") > limit), "heavy")
    is_hot = F.col("_rows") > F.lit(int(seen["rows"] * share))
    listed = heavy.where(is_hot).select(*keys).collect()
    schema = heavy.select(*keys).schema
    hot = F.broadcast(df.sparkSession.createDataFrame(listed, schema)) if listed else None
    others = heavy.where(~is_hot).select(*keys)
    return hot, None if others.isEmpty() else others


def match_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` with null equal to null, keeping one copy of the keys."""
    renamed = other.withColumnsRenamed({key: f"_other_{key}" for key in keys})
    same = reduce(
        Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_other_{k}`")) for k in keys]
    )
    joined = df.join(renamed, same, how)
    return joined.drop(*[f"_other_{key}" for key in keys])


def split_heavy(
    df: DataFrame,
    keys: list[str],
    limit: int,
    counted: DataFrame | None = None,
    weight: Column | None = None,
    write: bool = False,
):
    """The rows of small groups and those of heavy ones (None where there are none).

    ``counted`` is a frame that is cheaper to count and has, for each key, no fewer rows, or no less
    ``weight``. Hot keys are parted off by a broadcast before any shuffle by key. With ``write`` rows that
    have to be split are written first, so that they are made once.
    """
    parted = heavy_keys(df if counted is None else counted, keys, limit, weight=weight)
    if write and any(found is not None for found in parted):
        df = written(df, "rows")
    small, heavy = df, None
    for found in parted:
        if found is not None:
            part = match_keys(small, found, keys, "left_semi")
            small = match_keys(small, found, keys, "left_anti")
            heavy = part if heavy is None else heavy.unionByName(part)
    return small, heavy


def spread_positions(
    df: DataFrame, keys: list[str], order: list[Column], measure: Column | None = None
) -> DataFrame:
    """Adds ``_position`` (from 1, in ``order`` within ``keys``) without one task per group.

    ``_before`` is the sum of ``measure`` over the earlier rows of the group, ``_total`` that over
    all of them, and ``_group_rows`` their number. Rows equal in all ``order`` columns are parted by a number written with them, so copies spread as well.
    """
    measured = df.withColumns(
        {
            "_measure": F.lit(0).cast("bigint") if measure is None else measure.cast("bigint"),
            "_copy": F.monotonically_increasing_id(),
        }
    )
    # Written first, so that a task run again sees the same rows with the same numbers.
    numbered = written(measured, "numbered")
    sort = [*keys, *order, "_copy"]
    sliced = written(
        numbered.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}),
        "sliced",
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy("_at")
    earlier_slices = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per group and slice: a group has at most as many as there are slices.
    slices = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_at").alias("_first"),
        F.sum("_measure").alias("_sum"),
    )
    offsets = slices.select(
        *keys,
        "_slice",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier_slices), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(earlier_slices), F.lit(0)).alias("_sum_before"),
        F.sum("_sum").over(Window.partitionBy(*keys)).alias("_total"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("_group_rows"),
    )
    running = F.sum("_measure").over(in_slice.rowsBetween(Window.unboundedPreceding, -1))
    return (
        match_keys(
            sliced.withColumn("_running", F.coalesce(running, F.lit(0))),
            offsets,
            [*keys, "_slice"],
            "inner",
        )
        .withColumns(
            {
                "_position": F.col("_rows_before") + F.col("_at") - F.col("_first") + 1,
                "_before": F.col("_sum_before") + F.col("_running"),
            }
        )
        .drop("_measure", "_copy", "_slice", "_at", "_first", "_rows_before", "_sum_before")
        .drop("_running")
    )


def dense_position(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name="position",
    limit=GROUP_ROWS,
    counted: DataFrame | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Adds the place of each row in its group, from 1 without gaps.

    The groups are counted first. Without ``counted`` that reads ``df`` twice: a written table is the
    input to give. With it, see ``split_heavy``, ``df`` is read once, and written only if some group is
    heavy.
    """
    small, heavy = split_heavy(df, keys, limit, counted, weight, write=counted is not None)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    ranked = small.withColumn(name, rank)
    if heavy is None:
        return ranked
    spread = spread_positions(heavy, keys, order).withColumnRenamed("_position", name)
    return ranked.unionByName(spread.drop("_before", "_total", "_group_rows"))


def ordered_lists(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name="items",
    measure: Column | None = None,
    limit=GROUP_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Collect ``value`` per group in ``order``: ``(keys, chunk_seq, chunks, before, total, <name>)``.

    A group is cut after every ``limit`` values, and each part is one row: a group of n rows has
    ``chunks = ceil(n / limit)`` of them, whose lists joined by ``chunk_seq`` are the group.
    ``before`` sums ``measure`` over the earlier chunks, ``total`` over the group.
    """
    zero = F.lit(0).cast("bigint")
    measure = zero if measure is None else measure.cast("bigint")
    small, heavy = split_heavy(df, keys, limit, counted)
    sort_keys = [F.col(f"`{column}`").alias(f"o{i}") for i, column in enumerate(order)]
    lists = (
        small.groupBy(*keys)
        .agg(_collected([*sort_keys, value.alias("v")]).alias(name), F.sum(measure).alias("total"))
        .withColumns({"chunk_seq": zero, "chunks": F.lit(1).cast("bigint"), "before": zero})
    )
    if heavy is None:
        return lists
    spread = spread_positions(heavy, keys, [F.col(f"`{column}`") for column in order], measure)
    chunk = F.floor((F.col("_position") - 1) / limit).cast("bigint")
    chunks = (
        spread.withColumn("chunk_seq", chunk)
        .groupBy(*keys, "chunk_seq")
        .agg(
            F.first(F.ceil(F.col("_group_rows") / limit).cast("bigint")).alias("chunks"),
            F.min("_before").alias("before"),
            F.first("_total").alias("total"),
            _collected([F.col("_position"), value.alias("v")]).alias(name),
        )
    )
    return lists.unionByName(chunks)


def _collected(entry: list[Column]) -> Column:
    """The values ``v`` of a group, sorted by the other columns of the entries."""
    entries = F.sort_array(F.collect_list(F.struct(*entry)))
    return F.transform(entries, lambda e: e.getField("v"))
