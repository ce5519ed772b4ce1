"""Checks that a frame is small before it is sent to every executor."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
#: Bytes of a value of fixed width, at most.
FIXED_WIDTH = 16


def _width(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType | T.VariantType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(0))
    return F.lit(FIXED_WIDTH)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row; nothing is written out but nested values."""
    widths = [_width(F.col(f"`{field.name}`"), field.dataType) for field in df.schema]
    return reduce(Column.__add__, widths, F.lit(0)).cast("bigint")


def fits(seen, max_bytes=BROADCAST_BYTES, max_rows=BROADCAST_ROWS) -> bool:
    return (seen["rows"] or 0) <= max_rows and (seen["bytes"] or 0) <= max_bytes


def is_small(df: DataFrame, max_bytes=BROADCAST_BYTES, max_rows=BROADCAST_ROWS) -> bool:
    """Measure the frame itself: its rows and their bytes.

    One aggregate with partial sums; nothing but two numbers reaches the driver.
    """
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df)).alias("bytes")).first()
    return fits(seen, max_bytes, max_rows)


def counts_fit(counts: DataFrame) -> bool:
    """The same from the ``_rows`` and ``_bytes`` of its keys."""
    return fits(counts.agg(F.sum("_rows").alias("rows"), F.sum("_bytes").alias("bytes")).first())
