"""One row of each group of rows that nothing their operator reads tells apart."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.session import written


def one_of_repeats(rows: DataFrame, keys: list[str], again: Column) -> DataFrame:
    """The column ``row`` (a struct), unfolded, of each row; of one row per ``keys`` where ``again`` holds.

    Of rows that repeat their keys, the one stays whose columns have the least hash, so a task that
    runs again takes the same. Each task keeps one row per key before the exchange, so a row that a third
    of the table repeats is combined where it is read. Rows are written once and read for both halves.
    """
    kept = written(rows.select("row", *keys, again.alias("again")), "kept")
    chosen = F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")
    single = kept.where("NOT again").select("row")
    return single.union(kept.where("again").groupBy(*keys).agg(chosen).select("row")).select("row.*")
