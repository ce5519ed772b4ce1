"""Line items of a document as an array of ``(specification, total_amount)``, and back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.ordered import GROUP_ROWS, ordered_lists


def line_items_nest(
    items: DataFrame,
    keys: list[str],
    order: list[str],
    limit: int = GROUP_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``(keys, chunk_seq, table_data)``: the array is cut after every ``limit`` items.

    The layout is part of the result, and the same for every document: one of n items has
    ``ceil(n / limit)`` rows, each a value of bounded size.
    ``counted`` may name a frame with no fewer rows per document that is cheaper to count.
    """
    item = F.struct(F.col("specification"), F.col("total_amount"))
    ties = [*order, "specification", "total_amount"]
    lists = ordered_lists(items, keys, ties, item, name="table_data", limit=limit, counted=counted)
    return lists.drop("chunks", "before", "total")


def line_items_explode(documents: DataFrame) -> DataFrame:
    """One row per item with its place in the array; a document without items keeps one row."""
    kept = [F.col(f"`{name}`") for name in documents.columns if name != "table_data"]
    return documents.select(*kept, F.posexplode_outer("table_data").alias("item_seq", "_item")).select(
        *kept, "item_seq", "_item.specification", "_item.total_amount"
    )
