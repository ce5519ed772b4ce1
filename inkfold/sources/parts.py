"""Document parts: the body and the six header and footer kinds of every section."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import PARTS


def parts_union(frames: dict[str, DataFrame | None]) -> DataFrame:
    """One run table from a frame per part kind; kinds a document set lacks are None."""
    unknown = set(frames) - set(PARTS)
    if unknown:
        raise ValueError(f"unknown parts: {sorted(unknown)}")
    named = [
        frames[part].withColumn("part", F.lit(part))
        for part in PARTS
        if frames.get(part) is not None
    ]
    return reduce(DataFrame.unionByName, named)


def part_rank(part: Column) -> Column:
    """Place of a part within its section; the body comes first."""
    return F.array_position(F.array(*[F.lit(p) for p in PARTS]), part).cast("int") - 1


def reading_order() -> list[Column]:
    """Sort keys of a run table: the body, then section by section, header before footer."""
    return [(F.col("part") != "body"), F.col("section"), part_rank(F.col("part")), F.col("run_seq")]
