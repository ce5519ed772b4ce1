"""Vectors of a table as packed numbers: what both vector operators read."""

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.session import written


class Vectors(NamedTuple):
    """``rows``: (vec_id, vec, norm and kept columns), ``vec`` being ``dims`` numbers of ``kind``."""

    rows: DataFrame
    dims: int
    kind: str


def _packed(column: str, kind: str, others: list[str], zeros: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(column)
            starts, values = lists.offsets.to_numpy()[:-1], lists.values
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(kind)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
            with np.errstate(invalid="ignore"):
                other = np.concatenate([[0], np.cumsum(numbers != 0)])
            usable = (sizes > 0) & (bad[starts + sizes] == bad[starts]) & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            if not zeros:
                usable &= other[starts + sizes] > other[starts]
            kept = np.flatnonzero(usable)
            ends = np.cumsum(sizes[kept])
            items = np.repeat(starts[kept] - ends + sizes[kept], sizes[kept]) + np.arange(int(sizes[kept].sum()))
            data, bounds = numbers[items], np.concatenate([[0], ends])
            packed = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            wide = data.astype(np.float64)
            with np.errstate(over="ignore"):
                norm = np.sqrt(np.add.reduceat(wide * wide, bounds[:-1])) if len(kept) else np.zeros(0)
            chosen = batch.take(pa.array(kept))
            columns = [chosen.column("vec_id"), pa.array(packed, pa.binary()), pa.array(norm, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(chosen.column(x) for x in others)], names=["vec_id", "vec", "norm", *others]
            )

    return run


def vectors_of(
    table: DataFrame, column: str = "embedding", others: Iterable[str] = (), zeros: bool = True
) -> Vectors:
    """The usable vectors, written once.

    Rows without an id, with a null or empty vector, or with a null or non-finite component are left out;
    without ``zeros`` also vectors of zeros. Vectors have the length of the one with the least id
    (of several such, the least in bytes); those of another length are left out too, as nothing
    relates them to the others.
    """
    others = list(others)
    kind = "<f8" if dict(table.dtypes)[column] == "array<double>" else "<f4"
    if dict(table.dtypes)[column] not in ("array<double>", "array<float>"):
        kind, table = "<f8", table.withColumn(column, F.col(column).cast("array<double>"))
    read = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), column, *others)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.select(*others).schema) if others else ""
    schema = "vec_id bigint, vec binary, norm double" + (f", {kept}" if kept else "")
    rows = written(read.mapInArrow(_packed(column, kind, others, zeros), schema), "vectors")
    first = rows.orderBy("vec_id", "vec").select(F.octet_length("vec").alias("n")).first()
    size = first["n"] if first else 0
    return Vectors(rows.where(F.octet_length("vec") == size), size // np.dtype(kind).itemsize, kind)


def matrix(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(-1, dims).astype(np.float64)
