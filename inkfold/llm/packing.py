"""Best-fit packing of documents into sequences of several permitted lengths."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.session import written

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence of length c: fixed + c + c * c / quadratic (attention grows with the square).
FIXED_COST, QUADRATIC = 32.0, 16384.0
#: Pieces packed together by one task. More waste less at the end of a shard; memory is in
#: proportion, for a piece is a few numbers.
SHARD_PIECES = 4_096

PACKED = (
    "doc_id bigint, piece int, start bigint, n_words bigint, bin string, bin_capacity int, "
    "bin_used int, bin_offset int"
)


def sequence_cost(capacity: int) -> float:
    return FIXED_COST + capacity + capacity * capacity / QUADRATIC


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES):
    """Bins of pieces given longest first: ``(bin of each piece, offset, capacity, used of bins)``.

    A piece goes to the open bin, of whatever size, that it leaves the least room in. If none has
    room, a bin is opened of the size with the least cost per word it can expect to hold: the
    piece and the shorter pieces still to come that fit beside it, less the room that open bins
    already offer them. In the end every bin shrinks to the least size that holds its contents.
    """
    sizes = sorted(capacities)
    costs = {c: sequence_cost(c) for c in sizes}
    top = sizes[-1]
    histogram = np.bincount(np.asarray(lengths, np.int64), minlength=top + 1)
    # Words in pieces of up to x words; none of them is placed before the longer ones are.
    shorter = np.cumsum(histogram * np.arange(len(histogram))).tolist()
    left = histogram.tolist()
    bins_by_room: dict[int, list[int]] = {}
    rooms, room_total = 0, 0  # bit r is set if an open bin has room r
    capacity: list[int] = []
    used: list[int] = []
    owner, offset = [], []
    for length in lengths:
        left[length] -= 1
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            stack = bins_by_room[room]
            bin_no = stack.pop()
            if not stack:
                rooms ^= 1 << room
            room_total -= length
        else:
            waiting = left[length] * length

            def unit_cost(c: int, length=length, waiting=waiting) -> float:
                beside = c - length
                fill = shorter[min(beside, length - 1)] + (waiting if beside >= length else 0)
                return costs[c] / (length + min(beside, max(0, fill - room_total)))

            chosen = min((c for c in sizes if c >= length), key=lambda c: (unit_cost(c), -c))
            bin_no, room = len(capacity), chosen
            capacity.append(chosen)
            used.append(0)
            room_total += chosen - length
        owner.append(bin_no)
        offset.append(used[bin_no])
        used[bin_no] += length
        rest = room - length
        if rest:
            bins_by_room.setdefault(rest, []).append(bin_no)
            rooms |= 1 << rest
    final = [next(c for c in sizes if c >= u) for u in used]
    return owner, offset, final, used


def best_fit_packing(
    docs: DataFrame,
    capacities: Sequence[int] = CAPACITIES,
    length: Column | None = None,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Where each document goes: ``(doc_id, piece, start, n_words, bin, bin_capacity, ...)``.

    ``length`` is any measure of a row, by default its words (``[^\\x20\\x09-\\x0D]+``); give
    token counts to pack tokens. A document longer than the largest capacity is cut into pieces of
    that capacity and a rest, so nothing is truncated; ``start`` is where a piece begins. Bins
    are packed in shards of about ``shard_pieces`` pieces, dealt by a hash of row and piece.

    Documents of length 0 (null or empty texts) have one row without a bin. Repeated rows are
    packed each; null ids are packed like others. Other columns are not read.
    """
    spark, top = docs.sparkSession, max(capacities)
    n_words = word_count(F.col("text")) if length is None else length
    # Ids and lengths only, written once: counting and packing read these few bytes a row.
    measured = written(
        docs.select(
            "doc_id", n_words.cast("bigint").alias("total"), F.xxhash64("doc_id", "text").alias("row")
        ),
        "lengths",
    )
    pieces_of = F.greatest(F.ceil(F.col("total") / top), F.lit(1))
    n_pieces = measured.agg(F.sum(pieces_of)).first()[0] or 0
    shards = max(1, -(-n_pieces // shard_pieces))
    number = F.explode(F.sequence(F.lit(0), (pieces_of - 1).cast("int")))
    pieces = measured.select("doc_id", "total", "row", number.alias("piece")).select(
        "doc_id",
        "piece",
        (F.col("piece").cast("bigint") * top).alias("start"),
        F.least(F.col("total") - F.col("piece").cast("bigint") * top, F.lit(top)).alias("n_words"),
        F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).cast("int").alias("shard"),
    )

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        shard = table.column("shard")[0].as_py()
        owner, offset, final, used = best_fit(table.column("n_words").to_pylist(), capacities)
        return pa.table(
            {
                "doc_id": table.column("doc_id").cast(pa.int64()),
                "piece": table.column("piece"),
                "start": table.column("start"),
                "n_words": table.column("n_words"),
                "bin": pa.array([f"{shard}-{b}" for b in owner], pa.string()),
                "bin_capacity": pa.array([final[b] for b in owner], pa.int32()),
                "bin_used": pa.array([used[b] for b in owner], pa.int32()),
                "bin_offset": pa.array(offset, pa.int32()),
            }
        )

    full = pieces.where(F.col("n_words") > 0).groupBy("shard").applyInArrow(packed, PACKED)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("bin", "string"), ("bin_capacity", "int"), ("bin_used", "int"), ("bin_offset", "int"))]
    empty = measured.where(F.coalesce(F.col("total"), F.lit(0)) <= 0).select(
        F.col("doc_id").cast("bigint"), F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("n_words"), *none
    )
    return full.unionByName(empty)
