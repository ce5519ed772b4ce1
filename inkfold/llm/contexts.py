"""From recurring anchors to repeated windows: shared by both removals of repeats.

A window of ``span`` items (bytes or words) holds an anchor, and equal windows hold it at the
same place. So an anchor's neighbourhood, up to ``span`` items to the right and ``reach`` to the
left, decides all windows around it: two windows are equal if they agree on their items left of
the anchor and on those from it on. Both sides are classified by how far neighbours in sorted
order agree; a window's class is the pair.
"""

from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.recurring import items_of, owner_numbers, runs_of, told


class Sides(NamedTuple):
    """Sorted order of one side of the anchors, and how far each agrees with the one before."""

    order: np.ndarray
    common: np.ndarray

    def classes(self, depth: int) -> np.ndarray:
        """Equal numbers for anchors that agree on the first ``depth`` items of the side."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def room(starts: np.ndarray, lows: np.ndarray, highs: np.ndarray, span: int, reach: int):
    """Least and greatest number of items a window may have left of the anchor, inside its text."""
    least = np.maximum(0, starts + span - highs)
    return least, np.minimum(reach, starts - lows)


def repeated_range(right: Sides, left: Sides, least, most, members, span: int, verdict):
    """For each anchor the least and greatest offset of a repeated window, or a range that is empty.

    Only ``members`` are compared. ``verdict(groups, members)`` says which of the members, sorted
    by groups of equal windows, count as repeats.
    """
    n = len(least)
    low, high = np.full(n, span), np.full(n, -1)
    for offset in range(int(most.max(initial=-1)) + 1):
        own = members[(least[members] <= offset) & (offset <= most[members])]
        if not len(own):
            continue
        pairs = right.classes(span - offset)[own] * (n + 1) + left.classes(offset)[own]
        order = np.argsort(pairs)
        own = own[order]
        hit = own[verdict(runs_of(pairs[order]), own)]
        low[hit] = np.minimum(low[hit], offset)
        high[hit] = np.maximum(high[hit], offset)
    return low, high


def sorted_rows(rows: np.ndarray) -> Sides:
    """Sides of rows of bytes."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    differ = rows[order][1:] != rows[order][:-1]
    common = np.zeros(len(rows), np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return Sides(order, common)


def cuts_told(keys, sigs, places, counts, low, high, span: int, parts: int) -> Iterator[pa.RecordBatch]:
    """The cuts ``(from, to)`` of each text, overlapping ones as one.

    Entry i stands for ``counts[i]`` anchors of one text, all with its range of offsets;
    ``places`` lists them entry by entry. Windows of one anchor always overlap.
    """
    hit = np.flatnonzero(high >= low)
    if not len(hit):
        return
    each = np.repeat(hit, counts[hit])
    place = places[items_of(np.cumsum(counts), counts, hit)].astype(np.int64)
    owners = np.repeat(owner_numbers(keys[hit], sigs[hit]), counts[hit])
    begins, ends = place - high[each], place - low[each] + span
    order = np.lexsort((begins, owners))
    each, owners, begins, ends = each[order], owners[order], begins[order], ends[order]
    # One number line for all texts, each far beyond the one before.
    far = owners * (int(ends.max()) + 1)
    reached = np.maximum.accumulate(ends + far)
    fresh = np.append(True, begins[1:] + far[1:] > reached[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(fresh)) - 1
    cuts = np.stack([begins[first], reached[last] - far[last]], axis=1)
    bounds = runs_of(owners[first])
    texts = each[first[bounds[:-1]]]
    none = np.full(len(texts), -1)
    yield from told(keys[texts], sigs[texts], none, 2 * np.diff(bounds), cuts.reshape(-1), parts)


def dealt_like(found: DataFrame, name: str, partitions: int) -> DataFrame:
    """Answers dealt like the texts that they will meet."""
    dealt = found.select("key", "sig", F.col("data").alias(name)).repartition(partitions, "key", "sig")
    return dealt.hint("shuffle_hash")


def cut_mask(column: pa.Array, offsets: np.ndarray, n: int) -> np.ndarray:
    """Mask of the items of a chunk's texts that lie in a cut."""
    change = np.zeros(n + 1, np.int32)
    for row, blobs in enumerate(column):
        if blobs.is_valid:
            cuts = np.frombuffer(blobs.as_py(), np.int64).reshape(-1, 2) + offsets[row]
            np.add.at(change, cuts[:, 0], 1)
            np.add.at(change, cuts[:, 1], -1)
    np.cumsum(change, out=change)
    return change[:-1] > 0


def totals(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many items of each text the mask has."""
    return np.array([np.count_nonzero(mask[a:b]) for a, b in pairwise(offsets.tolist())], np.int64)


def around(data: np.ndarray, places: np.ndarray, lows, highs, span: int, reach: int):
    """The ``span`` bytes from each place on and the ``reach`` before it, nearest first.

    Zeros stand for what is beyond the text.
    """
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(span, np.uint8)])
    right = np.lib.stride_tricks.sliding_window_view(padded, span)[places + reach]
    left = np.lib.stride_tricks.sliding_window_view(padded, reach)[places][:, ::-1]
    return (
        right * (np.arange(span) < (highs - places)[:, None]),
        left * (np.arange(reach) < (places - lows)[:, None]),
    )


def only(chosen: np.ndarray, least: np.ndarray, most: np.ndarray, span: int):
    """The ranges of the chosen anchors; those of the others are empty."""
    low, high = np.full(len(least), span), np.full(len(least), -1)
    low[chosen], high[chosen] = least[chosen], most[chosen]
    return low, high
