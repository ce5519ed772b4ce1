"""Removal of long byte strings that an earlier document has, by a distributed suffix sort.

Suffixes are sorted where their texts are, at anchors only, and exchanged as front-coded runs:
each entry is the length it shares with the one before and the bytes that follow. Runs are
combined by a loser tree that remembers how long a prefix each loser shares with the last
winner, so bytes known to be equal are never compared again.
"""

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.contexts import (
    Sides,
    around,
    cut_mask,
    cuts_told,
    dealt_like,
    only,
    repeated_range,
    room,
    sorted_rows,
    totals,
)
from inkfold.llm.recurring import (
    BLOCKS,
    PART_BYTES,
    SHORT,
    answers,
    block_rows,
    id_of,
    items_of,
    keyed,
    pack,
    part_of,
    parts_for,
    recurring,
)
from inkfold.llm.words import (
    Chunk,
    Piece,
    anchors,
    at_most,
    byte_pieces,
    chunks,
    eights,
    gram_hashes,
)

SPAN, GRAM = 50, 20
REACH = SPAN - GRAM
CHOICE = 0x9E3779B97F4A7C15
#: Suffixes sorted at once by a task; merges of a fraction of a part, for strings are objects.
RUN_SUFFIXES, MERGES_PER_PART = 1 << 17, 4
CLEANED = (
    "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
)


def anchor_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors and their hashes."""
    n = len(chunk.data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Eight bytes decide which grams are anchors, the whole gram what they are joined on.
    choice = (eights(chunk.data)[:n] * np.uint64(CHOICE) >> np.uint64(32)).astype(np.uint32)
    places = anchors(choice, chunk.offsets, GRAM, SPAN)
    return places, gram_hashes(chunk.data, places, GRAM) & SHORT


def own_anchors(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a piece of text: places, hashes and the texts they are in."""
    places, hashes = anchor_hashes(piece.chunk)
    own = piece.own(places)
    return places[own], hashes[own], np.searchsorted(piece.chunk.offsets, places[own], "right") - 1


def distinct_anchors(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each text's anchor hashes once, for a repeat inside a text removes nothing."""
    found = [at_most(1, *own_anchors(piece)[1:]) for piece in byte_pieces(chunk, REACH, SPAN)]
    hashes, texts = at_most(1, *map(np.concatenate, zip(*found, strict=True)))
    return hashes, np.bincount(texts, minlength=len(chunk.offsets) - 1)


def front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows of bytes as shared lengths and what follows them."""
    width, common = rows.shape[1], np.zeros(len(rows), np.uint8)
    differ = rows[1:] != rows[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return common, rows[np.arange(width) >= common[:, None]]


def restored(common: np.ndarray, tails: np.ndarray, width: int) -> np.ndarray:
    own = np.arange(width) >= common[:, None]
    rows = np.zeros(own.shape, np.uint8)
    rows[own] = tails
    source = np.maximum.accumulate(np.where(own, np.arange(len(rows))[:, None], 0), axis=0)
    return np.take_along_axis(rows, source, axis=0)


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree that knows common prefixes.

    A run is its strings, all of one length, and how long a prefix each shares with the one
    before. Returns the strings' numbers (counted through all runs) in merged order, and their
    shared prefixes with the string before.
    """
    width = max((len(strings[0]) for strings, _ in runs if strings), default=0)
    first, total = [], 0
    for strings, _ in runs:
        first.append(total)
        total += len(strings)
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    heads = [0] * leaves
    current = [strings[0] if strings else b"" for strings, _ in runs] + [b""] * (leaves - len(runs))

    def decide(a: int, b: int, known: int) -> tuple[int, int, int]:
        """Winner, loser and their common prefix, comparing from ``known`` on only."""
        x, y = current[a][known:], current[b][known:]
        if x == y:
            return (a, b, width) if a < b else (b, a, width)
        differ = int.from_bytes(x) ^ int.from_bytes(y)
        common = width - (differ.bit_length() + 7) // 8
        return (a, b, common) if x < y else (b, a, common)

    # winners[i] of node i, (run, prefix shared with the last output or -1 when exhausted).
    winners = [(0, 0)] * (2 * leaves)
    losers, shares = [0] * leaves, [-1] * leaves
    for i in range(leaves):
        winners[leaves + i] = (i, 0 if i < len(runs) and runs[i][0] else -1)
    for node in range(leaves - 1, 0, -1):
        (a, ha), (b, hb) = winners[2 * node], winners[2 * node + 1]
        if ha == hb == 0:
            win, lose, common = decide(a, b, 0)
            winners[node], losers[node], shares[node] = (win, 0), lose, common
        else:
            better = ha >= hb
            winners[node] = (a, ha) if better else (b, hb)
            losers[node], shares[node] = (b, hb) if better else (a, ha)
    run, share = winners[1] if leaves > 1 else winners[leaves]
    order, commons = [], []
    for _ in range(total):
        strings, inner = runs[run]
        order.append(first[run] + heads[run])
        commons.append(share)
        heads[run] = at = heads[run] + 1
        if at < len(strings):
            current[run], share = strings[at], inner[at]
        else:
            share = -1
        node = (leaves + run) >> 1
        while node:
            other = shares[node]
            if other > share:
                losers[node], run = run, losers[node]
                shares[node], share = share, other
            elif other == share and share >= 0:
                run, losers[node], shares[node] = decide(run, losers[node], share)
            node >>= 1
    return order, commons


def merged_sides(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> Sides:
    """Merge the front-coded runs of all blocks; each run comes with its entries' numbers."""
    runs, numbers = [], []
    for common, tails, number in blocks:
        raw = restored(common, tails, width).tobytes()
        strings = [raw[i : i + width] for i in range(0, len(raw), width)]
        runs.append((strings, common.tolist()))
        numbers.append(number)
    order, commons = merge_runs(runs)
    return Sides(np.concatenate(numbers)[np.array(order, np.int64)], np.array(commons))


class _Runs:
    """Suffixes of a task's texts until there are enough for a sorted run per part."""

    def __init__(self, parts: int, texts: int, limit: int):
        self.parts, self.texts, self.limit, self.pending, self.size = parts, texts, limit, [], 0

    def add(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        """Takes the anchors whose hash recurs, some at a time: a long text has many."""
        known = [np.frombuffer(x.as_py(), np.uint64) for x in chunk.rows.column("hashes")]
        key, sig = (chunk.rows.column(name).to_numpy() for name in ("key", "sig"))
        for piece in byte_pieces(chunk, REACH, SPAN):
            places, hashes, texts = own_anchors(piece)
            bounds = np.searchsorted(texts, np.arange(len(known) + 1))
            kept = [np.isin(hashes[a:b], own) for (a, b), own in zip(pairwise(bounds), known, strict=True)]
            kept = np.flatnonzero(np.concatenate(kept))
            for at in range(0, len(kept), self.limit):
                own = kept[at : at + self.limit]
                self._lay(piece, places[own], hashes[own], key[texts[own]], sig[texts[own]], texts[own])
                if self.size >= self.limit:
                    yield from self.emit()

    def _lay(self, piece: Piece, places, hashes, keys, sigs, texts) -> None:
        lows, highs = piece.bounds(piece.chunk.offsets, texts)
        least, most = room(places, lows, highs, SPAN, REACH)
        useful = least <= most
        right, left = around(piece.chunk.data, places, lows, highs, SPAN, REACH)
        rows = [part_of(hashes, self.parts), keys, sigs, places - lows, least, most, right, left]
        self.pending.append([x[useful] for x in rows])
        self.size += int(useful.sum())

    def emit(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        part, keys, sigs, places, least, most, right, left = (
            np.concatenate(x) for x in zip(*self.pending, strict=True)
        )
        self.pending, self.size = [], 0
        bounds = np.stack([least, most], axis=1).astype(np.uint8)
        whole = np.ascontiguousarray(np.hstack([right, left, bounds]))
        whole = np.unique(whole.view(f"S{whole.shape[1]}").ravel(), return_inverse=True)[1]
        # By part, then as suffixes; equal neighbourhoods stand together, the least id first, and
        # those of one text are one entry with several places.
        order = np.lexsort((sigs, keys, whole, part))
        part, keys, sigs, whole = part[order], keys[order], sigs[order], whole[order]
        places = places[order].astype(np.uint32)
        same = (whole[1:] == whole[:-1]) & (part[1:] == part[:-1])
        first = np.flatnonzero(np.append(True, ~same | (keys[1:] != keys[:-1]) | (sigs[1:] != sigs[:-1])))
        counts = np.diff(np.append(first, len(order)))
        ends = np.cumsum(counts)
        alike, order = np.append(False, same)[first], order[first]
        part, keys, sigs, least, most = part[first], keys[first], sigs[first], least[order], most[order]
        # All windows around a neighbourhood that a smaller id has too are repeats already.
        head = np.maximum.accumulate(np.where(alike, 0, np.arange(len(order))))
        settled = keys > keys[head]
        ranges = only(np.flatnonzero(settled), least, most, SPAN)
        yield from cuts_told(keys, sigs, places, counts, *ranges, SPAN, self.texts)
        rest = np.flatnonzero(~settled)
        limits = np.searchsorted(part[rest], np.arange(self.parts + 1))
        for number in np.flatnonzero(np.diff(limits)):
            own = rest[limits[number] : limits[number + 1]]
            common, tails = front_coded(right[order[own]])
            block = pack(
                [
                    keys[own], sigs[own], counts[own].astype(np.uint32), least[own].astype(np.uint8),
                    most[own].astype(np.uint8), places[items_of(ends, counts, own)],
                    common, tails, left[order[own]].reshape(-1),
                ]
            )
            yield block_rows([number], [None], [block])


def _merged(blocks: list[list[np.ndarray]], texts: int) -> Iterator[pa.RecordBatch]:
    """All runs of one part: which windows does a smaller id have too?"""
    columns, runs, total = [], [], 0
    for *own, common, tails, left in blocks:
        columns.append([*own, left])
        runs.append((common, tails, np.arange(len(common)) + total))
        total += len(common)
    keys, sigs, counts, least, most, places, left = (
        np.concatenate(x) for x in zip(*columns, strict=True)
    )
    counts, least, most = (x.astype(np.int64) for x in (counts, least, most))
    right, left = merged_sides(runs, SPAN), sorted_rows(left.reshape(-1, REACH))
    ranks = np.unique(keys, return_inverse=True)[1].ravel()
    # Equal in suffix and in what stands before: every window of the larger ids is a repeat, and
    # the least id speaks for all.
    whole = [right.classes(SPAN), left.classes(REACH), least * (SPAN + 1) + most]
    order = np.lexsort((ranks, *whole))
    same = np.all([np.diff(x[order], prepend=-1) == 0 for x in whole], axis=0)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(total)))
    settled = np.zeros(total, bool)
    settled[order] = ranks[order] > ranks[order][head]

    def later(bounds: np.ndarray, members: np.ndarray) -> np.ndarray:
        """Members of a group in which a smaller id is."""
        smallest = np.minimum.reduceat(ranks[members], bounds[:-1])
        return ranks[members] > np.repeat(smallest, np.diff(bounds))

    low, high = repeated_range(right, left, least, most, np.flatnonzero(~settled), SPAN, later)
    low[settled], high[settled] = least[settled], most[settled]
    yield from cuts_told(keys, sigs, places, counts, low, high, SPAN, texts)


def _cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        data, offsets = chunk.data, chunk.offsets
        gone = cut_mask(chunk.rows.column("cuts"), offsets, len(data))
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        borders = offsets[1:-1][offsets[1:-1] < len(data)]
        first[borders] = gone[borders]
        removed, spans = totals(gone, offsets), totals(first, offsets)
        kept = data[~gone].tobytes()
        bounds = offsets - np.append(0, np.cumsum(removed))
        digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                chunk.rows.column("key"),
                pa.array(np.diff(offsets)),
                pa.array(removed),
                pa.array(spans),
                pa.array(digests, pa.string()),
            ],
            names=[part.split()[0] for part in CLEANED.split(", ")],
        )


def suffix_cuts(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(key, sig, text, cuts)``: every text with the byte ranges that an earlier one has."""
    rows = keyed(docs)
    parts = parts_for(rows, part_bytes)
    shared = recurring(rows, distinct_anchors, parts)
    # One exchange of the texts serves both joins: they meet their anchors, later their cuts.
    dealt = rows.repartition(parts, "key", "sig")
    merges = parts * MERGES_PER_PART

    def sorted_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(merges, parts, RUN_SUFFIXES)
        for chunk in chunks(batches):
            yield from runs.add(chunk)
        yield from runs.emit()

    known = dealt_like(shared, "hashes", parts)
    runs = dealt.join(known, ["key", "sig"]).mapInArrow(sorted_runs, BLOCKS)
    cuts = answers(runs, lambda blocks: _merged(blocks, parts))
    return dealt.join(dealt_like(cuts, "cuts", parts), ["key", "sig"], "left")


def suffix_dedup(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row.

    Every byte is removed that lies in a string of ``SPAN`` bytes which also starts in a document
    with a smaller id. Texts are UTF-8 bytes, null texts are empty; rows that repeat an id are not
    smaller than each other, a null id is larger than all others. Other columns are not read.
    """
    cleaned = suffix_cuts(docs, part_bytes).mapInArrow(_cleaned, CLEANED)
    return cleaned.select(id_of(), *[part.split()[0] for part in CLEANED.split(", ")[1:]])
