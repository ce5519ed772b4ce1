"""Which hashes do several texts share, and how many texts hold each? Without a row per hash.

As in ``recurring``, tasks pack the hashes of their texts into one block per part of the hash
space, and settle those that recur among their own texts. What they send of a settled hash is one
witness: how many texts of the block hold it, and which groups of texts these are in. The part adds
the counts up and tells each group the total, once per group and not once per text.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.recurring import BLOCK_HASHES, BLOCKS, TOLD, block_rows, owner_numbers, pack, part_of, runs_of, unpack
from inkfold.llm.words import Chunk, chunks, mix

#: Owner of a hash that a block has settled, and the count of one whose total is told separately.
WITNESS, UNKNOWN = np.uint32(0xFFFFFFFF), 0


def group_of(keys: np.ndarray, sigs: np.ndarray, groups: int) -> np.ndarray:
    """The group that puts the answers for a text together."""
    return part_of(mix(keys.astype(np.uint64) ^ mix(sigs.astype(np.uint64))), groups).astype(np.int64)


def _slices(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number with the places it stands at."""
    order = np.argsort(numbers, kind="stable")
    bounds = runs_of(numbers[order])
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(numbers[order[low]]), order[low:high]


def _of_runs(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the items of some runs, given where each ends and how many it has."""
    return np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(int(sizes.sum()))


class _Blocks:
    """The hashes of a task's texts until there are enough for a block per part."""

    def __init__(self, parts: int, groups: int):
        self.parts, self.groups = parts, groups
        self.clear()

    def clear(self) -> None:
        self.keys, self.sigs, self.counts, self.hashes, self.size = [], [], [], [], 0

    def add(self, rows: pa.RecordBatch, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(rows.column("key").to_numpy())
        self.sigs.append(rows.column("sig").to_numpy())
        self.counts.append(counts)
        self.hashes.append(hashes)
        self.size += len(hashes) + len(counts)

    def emit(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, sigs, counts, hashes = map(np.concatenate, (self.keys, self.sigs, self.counts, self.hashes))
        self.clear()
        groups = group_of(keys, sigs, self.groups)
        order = np.argsort(hashes, kind="stable")
        ordered, owners = hashes[order], np.repeat(np.arange(len(counts), dtype=np.uint32), counts)[order]
        bounds = runs_of(ordered)
        first, sizes = bounds[:-1], np.diff(bounds)
        settled = np.repeat(sizes > 1, sizes)
        yield from _settled(keys, sigs, counts, groups, ordered[settled], owners[settled])
        left, owner = ordered[first], np.where(sizes > 1, WITNESS, owners[first])
        # Of each settled hash, the groups of its texts: pairs in the order of the hashes.
        run = np.repeat(np.arange(len(first)), sizes)[settled]
        pairs = np.unique(run * self.groups + groups[owners[settled]])
        told = np.bincount(pairs // self.groups, minlength=len(first))
        ends, whom = np.cumsum(told), (pairs % self.groups).astype(np.uint32)
        limits = np.searchsorted(part_of(left, self.parts), np.arange(self.parts + 1))
        for part in np.flatnonzero(np.diff(limits)):
            own = slice(limits[part], limits[part + 1])
            real = owner[own] != WITNESS
            used, index = np.unique(owner[own][real], return_inverse=True)
            local = np.full(len(real), WITNESS)
            local[real] = index
            own_whom = whom[ends[own.start] - told[own.start] : ends[own.stop - 1]]
            # Differences, for ids that follow each other and hashes in order.
            block = pack(
                [
                    np.diff(keys[used], prepend=0), sigs[used], np.diff(left[own], prepend=np.uint64(0)), local,
                    sizes[own][~real].astype(np.uint32), told[own][~real].astype(np.uint32), own_whom,
                ]
            )
            yield block_rows([int(part)], [None], [block])


def _settled(keys, sigs, counts, groups, hashes, owners) -> Iterator[pa.RecordBatch]:
    """Every text of a block: how many hashes it has, and those known to recur."""
    order = np.argsort(owners, kind="stable")
    per_text = np.bincount(owners, minlength=len(counts))
    yield from _told(keys, sigs, counts.astype(np.int64), groups, per_text, hashes[order], np.full(len(order), UNKNOWN))


def _told(keys, sigs, known, groups, sizes, hashes, totals) -> Iterator[pa.RecordBatch]:
    """Answers for texts, ``sizes`` hashes each, in one block per group of texts."""
    ends = np.cumsum(sizes)
    for group, own in _slices(groups):
        items = _of_runs(ends[own], sizes[own])
        block = pack([keys[own], sigs[own], known[own], sizes[own], hashes[items], totals[items].astype(np.uint32)])
        yield block_rows([group], [group], [block])


def _counted(groups: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Blocks of one part: settled ones pass, the others are counted together."""
        settled = table.column("dest").is_valid()
        batches = [*table.filter(settled).select(["dest", "block"]).to_batches()]
        blocks = [unpack(b.as_py()) for b in table.filter(table.column("dest").is_null()).column("block")]
        if blocks:
            batches += [b.select(["dest", "block"]) for b in _totals(blocks, groups)]
        del blocks
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(batches, pa.schema([("dest", pa.int32()), ("block", pa.binary())]))

    return run


def _totals(blocks: list[list[np.ndarray]], groups: int) -> Iterator[pa.RecordBatch]:
    keys, sigs, hashes, owners, sizes, told, whom, total = [], [], [], [], [], [], [], 0
    for key, sig, steps, owner, size, to, whom_of in blocks:
        witness = owner == WITNESS
        keys.append(np.cumsum(key))
        sigs.append(sig)
        hashes.append(np.cumsum(steps, dtype=np.uint64))
        owners.append(np.where(witness, np.int64(-1), owner.astype(np.int64) + total))
        sizes.append(np.ones(len(owner), np.int64))
        sizes[-1][witness] = size
        told.append(np.zeros(len(owner), np.int64))
        told[-1][witness] = to
        whom.append(whom_of)
        total += len(key)
    keys, sigs, hashes, owners, sizes, told, whom = map(
        np.concatenate, (keys, sigs, hashes, owners, sizes, told, whom)
    )
    order = np.argsort(hashes, kind="stable")
    bounds = runs_of(hashes[order])
    in_all = np.add.reduceat(sizes[order], bounds[:-1])
    totals = np.empty(len(hashes), np.int64)
    totals[order] = np.repeat(in_all, np.diff(bounds))
    # Texts that hold a hash alone in their block, and share it with another block.
    real = np.flatnonzero((owners >= 0) & (totals > 1))
    real = real[np.argsort(owners[real], kind="stable")]
    bounds = runs_of(owners[real])
    texts = owners[real][bounds[:-1]]
    unknown = np.full(len(texts), -1)
    yield from _told(
        keys[texts], sigs[texts], unknown, group_of(keys[texts], sigs[texts], groups), np.diff(bounds),
        hashes[real], totals[real],
    )
    # Totals of settled hashes, for each group that has texts with them.
    entry = np.repeat(np.arange(len(hashes)), told)
    for group, own in _slices(whom.astype(np.int64)):
        found, at = np.unique(hashes[entry[own]], return_index=True)
        block = pack([found, totals[entry[own][at]].astype(np.uint32)])
        yield block_rows([group], [group], [block])


class Gathered:
    """The texts of a group: id, signature, size, copies, and shared hashes with their totals."""

    def __init__(self, table: pa.Table):
        blocks = [unpack(b.as_py()) for b in table.column("block")]
        keys, sigs, known, sizes, hashes, totals = map(
            np.concatenate, zip(*(b for b in blocks if len(b) == 6), strict=True)
        )
        lists = [b for b in blocks if len(b) == 2]
        if lists:
            listed, counts = map(np.concatenate, zip(*lists, strict=True))
            order = np.argsort(listed, kind="stable")
            ask = np.flatnonzero(totals == UNKNOWN)
            totals[ask] = counts[order][np.searchsorted(listed[order], hashes[ask])]
        owners = owner_numbers(keys, sigs)
        first = np.unique(owners, return_index=True)[1]
        self.keys, self.sigs = keys[first], sigs[first]
        self.n = np.full(len(first), -1, np.int64)
        np.maximum.at(self.n, owners, known)
        self.copies = np.bincount(owners, weights=known >= 0, minlength=len(first)).astype(np.int64)
        of_item = np.repeat(owners, sizes)
        # Hashes of a text in order, once each: rows equal in id and text bring them several times.
        order = np.lexsort((hashes, of_item))
        of_item, hashes, totals = of_item[order], hashes[order], totals[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (of_item[1:] != of_item[:-1]) | (hashes[1:] != hashes[:-1])
        self.hashes, self.totals = hashes[fresh], totals[fresh]
        self.bounds = np.searchsorted(of_item[fresh], np.arange(len(first) + 1))


def counted(
    rows: DataFrame,
    hashes_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]],
    groups: int,
    parts: int,
    assemble: Callable[[Gathered], pa.Table],
    schema: str,
) -> DataFrame:
    """What ``assemble`` makes of each group of texts; every text is in one group.

    ``rows`` is ``keyed``; ``hashes_of`` gives the hashes of a chunk's texts, text by text, and how
    many each text has. A hash that texts share comes with the number of texts that have it, rows
    that repeat a text counted too. That number is the same for all.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(parts, groups)
        for chunk in chunks(batches):
            blocks.add(chunk.rows, *hashes_of(chunk))
            if blocks.size >= BLOCK_HASHES:
                yield from blocks.emit()
        yield from blocks.emit()
        pa.default_memory_pool().release_unused()

    def gathered(table: pa.Table) -> pa.Table:
        made = assemble(Gathered(table))
        pa.default_memory_pool().release_unused()
        return made

    blocks = rows.mapInArrow(packed, BLOCKS).groupBy("part").applyInArrow(_counted(groups), TOLD)
    return blocks.groupBy("dest").applyInArrow(gathered, schema)
