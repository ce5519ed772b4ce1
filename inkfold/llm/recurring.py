"""Which hashes do several texts share? Answered without a row per hash.

Each task packs the hashes of its texts, sorted, into one block per part of the hash space. A
part is a task that sees all its blocks at once, and tells each text which of its hashes recur.
The number of parts follows the input, so a part's size does not. Hashes that recur inside a
task are settled there, and only one witness of each is sent: what a third of all texts share
reaches its part once per block, not once per text.
"""

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.words import Chunk, chunks, mix

#: Bytes of text per part or partition.
PART_BYTES = 24 << 20
#: Bits of a hash that do when a false match costs a look, not an error: 48 of 64.
SHORT = np.uint64(0xFFFFFFFFFFFF0000)
#: Hashes packed at once by a task.
BLOCK_HASHES = 1 << 19
NO_ID = (1 << 63) - 1
_WITNESS = np.uint32(0xFFFFFFFF)

#: What tasks send to a part: ``dest`` is null in blocks that the part compares, and names the
#: group of texts that a settled block is for.
BLOCKS = "part int, dest int, block binary"
TOLD = "dest int, block binary"
ANSWERS = "key bigint, sig bigint, n bigint, copies bigint, data binary"


def row_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))


def row_sig() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``(key, sig, text)``: the id (the largest number for null) and 64 bits of a hash of the text.

    Rows that repeat an id with another text stay apart by the signature; rows equal in both
    get equal results, whichever of them an answer is joined to.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_key().alias("key"), row_sig().alias("sig"), text.alias("text"))


def id_of(key: str = "key") -> Column:
    return F.when(F.col(key) != NO_ID, F.col(key)).alias("doc_id")


def parts_for(rows: DataFrame, part_bytes: int = PART_BYTES) -> int:
    total = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    return max(1, -(-total // part_bytes))


def pack(arrays: Iterable[np.ndarray]) -> bytes:
    """Arrays, byte plane by byte plane, compressed: high planes are mostly zeros."""
    engine, packed = zstandard.ZstdCompressor(level=3), []
    for array in arrays:
        array = np.ascontiguousarray(array)
        planes = array.view(np.uint8).reshape(len(array), array.itemsize).T if len(array) else array
        packed.append((array.dtype.str, len(array), engine.compress(planes.tobytes())))
    return pickle.dumps(packed)


def unpack(block: bytes) -> list[np.ndarray]:
    engine, arrays = zstandard.ZstdDecompressor(), []
    for kind, n, data in pickle.loads(block):
        dtype = np.dtype(kind)
        planes = np.frombuffer(engine.decompress(data), np.uint8)
        if n:
            planes = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T)
        arrays.append(planes.reshape(-1).view(dtype))
    return arrays


def binaries(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of consecutive runs of ``counts`` items."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(np.asarray(counts) * data.itemsize, out=bounds[1:])
    buffers = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), buffers)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts in the order of the hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def runs_of(ordered: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal values in a sorted array, its length last."""
    if not len(ordered):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]])


def items_of(ends: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where the items of the runs ``own`` are, if run i has the ``counts[i]`` items up to ``ends[i]``."""
    size = counts[own]
    return np.repeat(ends[own] - np.cumsum(size), size) + np.arange(int(size.sum()))


class _Blocks:
    """The hashes of a task's texts until there are enough for a block per part."""

    def __init__(self, parts: int, texts: int, with_counts: bool):
        self.parts, self.texts, self.with_counts = parts, texts, with_counts
        self.clear()

    def clear(self) -> None:
        self.keys, self.sigs, self.counts, self.hashes = [], [], [], []
        self.size = 0

    def add(self, rows: pa.RecordBatch, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(rows.column("key").to_numpy())
        self.sigs.append(rows.column("sig").to_numpy())
        self.counts.append(counts)
        self.hashes.append(hashes)
        self.size += len(hashes) + len(counts)

    def emit(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, sigs = np.concatenate(self.keys), np.concatenate(self.sigs)
        counts, hashes = np.concatenate(self.counts), np.concatenate(self.hashes)
        self.clear()
        texts = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
        order = np.argsort(hashes, kind="stable")
        ordered, owners = hashes[order], texts[order]
        bounds = runs_of(ordered)
        first, sizes = bounds[:-1], np.diff(bounds)
        settled = np.repeat(sizes > 1, sizes)
        yield from self._settled(keys, sigs, counts, ordered[settled], owners[settled])
        left = ordered[first]
        owner = np.where(sizes > 1, _WITNESS, owners[first])
        limits = np.searchsorted(part_of(left, self.parts), np.arange(self.parts + 1))
        for part in np.flatnonzero(np.diff(limits)):
            own = slice(limits[part], limits[part + 1])
            real = owner[own] != _WITNESS
            used, index = np.unique(owner[own][real], return_inverse=True)
            local = np.full(len(real), _WITNESS)
            local[real] = index
            steps = np.diff(left[own], prepend=np.uint64(0))
            # Differences, for ids that follow each other and hashes in order.
            block = pack([np.diff(keys[used], prepend=0), sigs[used], steps, local])
            yield block_rows([int(part)], [None], [block])

    def _settled(self, keys, sigs, counts, hashes, owners) -> Iterator[pa.RecordBatch]:
        """Texts with the hashes known to recur, and each text's count where wanted."""
        order = np.argsort(owners, kind="stable")
        per_text = np.bincount(owners, minlength=len(counts))
        shown = np.arange(len(counts)) if self.with_counts else np.flatnonzero(per_text)
        known = counts[shown].astype(np.int64) if self.with_counts else np.full(len(shown), -1)
        yield from told(keys[shown], sigs[shown], known, per_text[shown], hashes[order], self.texts)


def block_rows(parts: list[int], dests: list[int | None], blocks: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(parts, pa.int32()), pa.array(dests, pa.int32()), pa.array(blocks, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "dest", "block"])


def told(keys, sigs, known, counts, data, parts: int) -> Iterator[pa.RecordBatch]:
    """Answers for texts, ``counts`` items of ``data`` each, in one block per group of texts."""
    dest = part_of(mix(keys.astype(np.uint64) ^ mix(sigs.astype(np.uint64))), parts).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    bounds = runs_of(dest[order])
    ends = np.cumsum(counts)
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        own = order[low:high]
        size, items = counts[own], items_of(ends, counts, own)
        number = int(dest[own[0]])
        yield block_rows([number], [number], [pack([keys[own], sigs[own], known[own], size, data[items]])])


def compared(table: pa.Table, compare: Callable[[list[list[np.ndarray]]], Iterator[pa.RecordBatch]]) -> pa.Table:
    """Blocks of one part: settled ones pass, ``compare`` answers the others."""
    settled = table.column("dest").is_valid()
    answers = [table.filter(settled).select(["dest", "block"])]
    blocks = [unpack(b.as_py()) for b in table.filter(table.column("dest").is_null()).column("block")]
    if blocks:
        batches = list(compare(blocks))
        if batches:
            answers.append(pa.Table.from_batches(batches).select(["dest", "block"]))
    return pa.concat_tables(answers)


def _gathered(table: pa.Table) -> pa.Table:
    """The answers for a group of texts, one row per text."""
    blocks = [unpack(b.as_py()) for b in table.column("block")]
    keys, sigs, known, counts, data = (np.concatenate(x) for x in zip(*blocks, strict=True))
    owners = owner_numbers(keys, sigs)
    first = np.unique(owners, return_index=True)[1]
    n = np.full(len(first), -1, np.int64)
    np.maximum.at(n, owners, known)
    of_item = np.repeat(owners, counts)
    sizes = np.bincount(of_item, minlength=len(first))
    return pa.table(
        [
            pa.array(keys[first]),
            pa.array(sigs[first]),
            pa.array(n),
            pa.array(np.bincount(owners, weights=known >= 0, minlength=len(first)).astype(np.int64)),
            binaries(data[np.argsort(of_item, kind="stable")], sizes),
        ],
        names=["key", "sig", "n", "copies", "data"],
    )


def answers(blocks: DataFrame, compare: Callable) -> DataFrame:
    """``(key, sig, n, copies, data)``: what the parts found, one row per text that has any.

    Answers travel packed, a block per part and group of texts, so their rows are not more when
    there are more parts.
    """

    def run(table: pa.Table) -> pa.Table:
        found = compared(table, compare)
        pa.default_memory_pool().release_unused()
        return found

    return blocks.groupBy("part").applyInArrow(run, TOLD).groupBy("dest").applyInArrow(_gathered, ANSWERS)


def owner_numbers(keys: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """A number for each pair of key and signature."""
    order = np.lexsort((sigs, keys))
    fresh = np.zeros(len(keys), bool)
    fresh[1:] = (np.diff(keys[order]) != 0) | (np.diff(sigs[order]) != 0)
    owners = np.empty(len(keys), np.int64)
    owners[order] = np.cumsum(fresh)
    return owners


def _met(parts: int):
    def compare(blocks: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The hashes of each text that occur again, in this block or another."""
        keys, sigs, hashes, owners, total = [], [], [], [], 0
        for key, sig, steps, owner in blocks:
            keys.append(np.cumsum(key))
            sigs.append(sig)
            hashes.append(np.cumsum(steps, dtype=np.uint64))
            owners.append(np.where(owner == _WITNESS, np.int64(-1), owner.astype(np.int64) + total))
            total += len(key)
        keys, sigs, hashes, owners = map(np.concatenate, (keys, sigs, hashes, owners))
        order = np.argsort(hashes, kind="stable")
        hashes, owners = hashes[order], owners[order]
        bounds = runs_of(hashes)
        sizes = np.diff(bounds)
        recurs = np.repeat((sizes > 1) | (owners[bounds[:-1]] < 0), sizes) & (owners >= 0)
        hashes, owners = hashes[recurs], owners[recurs]
        order = np.argsort(owners, kind="stable")
        bounds = runs_of(owners[order])
        texts = owners[order][bounds[:-1]]
        yield from told(keys[texts], sigs[texts], np.full(len(texts), -1), np.diff(bounds), hashes[order], parts)

    return compare


def recurring(
    rows: DataFrame,
    hashes_of: Callable[[Chunk], tuple[np.ndarray, np.ndarray]],
    parts: int,
    with_counts: bool = False,
    hash_parts: int = 1,
) -> DataFrame:
    """``(key, sig, n, copies, data)``: the hashes of each text that occur at least twice anywhere.

    ``rows`` is ``keyed``; ``hashes_of`` gives the hashes of a chunk's texts, text by text, and
    how many each text has; ``parts`` is the number of groups of texts, ``hash_parts`` how many
    parts of the hash space there are for each. With ``with_counts``, texts that share nothing have a row as well,
    ``n`` is how many hashes a text has, and ``copies`` how many rows are equal in id and text.
    """

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(parts * hash_parts, parts, with_counts)
        for chunk in chunks(batches):
            blocks.add(chunk.rows, *hashes_of(chunk))
            if blocks.size >= BLOCK_HASHES:
                yield from blocks.emit()
        yield from blocks.emit()

    return answers(rows.mapInArrow(packed, BLOCKS), _met(parts))
