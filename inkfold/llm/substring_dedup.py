"""Removal of long passages that occur more than once: seeds, extended both ways.

Documents are joined on winnowed anchors of a few words. Around anchors that recur, the words
on both sides are compared, and every stretch of ``SPAN`` words that has an equal elsewhere is
removed. Members of an anchor are never paired: each side is sorted once, so that agreement with
any member shows as agreement between neighbours.
"""

import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.contexts import (
    Sides,
    cut_mask,
    cuts_told,
    dealt_like,
    only,
    repeated_range,
    room,
    totals,
)
from inkfold.llm.recurring import (
    BLOCKS,
    PART_BYTES,
    SHORT,
    answers,
    block_rows,
    id_of,
    keyed,
    pack,
    part_of,
    parts_for,
    recurring,
)
from inkfold.llm.repetition import word_ids
from inkfold.llm.words import (
    SPACE,
    Chunk,
    Piece,
    Words,
    anchors,
    at_most,
    chunks,
    find_words,
    window_hashes,
    word_hashes,
    word_pieces,
)

SPAN, GRAM = 35, 8
REACH = SPAN - GRAM
#: Seeds packed at once by a task; joins of a fraction of a part, for they carry their words.
BLOCK_SEEDS, JOINS_PER_PART = 1 << 14, 8
CLEANED = "key bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def seeds_of(chunk: Chunk, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of anchors, by word, and their hashes."""
    hashes = window_hashes(word_hashes(chunk.data, words), GRAM)
    places = anchors(hashes, words.offsets, GRAM, SPAN)
    return places, hashes[places] & SHORT


def own_seeds(piece: Piece, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a piece of text: places, hashes and the texts they are in."""
    places, hashes = seeds_of(piece.chunk, words)
    own = piece.own(places)
    return places[own], hashes[own], np.searchsorted(words.offsets, places[own], "right") - 1


def seed_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Each text's anchor hashes, twice if they repeat inside it, for repeats remove each other."""
    found = [at_most(2, *own_seeds(*piece)[1:]) for piece in word_pieces(chunk, REACH, SPAN)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(chunk.offsets) - 1, np.int64)
    hashes, texts = at_most(2, *map(np.concatenate, zip(*found, strict=True)))
    return hashes, np.bincount(texts, minlength=len(chunk.offsets) - 1)


def sorted_side(ids: np.ndarray) -> Sides:
    """Rows of word numbers in sorted order and how many leading words neighbours share."""
    order = np.lexsort(ids.T[::-1])
    differ = ids[order][1:] != ids[order][:-1]
    common = np.zeros(len(ids), np.int64)
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), ids.shape[1])
    return Sides(order, common)


class _Seeds:
    """Recurring anchors of a task's texts with the words around them, for a block per part."""

    def __init__(self, parts: int, texts: int, limit: int):
        self.parts, self.texts, self.limit, self.pending, self.size = parts, texts, limit, [], 0

    def add(self, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        """Takes the anchors whose hash recurs, some at a time: a long text has many."""
        known = [np.frombuffer(x.as_py(), np.uint64) for x in chunk.rows.column("hashes")]
        key, sig = (chunk.rows.column(name).to_numpy() for name in ("key", "sig"))
        for piece, words in word_pieces(chunk, REACH, SPAN):
            places, hashes, texts = own_seeds(piece, words)
            bounds = np.searchsorted(texts, np.arange(len(known) + 1))
            kept = [np.isin(hashes[a:b], own) for (a, b), own in zip(pairwise(bounds), known, strict=True)]
            kept = np.flatnonzero(np.concatenate(kept))
            raw = piece.chunk.data.tobytes()
            for at in range(0, len(kept), self.limit):
                own = kept[at : at + self.limit]
                self._lay(piece, words, raw, places[own], hashes[own], key[texts[own]], sig[texts[own]], texts[own])
                if self.size >= self.limit:
                    yield from self.emit()

    def _lay(self, piece: Piece, words: Words, raw: bytes, places, hashes, keys, sigs, texts) -> None:
        lows, highs = piece.bounds(words.offsets, texts)
        least, most = room(places, lows, highs, SPAN, REACH)
        useful = np.flatnonzero(least <= most)
        first = np.maximum(places - REACH, lows)[useful]
        last = np.minimum(places + SPAN, highs)[useful]
        begins, ends = words.starts[first], words.ends[last - 1]
        around = [raw[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
        self.pending.append(
            (
                part_of(hashes[useful], self.parts), keys[useful], sigs[useful], (places - lows)[useful],
                least[useful], most[useful], places[useful] - first, around,
            )
        )
        self.size += len(useful)

    def emit(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        columns = list(zip(*self.pending, strict=True))
        self.pending, self.size = [], 0
        part, keys, sigs, places, least, most, before = map(np.concatenate, columns[:-1])
        around = [text for texts in columns[-1] for text in texts]
        left, right = sides_of(around, before)
        # Neighbourhoods equal in all words: every window around them is a repeat already.
        bounds = np.stack([part.astype(np.int64), least, most], axis=1)
        whole = sorted_side(np.hstack([bounds, right, left]))
        width = bounds.shape[1] + right.shape[1] + left.shape[1]
        same = np.concatenate([[False], whole.common[1:] == width])
        group = np.cumsum(~same) - 1
        several = np.bincount(group)[group] > 1
        done = whole.order[several]
        if len(done):
            ranges = only(done, least, most, SPAN)
            yield from cuts_told(keys, sigs, places, np.ones_like(places), *ranges, SPAN, self.texts)
        # One of them goes on and stands for several.
        order, twice = whole.order[~same], several[~same]
        limits = np.searchsorted(part[order], np.arange(self.parts + 1))
        for number in np.flatnonzero(np.diff(limits)):
            own = order[limits[number] : limits[number + 1]]
            texts = [around[i] for i in own]
            block = pack(
                [
                    keys[own], sigs[own], places[own].astype(np.uint32), least[own].astype(np.uint8),
                    most[own].astype(np.uint8), before[own].astype(np.uint8),
                    twice[limits[number] : limits[number + 1]].astype(np.uint8),
                    np.array([len(t) for t in texts], np.uint32), np.frombuffer(b"".join(texts), np.uint8),
                ]
            )
            yield block_rows([number], [None], [block])


def sides_of(around: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words left of the anchors, nearest first, and from the anchors on.

    -1 stands for no word: the text ends there.
    """
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in around])]).astype(np.int64)
    data = np.frombuffer(b"".join(around), np.uint8)
    words = find_words(data, offsets)
    ids = np.append(word_ids(data, words), -1)
    at = (words.offsets[:-1] + before)[:, None]
    right = at + np.arange(SPAN)
    right = ids[np.where(right < words.offsets[1:, None], right, -1)]
    left = at - 1 - np.arange(REACH)
    left = ids[np.where(left >= words.offsets[:-1, None], left, -1)]
    return left, right


def _extended(columns: list[list[np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """All seeds of one part: which windows around them occur twice?"""
    keys, sigs, places, least, most, before, twice, sizes, letters = (
        np.concatenate(x) for x in zip(*columns, strict=True)
    )
    raw, ends = letters.tobytes(), np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    around = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    left, right = sides_of(around, before.astype(np.int64))
    weight = 1 + twice.astype(np.int64)

    least, most = least.astype(np.int64), most.astype(np.int64)

    def repeated(bounds: np.ndarray, members: np.ndarray) -> np.ndarray:
        return np.repeat(np.add.reduceat(weight[members], bounds[:-1]) > 1, np.diff(bounds))

    everyone = np.arange(len(keys))
    low, high = repeated_range(sorted_side(right), sorted_side(left), least, most, everyone, SPAN, repeated)
    yield from cuts_told(keys, sigs, places, np.ones_like(least), low, high, SPAN, parts)


def _cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        words = find_words(chunk.data, chunk.offsets)
        n = len(words.starts)
        gone = cut_mask(chunk.rows.column("cuts"), words.offsets, n)
        removed = totals(gone, words.offsets)
        # The kept words of each text, one space after each but the last.
        kept = np.flatnonzero(~gone)
        change = np.zeros(len(chunk.data) + 2, np.int8)
        change[words.starts[kept]] += 1
        change[words.ends[kept] + 1] -= 1
        padded = np.append(chunk.data, np.uint8(32))
        shown = np.cumsum(change[: len(padded)], dtype=np.int8) > 0
        shown[words.ends[kept]] = True
        padded = np.where(SPACE[padded], np.uint8(32), padded)
        digests, text_bounds = [], chunk.offsets
        for row in range(len(text_bounds) - 1):
            own = kept[np.searchsorted(kept, words.offsets[row]) : np.searchsorted(kept, words.offsets[row + 1])]
            if len(own):
                begin, end = words.starts[own[0]], words.ends[own[-1]]
                digests.append(hashlib.sha256(padded[begin:end][shown[begin:end]].tobytes()).hexdigest())
            else:
                digests.append(hashlib.sha256(b"").hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                chunk.rows.column("key"),
                pa.array(np.diff(words.offsets)),
                pa.array(removed),
                pa.array(digests, pa.string()),
            ],
            names=[part.split()[0] for part in CLEANED.split(", ")],
        )


def repeated_passages(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(key, sig, text, cuts)``: every text with the word ranges that occur twice."""
    rows = keyed(docs)
    parts = parts_for(rows, part_bytes)
    shared = recurring(rows, seed_hashes, parts)
    dealt = rows.repartition(parts, "key", "sig")

    def extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _Seeds(parts * JOINS_PER_PART, parts, BLOCK_SEEDS)
        for chunk in chunks(batches):
            yield from seeds.add(chunk)
        yield from seeds.emit()

    seeds = dealt.join(dealt_like(shared, "hashes", parts), ["key", "sig"]).mapInArrow(extended, BLOCKS)
    cuts = answers(seeds, lambda blocks: _extended(blocks, parts))
    return dealt.join(dealt_like(cuts, "cuts", parts), ["key", "sig"], "left")


def substring_dedup(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` per row.

    Every word is removed that lies in a window of ``SPAN`` words whose sequence also starts
    elsewhere, in the same text or another one; all copies go. Words are runs of anything but
    ``[\\x20\\x09-\\x0D]``. Null texts have no words; rows that repeat an id, or id and text, are
    texts of their own and repeats of each other. Other columns are not read.
    """
    cleaned = repeated_passages(docs, part_bytes).mapInArrow(_cleaned, CLEANED)
    return cleaned.select(id_of(), *[part.split()[0] for part in CLEANED.split(", ")[1:]])
