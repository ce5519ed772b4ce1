"""Texts of Arrow batches as numpy arrays: bytes, words and rolling hashes.

Everything here works on a slice of a batch at a time, so that memory stays bounded whatever
the number of rows per batch; only a single text is never cut.
"""

from collections.abc import Iterable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Arrays of so many numbers stay in a core's cache.
CHUNK_BYTES = 1 << 18
#: Longer texts are worked on in stretches of so many bytes, with what surrounds them.
PIECE_BYTES = 1 << 20
_U64 = np.uint64
#: Whitespace of all word rules here: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _splitmix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


mix = _splitmix
_BYTE_CODES = _splitmix(np.arange(1, 257, dtype=_U64) * _U64(0x9E3779B97F4A7C15))
_RADIX = 0x9E3779B97F4A7C15 | 1
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)


class Chunk(NamedTuple):
    """Texts ``data[offsets[i]:offsets[i + 1]]`` and the rows they came from."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray


def chunks(
    batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[Chunk]:
    """Runs of whole rows with about ``limit`` bytes of text; null texts are empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            part = pc.fill_null(column.slice(at, to - at), "").cast(pa.large_string())
            offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset :][: len(part) + 1]
            buffer = part.buffers()[2]
            data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
            yield Chunk(
                batch.slice(at, to - at), data[offsets[0] : offsets[-1]], offsets - offsets[0]
            )
            at = to
        # Workers live on from stage to stage: what a batch took goes back to the machine.
        del batch, column
        pa.default_memory_pool().release_unused()


class Words(NamedTuple):
    """Byte ranges of words, and ``offsets``: those of text i are ``offsets[i]:offsets[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes other than whitespace; words never cross texts."""
    inner = ~SPACE[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    borders = offsets[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    first[borders] = inner[borders]
    last[borders - 1] = inner[borders - 1]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


class Piece(NamedTuple):
    """Some texts, or a stretch of a long one: items (bytes or words) ``begin`` to ``end`` and
    those around them. ``before`` items of the text come earlier; it has ``size`` in all.
    """

    chunk: Chunk
    begin: int
    end: int
    before: int = 0
    size: int | None = None

    def own(self, places: np.ndarray) -> np.ndarray:
        return (self.begin <= places) & (places < self.end)

    def bounds(self, offsets: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where these texts begin and end, in items of this piece, however far outside."""
        if self.size is None:
            return offsets[texts], offsets[texts + 1]
        return np.full(len(texts), -self.before), np.full(len(texts), self.size - self.before)


def byte_pieces(chunk: Chunk, left: int, right: int) -> Iterator[Piece]:
    """The chunk, or its one long text in stretches with so many bytes on either side."""
    n = len(chunk.data)
    if n <= PIECE_BYTES or len(chunk.offsets) != 2:
        yield Piece(chunk, 0, n)
        return
    for begin in range(0, n, PIECE_BYTES):
        end = min(n, begin + PIECE_BYTES)
        low, high = max(0, begin - left), min(n, end + right)
        part = Chunk(chunk.rows, chunk.data[low:high], np.array([0, high - low]))
        yield Piece(part, begin - low, end - low, low, n)


def word_pieces(chunk: Chunk, left: int, right: int) -> Iterator[tuple[Piece, Words]]:
    """The same by words, each piece with its words."""
    n = len(chunk.data)
    if n <= PIECE_BYTES or len(chunk.offsets) != 2:
        words = find_words(chunk.data, chunk.offsets)
        yield Piece(chunk, 0, len(words.starts)), words
        return
    starts = []
    for at in range(0, n, PIECE_BYTES):
        inner = ~SPACE[chunk.data[max(0, at - 1) : at + PIECE_BYTES]]
        if not at:
            inner = np.append(False, inner)
        starts.append(np.flatnonzero(inner[1:] & ~inner[:-1]) + at)
    starts = np.concatenate(starts)
    for begin, end in pairwise(np.unique(np.searchsorted(starts, np.arange(0, n + PIECE_BYTES, PIECE_BYTES)))):
        low, high = max(0, begin - left), min(len(starts), end + right)
        data = chunk.data[starts[low] : starts[high] if high < len(starts) else n]
        part = Chunk(chunk.rows, data, np.array([0, len(data)]))
        yield Piece(part, begin - low, end - low, low, len(starts)), find_words(part.data, part.offsets)


def at_most(times: int, hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes, sorted, each of them no more than so many times, with their texts."""
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    kept = np.ones(len(order), bool)
    kept[times:] = (hashes[times:] != hashes[:-times]) | (texts[times:] != texts[:-times])
    return hashes[kept], texts[kept]


_powers = {"radix": np.ones(1, _U64), "inverse": np.ones(1, _U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers of the radix or its inverse, kept for the next chunk."""
    known = _powers[kind]
    if len(known) < n:
        base = _RADIX if kind == "radix" else _RADIX_INVERSE
        steps = np.full(1 << (n - 1).bit_length(), base, _U64)
        steps[0] = 1
        known = _powers[kind] = np.multiply.accumulate(steps)
    return known[:n]


def rolling_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``range_hashes`` gets the hash of any byte range."""
    sums = np.zeros(len(data) + 1, _U64)
    np.cumsum(_BYTE_CODES[data] * _power("radix", len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, by content alone."""
    inverse = _power("inverse", len(sums))
    lengths = (ends - starts).astype(_U64)
    return _splitmix((sums[ends] - sums[starts]) * inverse[starts] + lengths)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hashes of words, by content alone; a few stretches at a time if there is much."""
    if len(data) <= 2 * PIECE_BYTES:
        return range_hashes(rolling_sums(data), words.starts, words.ends)
    hashes = np.empty(len(words.starts), _U64)
    cuts = np.unique(np.searchsorted(words.starts, np.arange(0, len(data) + PIECE_BYTES, PIECE_BYTES)))
    for a, b in pairwise(cuts):
        # Only the last word that starts in a stretch can be longer than it.
        if words.ends[b - 1] - words.starts[b - 1] > PIECE_BYTES:
            hashes[b - 1] = _long_hash(data[words.starts[b - 1] : words.ends[b - 1]])
            b -= 1
        if a < b:
            base = words.starts[a]
            sums = rolling_sums(data[base : words.ends[b - 1]])
            hashes[a:b] = range_hashes(sums, words.starts[a:b] - base, words.ends[a:b] - base)
    return hashes


def _long_hash(data: np.ndarray) -> np.uint64:
    """What ``range_hashes`` gives for all of ``data``."""
    total = len(data)
    for at in range(0, len(data), CHUNK_BYTES):
        part = data[at : at + CHUNK_BYTES]
        sums = (_BYTE_CODES[part] * _power("radix", len(part))).sum(dtype=_U64)
        total += int(sums) * pow(_RADIX, at, 1 << 64)
    return _splitmix(np.array([total % (1 << 64)], _U64))[0]


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every ``width`` values in a row, in order; fewer values give none."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    total = np.zeros(n, _U64)
    for i in range(width):
        total = total * _U64(_RADIX) + values[i : i + n]
    return _splitmix(total)


def inside(offsets: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the n window starts whose ``width`` items lie in one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + width <= ends


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(hashes: np.ndarray, offsets: np.ndarray, gram: int, span: int) -> np.ndarray:
    """Winnowing: starts of grams that are the least of some window of ``span`` items.

    ``hashes[i]`` depends on nothing but the ``gram`` items from item i on. Every window of
    ``span`` items inside one text holds an anchor, and equal windows hold the same ones: all
    grams that share the least hash are taken.
    """
    width, n = span - gram + 1, len(hashes)
    windows = n - width + 1
    if windows <= 0:
        return np.zeros(0, np.int64)
    hashes = np.maximum(hashes, 1)  # 0 stands for windows that leave their text
    least = _sliding(hashes, width, np.minimum) * inside(offsets, span, windows)
    pad = np.zeros(width - 1, hashes.dtype)
    most = _sliding(np.concatenate([pad, least.astype(hashes.dtype), pad]), width, np.maximum)
    return np.flatnonzero(most == hashes)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number; the last seven positions have none."""
    data = np.ascontiguousarray(data)
    return np.ndarray(max(0, len(data) - 7), np.dtype("<u8"), data, strides=(1,)) if len(data) > 7 else np.zeros(0, _U64)


def gram_hashes(data: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes (8 or more) from each place on."""
    numbers, total = eights(data), np.zeros(len(places), _U64)
    for at in [*range(0, width - 8, 8), width - 8]:
        total = _splitmix(total * _U64(_RADIX) + numbers[places + at])
    return total
