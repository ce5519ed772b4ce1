"""Runs: stretches of words that repeat with a period, at least four times over.

Every run has a root, a Lyndon word in one of the two orders of the words, that is the longest one from
where it starts. So the longest Lyndon word at each place is a candidate period, and the longest
common extensions of its two ends, to the right and to the left, tell how far that period reaches.
Extensions are string depths of lowest common ancestors in Ukkonen's suffix trees of the words and of
the words backwards: the least depth on an Euler tour between two leaves, looked up in constant time.

A sieve comes first: each three words in a row of a run occur three times or more in their document,
so trees are built only for stretches of such words, which no run leaves.
"""

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkfold.llm.recurring import runs_of
from inkfold.llm.words import Chunk, Words, chunks, find_words, inside, mix, window_hashes, word_hashes

#: A run has so many words, and so many times its period, at least.
MIN_WORDS, MIN_EXPONENT = 6, 4
GRAM, GRAM_COUNT = 3, 3
#: Words that one pair of trees is built for, unless a period asks for more: see ``windows``.
TREE_WORDS = 1 << 16
RUNS = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, "
    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


class SuffixTree:
    """Ukkonen's tree of a text of numbers from 1, made ready for common extensions."""

    def __init__(self, symbols: np.ndarray):
        text = [*symbols.tolist(), 0]  # 0 ends the text and comes before all others
        self.size, base = len(text), max(text) + 1
        start, end, edges = self._grown(text, base)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        below = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        self._keys, self._below, self._base, self._nodes = keys[order], below[order], base, len(start)
        self._lengths = np.array(end) - np.array(start)
        tour, depth = self._euler_tour()
        depth = np.array(depth, np.int32)
        leaf = np.ones(self._nodes, bool)
        leaf[self._keys // base] = False
        along = np.array(tour)
        at = np.flatnonzero(leaf[along])
        self.first = np.empty(self.size, np.int64)
        self.first[self.size - depth[along[at]]] = at
        self._depth = depth
        # Least depths of ranges of 1, 2, 4, ... steps of the tour.
        self._least = [depth[along]]
        while 2 << len(self._least) - 1 <= len(along):
            last, step = self._least[-1], 1 << len(self._least) - 1
            self._least.append(np.minimum(last[:-step], last[step:]))

    @staticmethod
    def _grown(text: list[int], base: int) -> tuple[list[int], list[int], dict[int, int]]:
        """Where the edge into each node starts and ends, and edges by node and first symbol."""
        n = len(text)
        start, end, link, edges = [0], [0], [0], {}
        node = edge = length = left = 0
        for i, symbol in enumerate(text):
            waiting = 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    middle = start[child] + length
                    if text[middle] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    split = len(start)
                    start += (start[child], i)
                    end += (middle, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * base + symbol] = split + 1
                    edges[split * base + text[middle]] = child
                    start[child] = middle
                    if waiting:
                        link[waiting] = split
                    waiting = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        return start, end, edges

    def _children(self, keys: np.ndarray, below: np.ndarray) -> tuple[list[int], list[int]]:
        bounds = np.searchsorted(keys // self._base, np.arange(self._nodes + 1))
        return bounds.tolist(), below.tolist()

    def _euler_tour(self) -> tuple[list[int], list[int]]:
        """Nodes in the order of a walk around the tree, and the string depth of each node."""
        bounds, below = self._children(self._keys, self._below)
        lengths, place, depth = self._lengths.tolist(), bounds[:-1], [0] * self._nodes
        ends = bounds[1:]
        tour, path = [], [0]
        while path:
            node = path[-1]
            tour.append(node)
            at = place[node]
            if at < ends[node]:
                place[node] = at + 1
                child = below[at]
                depth[child] = depth[node] + lengths[child]
                path.append(child)
            else:
                path.pop()
        return tour, depth

    def ranks(self, backwards: bool = False) -> np.ndarray:
        """Places of the suffixes in order; ``backwards`` turns the order of symbols, not that of the end."""
        if not backwards:
            return np.argsort(np.argsort(self.first))
        symbol = self._keys % self._base
        order = np.argsort(self._keys - symbol + np.where(symbol > 0, self._base - symbol, 0))
        bounds, below = self._children(self._keys[order], self._below[order])
        found, path = [], [0]
        while path:
            node = path.pop()
            low, high = bounds[node], bounds[node + 1]
            if low == high:
                found.append(node)
            else:
                path += below[low:high][::-1]
        ranks = np.empty(self.size, np.int64)
        ranks[self.size - self._depth[found]] = np.arange(self.size)
        return ranks

    def extensions(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the text has in common from places a and b on; places of a pair differ."""
        low, high = self.first[a], self.first[b]
        low, high = np.minimum(low, high), np.maximum(low, high) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            own = level == k
            least = self._least[k]
            out[own] = np.minimum(least[low[own]], least[high[own] - (1 << int(k))])
        return out


def next_smaller(ranks: list[int]) -> list[int]:
    """For each place the next one whose suffix is smaller: there its longest Lyndon word ends."""
    following, open_places = [len(ranks)] * len(ranks), []
    for i, rank in enumerate(ranks):
        while open_places and ranks[open_places[-1]] > rank:
            following[open_places.pop()] = i
        open_places.append(i)
    return following


def maximal_runs(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``MIN_EXPONENT`` periods or more, in order."""
    n = len(symbols)
    symbols = np.unique(symbols, return_inverse=True)[1] + 1
    right, left = SuffixTree(symbols), SuffixTree(symbols[::-1])
    found = []
    for backwards in (False, True):
        ranks = right.ranks(backwards)[:n]
        ends = np.array(next_smaller(ranks.tolist()))
        i = np.flatnonzero(ends < n)
        j = ends[i]
        # Place i - 1 of the text is place n - i of the text backwards.
        low, high = i - left.extensions(n - i, n - j), j + right.extensions(i, j)
        own = high - low >= MIN_EXPONENT * (j - i)
        found.append(np.column_stack([low, high - low, j - i])[own])
    return np.unique(np.concatenate(found), axis=0)


def longest_period(symbols: np.ndarray) -> int:
    """No run has a period above this one.

    A window of at least a period's words recurs in its run at that distance and at no lesser one. So a
    period between half a width and the width shows as a distance between equal windows of that width.
    """
    hashes, most, width = mix(symbols.astype(np.uint64) + np.uint64(1)), 0, 1
    while width < len(symbols):
        windows = window_hashes(hashes, 1) if width == 1 else mix(windows[: -(width // 2)] * np.uint64(3) + windows[width // 2 :])
        order = np.argsort(windows, kind="stable")
        away = np.diff(order)[windows[order][1:] == windows[order][:-1]]
        away = away[(away <= width) & (2 * away > width)]
        most = max(most, int(away.max(initial=0)))
        width *= 2
    return most


def windows(n: int, period: int, words: int) -> list[tuple[int, int]]:
    """Half-overlapping stretches of ``words``, or of 16 periods if these are longer.

    Half a stretch holds eight periods, so each end of a run lies in a stretch that holds four of them.
    """
    size = max(words, 4 * MIN_EXPONENT * period)
    if n <= size:
        return [(0, n)]
    return [(at, min(at + size, n)) for at in range(0, n - size // 2, size // 2)]


def runs_in(symbols: np.ndarray) -> np.ndarray:
    """``maximal_runs`` with trees of a bounded size, unless the text has longer periods.

    Pieces of a run found in neighbouring stretches overlap by a period or more, and two runs of one
    period never do.
    """
    n = len(symbols)
    if n <= TREE_WORDS:
        found = maximal_runs(symbols)
    else:
        pieces = [
            maximal_runs(symbols[low:high]) + np.array([low, 0, 0])
            for low, high in windows(n, longest_period(symbols), TREE_WORDS)
        ]
        joined: list[list[int]] = []
        for start, length, period in sorted(map(tuple, np.concatenate(pieces).tolist()), key=lambda p: (p[2], p[0])):
            last = joined[-1] if joined else None
            if last and last[2] == period and start + period <= last[0] + last[1]:
                last[1] = max(last[1], start + length - last[0])
            else:
                joined.append([start, length, period])
        found = np.array(sorted(joined), np.int64).reshape(-1, 3)
    return found[found[:, 1] >= MIN_WORDS]


def stretches(symbols: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words, each within a text, outside of which there is no run."""
    grams = window_hashes(mix(symbols.astype(np.uint64) + np.uint64(1)), GRAM)
    if not len(grams):
        return []
    text = np.searchsorted(offsets, np.arange(len(grams)), "right")
    grams = mix(grams ^ mix(text.astype(np.uint64)))
    order = np.argsort(grams, kind="stable")
    bounds = runs_of(grams[order])
    often = np.zeros(len(grams), bool)
    often[order] = np.repeat(np.diff(bounds) >= GRAM_COUNT, np.diff(bounds))
    often &= inside(offsets, GRAM, len(grams))
    steps = np.diff(np.concatenate([[False], often, [False]]).astype(np.int8))
    low, high = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) + GRAM - 1
    own = high - low >= MIN_WORDS
    return list(zip(low[own].tolist(), high[own].tolist(), strict=True))


def source_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place of a document that is made periodic; None for others.

    With h the checksum of the id, tenths of the documents repeat, from word h / 10 mod n on, what
    follows there. A row without an id stays as it is.
    """
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def _symbols(chunk: Chunk, words: Words) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Numbers for the words of a chunk, equal for equal words; and where made periodic, their places."""
    symbols = np.unique(word_hashes(chunk.data, words), return_inverse=True)[1]
    moved = {}
    for i, doc_id in enumerate(chunk.rows.column("doc_id").to_pylist()):
        low, high = words.offsets[i], words.offsets[i + 1]
        places = source_words(doc_id, int(high - low))
        if places is not None:
            moved[i] = places
            symbols[low:high] = symbols[low:high][places]
    return symbols, moved


def _strongest(runs: list[list[int]]) -> list[int]:
    best = runs[0]
    for run in runs[1:]:  # in order of start and period, so ties stay with the first
        if run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        words = find_words(chunk.data, chunk.offsets)
        symbols, moved = _symbols(chunk, words)
        runs: dict[int, list[list[int]]] = {}
        for low, high in stretches(symbols, words.offsets):
            i = int(np.searchsorted(words.offsets, low, "right")) - 1
            found = runs_in(symbols[low:high]) + np.array([low - words.offsets[i], 0, 0])
            runs.setdefault(i, []).extend(found.tolist())
        rows = []
        for i in range(len(chunk.offsets) - 1):
            n, own = int(words.offsets[i + 1] - words.offsets[i]), runs.get(i, [])
            # Bytes split at the whitespace that parts words here.
            held = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes().split()
            if i in moved:
                held = [held[k] for k in moved[i].tolist()]
            if own:
                steps = np.zeros(n + 1, np.int64)
                for start, length, period in own:
                    steps[start + period] += 1
                    steps[start + length] -= 1
                held = [held[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
            best = _strongest(own) if own else None
            listed = "".join(f"{s},{length},{p}\n" for s, length, p in own)
            rows.append(
                (
                    n, len(own), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(held)).hexdigest(),
                )
            )
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        names = [x.split()[0] for x in RUNS.split(", ")]
        yield pa.RecordBatch.from_arrays([chunk.rows.column("doc_id"), *columns], names=names)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of each document and what is left of it when each keeps its first period.

    ``(doc_id, n_words, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256)``, one row per row. Words are runs of anything but ``[\\x20\\x09-\\x0D]``; a tenth of
    the documents is made periodic first, see ``source_words``. A run has ``MIN_WORDS`` words and
    ``MIN_EXPONENT`` periods or more, and no neighbouring word continues it. The four columns after
    ``n_runs`` are those of the run with the most periods (then the least start, then period), null
    without a run. Null and empty texts have no words and no runs. Repeated rows have a row each. Other
    columns are not read.

    Words of a text are told apart by 64 bits of a hash. A text is worked on whole, in some 80 bytes a
    word; trees take some 1,000 bytes a word of a stretch, and a stretch is cut into windows of
    ``TREE_WORDS``, or of 16 times the longest period that it may have.
    """
    return docs.select("doc_id", "text").mapInArrow(scored, RUNS)
