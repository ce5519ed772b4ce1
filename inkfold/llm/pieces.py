"""Encoding into sentence pieces with the best segmentations, and decoding.

Scores of a segmentation are sums of its pieces' scores. Forward Viterbi scores over the piece
lattice are computed for many words at once; they are exact heuristics for an A-star search that
runs backward from the end of a word and pops its segmentations best first.
"""

import hashlib
import heapq
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.words import chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands for a space inside pieces.
MARK = "▁"
N_BEST = 4
#: Words whose segmentations a task remembers; beyond that it starts anew.
REMEMBERED = 200_000
ENCODED = (
    "doc_id bigint, n_pieces bigint, score double, ids_sha256 string, n_segmentations int, "
    "scores array<double>, nbest_sha256 string, round_trip boolean"
)


class Vocabulary(NamedTuple):
    ids: dict[str, int]
    #: Whole numbers, a millionth each: sums are exact in any order.
    scores: np.ndarray
    #: UTF-8 of each piece as it is decoded.
    decoded: list[bytes]
    #: Id of the piece of each byte, for characters that no piece has.
    byte_ids: list[int]
    byte_score: int
    longest: int
    #: ASCII bytes that no piece holds; space counts as the mark.
    foreign: np.ndarray


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a model file; the model itself is never changed or trained.

    Scores of a unigram model are log-probabilities and stay as they are. Those of a merge model
    are ranks, which Zipf's law turns into log-probabilities: rank r weighs 1 / (r + 2).
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, decoded, byte_ids = {}, [], [0] * 256
    raw = np.array([model.get_score(i) for i in range(model.vocab_size())])
    if (raw == np.round(raw)).all():
        raw = -np.log(2 - np.minimum(raw, 0))
    scores = np.round(raw * 1e6).astype(np.int64)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            decoded.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            decoded.append(b"")
        else:
            ids[piece] = i
            decoded.append(piece.replace(MARK, " ").encode())
    if any(MARK in piece.lstrip(MARK) for piece in ids):
        raise ValueError("a piece crosses the start of a word")
    letters = {c for piece in ids for c in piece}
    foreign = np.array([i < 128 and chr(i) not in letters and i != 32 for i in range(256)])
    # Bytes are the last resort: less likely than any piece.
    byte_score = 2 * int(scores[list(ids.values())].min())
    return Vocabulary(ids, scores, decoded, byte_ids, byte_score, max(map(len, ids)), foreign)


class _Finder:
    """Ids of pieces by the hash of their characters: -1 for none, -2 where some piece goes on."""

    def __init__(self, vocab: Vocabulary):
        starts = {piece[:i]: -2 for piece in vocab.ids for i in range(1, len(piece))}
        left = {_hash_of(text): i for text, i in (starts | vocab.ids).items()}
        if len(left) < len(starts | vocab.ids):
            raise ValueError("pieces with equal hashes")
        self.tables = []
        for bits in (17, 15, 13, 12, 12, 12):
            keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            rest = {}
            for code, i in left.items():
                slot = code >> (64 - bits)
                if values[slot] == -1:
                    keys[slot], values[slot] = code, i
                else:
                    rest[code] = i
            self.tables.append((np.uint64(64 - bits), keys, values))
            left = {(code * int(_RADIX)) & 0xFFFFFFFFFFFFFFFF: i for code, i in rest.items()}
            if not left:
                return
        raise ValueError("too many pieces")

    def find(self, codes: np.ndarray) -> np.ndarray:
        found = np.full(len(codes), -1, np.int32)
        for shift, keys, values in self.tables:
            slot = codes >> shift
            hit = keys[slot] == codes
            found[hit] = values[slot[hit]]
            codes = codes * _RADIX
        return found


_RADIX = np.uint64(0x9E3779B97F4A7C15)


def _hash_of(piece: str) -> int:
    code = 0
    for c in piece:
        code = ((code + ord(c)) * int(_RADIX)) & 0xFFFFFFFFFFFFFFFF
    return code


class Lattice(NamedTuple):
    """The pieces of a word by where they end: those of position e are ``bounds[e]:bounds[e + 1]``.

    ``starts`` and ``ids`` say where a piece starts and which it is; -1 stands for the bytes of a character
    that is no piece. ``ahead`` is the best score of any segmentation up to a position (Viterbi).
    """

    unit: str
    bounds: Sequence[int]
    starts: Sequence[int]
    ids: Sequence[int]
    scores: Sequence[int]
    ahead: Sequence[int]


#: Positions whose pieces are looked up at once.
POSITIONS_AT_ONCE = 1 << 16


def lattice(unit: str, vocab: Vocabulary) -> Lattice:
    """All pieces of a short word."""
    edges: list[list[tuple[int, int, int]]] = [[] for _ in range(len(unit) + 1)]
    for start in range(len(unit)):
        for end in range(start + 1, min(len(unit), start + vocab.longest) + 1):
            piece = vocab.ids.get(unit[start:end])
            if piece is not None:
                edges[end].append((start, piece, int(vocab.scores[piece])))
        if unit[start] not in vocab.ids:
            edges[start + 1].append((start, -1, vocab.byte_score * _width(unit[start])))
    flat = [edge for own in edges for edge in own]
    bounds = [0, *accumulate(map(len, edges))]
    return _scored(unit, bounds, *([edge[k] for edge in flat] for k in range(3)))


def long_lattice(unit: str, vocab: Vocabulary, finder: _Finder) -> Lattice:
    """The same in arrays, some 60 bytes for each character."""
    letters = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    none = np.zeros(0, np.int32)
    ends, starts, ids, scores = [none], [none], [none], [np.zeros(0, np.int64)]
    for low in range(0, len(unit), POSITIONS_AT_ONCE):
        at = np.arange(low, min(low + POSITIONS_AT_ONCE, len(unit)))
        code = np.zeros(len(at), np.uint64)
        for length in range(1, vocab.longest + 1):
            inside = at + length <= len(unit)
            at, code = at[inside], code[inside]
            code = (code + letters[at + length - 1]) * _RADIX
            found = finder.find(code)
            own, number = at[found >= 0], found[found >= 0]
            score = vocab.scores[number]
            if length == 1 and len(own) < len(at):
                lost = at[found < 0]
                own, number = np.concatenate([own, lost]), np.concatenate([number, np.full(len(lost), -1)])
                score = np.concatenate([score, [vocab.byte_score * _width(unit[i]) for i in lost.tolist()]])
            ends.append((own + length).astype(np.int32))
            starts.append(own.astype(np.int32))
            ids.append(number.astype(np.int32))
            scores.append(score)
            at, code = at[found != -1], code[found != -1]
            if not len(at):
                break
    end = np.concatenate(ends)
    order = np.lexsort((np.concatenate(starts), end))
    bounds = np.searchsorted(end[order], np.arange(len(unit) + 2))
    return _scored(unit, bounds, *(array(k, np.concatenate(x)[order].tobytes()) for k, x in zip("iiq", (starts, ids, scores))))


def _width(letter: str) -> int:
    return len(letter.encode("utf-8", "surrogatepass"))


def _scored(unit: str, bounds, starts, ids, scores) -> Lattice:
    ahead = array("q", bytes(8 * (len(unit) + 1)))
    for end in range(1, len(unit) + 1):
        low, high = bounds[end], bounds[end + 1]
        ahead[end] = max(ahead[starts[k]] + scores[k] for k in range(low, high))
    return Lattice(unit, bounds, starts, ids, scores, ahead)


def n_best(unit: str, vocab: Vocabulary, finder: _Finder, n: int = N_BEST) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best segmentations of a word, best first; of equal scores, what was come to first.

    A partial segmentation covers the end of the word. What its rest can gain at most is the
    forward score of the position it has reached, exactly: nothing is expanded in vain, and the
    n-th pop of a whole segmentation is the n-th best. Of equally promising ones the one that has come
    furthest goes on.

    Time and memory grow with the word, some 400 bytes a character: a step remembers its piece and the
    step before it; no position is left more than n times, and only by its n most promising pieces,
    as each of these leads to a whole segmentation as good as it promises.
    """
    held = lattice(unit, vocab) if len(unit) <= WIDEST else long_lattice(unit, vocab, finder)
    ahead, starts, scores = held.ahead, held.starts, held.scores
    pieces, before = array("q", [-1]), array("q", [-1])  # of each step
    left: Counter[int] = Counter()
    found: list[tuple[int, tuple[int, ...]]] = []
    queue = [(-ahead[-1], len(unit), 0)]
    while queue and len(found) < n:
        promise, at, step = heapq.heappop(queue)
        if not at:
            found.append((-promise, _ids_of(held, vocab, pieces, before, step)))
            continue
        if left[at] == n:
            continue
        left[at] += 1
        gained = -promise - ahead[at]
        edges = range(held.bounds[at], held.bounds[at + 1])
        promises = [(-(gained + scores[k] + ahead[starts[k]]), starts[k], k) for k in edges]
        for promise, start, k in heapq.nsmallest(n, promises):
            pieces.append(k)
            before.append(step)
            heapq.heappush(queue, (promise, start, len(pieces) - 1))
    return found


def _ids_of(held: Lattice, vocab: Vocabulary, pieces, before, step: int) -> tuple[int, ...]:
    ids: list[int] = []
    while step:
        k = pieces[step]
        if held.ids[k] >= 0:
            ids.append(held.ids[k])
        else:
            ids += [vocab.byte_ids[b] for b in held.unit[held.starts[k]].encode("utf-8", "surrogatepass")]
        step = before[step]
    return tuple(ids)


#: Longer units, a rarity, are segmented one at a time.
WIDEST = 32


class Segmented(NamedTuple):
    """Best segmentations of many units, and what the second best of each loses."""

    scores: np.ndarray
    gaps: np.ndarray
    counts: np.ndarray
    ids: np.ndarray


NO_SECOND = 1 << 60


def one_by_one(units: list[str], vocab: Vocabulary, finder: _Finder) -> Segmented:
    found = [n_best(unit, vocab, finder, 2) for unit in units]
    return Segmented(
        np.array([f[0][0] for f in found], np.int64),
        np.array([f[0][0] - f[1][0] if len(f) > 1 else NO_SECOND for f in found], np.int64),
        np.array([len(f[0][1]) for f in found], np.int64),
        np.array([i for f in found for i in f[0][1]], np.int32),
    )


def all_at_once(units: list[str], vocab: Vocabulary, finder: _Finder) -> tuple[Segmented, np.ndarray]:
    """Forward and backward Viterbi over the lattices of many short units, column by column.

    The second best segmentation is the best through any piece off the best path. Units with a
    character that is no piece of its own are marked in the second result; theirs does not count.
    """
    width, n = max(map(len, units)), len(units)
    lengths = np.array([len(u) for u in units])
    letters = np.array(units, f"U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
    low = -(1 << 50)
    forward = np.full((width + 1, n), low)
    forward[0] = 0
    back, best_id = np.zeros((width + 1, n), np.int8), np.full((width + 1, n), -1, np.int32)
    strange = np.zeros(n, bool)
    edges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for start in range(width):
        rows = np.flatnonzero(lengths > start)
        code = np.zeros(len(rows), np.uint64)
        for end in range(start + 1, min(width, start + vocab.longest) + 1):
            code = (code + letters[rows, end - 1]) * _RADIX
            found = finder.find(code)
            if end == start + 1:
                strange[rows[found < 0]] = True
            hit = found >= 0
            own, score = rows[hit], vocab.scores[found[hit]]
            if len(own):
                edges.append((start, end, own, score))
                gained = forward[start, own] + score
                better = gained > forward[end, own]
                own, ids = own[better], found[hit][better]
                forward[end, own], back[end, own], best_id[end, own] = gained[better], start, ids
            goes_on = (found != -1) & (lengths[rows] > end)
            rows, code = rows[goes_on], code[goes_on]
            if not len(rows):
                break
    everyone = np.arange(n)
    backward = np.full((width + 1, n), low)
    backward[lengths, everyone] = 0
    for start, end, own, score in reversed(edges):
        backward[start, own] = np.maximum(backward[start, own], backward[end, own] + score)
    best = forward[lengths, everyone]
    # Walk back along the best paths, all units together.
    at, steps, on_path = lengths.copy(), [], np.zeros((width + 1, n), bool)
    while (at > 0).any():
        on_path[at, everyone] = True
        steps.append(np.where(at > 0, best_id[at, everyone], -1))
        at = np.where(at > 0, back[at, everyone], 0)
    second = np.full(n, low)
    for start, end, own, score in edges:
        through = forward[start, own] + score + backward[end, own]
        through[on_path[end, own] & (back[end, own] == start)] = low
        second[own] = np.maximum(second[own], through)
    gaps = np.where(second > low // 2, best - second, NO_SECOND)
    laid = np.stack(steps[::-1], axis=1)
    taken = laid >= 0
    return Segmented(best, gaps, taken.sum(axis=1), laid[taken]), strange


def least_sums(lists: list[list[int]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` least sums of one number of each ascending list, with the places taken; ties by places.

    Every choice is come to once, from the one with its last place but 0 a step lower.
    """
    first = (0,) * len(lists)
    queue, found = [(sum(numbers[0] for numbers in lists), first, 0)], []
    while queue and len(found) < n:
        total, pick, last = heapq.heappop(queue)
        found.append((total, pick))
        for i in range(last, len(lists)):
            if pick[i] + 1 < len(lists[i]):
                gain = lists[i][pick[i] + 1] - lists[i][pick[i]]
                heapq.heappush(queue, (total + gain, (*pick[:i], pick[i] + 1, *pick[i + 1 :]), i))
    return found


class Encoder:
    """Segments texts, remembering words; one per task."""

    def __init__(self, path: str, n: int):
        self.vocab, self.n = vocabulary(path), n
        self.finder = _Finder(self.vocab)
        self.remembered = lru_cache(maxsize=50_000)(lambda unit: n_best(unit, self.vocab, self.finder, self.n))
        self.forget()

    def alternatives(self, unit: str) -> list[tuple[int, tuple[int, ...]]]:
        return self.remembered(unit) if len(unit) <= WIDEST else n_best(unit, self.vocab, self.finder, self.n)

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        empty = np.zeros(0, np.int64)
        self.store = Segmented(empty, empty, empty, np.zeros(0, np.int32))
        self.ends = empty

    def learn(self, units: list[bytes]) -> None:
        texts = [u.decode("utf-8", "surrogatepass").replace(" ", MARK) for u in units]
        parts, order = [self.store], []
        plain = [i for i, t in enumerate(texts) if len(t) <= WIDEST]
        odd = [i for i, t in enumerate(texts) if len(t) > WIDEST]
        by_length = sorted(plain, key=lambda i: len(texts[i]))
        for at in range(0, len(by_length), 4096):
            own = by_length[at : at + 4096]
            result, strange = all_at_once([texts[i] for i in own], self.vocab, self.finder)
            if strange.any():
                odd += [i for i, s in zip(own, strange, strict=True) if s]
                keep = ~strange
                ids = result.ids[np.repeat(keep, result.counts)]
                result = Segmented(result.scores[keep], result.gaps[keep], result.counts[keep], ids)
                own = [i for i, s in zip(own, strange, strict=True) if not s]
            parts.append(result)
            order += own
        if odd:
            parts.append(one_by_one([texts[i] for i in odd], self.vocab, self.finder))
            order += odd
        base = len(self.store.scores)
        self.store = Segmented(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        self.known.update((units[i], base + j) for j, i in enumerate(order))

    def look_up(self, units: list[bytes]) -> np.ndarray:
        """Places of the units in the store."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new = [u for u in units if u not in self.known]
        if new:
            self.learn(new)
        return np.array([self.known[u] for u in units], np.int64)

    def stored(self, unit: bytes) -> tuple[int, ...]:
        """The best segmentation of a unit that was looked up."""
        place = self.known[unit]
        if len(self.ends) != len(self.store.counts):
            self.ends = np.cumsum(self.store.counts)
        return tuple(self.store.ids[self.ends[place] - self.store.counts[place] : self.ends[place]].tolist())

    def segmentations(self, units: list[bytes], gaps: np.ndarray) -> list[tuple[int, dict[int, tuple[int, ...]]]]:
        """The best ways to segment a text: what each loses, and the units that differ.

        Units are independent, so only the n - 1 with the least gaps can differ in the n best.
        The stored way of a unit comes first, whichever of several best ones the search gives first.
        """
        open_units = [i for i in np.argsort(gaps, kind="stable")[: self.n - 1].tolist() if gaps[i] < NO_SECOND]
        choices = []
        for i in open_units:
            ways = self.alternatives(units[i].decode("utf-8", "surrogatepass").replace(" ", MARK))
            first = self.stored(units[i])
            others = [(score, ids) for score, ids in ways if tuple(ids) != first]
            ways = [(ways[0][0], first), *others][: self.n]
            choices.append([(ways[0][0] - score, i, ids) for score, ids in ways])
        return [
            (loss, {c[k][1]: c[k][2] for c, k in zip(choices, pick, strict=True) if k})
            for loss, pick in least_sums([[way[0] for way in ways] for ways in choices], self.n)
        ]


def cut_units(data: np.ndarray, offsets: np.ndarray, foreign: np.ndarray):
    """Texts with a space before each, cut where no piece can cross: ``(data, bounds, per text)``."""
    filled = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][filled], 32)
    offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
    space, strange = data == 32, foreign[data]
    start = np.ones(len(data), bool)
    start[1:] = (space[1:] & ~space[:-1]) | (strange[1:] != strange[:-1])
    start[offsets[:-1][filled]] = True
    places = np.flatnonzero(start)
    return data, offsets, np.append(places, len(data)), np.searchsorted(places, offsets)


def encoded(path: str, n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, n)
        for chunk in chunks(batches, limit=1 << 20):
            data, offsets, bounds, per_text = cut_units(chunk.data, chunk.offsets, encoder.vocab.foreign)
            listed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]
            ).dictionary_encode()
            units = listed.dictionary.to_pylist()
            numbers = listed.indices.to_numpy(zero_copy_only=False)
            places = encoder.look_up(units)[numbers] if units else np.zeros(0, np.int64)
            yield _results(chunk, encoder, units, numbers, places, data, offsets, per_text)

    return run


def _results(chunk, encoder, units, numbers, places, data, offsets, per_text) -> pa.RecordBatch:
    store, raw = encoder.store, data.tobytes()
    first = np.concatenate([[0], np.cumsum(store.counts)])
    rows: list[tuple] = []
    for row in range(len(per_text) - 1):
        own = places[per_text[row] : per_text[row + 1]]
        counts = store.counts[own]
        ends = np.cumsum(counts)
        ids = store.ids[np.repeat(first[own] - ends + counts, counts) + np.arange(int(counts.sum()))]
        best = int(store.scores[own].sum())
        names = [units[i] for i in numbers[per_text[row] : per_text[row + 1]]] if len(own) else []
        digest, scores = hashlib.sha256(), []
        for loss, changed in encoder.segmentations(names, store.gaps[own]):
            scores.append((best - loss) / 1e6)
            pieces, at = [], 0
            for i in sorted(changed):
                pieces += [ids[at : ends[i] - counts[i]], np.array(changed[i], np.int32)]
                at = ends[i]
            digest.update(np.concatenate([*pieces, ids[at:]]).astype("<i4").tobytes() + b"\n")
        decoded = decode(ids, encoder.vocab)
        text = raw[offsets[row] + 1 : offsets[row + 1]]
        rows.append(
            (
                len(ids), best / 1e6, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(),
                len(scores), scores, digest.hexdigest(), decoded == text,
            )
        )
    kinds = [pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.string(), pa.bool_()]
    columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    names = [part.split()[0] for part in ENCODED.split(", ")]
    return pa.RecordBatch.from_arrays([chunk.rows.column("doc_id").cast(pa.int64()), *columns], names=names)


def decode(ids: Iterable[int], vocab: Vocabulary) -> bytes:
    """The text of a sequence of pieces, without the space that encoding puts first."""
    return b"".join(map(vocab.decoded.__getitem__, ids))[1:]


def encode(text: str, path: str = MODEL, n: int = N_BEST) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of one text, for use outside of a job."""
    batch = pa.RecordBatch.from_arrays([pa.array([text.replace(MARK, " ")])], names=["text"])
    encoder = Encoder(path, n)
    for chunk in chunks([batch]):
        data, _, bounds, _ = cut_units(chunk.data, chunk.offsets, encoder.vocab.foreign)
        units = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        places = encoder.look_up(units)
        ends = np.cumsum(encoder.store.counts)
        own = [encoder.store.ids[ends[p] - encoder.store.counts[p] : ends[p]].tolist() for p in places]
        best = int(encoder.store.scores[places].sum())
        return [
            ((best - loss) / 1e6, [i for at, ids in enumerate(own) for i in changed.get(at, ids)])
            for loss, changed in encoder.segmentations(units, encoder.store.gaps[places])
        ]
    return []


def piece_encoding(docs: DataFrame, path: str = MODEL, n: int = N_BEST) -> DataFrame:
    """Best segmentations of every row's text: ``(doc_id, n_pieces, score, ids_sha256, ...)``.

    ``ids_sha256`` is over the ids of the best one as little-endian 32-bit numbers, ``scores`` are
    those of the up to ``n`` best, ``nbest_sha256`` is over all their ids, a line each.
    ``round_trip`` tells whether decoding gives the text back, byte for byte; a literal mark
    (U+2581) comes back as the space it stands for.

    Null and empty texts have no pieces, one empty segmentation and a round trip. Repeated rows
    give repeated results; other columns are not read. One pass, no shuffle; the model file must
    be on every executor at ``path``. Memory is bounded by the words a task remembers, and by some 400
    bytes a character of the longest word: texts without spaces are one word where no sign parts them.
    """
    rows = docs.select("doc_id", F.replace("text", F.lit(MARK), F.lit(" ")).alias("text"))
    return rows.mapInArrow(encoded(path, n), ENCODED)
