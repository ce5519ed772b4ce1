"""Quality rules on repetition inside a text, by suffix arrays over its words."""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.words import SPACE, Words, chunks, find_words

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_covered_words bigint, "
    "covered_fraction double, longest_repeat bigint"
)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: The base rule: too few words, or too many of them in repeated windows of three.
MIN_WORDS, MAX_REPEAT_PERCENT, BASE_WINDOW = 50, 50, 3
#: The method's rule: repeats of so many words count; how much of a text they may cover, and how
#: long one may be.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 10, 0.3, 200


def word_ids(data: np.ndarray, words: Words) -> np.ndarray:
    """Equal words of a chunk get equal small numbers."""
    bounds = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=bounds[1:])
    letters = pa.py_buffer(np.ascontiguousarray(data[~SPACE[data]]))
    listed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(words.starts), [None, pa.py_buffer(bounds), letters]
    )
    return listed.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key, how many keys are smaller, and whether it occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(first, len(keys)))
    rank, several = np.empty(len(keys), np.int64), np.empty(len(keys), bool)
    rank[order] = np.repeat(first, sizes)
    several[order] = np.repeat(sizes > 1, sizes)
    return rank, several


def repeat_lengths(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it on that starts twice in its text.

    That is the depth of the deepest common-prefix interval around its suffix: the larger of the
    common prefixes with its two neighbours in the suffix array. Prefix doubling ranks the
    suffixes of all texts at once, the text being the leading key; a suffix leaves the sort when
    its rank is its own. Common prefixes follow from the ranks of all doublings.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rank, several = _ranked(texts * (int(ids.max()) + 1) + ids)
    levels, alive, step = [rank.astype(np.int32)], np.flatnonzero(several), 1
    while len(alive):
        follower = np.minimum(alive + step, n - 1)
        same = (alive + step < n) & (texts[follower] == texts[alive])
        after = np.where(same, rank[follower] + 1, 0)
        # Suffixes of one group differ by what follows only, so the group's rank stays the base.
        within, several = _ranked(rank[alive] * (n + 1) + after)
        base = np.sort(rank[alive])
        group_first = np.searchsorted(base, rank[alive])
        rank = rank.copy()
        rank[alive] += within - group_first
        levels.append(rank.astype(np.int32))
        alive, step = alive[several], step * 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    left, right = order[:-1], order[1:]
    common = np.zeros(n - 1, np.int64)
    # Only neighbours that share their first word are followed further.
    pairs = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[pairs], right[pairs]
    length = np.zeros(len(pairs), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        at_a, at_b = a + length, b + length
        in_both = (at_a < n) & (at_b < n)
        at_a, at_b = np.minimum(at_a, n - 1), np.minimum(at_b, n - 1)
        length += np.where(in_both & (levels[depth][at_a] == levels[depth][at_b]), 1 << depth, 0)
    common[pairs] = length
    best = np.zeros(n, np.int64)
    best[right] = common
    best[left] = np.maximum(best[left], common)
    return best


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the words in the union of spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:-1]) > 0


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def duplicate_lines(text: bytes) -> int:
    seen, repeated = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            repeated += line in seen
            seen.add(line)
    return repeated


def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The metrics and the verdict of each text, computed for a chunk of texts at once."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    for chunk in chunks(batches):
        data, offsets = chunk.data, chunk.offsets
        words = find_words(data, offsets)
        best = repeat_lengths(word_ids(data, words), words.offsets)
        n = len(best)
        n_words = np.diff(words.offsets)
        windows = np.flatnonzero(best >= BASE_WINDOW)
        repeat_words = per_text(covered(windows, np.full(len(windows), BASE_WINDOW), n), words.offsets)
        long = np.flatnonzero(best >= MIN_REPEAT)
        n_covered = per_text(covered(long, best[long], n), words.offsets)
        longest = np.zeros(len(n_words), np.int64)
        filled = n_words > 0
        longest[filled] = np.maximum.reduceat(best, words.offsets[:-1][filled]) if n else 0
        raw = data.tobytes()
        lines = [duplicate_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        failed = (n_words < MIN_WORDS) | (100 * repeat_words > MAX_REPEAT_PERCENT * n_words)
        fraction = n_covered / np.maximum(n_words, 1)
        kept = ~failed & (fraction <= MAX_COVERED) & (longest <= MAX_LONGEST)
        yield pa.RecordBatch.from_arrays(
            [
                chunk.rows.column("doc_id").cast(pa.int64()),
                *map(
                    pa.array,
                    [
                        n_words,
                        per_text(~SPACE[data] & ((data & 0xC0) != 0x80), offsets),
                        per_text(SYMBOLS[data], offsets),
                        np.array(lines, np.int64),
                        repeat_words,
                        failed,
                        kept,
                        n_covered,
                        fraction,
                        longest,
                    ],
                ),
            ],
            names=names,
        )


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition metrics and a verdict per row: no shuffle, one pass over the texts.

    Base metrics: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and
    ``n_repeat_words``; ``base_failed`` is their verdict. ``n_covered_words`` counts the words in
    the union of all maximal repeats of ``MIN_REPEAT`` words or more, ``longest_repeat`` is the
    longest run of words that starts twice; ``kept`` limits both.

    Null and empty texts have no words and fail. Repeated rows give repeated results, null ids
    stay null, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scored, SCHEMA)
