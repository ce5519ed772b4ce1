"""Language identification in two steps: the family first, then the language within it."""

from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.words import LOWER, Chunk, chunks

#: Families of related languages; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "bg", "sr"],
}
UNKNOWN = "und"
#: Labelled rows per language to learn from, as an expectation: rows are drawn by a hash.
SAMPLE_PER_LANG = 300
DIMENSIONS = 4096
EPOCHS = 12
REGULARISATION = 1e-4
ROWS_AT_ONCE = 256
#: Below this the separators do not know. Two families cannot score less, as one's margin is the
#: negative of the other's; what is in none of the languages is found by ``fits``.
MIN_SCORE = 0.25
#: A text fits if it is no further from a language than so many times the furthest learned row, each
#: of which is judged by the other rows alone.
SLACK = 1.5
#: With fewer different rows a language has the widest spread of those that have as many.
ENOUGH_ROWS = 20
#: Different letter groups from which on a longer text is not held to a stricter measure.
ENOUGH_GROUPS = 400

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One unit vector per text: roots of the counts of hashed letter pairs and triples.

    Case, digits and signs are folded away, so that the letters alone decide.
    """
    low = np.where(LETTER[data], LOWER[data], np.where(data < 128, 32, data)).astype(np.uint32)
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    low = np.where(after_c3 & (data >= 0x80) & (data <= 0x9E), low + 32, low).astype(np.uint32)
    n = len(offsets) - 1
    texts = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.zeros(n * DIMENSIONS)
    for width in (2, 3):
        m = len(low) - width + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for i in range(width):
            code = (code << np.uint32(8)) | low[i : i + m]
        slot = ((code + np.uint32(width)) * np.uint32(2654435761)) >> np.uint32(20)
        same = texts[:m] == texts[width - 1 :]
        counts += np.bincount(texts[:m][same] * DIMENSIONS + slot[same], minlength=n * DIMENSIONS)
    vectors = np.sqrt(counts).reshape(n, DIMENSIONS)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def linear_svm(vectors: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear support vector machine, by averaged subgradient steps."""
    x = np.hstack([vectors, np.ones((len(vectors), 1), np.float32)])
    y = np.where(positive, 1.0, -1.0)
    # Both classes weigh the same, however many rows each has.
    weight = np.where(positive, 0.5 / max(positive.sum(), 1), 0.5 / max((~positive).sum(), 1))
    weight = weight * len(y)
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    order, steps = np.random.default_rng(7), 0
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            steps += 1
            rate = 1 / (REGULARISATION * (steps + 1 / REGULARISATION))
            slack = y[i] * (x[i] @ w) < 1
            w *= 1 - rate * REGULARISATION
            if slack:
                w += rate * weight[i] * y[i] * x[i]
            mean += (w - mean) / steps
    return mean


class Usage(NamedTuple):
    """How a language uses letter groups: the log of their shares, and what is usual for a text.

    ``spread`` is how far the twentieth part of the learned rows is below their ``middle``.
    """

    logs: np.ndarray
    centre: float
    middle: float
    spread: float

    def distance(self, likelihood: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """How many times the spread texts are below the middle."""
        return (self.middle - _excess(likelihood, vectors, self.centre)) / self.spread


def _excess(likelihood: np.ndarray, vectors: np.ndarray, centre: float) -> np.ndarray:
    """Mean log-likelihoods against the usual one, in units that shrink as texts get longer.

    The different letter groups of a text stand for its length: repeats tell nothing new.
    """
    groups = np.maximum(np.count_nonzero(vectors, axis=1), 1)
    return (likelihood - centre) / np.sqrt(1 / groups + 1 / ENOUGH_GROUPS)


def _likelihoods_by_others(shares: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each row of a language, by the other rows of it."""
    return np.array([share @ np.log((total - share) / len(shares)) for share in shares])


def usage(vectors: np.ndarray) -> Usage:
    """Learned from the rows of one language; each is judged by the others alone."""
    shares = np.square(vectors, dtype=np.float64)
    total = shares.sum(axis=0) + 1 / DIMENSIONS
    own = _likelihoods_by_others(shares, total)
    centre = float(np.median(own))
    excess = _excess(own, vectors, centre)
    middle, low = np.median(excess), np.quantile(excess, 0.05)
    return Usage(np.log(total / (len(shares) + 1)), centre, float(middle), float(max(middle - low, 1e-9)))


def mixed_distance(a: Usage, b: Usage, vectors: np.ndarray) -> np.ndarray:
    """How far texts are from one in two languages, half in each, by the milder of both."""
    likelihood = np.square(vectors) @ (np.logaddexp(a.logs, b.logs) - np.log(2))
    centre = (a.centre + b.centre) / 2
    return np.minimum(*(x._replace(centre=centre).distance(likelihood, vectors) for x in (a, b)))


def tolerance(usages: list[Usage], rows: list[np.ndarray]) -> float:
    """``SLACK`` times the distance of the learned row that is furthest from all usages.

    ``rows[i]`` are the vectors that ``usages[i]`` was learned from.
    """
    furthest = 0.0
    for i, (own, vectors) in enumerate(zip(usages, rows, strict=True)):
        shares = np.square(vectors, dtype=np.float64)
        total = shares.sum(axis=0) + 1 / DIMENSIONS
        distances = own.distance(_likelihoods_by_others(shares, total), vectors)
        for row in np.argsort(-distances):
            if distances[row] <= furthest:
                break
            others = own._replace(logs=np.log((total - shares[row]) / len(shares)))
            one, nearest = vectors[row : row + 1], distances[row]
            for j, other in enumerate(usages):
                if i != j:
                    alone = other.distance(np.square(one) @ other.logs, one)[0]
                    nearest = min(nearest, alone, mixed_distance(others, other, one)[0])
            furthest = max(furthest, nearest)
    return SLACK * furthest


class Model(NamedTuple):
    """Separators of families, one against the rest, and of languages, one against one.

    Separators tell the learned languages apart; ``usages``, and how far from them a text may be,
    tell them from everything else.
    """

    families: dict[str, list[str]]
    against_rest: dict[str, np.ndarray]
    pairs: dict[tuple[str, str], np.ndarray]
    usages: list[Usage]
    tolerance: float = 0.0


def fit(vectors: np.ndarray, langs: np.ndarray) -> Model:
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    own = np.array([family_of(lang) for lang in langs])
    against_rest, pairs = {}, {}
    if len(families) > 1:
        against_rest = {name: linear_svm(vectors, own == name) for name in families}
    for members in families.values():
        for a, b in combinations(members, 2):
            rows = (langs == a) | (langs == b)
            pairs[a, b] = linear_svm(vectors[rows], langs[rows] == a)
    # Copies of one text would make its letter groups look usual.
    rows = [np.unique(vectors[langs == lang], axis=0) for lang in sorted(set(langs))]
    usages = [usage(own) for own in rows]
    sure = [i for i, own in enumerate(rows) if len(own) >= ENOUGH_ROWS]
    if sure:
        widest = max(usages[i].spread for i in sure)
        usages = [x if i in sure else x._replace(spread=widest) for i, x in enumerate(usages)]
    known = sure or range(len(rows))
    allowed = tolerance([usages[i] for i in known], [rows[i] for i in known])
    return Model(families, against_rest, pairs, usages, allowed)


def fits(model: Model, vectors: np.ndarray) -> np.ndarray:
    """Which texts use letter groups as a learned language, or a text in two of them, does.

    The shorter a text, the more it may differ; a few letters fit any language. Two languages are
    mixed only for texts that fit none, and one of the two is the likeliest.
    """
    shares = np.square(vectors)
    likelihoods = np.stack([shares @ own.logs for own in model.usages])
    found = np.zeros(len(vectors), bool)
    for own, likelihood in zip(model.usages, likelihoods, strict=True):
        found |= own.distance(likelihood, vectors) <= model.tolerance
    left = np.flatnonzero(~found)
    likeliest = likelihoods[:, left].argmax(axis=0)
    for i in np.unique(likeliest):
        rows = left[likeliest == i]
        for j, other in enumerate(model.usages):
            if i != j:
                found[rows] |= mixed_distance(model.usages[i], other, vectors[rows]) <= model.tolerance
    return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * np.clip(x, -30, 30)))


def predict(model: Model, vectors: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Languages and scores: the product of the family's and the language's certainty."""
    if not model.families:
        return [UNKNOWN] * len(vectors), np.zeros(len(vectors))
    x = np.hstack([vectors, np.ones((len(vectors), 1))])
    names = list(model.families)
    chosen, score = np.zeros(len(x), int), np.ones(len(x))
    if model.against_rest:
        margins = np.stack([x @ model.against_rest[name] for name in names], axis=1)
        chosen, score = margins.argmax(axis=1), _sigmoid(margins.max(axis=1))
    langs = np.empty(len(x), object)
    for i, name in enumerate(names):
        rows, members = np.flatnonzero(chosen == i), model.families[name]
        wins = np.zeros((len(rows), len(members)))
        worst = np.full((len(rows), len(members)), 30.0)
        for (a, b), weights in model.pairs.items():
            if a in members:
                margin = x[rows] @ weights
                ia, ib = members.index(a), members.index(b)
                wins[:, ia] += margin >= 0
                wins[:, ib] += margin < 0
                worst[:, ia] = np.minimum(worst[:, ia], margin)
                worst[:, ib] = np.minimum(worst[:, ib], -margin)
        # Most duels won; the margins settle ties.
        best = (wins + _sigmoid(worst) / 2).argmax(axis=1)
        langs[rows] = np.array(members, object)[best]
        score[rows] *= _sigmoid(worst[np.arange(len(rows)), best])
    return list(langs), score


def _row_groups(chunk: Chunk) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A chunk in groups of few rows: the profiles of many short texts would not fit."""
    for at in range(0, len(chunk.offsets) - 1, ROWS_AT_ONCE):
        offsets = chunk.offsets[at : at + ROWS_AT_ONCE + 1]
        yield (
            chunk.rows.slice(at, len(offsets) - 1),
            chunk.data[offsets[0] : offsets[-1]],
            offsets - offsets[0],
        )


def _profiled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        for rows, data, offsets in _row_groups(chunk):
            vectors = [v.astype(np.float32).tobytes() for v in profiles(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang"), pa.array(vectors, pa.binary())], names=["lang", "vector"]
            )


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Fit on about ``sample_per_lang`` rows of each language, drawn by a hash of the id.

    Only rows with a language whose id is not held out are drawn. Vectors of fixed length, not
    texts, reach the driver: 16 KB a sampled row.
    """
    labelled = docs.where(~F.col("held_out") & F.col("lang").isNotNull() & (F.col("lang") != ""))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Model({}, {}, {}, [])
    shares = [F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample_per_lang / n))]
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.try_element_at(
        F.create_map(*shares), F.col("lang")
    ) * (1 << 20)
    sampled = labelled.where(drawn).select("lang", "text")
    rows = sampled.mapInArrow(_profiled, "lang string, vector binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["vector"])))  # the same model on every run
    if not rows:
        return Model({}, {}, {}, [])
    vectors = np.stack([np.frombuffer(r["vector"], np.float32) for r in rows])
    return fit(vectors, np.array([r["lang"] for r in rows], object))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(LETTER[data])])
    found = np.diff(total[offsets]) > 0
    for i in np.flatnonzero(~found):
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")
        found[i] = any(c.isalpha() for c in text)
    return found


def with_held_out(docs: DataFrame) -> DataFrame:
    """Adds ``held_out``: the ``crc32`` of the id is 1 modulo 3, or there is no id."""
    digest = F.crc32(F.col("doc_id").cast("string"))
    return docs.withColumn("held_out", F.coalesce(F.pmod(digest, F.lit(3)) == 1, F.lit(True)))


def identified(
    chunk: Chunk, model: Model, learned_only: bool = False
) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray]]:
    """Rows with their languages and scores, a few at a time.

    With ``learned_only``, texts that fit no learned language are unknown too.
    """
    for rows, data, offsets in _row_groups(chunk):
        vectors = profiles(data, offsets)
        langs, score = predict(model, vectors)
        known = has_letter(data, offsets)
        if learned_only:
            known &= fits(model, vectors)
        langs = [lang if ok else UNKNOWN for lang, ok in zip(langs, known, strict=True)]
        yield rows, langs, np.where(known, score, 0.0)


def in_known_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, all columns as they are, whose text is in a learned language.

    Texts without a letter are rejected, those that use letter groups as no learned language
    does (unlearned languages, gibberish; see ``fits``), and those that score less than
    ``min_score``, which takes three families. If there is nothing to learn from, no text can be
    told, and only texts without a letter go.
    """
    model = train(with_held_out(docs.select("doc_id", "text", "lang")))

    def filtered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            if not model.families:
                yield chunk.rows.filter(pa.array(has_letter(chunk.data, chunk.offsets)))
                continue
            for rows, langs, score in identified(chunk, model, learned_only=True):
                told = np.array([lang != UNKNOWN for lang in langs], bool)
                yield rows.filter(pa.array(told & (score >= min_score)))

    return docs.mapInArrow(filtered, docs.schema)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row of ``(doc_id, text, lang)``.

    Rows whose ``crc32`` of the id, modulo 3, is 1 are held out: nothing is learned from them,
    nor from rows without an id. A null text, or one without a letter, is ``und`` with score 0;
    so is every text when there is nothing to learn from. Repeated rows give repeated results.
    Prediction is one pass over whole texts without a shuffle; the model is a few vectors.
    """
    rows = with_held_out(docs.select("doc_id", "text", "lang"))
    fitted = train(rows) if model is None else model

    def predicted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            for part, langs, score in identified(chunk, fitted):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("held_out"),
                        pa.array(langs, pa.string()),
                        pa.array(score),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        predicted, "doc_id bigint, held_out boolean, lang_pred string, score double"
    )
