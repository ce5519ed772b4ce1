"""Vector codes: product quantisation by whole numbers, entries found by a neighbour access tree.

Components become whole numbers, vectors are cut into equal parts, and each part is replaced by the
nearest entry of its codebook. A geometric near-neighbour access tree over the entries keeps, for
every split point and every subtree, the least and greatest distance between them. A query's
distances to the split points rule subtrees out; what is left is compared as whole numbers.
"""

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.llm.vectors import Vectors, matrix, vectors_of
from inkfold.operators.ordered import match_keys
from inkfold.operators.sizes import is_small
from inkfold.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a tree node; so few entries are compared without further nodes.
SPLITS = 16
#: Greatest whole number of a component: squares of up to 512 differences add up within 64 bits.
LARGEST = 1 << 26
#: Products and sums of whole numbers up to this are exact in double precision.
EXACT = float(1 << 53)
#: Share of a distance that rounding may have changed, with room to spare.
ROUNDING = 1e-12
#: Vectors that are looked up at once.
ROWS_AT_ONCE = 8192


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE)


def in_range(vectors: np.ndarray) -> np.ndarray:
    return (np.abs(whole_numbers(vectors)) <= LARGEST).all(axis=1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exactly."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if 4.0 * a.shape[1] * float(most) ** 2 < EXACT:
        a, b = a.astype(np.float64), b.astype(np.float64)
    total = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return total.astype(np.int64)


class Tree:
    """A node: split points, a subtree for each, and the range of distances from point i to subtree j.

    A subtree holds its split point in its range, but not among its members.
    """

    def __init__(self, entries: np.ndarray, members: np.ndarray):
        self.members, self.points = members, entries[members]
        self.children: list[Tree | None] = []
        if len(members) <= SPLITS:
            return
        between = squared(self.points, self.points)
        chosen = [0]
        nearest = between[0].copy()
        while len(chosen) < SPLITS and nearest.max() > 0:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, between[chosen[-1]])
        chosen = np.sort(np.array(chosen))
        owner = between[:, chosen].argmin(axis=1)
        owner[chosen] = np.arange(len(chosen))
        away = np.sqrt(between[chosen].astype(np.float64))
        of = [np.flatnonzero(owner == j) for j in range(len(chosen))]
        self.low = np.stack([away[:, own].min(axis=1) for own in of], axis=1)
        self.high = np.stack([away[:, own].max(axis=1) for own in of], axis=1)
        rest = [np.setdiff1d(own, chosen) for own in of]
        self.members, self.points = members[chosen], self.points[chosen]
        self.children = [Tree(entries, members[own]) if len(own) else None for own in rest]

    def search(self, queries: np.ndarray, which: np.ndarray, best: np.ndarray, entry: np.ndarray) -> None:
        """Lower ``best`` and ``entry`` of the queries ``which``; ties go to the lower entry."""
        away = squared(queries[which], self.points)
        place = away.argmin(axis=1)  # members are in order, so the first of equal ones is the lowest
        least, found = away[np.arange(len(which)), place], self.members[place]
        better = (least < best[which]) | ((least == best[which]) & (found < entry[which]))
        best[which[better]], entry[which[better]] = least[better], found[better]
        if not self.children:
            return
        away = np.sqrt(away.astype(np.float64))
        # The subtree of the nearest point first: it brings the bound down for the others.
        for first in (True, False):
            for j, child in enumerate(self.children):
                if child is None:
                    continue
                own = np.flatnonzero((place == j) == first)
                if not first and len(own):
                    own = own[self._may_hold(j, away[own], best[which[own]])]
                if len(own):
                    child.search(queries, which[own], best, entry)

    def _may_hold(self, j: int, away: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Queries for which subtree j may hold something as near as the best; only strictly farther
        subtrees are ruled out, and rounding never rules out."""
        radius = np.sqrt(best.astype(np.float64))[:, None]
        slack = ROUNDING * (away + self.high[:, j] + radius + 1)
        beyond = away - self.high[:, j] > radius + slack
        within = self.low[:, j] - away > radius + slack
        return ~(beyond | within).any(axis=1)


def nearest_entries(tree: Tree, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each query and the squared distance to it."""
    best, entry = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), ENTRIES)
    for at in range(0, len(queries), ROWS_AT_ONCE):
        tree.search(queries, np.arange(at, min(at + ROWS_AT_ONCE, len(queries))), best, entry)
    return entry, best


def _trees(books: np.ndarray) -> list[Tree]:
    return [Tree(book, np.arange(len(book))) for book in books]


def _assigned(batch: pa.RecordBatch, trees: list[Tree], kind: str, dims: int):
    """Rows that are in range, their parts as whole numbers, entries and squared distances."""
    values = matrix(batch.column("vec"), kind, dims)
    kept = in_range(values)
    parts = whole_numbers(values[kept]).astype(np.int64).reshape(-1, PARTS, dims // PARTS)
    found = [nearest_entries(tree, parts[:, p]) for p, tree in enumerate(trees)]
    return kept, parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _first_entries(vectors: Vectors) -> np.ndarray:
    """The parts of the vectors with the least ids, by part position."""
    kind, dims = vectors.kind, vectors.dims

    def in_bounds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_range(matrix(batch.column("vec"), kind, dims))))

    rows = vectors.rows.select("vec_id", "vec").mapInArrow(in_bounds, "vec_id bigint, vec binary")
    first = rows.orderBy("vec_id", "vec").limit(ENTRIES).collect()
    values = np.frombuffer(b"".join(bytes(r["vec"]) for r in first), kind).reshape(-1, dims).astype(np.float64)
    return whole_numbers(values).astype(np.int64).reshape(-1, PARTS, dims // PARTS).transpose(1, 0, 2)


def _refined(vectors: Vectors, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry is the floored mean of its parts."""
    kind, dims, width, trees = vectors.kind, vectors.dims, books.shape[2], _trees(books)
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, books.shape[1], width), np.int64)
        count = np.zeros((PARTS, books.shape[1]), np.int64)
        for batch in batches:
            _, parts, entries, _ = _assigned(batch, trees, kind, dims)
            for p in range(PARTS):
                count[p] += np.bincount(entries[:, p], minlength=books.shape[1])
                np.add.at(total[p], entries[:, p], parts[:, p])
        at = np.nonzero(count)
        columns = [at[0].astype(np.int32), at[1].astype(np.int32), count[at], *total[at].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=["part", "entry", "n", *names])

    schema = "part int, entry int, n bigint, " + ", ".join(f"{x} bigint" for x in names)
    # One row per entry of each codebook reaches the driver, whatever the number of vectors.
    found = vectors.rows.select("vec").mapInArrow(sums, schema).groupBy("part", "entry")
    after = books.copy()
    for row in found.agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect():
        after[row["part"], row["entry"]] = [row[x] // row["n"] for x in names]
    return after


def codebooks(vectors: Vectors, rounds: int = ROUNDS) -> np.ndarray:
    """Entries as whole numbers, by part position and index."""
    books = _first_entries(vectors)
    for _ in range(rounds if books.shape[1] else 0):
        books = _refined(vectors, books)
    return books


def codebooks_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def vector_codes(table: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` per usable vector.

    The codebook of each part position starts as the parts of the ``ENTRIES`` least ids (with fewer
    vectors it is smaller; equal ids go by the vector's bytes) and is refined ``ROUNDS`` times over
    all vectors. ``code`` names the nearest entries, two hex digits a part; ties go to the lower
    index. ``error`` sums the squared distances, ``label_error`` does so over all rows of a label,
    null labels together. Repeated rows count as often as they occur.

    Left out are the rows that ``vectors_of`` leaves out, vectors whose length four does not divide,
    and vectors with a component of more than ``LARGEST`` / 1024, whose squares 64 bits cannot hold.
    An empty table gives no rows. Other columns are not read.
    """
    vectors = vectors_of(table, column, ["label"])
    kind, dims = vectors.kind, vectors.dims
    schema = "vec_id bigint, code string, error bigint"
    if not dims or dims % PARTS:
        empty = vectors.rows.sparkSession.createDataFrame([], schema + ", label_error bigint, codebooks_sha256 string")
        return empty
    books = codebooks(vectors)
    trees = _trees(books)

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, _, entries, away = _assigned(batch, trees, kind, dims)
            rows = batch.filter(pa.array(kept))
            codes = [bytes(e).hex() for e in entries.astype(np.uint8)]
            columns = [rows.column("vec_id"), pa.array(codes, pa.string()), pa.array(away.sum(axis=1)), rows.column("label")]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "code", "error", "label"])

    label = vectors.rows.schema["label"].dataType.simpleString()
    rows = written(vectors.rows.select("vec_id", "vec", "label").mapInArrow(coded, f"{schema}, label {label}"), "codes")
    totals = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    totals = F.broadcast(totals) if is_small(totals) else totals
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return match_keys(rows, totals, ["label"], "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
