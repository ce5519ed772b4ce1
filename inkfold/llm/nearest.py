"""Nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

Inner products become distances by one more component, which gives all vectors the greatest norm. The
tree is grown from a bounded sample; every vector then goes down to its leaf. A query takes nodes
off a priority queue, nearest centre first, until it has seen enough leaves: so many that queries
compared with all vectors find the wanted share of their true neighbours.

Equal vectors are one entry of the index with their least ids, as no result can hold others. Rows of
neighbouring leaves make up parts of bounded size; a query goes to each part once, with the leaves
that it visits there.
"""

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.vectors import Vectors, matrix, vectors_of
from inkfold.operators.joins import salted_join
from inkfold.session import written

K, QUERY_STEP = 20, 20
#: Share of the true neighbours that calibration asks for.
RECALL = 0.95
#: Vectors that the tree is grown from, and queries that the visits are calibrated with.
SAMPLE, CALIBRATION = 16_384, 256
#: Children of a node, rounds of k-means, entries a leaf should hold, and sampled ones at least.
BRANCHES, MEANS_ROUNDS, LEAF_ROWS, LEAF_SAMPLE = 8, 8, 512, 4
#: Entries of a part, and queries that are compared with a part in one task.
PART_ROWS, PART_QUERIES = 4_096, 16_384
QUERIES_AT_ONCE = 256
SEED = 7


class Node(NamedTuple):
    """``centre`` and ``children`` are rows of the tree's arrays; a leaf has a number, others -1."""

    children: tuple[int, ...]
    leaf: int


class Tree:
    """Centres of all nodes, the root first; leaves are numbered so that near ones are neighbours."""

    def __init__(self, points: np.ndarray, norm: float, leaf_size: int):
        self.norm = norm
        self.nodes: list[Node] = []
        self.leaves = 0
        centres: list[np.ndarray] = []
        draw = np.random.default_rng(SEED)

        def grow(own: np.ndarray) -> int:
            number = len(self.nodes)
            centres.append(own.mean(axis=0) if len(own) else np.zeros(points.shape[1]))
            self.nodes.append(Node((), -1))
            groups = clusters(own, draw) if len(own) > leaf_size else []
            if len(groups) < 2:
                self.nodes[number] = Node((), self.leaves)
                self.leaves += 1
            else:
                self.nodes[number] = Node(tuple(grow(own[g]) for g in groups), -1)
            return number

        grow(points)
        self.centres = np.stack(centres)
        self.lengths = (self.centres * self.centres).sum(axis=1)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each point comes down to."""
        found = np.zeros(len(points), np.int32)
        open_nodes = [(0, np.arange(len(points)))]
        while open_nodes:
            number, own = open_nodes.pop()
            node = self.nodes[number]
            if node.leaf >= 0:
                found[own] = node.leaf
                continue
            below = list(node.children)
            nearest = (self.lengths[below] - 2 * points[own] @ self.centres[below].T).argmin(axis=1)
            open_nodes += [(child, own[nearest == i]) for i, child in enumerate(below)]
        return found

    def visits(self, queries: np.ndarray, most: int) -> Iterator[list[int]]:
        """Per query the first ``most`` leaves, best bin first."""
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            asked = queries[at : at + QUERIES_AT_ONCE]
            for away in self.lengths - 2 * asked @ self.centres.T:
                away = away.tolist()
                bins, leaves = [(away[0], 0)], []
                while bins and len(leaves) < most:
                    number = heapq.heappop(bins)[1]
                    node = self.nodes[number]
                    if node.leaf >= 0:
                        leaves.append(node.leaf)
                    for child in node.children:
                        heapq.heappush(bins, (away[child], child))
                yield leaves


def clusters(points: np.ndarray, draw: np.random.Generator) -> list[np.ndarray]:
    """Members of each of up to ``BRANCHES`` clusters, by k-means from distant starts."""
    centres = points[draw.integers(len(points))][None]
    away = ((points - centres[0]) ** 2).sum(axis=1)
    while len(centres) < BRANCHES and away.max() > 0:
        chosen = points[draw.choice(len(points), p=away / away.sum())]
        centres = np.vstack([centres, chosen])
        away = np.minimum(away, ((points - chosen) ** 2).sum(axis=1))
    for _ in range(MEANS_ROUNDS):
        owner = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, points)
        counts = np.bincount(owner, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    owner = ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
    return [own for own in (np.flatnonzero(owner == i) for i in range(len(centres))) if len(own)]


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors scaled to norms of 1 at most, with the component that makes all norms 1."""
    scaled = vectors / norm
    rest = np.maximum(0, 1 - (scaled * scaled).sum(axis=1))
    return np.column_stack([scaled, np.sqrt(rest)])


def asked(vectors: np.ndarray) -> np.ndarray:
    """Queries of norm 1 in the lifted space; scaling a query does not change what is nearest."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    scaled /= np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
    return np.column_stack([scaled, np.zeros(len(vectors))])


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, components in order: equal vectors have equal scores anywhere."""
    total = np.zeros(len(queries))
    for i in range(queries.shape[1]):
        total += queries[:, i] * vectors[:, i]
    return total + 0.0


def best_of(queries: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) that hold the k best of each query, ties included, with their scores."""
    rough = queries @ vectors.T
    if vectors.shape[0] > k:
        limit = np.partition(rough, -k, axis=1)[:, -k]
        slack = 1e-9 * (np.abs(queries).sum(axis=1) * np.abs(vectors).max(initial=0) + 1e-300)
        at = np.nonzero(rough >= (limit - slack)[:, None])
    else:
        at = np.nonzero(np.ones_like(rough, bool))
    return at[0], at[1], products(queries[at[0]], vectors[at[1]])


def first_places(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner in order: greatest score, then smallest id."""
    order = np.lexsort((ids, -score, owner))
    start = np.searchsorted(owner[order], owner[order])
    return order[np.arange(len(order)) - start < k]


def _one_per_id(vectors: Vectors) -> Vectors:
    """Of rows that repeat an id, the one whose vector is the least in bytes."""
    repeated = vectors.rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if repeated.isEmpty():
        return vectors
    least = vectors.rows.groupBy("vec_id").agg(F.min(F.struct("vec", "norm")).alias("v")).select("vec_id", "v.*")
    return vectors._replace(rows=written(least, "one_per_id"))


def _merged_ids(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``(vec, ids)``: vectors that a task sees once as they come, others at its end with their least ids."""

    def packed(vecs: list[bytes], ids: list[list[int]]) -> pa.RecordBatch:
        columns = [pa.array(vecs, pa.binary()), pa.array(ids, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["vec", "ids"])

    repeated: dict[bytes, list[int]] = {}
    for batch in batches:
        seen: dict[bytes, list[int]] = {}
        for vec, number in zip(batch.column("vec").to_pylist(), batch.column("vec_id").to_pylist(), strict=True):
            seen.setdefault(vec, []).append(number)
        for vec, ids in seen.items():
            if len(ids) > 1 or vec in repeated:
                repeated[vec] = sorted(repeated.get(vec, []) + ids)[:most]
        single = [(vec, ids) for vec, ids in seen.items() if vec not in repeated]
        yield packed([v for v, _ in single], [i for _, i in single])
    yield packed(list(repeated), list(repeated.values()))


def grown(vectors: Vectors) -> tuple[Tree, int]:
    """The tree, and the number of vectors."""
    total, norm = vectors.rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    drawn = vectors.rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec").collect()
    points = np.frombuffer(b"".join(bytes(r["vec"]) for r in drawn), vectors.kind).reshape(-1, vectors.dims)
    leaf_size = max(LEAF_SAMPLE, int(LEAF_ROWS * len(drawn) / max(total, 1)))
    return Tree(lifted(points.astype(np.float64), norm or 1.0), norm or 1.0, leaf_size), total


def calibrated_visits(vectors: Vectors, tree: Tree, is_query: Column, k: int, recall: float) -> int:
    """The least number of leaves after which calibration queries have the wanted recall.

    Up to ``CALIBRATION`` queries, drawn by a hash, are compared with all vectors. Each true neighbour
    costs as many visits as its leaf's place among the query's bins.
    """
    kind, dims = vectors.kind, vectors.dims
    drawn = vectors.rows.where(is_query).orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(CALIBRATION).collect()
    if not drawn:
        return tree.leaves
    asked_ids = np.array([r["vec_id"] for r in drawn])
    queries = np.frombuffer(b"".join(bytes(r["vec"]) for r in drawn), kind).reshape(-1, dims).astype(np.float64)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in batches:
            values, ids = matrix(batch.column("vec"), kind, dims), batch.column("vec_id").to_numpy()
            if not len(ids):
                continue
            who, which, score = best_of(queries, values, k + 1)
            other = asked_ids[who] != ids[which]
            who, which, score = who[other], which[other], score[other]
            leaf = tree.leaf_of(lifted(values[which], tree.norm)).astype(np.int64)
            held = [np.concatenate(x) for x in zip(held, (who, score, ids[which], leaf), strict=True)]
            first = first_places(held[0], held[1], held[2], k)
            held = [x[first] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["query", "score", "vec_id", "leaf"])

    found = vectors.rows.select("vec_id", "vec").mapInArrow(nearest, "query bigint, score double, vec_id bigint, leaf bigint")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "leaf"))), 1, k)
    truth = found.groupBy("query").agg(best.alias("best")).collect()
    needed: list[int] = []
    orders = list(tree.visits(asked(queries), tree.leaves))
    for row in truth:
        place = {leaf: i + 1 for i, leaf in enumerate(orders[row["query"]])}
        needed += [place[item["leaf"]] for item in row["best"]]
    needed.sort()
    return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] if needed else tree.leaves


class Parts(NamedTuple):
    """Of each leaf, its first part and the number of parts that its entries are dealt to."""

    first: np.ndarray
    blocks: np.ndarray


def parts_of(counts: np.ndarray, limit: int) -> Parts:
    """Neighbouring leaves share a part of up to ``limit`` entries; a larger leaf has parts of its own."""
    first, blocks = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    part, held = 0, 0
    for leaf, count in enumerate(counts.tolist()):
        if held and held + count > limit:
            part, held = part + 1, 0
        first[leaf] = part
        blocks[leaf] = max(1, -(-count // limit))
        if blocks[leaf] > 1:
            part, held = part + int(blocks[leaf]), 0
        else:
            held += count
    return Parts(first, blocks)


def _entries(vectors: Vectors, tree: Tree, most: int) -> DataFrame:
    """The index: ``(vec, ids, leaf)``, one row per different vector."""
    kind, dims = vectors.kind, vectors.dims

    def in_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf_of(lifted(matrix(batch.column("vec"), kind, dims), tree.norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    merged = vectors.rows.select("vec_id", "vec").mapInArrow(lambda b: _merged_ids(b, most), "vec binary, ids array<bigint>")
    least = F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, most)
    return written(merged.groupBy("vec").agg(least.alias("ids")).mapInArrow(in_leaves, "vec binary, ids array<bigint>, leaf int"), "entries")


def _routes(queries: DataFrame, vectors: Vectors, tree: Tree, parts: Parts, most: int) -> DataFrame:
    """``(part, query, vec, leaves)``: a query and the leaves that it visits in one part."""
    kind, dims = vectors.kind, vectors.dims

    def routed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, names = batch.column("vec").to_pylist(), batch.column("query").to_pylist()
            rows: list[tuple] = []
            found = tree.visits(asked(matrix(batch.column("vec"), kind, dims)), most) if vecs else iter(())
            for vec, name, leaves in zip(vecs, names, found, strict=True):
                to: dict[int, list[int]] = {}
                for leaf in leaves:
                    for block in range(int(parts.blocks[leaf])):
                        to.setdefault(int(parts.first[leaf]) + block, []).append(leaf)
                rows += [(part, name, vec, own) for part, own in to.items()]
                if len(rows) > QUERIES_AT_ONCE * 16:
                    yield _routes_batch(rows)
                    rows = []
            yield _routes_batch(rows)

    return queries.mapInArrow(routed, "part bigint, query string, vec binary, leaves array<int>")


def _routes_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32())]
    arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["part", "query", "vec", "leaves"])


def _search(kind: str, dims: int, most: int):
    def run(entries: pa.Table, routes: pa.Table) -> pa.Table:
        """The best ids of each query in one part, from the leaves that it visits."""
        names = routes.column("query")
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        if entries.num_rows and routes.num_rows:
            values = matrix(entries.column("vec"), kind, dims)
            queries = matrix(routes.column("vec"), kind, dims)
            leaf, ids = entries.column("leaf").to_numpy(), entries.column("ids").combine_chunks()
            id_starts, id_values = ids.offsets.to_numpy(), ids.values.to_numpy()
            visited = routes.column("leaves").combine_chunks()
            visitor = np.repeat(np.arange(len(queries)), np.diff(visited.offsets.to_numpy()))
            visited = visited.values.to_numpy()
            for number in np.unique(leaf):
                own, who = np.flatnonzero(leaf == number), visitor[visited == number]
                for at in range(0, len(who), QUERIES_AT_ONCE):
                    some = who[at : at + QUERIES_AT_ONCE]
                    asks, which, score = best_of(queries[some], values[own], most)
                    # Equal vectors: one row for each of their ids.
                    entry = own[which]
                    sizes = id_starts[entry + 1] - id_starts[entry]
                    ends = np.cumsum(sizes)
                    items = np.repeat(id_starts[entry] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
                    made = (np.repeat(some[asks], sizes), np.repeat(score, sizes), id_values[items])
                    first = first_places(*made, most)
                    held = [np.concatenate([h, m[first]]) for h, m in zip(held, made, strict=True)]
            first = first_places(*held, most)
            held = [x[first] for x in held]
        bounds = np.searchsorted(held[0], np.arange(routes.num_rows + 1)).astype(np.int32)
        scores = pa.ListArray.from_arrays(pa.array(bounds), pa.array(held[1]))
        ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(held[2]))
        return pa.table([names, scores, ids], names=["query", "scores", "ids"])

    return run


def nearest_neighbours(
    table: DataFrame,
    column: str = "embedding",
    k: int = K,
    step: int = QUERY_STEP,
    recall: float = RECALL,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each row whose id ``step`` divides.

    Nearest is the largest inner product in double precision, added up in the order of components;
    ties go to the smaller id, and a query's own id is no candidate. With fewer candidates than ``k`` a
    query visits what there is. Rows that ``vectors_of`` leaves out, vectors of zeros among them,
    take no part; of rows that repeat an id the one whose vector is the least in bytes does. An
    empty table gives no rows. Other columns are not read.

    All rows are in the index; the tree is grown from up to ``SAMPLE`` of them, drawn by a hash. With
    ``recall`` of 1 queries visit every leaf in which a calibration query has a neighbour.
    """
    session, schema = table.sparkSession, "query_id bigint, rank int, vec_id bigint, score double"
    vectors = vectors_of(table, column, zeros=False)
    if not vectors.dims:
        return session.createDataFrame([], schema)
    vectors = _one_per_id(vectors)
    is_query = F.col("vec_id") % step == 0
    tree, _ = grown(vectors)
    most = calibrated_visits(vectors, tree, is_query, k, recall)
    entries = _entries(vectors, tree, k + 1)
    # One number per leaf; the leaves are as many as the sample allows, whatever the table holds.
    sizes = {r["leaf"]: r["count"] for r in entries.groupBy("leaf").count().collect()}
    counts = np.array([sizes.get(i, 0) for i in range(tree.leaves)])
    # A query that finds fewer than k has to see more: leaves are taken until they hold enough.
    most = max(most, _enough(counts, k + 1))
    parts = parts_of(counts, PART_ROWS)
    lookup = session.createDataFrame(
        [(i, int(parts.first[i]), int(parts.blocks[i])) for i in range(tree.leaves)], "leaf int, first bigint, blocks bigint"
    )
    dealt = entries.join(F.broadcast(lookup), "leaf").withColumn(
        "part", F.col("first") + F.pmod(F.xxhash64("vec"), F.col("blocks"))
    )
    # Equal queries are searched for once, under a name of 128 bits.
    queries = vectors.rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.md5("vec").alias("query"), "vec")
    different = queries.groupBy("query").agg(F.first("vec").alias("vec")).select("query", "vec")
    routes = written(_routes(different, vectors, tree, parts, most), "routes")
    chunks = F.ceil(F.count(F.lit(1)) / PART_QUERIES).cast("int").alias("chunks")
    busy = written(routes.groupBy("part").agg(chunks), "busy")
    rows = dealt.select("part", "vec", "ids", "leaf").join(busy, "part")
    rows = rows.select("part", "vec", "ids", "leaf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    asks = routes.join(busy, "part").withColumn("chunk", F.pmod(F.xxhash64("query"), "chunks").cast("int")).drop("chunks")
    found = rows.groupBy("part", "chunk").cogroup(asks.groupBy("part", "chunk")).applyInArrow(
        _search(vectors.kind, vectors.dims, k + 1), "query string, scores array<double>, ids array<bigint>"
    )
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("s"), F.col("ids").alias("vec_id"))
    best = F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k + 1)
    tops = written(found.groupBy("query").agg(best.alias("best")), "tops")
    answered = salted_join(queries.select("query_id", "query"), tops, "query")
    others = F.slice(F.filter("best", lambda b: b.getField("vec_id") != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"),
        (F.lit(0.0) - F.col("b.s")).alias("score"),
    )


def _enough(counts: np.ndarray, wanted: int) -> int:
    """So many leaves hold ``wanted`` entries whichever they are, or all leaves."""
    held = np.cumsum(np.sort(counts))
    return int(min(len(counts), np.searchsorted(held, wanted) + 1))
