"""Vector operators against plain versions, on a table with awkward rows of all kinds."""

import hashlib
import math
import random

import numpy as np
import pytest
from inkfold.llm import nearest, queries, vector_codes
from pyspark.sql import functions as F

SCHEMA = (
    "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, vec STRING, norm STRING, ids STRING, leaf STRING, part STRING, "
    "query STRING, error STRING"
)


def row(i, vector, label=0):
    return (i, vector, label, "v", "n", "i", "l", "p", "q", "e")


def awkward(n=700, dims=8):
    pick = random.Random(3)

    def drawn(scale):
        return [float(np.float32(pick.gauss(0, scale))) for _ in range(dims)]

    made = [row(i, drawn(pick.choice([0.01, 0.3, 1, 40])), pick.choice([None, 1, 2, 3])) for i in range(n)]
    hot = drawn(1)
    made += [row(n + i, hot, 7) for i in range(n // 2)]
    made += [row(2 * n + i, [0.5] * dims, 7) for i in range(30)]
    made += [
        row(5000, None), row(5020, []), row(5040, [0.0] * dims), row(5060, [1.0] * (dims - 1) + [None]),
        row(5080, [1.0] * (dims - 1) + [math.nan]), row(5100, [1.0] * (dims - 1) + [-math.inf]),
        row(5120, [1.0] * (dims + 4)), row(None, drawn(1), None), row(5140, [-0.0, 1.0] * (dims // 2), None),
        row(5160, [60000.0, -60000.0] * (dims // 2)),
    ]
    return made


@pytest.fixture(scope="module")
def rows():
    made = awkward()
    return made + made[:8]  # repeated rows


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_codes(rows, dims=8, entries=256, rounds=4):
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label, *_ in rows
        if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    width = dims // 4
    first = sorted(kept, key=lambda r: r[0])[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(4)]

    def nearest_entry(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    def assign():
        return [[nearest_entry(r[1][p * width : (p + 1) * width], books[p]) for p in range(4)] for r in kept]

    for _ in range(rounds):
        found = assign()
        for p in range(4):
            for k in range(len(books[p])):
                own = [r[1][p * width : (p + 1) * width] for r, f in zip(kept, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    text = ",".join(str(x) for book in books for e in book for x in e)
    found, by_label = assign(), {}
    for r, f in zip(kept, found, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + sum(d for d, _ in f)
    return sorted(
        (r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[r[2]], hashlib.sha256(text.encode()).hexdigest())
        for r, f in zip(kept, found, strict=True)
    )


def test_vector_codes(table, rows):
    # Rows 0 to 7 occur twice and count twice; of the least ids they are the first sixteen.
    assert sorted(map(tuple, vector_codes.vector_codes(table).collect())) == plain_codes(rows)


def test_vector_codes_of_few_vectors(spark):
    made = [row(3, [1.0, 2.0, 3.0, 4.0], 1), row(1, [0.0, 0.0, 0.0, 0.0], None), row(2, [1.0, 2.0, 3.0, 4.001], None)]
    frame = spark.createDataFrame(made, SCHEMA).withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert sorted(map(tuple, vector_codes.vector_codes(frame).collect())) == plain_codes(made, 4)
    for other in ([], [row(1, [1.0, 2.0])], [row(1, None), row(None, None, None)]):
        assert vector_codes.vector_codes(spark.createDataFrame(other, SCHEMA)).collect() == []
    beyond = spark.createDataFrame([*made, row(0, [1e9, 0.0, 0.0, 0.0])], SCHEMA)
    assert {r["vec_id"] for r in vector_codes.vector_codes(beyond).collect()} == {1, 2, 3}


@pytest.mark.parametrize("scale", [3, 1000, 1 << 26])
def test_access_tree_finds_what_comparing_all_finds(scale):
    draw = np.random.default_rng(scale)
    for n in (1, 2, 16, 17, 256):
        entries = draw.integers(-scale, scale + 1, (n, 4))
        if n > 16:
            entries[draw.integers(0, n, 40)] = entries[0]  # equal entries: the lowest index wins
        asked = np.vstack([draw.integers(-scale, scale + 1, (300, 4)), entries, entries + 1])
        away = ((asked[:, None, :] - entries[None]) ** 2).sum(axis=2)
        entry, best = vector_codes.nearest_entries(vector_codes.Tree(entries, np.arange(n)), asked)
        assert entry.tolist() == away.argmin(axis=1).tolist() and best.tolist() == away.min(axis=1).tolist()


def test_access_tree_rules_subtrees_out(monkeypatch):
    draw = np.random.default_rng(1)
    centres = draw.integers(-100_000, 100_000, (16, 4))
    entries = (centres[:, None, :] + draw.integers(-50, 50, (16, 16, 4))).reshape(-1, 4)
    compared, squared = [], vector_codes.squared
    tree = vector_codes.Tree(entries, np.arange(256))
    monkeypatch.setattr(vector_codes, "squared", lambda a, b: compared.append(len(a) * len(b)) or squared(a, b))
    vector_codes.nearest_entries(tree, entries + 3)
    assert sum(compared) < 256 * 256 / 4


def plain_neighbours(rows, dims, k, step):
    kept = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == dims and any(v) and all(x is not None and math.isfinite(x) for x in v):
            kept[i] = np.array(v, np.float32).astype(np.float64)
    ids = np.array(sorted(kept))
    values = np.stack([kept[i] for i in ids])
    out = {}
    for i in ids[ids % step == 0]:
        score = np.zeros(len(ids))
        for c in range(dims):
            score += kept[i][c] * values[:, c]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_all_bins_give_the_exact_neighbours(table, rows, monkeypatch, small):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 40)
    monkeypatch.setattr(nearest, "calibrated_visits", lambda vectors, tree, *_: tree.leaves)
    if small:  # leaves over several parts, parts over several tasks
        monkeypatch.setattr(nearest, "PART_ROWS", 25)
        monkeypatch.setattr(nearest, "PART_QUERIES", 7)
    found = lists(nearest.nearest_neighbours(table).collect())
    assert found == plain_neighbours(rows, 8, 20, 20)


def test_recall_is_reached(spark, monkeypatch):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 16))
    values = (centres[draw.integers(0, 60, 6000)] + draw.normal(size=(6000, 16)) * 0.3) * draw.uniform(0.5, 2, (6000, 1))
    made = [row(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(values)]
    table = spark.createDataFrame(made, SCHEMA).repartition(4)
    monkeypatch.setattr(nearest, "LEAF_ROWS", 60)
    seen = []
    calibrated = nearest.calibrated_visits
    monkeypatch.setattr(nearest, "calibrated_visits", lambda *a: seen.append((calibrated(*a), a[1].leaves)) or seen[-1][0])
    found, truth = lists(nearest.nearest_neighbours(table).collect()), plain_neighbours(made, 16, 20, 20)
    assert found.keys() == truth.keys() and all(len(f) == 20 for f in found.values())
    hits = sum(len(set(found[q]) & set(truth[q])) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)
    assert seen[0][0] < seen[0][1] / 2  # fewer leaves than there are


def test_neighbours_of_few_vectors(spark):
    made = [row(0, [1.0, 0.0]), row(20, [1.0, 0.0]), row(3, [2.0, 0.0]), row(40, [0.0, 0.0]), row(7, [-1.0, 1.0])]
    found = lists(nearest.nearest_neighbours(spark.createDataFrame(made, SCHEMA)).collect())
    assert found == {0: [(3, 2.0), (20, 1.0), (7, -1.0)], 20: [(3, 2.0), (0, 1.0), (7, -1.0)]}
    for other in ([], [row(0, [1.0, 2.0])], [row(1, None), row(None, None, None)]):
        assert nearest.nearest_neighbours(spark.createDataFrame(other, SCHEMA)).collect() == []
    # Of rows that repeat an id, the vector that is the least in bytes.
    twice = spark.createDataFrame([row(0, [1.0, 0.0]), row(1, [4.0, 0.0]), row(1, [3.0, 0.0])], SCHEMA)
    least = min((np.array([x, 0], "<f4").tobytes(), x) for x in (4.0, 3.0))[1]
    assert lists(nearest.nearest_neighbours(twice).collect()) == {0: [(1, least)]}


def test_queries_over_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    codes = queries.QUERIES["op11_vector_codes"](spark, sf_dir).collect()
    assert sorted(map(tuple, codes)) == plain_codes(rows, len(rows[0][1]), rounds=4)
    found, truth = lists(queries.QUERIES["op13_nearest_neighbours"](spark, sf_dir).collect()), plain_neighbours(rows, 64, 20, 20)
    assert found.keys() == truth.keys()
    assert sum(len(set(found[q]) & set(truth[q])) for q in truth) >= 0.9 * sum(map(len, truth.values()))
