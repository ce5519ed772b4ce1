"""Runs of words against the definition, tried for every period."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from inkfold.llm import periodic, queries, words

SCHEMA = "doc_id BIGINT, text STRING, start STRING, length STRING, period STRING, n_words STRING"


def plain_runs(w):
    """Maximal stretches where words q apart are identical, for each q; the smallest q counts."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def plain(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2])) if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, n, len(runs), *four, sha256(listed.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


def random_words(draw):
    kind = draw.random()
    alphabet = "ab" if kind < 0.4 else "abc" if kind < 0.7 else "abcdefghij"
    made = []
    while len(made) < draw.randint(0, 90):
        if draw.random() < 0.4:
            root = [draw.choice(alphabet) for _ in range(draw.randint(1, 7))]
            made += (root * 12)[: draw.randint(1, len(root) * draw.randint(1, 9))]
        else:
            made.append(draw.choice(alphabet))
    return made


@pytest.mark.parametrize("tree_words", [16, 1 << 16])
def test_runs(monkeypatch, tree_words):
    monkeypatch.setattr(periodic, "TREE_WORDS", tree_words)  # of 16: cut into windows
    draw = random.Random(1)
    for _ in range(600):
        w = random_words(draw)
        if w:
            numbers = np.unique(w, return_inverse=True)[1]
            found = periodic.runs_in(numbers)
            assert list(map(tuple, found.tolist())) == plain_runs(w)
            spans = periodic.stretches(numbers, np.array([0, len(w)]))
            for s, length, q in plain_runs(w):
                assert any(low <= s and s + length <= high for low, high in spans)
            assert periodic.longest_period(numbers) >= max((q for *_, q in plain_runs(w)), default=0)


def test_extensions_and_ranks():
    draw = random.Random(2)
    for _ in range(150):
        text = [draw.randint(1, draw.choice([1, 2, 5])) for _ in range(draw.randint(1, 40))]
        tree = periodic.SuffixTree(np.array(text))
        n = len(text)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        found = tree.extensions(*np.array(pairs).T)
        for (i, j), k in zip(pairs, found, strict=True):
            assert k == next((x for x in range(n + 1) if max(i, j) + x >= n or text[i + x] != text[j + x]), 0)
        for backwards in (False, True):
            signed = [-x for x in text] if backwards else text
            order = sorted(range(n + 1), key=lambda i: signed[i:])
            assert tree.ranks(backwards)[order].tolist() == list(range(n + 1))


def test_long_periodic_texts():
    for w, runs in (
        (["x"] * 300_000, [(0, 300_000, 1)]),
        ([f"w{i % 50_000}" for i in range(230_000)], [(0, 230_000, 50_000)]),
        ([f"w{i}" for i in range(200_000)], []),
    ):
        numbers = np.unique(w, return_inverse=True)[1]
        found = [
            (s + low, length, q)
            for low, high in periodic.stretches(numbers, np.array([0, len(w)]))
            for s, length, q in periodic.runs_in(numbers[low:high]).tolist()
        ]
        assert found == runs


def test_periodic_runs(spark, monkeypatch):
    draw = random.Random(3)
    texts = [draw.choice([" ", "\n", "\t  "]).join(random_words(draw)) for _ in range(300)]
    texts += [None, "", " \n", "a " * 500, "é ß é ß é ß é ß", "A a A a A a A a", "x\x00 x\x00 x\x00 x\x00 x\x00 x\x00"]
    made = [(i, t, "s", "l", "p", "n") for i, t in enumerate(texts)]
    made += [(None, texts[3], *"slpn"), (None, "b " * 9, *"slpn"), *made[:4]]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 15
    found = periodic.periodic_runs(spark.createDataFrame(made, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted((plain(r[0], r[1]) for r in made), key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("limit", [1, 300])
def test_chunks_do_not_show(monkeypatch, limit):
    draw = random.Random(5)
    texts = [" ".join(random_words(draw)) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["doc_id", "text"])
    monkeypatch.setattr(words.chunks, "__defaults__", ("text", limit))
    found = [tuple(r.values()) for b in periodic.scored([batch]) for r in b.to_pylist()]
    assert found == [plain(i, t) for i, t in enumerate(texts)]


def test_query_over_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"] or "") < 6000}
    found = queries.QUERIES["op12_periodic_runs"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    assert all(tuple(r) == plain(r["doc_id"], short[r["doc_id"]]) for r in found if r["doc_id"] in short)
