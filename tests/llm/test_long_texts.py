"""Texts far longer than a piece: worked on in stretches, with the same results and bounded memory."""

import random
import subprocess
import sys
from pathlib import Path

import brute
import numpy as np
import pyarrow as pa
import pytest
from inkfold.llm import substring_dedup, suffix_dedup, words


def chunk_of(*texts):
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts)],
        names=["key", "sig", "text"],
    )
    return next(words.chunks([batch], limit=1 << 30))


TEXTS = [
    "x" * 400,
    "ab " * 200,
    "la la lo " * 70 + "z" * 300 + " end " * 60,
    " " * 300,
    "".join(random.Random(3).choices("abc d", k=900)),
    "é" * 120 + "\n" + "Wort " * 90,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("size", [40, 97, 256])
def test_pieces_have_the_anchors_of_the_whole(monkeypatch, text, size):
    chunk = chunk_of(text)
    whole = [x.tolist() for x in suffix_dedup.anchor_hashes(chunk)]
    by_word = words.find_words(chunk.data, chunk.offsets)
    seeds = [x.tolist() for x in substring_dedup.seeds_of(chunk, by_word)]
    hashes = words.word_hashes(chunk.data, by_word).tolist()
    distinct, twice = suffix_dedup.distinct_anchors(chunk), substring_dedup.seed_hashes(chunk)
    monkeypatch.setattr(words, "PIECE_BYTES", size)
    found = [(p, *suffix_dedup.own_anchors(p)) for p in words.byte_pieces(chunk, suffix_dedup.REACH, suffix_dedup.SPAN)]
    assert len(found) > 1
    assert np.concatenate([places + p.before for p, places, _, _ in found]).tolist() == whole[0]
    assert np.concatenate([h for _, _, h, _ in found]).tolist() == whole[1]
    found = [
        (p, *substring_dedup.own_seeds(p, w))
        for p, w in words.word_pieces(chunk, substring_dedup.REACH, substring_dedup.SPAN)
    ]
    assert [x for p, places, _, _ in found for x in (places + p.before).tolist()] == seeds[0]
    assert [x for _, _, h, _ in found for x in h.tolist()] == seeds[1]
    assert words.word_hashes(chunk.data, by_word).tolist() == hashes
    for a, b in ((distinct, suffix_dedup.distinct_anchors(chunk)), (twice, substring_dedup.seed_hashes(chunk))):
        assert all(x.tolist() == y.tolist() for x, y in zip(a, b, strict=True))


def test_hash_of_a_word_longer_than_a_block(monkeypatch):
    chunk = chunk_of("".join(random.Random(5).choices("abcé", k=5000)))
    by_word = words.find_words(chunk.data, chunk.offsets)
    whole = words.word_hashes(chunk.data, by_word)
    monkeypatch.setattr(words, "PIECE_BYTES", 1000)
    monkeypatch.setattr(words, "CHUNK_BYTES", 300)
    assert words.word_hashes(chunk.data, by_word).tolist() == whole.tolist()


def test_long_repetitions_against_brute_force(spark):
    texts = ["x" * 3000, "x" * 60 + " y", "ab " * 900, "one two three four five six seven " * 60, "ab " * 30, None, ""]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    for operator, slow in ((suffix_dedup.suffix_dedup, brute.suffix_dedup), (substring_dedup.substring_dedup, brute.substring_dedup)):
        found = sorted((tuple(r) for r in operator(docs, 1000).collect()), key=repr)
        assert found == sorted(slow(rows), key=repr)


#: Runs one operator's kernels, from hashes to the removal, on one long text in a process of its own.
KERNELS = """
import resource, sys
import numpy as np, pyarrow as pa
from inkfold.llm import contexts, recurring, substring_dedup as seven, suffix_dedup as four, words
kind, op = sys.argv[1:]
n = 20_000_000
letters = np.random.default_rng(1).integers(97, 123, n, np.uint8)
text = {"character": lambda: "x" * n, "word": lambda: "word " * (n // 5), "letters": lambda: letters.tobytes().decode()}[kind]()
del letters
def batch(**more):
    names = ["key", "sig", "text", *more]
    return pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([1], pa.int64()), pa.array([text]), *more.values()], names=names)
module = four if op == "op4" else seven
hashes_of = four.distinct_anchors if op == "op4" else seven.seed_hashes
[chunk] = words.chunks([batch()])
hashes, counts = hashes_of(chunk)
data = pa.array([hashes.tobytes()], pa.binary())
del hashes
[chunk] = words.chunks([batch(hashes=data)])
collector = four._Runs(8, 2, four.RUN_SUFFIXES) if op == "op4" else seven._Seeds(8, 2, seven.BLOCK_SEEDS)
rows = 0
for out in [collector.add(chunk), collector.emit()]:
    rows += sum(x.num_rows for x in out)
one_word = op == "op7" and kind != "word"
cuts = pa.array([np.array([0, 1] if one_word else [5, 700_000], np.int64).tobytes()], pa.binary())
[result] = module._cleaned([batch(cuts=cuts)])
print(rows, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("kind", ["character", "word", "letters"])
@pytest.mark.parametrize("op", ["op4", "op7"])
def test_memory_of_a_text_of_20_megabytes(kind, op):
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run(
        [sys.executable, "-c", KERNELS, kind, op], cwd=root, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr
    _, megabytes = map(int, done.stdout.split())
    print(op, kind, megabytes)
    assert megabytes < 1000
