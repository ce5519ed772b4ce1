"""Near-duplicate documents: a size-aware join of word shingles by Jaccard similarity.

Only shingles that recur can be in an intersection, and a document needs three quarters of its
own in one partner; documents with fewer leave the join at once, and equal sets are one node.
Small (light) sets meet on subsets of the size that their overlap must have: a shared subset is
a link. Large (heavy) sets scan inverted lists of the rarest shingles, which also index the
light sets near them in size; what they find is compared in full. The boundary between the two
is the one with the least estimated cost.
"""

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.components import connected_components
from inkfold.llm.counted import Gathered, counted
from inkfold.llm.recurring import NO_ID, PART_BYTES, id_of, keyed, parts_for, row_key, row_sig
from inkfold.llm.repeats import one_of_repeats
from inkfold.llm.words import LOWER, Chunk, chunks, find_words, inside, mix, window_hashes, word_hashes
from inkfold.session import written

WORDS = 5
#: Links need 4 * intersection >= 3 * union.
OVER, UNDER = 3, 4
#: No boundary between light and heavy sets lies above this: subsets would be too many.
MOST_LIGHT = 16

#: A text has more shingles than its bytes would make of other hashes.
HASH_PARTS = 3
#: Bits of a hash that tell shingles apart, and words of the bitmap of a set.
TOLD_APART, BITMAP_WORDS = np.uint64(0xFFFFFFFFFFFFFF00), 16
#: A node is named by 96 bits of a hash of its set.
NODE_BYTES = 12
SETS = (
    "key bigint, sig bigint, n bigint, copies bigint, node string, shingles binary, bits array<bigint>, "
    "rare array<bigint>, kept int, totals double"
)
PAIRS = "a string, b string"
#: Members of an inverted list whose pairs are made at once; longer lists are dealt into blocks.
LIST_MEMBERS = 512
SUBSETS = "subset binary, low int, high int, n int, node string"


def shingle_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, by hash, and their numbers."""
    data = LOWER[chunk.data]
    words = find_words(data, chunk.offsets)
    hashes, sizes = word_hashes(data, words), np.diff(words.offsets)
    shingles = window_hashes(hashes, WORDS)
    starts = np.flatnonzero(inside(words.offsets, WORDS, len(shingles)))
    found, places = [shingles[starts]], [starts]
    for width in range(1, WORDS):  # short texts: the whole sequence, told apart by its length
        short = words.offsets[:-1][sizes == width]
        if len(short):
            whole = window_hashes(hashes, width)[short]
            found.append(mix(whole + np.uint64(width)))
            places.append(short)
    found, places = np.concatenate(found) & TOLD_APART, np.concatenate(places)
    texts = np.searchsorted(words.offsets, places, "right") - 1
    order = np.lexsort((found, texts))
    found, texts = found[order], texts[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (texts[1:] != texts[:-1])
    return found[fresh], np.bincount(texts[fresh], minlength=len(sizes))


def needed(n: int, m: int) -> int:
    """The least overlap of sets of n and m that makes them link."""
    return -(-OVER * (n + m) // (OVER + UNDER))


def partners(n: int, most: int) -> range:
    """Sizes that a set of n can link with, up to ``most``."""
    return range(-(-OVER * n // UNDER), min(most, UNDER * n // OVER) + 1)


def prefix_length(n: Column) -> Column:
    """So many of the rarest shingles of a set must hold one that a partner's hold too."""
    return n - F.ceil(n * OVER / UNDER) + 1


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bit b is set if an odd number of shingles falls on b.

    Of two sets' bitmaps, no more bits differ than shingles do.
    """
    places = (shingles >> np.uint64(20)) % np.uint64(64 * BITMAP_WORDS)
    odd = np.bincount(places.astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _nodes(found: Gathered) -> pa.Table:
    """One row per text with its node, the shared part of its set and the rarest shingles of it.

    Sets that recur as a whole are one node; a set with shingles of its own is a node of its own.
    A set of which too few shingles recur cannot link and has none. The order of shingles is the same for
    all: those that one text has come first and are counted only, then the rarer, then by hash.
    """
    nodes, sets, bits, rare = [], [], [], []
    for i, n in enumerate(found.n.tolist()):
        own = slice(found.bounds[i], found.bounds[i + 1])
        shared = found.hashes[own]
        if not n or UNDER * len(shared) < OVER * n:
            for column in (nodes, sets, bits, rare):
                column.append(None)
            continue
        salt = b"" if len(shared) == n else f"{found.keys[i]}:{found.sigs[i]}".encode()
        digest = hashlib.blake2b(shared.tobytes(), digest_size=NODE_BYTES, key=salt).digest()
        taken = n - -(-OVER * n // UNDER) + 1 - (n - len(shared))
        nodes.append(base64.b64encode(digest).decode())
        sets.append(shared.tobytes())
        bits.append(bitmap(shared))
        rare.append(shared[np.lexsort((shared, found.totals[own]))[:taken]].view(np.int64))
    entries = np.add.reduceat(np.append(found.totals, 0).astype(np.float64), found.bounds[:-1])
    entries[np.diff(found.bounds) == 0] = 0
    columns = {
        "key": pa.array(found.keys), "sig": pa.array(found.sigs), "n": pa.array(found.n),
        "copies": pa.array(found.copies), "node": pa.array(nodes, pa.string()),
        "shingles": pa.array(sets, pa.binary()), "bits": pa.array(bits, pa.list_(pa.int64())),
        "rare": pa.array(rare, pa.list_(pa.int64())), "kept": pa.array(np.diff(found.bounds).astype(np.int32)),
        "totals": pa.array(entries),
    }
    return pa.table(columns)


def _subsets(most: int):
    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["subset", "low", "high", "n", "node"]
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                n, node = row["n"], row["node"]
                items = [row["shingles"][at : at + 8] for at in range(0, len(row["shingles"]), 8)]
                for m in partners(n, most):
                    for chosen in combinations(items, needed(n, m)):
                        digest = hashlib.blake2b(b"".join(chosen), digest_size=16).digest()
                        rows.append((digest, min(n, m), max(n, m), n, node))
                if len(rows) > 20_000:
                    yield _batch(rows, names, kinds)
                    rows = []
            yield _batch(rows, names, kinds)

    return listed


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def light_links(nodes: DataFrame, most: int) -> DataFrame:
    """Links among sets of up to ``most`` shingles: they share a subset of the needed size.

    In a bucket every set of the one size links with every set of the other, so each is tied to
    the least set of the other size; that leaves the components as they are.
    """
    small = nodes.where(F.col("n") <= most)
    rows = small.select("n", "node", "shingles").mapInArrow(_subsets(most), SUBSETS)
    keys = ["subset", "low", "high"]
    rows = written(rows, "subsets")
    firsts = rows.groupBy(*keys).agg(
        F.min(F.when(F.col("n") == F.col("low"), F.col("node"))).alias("of_low"),
        F.min(F.when(F.col("n") == F.col("high"), F.col("node"))).alias("of_high"),
    )
    firsts = written(firsts, "firsts")
    other = F.when(F.col("n") == F.col("low"), F.col("of_high")).otherwise(F.col("of_low"))
    tied = rows.join(firsts.where("of_low IS NOT NULL AND of_high IS NOT NULL"), keys)
    return tied.select(F.col("node").alias("a"), other.alias("b")).where("a <> b").distinct()


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The greatest light size: least subsets of the light plus list entries of the heavy sets."""

    def cost(most: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= most:
                total += count * sum(math.comb(n, needed(n, m)) for m in partners(n, most))
            if UNDER * n >= OVER * most:
                total += count * (n - -(-OVER * n // UNDER) + 1) * list_length
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def prefixes(nodes: DataFrame, light: int) -> DataFrame:
    """``(shingle, node, n, alone, place)``: the rarest shingles of each set that heavy sets can meet.

    ``alone`` counts those that no other text has: they come first, and stand in no list.
    """
    indexed = nodes.where(F.col("n") * UNDER >= light * OVER)
    alone = (F.col("n") - F.col("kept")).alias("alone")
    listed = indexed.select("node", "n", alone, F.posexplode("rare").alias("at", "shingle"))
    return listed.select("shingle", "node", "n", "alone", (F.col("alone") + F.col("at")).alias("place"))


def _can_link(light: int) -> Column:
    """Sizes fit, and enough shingles follow in both for the overlap needed."""
    n, m = F.col("n"), F.col("m")
    fits = (F.least(n, m) * UNDER >= F.greatest(n, m) * OVER) & (F.greatest(n, m) > light)
    most = F.least(n - F.col("place"), m - F.col("other_place"))
    return fits & (most * (OVER + UNDER) >= (n + m) * OVER)


def _bits_agree() -> Column:
    """Not more bits differ, with the shingles of one document only, than the overlap allows."""
    apart = F.aggregate(
        F.zip_with("bits", "other_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))),
        F.col("alone") + F.col("other_alone"),
        lambda total, one: total + one,
    )
    n, m = F.col("n"), F.col("m")
    return apart <= n + m - 2 * F.ceil((n + m) * OVER / (OVER + UNDER)).cast("int")


def _linking(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that overlap enough."""
    for batch in batches:
        left, right = batch.column("s_a"), batch.column("s_b")
        sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        both = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (left, right))
            places = np.searchsorted(b, a)
            both[i] = np.count_nonzero(b[np.minimum(places, len(b) - 1)] == a)
        yield batch.select(["a", "b"]).filter(pa.array(both * (OVER + UNDER) >= sizes * OVER))


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, compared by all their shingles."""
    sides = [
        nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}"))
        for x in "ab"
    ]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_linking, PAIRS)


def components_of(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(key, sig, n, copies, component, first)``: one row per id and text, see ``near_duplicates``.

    ``first`` holds for one of them in each component: of those with the least id, that with the least
    signature.
    """
    rows = keyed(docs)
    groups = parts_for(rows, part_bytes)
    sets = written(counted(rows, shingle_hashes, groups, groups * HASH_PARTS, _nodes, SETS), "sets")
    nodes = written(
        sets.where("node IS NOT NULL").groupBy("node").agg(
            F.first("n").cast("int").alias("n"), F.first("shingles").alias("shingles"),
            F.first("bits").alias("bits"), F.first("rare").alias("rare"), F.first("kept").alias("kept"),
            F.first("totals").alias("totals"), F.min(F.struct("key", "sig")).alias("least"),
        ),
        "nodes",
    )
    labels = connected_components(links_of(nodes))
    own = nodes.select("node", "least").join(labels, "node", "left")
    own = written(own.withColumn("label", F.coalesce("label", "node")), "labels")
    # Written, so that adaptive execution can split the rows of a large component.
    least = written(own.groupBy("label").agg(F.min("least").alias("least")), "least")
    of_node = own.select("node", "label").join(least, "label").select("node", "least")
    sets = sets.select("key", "sig", "n", "copies", "node")
    first = (F.col("key") == F.col("least.key")) & (F.col("sig") == F.col("least.sig"))
    linked = sets.where("node IS NOT NULL").join(of_node, "node")
    linked = linked.withColumns({"component": F.col("least.key"), "first": first}).drop("least")
    alone = sets.where("node IS NULL").withColumns({"component": F.col("key"), "first": F.lit(True)})
    return linked.unionByName(alone).drop("node")


def near_duplicates(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row.

    The set of a text is its distinct shingles of ``WORDS`` words (runs of anything but
    ``[\\x20\\x09-\\x0D]``, A-Z lowered), or all its words if there are fewer. Null and empty texts
    have no shingles and no links. ``component_id`` is the least id reachable by links, the
    row's own included; rows without an id get that of their partners, or null. Repeated rows
    link to each other. Other columns are not read.

    Heavy sets are linked in two passes. The first compares each member of an inverted list with
    one of them only, the one with the fewest rarer shingles: of near copies that is the original.
    The second compares members of one list that are still in different components, unless their
    bitmaps differ in more bits than their sets may in shingles. So groups of near copies cost
    about their size, and no link is lost.

    Shingles are known by 56 bits of a hash, and sets are compared by these in full; the words
    themselves are not compared. Two different shingles of two documents of 500 words are taken
    for one with a chance below one in 10^11.
    """
    every = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return (
        components_of(docs, part_bytes)
        .select("*", every.alias("copy"))
        .select(
            id_of(),
            F.col("n").alias("n_shingles"),
            F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, all columns as they are: that with the least id.

    One stays as well of rows that repeat the least id, with one text or with several that are
    linked, and of components without ids.
    """
    first = written(components_of(docs).where("first").select("key", "sig", "copies"), "first")
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key"), row_sig().alias("sig"))
    if first.where("copies > 1").isEmpty():
        return rows.join(first.drop("copies").hint("shuffle_hash"), ["key", "sig"], "left_semi").select("row.*")
    met = rows.join(first.hint("shuffle_hash"), ["key", "sig"])
    return one_of_repeats(met, ["key", "sig"], F.col("copies") > 1)


def links_of(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that give the components of all links."""
    mean = nodes.agg((F.sum("totals") / F.sum("kept")).alias("x")).first()["x"]
    by_size = nodes.where(F.col("n") <= UNDER * MOST_LIGHT).groupBy("n").count().collect()
    light = boundary({r["n"]: r["count"] for r in by_size}, mean or 1.0)
    lists = written(prefixes(nodes, light), "prefixes")
    # Aggregates are written before they are joined by their key: adaptive execution splits a hot key
    # only where the other side of the join is not aggregated by it in the same stage.
    firsts = lists.groupBy("shingle").agg(
        F.min(F.struct("place", "node", "n")).alias("first"), F.count(F.lit(1)).alias("members")
    )
    firsts = written(firsts.where("members > 1"), "firsts")
    stars = lists.join(firsts, "shingle").select(
        F.col("node").alias("a"), "n", "place", F.col("first.node").alias("b"),
        F.col("first.n").alias("m"), F.col("first.place").alias("other_place"),
    )
    tried = written(stars.where((F.col("a") != F.col("b")) & _can_link(light)).select("a", "b").distinct(), "tried")
    found = written(light_links(nodes, light).unionByName(verified(tried, nodes)), "links")
    # Second pass: lists whose members are still apart.
    labels = connected_components(found)
    labelled = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = written(labelled.join(firsts.select("shingle", "members"), "shingle"), "labelled")
    apart = labelled.groupBy("shingle").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    apart = written(apart.where("least < most").select("shingle"), "apart")
    open_lists = labelled.join(apart, "shingle").join(nodes.select("node", "bits"), "node")
    open_lists = written(open_lists, "open")
    pairs = short_pairs(open_lists.where(F.col("members") <= LIST_MEMBERS), light).unionByName(
        long_pairs(open_lists.where(F.col("members") > LIST_MEMBERS), light, LIST_MEMBERS)
    )
    known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return found.unionByName(verified(pairs.distinct().join(known, ["a", "b"], "left_anti"), nodes))


def short_pairs(lists: DataFrame, light: int) -> DataFrame:
    """Members of one list that are still apart and may link."""
    others = lists.select(
        "shingle", F.col("node").alias("b"), F.col("n").alias("m"), F.col("alone").alias("other_alone"),
        F.col("place").alias("other_place"), F.col("label").alias("other_label"), F.col("bits").alias("other_bits"),
    )
    return (
        lists.withColumnRenamed("node", "a")
        .join(others, "shingle")
        .where((F.col("a") < F.col("b")) & (F.col("label") != F.col("other_label")) & _can_link(light) & _bits_agree())
        .select("a", "b")
    )


def long_pairs(lists: DataFrame, light: int, block: int) -> DataFrame:
    """The same for lists of many members: these are dealt into blocks, and blocks meet in pairs.

    A pair of blocks is a group of about two ``block`` members, which are compared as arrays; pairs
    become rows only if they may link. A list of k blocks sends each member to k groups.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = lists.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
        "node", "n", "alone", "place", "label", "bits",
    )

    def pairs(table: pa.Table) -> pa.Table:
        n, alone, place, own = (table.column(x).to_numpy().astype(np.int64) for x in ("n", "alone", "place", "own"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        label = np.unique(table.column("label").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        bits = np.stack(table.column("bits").to_numpy(zero_copy_only=False)).view(np.uint64)
        left, right = [], []
        others = np.flatnonzero(own == high)
        for i in np.flatnonzero(own == low):
            j = others[(label[others] != label[i]) & ((others > i) if low == high else True)]
            small, great = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            most = np.minimum(n[i] - place[i], n[j] - place[j])
            sums = n[i] + n[j]
            j = j[(small * UNDER >= great * OVER) & (great > light) & (most * (OVER + UNDER) >= sums * OVER)]
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) + alone[i] + alone[j]
            least = -(-(n[i] + n[j]) * OVER // (OVER + UNDER))
            j = j[differ <= n[i] + n[j] - 2 * least]
            left.append(np.full(len(j), i))
            right.append(j)
        names = table.column("node")
        ends = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right)]
        return pa.table([names.take(pa.array(x)) for x in ends], names=["a", "b"])

    found = met.groupBy("shingle", "low", "high").applyInArrow(pairs, PAIRS)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
