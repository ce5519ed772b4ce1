"""Connected components of a large graph, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.session import written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Every node has one label, and no label is labelled itself: one grouping tells."""
    ends = F.inline(
        F.array(
            F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
            F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
        )
    )
    counts = edges.select(ends).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return counts.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node in ``edges`` (a, b); the label is the least node reachable.

    Large star: a node's greater neighbours move to the least node around it. Small star: its
    smaller neighbours, and the node itself, move there too. Both keep components, and alternating
    them leaves one star per component after about log-squared rounds. Every round is two
    groupings and two joins over the edges, written to the shared folder; a node with very many
    neighbours is combined before the shuffle, and adaptive execution splits its join, as what it
    is joined with is written first: a grouping by the same key in the same stage would prevent it.
    Links that are stars already, as most of near copies are, need no round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "edges")
    while not _all_stars(edges):
        ways = _both_ways(edges)
        around = written(ways.groupBy("a").agg(F.min("b").alias("m")), "around")
        large = (
            ways.join(around, "a")
            .where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .where("a <> b")
        )
        large = written(large, "edges")
        below = written(large.groupBy("a").agg(F.min("b").alias("m")), "below")
        small = (
            large.join(below, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        edges = written(small, "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.unionByName(centres)
