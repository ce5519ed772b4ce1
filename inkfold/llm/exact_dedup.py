"""Exact duplicates of whole texts, combined in three stages that no hot text can overload."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.repeats import one_of_repeats
from inkfold.session import written

#: One bit of a bigint each, so that the salts of a text are a mask of fixed width.
SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of ``[\\x20\\x09-\\x0D]`` becomes one space; null counts as empty.

    Single spaces, nearly all runs, are left out of the pattern: replacing them changes nothing.
    """
    runs = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), runs, " ")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``_norm``, ``_digest`` and ``_salt``."""
    norm = normalised(F.col(text_col))
    salt = F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")
    return docs.withColumn("_norm", norm).withColumns({"_digest": F.sha2("_norm", 256), "_salt": salt})


def verdicts(digests: DataFrame) -> DataFrame:
    """``(_digest, _salt, keep_id, group_size)`` from ``(doc_id, _norm, _digest, _salt)``."""
    salted = digests.groupBy("_digest", "_salt", "_norm").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    winners = (
        salted.repartition("_digest")
        .groupBy("_digest", "_norm")
        .agg(
            F.min("first_id").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("salts"),
        )
        .groupBy("_digest")
        .agg(
            F.first("keep_id").alias("keep_id"),
            F.first("group_size").alias("group_size"),
            F.first("salts").alias("salts"),
            F.count(F.lit(1)).alias("texts"),
        )
    )
    one_text = F.when(
        F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256 digest"))
    ).otherwise(F.col("group_size"))
    all_salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    own_salts = F.filter(all_salts, lambda s: F.getbit("salts", s) == 1)
    return winners.select(
        "_digest",
        "keep_id",
        one_text.cast("bigint").alias("group_size"),
        F.explode(own_salts).alias("_salt"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per input row.

    Stage 1 counts equal texts inside each task, before anything is shuffled. Stage 2 merges
    them by digest and salt, so that a text that a third of all rows share meets in ``SALTS``
    tasks. Stage 3 combines the winners of the salts. The full text is part of the key at every
    stage; two texts with one digest, should they ever exist, stop the job instead of merging.
    The verdict returns to the rows by digest and salt, which spreads hot texts again.

    Null texts equal empty ones. Rows that repeat both id and text are one document: all kept or
    all dropped; a null id is kept only if its whole group has no id. ``without_copies`` leaves one of
    them. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    digests = digested(rows, "doc_id", "text")
    return (
        digests.drop("_norm", "text")
        .join(verdicts(digests), ["_digest", "_salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("_digest").alias("text_sha256"),
        )
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, all columns as they are: that with the least id.

    See ``exact_dedup``. Of rows that repeat the least id, or of a group without ids, one stays as
    well. Whether any id is repeated is counted first, from the ids alone; where none is, no row is
    looked at a second time.
    """
    digests = digested(docs.select("doc_id", "text"), "doc_id", "text")
    # The row as one value: none of its columns can clash with those used here.
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    rows = digested(rows, "doc_id", "text").drop("_norm", "text")
    verdict = verdicts(digests)
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = written(repeated.select(F.col("doc_id").alias("keep_id"), F.lit(True).alias("repeated")), "repeated")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if repeated.isEmpty():
        met = rows.join(verdict.hint("shuffle_hash"), ["_digest", "_salt"])
        return met.where(first).select("row.*")
    verdict = verdict.join(repeated, "keep_id", "left").hint("shuffle_hash")
    met = rows.join(verdict, ["_digest", "_salt"]).where(first)
    # A join leaves ids that are null unmatched: their rows are repeated, or taken for it.
    return one_of_repeats(met, ["_digest"], F.coalesce("repeated", F.col("keep_id").isNull()))
