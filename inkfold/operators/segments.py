"""Runs and their filled and unfilled segments."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.constants import FILLED_COLOR, FILLED_UNDERLINE
from inkfold.functions.text import (
    count_markers,
    filled_flag,
    has_marker,
    preserve_space,
    split_marker,
)
from inkfold.operators.ordered import GROUP_ROWS, dense_position, ordered_lists
from inkfold.sources.parts import reading_order


def run_text_concat(
    pieces: DataFrame, keys: list[str], order: str = "piece_seq", limit: int = GROUP_ROWS
) -> DataFrame:
    """``(keys, chunk_seq, chunks, markers_before, markers, text)`` from the pieces of each run.

    Null and empty pieces add nothing. A run is cut after every ``limit`` pieces, and its rows'
    texts joined by ``chunk_seq`` are the run. The markers in the earlier rows and in the whole
    run tell where the pieces of a row stand; segments across a cut are put together again by
    ``segment_runs``, so that ``limit`` never shows in segments.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = ordered_lists(
        pieces, keys, [order, "text"], text, name="_pieces", measure=count_markers(text), limit=limit
    )
    return lists.select(
        *keys,
        "chunk_seq",
        "chunks",
        F.col("before").alias("markers_before"),
        F.col("total").alias("markers"),
        F.array_join("_pieces", "").alias("text"),
    )


def marked_run_filter(runs: DataFrame) -> DataFrame:
    """Runs with a marker in their text; runs without text are not among them."""
    return runs.where(has_marker(F.col("text")))


def nonempty_segments(segments: DataFrame) -> DataFrame:
    """Leave out empty pieces after their places are known, so the others keep their parity."""
    return segments.where(F.col("text") != "")


def split_segments(runs: DataFrame) -> DataFrame:
    """Every piece of every run with ``seg_seq`` and ``is_filled``, empty pieces included.

    Runs without a marker come back whole, as one unfilled piece. The other columns stay. Where
    ``run_text_concat`` cut a run into several rows, the pieces at the cuts are joined.
    """
    inner = ("text", "markers_before", "markers", "chunk_seq", "chunks")
    kept = [F.col(f"`{name}`") for name in runs.columns if name not in inner]
    marked = has_marker(F.col("text"))
    if "markers" in runs.columns:
        start, is_split = F.col("markers_before"), F.col("markers") > 0
    else:
        start, is_split = F.lit(0), marked
    pieces = F.when(marked, split_marker(F.col("text"))).otherwise(F.array("text"))
    parts = [F.col("chunk_seq"), F.col("chunks")] if "chunks" in runs.columns else []
    exploded = runs.select(
        *kept,
        *parts,
        start.alias("_start"),
        is_split.alias("is_split"),
        F.size(pieces).alias("_size"),
        F.posexplode(pieces).alias("_at", "text"),
    )
    seg_seq = (F.col("_start") + F.col("_at")).cast("int")
    placed = exploded.withColumns({"seg_seq": seg_seq, "is_filled": filled_flag(seg_seq)})
    if parts:
        placed = _joined_at_cuts(placed)
    return placed.drop("_start", "_at", "_size", "chunk_seq", "chunks")


def _joined_at_cuts(pieces: DataFrame) -> DataFrame:
    """The first and last pieces of neighbouring parts of a run become one segment again.

    Only these are grouped; what a group collects is the text of one segment, which is one value
    of the result in any case. Runs of one part fall out of this branch when it is planned.
    """
    first = (F.col("_at") == 0) & (F.col("chunk_seq") > 0)
    last = (F.col("_at") == F.col("_size") - 1) & (F.col("chunk_seq") < F.col("chunks") - 1)
    at_cut = (F.col("chunks") > 1) & (first | last)
    names = [n for n in pieces.columns if n not in ("text", "chunk_seq", "chunks", "_start", "_at", "_size")]
    keys = [F.col(f"`{name}`") for name in names]
    in_order = F.sort_array(F.collect_list(F.struct("chunk_seq", "text")))
    whole = F.array_join(F.transform(in_order, lambda p: p.getField("text")), "")
    joined = pieces.where(at_cut).groupBy(*keys).agg(whole.alias("text"))
    columns = [*keys, F.col("text")]
    return pieces.where(~at_cut).select(*columns).unionByName(joined.select(*columns))


def segment_style(segments: DataFrame) -> DataFrame:
    """Filled text is underlined and red; other pieces of a split run lose both.

    Runs that were not split keep the style of the template.
    """
    own = segments.columns

    def style(name: str, filled: str):
        template = F.col(name) if name in own else F.lit(None).cast("string")
        return F.when(F.col("is_filled"), F.lit(filled)).when(~F.col("is_split"), template)

    return segments.withColumns(
        {
            "underline": style("underline", FILLED_UNDERLINE),
            "color": style("color", FILLED_COLOR),
        }
    )


def segment_runs(runs: DataFrame) -> DataFrame:
    """Runs to styled segments: split, place, drop empty pieces, style.

    No shuffle, but of the pieces at the cuts of runs that ``run_text_concat`` laid out in parts.
    """
    styled = segment_style(nonempty_segments(split_segments(runs)))
    return styled.withColumn("preserve_space", preserve_space(F.col("text"))).drop("is_split")


def segment_order(
    segments: DataFrame, keys: list[str], limit: int = GROUP_ROWS, runs: DataFrame | None = None
) -> DataFrame:
    """Adds ``position``: the place of a segment in its document, from 1 without gaps.

    ``runs`` are the runs, or the pieces of runs, that the segments were made from: a document has no more
    segments than these have markers and texts, so whether it is a long one is known before anything
    is split. Segments are then made once, and written only if there is a long document.
    """
    order = [*reading_order(), F.col("seg_seq")]
    if runs is None:
        return dense_position(segments, keys, order, limit=limit)
    most = count_markers(F.coalesce("text", F.lit(""))) + 1
    return dense_position(segments, keys, order, limit=limit, counted=runs.select(*keys, "text"), weight=most)
