"""Merging record values into templates, in one pass over the placeholders.

Values are never scanned for placeholders themselves, and a field without a value gives an
empty text.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import CONTRACT_FIELDS, MARKER
from inkfold.functions.text import wrap_value
from inkfold.operators.joins import HOT_ROWS, salted_join
from inkfold.operators.sizes import is_small
from inkfold.sources.parts import reading_order
from inkfold.sources.templates import Run, tokenize_templates


def fields_of(template: Sequence[Run]) -> list[str]:
    """The contract fields a template uses, in their declared order."""
    used = {field for run in template for _, field in run.pieces()}
    return [field for field in CONTRACT_FIELDS if field in used]


def merged_text(run: Run, values: Column) -> Column:
    """The text of one known run: literals and field columns side by side, null without text."""
    if run.text is None:
        return F.lit(None).cast("string")
    pieces, empty = [], F.lit("")
    for literal, field in run.pieces():
        if literal:
            pieces.append(F.lit(literal))
        if field in CONTRACT_FIELDS:
            pieces.append(F.coalesce(values.getField(field), empty))
    return F.concat(*pieces) if pieces else empty


def merged_runs(template: Sequence[Run], values: Column) -> Column:
    """All runs of a known template as an array: no join and no shuffle."""

    def style(value: str | None) -> Column:
        return F.lit(value).cast("string")

    return F.array(
        *[
            F.struct(
                F.lit(run.part).alias("part"),
                F.lit(run.section).alias("section"),
                F.lit(run.run_seq).alias("run_seq"),
                merged_text(run, values).alias("text"),
                style(run.underline).alias("underline"),
                style(run.color).alias("color"),
            )
            for run in template
        ]
    )


def template_merge(documents: DataFrame, template: Sequence[Run]) -> DataFrame:
    """One row per document and run of a template known when the job is written."""
    kept = [F.col(f"`{name}`") for name in documents.columns if name != "marked"]
    return documents.select(*kept, F.explode(merged_runs(template, F.col("marked"))).alias("_run")).select(
        *kept, "_run.*"
    )


def _with_runs(
    documents: DataFrame, templates: DataFrame, small: bool | None, limit: int
) -> tuple[DataFrame, list[Column], Column]:
    """Documents with the runs of their templates, the columns to keep, and the merged runs in reading order.

    A template is one row with its runs, so a document meets it once and its values travel once.
    Literals and places of fields of a run are laid side by side and merged inside the row, without
    grouping. Templates that pass the size check are broadcast; otherwise the join shuffles, with the
    documents of templates used more than ``limit`` times spread.

    Documents have their values in ``marked``, or unmarked in ``record``: then those that a run uses
    are marked when it takes them, and the others never.
    """
    declared = F.array(*[F.lit(field) for field in CONTRACT_FIELDS])
    # Places from 1, and 0 for a field nobody declared.
    places = F.transform("fields", lambda field: F.array_position(declared, field).cast("int"))
    tokenized = tokenize_templates(templates).drop("text").withColumn("fields", places)
    names = [name for name in tokenized.columns if name != "template_id"]
    shown = [name for name in names if name not in ("literals", "fields")]
    entry = F.struct(F.struct(*reading_order()).alias("place"), F.struct(*names).alias("run"))
    in_order = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e.getField("run"))
    whole = tokenized.groupBy("template_id").agg(in_order.alias("_runs")).withColumn("template_found", F.lit(True))
    small = is_small(templates) if small is None else small
    marked = "marked" in documents.columns
    source = F.col("marked" if marked else "record")
    values = F.array(*[source.getField(field) for field in CONTRACT_FIELDS])
    filled = documents.withColumn("_values", values).drop("marked")
    if small:
        joined = filled.join(F.broadcast(whole), "template_id", "left")
    else:
        joined = salted_join(filled, whole, "template_id", limit, "left")

    def value(place: Column) -> Column:
        found = F.get("_values", place - 1)
        return F.coalesce(found if marked else wrap_value(found), F.lit(""))

    def text(run: Column) -> Column:
        pieces = F.zip_with(
            run.getField("literals"),
            run.getField("fields"),
            lambda literal, place: F.concat(literal, value(place)),
        )
        return F.array_join(pieces, "")

    merged = F.transform(
        "_runs",
        lambda run: F.struct(*[run.getField(n).alias(n) for n in shown], text(run).alias("text")),
    )
    kept = [F.col(f"`{name}`") for name in filled.columns if name != "_values"]
    found = F.coalesce("template_found", F.lit(False)).alias("template_found")
    return joined, [*kept, found], merged


def template_merge_data(
    documents: DataFrame,
    templates: DataFrame,
    small: bool | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """One row per document and run, the runs taken from a table by ``template_id``.

    ``template_found`` tells whether the document's template is in the table. Where it is not, or the
    document names none, there is one row without a run: it cannot be made, and must not go unseen. A
    run without text has a row without text, which says nothing about its document.
    """
    joined, kept, merged = _with_runs(documents, templates, small, limit)
    return joined.select(*kept, F.inline_outer(merged))


def template_texts(
    documents: DataFrame,
    templates: DataFrame,
    small: bool | None = None,
    limit: int = HOT_ROWS,
) -> DataFrame:
    """One row per document with ``file_text``: its runs in reading order, one per line, without markers.

    Runs without text have no line. A document whose template is not in the table has no text.
    """
    joined, kept, merged = _with_runs(documents, templates, small, limit)
    lines = F.array_join(F.transform(merged, lambda run: run.getField("text")), "\n")
    return joined.select(*kept, F.replace(lines, F.lit(MARKER), F.lit("")).alias("file_text"))
