"""Generating contracts from quotation payloads.

Gate, extraction, marking, merging and splitting are narrow column work on one parse of each
payload: the jobs below have no shuffle, so they scale with the number of input splits.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import MARKER
from inkfold.functions.files import encode_base64, result_name
from inkfold.operators.extract import Rule, document_type, rule_extract
from inkfold.operators.merge import (
    fields_of,
    merged_runs,
    merged_text,
    template_merge_data,
    template_texts,
)
from inkfold.operators.records import mark_record, parse_extraction
from inkfold.operators.segments import segment_runs
from inkfold.session import written
from inkfold.sources.quotations import payload_accepted, payload_id, read_payloads
from inkfold.sources.templates import Run

SEGMENT_COLUMNS = [
    ("part", "string"),
    ("section", "int"),
    ("run_seq", "int"),
    ("seg_seq", "int"),
    ("text", "string"),
    ("is_filled", "boolean"),
    ("underline", "string"),
    ("color", "string"),
    ("preserve_space", "boolean"),
]
GENERATED = 200
REJECTED = 422
FAILED = 500


def extract_records(payloads: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(payload, quotation_id, accepted, record)``; the record of a rejected line is null."""
    parsed = F.col("_parsed")
    accepted = payload_accepted(parsed)
    record = rule_extract(parsed.getField("result_quotation"), rules)
    return read_payloads(payloads.select("payload"), document_type(rules)).select(
        "payload",
        payload_id(parsed).alias("quotation_id"),
        accepted.alias("accepted"),
        F.when(accepted, record).alias("record"),
    )


def _exploded_runs(documents: DataFrame, usable: Column, template: Sequence[Run]) -> DataFrame:
    # The array is built inside the explode: as a column of its own it would be built a second
    # time by the filter that Spark infers for exploded columns.
    runs = F.when(usable, merged_runs(template, F.col("marked")))
    return documents.select("quotation_id", F.explode(runs).alias("_run")).select(
        "quotation_id", "_run.*"
    )


def generate_contracts(
    payloads: DataFrame, rules: Sequence[Rule], template: Sequence[Run]
) -> DataFrame:
    """The styled segments of the contract of every accepted payload."""
    return segments_of(extract_records(payloads, rules), template)


def segments_of(records: DataFrame, template: Sequence[Run]) -> DataFrame:
    marked = records.select(
        "quotation_id", "accepted", mark_record(F.col("record"), fields_of(template)).alias("marked")
    )
    return segment_runs(_exploded_runs(marked, F.col("accepted"), template))


def file_text(template: Sequence[Run], marked: Column) -> Column:
    """The text of a contract, one run per line, without markers."""
    lines = F.concat_ws("\n", *[merged_text(run, marked) for run in template])
    return F.replace(lines, F.lit(MARKER), F.lit(""))


def _results(usable: Column, failed: int | Column, text: Column, source: Column) -> list[Column]:
    file = encode_base64(F.encode(text, "UTF-8"))
    return [
        F.col("quotation_id"),
        usable.alias("accepted"),
        F.when(usable, GENERATED).otherwise(failed).alias("http_status"),
        F.when(usable, result_name(F.col("quotation_id"))).alias("file_name"),
        F.when(usable, file).alias("file_base64"),
        F.when(usable, F.col("record")).alias("contract_data"),
        F.when(~usable, source).alias("rejected"),
    ]


def contract_results(
    payloads: DataFrame, rules: Sequence[Rule], template: Sequence[Run]
) -> DataFrame:
    """One result per payload: file name, file, and the raw record without markers.

    Lines that the gate turns down stay as rows with their text in ``rejected``.
    """
    return results_of(extract_records(payloads, rules), template)


def results_of(records: DataFrame, template: Sequence[Run]) -> DataFrame:
    marked = records.withColumn("marked", mark_record(F.col("record"), fields_of(template)))
    return marked.select(*_results(F.col("accepted"), REJECTED, file_text(template, F.col("marked")), F.col("payload")))


def lasting_records(payloads: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Records to be written and read by several outputs: only rejected lines keep their payload."""
    records = extract_records(payloads, rules)
    return records.withColumn("payload", F.when(~F.col("accepted"), F.col("payload")))


def contract_outputs(
    payloads: DataFrame, rules: Sequence[Rule], template: Sequence[Run]
) -> tuple[DataFrame, DataFrame]:
    """``(contract_results, generate_contracts)`` of the same payloads, which are parsed once.

    Records are written once to the shared folder, and both frames read them.
    """
    records = written(lasting_records(payloads, rules), "records")
    return results_of(records, template), segments_of(records, template)


def contracts_from_templates(
    payloads: DataFrame,
    rules: Sequence[Rule],
    templates: DataFrame,
    template_id: Column,
    small: bool | None = None,
) -> DataFrame:
    """Styled segments of accepted payloads, merged into templates that a table holds.

    ``template_id`` is computed from the extracted ``record``. A payload whose template is not in
    the table fails alone: it has one row with ``http_status`` 500 and no segment. A document either
    fails or has segments, never both. Rejected payloads have no rows; ``contract_results`` is where
    they are kept.
    """
    records = extract_records(payloads, rules)
    return segments_from_templates(accepted_records(records), templates, template_id, small)


def accepted_records(records: DataFrame) -> DataFrame:
    """``(quotation_id, record)`` of what the gate lets through.

    Made inside an ``inline``: a filter would be pushed below the extraction and parse again.
    """
    kept = F.struct("quotation_id", "record")
    return records.select(F.inline(F.when(F.col("accepted"), F.array(kept))))


def segments_from_templates(
    records: DataFrame, templates: DataFrame, template_id: Column, small: bool | None = None
) -> DataFrame:
    """Segments, and a row with status 500 for each record without a template, in one pass."""
    documents = records.select("quotation_id", template_id.alias("template_id"), "record")
    merged = template_merge_data(documents, templates, small).drop("record")
    styled = merged.withColumns({n: F.lit(None).cast("string") for n in ("underline", "color") if n not in merged.columns})
    # A document that cannot be made passes through as one piece of text and comes out without it.
    found = F.col("template_found")
    carried = styled.withColumn("text", F.when(found, F.col("text")).otherwise(F.lit(".")))
    return segment_runs(carried).select(
        "quotation_id",
        "template_id",
        *[F.when(found, F.col(name)).cast(kind).alias(name) for name, kind in SEGMENT_COLUMNS],
        F.when(found, GENERATED).otherwise(FAILED).alias("http_status"),
    )


def results_from_templates(
    records: DataFrame, templates: DataFrame, template_id: Column, small: bool | None = None
) -> DataFrame:
    """One result per record of ``lasting_records``, merged into templates that a table holds.

    Rejected lines have status 422 and their text; a record without a template has status 500, and
    keeps its data.
    """
    documents = records.select(
        "payload", "quotation_id", "accepted", "record",
        F.when(F.col("accepted"), template_id).alias("template_id"),
    )
    merged = template_texts(documents, templates, small)
    made = F.col("accepted") & F.col("template_found")
    failed = F.when(F.col("accepted"), FAILED).otherwise(REJECTED)
    shown = merged.select(
        *_results(made, failed, F.col("file_text"), F.col("payload")),
        "record", "template_id", F.col("accepted").alias("_gated"),
    )
    return shown.withColumns({"contract_data": F.col("record"), "accepted": F.col("_gated")}).drop("record", "_gated")


def reply_results(replies: DataFrame, template: Sequence[Run]) -> DataFrame:
    """Results from the replies ``(quotation_id, reply)`` of a batch extractor.

    A reply that is not one JSON object fails its document only. ``contract_data`` is the view of
    the declared fields; ``reply`` is the whole reply as it came, with keys nobody declared, types,
    and absent keys told from null ones.
    """
    parsed, usable = parse_extraction(replies), F.col("parsed")
    raw = F.when(usable, F.col("reply")).alias("reply")
    text = file_text(template, F.col("marked"))
    return parsed.select(*_results(usable, FAILED, text, F.col("reply")), raw)


def reply_segments(replies: DataFrame, template: Sequence[Run]) -> DataFrame:
    """The styled segments of the contracts made from extractor replies."""
    return segment_runs(_exploded_runs(parse_extraction(replies), F.col("parsed"), template))
