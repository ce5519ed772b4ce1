"""Quotation payloads: one JSON object per line with an id and a document."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.functions.documents import (
    STRICT,
    is_json_string,
    variant_text,
    with_json,
)

ANY_OBJECT = "STRUCT<`_`: STRING>"
FILES_PER_BATCH = 10_000


def scan_payloads(
    spark: SparkSession,
    path: str,
    stream: bool = False,
    files_per_batch: int = FILES_PER_BATCH,
    whole_file: bool = False,
) -> DataFrame:
    """Landed payloads as ``(payload)``, unparsed so that a bad one cannot fail the scan.

    A payload is a line, or with ``whole_file`` a file: saved responses are often indented.
    """
    reader = spark.read
    if stream:
        reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path, wholetext=whole_file).withColumnRenamed("value", "payload")


def read_payloads(payloads: DataFrame, document_type: str = ANY_OBJECT) -> DataFrame:
    """Adds ``_parsed``, a struct of ``quotation_id VARIANT`` and ``result_quotation``.

    ``document_type`` is a STRUCT, which comes back null for anything but a JSON object. Reading
    the document straight into the fields a job needs saves parsing it again.
    """
    payload_type = f"STRUCT<quotation_id: VARIANT, result_quotation: {document_type}>"
    return with_json(payloads, "_parsed", "payload", payload_type)


def payload_id(parsed: Column) -> Column:
    """The id if it is a JSON string, else null."""
    quotation_id = parsed.getField("quotation_id")
    return F.when(is_json_string(quotation_id), variant_text(quotation_id))


def payload_accepted(parsed: Column) -> Column:
    """A string id that is not empty, and a document that is an object."""
    usable = (payload_id(parsed) != "") & parsed.getField("result_quotation").isNotNull()
    return F.coalesce(usable, F.lit(False))


def payload_gate(payloads: DataFrame) -> DataFrame:
    """Adds ``quotation_id`` (null unless a string) and ``accepted``; no line is dropped.

    Splitting by ``accepted`` gives the valid frame and the quarantine.
    """
    parsed = F.col("_parsed")
    return (
        read_payloads(payloads)
        .withColumns({"quotation_id": payload_id(parsed), "accepted": payload_accepted(parsed)})
        .drop("_parsed")
    )


def quotation_scan(payloads: DataFrame) -> DataFrame:
    """``(quotation_id, doc)`` of the accepted payloads, the document as JSON text."""
    # Read for accepted lines only, which are one JSON object as a whole: no end mark is needed again.
    document = F.from_json("payload", "STRUCT<result_quotation: STRING>", STRICT)
    parsed = F.col("_parsed")
    row = F.struct(
        payload_id(parsed).alias("quotation_id"), document.getField("result_quotation").alias("doc")
    )
    # Rejected lines give no row here; a filter would be pushed down and parse the line again.
    return read_payloads(payloads).select(
        F.inline(F.when(payload_accepted(parsed), F.array(row)))
    )
