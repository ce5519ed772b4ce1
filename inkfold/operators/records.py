"""Contract records: projection, parsing of replies, key checks and listings."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import CONTRACT_FIELDS, SENTINEL
from inkfold.functions.documents import read_json, variant_text, with_json
from inkfold.functions.nested import wrap_json
from inkfold.functions.text import wrap_value


def contract_projection(df: DataFrame) -> DataFrame:
    """Exactly the 40 fields, as text, in their declared order."""
    return df.select(*[F.col(f"`{field}`").cast("string") for field in CONTRACT_FIELDS])


def payload_to_json(document: Column, pretty: bool = False) -> Column:
    """JSON text of a nested column, null members kept and non-ASCII letters as they are."""
    options = {"ignoreNullFields": "false"}
    if pretty:
        options["pretty"] = "true"
    return F.to_json(document, options)


def _shown(value: Column) -> Column:
    """How a template shows a JSON value: text is marked, other values are written as they are.

    Lists and objects are shown as JSON in which every string that is a value is marked, at any depth.
    """
    text, kind = variant_text(value), F.schema_of_variant(value)
    # Most keys of a reply are absent, and absent ones are settled without asking for a kind.
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(kind == "STRING", wrap_value(text))
        .when(kind == "VOID", F.lit("None"))
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(F.rlike(kind, F.lit("^(?:ARRAY|OBJECT)<")), wrap_json(text))
        .otherwise(text)
    )


def parse_extraction(replies: DataFrame) -> DataFrame:
    """Adds ``parsed``, ``record`` and ``marked`` to replies given as JSON text.

    ``parsed`` is false for text that is not one JSON object: that document fails, the job goes
    on. ``record`` is the typed view with null for absent keys. In ``marked`` JSON strings are
    marked, inside lists and objects too; other values are shown as they are.
    """
    members = ", ".join(f"`{field}`: VARIANT" for field in CONTRACT_FIELDS)
    reply = F.col("_reply")
    values = F.array(*[reply.getField(field) for field in CONTRACT_FIELDS])

    def view(name: str) -> Column:
        fields = [F.get(name, F.lit(i)).alias(f) for i, f in enumerate(CONTRACT_FIELDS)]
        return F.when(F.col("parsed"), F.struct(*fields))

    # One lambda over the values instead of 40 expressions: unrolled, the generated code would
    # be too large to compile.
    listed = with_json(replies, "_reply", "reply", f"STRUCT<{members}>").withColumns(
        {
            "parsed": reply.isNotNull(),
            "_texts": F.transform(values, variant_text),
            "_shown": F.transform(values, _shown),
        }
    )
    return listed.withColumns({"record": view("_texts"), "marked": view("_shown")}).drop(
        "_reply", "_texts", "_shown"
    )


def mark_record(record: Column, fields: Sequence[str] = CONTRACT_FIELDS) -> Column:
    """The given fields of a record with their values marked."""
    return F.struct(*[wrap_value(record.getField(field)).alias(field) for field in fields])


def schema_conformance(replies: DataFrame, fields: Sequence[str] = CONTRACT_FIELDS) -> DataFrame:
    """Adds ``missing`` and ``extra``: declared keys a reply lacks, and keys nobody declared.

    Both are null for a reply that is not one JSON object as a whole.
    """
    declared = F.array(*[F.lit(field) for field in fields])
    whole = read_json(F.col("reply"), "STRUCT<`_`: STRING>").isNotNull()
    keys = F.when(whole, F.json_object_keys(F.col("reply")))
    return replies.withColumns(
        {"missing": F.array_except(declared, keys), "extra": F.array_except(keys, declared)}
    )


def contract_key_values(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per record and field: ``(keys, field, value, is_not_found)``."""
    entries = F.array(
        *[
            F.struct(F.lit(field).alias("field"), F.col("record").getField(field).alias("value"))
            for field in CONTRACT_FIELDS
        ]
    )
    held = F.when(F.col("record").isNotNull(), entries)  # no rows for a rejected line
    return records.select(*keys, F.inline(held)).withColumn(
        "is_not_found", F.col("value").eqNullSafe(F.lit(SENTINEL))
    )
