"""Names, keys and text encoding of result files."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.constants import RESULT_DEFAULT_PREFIX, RESULT_PREFIX, RESULT_SUFFIX


def result_name(quotation_id: Column) -> Column:
    return F.concat(F.lit(RESULT_PREFIX), quotation_id, F.lit(RESULT_SUFFIX))


def shown_name(file_name: Column, quotation_id: Column) -> Column:
    """The name a client saves under: the given one, or a plain one where it is absent."""
    plain = F.concat(F.lit(RESULT_DEFAULT_PREFIX), quotation_id, F.lit(RESULT_SUFFIX))
    return F.coalesce(file_name, plain)


def encode_base64(data: Column) -> Column:
    """Base64 on one line; Spark's own result is broken into lines of 76 characters."""
    return F.replace(F.base64(data), F.lit("\r\n"), F.lit(""))


def decode_base64(text: Column) -> Column:
    return F.unbase64(text)


def record_id(*parts: Column) -> Column:
    """A key that a repeated job gives again, unlike a random one."""
    return F.sha2(F.concat_ws("\x1f", *[part.cast("string") for part in parts]), 256)
