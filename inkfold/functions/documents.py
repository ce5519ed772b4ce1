"""Column functions over JSON text.

The text is read as the first element of an array whose last element is an end mark. Trailing
characters, a second value or a cut-off document leave an array of another length or without the
mark. The mark is the digest of the text, which no text holds, so none can close the array by itself;
and it is the same whenever a job is built, so that equal jobs have equal plans.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Standard quotes only, and no bound on the length of texts and numbers below that of a string.
STRICT = {
    "allowSingleQuotes": "false",
    "maxStringLen": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
}
FALSY_JSON = r'^(?:null|false|""|\[\s*\]|\{\s*\}|-?0(?:\.0*)?(?:[eE][-+]?[0-9]+)?)$'
JSON_SPACE = " \t\r\n"


#: The member of a struct that holds the mark.
END = "end of text"


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


class _Framed:
    """One read of a JSON value between brackets, with its end mark.

    The mark is an element of the type that is read: for structs, a member that only it has.
    """

    def __init__(self, ddl: str):
        self.in_struct = ddl.startswith("STRUCT<")
        if self.in_struct:
            ddl = f"{ddl[:-1]}, `{END}`: STRING>"
        elif ddl != "STRING":
            raise ValueError(f"read as a STRUCT or as a STRING, not as {ddl}")
        self.ddl = ddl

    def values(self, text: Column, digest: Column) -> Column:
        opening, closing = (f',{{"{END}":"', '"}]') if self.in_struct else (',"', '"]')
        framed = F.concat(F.lit("["), text, F.lit(opening), digest, F.lit(closing))
        return F.from_json(framed, f"ARRAY<{self.ddl}>", STRICT)

    def only(self, values: Column, digest: Column) -> Column:
        last = F.get(values, F.lit(1))
        ended = (last.getField(END) if self.in_struct else last) == digest
        return F.when((F.size(values) == 2) & ended, F.get(values, F.lit(0)))


def _named(value: Column, use) -> Column:
    """``use`` of a value under a name: two uses of it still cost one evaluation."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read_json(text: Column, ddl: str) -> Column:
    """The single JSON value in ``text`` as the given type; null if it is not exactly one value."""
    framed = _Framed(ddl)
    return _named(
        _digest(text), lambda digest: _named(framed.values(text, digest), lambda v: framed.only(v, digest))
    )


def with_json(df: DataFrame, name: str, text: str, ddl: str) -> DataFrame:
    """``read_json`` as a column of the frame, in steps that compile better than lambdas."""
    framed, digest = _Framed(ddl), F.col("_digest_of_text")
    return (
        df.withColumn("_digest_of_text", _digest(F.col(text)))
        .withColumn(name, framed.values(F.col(text), digest))
        .withColumn(name, framed.only(F.col(name), digest))
        .drop("_digest_of_text")
    )


def is_json_string(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def variant_text(value: Column) -> Column:
    """A string without its quotes, anything else as JSON text."""
    return F.try_variant_get(value, "$", "string")


def json_truthy(text: Column) -> Column:
    """Truth of a JSON value given as text: null, false, zero and empty values are false."""
    return ~F.btrim(text, F.lit(JSON_SPACE)).rlike(FALSY_JSON)


def variant_truthy(value: Column) -> Column:
    return F.coalesce(json_truthy(F.to_json(value)), F.lit(False))
