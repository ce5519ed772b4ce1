"""Marking of the strings inside nested values: by the type of a column, or in JSON of any shape."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.constants import EDGE_CHARACTERS
from inkfold.functions.text import wrap_value

# How JSON writes the whitespace that it may not hold as it is.
ESCAPED_SPACE = {
    r"\t": "\t",
    r"\n": "\n",
    r"\r": "\r",
    r"\f": "\f",
    r"\u000B": "\x0b",
    r"\u001C": "\x1c",
    r"\u001D": "\x1d",
    r"\u001E": "\x1e",
    r"\u001F": "\x1f",
}
#: Stand for an escaped backslash and an escaped quote; JSON holds no control character as it is.
BACKSLASH, QUOTE = "\x01", "\x02"


def holds_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(holds_text(field.dataType) for field in dtype)
    if isinstance(dtype, T.ArrayType):
        return holds_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return holds_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def wrap_nested(value: Column, dtype: T.DataType) -> Column:
    """Apply ``wrap_value`` to every string value of a struct, array or map.

    Map keys, numbers and subtrees without text come back as they are.
    """
    if not holds_text(dtype):
        return value
    if isinstance(dtype, T.StringType):
        return wrap_value(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: wrap_nested(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: wrap_nested(item, dtype.valueType))
    fields = [
        wrap_nested(value.getField(field.name), field.dataType).alias(field.name)
        for field in dtype
    ]
    return F.when(value.isNotNull(), F.struct(*fields))


def wrap_json(json: Column) -> Column:
    """Apply ``wrap_value`` to every string value of a JSON text, however deep; keys stay.

    The text is one that Spark writes: without spaces between tokens. It is cut at its quotes, so
    that every second piece is the inside of a string, and a key if a colon follows. All of this takes
    time in proportion to the text, whatever its shape.
    """
    escapes = {r"\\": BACKSLASH, r"\"": QUOTE} | ESCAPED_SPACE
    plain = json
    for escape, character in escapes.items():
        plain = F.replace(plain, F.lit(escape), F.lit(character))

    def marked(pieces: Column) -> Column:
        def shown(piece: Column, at: Column) -> Column:
            is_key = F.startswith(F.get(pieces, at + 1), F.lit(":"))
            return F.when((at % 2 == 1) & ~is_key, wrap_value(piece, EDGE_CHARACTERS + QUOTE)).otherwise(piece)

        return F.array_join(F.transform(pieces, shown), '"')

    # The lambda names the pieces, which are looked at from every one of them.
    text = F.get(F.transform(F.array(F.split(plain, '"', -1)), marked), F.lit(0))
    for escape, character in reversed(escapes.items()):
        text = F.replace(text, F.lit(character), F.lit(escape))
    return text
