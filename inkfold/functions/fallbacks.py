"""First-usable-value rules over response bodies given as JSON text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.constants import (
    DISPLAY_NAME_DEFAULT,
    LOGIN_ERROR_DEFAULT,
    QUOTATION_ERROR_DEFAULT,
    UNKNOWN_CAUSE,
)
from inkfold.functions.documents import (
    JSON_SPACE,
    json_truthy,
    read_json,
    variant_text,
    variant_truthy,
)


def _object(body: Column, keys: list[str]) -> Column:
    return read_json(body, "STRUCT<" + ", ".join(f"`{key}`: VARIANT" for key in keys) + ">")


def _is_object(body: Column) -> Column:
    return F.startswith(F.btrim(body, F.lit(JSON_SPACE)), F.lit("{"))


def first_truthy(body: Column, keys: list[str], default: str) -> Column:
    """Text of the first key whose value is not empty, zero, false or null; else the default."""

    def choose(parsed: Column) -> Column:
        found = [
            F.when(variant_truthy(parsed.getField(key)), variant_text(parsed.getField(key)))
            for key in keys
        ]
        return F.coalesce(*found, F.lit(default))

    return F.get(F.transform(F.array(_object(body, keys)), choose), F.lit(0))


def key_or_default(body: Column, key: str, default: str) -> Column:
    """Text of the key; the default only where the key is absent, so an empty text stays."""

    def choose(parsed: Column) -> Column:
        value = parsed.getField(key)
        return F.when(value.isNull(), F.lit(default)).otherwise(variant_text(value))

    return F.get(F.transform(F.array(_object(body, [key])), choose), F.lit(0))


def login_error(body: Column) -> Column:
    return first_truthy(body, ["error", "detail"], LOGIN_ERROR_DEFAULT)


def quotation_error(body: Column) -> Column:
    return first_truthy(body, ["detail", "error"], QUOTATION_ERROR_DEFAULT)


def client_error(body: Column) -> Column:
    """What the client shows of a refused login: ``error`` alone, then the default."""
    return first_truthy(body, ["error"], LOGIN_ERROR_DEFAULT)


def logged_error(body: Column) -> Column:
    """What the log shows of a refused login: the default only where ``error`` is absent."""
    return F.when(_is_object(body), key_or_default(body, "error", UNKNOWN_CAUSE)).otherwise(F.lit(""))


def upstream_detail(body: Column) -> Column:
    return key_or_default(body, "detail", LOGIN_ERROR_DEFAULT)


def display_name(user: Column) -> Column:
    return first_truthy(user, ["username", "name", "email"], DISPLAY_NAME_DEFAULT)


def success_flag(body: Column) -> Column:
    """Truth of ``success`` in an object body, of the body itself otherwise; null if not JSON."""
    truth = F.when(
        _is_object(body), variant_truthy(_object(body, ["success"]).getField("success"))
    ).otherwise(json_truthy(body))
    return F.when(read_json(body, "STRING").isNotNull() | _is_null_text(body), truth)


def login_accepted(body: Column) -> Column:
    """A login counts in the client only if it succeeded and carries a token in ``data``."""
    parsed = _object(body, ["success", "data"])
    both = F.transform(
        F.array(parsed),
        lambda p: variant_truthy(p.getField("success")) & variant_truthy(p.getField("data")),
    )
    return F.get(both, F.lit(0))


def _is_null_text(body: Column) -> Column:
    return F.btrim(body, F.lit(JSON_SPACE)) == "null"
