"""Column functions for cleaning, marking and splitting text values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.constants import (
    EDGE_CHARACTERS,
    MARKER,
    SENTINEL,
    WHITESPACE,
    WHITESPACE_CHARACTERS,
)


def is_blank(value: Column) -> Column:
    """True when the text is empty or holds nothing but Unicode whitespace."""
    return ~value.rlike(f"[^{WHITESPACE}]")


def blank_or_sentinel(value: Column) -> Column:
    """True for the exact "not found" text and for blank text; such values are never marked."""
    return (value == SENTINEL) | is_blank(value)


def wrap_value(value: Column, edges: str = EDGE_CHARACTERS) -> Column:
    """Cut the edge characters and put the fill marker on both sides."""
    marker = F.lit(MARKER)
    marked = F.concat(marker, F.btrim(value, F.lit(edges)), marker)
    return F.when(blank_or_sentinel(value), value).otherwise(marked)


def not_found_fill(value: Column) -> Column:
    return F.coalesce(value, F.lit(SENTINEL))


def split_marker(text: Column) -> Column:
    """Pieces between markers, empty ones kept: odd positions are the filled ones."""
    return F.split(text, MARKER, -1)


def filled_flag(position: Column) -> Column:
    return position % 2 == 1


def has_marker(text: Column) -> Column:
    return F.contains(text, F.lit(MARKER))


def count_markers(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(MARKER), F.lit("")))


def preserve_space(text: Column) -> Column:
    """True when either edge of the text is whitespace, which a word processor would drop.

    Only the two edge characters are looked at: a pattern would walk the whole text.
    """
    spaces = F.lit(WHITESPACE_CHARACTERS)
    first, last = F.substring(text, 1, 1), F.substring(text, -1, 1)
    return (text != "") & (F.contains(spaces, first) | F.contains(spaces, last))
