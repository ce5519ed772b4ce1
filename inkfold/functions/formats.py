"""Display formats of times, dates, amounts and lists."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkfold.constants import (
    AMOUNT_WORD,
    BUDDHIST_ERA_OFFSET,
    CURRENCY_WORD,
    INSTALMENT_WORD,
    PAY_WORD,
    THAI_MONTHS,
)
from inkfold.functions.text import is_blank

LIST_SEPARATOR = ", "
# Commas between digit groups, the currency word at the end, and spaces around them.
AMOUNT_DRESS = rf"(?<=\d),(?=\d{{3}}(?:\D|$))|\s*{CURRENCY_WORD}\s*$|^\s+|\s+$"


def log_timestamp(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``, fractions cut off; no zone shift for zone-less times."""
    return F.substring(ts.cast("string"), 1, 19)


def _as_it_is(value: Column) -> Column:
    """The text of a value that is there but cannot be read: never to be taken for a missing one."""
    text = value.cast("string")
    return F.when(~is_blank(text), text)


def thai_date(value: Column) -> Column:
    """Day, Thai month name and Buddhist-era year of a date or ISO date text, else the text."""
    date = value.try_cast("date")
    months = F.expr(f"array({', '.join(repr(month) for month in THAI_MONTHS)})")
    shown = F.concat(
        F.dayofmonth(date).cast("string"),
        F.lit(" "),
        F.element_at(months, F.month(date)),
        F.lit(" "),
        (F.year(date) + BUDDHIST_ERA_OFFSET).cast("string"),
    )
    return F.coalesce(shown, _as_it_is(value))


def _grouped(value: Column) -> Column:
    """The amount without its grouping commas and currency word, shown again; null if unreadable."""
    text = value.cast("string")
    # A number reads the same with spaces around it, so the pattern is for the other two.
    dressed = F.contains(text, F.lit(",")) | F.contains(text, F.lit(CURRENCY_WORD))
    plain = F.when(dressed, F.regexp_replace(text, AMOUNT_DRESS, "")).otherwise(text)
    return F.format_number(plain.try_cast("decimal(38,2)"), 2)


def grouped_amount(value: Column) -> Column:
    """Digits grouped by thousands with two decimals, rounded half up; other text as it is."""
    return F.coalesce(_grouped(value), _as_it_is(value))


def baht_amount(value: Column) -> Column:
    """A grouped amount with the currency word; text that is no amount as it is."""
    return F.coalesce(F.concat(_grouped(value), F.lit(f" {CURRENCY_WORD}")), _as_it_is(value))


def payment_terms(terms: Column) -> Column:
    """One line of text from instalments ``(pct, note, amount)``, in the order given."""

    def one(term: Column, index: Column) -> Column:
        return F.concat_ws(
            " ",
            F.lit(INSTALMENT_WORD),
            (index + 1).cast("string"),
            F.lit(PAY_WORD),
            F.concat(term.getField("pct").cast("string"), F.lit("%")),
            term.getField("note"),
            F.concat(F.lit(f"{AMOUNT_WORD} "), baht_amount(term.getField("amount"))),
        )

    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, one), LIST_SEPARATOR))


def module_count(modules: Column) -> Column:
    return F.when(modules.isNotNull(), F.size(modules).cast("string"))


def module_details(modules: Column) -> Column:
    """Names with their monthly price, from ``(name, monthly)`` items in the order given."""
    items = F.transform(
        modules,
        lambda m: F.concat_ws(" ", m.getField("name"), baht_amount(m.getField("monthly"))),
    )
    return F.when(F.size(modules) > 0, F.array_join(items, LIST_SEPARATOR))
