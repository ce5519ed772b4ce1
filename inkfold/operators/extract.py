"""From a quotation document to the 40 text fields of a contract record."""

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.constants import CONTRACT_FIELDS, SENTINEL
from inkfold.functions import formats
from inkfold.functions.text import not_found_fill
from inkfold.session import written

TERMS = "ARRAY<STRUCT<pct: STRING, note: STRING, amount: STRING>>"
MODULES = "ARRAY<STRUCT<name: STRING, monthly: STRING>>"


@dataclass(frozen=True)
class Formatter:
    """How a value is read from the document and shown in the record."""

    show: Callable[[Column], Column]
    reads: str = "STRING"


FORMATTERS = {
    "text": Formatter(lambda value: value),
    "thai_date": Formatter(formats.thai_date),
    "grouped_amount": Formatter(formats.grouped_amount),
    "baht_amount": Formatter(formats.baht_amount),
    "payment_terms": Formatter(formats.payment_terms, TERMS),
    "module_count": Formatter(formats.module_count, MODULES),
    "module_details": Formatter(formats.module_details, MODULES),
}


@dataclass(frozen=True)
class Rule:
    """Where a field stands in the document: ``$.name``, ``$.a.b`` or ``$.a[0].b``."""

    field: str
    path: str
    formatter: str | Formatter = "text"

    def steps(self) -> list[str | int]:
        found = re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", self.path)
        spelled = "$" + "".join(f".{n}" if n else f"[{i}]" for n, i in found)
        if not found or spelled != self.path:
            raise ValueError(f"not a path of names and positions: {self.path}")
        return [name or int(index) for name, index in found]

    def shown(self) -> Formatter:
        if isinstance(self.formatter, Formatter):
            return self.formatter
        return FORMATTERS[self.formatter]


ITEM = object()


def document_type(rules: Iterable[Rule]) -> str:
    """The STRUCT that holds just the paths of the rules: other parts are skipped in parsing."""
    leaves = {}
    for rule in rules:
        path = tuple(ITEM if isinstance(step, int) else step for step in rule.steps())
        reads = rule.shown().reads
        if leaves.setdefault(path, reads) != reads:
            raise ValueError(f"{rule.path} is read as {leaves[path]} and as {reads}")
    return _type_below((), leaves)


def _type_below(prefix: tuple, leaves: dict[tuple, str]) -> str:
    below = [path for path in leaves if path[: len(prefix)] == prefix]
    if below == [prefix]:
        return leaves[prefix]
    # Names of the next level, in the order of the rules.
    steps = list(dict.fromkeys(path[len(prefix)] for path in below if path != prefix))
    if prefix in leaves or (ITEM in steps and steps != [ITEM]):
        names = ".".join("[]" if step is ITEM else step for step in prefix)
        raise ValueError(f"rules read ${'.' if names else ''}{names} as two different types")
    if steps == [ITEM]:
        return f"ARRAY<{_type_below((*prefix, ITEM), leaves)}>"
    members = [f"`{step}`: {_type_below((*prefix, step), leaves)}" for step in steps]
    return f"STRUCT<{', '.join(members)}>"


def rule_extract(document: Column, rules: Iterable[Rule]) -> Column:
    """The contract record of a document parsed as ``document_type(rules)``.

    Fields without a rule, and paths the document lacks, hold the "not found" text; nothing is
    derived or guessed.
    """
    by_field = {rule.field: rule for rule in rules}
    unknown = set(by_field) - set(CONTRACT_FIELDS)
    if unknown:
        raise ValueError(f"not fields of a contract record: {sorted(unknown)}")

    not_found = F.lit(SENTINEL)

    def value(field: str) -> Column:
        rule = by_field.get(field)
        if rule is None:
            return not_found
        found = document
        for step in rule.steps():
            found = F.get(found, F.lit(step)) if isinstance(step, int) else found.getField(step)
        return not_found_fill(rule.shown().show(found).cast("string"))

    return F.struct(*[value(field).alias(field) for field in CONTRACT_FIELDS])


class ExtractorFailed(RuntimeError):
    """An extractor could not read a single document of a job."""


def batch_extract(
    documents: DataFrame,
    extractor: Callable[[pd.Series], Iterable[str | None]],
    partitions: int | None = None,
) -> DataFrame:
    """``(quotation_id, reply, error)`` from a caller's function over batches of document texts.

    The function gets the documents of one Arrow batch and gives one JSON text per document,
    None for a document it could not read. Batches stream, so a task holds one at a time;
    ``partitions`` spreads slow extractors over more tasks than the input files give.

    A batch that fails, or comes back with another number of replies, is tried again document by
    document: the one that fails has no reply but the text of its ``error``. Which rows come out does
    not depend on how documents are dealt to tasks and batches.

    Replies are written once, so that the extractor runs once whatever is made of them. If every document
    of the whole job failed, the extractor is at fault and ``ExtractorFailed`` is raised with one of the
    errors; no documents are no failure. A stream has no whole to judge by: its errors are rows.
    """
    source = documents.select("quotation_id", "doc")
    if partitions:
        source = source.repartition(partitions)

    def replies_of(docs: pd.Series) -> list[str | None]:
        replies = list(extractor(docs))
        if len(replies) != len(docs):
            raise ValueError(f"{len(replies)} replies to {len(docs)} documents")
        return replies

    def run(batches):
        for batch in batches:
            errors = [None] * len(batch)
            try:
                replies = replies_of(batch["doc"])
            except Exception:
                replies = [None] * len(batch)
                for i in range(len(batch)):
                    try:
                        replies[i] = replies_of(batch["doc"].iloc[i : i + 1])[0]
                    except Exception as error:
                        errors[i] = f"{type(error).__name__}: {error}"
            yield pd.DataFrame(
                {"quotation_id": batch["quotation_id"], "reply": replies, "error": errors}, dtype="object"
            )

    replies = source.mapInPandas(run, "quotation_id STRING, reply STRING, error STRING")
    if source.isStreaming:
        return replies
    replies = written(replies, "replies")
    seen = replies.agg(
        F.count(F.lit(1)).alias("rows"), F.count("error").alias("failed"), F.min("error").alias("error")
    ).first()
    if seen["rows"] and seen["failed"] == seen["rows"]:
        raise ExtractorFailed(f"all of {seen['rows']} documents failed: {seen['error']}")
    return replies
