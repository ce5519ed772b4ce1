"""Resolving requested quotation ids against landed documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkfold.operators.joins import HOT_ROWS, key_counts, salted_join
from inkfold.operators.sizes import counts_fit

FOUND = 200
NOT_FOUND = 404
KEY = "quotation_id"


def _measured(requests: DataFrame, small: bool | None) -> tuple[bool, DataFrame | None]:
    """Whether the requests may be broadcast, and the counts of their ids where these were needed."""
    if small:
        return True, None
    counts = key_counts(requests, KEY)
    return (counts_fit(counts) if small is None else False), counts


def lookup_misses(
    requests: DataFrame, landed: DataFrame, small: bool | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Requests for which nothing has landed, repeated ones and those without an id included.

    Requests that turn out too many to broadcast are read twice: counted by id, and joined.
    """
    small, counts = _measured(requests, small)
    ids = landed.select(KEY)
    if small:
        wanted = requests.select(KEY).distinct()
        matched = ids.join(F.broadcast(wanted), KEY, "left_semi").distinct()
        return requests.join(F.broadcast(matched), KEY, "left_anti")
    # Distinct ids, so an id that landed often is one row and only requests can be skewed.
    return salted_join(requests, ids.distinct(), KEY, limit, "left_anti", counts)


def quotation_lookup(
    requests: DataFrame, landed: DataFrame, small: bool | None = None, limit: int = HOT_ROWS
) -> DataFrame:
    """Every request with ``http_status`` and ``doc``.

    ``landed`` is ``(quotation_id, status, doc)``; a status other than 200 is passed through
    without a document, and an id that never landed gives 404.

    A request list that passes the size check is broadcast and the documents stay where they are;
    an outer join could not do that, so matches and misses are two joins. A longer list is shuffled
    with hot ids spread, in one left join that gives both: it is read once to be counted, which also
    settles its size, and once to be joined.
    """
    small, counts = _measured(requests, small)
    status = F.coalesce(F.col("status"), F.lit(FOUND))
    document = F.when(status == FOUND, F.col("doc")).alias("doc")
    if not small:
        marked = landed.select(KEY, "status", "doc", F.lit(True).alias("_landed"))
        joined = salted_join(requests, marked, KEY, limit, "left", counts)
        known = F.when(F.col("_landed"), status).otherwise(NOT_FOUND).alias("http_status")
        return joined.select(*[F.col(f"`{name}`") for name in requests.columns], known, document)
    found = landed.join(F.broadcast(requests), KEY).select(*requests.columns, status.alias("http_status"), document)
    missing = lookup_misses(requests, landed, True).select(
        *requests.columns,
        F.lit(NOT_FOUND).alias("http_status"),
        F.lit(None).cast("string").alias("doc"),
    )
    return found.unionByName(missing)
