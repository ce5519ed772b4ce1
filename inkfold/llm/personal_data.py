"""Personal data in texts: fixed patterns, and further spans by weak supervision.

DataFrame functions only. Labelers (format, gazetteer, context, shape) vote on every candidate;
expectation-maximisation estimates how far to trust each labeler; its posteriors train a naive
Bayes classifier of spans, which decides on the candidates that the fixed patterns leave out.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkfold.session import written

# Patterns take what they can at once (possessive) and start at the head of a run of their own
# characters or where the last match ended, so that long runs cost linear time and no deep stack.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ADDED_PATTERNS = {
    # A spelled-out address: name at host dot com.
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?[\[(]dot[\])] ?[A-Za-z]{2,12}(?![A-Za-z0-9])",
    # National number without a country code.
    "local_phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@", "phone": "+", "spelled_email": "dot"}
KINDS = [*BASE_PATTERNS, *ADDED_PATTERNS]

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
STRICT_IP = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
#: Code points before a candidate that the context labeler reads.
CONTEXT = 40
CUES = r"(?i)\b(?:e-?mail|mail|contact|tel|phone|call|mobile|fax|ssn|social security|iban|account|card|visa|ip|address|reach)\b[^a-z0-9]{0,8}$"
COUNTER_CUES = r"(?i)\b(?:order|invoice|isbn|version|serial|part|model|item|ref|sku|page|section|figure|table)\b[^a-z0-9]{0,8}$"
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info"]
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "NL", "PL", "PT", "SE"]
LABELERS = ["format", "gazetteer", "context", "shape"]
#: A candidate outside the fixed patterns is reported from this probability on.
ACCEPT = 0.9
EM_ROUNDS = 50
#: Matches of one kind in a text that are put together inside its row; of more, each is a row.
MOST_MATCHES = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def gaps_and_matches(text: Column, kind: str) -> Column:
    """Array of ``(value, gap)``: a pattern's matches, and the text between each and the one before.

    The text is cut at the matches, so lengths of gaps and matches add up to positions.
    """
    pattern = {**BASE_PATTERNS, **ADDED_PATTERNS}[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # An array of pieces is always one longer than that of the matches.
    pairs = F.zip_with(
        matches,
        F.slice(F.split(text, pattern, -1), 1, F.size(matches)),
        lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")),
    )
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else F.lit(True)
    nothing = F.array().cast("array<struct<value:string,gap:string>>")
    return F.when(needed & F.rlike(text, F.lit(pattern)), pairs).otherwise(nothing)


def located(pairs: Column, kind: str) -> Column:
    """Array of ``(kind, start, end, value, before)`` by code points, from a few gaps and matches.

    Each step copies the array so far: texts with more than ``MOST_MATCHES`` take ``located_rows``.
    """
    item = "struct<kind:string,start:int,end:int,value:string,before:string>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), *_seen(pair))
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    return F.aggregate(pairs, first, step, lambda state: state["found"])


def _seen(pair: Column) -> list[Column]:
    return [pair["value"].alias("value"), F.right(pair["gap"], F.lit(CONTEXT)).alias("before")]


def located_rows(texts: DataFrame) -> DataFrame:
    """``(row, found, passed, covered)``: the matches in long lists of ``(row, text)``, a row each.

    Positions are running sums over a text's matches. A span meets a match if, of all spans that begin
    before the match ends, one ends after it begins: a running maximum. Both are windows over one
    text, which Spark sorts and spills, so the work is that of sorting the matches.
    """
    parts = []
    for place, kind in enumerate(KINDS):
        pairs = texts.select("row", F.posexplode(gaps_and_matches(F.col("text"), kind)).alias("at", "pair"))
        parts.append(
            pairs.select(
                "row", "at", F.lit(kind).alias("kind"), F.lit(place).alias("place"), *_seen(F.col("pair")),
                F.length("pair.value").alias("width"), F.length("pair.gap").alias("gap"),
            )
        )
    in_order = Window.partitionBy("row", "place").orderBy("at")
    end = F.sum(F.col("gap") + F.col("width")).over(in_order).cast("int")
    placed = reduce(DataFrame.unionByName, parts).withColumn("end", end)
    found = F.struct("kind", (F.col("end") - F.col("width")).alias("start"), "end", "value", "before")
    passed = reduce(
        lambda rest, kind: F.when(F.col("kind") == kind, passes(kind, F.col("value"))).otherwise(rest),
        BASE_PATTERNS,
        F.lit(False),
    )
    matches = placed.select("row", "place", found.alias("found"), passed.alias("passed"))
    # Two events a match: where it ends it asks, where it begins it counts if it is a span.
    asks = F.struct(F.col("found.end").alias("at"), F.lit(0).alias("begins"), F.lit(-1).alias("reach"))
    span = F.struct(F.col("found.start").alias("at"), F.lit(1).alias("begins"), F.col("found.end").alias("reach"))
    events = matches.select("*", F.inline(F.when(F.col("passed"), F.array(asks, span)).otherwise(F.array(asks))))
    before = Window.partitionBy("row").orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = events.withColumn("reached", F.max("reach").over(before)).where("begins = 0")
    return reached.select("row", "place", "found", "passed", (F.col("reached") > F.col("found.start")).alias("covered"))


def passes(kind: str, value: Column) -> Column:
    """The conditions on a match of a fixed pattern."""
    digits = _digits(value)
    if kind == "ip":
        return F.rlike(value, F.lit(STRICT_IP))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def votes(found: Column) -> Column:
    """Votes of all labelers on one candidate: 1 personal data, 0 not, -1 no opinion."""
    kind, value, before = found["kind"], found["value"], found["before"]
    digits = _digits(value)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, 0).otherwise(-1)

    by_kind = reduce(
        lambda rest, k: F.when(kind == k, passes(k, value)).otherwise(rest),
        BASE_PATTERNS,
        F.when(kind == "ssn", ~F.rlike(value, F.lit("^(?:000|666|9)|-00-|-0000$")))
        .when(kind == "local_phone", F.length(digits).between(8, 11))
        .when(kind == "iban", F.length(F.replace(value, F.lit(" "))).between(15, 34))
        .otherwise(F.lit(True)),
    )
    ending = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    listed = F.when(kind.isin("email", "spelled_email"), ending.isin(TOP_DOMAINS)).when(
        kind == "iban", F.left(value, F.lit(2)).isin(IBAN_COUNTRIES)
    )
    reserved = (kind == "ip") & F.rlike(value, F.lit(r"^(?:0|10|127|255|192\.168)\."))
    dull = (digits != "") & F.rlike(digits, F.lit(r"^(\d)\1*$|^0?123456"))
    return F.struct(
        vote(by_kind, ~by_kind).alias("format"),
        F.coalesce(vote(listed, reserved | ~listed), F.when(reserved, 0), F.lit(-1)).alias("gazetteer"),
        vote(F.rlike(before, F.lit(CUES)), F.rlike(before, F.lit(COUNTER_CUES))).alias("context"),
        vote((digits != "") & ~dull, dull).alias("shape"),
    )


def features(found: Column) -> dict[str, Column]:
    """What the final classifier sees of a candidate; every feature has a few values only."""
    value = found["value"]
    return {
        "kind": found["kind"],
        "length": F.least(F.length(value) / 4, F.lit(8)).cast("int").cast("string"),
        "digits": F.least(F.length(_digits(value)), F.lit(20)).cast("string"),
        "cue": F.when(F.rlike(found["before"], F.lit(CUES)), "for")
        .when(F.rlike(found["before"], F.lit(COUNTER_CUES)), "against")
        .otherwise("none"),
        "separator": F.regexp_extract(value, r"[0-9]([^0-9A-Za-z])", 1),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS):
    """EM over vote patterns and their counts: ``(prior, hits, false alarms)``.

    ``hits[j]`` is how often labeler ``j`` says yes when it votes on personal data, ``false
    alarms[j]`` when it votes on anything else. Only the counts of patterns are needed, of which
    there are at most 3 to the number of labelers, whatever the corpus holds.
    """
    width = len(LABELERS)
    prior, hits, alarms = 0.5, [0.8] * width, [0.2] * width
    for _ in range(rounds if patterns else 0):
        yes_mass, no_mass = 1.0, 1.0
        sums = [[1.6, 2.0, 0.4, 2.0] for _ in range(width)]  # weak prior votes
        for pattern, n in patterns:
            p = posterior(pattern, prior, hits, alarms)
            yes_mass += n * p
            no_mass += n * (1 - p)
            for j, vote in enumerate(pattern):
                if vote >= 0:
                    sums[j][0] += n * p * vote
                    sums[j][1] += n * p
                    sums[j][2] += n * (1 - p) * vote
                    sums[j][3] += n * (1 - p)
        prior = min(0.99, max(0.01, yes_mass / (yes_mass + no_mass)))
        hits = [min(0.99, max(0.5, s[0] / s[1])) for s in sums]
        alarms = [max(0.01, min(0.5, s[2] / s[3])) for s in sums]
    return prior, hits, alarms


def posterior(pattern, prior, hits, alarms) -> float:
    logit = math.log(prior / (1 - prior))
    for vote, hit, alarm in zip(pattern, hits, alarms, strict=True):
        if vote == 1:
            logit += math.log(hit / alarm)
        elif vote == 0:
            logit += math.log((1 - hit) / (1 - alarm))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def trained_score(candidates: DataFrame, names: list[str]):
    """A function from features to a probability, learned from all candidates of the corpus."""
    voted = candidates.groupBy(*[F.col(f"votes.{name}").alias(name) for name in LABELERS]).count()
    patterns = [(tuple(row)[:-1], row["count"]) for row in voted.collect()]
    prior, hits, alarms = estimate(patterns)
    start = F.lit(math.log(prior / (1 - prior)))
    logit = reduce(
        lambda total, j: total
        + F.when(F.col(f"votes.{LABELERS[j]}") == 1, math.log(hits[j] / alarms[j]))
        .when(F.col(f"votes.{LABELERS[j]}") == 0, math.log((1 - hits[j]) / (1 - alarms[j])))
        .otherwise(0.0),
        range(len(LABELERS)),
        start,
    )
    soft = candidates.withColumn("_p", 1 / (1 + F.exp(-logit)))
    # One row per feature and value: a few dozen, for the values are bounded.
    pairs = F.array(
        *[F.struct(F.lit(n).alias("name"), F.col(f"features.{n}").alias("value")) for n in names]
    )
    masses = (
        soft.select("_p", F.explode(pairs).alias("pair"))
        .groupBy("pair.name", "pair.value")
        .agg(F.sum("_p").alias("yes"), F.sum(1 - F.col("_p")).alias("no"))
        .collect()
    )
    total_yes = sum(m["yes"] for m in masses) / len(names) + 1
    total_no = sum(m["no"] for m in masses) / len(names) + 1
    weights = {
        (m["name"], m["value"]): math.log((m["yes"] + 0.1) / total_yes)
        - math.log((m["no"] + 0.1) / total_no)
        for m in masses
    }
    base = math.log(total_yes / total_no)

    def score(feature: Column) -> Column:
        parts = []
        for name in names:
            known = {v: w for (n, v), w in weights.items() if n == name and v is not None}
            part = F.lit(0.0)
            if known:
                pairs = [F.lit(x) for item in sorted(known.items()) for x in item]
                part = F.coalesce(F.try_element_at(F.create_map(*pairs), feature[name]), F.lit(0.0))
            parts.append(part)
        return 1 / (1 + F.exp(-reduce(Column.__add__, parts, F.lit(base))))

    return score


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)`` per row.

    ``spans`` is ``kind:start:end`` by kind, then start, in code points, end exclusive: all spans
    of the fixed patterns, then the candidates of other kinds that lie clear of
    those and that the trained classifier accepts. Null and empty texts have no spans; repeated rows are rows of their own; a table
    without rows or candidates leaves the classifier at its prior. Other columns are not read.
    Names of more than 64 characters and hosts of more than 63 are not taken for spelled-out addresses.

    The texts are scanned once, into a table of one small row each in the shared folder; nothing
    is shuffled but the counts of vote patterns and feature values. Texts with more than
    ``MOST_MATCHES`` matches of a kind are kept in that table and scanned again, match by match: time
    grows with the matches, not with their square.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), *[gaps_and_matches(text, kind).alias(f"_{kind}") for kind in KINDS]
    )
    many = F.greatest(*[F.size(f"_{kind}") for kind in KINDS]) > MOST_MATCHES
    raw = pairs.select(
        "doc_id",
        F.when(many, F.col("_text")).alias("long_text"),
        *[F.when(~many, located(F.col(f"_{kind}"), kind)).alias(f"_{kind}") for kind in KINDS],
    )

    def passing(kind: str) -> Column:
        return F.filter(f"_{kind}", lambda found: passes(kind, found["value"]))

    base = {kind: passing(kind) for kind in BASE_PATTERNS}
    every_base = F.concat(*base.values())
    names = list(features(F.struct(*[F.lit("").alias(x) for x in ("kind", "value", "before")])))

    def described(found: Column, covered: Column) -> Column:
        return F.struct(
            *[found[x].alias(x) for x in ("kind", "start", "end")],
            covered.alias("covered"),
            votes(found).alias("votes"),
            F.struct(*[column.alias(name) for name, column in features(found).items()]).alias("features"),
        )

    def met(found: Column) -> Column:
        return F.exists(every_base, lambda s: (s["start"] < found["end"]) & (found["start"] < s["end"]))

    scanned = written(
        raw.select(
            "doc_id",
            "long_text",
            *[F.size(base[kind]).cast("bigint").alias(f"n_{kind}") for kind in BASE_PATTERNS],
            _joined(every_base).alias("base_spans"),
            F.transform(F.concat(*[f"_{kind}" for kind in KINDS]), lambda f: described(f, met(f))).alias("candidates"),
        ),
        "personal",
    )
    short, long = scanned.where("long_text IS NULL").drop("long_text"), scanned.where("long_text IS NOT NULL")
    every = short.select(F.inline("candidates"))
    rows = None
    if not long.isEmpty():
        numbered = long.select("doc_id", F.col("long_text").alias("text"), F.monotonically_increasing_id().alias("row"))
        numbered = written(numbered, "long_texts")
        matches = written(located_rows(numbered.select("row", "text")), "matches")
        rows = matches.select("row", "place", "passed", described(F.col("found"), F.col("covered")).alias("c"))
        every = every.unionByName(rows.select("c.*"))
    score = trained_score(every, names)

    def accepted(s: Column) -> Column:
        return s["kind"].isin(list(ADDED_PATTERNS)) & ~s["covered"] & (score(s["features"]) >= ACCEPT)

    columns = ["doc_id", *[f"n_{kind}" for kind in BASE_PATTERNS], "base_spans", "added_spans", "n_added"]
    added = F.filter("candidates", accepted)
    judged = short.withColumns({"added_spans": _joined(added), "n_added": F.size(added).cast("bigint")}).select(*columns)
    if rows is not None:
        kept = rows.withColumn("added", accepted(F.col("c"))).where("passed OR added")
        span = F.struct("place", F.col("c.start").alias("start"), "c.kind", F.col("c.end").alias("end"))

        def listed(which: str) -> Column:
            return _joined(F.sort_array(F.collect_list(F.when(F.col(which), span))))

        per_text = kept.groupBy("row").agg(
            *[F.count_if(F.col("passed") & (F.col("c.kind") == kind)).alias(f"n_{kind}") for kind in BASE_PATTERNS],
            listed("passed").alias("base_spans"),
            listed("added").alias("added_spans"),
            F.count_if("added").alias("n_added"),
        )
        nothing = {n: F.coalesce(n, F.lit(0 if n.startswith("n_") else "")).alias(n) for n in columns[1:]}
        long_rows = numbered.select("doc_id", "row").join(per_text, "row", "left").select("doc_id", *nothing.values())
        judged = judged.unionByName(long_rows)
    spans = F.concat_ws(",", F.expr("nullif(base_spans, '')"), F.expr("nullif(added_spans, '')"))
    return judged.select(
        "doc_id",
        *[f"n_{kind}" for kind in BASE_PATTERNS],
        F.sha2("base_spans", 256).alias("base_sha256"),
        spans.alias("spans"),
        "n_added",
    )
