"""Secrets in texts, and how many owners share each of them across the corpus."""

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.recurring import NO_ID, row_key, row_sig
from inkfold.session import written

BASE_KINDS = {
    "assign": re.compile(
        r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Only these runs of hex digits can pass, and finding them directly is faster.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
ADDED_KINDS = {
    "provider": re.compile(
        r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"
    ),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # Header lines, then the key. Nothing passes five hyphens and nothing is tried twice, so a text
    # is read about once, however many blocks are left open in it.
    "pem": re.compile(
        r"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----"
        r"(?:\s*+[A-Za-z][A-Za-z0-9-]*+:(?:[^\r\n-]|-(?!----))*+)*+[A-Za-z0-9+/=\s]{40,}+-----END"
    ),
    "entropy": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+"),
}
KINDS = [*BASE_KINDS, *ADDED_KINDS]
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]?|test|xxxx|12345|abcdef")
#: Bits per character below which a value does not look drawn at random.
LEAST_ENTROPY = 3.0
#: A value that more owners have than this is a copied example, not somebody's credential.
MAX_OWNERS = 2
#: So is one in more repositories than this, however few own them.
MAX_REPOSITORIES = 3
#: One bit of a bigint each; see ``ownership``.
SALTS = 64

CANDIDATE = "struct<start:int,rank:int,end:int,kind:string,digest:string,live:boolean>"
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,owners:bigint,repositories:bigint>>"
SCANNED = (
    "doc_id bigint, sig bigint, owner string, repository string, n_assign bigint, n_access bigint, n_hex bigint, "
    f"base_sha256 string, candidates array<{CANDIDATE}>"
)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)`` of the fixed patterns, kind by kind."""
    found = []
    for kind, pattern in BASE_KINDS.items():
        for match in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            value = match[2] if kind == "assign" else match[0]
            if len(value) >= LEAST[kind]:
                found.append((kind, match.start(), match.end(), value))
    return found


def added_spans(text: str, taken: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of the wider patterns, clear of the fixed ones and of each other.

    Only a PEM block may hold fixed ones: its headers can have hex digits.
    """
    found: list[tuple[str, int, int, str]] = []
    matches = [(k, m) for k, pattern in ADDED_KINDS.items() for m in pattern.finditer(text)]
    covered = bytearray(len(text) if matches else 0)
    for _, start, end, _ in taken if matches else ():
        covered[start:end] = b"\1" * (end - start)
    for kind, match in matches:
        start, end = match.span()
        if kind == "pem" or covered.find(1, start, end) < 0:
            found.append((kind, start, end, match[0]))
            covered[start:end] = b"\1" * (end - start)
    return found


def looks_live(kind: str, value: str) -> bool:
    """Random-looking: many different characters, no placeholder, letters and digits mixed."""
    if PLACEHOLDER.search(value):
        return False
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    if kind == "entropy":
        classes = [str.islower, str.isupper, str.isdigit]
        return entropy >= LEAST_ENTROPY + 1 and all(any(map(c, value)) for c in classes)
    return entropy >= LEAST_ENTROPY


def scan(text: str) -> tuple[list[int], str, list[dict]]:
    base = base_spans(text)
    ranked = sorted((start, KINDS.index(kind), end, kind) for kind, start, end, _ in base)
    digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in ranked).encode()).hexdigest()
    candidates = [
        {
            "start": start,
            "rank": KINDS.index(kind),
            "end": end,
            "kind": kind,
            "digest": hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(),
            "live": looks_live(kind, value),
        }
        for kind, start, end, value in base + added_spans(text, base)
    ]
    counted = Counter(kind for kind, *_ in base)
    return [counted[kind] for kind in BASE_KINDS], digest, candidates


def _scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [
            ("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()),
            ("kind", pa.string()), ("digest", pa.string()), ("live", pa.bool_()),
        ]
    )
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            results = [scan(text.as_py() or "") for text in part.column("text")]
            columns = [part.column(name) for name in ("doc_id", "sig", "owner", "repository")]
            columns += [pa.array([r[0][i] for r in results], pa.int64()) for i in range(3)]
            columns.append(pa.array([r[1] for r in results], pa.string()))
            columns.append(pa.array([r[2] for r in results], pa.list_(pa.struct(schema))))
            names = [field.split()[0] for field in SCANNED.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def ownership(candidates: DataFrame) -> DataFrame:
    """``(digest, salt, owners, repositories)``: how widely each value is spread.

    Repeats are merged by value, owner and repository before the shuffle, then counted in two
    steps, so a value that every document holds is a few rows. A value comes back once per salt
    that its candidates have, so the join with them is spread too.
    """
    per_owner = (
        candidates.groupBy("digest", "owner", "repository")
        .agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
        .groupBy("digest", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"), F.bit_or("salts").alias("salts"))
    )
    spread = per_owner.groupBy("digest").agg(
        F.count(F.lit(1)).alias("owners"),
        F.sum("repositories").alias("repositories"),
        F.bit_or("salts").alias("salts"),
    )
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    own = F.filter(every, lambda s: F.getbit("salts", s) == 1)
    return spread.select("digest", "owners", "repositories", F.explode(own).alias("salt"))


def secret_scan(
    docs: DataFrame,
    owner: Column | None = None,
    repository: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """Secrets of each row and whether they look like a live credential of one owner.

    ``owner`` and ``repository`` name where a row comes from; by default the source, and the
    source with the language. Returns ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_added, n_live, n_copied, owners, repositories, sig, span_list)``. Spans of the fixed patterns
    are always reported. A candidate of the wider patterns is added if it looks live and at most
    ``max_owners`` owners, in at most ``max_repositories`` repositories of theirs together, have its
    value anywhere in the corpus. ``n_live`` counts such values among all spans, ``n_copied`` the
    candidates that more owners or repositories have. ``owners`` and ``repositories`` list how many
    have the value of each span, in the order of ``spans``.

    Null texts count as empty, null owners as one unknown owner. Repeated rows are rows of their
    own. Other columns are not read. Texts are scanned once, whole; what is written and shuffled
    is candidates and digests, never the values.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        row_sig().alias("sig"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        "text",
    )
    scanned = written(
        rows.mapInArrow(_scanned, SCANNED).withColumn("row", F.monotonically_increasing_id()), "secrets"
    )
    candidates = scanned.select("row", "owner", "repository", F.inline("candidates")).withColumn(
        "salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    )
    judged = candidates.join(ownership(candidates), ["digest", "salt"])
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    fixed = F.col("rank") < len(BASE_KINDS)
    added = ~fixed & F.col("live") & few
    span = F.struct("start", "rank", "end", "kind", "owners", "repositories")
    per_row = judged.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(fixed | added, span))).alias("span_list"),
        F.count_if(added).alias("n_added"),
        F.count_if(F.col("live") & few).alias("n_live"),
        F.count_if(~few).alias("n_copied"),
    )
    zero = F.lit(0).cast("bigint")
    # A row with candidates meets its own ones only: no row number is hot.
    joined = scanned.join(per_row, "row", "left").withColumn(
        "span_list", F.coalesce("span_list", F.from_json(F.lit("[]"), SPANS))
    )
    text_form = F.transform("span_list", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return joined.select(
        "doc_id",
        *[f"n_{kind}" for kind in BASE_KINDS],
        "base_sha256",
        F.array_join(text_form, ",").alias("spans"),
        F.coalesce("n_added", zero).alias("n_added"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_copied", zero).alias("n_copied"),
        *[F.array_join(F.col("span_list")[name].cast("array<string>"), ",").alias(name) for name in ("owners", "repositories")],
        "sig",
        "span_list",
    )


MARK = "[secret]"


def redacted_text(text: str, spans: list[dict]) -> str:
    """The text with each run of overlapping spans replaced by one mark."""
    pieces, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if span["start"] >= at or not pieces:
            pieces += [text[at : span["start"]], MARK]
        at = max(at, span["end"])
    return "".join([*pieces, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the secrets in the texts replaced and ``n_chars`` adjusted."""
    spans = secret_scan(docs).where(F.size("span_list") > 0)
    spans = spans.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), "sig", "span_list")
    spans = spans.dropDuplicates(["key", "sig"])  # rows equal in id and text have equal spans
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key"), row_sig().alias("sig"))
    met = rows.join(spans.hint("shuffle_hash"), ["key", "sig"], "left").select("row", "span_list")
    names = docs.columns
    place = names.index("text")

    def replaced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, found = batch.column("row").flatten(), batch.column("span_list")
            texts = columns[place]
            if found.null_count < len(found):
                texts = pa.array(
                    [redacted_text(t.as_py() or "", s.as_py()) if s.is_valid else t.as_py() for t, s in zip(texts, found, strict=True)],
                    texts.type,
                )
            columns[place] = texts
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = met.mapInArrow(replaced, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out
