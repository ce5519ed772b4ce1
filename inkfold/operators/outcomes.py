"""Request logs and request events to outcome tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of the request logs.
TAG_MARKS = ["✅", "❌"]
OUTCOME_LABELS = {
    "สำเร็จ": "succeeded",
    "ล้มเหลว": "failed",
    "เชื่อมต่อไม่ได้": "unreachable",
    "ข้อผิดพลาด": "error",
}
ACTION_LABELS = {
    "พยายามล็อกอิน": "login",
    "ดึงข้อมูลใบเสนอราคา": "quotation",
    "กำลังสร้างสัญญาจากใบเสนอราคา": "generate",
}
SYSTEM_ERROR_LABEL = "เกิดข้อผิดพลาดในระบบ: "
REMOVED_LABEL = "ลบไฟล์ชั่วคราวเรียบร้อย: "
NOT_REMOVED_LABEL = "เกิดข้อผิดพลาดในการลบไฟล์ชั่วคราว "
USER_PREFIX = "userid="

# Parts of a line are put between separators by one replacement and then split, so the pattern
# runs once per line and not once per part.
SEPARATOR = "\x1e"
LINE_PATTERN = (
    r"(?s)^"
    rf"(?:\[({'|'.join(TAG_MARKS)}) ([^\]{SEPARATOR}]+)\] )?"
    r"(?:\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)\] )?"
    rf"(?:({'|'.join(ACTION_LABELS)}): )?"
    rf"({USER_PREFIX})?"
    rf"([^{SEPARATOR}]*?)"
    r"(?: \| (?:HTTP (\d+)|(?:error=)?(.*)))?\z"
)
PART_NAMES = ["mark", "label", "time", "action_label", "user", "subject", "http", "error"]


def _lookup(key: Column, table: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for label, value in table.items():
        found = F.when(key == label, value).otherwise(found)
    return found


def log_parse(lines: DataFrame) -> DataFrame:
    """``line`` to ``(tag, outcome, ts, action, subject, http_status, error)`` and ``parsed``.

    Lines of no known shape stay, with ``parsed`` false. A success tag on the line that opens a
    generation means started, so the action decides there.
    """
    line = F.col("line")
    groups = SEPARATOR.join(f"${i + 1}" for i in range(len(PART_NAMES)))
    parts = F.split(F.regexp_replace(line, LINE_PATTERN, groups), SEPARATOR, len(PART_NAMES))
    lined = lines.withColumn("_parts", parts)

    def part(name: str) -> Column:
        return F.nullif(F.get(F.col("_parts"), F.lit(PART_NAMES.index(name))), F.lit(""))

    whole = F.size("_parts") == len(PART_NAMES)
    system = F.startswith(line, F.lit(SYSTEM_ERROR_LABEL))
    # The removal of a generated file: done, or the file and what stood against it.
    removed = F.startswith(line, F.lit(REMOVED_LABEL))
    stuck = F.startswith(line, F.lit(NOT_REMOVED_LABEL))
    left = F.split(F.substr(line, F.lit(len(NOT_REMOVED_LABEL) + 1)), ": ", 2)
    action = F.coalesce(
        _lookup(part("action_label"), ACTION_LABELS), F.when(part("user").isNotNull(), "login")
    )
    stamped = part("mark").isNotNull() | part("time").isNotNull()
    known = whole & action.isNotNull() & stamped
    opening = (action == "generate") | part("mark").isNull()
    outcome = F.when(opening, "started").otherwise(_lookup(part("label"), OUTCOME_LABELS))

    def of_known(value: Column) -> Column:
        return F.when(~(system | removed | stuck) & known, value)

    return lined.select(
        *[F.col(f"`{name}`") for name in lines.columns],
        of_known(part("label")).alias("tag"),
        F.when(system | stuck, "error")
        .when(removed, "succeeded")
        .when(known, outcome)
        .alias("outcome"),
        of_known(part("time")).try_cast("timestamp_ntz").alias("ts"),
        F.when(removed | stuck, "cleanup")
        .when(system, "generate")
        .when(known, action)
        .alias("action"),
        F.when(removed, F.substr(line, F.lit(len(REMOVED_LABEL) + 1)))
        .when(stuck, F.get(left, F.lit(0)))
        .otherwise(of_known(part("subject")))
        .alias("subject"),
        of_known(part("http")).try_cast("int").alias("http_status"),
        F.when(system, F.substr(line, F.lit(len(SYSTEM_ERROR_LABEL) + 1)))
        .when(stuck, F.get(left, F.lit(1)))
        .when(known, part("error"))
        .alias("error"),
        F.coalesce(system | removed | stuck | known, F.lit(False)).alias("parsed"),
    )


def logged_code(action: Column, outcome: Column, http_status: Column) -> Column:
    """The response code a parsed line stands for; null while a request is only started."""
    return (
        F.when(outcome == "succeeded", 200)
        .when(outcome == "unreachable", 503)
        .when(outcome == "error", 500)
        .when((outcome == "failed") & http_status.isNotNull(), http_status)
        .when((outcome == "failed") & (action == "login"), 200)
    )


def outcome_class(
    operation: Column,
    upstream_status: Column,
    failure: Column,
    has_bearer: Column,
    token_valid: Column,
) -> Column:
    """The response code of a request event.

    ``failure`` is ``connection``, any other text for another exception, or null. A login does
    not need a token; fetching needs the header only; generating needs a valid token, and any
    failure in it is a processing error. A header or token nobody reported is not there.
    """
    has_bearer, token_valid = (F.coalesce(x, F.lit(False)) for x in (has_bearer, token_valid))
    code = F.when((operation == "quotation") & ~has_bearer, 401).when(
        (operation == "generate") & ~(has_bearer & token_valid), 401
    )
    return (
        code.when((operation == "generate") & failure.isNotNull(), 500)
        .when(operation == "generate", 200)
        .when(failure == "connection", 503)
        .when(failure.isNotNull(), 500)
        .otherwise(upstream_status)
    )
