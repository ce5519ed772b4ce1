"""DuckDB SQL with the rows of the registered queries, straight from the test tables."""

from inkfold.constants import (
    CONTRACT_FIELDS,
    DISPLAY_NAME_DEFAULT,
    LOGIN_ERROR_DEFAULT,
    QUOTATION_ERROR_DEFAULT,
    SENTINEL,
    THAI_MONTHS,
    WHITESPACE,
)
from inkfold.workload.tables import RULES, TEMPLATE, TERM_DAYS, TERM_NOTES

# Fixed values, stated here on their own: the placeholders of templates.
PLACEHOLDER = r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"
M = "chr(8291)"
# Phrases of amounts, instalments, file names and log lines.
BAHT_WORD = "บาท"
INSTALMENT, PAID, AMOUNT = "งวดที่", "ชำระ", "เป็นจำนวนเงิน"
FILE_PREFIX = "สัญญา_"
S = f"'{SENTINEL}'"
EDGES = "(' ' || chr(9) || chr(10) || chr(13) || '''\",')"
ID = "'QO' || o_orderkey"
ORDERS = "orders LEFT JOIN customer ON o_custkey = c_custkey"


def unmarked(x: str) -> str:
    return f"({x} = {S} OR NOT regexp_matches({x}, '[^{WHITESPACE}]'))"


def mark(x: str) -> str:
    return f"CASE WHEN {unmarked(x)} THEN {x} ELSE {M} || trim({x}, {EDGES}) || {M} END"


def edge_space(x: str) -> str:
    return f"regexp_matches({x}, '^[{WHITESPACE}]|[{WHITESPACE}]\\z')"


def grouped(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DECIMAL(18,2)))"


def baht(x: str) -> str:
    return f"{grouped(x)} || ' {BAHT_WORD}'"


def thai(x: str) -> str:
    months = ", ".join(f"'{month}'" for month in THAI_MONTHS)
    return f"(day({x}) || ' ' || [{months}][month({x})] || ' ' || (year({x}) + 543))"


def term(index: int) -> str:
    percent, note = TERM_NOTES[index]
    amount = f"CAST(o_totalprice AS DECIMAL(18,2)) * CAST({percent} AS DECIMAL(3,0)) * 0.01"
    return f"'{INSTALMENT} {index + 1} {PAID} {percent}% {note} {AMOUNT} ' || {baht(amount)}"


TERMS = " || ', ' || ".join(term(i) for i in range(len(TERM_NOTES)))

MODULES = f"""
brand AS (
  SELECT l_orderkey, p_brand, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS monthly
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_brand),
modules AS (
  SELECT l_orderkey, CAST(COUNT(*) AS VARCHAR) AS n_modules,
    string_agg(p_brand || ' ' || {baht("monthly")}, ', ' ORDER BY p_brand) AS details
  FROM brand GROUP BY l_orderkey)"""

DAY = "CAST(o_orderdate AS DATE)"
WRITTEN_DAY = f"CASE WHEN o_orderstatus = 'P' THEN strftime({DAY}, '%d/%m/%Y') ELSE {thai(DAY)} END"
FIELD_SQL = {
    "Contract_id": ID,
    "Contract_date": WRITTEN_DAY,
    "Customer_company_name": "c_name",
    "Standard_module_name": "c_mktsegment",
    "Contract_start_date": thai(DAY),
    "Contract_end_date": thai(f"({DAY} + {TERM_DAYS})"),
    "License_fee": baht("o_totalprice"),
    "License_fee_month": grouped("o_totalprice"),
    "Optional_module_count": f"COALESCE(n_modules, {S})",
    "Optional_module_details": f"COALESCE(details, {S})",
    "Implement_package_name": "o_orderpriority",
    "Implement_price": baht("o_totalprice"),
    "Implement_payment_terms": TERMS,
    "Quotation_id": ID,
    "Quotation_date": WRITTEN_DAY,
    "Customer_company_signature_name": "c_name",
}
RECORD_COLUMNS = ", ".join(f'{FIELD_SQL.get(f, S)} AS "{f}"' for f in CONTRACT_FIELDS)
RECORD = f"""{MODULES},
record AS (
  SELECT {ID} AS doc_id, {RECORD_COLUMNS}
  FROM {ORDERS} LEFT JOIN modules ON o_orderkey = l_orderkey)"""


def run_text(run, show) -> str:
    """The text of a run: what stands between braces is a field, the rest is as it is."""
    first, *others = run.text.split("{{")
    pieces = ["'" + first.replace("'", "''") + "'"]
    for other in others:
        field, literal = other.split("}}", 1)
        pieces.append(show(f'"{field.strip()}"'))
        pieces.append("'" + literal.replace("'", "''") + "'")
    return " || ".join(f"({piece})" for piece in pieces)


FILE_TEXT = " || chr(10) || ".join(
    run_text(run, lambda f: f"CASE WHEN {unmarked(f)} THEN {f} ELSE trim({f}, {EDGES}) END")
    for run in TEMPLATE
)
# The lines of pending orders, whose dates are not ISO, are broken.
RESULTS = f"""WITH {RECORD}
SELECT doc_id, TRUE AS accepted, 200 AS http_status, '{FILE_PREFIX}' || doc_id || '.docx' AS file_name,
  base64(encode({FILE_TEXT})) AS file_base64, NULL AS rejected_ending,
  {", ".join(f'"{f}"' for f in CONTRACT_FIELDS)}
FROM record WHERE NOT contains("Contract_date", '/')
UNION ALL SELECT NULL, FALSE, 422, NULL, NULL, '] x', {", ".join("NULL" for _ in CONTRACT_FIELDS)}
FROM record WHERE contains("Contract_date", '/')"""


def text_or_null(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def segments_of(runs: str, keys: str) -> str:
    """Segments of a CTE ``runs`` with ``keys``, text, underline and color."""
    return f"""
split_runs AS (
  SELECT {keys}, string_split(text, {M}) AS pieces, underline AS u, color AS c FROM {runs}),
placed AS (
  SELECT {keys}, u, c, len(pieces) > 1 AS is_split, pieces,
    unnest(range(len(pieces))) AS pos FROM split_runs),
segments AS (
  SELECT {keys}, CAST(pos AS INTEGER) AS seg_seq, pieces[pos + 1] AS text, pos % 2 = 1 AS is_filled,
    CASE WHEN pos % 2 = 1 THEN 'single' WHEN NOT is_split THEN u END AS underline,
    CASE WHEN pos % 2 = 1 THEN 'FF0000' WHEN NOT is_split THEN c END AS color,
    {edge_space("pieces[pos + 1]")} AS preserve_space
  FROM placed WHERE pieces[pos + 1] <> '')"""


CONTRACT_RUNS = " UNION ALL ".join(
    f"SELECT doc_id, '{run.part}' AS part, {run.section} AS section, {run.run_seq} AS run_seq, "
    f"{run_text(run, mark)} AS text, {text_or_null(run.underline)} AS underline, "
    f"{text_or_null(run.color)} AS color FROM record"
    for run in TEMPLATE
)

def cut(field: str) -> str:
    return f"""(CASE WHEN {unmarked(f'"{field}"')} THEN "{field}" ELSE trim("{field}", {EDGES}) END)"""


PRIORITY_RUNS = f"""runs AS (
  SELECT doc_id, "Implement_package_name" AS template_id, 'body' AS part, 0 AS section, 0 AS run_seq,
    "Implement_package_name" || ': ' || ({mark('"Contract_id"')}) || ' for '
      || ({mark('"Customer_company_name"')}) || ', tax {SENTINEL}' AS text,
    CAST(NULL AS VARCHAR) AS underline, CAST(NULL AS VARCHAR) AS color
  FROM record WHERE "Implement_package_name" <> '5-LOW'
  UNION ALL SELECT doc_id, "Implement_package_name", 'footer', 0, 0,
    "Implement_package_name" || ' of ' || ({mark('"Quotation_date"')}), NULL, NULL
  FROM record WHERE "Implement_package_name" <> '5-LOW')"""

DIRTY = "' ''' || c_name || ''', ' || chr(9)"
MARKED_LINE = (
    f"'Customer ' || (CASE WHEN o_orderstatus = 'P' THEN {M} || {M} "
    f"ELSE {M} || c_name || {M} END) || ', ordered ' || {M} || o_orderpriority || {M}"
)
MARKED_ORDERS = f"""marked AS (SELECT o_orderkey, {MARKED_LINE} AS text FROM {ORDERS}),
pieces AS (SELECT o_orderkey, string_split(text, {M}) AS pieces FROM marked),
placed AS (SELECT o_orderkey, pieces, unnest(range(len(pieces))) AS pos FROM pieces)"""

DOCUMENT_LINES = f"""split_lines AS (
  SELECT doc_id, lang, string_split(text, chr(10)) AS lines FROM documents),
placed_lines AS (SELECT doc_id, lang, lines, unnest(range(len(lines))) AS pos FROM split_lines),
document_lines AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS line_no,
    CASE WHEN lang = 'en' AND lines[pos + 1] = '' THEN {S} ELSE lines[pos + 1] END AS value
  FROM placed_lines)"""

PIECES = f"""pieces AS (
  SELECT conv_id AS doc_id, CASE WHEN role = 'system' THEN 'header' ELSE 'body' END AS part,
    0 AS section, CAST(turn // 2 AS INTEGER) AS run_seq, turn AS piece_seq,
    CASE WHEN role = 'user' THEN {mark("text")} ELSE text END AS text
  FROM conversations)"""
RUN_KEYS = "doc_id, part, section, run_seq"
CONVERSATION_SEGMENTS = f"""{PIECES},
runs AS (
  SELECT {RUN_KEYS}, string_agg(text, '' ORDER BY piece_seq) AS text,
    CAST(NULL AS VARCHAR) AS underline, CAST(NULL AS VARCHAR) AS color
  FROM pieces GROUP BY {RUN_KEYS}),
{segments_of("runs", RUN_KEYS)}"""

LANDED = f"""landed AS (
  SELECT {ID} AS quotation_id, CASE WHEN o_orderstatus = 'P' THEN 503 ELSE 200 END AS status,
    CASE WHEN o_orderstatus <> 'P' THEN c_name END AS customer FROM {ORDERS}),
requests AS (SELECT event_id AS request_seq, 'QO' || (event_id * 2) AS quotation_id FROM events)"""

ITEM_POSITIONS = f"""items AS (
  SELECT l_orderkey, l_linenumber, p_name AS specification, {grouped("l_extendedprice")} AS total_amount
  FROM lineitem JOIN part ON l_partkey = p_partkey),
numbered AS (
  SELECT *, row_number() OVER (
    PARTITION BY l_orderkey ORDER BY l_linenumber, specification, total_amount) - 1 AS pos FROM items)"""

BODY = """bodies AS (
  SELECT event_id, event_type AS kind, value,
    event_type = 'error' AND value >= 50 AS broken FROM events)"""


def whole(run_list: str) -> str:
    return "[" + ", ".join(f"'{name}'" for name in run_list) + "]"


NATION_TEXT = (
    f"n_name || ': contract ' || ({mark(ID)}) || ' for ' || ({mark(DIRTY)}) || '; tax {SENTINEL}.'"
)
REPLY_KEYS = (
    "['Contract_id', 'Customer_company_name']"
    " || CASE WHEN o_orderpriority <> '1-URGENT' THEN ['Customer_tax_id'] ELSE [] END"
    " || CASE WHEN o_orderpriority = '2-HIGH' THEN ['Standard_users_count'] ELSE [] END"
    " || CASE WHEN o_orderstatus = 'F' THEN ['Remark'] ELSE [] END"
    " || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ['Optional_module_details'] ELSE [] END"
)


def nested(m: str, space: str, quote: str, tab: str) -> str:
    """A reply's value of mixed kinds; ``m`` stands around marked texts, the others at edges that are cut."""
    return (
        f"'[\"' || {m} || c_name || {m} || '\",' || o_custkey || ',{{\"deep\":[[\"' || {m} || '{space}{quote}' || c_mktsegment"
        f" || '{quote}{tab}' || {m} || '\",true,null],{{\"a:b\":\"{SENTINEL}\"}}],\"note\":\"  \"}},\"' || {m}"
        f" || 'say \\\"' || o_orderstatus || '\\\", \\\\n' || {m} || '\"]'"
    )


NESTED_RAW = nested("''", " ", "''", "\\t")
NESTED_MARKED, NESTED_SHOWN = nested(M, "", "", ""), nested("''", "", "", "")


def of_reply(value: str) -> str:
    return f"CASE WHEN o_orderpriority <> '3-MEDIUM' THEN {value} END"


REPLY_RAW = {
    "Contract_id": ID,
    "Customer_company_name": "c_name",
    "Customer_tax_id": f"CASE WHEN o_orderpriority <> '1-URGENT' THEN {S} END",
    "Standard_users_count": "CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_custkey AS VARCHAR) END",
    "Optional_module_details": f"CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN {NESTED_RAW} END",
}
REPLY_MARKED = REPLY_RAW | {
    "Contract_id": mark(ID),
    "Customer_company_name": mark("c_name"),
    "Optional_module_details": f"CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN {NESTED_MARKED} END",
}
REPLY_GOOD = "(o_orderpriority <> '3-MEDIUM')"
REPLY_ENDING = "CASE o_orderstatus WHEN 'O' THEN '] x' WHEN 'F' THEN '],[1' ELSE '}' END"
REPLY_TEXT = (
    f"('{{\"Contract_id\":\"' || {ID} || '\",\"Customer_company_name\":\"' || c_name || '\"'"
    f" || CASE WHEN o_orderpriority <> '1-URGENT' THEN ',\"Customer_tax_id\":\"{SENTINEL}\"' ELSE '' END"
    " || CASE WHEN o_orderpriority = '2-HIGH' THEN ',\"Standard_users_count\":' || o_custkey ELSE '' END"
    " || CASE WHEN o_orderstatus = 'F' THEN ',\"Remark\":\"' || c_mktsegment || '\"' ELSE '' END"
    f" || CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ',\"Optional_module_details\":' || {NESTED_RAW} ELSE '' END"
    " || '}')"
)
REPLY_FIELDS = {
    "Contract_id": ID,
    "Customer_company_name": "c_name",
    "Customer_tax_id": f"CASE WHEN o_orderpriority <> '1-URGENT' THEN {S} ELSE '' END",
}


def reply_value(quoted: str, marked: bool) -> str:
    """What a template shows of a reply's field; a field that no reply has is empty."""
    if quoted == '"Optional_module_details"':
        return f"CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN {NESTED_MARKED if marked else NESTED_SHOWN} ELSE '' END"
    value = REPLY_FIELDS.get(quoted.strip('"'), "''")
    trimmed = f"CASE WHEN {unmarked(value)} THEN {value} ELSE trim({value}, {EDGES}) END"
    return mark(value) if marked else trimmed


REPLY_FILE = " || chr(10) || ".join(run_text(run, lambda f: reply_value(f, False)) for run in TEMPLATE)
REPLY_RUNS = " UNION ALL ".join(
    f"SELECT {ID} AS doc_id, '{run.part}' AS part, {run.section} AS section, {run.run_seq} AS run_seq, "
    f"{run_text(run, lambda f: reply_value(f, True))} AS text, {text_or_null(run.underline)} AS underline, "
    f"{text_or_null(run.color)} AS color FROM {ORDERS} WHERE {REPLY_GOOD}"
    for run in TEMPLATE
)
LOG_SHAPE = "event_id % 15"
LOG_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"
LOG_PARSED = f"""
  CASE WHEN {LOG_SHAPE} IN (1, 7, 10) THEN 'สำเร็จ' WHEN {LOG_SHAPE} IN (2, 3, 8) THEN 'ล้มเหลว'
    WHEN {LOG_SHAPE} = 4 THEN 'เชื่อมต่อไม่ได้' WHEN {LOG_SHAPE} IN (5, 9) THEN 'ข้อผิดพลาด' END AS tag,
  CASE WHEN {LOG_SHAPE} IN (0, 6, 10) THEN 'started' WHEN {LOG_SHAPE} IN (1, 7) THEN 'succeeded'
    WHEN {LOG_SHAPE} IN (2, 3, 8) THEN 'failed' WHEN {LOG_SHAPE} = 4 THEN 'unreachable'
    WHEN {LOG_SHAPE} IN (5, 9, 11, 14) THEN 'error' WHEN {LOG_SHAPE} = 13 THEN 'succeeded' END AS outcome,
  CASE WHEN {LOG_SHAPE} <= 6 THEN date_trunc('second', ts) END AS ts,
  CASE WHEN {LOG_SHAPE} <= 5 THEN 'login' WHEN {LOG_SHAPE} <= 9 THEN 'quotation'
    WHEN {LOG_SHAPE} <= 11 THEN 'generate' WHEN {LOG_SHAPE} >= 13 THEN 'cleanup' END AS action,
  CASE WHEN {LOG_SHAPE} <= 5 THEN 'u' || user_id WHEN {LOG_SHAPE} <= 10 THEN 'QO' || user_id
    WHEN {LOG_SHAPE} >= 13 THEN '/tmp/QO' || user_id || '.docx' END AS subject,
  CASE WHEN {LOG_SHAPE} IN (3, 8) THEN CAST(400 + user_id % 100 AS INTEGER) END AS http_status,
  CASE {LOG_SHAPE} WHEN 2 THEN 'wrong password | twice' WHEN 5 THEN 'HTTP reply cut off'
    WHEN 9 THEN 'no route' WHEN 11 THEN 'bad value | QO' || user_id WHEN 14 THEN 'in use: yes' END AS error,
  {LOG_SHAPE} <> 12 AS parsed"""

ORACLE_SQL = {
    "quotation_scan": f"""WITH {MODULES}
SELECT {ID} AS quotation_id, {ID} AS docno,
  CASE WHEN o_orderstatus = 'P' THEN strftime({DAY}, '%d/%m/%Y') ELSE CAST({DAY} AS VARCHAR) END AS day,
  CAST({DAY} AS VARCHAR) AS period_start, c_name AS customer, c_mktsegment AS segment,
  o_orderpriority AS priority, 'go live' AS last_note, CAST(n_modules AS INTEGER) AS n_modules
FROM {ORDERS} LEFT JOIN modules ON o_orderkey = l_orderkey""",
    "quotation_lookup": f"""WITH {LANDED}
SELECT request_seq, r.quotation_id, COALESCE(status, 404) AS http_status, customer
FROM requests r LEFT JOIN landed l ON r.quotation_id = l.quotation_id""",
    "lookup_misses": f"""WITH {LANDED}
SELECT request_seq, quotation_id FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.quotation_id = r.quotation_id)""",
    "payload_gate": f"""SELECT o_orderkey,
  CASE WHEN o_orderpriority = '2-HIGH' THEN {ID} WHEN o_orderpriority = '5-LOW' THEN ''
    WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus NOT IN ('P', 'F') THEN {ID}
    END AS quotation_id,
  o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus NOT IN ('P', 'F') AS accepted FROM {ORDERS}""",
    "template_scan": f"""WITH split_pages AS (
  SELECT page_id, string_split(html, chr(10)) AS lines FROM pages),
placed AS (SELECT page_id, lines, unnest(range(len(lines))) AS pos FROM split_pages),
runs AS (
  SELECT CAST(page_id AS VARCHAR) AS template_id, CAST(pos AS INTEGER) AS run_seq,
    '{{{{ Contract_id }}}} ' || lines[pos + 1] || ' {{{{Quotation_date}}}}' AS text FROM placed)
SELECT template_id, run_seq, regexp_replace(text, '{PLACEHOLDER}', '|', 'g') AS literals,
  array_to_string(regexp_extract_all(text, '{PLACEHOLDER}', 1), '|') AS fields FROM runs""",
    "parts_union": """
SELECT doc_id, 'body' AS part, 0 AS section, 0 AS run_seq, text FROM documents
UNION ALL SELECT page_id, 'header', 0, 0, url FROM pages
UNION ALL SELECT c_custkey, 'first_page_header', 0, 0, c_name FROM customer
UNION ALL SELECT s_suppkey, 'even_page_header', 0, 0, s_name FROM supplier
UNION ALL SELECT conv_id, 'footer', 0, CAST(turn AS INTEGER), text FROM conversations
UNION ALL SELECT p_partkey, 'first_page_footer', 0, 0, p_name FROM part""",
    "result_sink": RESULTS,
    "contract_projection": f"""WITH {RECORD}
SELECT {", ".join(f'"{f}"' for f in CONTRACT_FIELDS)} FROM record""",
    "parse_extraction": f"""SELECT o_orderkey, {REPLY_GOOD} AS parsed,
  {", ".join(f'{of_reply(REPLY_RAW.get(f, "NULL"))} AS "raw_{f}"' for f in CONTRACT_FIELDS)},
  {", ".join(f'{of_reply(REPLY_MARKED.get(f, "NULL"))} AS "marked_{f}"' for f in CONTRACT_FIELDS)}
FROM {ORDERS}""",
    "schema_conformance": f"""WITH reply AS (
  SELECT o_orderkey, o_orderpriority, {REPLY_KEYS} AS keys, {whole(CONTRACT_FIELDS)} AS declared FROM {ORDERS})
SELECT o_orderkey,
  {of_reply("array_to_string(list_filter(declared, lambda x: NOT list_contains(keys, x)), '|')")} AS missing,
  {of_reply("array_to_string(list_filter(keys, lambda x: NOT list_contains(declared, x)), '|')")} AS extra
FROM reply""",
    "not_found_fill": f"""WITH {MODULES}
SELECT o_orderkey, COALESCE(details, {S}) AS details
FROM {ORDERS} LEFT JOIN modules ON o_orderkey = l_orderkey""",
    "blank_or_sentinel": f"""WITH {DOCUMENT_LINES}
SELECT doc_id, line_no, {unmarked("value")} AS unmarked FROM document_lines""",
    "marked_run_filter": f"""WITH {PIECES}
SELECT doc_id, part, run_seq, piece_seq FROM pieces WHERE contains(text, {M})""",
    "nonempty_segments": f"""WITH {MARKED_ORDERS}
SELECT o_orderkey, CAST(pos AS INTEGER) AS seg_seq, pieces[pos + 1] AS text FROM placed
WHERE pieces[pos + 1] <> ''""",
    "payload_to_json": f"""SELECT o_orderkey, '{{"docno":"' || {ID} || '","custkey":' || o_custkey
  || ',"customer":{{"name":"' || c_name || '","tax_id":null}},"date":"' || {thai(DAY)} || '"}}' AS json
FROM {ORDERS}""",
    "rule_extract": f"""WITH {RECORD}
SELECT doc_id, {", ".join(f'"{rule.field}"' for rule in RULES)} FROM record""",
    "batch_extract": f"""SELECT {ID} AS quotation_id, {ID} AS "Contract_id",
  c_name AS "Customer_company_name", {S} AS "Customer_tax_id" FROM {ORDERS}""",
    "line_items_nest": f"""WITH {ITEM_POSITIONS}
SELECT l_orderkey, pos // 500 AS chunk_seq, CAST(COUNT(*) AS INTEGER) AS n_items,
  string_agg(specification || '=' || total_amount, '|' ORDER BY pos) AS items
FROM numbered GROUP BY 1, 2""",
    "line_items_explode": f"""WITH {ITEM_POSITIONS}
SELECT l_orderkey, pos // 500 AS chunk_seq, CAST(pos % 500 AS INTEGER) AS item_seq,
  specification, total_amount FROM numbered""",
    "wrap_value": f"""SELECT doc_id, {mark("text")} AS marked FROM documents""",
    "wrap_nested": f"""SELECT o_orderkey, {mark("c_name")} AS name,
  array_to_string(list_transform([o_orderpriority, {S}, ' ' || chr(9), {DIRTY}],
    lambda x: {mark("x")}), '|') AS tags,
  {mark("c_mktsegment")} AS segment, o_custkey AS number FROM {ORDERS}""",
    "split_marker": f"""WITH {MARKED_ORDERS}
SELECT o_orderkey, CAST(len(pieces) AS INTEGER) AS n_pieces, array_to_string(pieces, '|') AS pieces
FROM pieces""",
    "filled_flag": f"""WITH {MARKED_ORDERS}
SELECT o_orderkey, CAST(pos AS INTEGER) AS seg_seq, pieces[pos + 1] AS text, pos % 2 = 1 AS is_filled
FROM placed""",
    "preserve_space": f"""WITH {DOCUMENT_LINES}
SELECT doc_id, line_no, {edge_space("value")} AS preserve_space FROM document_lines""",
    "segment_style": f"""WITH marked AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN c_name ELSE {MARKED_LINE} END AS text
  FROM {ORDERS}),
pieces AS (SELECT o_orderkey, string_split(text, {M}) AS pieces FROM marked),
placed AS (SELECT o_orderkey, pieces, unnest(range(len(pieces))) AS pos FROM pieces)
SELECT o_orderkey, CAST(pos AS INTEGER) AS seg_seq, pos % 2 = 1 AS is_filled,
  CASE WHEN pos % 2 = 1 THEN 'single' WHEN len(pieces) = 1 THEN 'double' END AS underline,
  CASE WHEN pos % 2 = 1 THEN 'FF0000' END AS color FROM placed""",
    "result_name": f"""SELECT o_orderkey, {ID} AS quotation_id,
  CASE WHEN o_orderstatus <> 'P' THEN '{FILE_PREFIX}' || {ID} || '.docx' END AS file_name,
  CASE WHEN o_orderstatus <> 'P' THEN '{FILE_PREFIX}' ELSE 'contract_' END || {ID} || '.docx' AS shown_name
FROM orders""",
    "base64_roundtrip": """SELECT doc_id, base64(encode(text)) AS file_base64, text AS decoded
FROM documents""",
    "error_detail": f"""WITH {BODY}
SELECT event_id,
  CASE WHEN kind = 'signup' THEN 'd' || event_id WHEN kind = 'error' AND NOT broken THEN 'e' || event_id
    ELSE '{LOGIN_ERROR_DEFAULT}' END AS login_error,
  CASE WHEN kind = 'signup' THEN 'd' || event_id WHEN kind = 'error' AND NOT broken THEN 'e' || event_id
    ELSE '{QUOTATION_ERROR_DEFAULT}' END AS quotation_error,
  CASE WHEN kind = 'signup' THEN 'd' || event_id WHEN kind = 'click' THEN ''
    WHEN kind = 'error' AND NOT broken THEN NULL ELSE '{LOGIN_ERROR_DEFAULT}' END AS upstream_detail
FROM bodies""",
    "display_name": f"""WITH {BODY}
SELECT event_id, CASE WHEN kind = 'click' THEN 'n' || event_id
  WHEN kind = 'error' AND NOT broken THEN 'm' ELSE '{DISPLAY_NAME_DEFAULT}' END AS display_name
FROM bodies""",
    "success_flag": f"""WITH {BODY}
SELECT event_id, CASE WHEN NOT broken THEN kind IN ('view', 'click', 'purchase') END AS success,
  kind = 'view' AS login_accepted FROM bodies""",
    "record_id": f"SELECT o_orderkey, sha256({ID} || chr(31) || o_custkey) AS record_id FROM orders",
    "log_timestamp": f"SELECT event_id, {LOG_TIME} AS logged_at FROM events",
    "thai_date": f"SELECT o_orderkey, {thai('o_orderdate')} AS thai_date FROM orders",
    "baht_amount": f"SELECT o_orderkey, {baht('o_totalprice')} AS amount FROM orders",
    "payment_terms": f"SELECT o_orderkey, {TERMS} AS terms FROM orders",
    "module_details": f"""WITH {MODULES}
SELECT o_orderkey, n_modules, details FROM {ORDERS} LEFT JOIN modules ON o_orderkey = l_orderkey""",
    "template_merge": f"""WITH named AS (
  SELECT o_orderkey, c_nationkey, {", ".join(
    f'{ {"Contract_id": ID, "Customer_company_name": DIRTY}.get(f, S) } AS "{f}"' for f in CONTRACT_FIELDS)}
  FROM {ORDERS}),
known AS ({" UNION ALL ".join(
    f"SELECT 'known' AS form, o_orderkey, '{r.part}' AS part, {r.section} AS section, "
    f"{r.run_seq} AS run_seq, {run_text(r, mark)} AS text FROM named" for r in TEMPLATE)})
SELECT *, TRUE AS template_found FROM known
UNION ALL SELECT 'data', o_orderkey, 'body', 0, 0, {NATION_TEXT}, TRUE
FROM {ORDERS} JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'data', o_orderkey, 'header', 0, 0, NULL, TRUE
FROM {ORDERS} JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'data', o_orderkey, 'footer', 0, 0, 'Office of ' || n_name, TRUE
FROM {ORDERS} JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')
UNION ALL SELECT 'data', o_orderkey, NULL, NULL, NULL, NULL, FALSE
FROM {ORDERS} WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
    "run_text_concat": f"""WITH {PIECES},
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY {RUN_KEYS} ORDER BY piece_seq, text) - 1) // 800
    AS chunk_seq, CAST(length(text) - length(replace(text, {M}, '')) AS BIGINT) AS n FROM pieces),
chunks AS (
  SELECT {RUN_KEYS}, chunk_seq, SUM(n) AS n, string_agg(text, '' ORDER BY piece_seq, text) AS text
  FROM numbered GROUP BY ALL)
SELECT {RUN_KEYS}, chunk_seq, COUNT(*) OVER (PARTITION BY {RUN_KEYS}) AS chunks, CAST(COALESCE(SUM(n) OVER (PARTITION BY {RUN_KEYS} ORDER BY chunk_seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS markers_before,
  CAST(SUM(n) OVER (PARTITION BY {RUN_KEYS}) AS BIGINT) AS markers, text FROM chunks""",
    "segment_runs": f"WITH {CONVERSATION_SEGMENTS} SELECT * FROM segments",
    "segment_order": f"""WITH {CONVERSATION_SEGMENTS}
SELECT {RUN_KEYS}, seg_seq, row_number() OVER (
  PARTITION BY doc_id ORDER BY part <> 'body', section, run_seq, seg_seq) AS position FROM segments""",
    "contract_key_values": f"""WITH {RECORD},
listed AS (
  UNPIVOT record ON {", ".join(f'"{f}"' for f in CONTRACT_FIELDS)} INTO NAME field VALUE value)
SELECT doc_id, field, value, value = {S} AS is_not_found FROM listed""",
    "generate_contracts": f"""WITH {RECORD},
runs AS ({CONTRACT_RUNS}),
{segments_of("runs", RUN_KEYS)}
SELECT * FROM segments""",
    "contract_outputs": f"""WITH {RECORD},
good AS (SELECT * FROM record WHERE NOT contains("Contract_date", '/')),
runs AS ({CONTRACT_RUNS.replace(" FROM record", " FROM good")}),
{segments_of("runs", RUN_KEYS)}
SELECT doc_id, NULL AS http_status, part, run_seq, seg_seq, text AS value FROM segments
UNION ALL SELECT doc_id, 200, NULL, NULL, NULL, base64(encode({FILE_TEXT})) FROM good
UNION ALL SELECT NULL, 422, NULL, NULL, NULL, '] x' FROM record WHERE contains("Contract_date", '/')""",
    "reply_results": f"""SELECT {ID} AS doc_id, {REPLY_GOOD} AS accepted,
  CASE WHEN {REPLY_GOOD} THEN 200 ELSE 500 END AS http_status,
  {of_reply(f"'{FILE_PREFIX}' || {ID} || '.docx'")} AS file_name,
  {of_reply(f"base64(encode({REPLY_FILE}))")} AS file_base64,
  {of_reply(f"sha256({REPLY_TEXT})")} AS reply_sha256,
  CASE WHEN NOT {REPLY_GOOD} THEN sha256({REPLY_TEXT} || {REPLY_ENDING}) END AS rejected_sha256,
  {of_reply(ID)} AS "Contract_id", {of_reply("c_name")} AS "Customer_company_name",
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '3-MEDIUM') THEN {S} END AS "Customer_tax_id",
  CASE WHEN o_orderpriority = '2-HIGH' THEN CAST(o_custkey AS VARCHAR) END AS "Standard_users_count"
FROM {ORDERS}""",
    "reply_segments": f"""WITH runs AS ({REPLY_RUNS}),
{segments_of("runs", RUN_KEYS)}
SELECT * FROM segments""",
    "contracts_from_templates": f"""WITH {RECORD},
{PRIORITY_RUNS},
{segments_of("runs", "template_id, " + RUN_KEYS)}
SELECT *, 200 AS http_status FROM segments
UNION ALL SELECT "Implement_package_name", doc_id, {", ".join(["NULL"] * 9)}, 500
FROM record WHERE "Implement_package_name" = '5-LOW'""",
    "log_parse": f"""WITH parsed AS (SELECT event_id, {LOG_PARSED} FROM events)
SELECT *, CASE WHEN outcome = 'succeeded' THEN 200 WHEN outcome = 'unreachable' THEN 503
  WHEN outcome = 'error' THEN 500 WHEN outcome = 'failed' THEN COALESCE(http_status, 200) END AS code
FROM parsed""",
    "outcome_class": """WITH requests AS (
  SELECT event_id, value, user_id, CASE WHEN event_type IN ('signup', 'view') THEN 'login'
    WHEN event_type = 'purchase' THEN 'generate' ELSE 'quotation' END AS operation FROM events)
SELECT event_id, operation, CASE
  WHEN operation = 'quotation' AND user_id < 10 THEN 401
  WHEN operation = 'generate' AND user_id < 20 THEN 401
  WHEN operation = 'generate' THEN CASE WHEN value < 10 THEN 500 ELSE 200 END
  WHEN value < 5 THEN 503 WHEN value < 10 THEN 500 WHEN value < 30 THEN 404 ELSE 200 END AS code
FROM requests""",
    "generate_contracts_stream": RESULTS,
    "contract_tables_stream": f"""WITH {RECORD.replace("record AS (", "whole AS (")},
record AS (SELECT * FROM whole WHERE NOT contains("Contract_date", '/')),
{PRIORITY_RUNS},
{segments_of("runs", "template_id, " + RUN_KEYS)},
results AS (
  SELECT doc_id, "Implement_package_name" AS template_id,
    CASE WHEN "Implement_package_name" = '5-LOW' THEN 500 ELSE 200 END AS number,
    CASE WHEN "Implement_package_name" <> '5-LOW' THEN base64(encode(
      "Implement_package_name" || ': ' || {cut("Contract_id")} || ' for ' || {cut("Customer_company_name")}
      || ', tax {SENTINEL}' || chr(10) || "Implement_package_name" || ' of ' || {cut("Quotation_date")})) END AS value
  FROM record
  UNION ALL SELECT NULL, NULL, 422, '] x' FROM whole WHERE contains("Contract_date", '/'))
SELECT 'results' AS kind, * FROM results
UNION ALL SELECT 'dead_letters', * FROM results WHERE number <> 200
UNION ALL SELECT 'segments', doc_id, template_id, seg_seq, text FROM segments""",
    "log_parse_stream": f"""SELECT CASE {LOG_SHAPE}
  WHEN 0 THEN '[' || {LOG_TIME} || '] พยายามล็อกอิน: userid=u' || user_id
  WHEN 1 THEN '[✅ สำเร็จ] [' || {LOG_TIME} || '] userid=u' || user_id
  WHEN 2 THEN '[❌ ล้มเหลว] [' || {LOG_TIME} || '] userid=u' || user_id || ' | error=wrong password | twice'
  WHEN 3 THEN '[❌ ล้มเหลว] [' || {LOG_TIME} || '] userid=u' || user_id || ' | HTTP ' || (400 + user_id % 100)
  WHEN 4 THEN '[❌ เชื่อมต่อไม่ได้] [' || {LOG_TIME} || '] userid=u' || user_id
  WHEN 5 THEN '[❌ ข้อผิดพลาด] [' || {LOG_TIME} || '] userid=u' || user_id || ' | HTTP reply cut off'
  WHEN 6 THEN '[' || {LOG_TIME} || '] ดึงข้อมูลใบเสนอราคา: QO' || user_id
  WHEN 7 THEN '[✅ สำเร็จ] ดึงข้อมูลใบเสนอราคา: QO' || user_id
  WHEN 8 THEN '[❌ ล้มเหลว] ดึงข้อมูลใบเสนอราคา: QO' || user_id || ' | HTTP ' || (400 + user_id % 100)
  WHEN 9 THEN '[❌ ข้อผิดพลาด] ดึงข้อมูลใบเสนอราคา: QO' || user_id || ' | no route'
  WHEN 10 THEN '[✅ สำเร็จ] กำลังสร้างสัญญาจากใบเสนอราคา: QO' || user_id
  WHEN 11 THEN 'เกิดข้อผิดพลาดในระบบ: bad value | QO' || user_id
  WHEN 13 THEN 'ลบไฟล์ชั่วคราวเรียบร้อย: /tmp/QO' || user_id || '.docx'
  WHEN 14 THEN 'เกิดข้อผิดพลาดในการลบไฟล์ชั่วคราว /tmp/QO' || user_id || '.docx: in use: yes'
  ELSE 'INFO: ' || event_type || ' 200 OK' END AS line, {LOG_PARSED}
FROM events""",
}
