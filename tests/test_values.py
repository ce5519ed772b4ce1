import base64
import json
from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkfold.constants import EDGE_CHARACTERS, LOGIN_ERROR_DEFAULT, MARKER, SENTINEL, UNKNOWN_CAUSE
from inkfold.functions import documents, fallbacks, files, formats, nested

M = "⁣"


def test_read_json_takes_exactly_one_value(evaluate):
    texts = ['{"a":"x"}', '{"a":1,"a":2}', ' {"a":"y"} ', '{"a":"x"} tail', '{"a":"x"', "{},{}"]
    texts += ["", "[1]", "5", "null", "{'a':'x'}", '{"b":1}']
    got = evaluate(lambda c: documents.read_json(c, "STRUCT<a: STRING>"), texts)
    shown = [None if row is None else row["a"] for row in got]
    assert shown == ["x", "2", "y", None, None, None, None, None, None, None, None, None]
    assert got[-1] is not None and got[3] is None and got[5] is None


def test_read_json_takes_long_texts_whole(spark):
    size = 25_000_000
    text = F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), size), F.lit('"}'))
    frame = spark.range(1).select(documents.read_json(text, "STRUCT<a: STRING>").alias("r"))
    assert frame.select(F.length("r.a")).first()[0] == size


def test_success_flag(evaluate):
    cases = {
        '{"success":true}': True,
        '{"success":"false"}': True,
        '{"success":0}': False,
        '{"success":0.0}': False,
        '{"success":null}': False,
        '{"success":[]}': False,
        '{"success":{}}': False,
        '{"success":"","success":1}': True,
        "{}": False,
        "[]": False,
        "[0]": True,
        '"x"': True,
        '""': False,
        "null": False,
        "true": True,
        "0": False,
        "0.0": False,
        "{bad": None,
    }
    assert evaluate(fallbacks.success_flag, list(cases)) == list(cases.values())


def test_login_needs_a_token(evaluate):
    bodies = ['{"success":true,"data":"t"}', '{"success":true}', '{"success":true,"data":""}']
    bodies += ['{"success":false,"data":"t"}', "[1]"]
    assert evaluate(fallbacks.login_accepted, bodies) == [True, False, False, False, False]


def test_error_texts(evaluate):
    bodies = ['{"error":"e","detail":"d"}', '{"error":"","detail":"d"}', '{"detail":""}', "{}", "oops"]
    bodies += ['{"detail":null}', '{"detail":["a",1]}']
    default, missing = "ชื่อผู้ใช้หรือรหัสผ่านไม่ถูกต้อง", "ไม่พบข้อมูลใบเสนอราคา"
    listed = '["a",1]'
    assert evaluate(fallbacks.login_error, bodies) == ["e", "d", default, default, default, default, listed]
    assert evaluate(fallbacks.quotation_error, bodies) == ["d", "d", missing, missing, missing, missing, listed]
    assert evaluate(fallbacks.upstream_detail, bodies) == ["d", "d", "", default, default, None, listed]


def test_texts_that_close_the_frame_are_no_json(evaluate):
    texts = ['{"success":true}] x', '{"success":true}],[1', '{"success":true},{"success":true}', '{"success":true}', "", None]
    assert evaluate(fallbacks.success_flag, texts) == [None, None, None, True, None, None]


def test_client_and_log_errors(evaluate):
    bodies = ['{"error":"e","detail":"d"}', '{"error":""}', '{"detail":"d"}', "[1]"]
    assert evaluate(fallbacks.client_error, bodies) == ["e", LOGIN_ERROR_DEFAULT, LOGIN_ERROR_DEFAULT, LOGIN_ERROR_DEFAULT]
    assert evaluate(fallbacks.logged_error, bodies) == ["e", "", UNKNOWN_CAUSE, ""]


def test_display_name(evaluate):
    users = ['{"name":"n","email":"e"}', '{"username":"u","name":"n"}', '{"userid":"x"}']
    assert evaluate(fallbacks.display_name, users) == ["n", "u", "ผู้ใช้งาน"]


def test_dates_and_amounts(evaluate):
    days = ["2024-01-01", "2024-02-29", "1999-12-31", "01/03/2026", " ", None]
    assert evaluate(formats.thai_date, days) == [
        "1 มกราคม 2567",
        "29 กุมภาพันธ์ 2567",
        "31 ธันวาคม 2542",
        "01/03/2026",
        None,
        None,
    ]
    assert evaluate(formats.thai_date, [date(2024, 6, 5)], "DATE") == ["5 มิถุนายน 2567"]
    amounts = ["90000", "1234567.005", "0.5", "1.2E7", "much", "90,000.00", "90000 บาท", " 1,234.5บาท ", "12345678901234567890", "1,2"]
    assert evaluate(formats.baht_amount, amounts) == [
        "90,000.00 บาท",
        "1,234,567.01 บาท",
        "0.50 บาท",
        "12,000,000.00 บาท",
        "much",
        "90,000.00 บาท",
        "90,000.00 บาท",
        "1,234.50 บาท",
        "12,345,678,901,234,567,890.00 บาท",
        "1,2",
    ]
    assert evaluate(formats.grouped_amount, ["7", "", None]) == ["7.00", None, None]


def test_log_timestamp_needs_no_zone(spark, evaluate):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = [datetime(2024, 3, 10, 2, 30, 5, 999999), datetime(2024, 1, 1)]
        got = evaluate(formats.log_timestamp, stamps, "TIMESTAMP_NTZ")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-03-10 02:30:05", "2024-01-01 00:00:00"]


def test_lists(evaluate):
    terms = [("30", "kick off", "90000"), ("70", None, "210000")]
    ddl = "ARRAY<STRUCT<pct: STRING, note: STRING, amount: STRING>>"
    assert evaluate(formats.payment_terms, [terms, [], None], ddl) == [
        "งวดที่ 1 ชำระ 30% kick off เป็นจำนวนเงิน 90,000.00 บาท, "
        "งวดที่ 2 ชำระ 70% เป็นจำนวนเงิน 210,000.00 บาท",
        None,
        None,
    ]
    modules = "ARRAY<STRUCT<name: STRING, monthly: STRING>>"
    lists = [[("HR", "10"), ("CRM", None), ("BI", "free")], [], None]
    assert evaluate(formats.module_details, lists, modules) == ["HR 10.00 บาท, CRM, BI free", None, None]
    assert evaluate(formats.module_count, lists, modules) == ["3", "0", None]


def test_wrap_nested(spark):
    schema = T.StructType.fromDDL(
        "name STRING, n INT, tags ARRAY<STRING>, notes MAP<STRING, STRING>, "
        "items ARRAY<STRUCT<t: STRING, v: DOUBLE>>, empty STRUCT<t: STRING>"
    )
    row = ("a ", 5, ["x", SENTINEL, " ", None], {"k": "'v'"}, [("i", 1.5)], None)
    frame = spark.createDataFrame([(row,)], T.StructType([T.StructField("d", schema)]))
    got = frame.select(nested.wrap_nested(F.col("d"), schema).alias("d")).first()["d"]
    assert got["name"] == f"{M}a{M}" and got["n"] == 5
    assert got["tags"] == [f"{M}x{M}", SENTINEL, " ", None]
    assert got["notes"] == {"k": f"{M}v{M}"}
    assert got["items"][0].asDict() == {"t": f"{M}i{M}", "v": 1.5}
    assert got["empty"] is None


def test_files(spark, evaluate):
    texts = ["", "a" * 200, "สัญญา ไม่พบ\n" * 40]
    encoded = evaluate(lambda c: files.encode_base64(F.encode(c, "UTF-8")), texts)
    assert encoded == [base64.b64encode(t.encode()).decode() for t in texts]
    back = evaluate(lambda c: F.decode(files.decode_base64(c), "UTF-8"), encoded)
    assert back == texts
    assert evaluate(files.result_name, ["QO1"]) == ["สัญญา_QO1.docx"]
    assert evaluate(lambda c: files.shown_name(F.lit(None), c), ["QO1"]) == ["contract_QO1.docx"]
    ids = evaluate(files.record_id, ["a", "b", "a"])
    assert ids[0] == ids[2] != ids[1]


def test_json_text_keeps_nulls_and_letters(spark):
    from inkfold.operators.records import payload_to_json

    frame = spark.createDataFrame([(("ก", None),)], "d STRUCT<a: STRING, b: STRING>")
    got = frame.select(payload_to_json(F.col("d")).alias("t"), payload_to_json(F.col("d"), True).alias("p"))
    row = got.first()
    assert row["t"] == '{"a":"ก","b":null}'
    assert json.loads(row["p"]) == {"a": "ก", "b": None} and "\n" in row["p"]


NESTED = [
    '["p",1]',
    '["a",{"k":"b"}]',
    '{"x":["y"]}',
    '{"a:b":"c","d":":e"}',
    '[[],{},"",[" \\t","\\u001c\\u00a0"],null,true,-1.5,"ไม่พบข้อมูล"]',
    '["\\\\","\\"q\\"","\\\\\\"x","\\\\n, ","\\t\\r\\n x \\f","\\\\\\\\t"]',
    '{"k\\":":{"l":["m\\",\\"n",{"o":"\\u0001p\\u0002"}]}}',
    '["é ü \u2063"," \' \\", "]',
]


def test_wrap_json_is_the_walk(evaluate):
    """Against a walk over the parsed value, on keys, escapes and edges of all kinds."""

    def walk(value):
        if isinstance(value, dict):
            return {key: walk(item) for key, item in value.items()}
        if isinstance(value, list):
            return [walk(item) for item in value]
        if not isinstance(value, str) or value == SENTINEL or not value.strip():
            return value
        return f"{MARKER}{value.strip(EDGE_CHARACTERS)}{MARKER}"

    deep = '"x"'
    for _ in range(40):
        deep = f'[{{"k":{deep}}},"y"]'
    texts = [*NESTED, deep, json.dumps(["w " * 3 + str(i) for i in range(3000)])]
    shown = evaluate(lambda c: nested.wrap_json(F.to_json(F.parse_json(c))), texts)
    assert [json.loads(s) for s in shown] == [walk(json.loads(t)) for t in texts]
