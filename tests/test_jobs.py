import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from inkfold.constants import CONTRACT_FIELDS, SENTINEL
from inkfold.operators.extract import Rule
from inkfold.operators.outcomes import log_parse, logged_code, outcome_class
from inkfold.plans import contracts
from inkfold.sources import logs, results
from inkfold.sources.quotations import quotation_scan, scan_payloads
from inkfold.sources.templates import TEMPLATE_SCHEMA, Run, scan_templates
from inkfold.streaming import jobs

RULES = [
    Rule("Contract_id", "$.no"),
    Rule("Customer_company_name", "$.customer.name"),
    Rule("License_fee", "$.fee", "baht_amount"),
]
TEMPLATE = [
    Run("body", 0, 0, "No. {{ Contract_id }} for {{ Customer_company_name }}; tax {{ Customer_tax_id }}."),
    Run("body", 0, 1, "As agreed.", underline="double"),
    Run("footer", 0, 0, "{{ License_fee }}"),
]
LINES = [
    '{"quotation_id":"a","result_quotation":{"no":"1","customer":{"name":" \\"Co\\", "},"fee":5}}',
    '{"quotation_id":"b","result_quotation":{}}',
    '{"quotation_id":"a","result_quotation":{"no":"1","customer":{"name":" \\"Co\\", "},"fee":5}}',
    '{"quotation_id":"c","result_quotation":[]}',
    "not json",
]


@pytest.fixture
def payloads(spark):
    return spark.createDataFrame([(line,) for line in LINES], "payload STRING")


def test_generate_contracts(payloads):
    made = contracts.generate_contracts(payloads, RULES, TEMPLATE).collect()
    columns = ["part", "run_seq", "seg_seq", "text", "is_filled", "underline", "color"]
    shown = [tuple(r[c] for c in columns) for r in made if r["quotation_id"] == "a"]
    once = [
        ("body", 0, 0, "No. ", False, None, None),
        ("body", 0, 1, "1", True, "single", "FF0000"),
        ("body", 0, 2, " for ", False, None, None),
        ("body", 0, 3, "Co", True, "single", "FF0000"),
        ("body", 0, 4, f"; tax {SENTINEL}.", False, None, None),
        ("body", 1, 0, "As agreed.", False, "double", None),
        ("footer", 0, 1, "5.00 บาท", True, "single", "FF0000"),
    ]
    assert sorted(shown) == sorted(once * 2)
    missing = [r["text"] for r in made if r["quotation_id"] == "b"]
    assert missing == [f"No. {SENTINEL} for {SENTINEL}; tax {SENTINEL}.", "As agreed.", SENTINEL]
    assert {r["quotation_id"] for r in made} == {"a", "b"}


def check_results(made):
    by_id = {r["quotation_id"]: r for r in made}
    assert len(made) == len(LINES)
    good = by_id["a"]
    text = base64.b64decode(good["file_base64"]).decode()
    assert text == f"No. 1 for Co; tax {SENTINEL}.\nAs agreed.\n5.00 บาท"
    assert (good["http_status"], good["file_name"]) == (200, "สัญญา_a.docx")
    assert good["contract_data"]["Customer_company_name"] == ' "Co", '
    assert list(good["contract_data"].asDict()) == CONTRACT_FIELDS
    rejected = sorted(r["rejected"] for r in made if not r["accepted"])
    assert rejected == sorted(LINES[3:])
    bad = by_id["c"]
    assert (bad["http_status"], bad["file_name"], bad["file_base64"], bad["contract_data"]) == (422, None, None, None)


TEMPLATE_ROWS = [("t", r.part, r.section, r.run_seq, r.text, r.underline, r.color) for r in TEMPLATE]


def test_a_document_succeeds_or_fails(spark, payloads):
    kind = "template_id STRING, part STRING, section INT, run_seq INT, text STRING, underline STRING, color STRING"
    only_null = ("n", "body", 0, 0, None, None, None)
    table = spark.createDataFrame([*TEMPLATE_ROWS, ("t", "header", 0, 0, None, None, None), only_null], kind)
    for chosen in ("t", "n", "lost", None):
        template_id = F.when(F.col("record.Contract_id") == "1", F.lit(chosen)).otherwise("t")
        for small in (True, False) if chosen == "lost" else (True,):
            made = contracts.contracts_from_templates(payloads, RULES, table, template_id, small)
            states = {}
            for r in made.collect():
                states.setdefault(r["quotation_id"], []).append((r["http_status"], r["text"] is None))
            expected = {"t": {(200, False)}, "n": None, "lost": {(500, True)}, None: {(500, True)}}[chosen]
            assert (set(states["a"]) if "a" in states else None) == expected and set(states["b"]) == {(200, False)}
            if chosen in ("lost", None):
                assert len(states["a"]) == 2  # one row for each of the two payloads
    known = contracts.generate_contracts(payloads, RULES, TEMPLATE)
    made = contracts.contracts_from_templates(payloads, RULES, table, F.lit("t"), True)
    assert sorted(map(repr, made.select(*known.columns).collect())) == sorted(map(repr, known.collect()))
    plan = physical_plan(contracts.contracts_from_templates(payloads, RULES, table, F.lit("t"), True))
    assert plan.count("from_json") == 1 and "Union" not in plan


def test_equal_jobs_have_equal_plans(payloads):
    for job in (
        lambda: contracts.generate_contracts(payloads, RULES, TEMPLATE),
        lambda: contracts.contract_results(payloads, RULES, TEMPLATE),
        lambda: quotation_scan(payloads),
    ):
        assert job().sameSemantics(job())


def test_results_and_sink(spark, payloads, tmp_path):
    made = contracts.contract_results(payloads, RULES, TEMPLATE)
    check_results(made.collect())
    path = str(tmp_path / "sink")
    results.write_results(made, path)
    check_results(results.read_results(spark, path).collect())
    plan = results.read_results(spark, path).where("accepted")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(accepted" in plan


def test_replies_take_the_same_way(spark):
    replies = [("a", json.dumps({"Contract_id": "1", "License_fee": 5})), ("b", "oops"), ("c", None)]
    frame = spark.createDataFrame(replies, "quotation_id STRING, reply STRING")
    made = {r["quotation_id"]: r for r in contracts.reply_results(frame, TEMPLATE).collect()}
    assert [made[k]["http_status"] for k in "abc"] == [200, 500, 500]
    assert base64.b64decode(made["a"]["file_base64"]).decode() == "No. 1 for ; tax .\nAs agreed.\n5"
    pieces = contracts.reply_segments(frame, TEMPLATE).where("is_filled").collect()
    assert [(r["quotation_id"], r["text"]) for r in pieces] == [("a", "1")]


def land(spark, folder, lines):
    spark.createDataFrame([(line,) for line in lines], "value STRING").write.mode("append").text(folder)


def test_contract_stream_is_the_batch(spark, payloads, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for part in (LINES[:2], LINES[2:]):
        land(spark, source, part)
        jobs.generate_contracts_stream(spark, source, sink, progress, RULES, TEMPLATE).awaitTermination()
    check_results(results.read_results(spark, sink).collect())


def test_segment_stream_is_the_batch(spark, payloads, tmp_path):
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    land(spark, source, LINES)
    jobs.contract_segments_stream(spark, source, sink, progress, RULES, TEMPLATE).awaitTermination()
    expected = contracts.generate_contracts(payloads, RULES, TEMPLATE)
    got = spark.read.parquet(sink).select(*expected.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))


def test_both_outputs_from_one_parse(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "in")
    land(spark, path, LINES)
    scanned = spark.read.text(path).withColumnRenamed("value", "payload")
    plans, plain = [], contracts.written
    monkeypatch.setattr(contracts, "written", lambda df, label: plans.append(physical_plan(df)) or plain(df, label))
    made, pieces = contracts.contract_outputs(scanned, RULES, TEMPLATE)
    assert len(plans) == 1 and plans[0].count("from_json") == 1 and "Exchange" not in plans[0]
    assert not any("from_json" in physical_plan(f) for f in (made, pieces))
    check_results(made.collect())
    expected = contracts.generate_contracts(scanned, RULES, TEMPLATE)
    assert sorted(map(repr, pieces.collect())) == sorted(map(repr, expected.collect()))


def test_contract_tables_stream(spark, tmp_path):
    source, sink, progress, kept = (str(tmp_path / n) for n in ("in", "out", "progress", "templates"))

    def run():
        scan = lambda session: scan_templates(session, kept)
        chosen = F.when(F.col("record.Contract_id") == "1", F.lit("t")).otherwise("lost")
        jobs.contract_tables_stream(spark, source, sink, progress, RULES, scan, chosen).awaitTermination()
        tables = {n: jobs.contract_table(spark, sink, n) for n in ("records", "results", "segments", "dead_letters")}
        return {n: sorted(map(repr, f.collect())) for n, f in tables.items()}

    def put_templates(note):
        made = [*TEMPLATE_ROWS, ("t", "header", 0, 0, note, None, None), ("t", "header", 0, 1, None, None, None)]
        spark.createDataFrame(made, TEMPLATE_SCHEMA).write.mode("overwrite").parquet(kept)

    put_templates("first")
    land(spark, source, LINES)
    one = run()
    results_ = jobs.contract_table(spark, sink, "results").collect()
    assert sorted((r["quotation_id"] or "", r["http_status"]) for r in results_) == [("", 422), ("a", 200), ("a", 200), ("b", 500), ("c", 422)]
    text = base64.b64decode(next(r["file_base64"] for r in results_ if r["quotation_id"] == "a")).decode()
    assert text == f"No. 1 for Co; tax {SENTINEL}.\nAs agreed.\nfirst\n5.00 บาท"
    assert sorted(r["rejected"] or "" for r in results_ if not r["accepted"]) == sorted(LINES[3:])
    dead = jobs.contract_table(spark, sink, "dead_letters").collect()
    assert sorted(r["http_status"] for r in dead) == [422, 422, 500]
    assert next(r for r in dead if r["http_status"] == 500)["contract_data"]["Contract_id"] == SENTINEL
    pieces = jobs.contract_table(spark, sink, "segments")
    assert {r["quotation_id"] for r in pieces.collect()} == {"a"} and pieces.where("text = 'first'").count() == 2

    put_templates("second")  # a later batch sees the templates of its time
    land(spark, source, LINES[:1])
    two = run()
    assert all(set(one[n]) <= set(two[n]) for n in one) and len(two["results"]) == 6
    pieces = jobs.contract_table(spark, sink, "segments")
    assert pieces.where("text = 'second'").count() == 1 and pieces.where("text = 'first'").count() == 2

    for mark in (f"{progress}/commits/1", f"{progress}/commits/.1.crc"):
        os.unlink(mark)  # as if the last batch had been cut off before its commit
    assert run() == two


T = "2026-01-02 03:04:05"
# The shapes of log lines, with what they are parsed to.
LOG = {
    f"[{T}] พยายามล็อกอิน: userid=u": (None, "started", "login", "u", None, None, None),
    f"[✅ สำเร็จ] [{T}] userid=u": ("สำเร็จ", "succeeded", "login", "u", None, None, 200),
    f"[❌ ล้มเหลว] [{T}] userid=u | error=no | such": ("ล้มเหลว", "failed", "login", "u", None, "no | such", 200),
    f"[❌ ล้มเหลว] [{T}] userid=u | HTTP 403": ("ล้มเหลว", "failed", "login", "u", 403, None, 403),
    f"[❌ เชื่อมต่อไม่ได้] [{T}] userid=u": ("เชื่อมต่อไม่ได้", "unreachable", "login", "u", None, None, 503),
    f"[❌ ข้อผิดพลาด] [{T}] userid=u | HTTP was cut": ("ข้อผิดพลาด", "error", "login", "u", None, "HTTP was cut", 500),
    f"[{T}] ดึงข้อมูลใบเสนอราคา: Q": (None, "started", "quotation", "Q", None, None, None),
    "[✅ สำเร็จ] ดึงข้อมูลใบเสนอราคา: Q": ("สำเร็จ", "succeeded", "quotation", "Q", None, None, 200),
    "[❌ ล้มเหลว] ดึงข้อมูลใบเสนอราคา: Q | HTTP 502": ("ล้มเหลว", "failed", "quotation", "Q", 502, None, 502),
    "[❌ ข้อผิดพลาด] ดึงข้อมูลใบเสนอราคา: Q | no route": ("ข้อผิดพลาด", "error", "quotation", "Q", None, "no route", 500),
    "[✅ สำเร็จ] กำลังสร้างสัญญาจากใบเสนอราคา: Q": ("สำเร็จ", "started", "generate", "Q", None, None, None),
    "เกิดข้อผิดพลาดในระบบ: bad | [value]": (None, "error", "generate", None, None, "bad | [value]", 500),
    "": (None,) * 7,
    "INFO: started": (None,) * 7,
    "[✅ สำเร็จ] something else": (None,) * 7,
    "userid=u": (None,) * 7,
}


def check_log(parsed):
    code = logged_code(F.col("action"), F.col("outcome"), F.col("http_status"))
    got = {r["line"]: r for r in parsed.withColumn("code", code).collect()}
    names = ["tag", "outcome", "action", "subject", "http_status", "error", "code"]
    assert {line: tuple(r[n] for n in names) for line, r in got.items()} == LOG
    for line, r in got.items():
        assert str(r["ts"]) == (T if f"[{T}]" in line else "None")
        assert r["parsed"] == (LOG[line][1] is not None)


def test_log_shapes(spark, tmp_path):
    check_log(log_parse(spark.createDataFrame([(line,) for line in LOG], "line STRING")))
    source, sink, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    land(spark, source, LOG)
    check_log(log_parse(logs.scan_logs(spark, source)))
    jobs.log_parse_stream(spark, source, sink, progress).awaitTermination()
    check_log(spark.read.parquet(sink))


OUTCOMES = [
    # operation, upstream status, failure, bearer header, valid token, code
    ("login", 200, None, False, False, 200),
    ("login", 401, None, False, False, 401),
    ("login", None, "connection", False, False, 503),
    ("login", None, "timeout", False, False, 500),
    ("quotation", 200, None, False, True, 401),
    ("quotation", 200, None, True, False, 200),
    ("quotation", 404, None, True, True, 404),
    ("quotation", None, "connection", True, True, 503),
    ("quotation", None, "other", True, True, 500),
    ("generate", None, None, True, False, 401),
    ("generate", None, None, False, True, 401),
    ("generate", None, "connection", True, True, 500),
    ("generate", None, None, True, True, 200),
]


def test_outcome_table(spark):
    ddl = "operation STRING, status INT, failure STRING, bearer BOOLEAN, token BOOLEAN, code INT"
    frame = spark.createDataFrame(OUTCOMES, ddl)
    columns = [F.col(c) for c in ("operation", "status", "failure", "bearer", "token")]
    assert frame.where(~outcome_class(*columns).eqNullSafe(F.col("code"))).count() == 0


def test_a_header_nobody_reported_is_not_there(spark):
    cases = [("quotation", None, True), ("generate", True, None), ("generate", None, True), ("login", None, None)]
    frame = spark.createDataFrame(cases, "op STRING, bearer BOOLEAN, token BOOLEAN")
    code = outcome_class(F.col("op"), F.lit(200), F.lit(None).cast("string"), F.col("bearer"), F.col("token"))
    assert [r["c"] for r in frame.select(code.alias("c")).collect()] == [401, 401, 401, 200]


def test_logs_of_removed_files(spark):
    # The two lines about generated files.
    lines = [
        "ลบไฟล์ชั่วคราวเรียบร้อย: /tmp/a.docx",
        "เกิดข้อผิดพลาดในการลบไฟล์ชั่วคราว /tmp/a.docx: busy: later",
    ]
    got = log_parse(spark.createDataFrame([(line,) for line in lines], "line STRING")).collect()
    assert [(r["action"], r["outcome"], r["subject"], r["error"], r["parsed"]) for r in got] == [
        ("cleanup", "succeeded", "/tmp/a.docx", None, True),
        ("cleanup", "error", "/tmp/a.docx", "busy: later", True),
    ]


def test_rejected_lines_have_no_record(spark):
    good = '{"quotation_id":"1","result_quotation":{"no":"1"}}'
    lines = [good, good + "] trailing", good + "],[1", '{"quotation_id":5,"result_quotation":{}}']
    frame = spark.createDataFrame([(line,) for line in lines], "payload STRING")
    got = contracts.extract_records(frame, RULES).collect()
    assert [(r["accepted"], r["record"] is None) for r in got] == [(True, False)] + [(False, True)] * 3


def test_a_payload_may_be_a_whole_file(spark, tmp_path):
    path = tmp_path / "saved"
    path.mkdir()
    text = '{\n "quotation_id": "1",\n "result_quotation": {"no": "1"}\n}\n'
    (path / "one.json").write_text(text)
    for stream in (False, True):
        frame = scan_payloads(spark, str(path), stream=stream, whole_file=True)
        if stream:
            query = frame.writeStream.format("memory").queryName("saved").trigger(availableNow=True).start()
            query.awaitTermination()
            frame = spark.table("saved")
        assert [r["payload"] for r in frame.collect()] == [text]
        assert contracts.extract_records(frame, RULES).first()["accepted"]


def physical_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans_have_one_parse_and_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "in")
    land(spark, path, LINES)
    scanned = spark.read.text(path).withColumnRenamed("value", "payload")
    for frame in (
        contracts.generate_contracts(scanned, RULES, TEMPLATE),
        contracts.contract_results(scanned, RULES, TEMPLATE),
    ):
        plan = physical_plan(frame)
        assert plan.count("from_json") == 1
        assert "Exchange" not in plan and "Python" not in plan
