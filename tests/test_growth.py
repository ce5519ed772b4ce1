"""That the figures of the contract jobs grow no faster than their input."""

import re

from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from inkfold.constants import CONTRACT_FIELDS, SENTINEL
from inkfold.functions import formats
from inkfold.operators import merge
from inkfold.operators.records import mark_record
from inkfold.plans import contracts
from inkfold.sources import results
from inkfold.sources.quotations import quotation_scan
from inkfold.streaming import jobs
from inkfold.workload import tables as t

RULES = t.RULES[:1]
TEMPLATE = t.TEMPLATE[:2]
LINES = ['{"quotation_id":"a","result_quotation":{"docno":"1","n":[1.0,"x"]}}', '{"quotation_id":"b","result_quotation":"{}"}', "{}] x"]
WRITERS = results.OPEN_FOLDERS[0]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def orders_in(folder, spark, orders, items):
    """The tables that payloads are made from, ``items`` to an order and every tenth line without an order."""
    keys = spark.range(orders)
    day, key = F.lit("2024-02-03").cast("timestamp"), F.col("id")
    frames = {
        "customer": keys.select(
            key.alias("c_custkey"), F.concat(F.lit("C"), key).alias("c_name"), key.alias("c_nationkey"), F.lit("S").alias("c_mktsegment")
        ),
        "part": spark.range(4).select(F.col("id").alias("p_partkey"), F.concat(F.lit("B"), F.col("id") % 2).alias("p_brand")),
        "orders": keys.select(
            key.alias("o_orderkey"), key.alias("o_custkey"), F.lit("O").alias("o_orderstatus"),
            F.lit(1234.5).alias("o_totalprice"), day.alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"),
        ),
        "lineitem": spark.range(orders * items).select(
            F.when(F.col("id") % 10 > 0, F.col("id") % orders).alias("l_orderkey"),
            (F.col("id") % 5).alias("l_partkey"),
            (F.col("id") / 100).alias("l_extendedprice"),
        ),
    }
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_modules_take_one_shuffle_by_order_whose_parts_grow_with_the_table(spark, tmp_path):
    folder = orders_in(tmp_path, spark, 30, 20)
    made = t.orders_with_modules(spark, folder)
    plan = plan_of(made)
    assert "RoundRobin" not in plan
    splits = t.table(spark, folder, "lineitem").rdd.getNumPartitions()
    assert re.findall(r"hashpartitioning\(l_orderkey#\d+L?(?:, name#\d+)?, (\d+)\)", plan) == [str(8 * splits)]
    expected = {}
    for i in range(600):
        if i % 10:
            brand = None if i % 5 == 4 else f"B{i % 5 % 2}"
            brands = expected.setdefault(i % 30, {})
            brands[brand] = brands.get(brand, 0) + i
    rows = made.select("o_orderkey", "modules").collect()
    assert len(rows) == 30
    for row in rows:
        found = row["modules"] and {m["name"]: int(m["monthly"] * 100) for m in row["modules"]}
        assert found == expected.get(row["o_orderkey"])


def test_plain_amounts_are_read_without_the_pattern(spark, evaluate):
    values = ["1234.5", " 12 ", "1,234.50 บาท", "12บาท", "\t-3.005\n", "1,2", "x", "", None, "1e3", "1,234,567"]
    shown = ["1,234.50", "12.00", "1,234.50", "12.00", "-3.01", "1,2", "x", None, None, "1,000.00", "1,234,567.00"]
    assert evaluate(formats.grouped_amount, values) == shown
    plan = plan_of(spark.range(1).select(formats.grouped_amount(F.col("id"))))
    assert re.search(r"THEN regexp_replace", plan)


def templates_of(spark):
    rows = [("t", "body", 0, 0, "{{Contract_id}}/{{ Quotation_date }}/{{ Nobody }}."), ("t", "body", 0, 1, None)]
    return spark.createDataFrame(rows, "template_id STRING, part STRING, section INT, run_seq INT, text STRING")


def records_of(spark):
    given = {"Contract_id": F.lit(' "7", '), "Quotation_date": F.col("remark")}
    values = [given.get(name, F.lit(SENTINEL)).alias(name) for name in CONTRACT_FIELDS]
    rows = [("a", "t", "r"), ("b", "t", None), ("c", "lost", "r")]
    frame = spark.createDataFrame(rows, "quotation_id STRING, template_id STRING, remark STRING")
    return frame.select("quotation_id", "template_id", F.struct(*values).alias("record"))


def test_segments_mark_only_the_values_that_runs_take(spark):
    records, templates = records_of(spark), templates_of(spark)
    made = contracts.segments_from_templates(
        records, templates, F.when(F.col("quotation_id") == "c", "lost").otherwise("t"), True
    )
    plan = plan_of(made)
    assert "map_from_arrays" not in plan and plan.count("RLIKE") <= 2
    shown = [(r["quotation_id"], r["http_status"], r["seg_seq"], r["text"]) for r in made.collect()]
    expected = [("a", 200, 1, "7"), ("a", 200, 2, "/"), ("a", 200, 3, "r"), ("a", 200, 4, "/."), ("b", 200, 1, "7"), ("b", 200, 2, "//."), ("c", 500, None, None)]
    assert sorted(shown, key=repr) == sorted(expected, key=repr)


def test_marked_and_unmarked_documents_merge_alike(spark):
    records, templates = records_of(spark), templates_of(spark)
    marked = records.select("quotation_id", "template_id", mark_record(F.col("record")).alias("marked"))
    for job in (merge.template_merge_data, merge.template_texts):
        for small in (True, False):
            known = job(marked, templates, small)
            found = job(records, templates, small).select(*known.columns)
            assert sorted(map(repr, found.collect())) == sorted(map(repr, known.collect()))


def test_results_mark_only_the_values_that_runs_take(spark):
    records = records_of(spark).select(
        F.lit(None).cast("string").alias("payload"), "quotation_id", F.lit(True).alias("accepted"), "record"
    )
    made = contracts.results_from_templates(records, templates_of(spark), F.lit("t"), True)
    plan = plan_of(made)
    assert "map_from_arrays" not in plan and plan.count("RLIKE") <= 2
    assert {r["contract_data"]["Contract_id"] for r in made.collect()} == {' "7", '}


def test_the_sink_keeps_both_folders_open(spark, tmp_path, monkeypatch):
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **options):
        seen.append(int(spark.conf.get(WRITERS)))
        return write(self, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    spark.conf.unset(WRITERS)
    payloads = spark.createDataFrame([(line,) for line in LINES], "payload STRING").coalesce(1)
    results.write_results(contracts.contract_results(payloads, RULES, TEMPLATE), str(tmp_path / "sink"))
    assert seen[0] >= 2 and int(spark.conf.get(WRITERS)) == 0
    kept = results.read_results(spark, str(tmp_path / "sink")).collect()
    assert sorted((r["http_status"], r["accepted"]) for r in kept) == [(200, True), (422, False), (422, False)]


def test_the_stream_keeps_all_folders_open(spark, tmp_path):
    spark.conf.unset(WRITERS)
    spark.createDataFrame([(line,) for line in LINES], "value STRING").coalesce(1).write.text(str(tmp_path / "in"))
    jobs.generate_contracts_stream(
        spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), RULES, TEMPLATE
    ).awaitTermination()
    assert int(spark.conf.get(WRITERS)) >= 2
    spark.conf.unset(WRITERS)
    assert results.read_results(spark, str(tmp_path / "out")).count() == len(LINES)


def test_documents_are_checked_as_a_whole_once(spark):
    scanned = quotation_scan(spark.createDataFrame([(line,) for line in LINES], "payload STRING"))
    assert plan_of(scanned).count("sha2(") == 1
    assert [tuple(r) for r in scanned.collect()] == [("a", '{"docno":"1","n":[1.0,"x"]}')]
