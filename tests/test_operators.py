import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from inkfold.constants import CONTRACT_FIELDS, SENTINEL
from inkfold.operators import extract, joins, line_items, lookup, merge, ordered, records, segments, sizes
from inkfold.operators.extract import Rule
from inkfold.sources import parts, quotations, templates

M = "⁣"


def rows(frame, *columns):
    columns = columns or tuple(frame.columns)
    return sorted((tuple(row) for row in frame.select(*columns).collect()), key=repr)


GATE = {
    '{"quotation_id":"a","result_quotation":{"x":1,"x":2}}': ("a", True),
    '{"quotation_id":"e","result_quotation":{}}': ("e", True),
    '{"quotation_id":"d","quotation_id":"f","result_quotation":{"customer":"text"}}': ("f", True),
    '{"quotation_id":1,"result_quotation":{}}': (None, False),
    '{"quotation_id":"","result_quotation":{}}': ("", False),
    '{"quotation_id":"b","result_quotation":"{}"}': ("b", False),
    '{"quotation_id":"b","result_quotation":[1]}': ("b", False),
    '{"quotation_id":"b","result_quotation":null}': ("b", False),
    '{"quotation_id":"b"}': ("b", False),
    '{"quotation_id":{"a":1},"result_quotation":{}}': (None, False),
    '{"quotation_id":"c","result_quotation":{}} tail': (None, False),
    '{"quotation_id":"c","result_quotation":{}': (None, False),
    "[1]": (None, False),
    "null": (None, False),
    "": (None, False),
}


def test_payload_gate_keeps_every_line(spark):
    frame = spark.createDataFrame([(line,) for line in GATE], "payload STRING")
    got = {r["payload"]: (r["quotation_id"], r["accepted"]) for r in quotations.payload_gate(frame).collect()}
    assert got == GATE
    scanned = quotations.quotation_scan(frame)
    assert rows(scanned, "quotation_id") == [("a",), ("e",), ("f",)]
    assert rows(scanned.where("quotation_id = 'f'"), "doc") == [('{"customer":"text"}',)]


@pytest.mark.parametrize("small, limit", [(True, 1), (False, 1), (False, 100), (None, 100)])
def test_lookup(spark, small, limit):
    asked = [(1, "a"), (2, "a"), (3, "b"), (4, "z"), (5, None)] + [(i, "y") for i in range(6, 9)]
    requests = spark.createDataFrame(asked, "seq INT, quotation_id STRING")
    landed = spark.createDataFrame([("a", None, "A"), ("b", 503, "B"), ("c", 200, "C")], "quotation_id STRING, status INT, doc STRING")
    got = rows(lookup.quotation_lookup(requests, landed, small, limit), "seq", "http_status", "doc")
    missing = [(i, 404, None) for i in range(4, 9)]
    assert got == [(1, 200, "A"), (2, 200, "A"), (3, 503, None), *missing]
    misses = lookup.lookup_misses(requests, landed, small, limit)
    assert rows(misses, "seq") == [(i,) for i in range(4, 9)]


def test_salted_join_is_the_join(spark):
    many = spark.range(500).select(F.when(F.col("id") < 200, 7).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 9).alias("v"))
    few = spark.range(60).select((F.col("id") % 30).alias("k"), F.col("id").alias("w"))
    expected = rows(many.join(few, "k"))
    for limit in (5, 100, 1000):
        assert rows(joins.salted_join(many, few, "k", limit)) == expected
        ids = few.select("k").distinct()
        assert rows(joins.salted_join(many, ids, "k", limit, "left_anti")) == rows(many.join(few, "k", "left_anti"))
        left = many.unionByName(spark.createDataFrame([(None, 1), (None, 1), (777, 2)], "k BIGINT, v BIGINT"))
        left = left.unionByName(spark.range(20).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("v")))
        for how in ("left", "left_anti", "inner"):
            counts = joins.key_counts(left, "k")
            assert rows(joins.salted_join(left, few, "k", limit, how, counts)) == rows(left.join(few, "k", how))


def test_equal_rows_of_a_hot_key_spread_by_their_number(spark):
    rows_ = spark.range(4000).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    rows_ = rows_.unionByName(spark.range(90).select(F.lit("b").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m")))
    counts = joins.key_counts(rows_, "k")
    hot = joins.hot_parts(counts, "k", 100)
    assert rows(hot) == [("hot", 40)]
    spread = joins.spread_hot(rows_, hot, "k")
    parts_ = spread.where("k = 'hot'").groupBy("_part").count().collect()
    assert len(parts_) == 40 and max(r["count"] for r in parts_) <= 130
    assert spread.where("k = 'b' AND _part = 0").count() == 90
    assert joins.hot_parts(counts, "k", 4000) is None


@pytest.mark.parametrize("limit", [3, 1000])
def test_long_request_lists_are_read_twice(spark, monkeypatch, limit):
    """Counted once and joined once, with hot ids and without; the written copy is another folder."""
    path = f"{tempfile.mkdtemp()}/r"  # short, as plans cut long paths
    spark.range(60).selectExpr("id AS seq", "IF(id < 20, 'hot', CAST(id AS STRING)) AS quotation_id").write.parquet(path)
    landed = spark.createDataFrame([("hot", 200, "A"), ("30", 503, "B")], "quotation_id STRING, status INT, doc STRING")
    for job in (lookup.quotation_lookup, lookup.lookup_misses):
        read = []
        plain = joins.written
        monkeypatch.setattr(joins, "written", lambda df, label: read.append(scans(df, path)) or plain(df, label))
        read.append(scans(job(spark.read.parquet(path), landed, False, limit), path))
        assert sum(read) == 2 and len(read) == (3 if limit == 3 else 2)
        monkeypatch.setattr(joins, "written", plain)


def scans(frame, path):
    """How often the plan reads a folder."""
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    return len([line for line in plan.splitlines() if "FileScan" in line and path in line])


def test_size_check(spark):
    frame = spark.range(100).select(F.repeat(F.lit("x"), 100).alias("t"))
    assert sizes.is_small(frame)
    assert not sizes.is_small(frame, max_rows=99)
    assert not sizes.is_small(frame, max_bytes=5000)
    assert sizes.is_small(frame.limit(0))


def test_rule_paths():
    kind = extract.document_type([Rule("Contract_id", "$.a.b"), Rule("Quotation_id", "$.a.c[1].d"), Rule("Implement_payment_terms", "$.t", "payment_terms")])
    assert kind == f"STRUCT<`a`: STRUCT<`b`: STRING, `c`: ARRAY<STRUCT<`d`: STRING>>>, `t`: {extract.TERMS}>"
    for clash in (["$.a", "$.a.b"], ["$.a.b", "$.a"], ["$.a[0]", "$.a"], ["$.a", "$.a[0]"], ["$.a[0].b", "$.a.c"]):
        with pytest.raises(ValueError):
            extract.document_type([Rule("Contract_id", path) for path in clash])
    for path in ("a.b", "$", "$..a", "$.a[x]"):
        with pytest.raises(ValueError):
            Rule("Contract_id", path).steps()
    with pytest.raises(ValueError):
        extract.rule_extract(F.lit(None), [Rule("Nothing", "$.a")])


def test_rule_extract_never_guesses(spark):
    rules = [
        Rule("Contract_id", "$.no"),
        Rule("License_fee", "$.fee", "baht_amount"),
        Rule("Contract_date", "$.date", "thai_date"),
        Rule("Customer_company_name", "$.customer.name"),
        Rule("Customer_address", "$.places[1]"),
    ]
    docs = [
        {"no": "N1", "fee": 1000, "date": "2024-01-01", "customer": {"name": "C"}, "places": ["x", "y"]},
        {"no": 7, "fee": "much", "date": None, "customer": "C", "places": ["x"]},
        {},
    ]
    frame = spark.createDataFrame([(json.dumps(d),) for d in docs], "doc STRING")
    from inkfold.functions.documents import with_json

    parsed = with_json(frame, "d", "doc", extract.document_type(rules))
    got = parsed.select(extract.rule_extract(F.col("d"), rules).alias("r")).select("r.*").collect()
    assert got[0].asDict().keys() == dict.fromkeys(CONTRACT_FIELDS).keys()
    pick = [[row[f] for f in ("Contract_id", "License_fee", "Contract_date", "Customer_company_name", "Customer_address", "License_fee_year")] for row in got]
    assert pick == [
        ["N1", "1,000.00 บาท", "1 มกราคม 2567", "C", "y", SENTINEL],
        ["7", "much", SENTINEL, SENTINEL, SENTINEL, SENTINEL],
        [SENTINEL] * 6,
    ]


def test_parse_extraction(spark):
    replies = [
        '{"Contract_id":"a","Manday_price":5,"Customer_email":null,"Contract_date":true,"Extra":1}',
        "[1]",
        "{bad",
        '{"Contract_id":["a, ","b"],"Quotation_id":{"k":"v","l":" "},"Manday_price":[1,"x"],"Customer_email":{"k":{"l":"v"}}}',
    ]
    frame = spark.createDataFrame([(r,) for r in replies], "reply STRING")
    got = records.parse_extraction(frame).collect()
    assert [r["parsed"] for r in got] == [True, False, False, True]
    nested_ = got[3]["marked"]
    assert (nested_["Contract_id"], nested_["Quotation_id"]) == (f'["{M}a{M}","{M}b{M}"]', f'{{"k":"{M}v{M}","l":" "}}')
    assert (nested_["Manday_price"], nested_["Customer_email"]) == (f'[1,"{M}x{M}"]', f'{{"k":{{"l":"{M}v{M}"}}}}')
    record, marked = got[0]["record"], got[0]["marked"]
    assert (record["Contract_id"], record["Manday_price"], record["Customer_email"]) == ("a", "5", None)
    assert (marked["Contract_id"], marked["Manday_price"]) == (f"{M}a{M}", "5")
    assert (marked["Customer_email"], marked["Contract_date"], marked["Customer_tax_id"]) == ("None", "True", None)
    assert got[1]["record"] is None and got[2]["marked"] is None


def test_schema_conformance(spark):
    full = json.dumps({f: "x" for f in CONTRACT_FIELDS})
    broken = ['{"a":1}}', '{"a":1} x', '{"a":1}] x']
    frame = spark.createDataFrame([('{"a":1,"z":2}',), ('{"b":1,"a":2}',), (full,), *[(b,) for b in broken]], "reply STRING")
    got = records.schema_conformance(frame, ["a", "b"]).collect()
    assert [(r["missing"], r["extra"]) for r in got[:2]] == [(["b"], ["z"]), ([], [])]
    assert [(r["missing"], r["extra"]) for r in got[3:]] == [(None, None)] * 3
    row = records.schema_conformance(frame).collect()[2]
    assert row["missing"] == [] and row["extra"] == []


def test_batch_extract_may_fail_a_document(spark):
    docs = spark.createDataFrame([("a", '{"n":1}'), ("b", "x"), ("c", '{"n":3}')], "quotation_id STRING, doc STRING")

    def read(batch):
        for text in batch:
            yield json.dumps({"Contract_id": json.loads(text)["n"]}) if text[0] == "{" else None

    for partitions in (None, 3):
        got = records.parse_extraction(extract.batch_extract(docs, read, partitions))
        assert rows(got, "quotation_id", "parsed") == [("a", True), ("b", False), ("c", True)]


def test_batch_extract_tries_a_failing_batch_again(spark):
    docs = spark.createDataFrame([(i, t) for i, t in zip("abc", ["1", "x", "3"])], "quotation_id STRING, doc STRING")

    def read(batch):
        return [json.dumps({"Contract_id": int(text)}) for text in batch]

    got = extract.batch_extract(docs.coalesce(1), read).collect()
    assert [(r["quotation_id"], r["reply"] is None) for r in got] == [("a", False), ("b", True), ("c", False)]
    assert [r["error"] is None for r in got] == [True, False, True] and "ValueError" in got[1]["error"]
    short = extract.batch_extract(docs.coalesce(1), lambda batch: ["{}"] if len(batch) == 1 else [])
    assert [r["reply"] for r in short.collect()] == ["{}"] * 3
    with pytest.raises(extract.ExtractorFailed, match="all of 3 documents failed: ValueError: no luck"):
        extract.batch_extract(docs, lambda batch: (_ for _ in ()).throw(ValueError("no luck")))
    # Nothing to read is no failure, and a bad document that is alone in its task is a row.
    assert extract.batch_extract(docs.limit(0), read).collect() == []
    for partitions in (1, 3, 50):
        got = extract.batch_extract(docs.repartition(50, "quotation_id"), read, partitions)
        assert rows(got.select("quotation_id", F.col("error").isNull().alias("ok"))) == [("a", True), ("b", False), ("c", True)]


def test_an_extractor_runs_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def read(batch):
        for text in batch:
            with open(calls, "a") as file:
                file.write(text)
            yield "{}"

    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "quotation_id STRING, doc STRING").coalesce(1)
    got = extract.batch_extract(docs, read)
    assert got.count() == got.where("reply = '{}'").count() == 2
    with open(calls) as file:
        assert file.read() == "12"


SEGMENTS = {
    f"p {M}b{M} q{M}c{M}": [(0, "p ", False), (1, "b", True), (2, " q", False), (3, "c", True)],
    f"X{M}{M}Y": [(0, "X", False), (2, "Y", False)],
    f"{M}tail": [(1, "tail", True)],
    f"{M}{M}{M}z": [(3, "z", True)],
    "none": [(0, "none", False)],
    "": [],
}


def test_segment_runs(spark):
    runs = [(i, text, "double", None) for i, text in enumerate(SEGMENTS)]
    frame = spark.createDataFrame(runs, "run_seq INT, text STRING, underline STRING, color STRING")
    got = segments.segment_runs(frame).collect()
    for i, expected in enumerate(SEGMENTS.values()):
        mine = [r for r in got if r["run_seq"] == i]
        assert [(r["seg_seq"], r["text"], r["is_filled"]) for r in mine] == expected
        for r in mine:
            style = ("single", "FF0000") if r["is_filled"] else (None, None)
            assert (r["underline"], r["color"]) == (("double", None) if i == 4 else style)
            assert r["preserve_space"] == (r["text"] != r["text"].strip())


def piece_table(spark, n=400):
    """Runs of which one holds a third of all pieces, some of them copies."""
    pick = random.Random(3)
    pieces, sizes_ = [], {"hot": n // 3}
    for k in range(n // 10):
        sizes_[f"r{k}"] = pick.randint(1, 9)
    for run, size in sizes_.items():
        for seq in range(size):
            text = pick.choice(["a", "", None, M, f"{M}b{M}", f"c{M}", " d "])
            pieces.append((run, "body", 0, 0, seq // 2 * 2, text))
    pick.shuffle(pieces)
    return spark.createDataFrame(pieces, "doc_id STRING, part STRING, section INT, run_seq INT, piece_seq INT, text STRING")


RUN = ["doc_id", "part", "section", "run_seq"]


def test_long_runs_are_the_same_in_chunks(spark):
    pieces = piece_table(spark)
    whole = {r["doc_id"]: r for r in segments.run_text_concat(pieces, RUN).collect()}
    chunked = segments.run_text_concat(pieces, RUN, limit=7)
    chunks = {}
    for r in sorted(chunked.collect(), key=lambda r: r["chunk_seq"]):
        chunks.setdefault(r["doc_id"], []).append(r)
    assert len(chunks["hot"]) == -(-133 // 7)
    for run, parts_ in chunks.items():
        assert "".join(p["text"] for p in parts_) == whole[run]["text"]
        assert [p["chunk_seq"] for p in parts_] == list(range(len(parts_)))
        before = 0
        for p in parts_:
            assert p["markers_before"] == before and p["markers"] == whole[run]["markers"]
            before += p["text"].count(M)

    columns = [*RUN, "seg_seq", "text", "is_filled", "underline", "color", "preserve_space"]
    expected = segments.segment_runs(segments.run_text_concat(pieces, RUN))
    places = segments.segment_order(expected, ["doc_id"])
    for limit in (2, 7, 2000):
        laid_out = segments.run_text_concat(pieces, RUN, limit=limit)
        got = segments.segment_runs(laid_out)
        assert rows(got, *columns) == rows(expected, *columns)
        placed = segments.segment_order(got, ["doc_id"], limit=limit)
        assert rows(placed, *columns, "position") == rows(places, *columns, "position")


def test_a_segment_across_a_cut_is_one_segment(spark):
    texts = [f"x {M}ab", "c", f" d{M} e", "f"]
    pieces = [("d", "body", 0, 0, i, text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(pieces, "doc_id STRING, part STRING, section INT, run_seq INT, piece_seq INT, text STRING")
    for limit in (1, 2, 3, 2000):
        found = segments.segment_runs(segments.run_text_concat(frame, RUN, limit=limit))
        got = sorted((r["seg_seq"], r["text"], r["is_filled"], r["preserve_space"]) for r in found.collect())
        assert got == [(0, "x ", False, True), (1, "abc d", True, False), (2, " ef", False, True)]


def test_joined_segments_are_the_text_without_markers(spark):
    runs = segments.run_text_concat(piece_table(spark), RUN)
    texts = {r["doc_id"]: r["text"].replace(M, "") for r in runs.collect()}
    got = dict.fromkeys(texts, "")
    for r in sorted(segments.segment_runs(runs).collect(), key=lambda r: r["seg_seq"]):
        got[r["doc_id"]] += r["text"]
    assert got == texts


def test_dense_position_of_heavy_groups(spark):
    table = [("hot", i // 3) for i in range(300)] + [(None, 5), (None, 4), ("b", 1)] + [("c", 0)] * 40
    frame = spark.createDataFrame(table, "k STRING, v INT").repartition(5)
    got = ordered.dense_position(frame, ["k"], [F.col("v")], limit=20).collect()
    assert len(got) == len(table)
    for key in ("hot", None, "b", "c"):
        mine = sorted((r for r in got if r["k"] == key), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
        assert [r["v"] for r in mine] == sorted(r["v"] for r in mine)


def test_heavy_groups_that_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(ordered.heavy_keys, "__defaults__", (0.2,))
    key = F.when(F.col("id") < 30, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 6).cast("string")))
    frame = spark.range(90).select(key.alias("k"), F.col("id").alias("v"))
    frame = frame.unionByName(spark.createDataFrame([("small", 1)], "k STRING, v BIGINT"))
    hot, others = ordered.heavy_keys(frame, ["k"], 3)
    assert rows(hot) == [("hot",)] and len(rows(others)) == 6
    got = ordered.dense_position(frame, ["k"], [F.col("v")], limit=3)
    groups = {}
    for row in got.collect():
        groups.setdefault(row["k"], []).append((row["position"], row["v"]))
    assert sum(map(len, groups.values())) == 91
    for pairs in groups.values():
        values = [v for _, v in sorted(pairs)]
        assert values == sorted(values) and [p for p, _ in sorted(pairs)] == list(range(1, len(pairs) + 1))
    assert ordered.heavy_keys(frame, ["k"], 1000) == (None, None)


def test_spread_is_over_many_tasks(spark):
    frame = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    got = ordered.spread_positions(frame, ["k"], [F.col("v")])
    assert sorted(r["_position"] for r in got.collect()) == list(range(1, 4001))
    sliced = frame.withColumn("c", F.monotonically_increasing_id()).repartitionByRange("k", "v", "c")
    assert sliced.select(F.spark_partition_id()).distinct().count() >= 1


def test_segments_are_written_only_for_long_documents(spark, monkeypatch):
    pieces = piece_table(spark)
    made = segments.segment_runs(segments.run_text_concat(pieces, RUN))
    expected = rows(segments.segment_order(made, ["doc_id"]))
    labels, plain = [], ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, label: labels.append(label) or plain(df, label))
    assert rows(segments.segment_order(made, ["doc_id"], 1000, pieces)) == expected and labels == []
    assert rows(segments.segment_order(made, ["doc_id"], 20, pieces)) == expected and labels.count("rows") == 1


def test_segment_order(spark):
    runs = [("d", "footer", 0, 0), ("d", "body", 0, 1), ("d", "header", 1, 0), ("d", "body", 0, 0), ("d", "header", 0, 0), ("e", "even_page_header", 0, 0)]
    frame = spark.createDataFrame([(*r, f"x{M}y{M}") for r in runs], "doc_id STRING, part STRING, section INT, run_seq INT, text STRING")
    for limit in (1000, 3):
        placed = segments.segment_order(segments.segment_runs(frame), ["doc_id"], limit=limit)
        got = [(r["part"], r["section"], r["run_seq"], r["seg_seq"]) for r in sorted(placed.where("doc_id = 'd'").collect(), key=lambda r: r["position"])]
        order = [("body", 0, 0), ("body", 0, 1), ("header", 0, 0), ("footer", 0, 0), ("header", 1, 0)]
        assert got == [(*o, s) for o in order for s in (0, 1)]


def test_line_items_round_trip(spark):
    items = [("hot", i % 5, f"s{i % 7}", f"{i % 3}.00") for i in range(60)] + [("b", 1, "s", "1.00")]
    frame = spark.createDataFrame(items, "doc STRING, line INT, specification STRING, total_amount STRING")
    for limit in (1000, 8):
        nested_ = line_items.line_items_nest(frame, ["doc"], ["line"], limit=limit)
        assert nested_.where("doc = 'hot'").count() == (1 if limit == 1000 else 8)
        back = line_items.line_items_explode(nested_).collect()
        hot = [(r["chunk_seq"] * limit + r["item_seq"], r["specification"], r["total_amount"]) for r in back if r["doc"] == "hot"]
        expected = sorted(i[1:] for i in items if i[0] == "hot")
        assert sorted(hot) == [(n, s, a) for n, (_, s, a) in enumerate(expected)]
    empty = spark.createDataFrame([("x", [])], "doc STRING, table_data ARRAY<STRUCT<specification: STRING, total_amount: STRING>>")
    assert rows(line_items.line_items_explode(empty)) == [("x", None, None, None)]


TEMPLATE = [
    templates.Run("body", 0, 0, "{{Contract_id}}{{ Contract_id }} of {{ Customer_company_name }}, {{ Unknown }}."),
    templates.Run("body", 0, 1, "nothing here {{ 9bad }} {single}"),
    templates.Run("footer", 1, 0, "{{ Customer_email }}"),
]


def merge_input(spark):
    fields = {f: None for f in CONTRACT_FIELDS}
    values = [{"Contract_id": "7", "Customer_company_name": "{{ Contract_id }}"}, {"Contract_id": "$1\\", "Customer_email": SENTINEL}]
    data = [(i, "t", {**fields, **v}) for i, v in enumerate(values)]
    kind = "STRUCT<" + ", ".join(f"{f}: STRING" for f in CONTRACT_FIELDS) + ">"
    return spark.createDataFrame(data, f"doc INT, template_id STRING, marked {kind}")


def test_both_template_forms_agree(spark):
    documents = merge_input(spark)
    table = spark.createDataFrame([("t", r.part, r.section, r.run_seq, r.text, r.underline, r.color) for r in TEMPLATE], templates.TEMPLATE_SCHEMA)
    columns = ["doc", "part", "section", "run_seq", "text", "underline", "color"]
    known = rows(merge.template_merge(documents.drop("template_id"), TEMPLATE), *columns)
    assert [r[4] for r in known] == [
        "77 of {{ Contract_id }}, .", "nothing here {{ 9bad }} {single}", "",
        "$1\\$1\\ of , .", "nothing here {{ 9bad }} {single}", SENTINEL,
    ]
    for small, limit in ((True, 1), (False, 1), (False, 100), (None, 1)):
        got = merge.template_merge_data(documents, table, small, limit)
        assert rows(got, *columns) == known
    lost = documents.withColumn("template_id", F.when(F.col("doc") == 0, "nobody's"))
    for small in (True, False):
        got = merge.template_merge_data(lost, table, small)
        assert [(r["doc"], r["part"], r["text"]) for r in got.orderBy("doc").collect()] == [(0, None, None), (1, None, None)]
        assert [r["template_found"] for r in got.collect()] == [False, False]


def test_a_run_without_text_is_passed_over(spark):
    documents, template = merge_input(spark), [*TEMPLATE, templates.Run("header", 0, 0, None)]
    table = spark.createDataFrame([("t", r.part, r.section, r.run_seq, r.text, r.underline, r.color) for r in template], templates.TEMPLATE_SCHEMA)
    known = merge.template_merge(documents.drop("template_id"), template)
    columns = ["doc", "part", "section", "run_seq", "text", "underline", "color"]
    by_data = merge.template_merge_data(documents, table, True)
    assert rows(by_data, *columns) == rows(known, *columns) and by_data.where("NOT template_found").count() == 0
    pieces = [rows(segments.segment_runs(f.select(*columns)), "doc", "part", "run_seq", "seg_seq", "text") for f in (known, by_data)]
    assert pieces[0] == pieces[1] and {p[1] for p in pieces[0]} == {"body", "footer"}


def test_parts_union(spark):
    frame = spark.createDataFrame([(1, "t")], "doc_id INT, text STRING")
    got = parts.parts_union({"footer": frame, "body": frame, "header": None})
    assert rows(got, "part") == [("body",), ("footer",)]
    with pytest.raises(ValueError):
        parts.parts_union({"margin": frame})


def test_key_values(spark):
    row = ("q", {f: SENTINEL for f in CONTRACT_FIELDS} | {"Contract_id": "1", "Quotation_id": None})
    kind = "STRUCT<" + ", ".join(f"{f}: STRING" for f in CONTRACT_FIELDS) + ">"
    frame = spark.createDataFrame([row], f"quotation_id STRING, record {kind}")
    got = records.contract_key_values(frame, ["quotation_id"]).collect()
    assert [r["field"] for r in got] == CONTRACT_FIELDS
    assert {r["field"] for r in got if not r["is_not_found"]} == {"Contract_id", "Quotation_id"}
