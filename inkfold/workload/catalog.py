"""The registered queries: one per operator, each over the whole of the tables it reads."""

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.constants import CONTRACT_FIELDS, SENTINEL
from inkfold.functions import fallbacks, files, formats, nested, text
from inkfold.operators import (
    extract,
    line_items,
    lookup,
    merge,
    outcomes,
    records,
    segments,
)
from inkfold.plans import contracts
from inkfold.session import scratch_path
from inkfold.sources import parts, quotations, results, templates
from inkfold.streaming import jobs
from inkfold.workload import tables as t
from inkfold.workload.tables import RULES, TEMPLATE, table

LISTED_FIELDS = [rule.field for rule in RULES]
# The layouts that the queries ask for; the SQL states them on its own.
ITEMS_PER_ROW, PIECES_PER_ROW = 500, 800
RUN_KEYS = ["doc_id", "part", "section", "run_seq"]


def _orders(spark: SparkSession, d: str, *columns) -> DataFrame:
    return t.spread_table(spark, d, "orders").select("o_orderkey", *columns)


def _doc_id() -> Column:
    """The id under a name that no contract field has, as fields stand beside it here."""
    return F.col("quotation_id").alias("doc_id")


def _join(array, separator="|") -> Column:
    return F.array_join(array, separator)


# Scans, sources, sinks


def quotation_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "landing")
    t.quotation_payloads(spark, d).write.text(path)
    scanned = quotations.quotation_scan(quotations.scan_payloads(spark, path))
    return scanned.select(
        "quotation_id",
        *[
            F.get_json_object("doc", path).alias(name)
            for name, path in {
                "docno": "$.docno",
                "day": "$.date",
                "period_start": "$.period.start",
                "customer": "$.customer.name",
                "segment": "$.customer.segment",
                "priority": "$.priority",
                "last_note": "$.terms[2].note",
            }.items()
        ],
        F.json_array_length(F.get_json_object("doc", "$.modules")).alias("n_modules"),
    )


def quotation_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = lookup.quotation_lookup(t.quotation_requests(spark, d), t.landed_quotations(spark, d))
    name = F.get_json_object("doc", "$.name").alias("customer")
    return found.select("request_seq", "quotation_id", "http_status", name)


def lookup_misses(spark: SparkSession, d: str) -> DataFrame:
    return lookup.lookup_misses(t.quotation_requests(spark, d), t.landed_quotations(spark, d))


def payload_gate(spark: SparkSession, d: str) -> DataFrame:
    return quotations.payload_gate(t.mixed_payloads(spark, d)).drop("payload")


def template_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "templates")
    t.page_templates(spark, d).write.parquet(path)
    scanned = templates.tokenize_templates(templates.scan_templates(spark, path))
    return scanned.select(
        "template_id",
        "run_seq",
        _join("literals").alias("literals"),
        _join("fields").alias("fields"),
    )


def parts_union(spark: SparkSession, d: str) -> DataFrame:
    def runs(name: str, key: str, value: str, seq: Column) -> DataFrame:
        return table(spark, d, name).select(
            F.col(key).cast("bigint").alias("doc_id"),
            F.lit(0).alias("section"),
            seq.cast("int").alias("run_seq"),
            F.col(value).alias("text"),
        )

    first = F.lit(0)
    return parts.parts_union(
        {
            "body": runs("documents", "doc_id", "text", first),
            "header": runs("pages", "page_id", "url", first),
            "first_page_header": runs("customer", "c_custkey", "c_name", first),
            "even_page_header": runs("supplier", "s_suppkey", "s_name", first),
            "footer": runs("conversations", "conv_id", "text", F.col("turn")),
            "first_page_footer": runs("part", "p_partkey", "p_name", first),
            "even_page_footer": None,
        }
    )


def _both_routes(frame: DataFrame) -> DataFrame:
    """Accepted and rejected results alike, with what the rejected line ends on."""
    ending = F.right("rejected", F.lit(len(t.BROKEN_ENDING))).alias("rejected_ending")
    return frame.select(
        _doc_id(), "accepted", "http_status", "file_name", "file_base64", ending, "contract_data.*"
    )


def result_sink(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "results")
    made = contracts.contract_results(t.broken_payloads(spark, d), RULES, TEMPLATE)
    results.write_results(made, path)
    return _both_routes(results.read_results(spark, path))


# Projections, filters, predicates


def contract_projection(spark: SparkSession, d: str) -> DataFrame:
    extracted = contracts.extract_records(t.quotation_payloads(spark, d), RULES)
    return records.contract_projection(extracted.select("payload", "record.*"))


def parse_extraction(spark: SparkSession, d: str) -> DataFrame:
    parsed = records.parse_extraction(t.order_replies(spark, d))
    return parsed.select(
        "o_orderkey",
        "parsed",
        *[F.col(f"record.{name}").alias(f"raw_{name}") for name in CONTRACT_FIELDS],
        *[F.col(f"marked.{name}").alias(f"marked_{name}") for name in CONTRACT_FIELDS],
    )


def schema_conformance(spark: SparkSession, d: str) -> DataFrame:
    checked = records.schema_conformance(t.order_replies(spark, d))
    return checked.select(
        "o_orderkey", _join("missing").alias("missing"), _join("extra").alias("extra")
    )


def not_found_fill(spark: SparkSession, d: str) -> DataFrame:
    details = formats.module_details(F.col("modules"))
    return t.orders_with_modules(spark, d).select(
        "o_orderkey", text.not_found_fill(details).alias("details")
    )


def blank_or_sentinel(spark: SparkSession, d: str) -> DataFrame:
    return t.document_lines(spark, d).select(
        "doc_id", "line_no", text.blank_or_sentinel(F.col("value")).alias("unmarked")
    )


def marked_run_filter(spark: SparkSession, d: str) -> DataFrame:
    return segments.marked_run_filter(t.conversation_pieces(spark, d)).select(
        "doc_id", "part", "run_seq", "piece_seq"
    )


def nonempty_segments(spark: SparkSession, d: str) -> DataFrame:
    pieces = segments.split_segments(t.marked_orders(spark, d))
    return segments.nonempty_segments(pieces).select("o_orderkey", "seg_seq", "text")


# Extraction


def payload_to_json(spark: SparkSession, d: str) -> DataFrame:
    document = F.struct(
        t.order_id().alias("docno"),
        F.col("o_custkey").alias("custkey"),
        F.struct(F.col("c_name").alias("name"), F.lit(None).cast("string").alias("tax_id")).alias(
            "customer"
        ),
        formats.thai_date(F.col("o_orderdate")).alias("date"),
    )
    return t.orders_with_customer(spark, d).select(
        "o_orderkey", records.payload_to_json(document).alias("json")
    )


def rule_extract(spark: SparkSession, d: str) -> DataFrame:
    extracted = contracts.extract_records(t.quotation_payloads(spark, d), RULES)
    return extracted.select(_doc_id(), *[F.col(f"record.{name}") for name in LISTED_FIELDS])


def batch_extract(spark: SparkSession, d: str) -> DataFrame:
    def read_documents(docs):
        """A deterministic extractor in the place of a remote model."""
        for doc in docs:
            found = json.loads(doc)
            customer = found.get("customer", {})
            reply = {
                "Contract_id": found.get("docno", SENTINEL),
                "Customer_company_name": customer.get("name", SENTINEL),
                "Customer_tax_id": customer.get("tax_id", SENTINEL),
            }
            yield json.dumps(reply, ensure_ascii=False)

    documents = quotations.quotation_scan(t.quotation_payloads(spark, d))
    parsed = records.parse_extraction(extract.batch_extract(documents, read_documents))
    return parsed.select(
        "quotation_id", "record.Contract_id", "record.Customer_company_name", "record.Customer_tax_id"
    )


def _nested_items(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select("p_partkey", "p_name")
    lines = t.spread_table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"
    )
    items = lines.join(names, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey",
        "l_linenumber",
        F.col("p_name").alias("specification"),
        formats.grouped_amount(F.col("l_extendedprice")).alias("total_amount"),
    )
    return line_items.line_items_nest(
        items, ["l_orderkey"], ["l_linenumber"], limit=ITEMS_PER_ROW, counted=lines
    )


def line_items_nest(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform(
        "table_data",
        lambda item: F.concat_ws("=", item.getField("specification"), item.getField("total_amount")),
    )
    return _nested_items(spark, d).select(
        "l_orderkey", "chunk_seq", F.size("table_data").alias("n_items"), _join(shown).alias("items")
    )


def line_items_explode(spark: SparkSession, d: str) -> DataFrame:
    return line_items.line_items_explode(_nested_items(spark, d))


# Scalar functions


def wrap_value(spark: SparkSession, d: str) -> DataFrame:
    return t.spread_table(spark, d, "documents").select(
        "doc_id", text.wrap_value(F.col("text")).alias("marked")
    )


def wrap_nested(spark: SparkSession, d: str) -> DataFrame:
    tags = F.array("o_orderpriority", F.lit(SENTINEL), F.lit(" \t"), t.dirty_name())
    frame = t.orders_with_customer(spark, d).select(
        "o_orderkey",
        F.struct(
            F.col("c_name").alias("name"),
            tags.alias("tags"),
            F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("notes"),
            F.col("o_custkey").alias("number"),
        ).alias("data"),
    )
    marked = nested.wrap_nested(F.col("data"), frame.schema["data"].dataType)
    wrapped = frame.withColumn("data", marked)
    return wrapped.select(
        "o_orderkey",
        "data.name",
        _join("data.tags").alias("tags"),
        F.element_at("data.notes", "segment").alias("segment"),
        "data.number",
    )


def split_marker(spark: SparkSession, d: str) -> DataFrame:
    pieces = text.split_marker(F.col("text"))
    return t.marked_orders(spark, d).select(
        "o_orderkey", F.size(pieces).alias("n_pieces"), _join(pieces).alias("pieces")
    )


def filled_flag(spark: SparkSession, d: str) -> DataFrame:
    pieces = t.marked_orders(spark, d).select(
        "o_orderkey", F.posexplode(text.split_marker(F.col("text"))).alias("seg_seq", "text")
    )
    return pieces.withColumn("is_filled", text.filled_flag(F.col("seg_seq")))


def preserve_space(spark: SparkSession, d: str) -> DataFrame:
    return t.document_lines(spark, d).select(
        "doc_id", "line_no", text.preserve_space(F.col("value")).alias("preserve_space")
    )


def segment_style(spark: SparkSession, d: str) -> DataFrame:
    runs = t.orders_with_customer(spark, d).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("c_name")).otherwise(t.marked_line()).alias("text"),
        F.lit("double").alias("underline"),
        F.lit(None).cast("string").alias("color"),
    )
    styled = segments.segment_style(segments.split_segments(runs))
    return styled.select("o_orderkey", "seg_seq", "is_filled", "underline", "color")


def result_name(spark: SparkSession, d: str) -> DataFrame:
    named = _orders(spark, d, "o_orderstatus").select(
        "o_orderkey",
        t.order_id().alias("quotation_id"),
        F.when(F.col("o_orderstatus") != "P", files.result_name(t.order_id())).alias("file_name"),
    )
    shown = files.shown_name(F.col("file_name"), F.col("quotation_id"))
    return named.withColumn("shown_name", shown)


def base64_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    encoded = t.spread_table(spark, d, "documents").select(
        "doc_id", files.encode_base64(F.encode("text", "UTF-8")).alias("file_base64")
    )
    decoded = F.decode(files.decode_base64(F.col("file_base64")), "UTF-8")
    return encoded.withColumn("decoded", decoded)


def error_detail(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return t.response_bodies(spark, d).select(
        "event_id",
        fallbacks.login_error(body).alias("login_error"),
        fallbacks.quotation_error(body).alias("quotation_error"),
        fallbacks.upstream_detail(body).alias("upstream_detail"),
    )


def display_name(spark: SparkSession, d: str) -> DataFrame:
    return t.response_bodies(spark, d).select(
        "event_id", fallbacks.display_name(F.col("body")).alias("display_name")
    )


def success_flag(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return t.response_bodies(spark, d).select(
        "event_id",
        fallbacks.success_flag(body).alias("success"),
        fallbacks.login_accepted(body).alias("login_accepted"),
    )


def record_id(spark: SparkSession, d: str) -> DataFrame:
    key = files.record_id(t.order_id(), F.col("o_custkey"))
    return _orders(spark, d, key.alias("record_id"))


def log_timestamp(spark: SparkSession, d: str) -> DataFrame:
    stamp = formats.log_timestamp(F.col("ts")).alias("logged_at")
    return table(spark, d, "events").select("event_id", stamp)


def thai_date(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, formats.thai_date(F.col("o_orderdate")).alias("thai_date"))


def baht_amount(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, formats.baht_amount(F.col("o_totalprice")).alias("amount"))


def payment_terms(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, formats.payment_terms(t.order_terms()).alias("terms"))


def module_details(spark: SparkSession, d: str) -> DataFrame:
    modules = F.col("modules")
    return t.orders_with_modules(spark, d).select(
        "o_orderkey",
        formats.module_count(modules).alias("n_modules"),
        formats.module_details(modules).alias("details"),
    )


# Rendering, grouping, ordering


def _named_orders(spark: SparkSession, d: str) -> DataFrame:
    """Marked records of orders with the template of the customer's nation."""
    known = {
        "Contract_id": t.order_id(),
        "Customer_company_name": t.dirty_name(),
    }
    record = F.struct(
        *[known.get(name, F.lit(SENTINEL)).alias(name) for name in CONTRACT_FIELDS]
    )
    return t.orders_with_customer(spark, d).select(
        "o_orderkey",
        t.chosen_template().alias("template_id"),
        records.mark_record(record).alias("marked"),
    )


def template_merge(spark: SparkSession, d: str) -> DataFrame:
    documents = _named_orders(spark, d)
    columns = ["form", "o_orderkey", "part", "section", "run_seq", "text", "template_found"]
    by_data = merge.template_merge_data(documents, t.nation_templates(spark, d))
    known = merge.template_merge(documents.drop("template_id"), TEMPLATE)
    return (
        by_data.withColumn("form", F.lit("data"))
        .select(*columns)
        .unionByName(known.withColumns({"form": F.lit("known"), "template_found": F.lit(True)}).select(*columns))
    )


def run_text_concat(spark: SparkSession, d: str) -> DataFrame:
    return segments.run_text_concat(t.conversation_pieces(spark, d), RUN_KEYS, limit=PIECES_PER_ROW)


def _conversation_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_runs(segments.run_text_concat(t.conversation_pieces(spark, d), RUN_KEYS))


def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    return _conversation_segments(spark, d).select(
        *RUN_KEYS, "seg_seq", "text", "is_filled", "underline", "color", "preserve_space"
    )


def segment_order(spark: SparkSession, d: str) -> DataFrame:
    pieces = t.conversation_pieces(spark, d)
    placed = segments.segment_order(_conversation_segments(spark, d), ["doc_id"], runs=pieces)
    return placed.select(*RUN_KEYS, "seg_seq", "position")


def contract_key_values(spark: SparkSession, d: str) -> DataFrame:
    extracted = contracts.extract_records(t.quotation_payloads(spark, d), RULES)
    return records.contract_key_values(extracted.withColumn("doc_id", _doc_id()), ["doc_id"])


def generate_contracts(spark: SparkSession, d: str) -> DataFrame:
    made = contracts.generate_contracts(t.quotation_payloads(spark, d), RULES, TEMPLATE)
    return made.withColumnRenamed("quotation_id", "doc_id")


def contract_outputs(spark: SparkSession, d: str) -> DataFrame:
    made, pieces = contracts.contract_outputs(t.broken_payloads(spark, d), RULES, TEMPLATE)
    columns = ["part", "run_seq", "seg_seq"]
    nothing = [F.lit(None).cast("string" if name == "part" else "int").alias(name) for name in columns]
    ending = F.right("rejected", F.lit(len(t.BROKEN_ENDING)))
    results_ = made.select(_doc_id(), "http_status", *nothing, F.coalesce("file_base64", ending).alias("value"))
    return results_.unionByName(
        pieces.select(_doc_id(), F.lit(None).cast("int").alias("http_status"), *columns, F.col("text").alias("value"))
    )


def reply_results(spark: SparkSession, d: str) -> DataFrame:
    made = contracts.reply_results(t.order_replies(spark, d), TEMPLATE)
    shown = ["Contract_id", "Customer_company_name", "Customer_tax_id", "Standard_users_count"]
    return made.select(
        _doc_id(),
        "accepted",
        "http_status",
        "file_name",
        "file_base64",
        F.sha2("reply", 256).alias("reply_sha256"),
        F.sha2("rejected", 256).alias("rejected_sha256"),
        *[F.col(f"contract_data.{name}").alias(name) for name in shown],
    )


def reply_segments(spark: SparkSession, d: str) -> DataFrame:
    made = contracts.reply_segments(t.order_replies(spark, d), TEMPLATE)
    return made.withColumnRenamed("quotation_id", "doc_id")


def contracts_from_templates(spark: SparkSession, d: str) -> DataFrame:
    made = contracts.contracts_from_templates(
        t.quotation_payloads(spark, d), RULES, t.priority_templates(spark, d), F.col("record.Implement_package_name")
    )
    return made.withColumnRenamed("quotation_id", "doc_id")


# Logs and outcomes


def log_parse(spark: SparkSession, d: str) -> DataFrame:
    parsed = outcomes.log_parse(t.log_lines(spark, d)).drop("line")
    code = outcomes.logged_code(F.col("action"), F.col("outcome"), F.col("http_status"))
    return parsed.withColumn("code", code.cast("int"))


def outcome_class(spark: SparkSession, d: str) -> DataFrame:
    kind, value, user = F.col("event_type"), F.col("value"), F.col("user_id")
    operation = (
        F.when(kind.isin("signup", "view"), "login").when(kind == "purchase", "generate").otherwise("quotation")
    )
    failure = F.when(value < 5, "connection").when(value < 10, "timeout")
    code = outcomes.outcome_class(
        operation,
        F.when(value < 30, 404).otherwise(200),
        failure,
        user >= 10,
        user >= 20,
    )
    return table(spark, d, "events").select(
        "event_id", operation.alias("operation"), code.cast("int").alias("code")
    )


# Streams


def generate_contracts_stream(spark: SparkSession, d: str) -> DataFrame:
    source, sink = scratch_path(spark, "landing"), scratch_path(spark, "contracts")
    t.broken_payloads(spark, d).write.text(source)
    query = jobs.generate_contracts_stream(
        spark, source, sink, scratch_path(spark, "progress"), RULES, TEMPLATE
    )
    query.awaitTermination()
    return _both_routes(results.read_results(spark, sink))


def contract_tables_stream(spark: SparkSession, d: str) -> DataFrame:
    source, sink, kept = (scratch_path(spark, name) for name in ("landing", "contracts", "templates"))
    t.broken_payloads(spark, d).write.text(source)
    t.priority_templates(spark, d).write.parquet(kept)
    query = jobs.contract_tables_stream(
        spark, source, sink, scratch_path(spark, "progress"), RULES,
        lambda session: templates.scan_templates(session, kept), F.col("record.Implement_package_name"),
    )
    query.awaitTermination()
    ending = F.right("rejected", F.lit(len(t.BROKEN_ENDING)))
    shown = {
        "results": ("http_status", F.coalesce("file_base64", ending)),
        "dead_letters": ("http_status", ending),
        "segments": ("seg_seq", F.col("text")),
    }
    tables = [
        jobs.contract_table(spark, sink, name).select(
            F.lit(name).alias("kind"), _doc_id(), "template_id", F.col(number).alias("number"), value.alias("value")
        )
        for name, (number, value) in shown.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def log_parse_stream(spark: SparkSession, d: str) -> DataFrame:
    source, sink = scratch_path(spark, "landing"), scratch_path(spark, "logs")
    t.log_lines(spark, d).select("line").write.text(source)
    query = jobs.log_parse_stream(spark, source, sink, scratch_path(spark, "progress"))
    query.awaitTermination()
    return spark.read.parquet(sink)


QUERIES = {
    query.__name__: query
    for query in [
        quotation_scan,
        quotation_lookup,
        lookup_misses,
        payload_gate,
        template_scan,
        parts_union,
        result_sink,
        contract_projection,
        parse_extraction,
        schema_conformance,
        not_found_fill,
        blank_or_sentinel,
        marked_run_filter,
        nonempty_segments,
        payload_to_json,
        rule_extract,
        batch_extract,
        line_items_nest,
        line_items_explode,
        wrap_value,
        wrap_nested,
        split_marker,
        filled_flag,
        preserve_space,
        segment_style,
        result_name,
        base64_roundtrip,
        error_detail,
        display_name,
        success_flag,
        record_id,
        log_timestamp,
        thai_date,
        baht_amount,
        payment_terms,
        module_details,
        template_merge,
        run_text_concat,
        segment_runs,
        segment_order,
        contract_key_values,
        generate_contracts,
        contract_outputs,
        reply_results,
        reply_segments,
        contracts_from_templates,
        log_parse,
        outcome_class,
        generate_contracts_stream,
        contract_tables_stream,
        log_parse_stream,
    ]
}
