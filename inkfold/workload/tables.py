"""Quotations, replies, document runs and logs made by Spark from the whole test tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.constants import SENTINEL
from inkfold.functions.formats import log_timestamp
from inkfold.functions.text import wrap_value
from inkfold.operators.extract import Rule
from inkfold.operators.outcomes import (
    ACTION_LABELS,
    NOT_REMOVED_LABEL,
    OUTCOME_LABELS,
    REMOVED_LABEL,
    SYSTEM_ERROR_LABEL,
)
from inkfold.operators.records import payload_to_json
from inkfold.sources.templates import Run

ID_PREFIX = "QO"
TERM_NOTES = [(30, "kick off"), (40, "data migration"), (30, "go live")]
TERM_DAYS = 365
#: Orders make more of a task's memory than the Parquet they are read from.
PARTS_PER_SPLIT = 8

RULES = [
    Rule("Contract_id", "$.docno"),
    Rule("Contract_date", "$.date", "thai_date"),
    Rule("Customer_company_name", "$.customer.name"),
    Rule("Customer_tax_id", "$.customer.tax_id"),
    Rule("Customer_address", "$.customer.addresses[0].text"),
    Rule("Standard_module_name", "$.customer.segment"),
    Rule("Contract_start_date", "$.period.start", "thai_date"),
    Rule("Contract_end_date", "$.period.end", "thai_date"),
    Rule("License_fee", "$.total", "baht_amount"),
    Rule("License_fee_month", "$.total", "grouped_amount"),
    Rule("Optional_module_count", "$.modules", "module_count"),
    Rule("Optional_module_details", "$.modules", "module_details"),
    Rule("Implement_package_name", "$.priority"),
    Rule("Implement_price", "$.total", "baht_amount"),
    Rule("Implement_payment_terms", "$.terms", "payment_terms"),
    Rule("Quotation_id", "$.docno"),
    Rule("Quotation_date", "$.date", "thai_date"),
    Rule("Customer_company_signature_name", "$.customer.name"),
]

TEMPLATE = [
    Run("body", 0, 0, "SOFTWARE LICENCE AGREEMENT", underline="double", color="0000FF"),
    Run("body", 0, 1, "Made on {{ Contract_date }} with {{ Customer_company_name }}; tax {{Customer_tax_id}}."),
    Run("body", 0, 2, "Office: {{ Customer_address }}"),
    Run("body", 0, 3, "From {{ Contract_start_date }} to {{ Contract_end_date }}", color="0000FF"),
    Run("body", 0, 4, "{{ Standard_module_name }} licence: {{ License_fee }} ({{ License_fee_month }})"),
    Run("body", 0, 5, "{{ Optional_module_count }} modules: {{ Optional_module_details }}"),
    Run("body", 0, 6, "{{ Implement_package_name }} at {{ Implement_price }}: {{ Implement_payment_terms }}"),
    Run("body", 0, 7, "Signed {{ Customer_company_signature_name }} by {{ Customer_authorized_signature }}"),
    Run("header", 0, 0, "No. {{ Contract_id }}"),
    Run("footer", 0, 0, "Quotation {{ Quotation_id }} of {{ Quotation_date }}"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table on at least as many tasks as there are cores.

    A small file is one split, which would leave all work on its rows to one task. Tables of
    many splits, as large ones are, come back as they are, without a shuffle.
    """
    frame = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def money(value: Column) -> Column:
    return value.cast("decimal(18,2)")


def written_amount(value: Column) -> Column:
    """An amount as people write it: plain, with grouping commas, or with the currency word."""
    plain, priority = money(value).cast("string"), F.col("o_orderpriority")
    grouped = F.format_number(money(value), 2)
    return (
        F.when(priority == "1-URGENT", grouped)
        .when(priority == "2-HIGH", F.concat(plain, F.lit(" บาท")))
        .when(priority == "5-LOW", F.concat(grouped, F.lit("บาท ")))
        .otherwise(plain)
    )


def written_date(day: Column) -> Column:
    """An ISO date; for pending orders one that cannot be told from month first."""
    return F.when(F.col("o_orderstatus") == "P", F.date_format(day, "dd/MM/yyyy")).otherwise(day.cast("string"))


def instalment(total: Column, percent: int) -> Column:
    return money(money(total) * F.lit(percent).cast("decimal(3,0)") * F.expr("0.01BD"))


def order_terms() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(percent).alias("pct"),
                F.lit(note).alias("note"),
                instalment(F.col("o_totalprice"), percent).alias("amount"),
            )
            for percent, note in TERM_NOTES
        ]
    )


def order_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_orderkey, modules)``: the brands of an order with their summed price.

    Prices are summed per order and brand first, so an order's list is no longer than there
    are brands, however many line items it has. One shuffle by order serves both groupings and a
    join by order; hardly two lines of an order meet in a task before it. Its parts grow in number
    with the table, so that the memory of a task does not.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", money(F.col("l_extendedprice")).alias("price")
    )
    parts = PARTS_PER_SPLIT * lines.rdd.getNumPartitions()
    brands = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("name"))
    per_brand = (
        lines.join(brands, F.col("l_partkey") == F.col("p_partkey"), "left")
        .select("l_orderkey", "name", "price")
        .repartition(parts, "l_orderkey")
        .groupBy("l_orderkey", "name")
        .agg(money(F.sum("price")).alias("monthly"))
    )
    return per_brand.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("name", "monthly"))).alias("modules")
    )


def _with_customer(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment"
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")


def orders_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_customer(spark, sf_dir, spread_table(spark, sf_dir, "orders"))


def order_id() -> Column:
    return F.concat(F.lit(ID_PREFIX), F.col("o_orderkey").cast("string"))


def orders_with_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The join by order spreads the orders: they are not dealt out before it.
    orders = _with_customer(spark, sf_dir, table(spark, sf_dir, "orders"))
    modules = order_modules(spark, sf_dir)
    return orders.join(modules, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def order_document() -> Column:
    """The quotation document of an order; no tax id and no address, to be reported missing."""
    day = F.col("o_orderdate").cast("date")
    return F.struct(
        order_id().alias("docno"),
        written_date(day).alias("date"),
        F.struct(
            day.cast("string").alias("start"),
            F.date_add(day, TERM_DAYS).cast("string").alias("end"),
        ).alias("period"),
        F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias(
            "customer"
        ),
        F.col("o_orderpriority").alias("priority"),
        written_amount(F.col("o_totalprice")).alias("total"),
        order_terms().alias("terms"),
        F.col("modules"),
    )


def quotation_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload line per order."""
    payload = F.struct(order_id().alias("quotation_id"), order_document().alias("result_quotation"))
    return orders_with_modules(spark, sf_dir).select(payload_to_json(payload).alias("payload"))


#: What makes a payload line unusable though its beginning is a whole payload.
BROKEN_ENDING = "] x"


def broken_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload lines, those of pending orders with something behind the object."""
    pending = F.get_json_object("payload", "$.result_quotation.date").contains("/")
    line = F.when(pending, F.concat("payload", F.lit(BROKEN_ENDING))).otherwise(F.col("payload"))
    return quotation_payloads(spark, sf_dir).select(line.alias("payload"))


def chosen_template() -> Column:
    """The template of an order by nation; one that nobody has for low orders, none for urgent ones."""
    priority = F.col("o_orderpriority")
    return F.when(priority == "5-LOW", "lost").when(
        priority != "1-URGENT", F.col("c_nationkey").cast("string")
    )


def priority_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of two runs, and one without text, for each order priority but the lowest."""
    kinds = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select("o_orderpriority").distinct()
    runs = F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.concat(F.col("o_orderpriority"), F.lit(text)).alias("text"))
            for part, text in (
                ("body", ": {{ Contract_id }} for {{Customer_company_name}}, tax {{ Customer_tax_id }}"),
                ("footer", " of {{ Quotation_date }}"),
                ("header", None),
            )
        ]
    )
    return kinds.select(F.col("o_orderpriority").alias("template_id"), F.explode(runs).alias("r")).select(
        "template_id", "r.part", F.lit(0).alias("section"), F.lit(0).alias("run_seq"), "r.text"
    )


def mixed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload lines of which most order priorities give one kind of unusable line."""
    document = F.struct(F.col("c_name").alias("name"))
    good = payload_to_json(
        F.struct(order_id().alias("quotation_id"), document.alias("result_quotation"))
    )
    number_id = payload_to_json(
        F.struct(F.col("o_orderkey").alias("quotation_id"), document.alias("result_quotation"))
    )
    array_document = payload_to_json(
        F.struct(order_id().alias("quotation_id"), F.array("c_name").alias("result_quotation"))
    )
    empty_id = payload_to_json(
        F.struct(F.lit("").alias("quotation_id"), document.alias("result_quotation"))
    )
    priority = F.col("o_orderpriority")
    payload = (
        F.when(priority == "1-URGENT", number_id)
        .when(priority == "2-HIGH", array_document)
        .when(priority == "3-MEDIUM", F.concat(F.lit("{"), good))
        .when(priority == "5-LOW", empty_id)
        .when(F.col("o_orderstatus") == "P", F.concat(good, F.lit("] trailing")))
        .when(F.col("o_orderstatus") == "F", F.concat(good, F.lit("],[1")))
        .otherwise(good)
    )
    return orders_with_customer(spark, sf_dir).select("o_orderkey", payload.alias("payload"))


def landed_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(quotation_id, status, doc)``: pending orders stand for a failing source system."""
    document = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return orders_with_customer(spark, sf_dir).select(
        order_id().alias("quotation_id"),
        F.when(F.col("o_orderstatus") == "P", 503).alias("status"),
        payload_to_json(document).alias("doc"),
    )


def quotation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event, for ids that reach past the last order."""
    wanted = F.concat(F.lit(ID_PREFIX), (F.col("event_id") * 2).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_seq"), wanted.alias("quotation_id")
    )


def nested_reply() -> Column:
    """JSON of mixed kinds at several depths, with a key that looks like a pair."""
    pieces = [
        '["', F.col("c_name"), '",', F.col("o_custkey").cast("string"), ',{"deep":[[" \'', F.col("c_mktsegment"),
        '\'\\t",true,null],{"a:b":"', SENTINEL, '"}],"note":"  "},"say \\"', F.col("o_orderstatus"), '\\", \\\\n"]',
    ]
    return F.concat(*[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces])


def order_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderkey, quotation_id, reply)``: good, odd and broken extractor replies."""
    priority = F.col("o_orderpriority")
    good = F.to_json(
        F.struct(
            order_id().alias("Contract_id"),
            F.col("c_name").alias("Customer_company_name"),
            F.when(priority != "1-URGENT", F.lit(SENTINEL)).alias("Customer_tax_id"),
            F.when(priority == "2-HIGH", F.col("o_custkey")).alias("Standard_users_count"),
            F.when(F.col("o_orderstatus") == "F", F.col("c_mktsegment")).alias("Remark"),
        )
    )
    with_modules = F.concat(F.left(good, F.length(good) - 1), F.lit(',"Optional_module_details":'), nested_reply(), F.lit("}"))
    good = F.when(priority == "4-NOT SPECIFIED", with_modules).otherwise(good)
    reply = (
        F.when((priority == "3-MEDIUM") & (F.col("o_orderstatus") == "O"), F.concat(good, F.lit("] x")))
        .when((priority == "3-MEDIUM") & (F.col("o_orderstatus") == "F"), F.concat(good, F.lit("],[1")))
        .when(priority == "3-MEDIUM", F.concat(good, F.lit("}")))
        .otherwise(good)
    )
    return orders_with_customer(spark, sf_dir).select(
        "o_orderkey", order_id().alias("quotation_id"), reply.alias("reply")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, value)``: every line of every document, blank English lines replaced."""
    lines = spread_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "value")
    )
    value = F.when((F.col("lang") == "en") & (F.col("value") == ""), SENTINEL).otherwise(
        F.col("value")
    )
    return lines.select("doc_id", "line_no", value.alias("value"))


def dirty_name() -> Column:
    """A customer name with quotes, commas and blanks around it."""
    return F.concat(F.lit(" '"), F.col("c_name"), F.lit("', \t"))


def marked_line() -> Column:
    """A line about an order with two marked values, the first one empty for pending orders."""
    first = F.when(F.col("o_orderstatus") == "P", F.lit("',")).otherwise(dirty_name())
    return F.concat(
        F.lit("Customer "), wrap_value(first), F.lit(", ordered "), wrap_value(F.col("o_orderpriority"))
    )


def marked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_with_customer(spark, sf_dir).select("o_orderkey", marked_line().alias("text"))


def conversation_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as text pieces of runs: two turns to a run, what users say is marked."""
    said = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.when(F.col("role") == "system", "header").otherwise("body").alias("part"),
        F.lit(0).alias("section"),
        F.floor(F.col("turn") / 2).cast("int").alias("run_seq"),
        F.col("turn").alias("piece_seq"),
        F.when(F.col("role") == "user", wrap_value(said)).otherwise(said).alias("text"),
    )


def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every page as a template run with two placeholders."""
    lines = spread_table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.split("html", "\n", -1)).alias("run_seq", "line")
    )
    text = F.concat(F.lit("{{ Contract_id }} "), F.col("line"), F.lit(" {{Quotation_date}}"))
    return lines.select(
        F.col("page_id").cast("string").alias("template_id"),
        F.lit("body").alias("part"),
        F.lit(0).alias("section"),
        "run_seq",
        text.alias("text"),
        F.lit(None).cast("string").alias("underline"),
        F.lit(None).cast("string").alias("color"),
    )


def nation_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template of two runs, and one without text, per nation."""
    body = F.concat(
        F.col("n_name"),
        F.lit(": contract {{ Contract_id }} for {{Customer_company_name}}; tax {{ Customer_tax_id }}"),
        F.lit("{{ Unknown_field }}."),
    )
    runs = F.array(
        F.struct(F.lit("body").alias("part"), F.lit(0).alias("run_seq"), body.alias("text")),
        F.struct(
            F.lit("footer").alias("part"),
            F.lit(0).alias("run_seq"),
            F.concat(F.lit("Office of "), F.col("n_name")).alias("text"),
        ),
        F.struct(F.lit("header").alias("part"), F.lit(0).alias("run_seq"), F.lit(None).cast("string").alias("text")),
    )
    return (
        table(spark, sf_dir, "nation")
        .select(F.col("n_nationkey").cast("string").alias("template_id"), F.explode(runs).alias("r"))
        .select("template_id", "r.part", F.lit(0).alias("section"), "r.run_seq", "r.text")
    )


def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, body)``: a response body per event, its shape given by the event type."""
    kind, value = F.col("event_type"), F.col("event_id").cast("string")
    amount = F.col("value").cast("string")
    body = (
        F.when(kind == "view", F.concat(F.lit('{"success":true,"data":"t'), value, F.lit('"}')))
        .when(
            kind == "signup",
            F.concat(F.lit('{"success":0.0,"error":"","detail":"d'), value, F.lit('"}')),
        )
        .when(
            kind == "click",
            F.concat(F.lit('{"success":"false","data":[],"name":"n'), value, F.lit('","detail":""}')),
        )
        .when(kind == "purchase", F.concat(F.lit("["), amount, F.lit("]")))
        .otherwise(F.concat(F.lit('{"error":"e'), value, F.lit('","detail":null,"email":"m"')))
    )
    whole = F.when((kind == "error") & (F.col("value") < 50), F.concat(body, F.lit("}"))).otherwise(body)
    return spread_table(spark, sf_dir, "events").select("event_id", whole.alias("body"))


def _label(table_of_labels: dict[str, str], value: str) -> str:
    return next(label for label, meaning in table_of_labels.items() if meaning == value)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(event_id, line)``: a request log in all its shapes, and lines of no known shape."""
    time = F.concat(F.lit("["), log_timestamp(F.col("ts")), F.lit("] "))
    user = F.concat(F.lit("userid=u"), F.col("user_id").cast("string"))
    quotation = F.concat(F.lit(ID_PREFIX), F.col("user_id").cast("string"))
    status = (F.lit(400) + F.col("user_id") % 100).cast("string")
    good = f"[✅ {_label(OUTCOME_LABELS, 'succeeded')}] "
    bad = {name: f"[❌ {_label(OUTCOME_LABELS, name)}] " for name in ("failed", "unreachable", "error")}
    action = {name: f"{_label(ACTION_LABELS, name)}: " for name in ("login", "quotation", "generate")}
    shapes = [
        F.concat(time, F.lit(action["login"]), user),
        F.concat(F.lit(good), time, user),
        F.concat(F.lit(bad["failed"]), time, user, F.lit(" | error=wrong password | twice")),
        F.concat(F.lit(bad["failed"]), time, user, F.lit(" | HTTP "), status),
        F.concat(F.lit(bad["unreachable"]), time, user),
        F.concat(F.lit(bad["error"]), time, user, F.lit(" | HTTP reply cut off")),
        F.concat(time, F.lit(action["quotation"]), quotation),
        F.concat(F.lit(good + action["quotation"]), quotation),
        F.concat(F.lit(bad["failed"] + action["quotation"]), quotation, F.lit(" | HTTP "), status),
        F.concat(F.lit(bad["error"] + action["quotation"]), quotation, F.lit(" | no route")),
        F.concat(F.lit(good + action["generate"]), quotation),
        F.concat(F.lit(SYSTEM_ERROR_LABEL + "bad value | "), quotation),
        F.concat(F.lit("INFO: "), F.col("event_type"), F.lit(" 200 OK")),
        F.concat(F.lit(f"{REMOVED_LABEL}/tmp/"), quotation, F.lit(".docx")),
        F.concat(F.lit(f"{NOT_REMOVED_LABEL}/tmp/"), quotation, F.lit(".docx: in use: yes")),
    ]
    kind = F.col("event_id") % len(shapes)
    line = F.coalesce(*[F.when(kind == i, shape) for i, shape in enumerate(shapes)])
    return spread_table(spark, sf_dir, "events").select("event_id", line.alias("line"))
