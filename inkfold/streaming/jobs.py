"""Streams over landing folders. Each file is processed once; sinks commit exactly once."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkfold.operators.extract import Rule
from inkfold.operators.outcomes import log_parse
from inkfold.plans.contracts import (
    GENERATED,
    accepted_records,
    contract_results,
    generate_contracts,
    lasting_records,
    results_from_templates,
    segments_from_templates,
)
from inkfold.sources.logs import scan_logs
from inkfold.sources.quotations import scan_payloads
from inkfold.sources.results import OPEN_FOLDERS
from inkfold.sources.templates import Run


#: Process what has landed, then stop. ``{"processingTime": "1 minute"}`` runs on.
ONCE = {"availableNow": True}


def _write(
    frame: DataFrame, sink: str, checkpoint: str, partition: str | None, trigger: dict
) -> StreamingQuery:
    writer = (
        frame.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
    )
    if partition:
        # The sink asks its session for this in every batch, so it stays on.
        frame.sparkSession.conf.set(*OPEN_FOLDERS)
        writer = writer.partitionBy(partition)
    return writer.start()


def generate_contracts_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    rules: Sequence[Rule],
    template: Sequence[Run],
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Results of landed payloads. Turned-down lines go to the ``accepted=false`` partition.

    A repeated id is generated again, as the request service does.
    """
    payloads = scan_payloads(spark, source, stream=True)
    return _write(contract_results(payloads, rules, template), sink, checkpoint, "accepted", trigger)


def contract_segments_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    rules: Sequence[Rule],
    template: Sequence[Run],
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Styled segments of landed payloads."""
    payloads = scan_payloads(spark, source, stream=True)
    return _write(generate_contracts(payloads, rules, template), sink, checkpoint, "part", trigger)


def contract_tables_stream(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    rules: Sequence[Rule],
    templates: Callable[[SparkSession], DataFrame],
    template_id: Column,
    trigger: dict = ONCE,
) -> StreamingQuery:
    """Contracts of landed payloads as tables below ``sink``, from templates that may change meanwhile.

    ``templates`` is asked for the template table in every batch, and ``template_id`` is computed from the
    extracted ``record``. A batch is parsed once, into its ``records``, which the others read:
    ``results``, one per payload; ``segments``; and ``dead_letters``, the results that are not 200.
    ``templates`` keeps the runs that a batch was made with, so that results and segments agree.

    Each batch has a folder of its own in each table, which a repeated batch replaces: it adds nothing.
    ``contract_table`` reads a table; a batch that was cut off is there in part until it is repeated.
    """

    def process(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession

        def put(frame: DataFrame, name: str) -> DataFrame:
            path = f"{sink}/{name}/batch={number}"
            frame.write.mode("overwrite").parquet(path)
            return session.read.schema(frame.schema).parquet(path)

        runs = put(templates(session), "templates")
        records = put(lasting_records(batch, rules), "records")
        results = put(results_from_templates(records, runs, template_id), "results")
        put(results.where(F.col("http_status") != GENERATED), "dead_letters")
        made = segments_from_templates(accepted_records(records), runs, template_id)
        put(made.where(F.col("http_status") == GENERATED).drop("http_status"), "segments")

    payloads = scan_payloads(spark, source, stream=True)
    return payloads.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def contract_table(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """A table of ``contract_tables_stream`` over all batches, ``batch`` last."""
    return spark.read.parquet(f"{sink}/{name}")


def log_parse_stream(
    spark: SparkSession, source: str, sink: str, checkpoint: str, trigger: dict = ONCE
) -> StreamingQuery:
    """Parsed lines of landed request logs, unparsed lines among them."""
    return _write(log_parse(scan_logs(spark, source, stream=True)), sink, checkpoint, None, trigger)
