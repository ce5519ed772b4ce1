"""Request logs as lines of text."""

from pyspark.sql import DataFrame, SparkSession

from inkfold.sources.quotations import FILES_PER_BATCH


def scan_logs(
    spark: SparkSession, path: str, stream: bool = False, files_per_batch: int = FILES_PER_BATCH
) -> DataFrame:
    reader = spark.read
    if stream:
        reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path).withColumnRenamed("value", "line")
