"""The result table. Spark's commit protocol takes the place of temporary files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.session import setting

#: A task keeps this many folders open and writes rows as they come; rows of more are sorted first.
#: Without it all rows of a task are sorted by their folder, files and records with them.
OPEN_FOLDERS = ("spark.sql.maxConcurrentOutputFileWriters", "8")


def write_results(results: DataFrame, path: str) -> None:
    """Accepted and rejected documents go to one table in one pass, split by ``accepted``."""
    with setting(results.sparkSession, *OPEN_FOLDERS):
        results.write.mode("errorifexists").partitionBy("accepted").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The result table; a filter on ``accepted`` reads only the folder it needs."""
    written = spark.read.parquet(path)
    return written.withColumn("accepted", F.col("accepted").cast("boolean"))
