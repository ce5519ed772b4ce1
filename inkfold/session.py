"""Session settings and the shared folder that jobs may write intermediate tables to."""

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app="inkfold", master=None, **settings) -> SparkSession:
    """A session with adaptive execution on; sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Whole documents travel in Arrow batches, so fewer rows per batch than the default.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        **{key: str(value) for key, value in settings.items()},
    }
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session.

    Workers find it without this where it is installed or on their path.
    """
    context = spark.sparkContext
    if getattr(context, "_inkfold_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="inkfold-"), "inkfold")
    context.addPyFile(shutil.make_archive(archive, "zip", root, "inkfold"))
    context._inkfold_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's checkpoint folder.

    A machine-local folder is made only in local mode, where it is reachable by definition.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    base = tempfile.mkdtemp(prefix="inkfold-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session while a job is started."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """Write the frame to the shared folder once and go on from the written table.

    What follows then reads just the columns it needs, a lost executor costs no recomputation
    of what came before, and numbers given to rows stay as they were written.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
