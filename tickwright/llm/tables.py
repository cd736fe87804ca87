"""Intermediate tables in the shared work folder."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import persist_table

BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def lean(spark: SparkSession):
    """For the jobs inside: no shuffle files after the job that needs them, and tasks that
    hold at most BATCH_ROWS rows, or the first that reach BATCH_BYTES, at a time."""
    conf = spark.conf
    before = {_CLEANUP: conf.get(_CLEANUP, "false"), _BATCH: conf.get(_BATCH, "10000"), _BYTES: conf.get(_BYTES, "64m")}
    conf.set(_CLEANUP, "true")
    conf.set(_BATCH, str(BATCH_ROWS))
    conf.set(_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame and read it back, as persist_table does, under `lean`.

    The table has replaced the shuffle files of its job, and a long job would otherwise
    keep those of all its steps on disk.
    """
    with lean(df.sparkSession):
        return persist_table(df, label)
