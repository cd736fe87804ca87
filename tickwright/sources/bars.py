"""Daily bars: reading, folding loads by key, and laying them out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .dimensions import empty, path_exists

VALUES = [f.name for f in schemas.BARS if f.name not in ("symbol", "date")]


def _csv(spark, path):
    return spark.read.schema(schemas.BARS).option("header", True).csv(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV, the gzip copy first. A blank cell is NULL.

    A gzip file is one task; land it as a table (write_bars_table) before scale.
    """
    for candidate in (path + ".gz", path):
        if path_exists(spark, candidate):
            return _csv(spark, candidate)
    raise FileNotFoundError(f"neither {path}.gz nor {path}")


def read_wide_bars(spark: SparkSession, path: str) -> DataFrame:
    """As read_bars, but the wide universe is optional: no file, no rows."""
    try:
        return read_bars(spark, path)
    except FileNotFoundError:
        return empty(spark, schemas.BARS)


def fold_by_key(rows: DataFrame, order) -> DataFrame:
    """One row per (symbol, date), the one highest in `order`.

    An aggregate, not a row number: copies of a key collapse on the map side, so
    a symbol loaded many times over never gathers in one task. The row itself
    breaks a tie, which keeps the answer the same when a task runs again.
    """
    row = F.struct(*VALUES)
    return (rows.groupBy("symbol", "date")
            .agg(F.max_by(row, F.struct(*order, row)).alias("x"))
            .select("symbol", "date", "x.*"))


def upsert_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing bars with incoming ones replacing the same key; last load wins.

    `incoming` may carry load_seq to order several loads of one key.
    """
    if "load_seq" not in incoming.columns:
        incoming = incoming.withColumn("load_seq", F.lit(1))
    both = (existing.select("symbol", "date", *VALUES, F.lit(None).cast("long").alias("load_seq"))
            .unionByName(incoming.select("symbol", "date", *VALUES,
                                         F.col("load_seq").cast("long").alias("load_seq"))))
    return fold_by_key(both, ["load_seq"])


def write_bars_table(bars: DataFrame, table: str, path: str, buckets: int = 8) -> None:
    """Bars bucketed by symbol and sorted by date.

    Every per-symbol window and aggregate over the table then starts without a
    shuffle. Choose buckets so that one holds a few hundred megabytes.
    """
    (bars.repartition(buckets, "symbol").write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "symbol").sortBy("symbol", "date").saveAsTable(table))
