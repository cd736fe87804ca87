"""Writing bars and dimensions back out as files."""

from pyspark.sql import DataFrame


def sink_sorted_csv_gz(bars: DataFrame, path: str, files: int | None = None) -> None:
    """Bars in (symbol, date) order over gzip CSV parts.

    Ranges are cut on both columns, so one long symbol spans several files and
    the parts read in name order are the whole table in order.
    """
    keys = ("symbol", "date")
    ranged = bars.repartitionByRange(files, *keys) if files else bars.repartitionByRange(*keys)
    (ranged.sortWithinPartitions(*keys).write.mode("overwrite")
     .option("header", True).option("compression", "gzip").csv(path))


def surviving(dimension: DataFrame, kept: DataFrame) -> DataFrame:
    """Dimension rows whose symbol is still present."""
    return dimension.join(kept.select("symbol"), "symbol", "left_semi")


def sink_filtered_dimension(dimension: DataFrame, kept: DataFrame, path: str) -> None:
    surviving(dimension, kept).write.mode("overwrite").option("header", True).csv(path)
