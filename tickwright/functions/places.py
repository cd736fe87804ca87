"""Places in one order over a whole table, and pages of a stored order.

An ordered row number over a table without a partition key is one task. Here rows are
laid out by ranges of the sort keys, each range is numbered in its own task, and the
numbers of rows in the ranges before are added. Keys may be several, of either
direction, with nulls last and ties: a tie in all keys is broken by the row itself.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import persist_table


def sort_keys(order: dict) -> list:
    """Sort columns of {name: ascending}, nulls last."""
    if not order:
        raise ValueError("an order needs a sort key")
    return [F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in order.items()]


def with_place(df: DataFrame, order: dict, out: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in the order {column: ascending}.

    The ranges come from a sample, so the laid out rows are written once and both the
    counts and the numbers are read from there. Only one row a range is put in one task.
    """
    sort_keys(order)
    rest = {c: True for c in df.columns if c not in order and not _unordered(df.schema[c].dataType)}
    keys = sort_keys(order | rest)
    laid = persist_table(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ordered")
    inside = laid.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*keys)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = (laid.groupBy("_range").agg(F.count("*").alias("_n"))
              .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (inside.join(F.broadcast(counts), "_range")         # one row a range
            .select(*df.columns, (F.col("_before") + F.col("_in")).alias(out)))


def _unordered(kind) -> bool:
    return kind.typeName() in ("map", "variant")


def after_row(order: dict, last: dict) -> Column:
    """Whether a row stands after the one whose keys are `last`, in the order {column: ascending}."""
    def beyond(c, up):
        value = last[c]
        if value is None:
            return F.lit(False)
        step = F.col(c) > F.lit(value) if up else F.col(c) < F.lit(value)
        return step | F.col(c).isNull()

    def level(names):
        *same, c = names
        equal = [F.col(k).eqNullSafe(F.lit(last[k])) for k in same]
        return reduce(lambda a, b: a & b, [*equal, F.coalesce(beyond(c, order[c]), F.lit(False))])
    names = list(order)
    return reduce(lambda a, b: a | b, [level(names[:i + 1]) for i in range(len(names))])


def store_ordered(df: DataFrame, order: dict, path: str) -> DataFrame:
    """Write df with its places, in order; pages are then read by place.

    Files hold ranges of places, and their statistics are the bounds of the pages in
    them: any page reads the one or two files that it lies in.
    """
    placed = with_place(df, order)
    placed.repartitionByRange("place").sortWithinPartitions("place").write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def read_page(spark: SparkSession, path: str, page: int, per_page: int) -> DataFrame:
    """Page `page`, from 1, of a stored order."""
    first = (page - 1) * per_page
    return (spark.read.parquet(path).filter((F.col("place") > first) & (F.col("place") <= first + per_page))
            .orderBy("place"))
