"""Running totals over groups of any size.

A group is cut into chunks by a hash or range of its order key. Chunk totals are
summed first (with a map-side combine), so that a window never holds more than
one chunk of one group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, group: str, chunk: str, order: list, value: Column,
                  name: str, few_chunks: bool = False) -> DataFrame:
    """Add `name`: the sum of value over the rows of the group that stand before.

    The order is by chunk, then by the columns of order; group may be null. Rows
    that tie in all of these are interchangeable. A caller that has a bound on groups
    times chunks sets few_chunks: the chunks' totals then go to the rows, which are
    shuffled once.
    """
    rows = rows.withColumn("__total_v", value)
    sums = rows.groupBy(group, chunk).agg(F.sum("__total_v").alias("__total_sum"))
    before = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("__total_g"), F.col(chunk).alias("__total_c"),
                       F.coalesce(F.sum("__total_sum").over(before), F.lit(0)).alias("__total_base"))
    inside = (Window.partitionBy(group, chunk).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    base = F.broadcast(base) if few_chunks else base
    placed = rows.withColumn("__total_in", F.coalesce(F.sum("__total_v").over(inside), F.lit(0)))
    return (placed.join(base, F.col(group).eqNullSafe(F.col("__total_g")) & (F.col(chunk) == F.col("__total_c")))
            .withColumn(name, F.col("__total_base") + F.col("__total_in"))
            .drop("__total_v", "__total_g", "__total_c", "__total_base", "__total_in"))
