"""The split between rows to learn from and rows held out."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GROUPS = 1000
TURN = 1 << 30


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is 2 modulo 4; a row without an id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample_ids(rows: DataFrame, group: str, n: int) -> DataFrame:
    """At most n rows of each group, those with the smallest hash of the id.

    Groups are counted first, so that of a large one only some 4 n rows with small
    hashes are put in order. More than MAX_GROUPS groups are an error.
    """
    ids = (rows.filter(F.col("doc_id").isNotNull() & F.col(group).isNotNull())
           .select("doc_id", group).distinct())
    sizes = ids.groupBy(group).count().take(MAX_GROUPS + 1)
    if len(sizes) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} values of {group}")
    if not sizes:
        return ids
    kind = rows.schema[group].dataType
    bounds = F.create_map(*[x for r in sizes for x in (
        F.lit(r[group]).cast(kind), F.lit(min(TURN, 4 * n * TURN // r["count"])))])
    first = Window.partitionBy(group).orderBy("_at", "doc_id")
    return (ids.withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.lit(TURN)))
            .filter(F.col("_at") <= F.element_at(bounds, F.col(group)))
            .withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= n)
            .drop("_place", "_at"))
