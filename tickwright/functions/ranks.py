"""Exact medians and percentile ranks over groups of any size.

A plain ordered window, or the exact median aggregate, puts a whole group in one
task. A cross-section has one group per metric, or a dozen sectors, and so one
task would hold a large share of the table. Here a group is cut into value bands
first, and a band into sub-bands, as values tend to crowd near a common one. Both
are fixed, monotone functions of the number itself, so they need no sampling, give
the same answer when a task is run again, and keep equal values together. Counting
is a map-side combined aggregate; the order inside a sub-band is found among its
distinct values only, so a value that repeats a billion times is one row.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .guards import finite

_BANDS_PER_E_FOLD = 256       # a band spans about 0.4 percent of a value
_SUB_BANDS = 1024             # a sub-band spans about 4 millionths of a value
_MAGNITUDE_OFFSET = 1_000_000  # keeps the band of a positive double positive


def value_band(x: Column) -> Column:
    """A whole number that never decreases as x grows."""
    size = (F.floor(F.ln(F.abs(x)) * _BANDS_PER_E_FOLD) + _MAGNITUDE_OFFSET).cast("long")
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def sub_band(x: Column) -> Column:
    """The place of x in its band: a whole number that never decreases there as x grows."""
    at = F.ln(F.abs(x)) * _BANDS_PER_E_FOLD
    part = F.floor((at - F.floor(at)) * _SUB_BANDS).cast("long")
    return F.when(x > 0, part).when(x < 0, -part).otherwise(F.lit(0).cast("long"))


def _banded(df: DataFrame, keys, value) -> DataFrame:
    """Adds _g, _v, _b and _s. The group is one struct, so a NULL key is a group too."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return (df.withColumn("_g", group).withColumn("_v", finite(F.col(value)))
            .withColumn("_b", value_band(F.col("_v"))).withColumn("_s", sub_band(F.col("_v"))))


def _distinct_values(banded: DataFrame) -> DataFrame:
    return (banded.filter(F.col("_v").isNotNull()).groupBy("_g", "_b", "_s", "_v")
            .agg(F.count("*").alias("_m")))


def _band_offsets(distinct: DataFrame) -> DataFrame:
    """Rows below each sub-band, and rows in the group.

    A group has a few thousand bands and a band at most _SUB_BANDS sub-bands, so no
    window here grows with the rows.
    """
    cells = distinct.groupBy("_g", "_b", "_s").agg(F.sum("_m").alias("_rows"))
    below = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bands = (cells.groupBy("_g", "_b").agg(F.sum("_rows").alias("_band"))
             .select("_g", "_b", F.coalesce(F.sum("_band").over(below), F.lit(0)).alias("_under"),
                     F.sum("_band").over(Window.partitionBy("_g")).alias("_n")))
    inside = Window.partitionBy("_g", "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_under") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))
    return cells.join(bands, ["_g", "_b"]).select("_g", "_b", "_s", "_rows", before.alias("_before"), "_n")


def _below_in_band():
    w = Window.partitionBy("_g", "_b", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_m").over(w), F.lit(0))


def grouped_median(df: DataFrame, keys, value: str, out: str = "median") -> DataFrame:
    """Exact median per group: mean of the two middle values, NULLs ignored.

    Only the one or two sub-bands holding the middle positions are looked into.
    """
    distinct = _distinct_values(_banded(df, list(keys), value))

    def inside(position, before, size):
        return (F.col(position) > before) & (F.col(position) <= before + F.col(size))

    before, start = F.col("_before"), F.col("_start")
    middle = (_band_offsets(distinct)
              .withColumn("_lo", F.floor((F.col("_n") + 1) / 2))
              .withColumn("_hi", F.floor((F.col("_n") + 2) / 2))
              .filter(inside("_lo", before, "_rows") | inside("_hi", before, "_rows"))
              .select("_g", "_b", "_s", "_before", "_lo", "_hi"))
    hits = inside("_lo", start, "_m").cast("int") + inside("_hi", start, "_m").cast("int")
    placed = (distinct.join(middle, ["_g", "_b", "_s"]).withColumn("_start", before + _below_in_band())
              .withColumn("_hits", hits).filter("_hits > 0"))
    return (placed.groupBy("_g").agg((F.sum(F.col("_v") * F.col("_hits")) / 2).alias(out))
            .select(*[F.col(f"_g.{k}").alias(k) for k in keys], out))


def grouped_percentile(df: DataFrame, keys, value: str, out: str) -> DataFrame:
    """Every row with its exact percentile rank among the group's non-null values.

    (rank - 1) / (n - 1): 0 for the smallest, 1 for a unique largest; ties share a
    rank. NULL values, and a lone value, have no rank. Joining the rank back by
    value leaves one row per value on one side, which a skew-splitting join or a
    size-checked broadcast handles when a single value is very frequent.
    """
    source = _banded(df, list(keys), value)
    distinct = _distinct_values(source)
    rank = (F.col("_before") + F.col("_in")) / F.nullif(F.col("_n") - 1, F.lit(0))
    ranked = (distinct.withColumn("_in", _below_in_band())
              .join(_band_offsets(distinct), ["_g", "_b", "_s"])
              .select("_g", "_b", "_s", "_v", rank.alias(out)))
    return (source.join(ranked, ["_g", "_b", "_s", "_v"], "left")
            .select(*[F.col(f"`{c}`") for c in df.columns], out))


def prefix_contenders(df: DataFrame, keys: list, value: str, n: int, fields: list) -> DataFrame:
    """Per key, `contenders`: the rows that were among the n largest when they appeared, by date.

    Only such a row can be in the top n of any prefix, and there are few: about
    n * ln(rows / n) of a record in random order. A group is folded once along its
    dates with a heap of at most n values, whatever n is; an equal later value does
    not enter. A group must be of bounded size, as a symbol's record is.
    """
    row = F.struct("date", F.col(value).cast("double").alias("score"), *fields)
    groups = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = groups.schema["rows"].dataType.simpleString()

    def step(held, x):
        top = held["top"]
        full = F.size(top) >= n
        rest = F.when(full, F.slice(top, 2, max(n - 1, 1)) if n > 1 else F.slice(top, 1, 0)).otherwise(top)
        entered = F.struct(F.array_sort(F.concat(rest, F.array(x["score"]))).alias("top"),
                           F.concat(held["kept"], F.array(x)).alias("kept"))
        return F.when(~full | (x["score"] > F.element_at(top, 1)), entered).otherwise(held)

    start = F.struct(F.array().cast("array<double>").alias("top"), F.array().cast(kind).alias("kept"))
    return groups.select(*keys, F.aggregate("rows", start, step, lambda held: held["kept"]).alias("contenders"))


def top_of(contenders: str, until: Column, n: int) -> Column:
    """Of contenders dated up to a day the n of the largest score, the earlier of equals first."""
    keyed = F.transform(F.filter(contenders, lambda r: r["date"] <= until),
                        lambda r: F.struct((-r["score"]).alias("k"), r["date"].alias("d"), r.alias("row")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda r: r["row"])
