"""Rollups from mergeable monthly partials, rebuilt only where bars changed.

Bars are stored by month. A month's fingerprint (rows and the sum of row hashes) tells
whether it changed; a refresh reads the new bars once for the fingerprints, writes the
months that differ under the new run, and names the others where they already lie. Each
stored month has one partial row a symbol, which is aggregated inside the month's own
tasks; statistics and quotes are merged from those rows, a few hundred a symbol, without
the bars behind them.

    part          merge over months in order
    edges         first of first, last of last
    counts, sums  added; what a month's first close moves against the month before is added here
    drawdown      least of the month's own and of its low against the highest close before it
    newest returns  the last of all, each month keeping its own last RECENT
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import guards as G
from ..operators import series as S
from ..sources.dimensions import path_exists

RECENT = 21
BAR = ["open", "high", "low", "close", "adj_close", "volume"]
_INDEX = "month string, rows long, print decimal(38,0), path string"


def month_of():
    return F.date_format("date", "yyyy-MM")


def fingerprints(bars: DataFrame) -> DataFrame:
    """month, rows, print: an aggregate that sends one row a month and task through the shuffle."""
    return (bars.groupBy(month_of().alias("month"))
            .agg(F.count("*").alias("rows"),
                 F.sum(F.xxhash64("symbol", "date", *BAR).cast("decimal(38,0)")).alias("print")))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], _INDEX)
    return spark.read.schema(_INDEX).parquet(path)


def read_months(spark: SparkSession, index: DataFrame, name: str, schema) -> DataFrame:
    """The stored months of `name` (bars or partials), wherever they lie.

    The driver holds the list of months, at most a few hundred for any number of symbols.
    """
    paths = [f"{r['path']}/{name}/month={r['month']}" for r in index.select("month", "path").distinct().collect()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def month_partials(bars: DataFrame) -> DataFrame:
    """One row a symbol and month. Both windows and the aggregate share one partition of a month's rows."""
    w = Window.partitionBy("month", "symbol").orderBy("date")
    valid = F.col("close").isNotNull()
    rows = (bars.withColumn("month", month_of())
            .withColumn("before", F.lag("close").over(w))
            .withColumn("r", G.change(F.col("close"), F.col("before")))
            .withColumn("peak", F.max("close").over(S.so_far(w))))
    bar = F.struct("date", *BAR)
    ordered = F.array_sort(F.collect_list(F.struct("date", "r")))          # a month's days
    moved = F.filter(ordered, lambda x: x["r"].isNotNull())
    closes = F.array_sort(F.collect_list(F.struct("date", "close")))
    r = F.col("r")
    return rows.groupBy("month", "symbol").agg(
        F.min(bar).alias("first"), F.max(bar).alias("last"), F.count("*").alias("days"),
        F.get(closes, F.size(closes) - 2)["close"].alias("last_but_one"), (F.count("*") > 1).alias("has_two"),
        F.max("close").alias("highest"), F.min("close").alias("lowest"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.count("volume").alias("volumes"), F.sum("volume").alias("volume"),
        F.count(F.col("close") * F.col("volume")).alias("dollar_days"), F.sum(F.col("close") * F.col("volume")).alias("dollars"),
        F.count(r).alias("moves"), F.sum(r).alias("sum_r"), F.sum(r * r).alias("sum_rr"),
        F.min(G.change(F.col("close"), F.col("peak"))).alias("drawdown"),
        F.when(F.count(F.when(valid, 1)) > 0, F.slice(F.reverse(moved), 1, RECENT)).alias("newest"))


def refresh(spark: SparkSession, bars: DataFrame, root: str, run: str, previous: str | None) -> DataFrame:
    """Store the months of bars that differ from those of the run before; the index of all months.

    Bars are read for the fingerprints and, months that differ only, to be stored. The
    index is written last, so a run that dies leaves nothing that a reader would find.
    """
    home = f"{root.rstrip('/')}/months/{run}"
    old = read_index(spark, f"{root.rstrip('/')}/months/{previous}/index") if previous else spark.createDataFrame([], _INDEX)
    prints = fingerprints(bars.select(*[f.name for f in schemas.BARS]))
    known = old.select("month", F.col("rows").alias("r"), F.col("print").alias("p"), "path")
    index = (prints.join(known, "month", "left")
             .withColumn("same", F.coalesce((F.col("rows") == F.col("r")) & F.col("print").eqNullSafe(F.col("p")), F.lit(False)))
             .select("month", "rows", "print", F.when(F.col("same"), F.col("path")).otherwise(F.lit(home)).alias("path"), "same"))
    index.write.parquet(f"{home}/judged")
    index = spark.read.parquet(f"{home}/judged")
    changed = index.filter("NOT same").select("month")
    # months are few, so the list prunes rows in the scan's own tasks
    touched = [r[0] for r in changed.collect()]
    if touched:
        rows = bars.withColumn("month", month_of()).filter(F.col("month").isin(touched))
        (rows.repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(8))).sortWithinPartitions("month", "symbol", "date")
         .write.partitionBy("month").parquet(f"{home}/bars"))
        stored = spark.read.schema(_bars_schema()).option("basePath", f"{home}/bars").parquet(f"{home}/bars")
        month_partials(stored.drop("month")).write.partitionBy("month").parquet(f"{home}/partials")
    index.drop("same").coalesce(1).write.parquet(f"{home}/index")
    return spark.read.schema(_INDEX).parquet(f"{home}/index")


def _bars_schema():
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.BARS) + ", month string"


_BAR_STRUCT = "struct<date:date,open:double,high:double,low:double,close:double,adj_close:double,volume:bigint>"
_PARTIAL = (f"symbol string, first {_BAR_STRUCT}, last {_BAR_STRUCT}, days bigint, last_but_one double, has_two boolean, "
            "highest double, lowest double, high double, low double, volumes bigint, volume bigint, dollar_days bigint, "
            "dollars double, moves bigint, sum_r double, sum_rr double, drawdown double, "
            "newest array<struct<date:date,r:double>>")


def partials(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The stored partials, with what each month's first close moved against the month before."""
    rows = read_months(spark, index, "partials", _PARTIAL)
    w = Window.partitionBy("symbol").orderBy("first.date")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("joint", G.change(F.col("first.close"), F.lag("last.close").over(w)))
            .withColumn("peak_before", F.max("highest").over(before))
            .withColumn("close_before", F.lag("last.close").over(w)))


def symbol_stats(merged: DataFrame, symbols: DataFrame) -> DataFrame:
    """rollups.symbol_stats from partials."""
    joint = F.col("joint")
    own = F.coalesce("newest", F.array().cast("array<struct<date:date,r:double>>"))
    with_joint = F.when(joint.isNotNull(), F.concat(own, F.array(F.struct(F.col("first.date").alias("date"), joint.alias("r"))))).otherwise(own)
    # a month's list is newest first, and so is the list of months
    months = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("first.date").alias("d"), with_joint.alias("x")))))
    recent = F.slice(F.flatten(F.transform(months, lambda m: m["x"])), 1, RECENT)
    rolled = merged.groupBy("symbol").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("days").alias("trading_days"),
        (F.sum("moves") + F.count(joint)).alias("n_returns"),
        (F.coalesce(F.sum("sum_r"), F.lit(0.0)) + F.coalesce(F.sum(joint), F.lit(0.0))).alias("sum_r"),
        (F.coalesce(F.sum("sum_rr"), F.lit(0.0)) + F.coalesce(F.sum(joint * joint), F.lit(0.0))).alias("sum_rr"),
        F.min(F.least("drawdown", G.change(F.col("lowest"), F.col("peak_before")))).alias("max_drawdown"),
        recent.alias("recent"), F.max("highest").alias("highest_close"), F.min("lowest").alias("lowest_close"),
        (F.sum("volume") / F.sum("volumes")).alias("avg_volume"),
        (F.sum("dollars") / F.sum("dollar_days")).alias("avg_dollar_volume")).filter("n_returns > 0")
    n = F.col("n_returns")
    dev = F.sqrt(F.greatest(F.col("sum_rr") / n - F.pow(F.col("sum_r") / n, 2), F.lit(0.0)))
    k = F.size("recent")
    mean = F.aggregate("recent", F.lit(0.0), lambda s, x: s + x["r"]) / k
    spread = F.aggregate("recent", F.lit(0.0), lambda s, x: s + F.pow(x["r"] - F.col("mean_recent"), 2)) / k
    first, last = F.col("first.close"), F.col("last.close")
    return (symbols.join(rolled, "symbol").withColumn("mean_recent", mean)
            .select("symbol", "name", "sector", "industry", "is_index", F.col("first.date").alias("first_date"),
                    F.col("last.date").alias("last_date"), "trading_days", first.alias("first_close"), last.alias("last_close"),
                    G.change(last, first).alias("total_return"), G.years_between(F.col("first.date"), F.col("last.date")).alias("years"),
                    G.growth_rate(first, last, F.col("first.date"), F.col("last.date")).alias("cagr"),
                    G.annualised(dev).alias("ann_volatility"), "max_drawdown",
                    F.when(k >= RECENT, G.annualised(F.sqrt(spread))).alias("current_volatility"),
                    F.get("recent", F.lit(0))["r"].alias("last_daily_return"),
                    "highest_close", "lowest_close", "avg_volume", "avg_dollar_volume"))


def latest_quote(spark: SparkSession, merged: DataFrame, index: DataFrame) -> DataFrame:
    """rollups.latest_quote from partials.

    Months wholly inside a symbol's last year give their highs and lows. Of the month
    where the year begins the days are read, from the stored months of that name alone.
    """
    newest = (merged.groupBy("symbol").agg(F.max(F.struct("last", "has_two", "last_but_one", "close_before")).alias("x"))
              .select("symbol", "x.*").withColumn("since", F.add_months("last.date", -12)))
    inside = (merged.join(newest.select("symbol", "since"), "symbol").filter(F.col("first.date") >= F.col("since"))
              .select("symbol", "high", "low"))
    edge = newest.select("symbol", "since", F.date_format("since", "yyyy-MM").alias("month"))
    # only months that begin before the year does are cut
    cut = (merged.select("symbol", F.date_format("first.date", "yyyy-MM").alias("month"), F.col("first.date").alias("begun"))
           .join(edge, ["symbol", "month"]).filter("begun < since").select("symbol", "month", "since"))
    months = [r[0] for r in cut.select("month").distinct().collect()]
    held = index.filter(F.col("month").isin(months)) if months else index.filter("false")
    days = (read_months(spark, held, "bars", schemas.BARS).join(cut, "symbol")
            .filter((F.col("date") >= F.col("since")) & (month_of() == F.col("month"))).select("symbol", "high", "low"))
    year = inside.unionByName(days).groupBy("symbol").agg(F.max("high").alias("w52_high"), F.min("low").alias("w52_low"))
    previous = F.when(F.col("has_two"), F.col("last_but_one")).otherwise(F.col("close_before"))
    return newest.join(year, "symbol", "left").select(
        "symbol", F.col("last.date").alias("date"), *[F.col(f"last.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")],
        previous.alias("prev_close"), G.change(F.col("last.close"), previous).alias("daily_return"), "w52_high", "w52_low")
