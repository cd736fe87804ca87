"""One-row-per-symbol and one-row-per-period rollups.

Edges (first and last close of a group) come from min_by / max_by inside the
aggregate itself, so a rollup is one pass: no join back to the bars.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from . import series as S


def latest_where(value: str, keep=None):
    """The value on the newest date for which it (or the condition) holds."""
    ok = F.col(value).isNotNull() if keep is None else keep
    return F.max_by(value, F.when(ok, F.col("date")))


def agg_bounds(bars):
    return bars.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("*").alias("trading_days"))


def agg_extremes(bars):
    return bars.groupBy("symbol").agg(
        F.max("close").alias("highest_close"), F.min("close").alias("lowest_close"),
        F.avg("volume").alias("avg_volume"),
        F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume"))


def agg_moments(bars):
    r = F.col("daily_return")
    return (S.daily_returns(bars).filter(r.isNotNull()).groupBy("symbol").agg(
        F.avg(r).alias("mean_ret"), F.avg(r * r).alias("mean_sq"),
        F.count("*").alias("n"),
        G.annualised(F.stddev_pop(r)).alias("ann_volatility")))


def latest_row(bars):
    """The newest bar of each symbol."""
    cols = ["open", "high", "low", "close", "adj_close", "volume"]
    return bars.groupBy("symbol").agg(
        F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in cols])


def symbol_stats(bars: DataFrame, symbols: DataFrame, recent: int = 21) -> DataFrame:
    """Each symbol over its own record: one shuffle, one aggregate, one join.

    The current volatility is that of the newest returns, so returns are counted
    from the newest and no rolling frame is kept for the sessions before.
    """
    newest = (Window.partitionBy("symbol").orderBy(F.desc("date"))
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    r = F.col("daily_return")
    rows = (bars.select("symbol", "date", "close", "volume",
                        S.return_column().alias("daily_return"), S.peak_column().alias("peak"))
            .withColumn("k", F.count(r).over(newest)))
    rolled = rows.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("*").alias("trading_days"),
        F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
        F.stddev_pop(r).alias("dev"), F.count(r).alias("n_returns"),
        F.min(G.change(F.col("close"), F.col("peak"))).alias("max_drawdown"),
        F.when(F.count(r) >= recent, G.annualised(F.stddev_pop(F.when(F.col("k") <= recent, r))))
        .alias("current_volatility"),
        latest_where("daily_return").alias("last_daily_return"),
        F.max("close").alias("highest_close"), F.min("close").alias("lowest_close"),
        F.avg("volume").alias("avg_volume"),
        F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume")) \
        .filter(F.col("n_returns") > 0)
    first, last = F.col("first_close"), F.col("last_close")
    return (symbols.join(rolled, "symbol")
            .withColumn("total_return", G.change(last, first))
            .withColumn("years", G.years_between(F.col("first_date"), F.col("last_date")))
            .withColumn("cagr", G.growth_rate(first, last, F.col("first_date"), F.col("last_date")))
            .withColumn("ann_volatility", G.annualised(F.col("dev")))
            .select("symbol", "name", "sector", "industry", "is_index", "first_date",
                    "last_date", "trading_days", "first_close", "last_close",
                    "total_return", "years", "cagr", "ann_volatility", "max_drawdown",
                    "current_volatility", "last_daily_return", "highest_close",
                    "lowest_close", "avg_volume", "avg_dollar_volume"))


def latest_quote(bars: DataFrame) -> DataFrame:
    """Newest bar, the close before it, and the 52-week range ending on it.

    The previous close needs an order, the 52-week range needs the last date;
    both are per-symbol windows over the same sort, then one aggregate.
    """
    every = Window.partitionBy("symbol")
    cols = ["open", "high", "low", "close", "volume"]
    framed = (bars.select("symbol", "date", *cols, F.lag("close").over(S.sessions())
                          .alias("prev"), F.max("date").over(every).alias("newest"))
              .filter(F.col("date") >= F.add_months("newest", -12)))
    previous = F.max_by("prev", "date")
    return framed.groupBy("symbol").agg(
        F.max("date").alias("date"), *[F.max_by(c, "date").alias(c) for c in cols],
        previous.alias("prev_close"),
        G.change(F.max_by("close", "date"), previous).alias("daily_return"),
        F.max("high").alias("w52_high"), F.min("low").alias("w52_low"))


def _period_edges(bars, period):
    return bars.withColumn("period", period).groupBy("symbol", "period")


def yearly_summary(bars: DataFrame, full_year_sessions: int = 240) -> DataFrame:
    opened, closed = F.min_by("close", "date"), F.max_by("close", "date")
    return (_period_edges(bars, F.date_format("date", "yyyy")).agg(
        opened.alias("open_close"), closed.alias("close_close"),
        F.max("close").alias("year_high"), F.min("close").alias("year_low"),
        F.avg("volume").alias("avg_volume"), F.count("*").alias("trading_days"),
        G.change(closed, opened).alias("year_return"),
        (F.count("*") < full_year_sessions).cast("int").alias("is_partial"))
        .withColumnRenamed("period", "year"))


def monthly_returns(bars: DataFrame) -> DataFrame:
    opened, closed = F.min_by("close", "date"), F.max_by("close", "date")
    return (_period_edges(bars, F.date_format("date", "yyyy-MM"))
            .agg(G.change(closed, opened).alias("month_return"))
            .select("symbol", F.col("period").alias("year_month"),
                    F.substring("period", 1, 4).alias("year"),
                    F.substring("period", 6, 2).alias("month"), "month_return"))


MONTHS = [f"{m:02d}" for m in range(1, 13)]


def monthly_pivot(bars):
    """A year-by-month grid per symbol with a fixed set of twelve columns."""
    grid = (monthly_returns(bars).groupBy("symbol", "year").pivot("month", MONTHS)
            .agg(F.first("month_return")))
    return grid.select("symbol", "year", *[F.col(m).alias(f"m{m}") for m in MONTHS])


def yearly_track_record(bars):
    return yearly_summary(bars).sortWithinPartitions("symbol", "year")


def monthly_grid(bars):
    return (monthly_returns(bars).select("symbol", "year", "month", "month_return")
            .sortWithinPartitions("symbol", "year", "month"))


def yearly_extremes(bars):
    """Each year with a mark on the best and the worst full one.

    Ties go to the earlier year. Years per symbol are few, so the marks are a
    window over the already aggregated rows.
    """
    full = F.col("is_partial") == 0
    high = Window.partitionBy("symbol", full).orderBy(F.desc("year_return"), "year")
    low = Window.partitionBy("symbol", full).orderBy(F.asc_nulls_last("year_return"), "year")
    mark = (F.when(full & (F.row_number().over(high) == 1), "best")
            .when(full & (F.row_number().over(low) == 1), "worst"))
    return yearly_summary(bars).select("symbol", "year", "year_return", "is_partial",
                                       mark.alias("mark"))
