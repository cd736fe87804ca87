"""Per-symbol daily series: returns, drawdowns, averages, volatility.

Every frame here is partitioned by symbol and ordered by date. A (symbol, date)
pair is unique in BARS (see sources.bars.upsert_bars), so one symbol's partition
never holds more rows than its record has calendar days, whatever the size of
the table; the data grows in symbols, and symbols spread over the cluster. All
series share one shuffle and one sort, and none at all when the table is
bucketed by symbol.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G


def sessions(*more):
    return Window.partitionBy("symbol", *more).orderBy("date")


def so_far(window=None):
    return (window or sessions()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def trailing(n: int, window=None):
    return (window or sessions()).rowsBetween(-(n - 1), Window.currentRow)


def return_column(price: str = "close", window=None) -> Column:
    before = F.lag(price).over(window or sessions())
    return G.change(F.col(price), before)


def peak_column(window=None) -> Column:
    return F.max("close").over(so_far(window))


def average_column(n: int) -> Column:
    """Mean close of the last n sessions, NULL until n sessions exist."""
    full = F.row_number().over(sessions()) >= n
    return F.when(full, F.avg("close").over(trailing(n)))


def volatility_column(returns: str = "daily_return", n: int = 21) -> Column:
    """Annualised deviation of the last n non-null returns, NULL until n exist.

    Rows without a return form their own sub-partition, so they neither fill a
    frame nor need a filter and a join back; hashing by symbol still serves it.
    """
    w = sessions(F.col(returns).isNull())
    full = (F.row_number().over(w) >= n) & F.col(returns).isNotNull()
    return F.when(full, G.annualised(F.stddev_pop(returns).over(trailing(n, w))))


def valid_closes(bars: DataFrame) -> DataFrame:
    return bars.filter(F.col("close") > 0)


def daily_returns(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", "close", "volume",
                       return_column().alias("daily_return"))


def drawdowns(bars: DataFrame) -> DataFrame:
    return (bars.select("symbol", "date", "close", peak_column().alias("peak_close"))
            .withColumn("drawdown", G.change(F.col("close"), F.col("peak_close"))))


def moving_averages(bars: DataFrame, spans=(50, 200)) -> DataFrame:
    return bars.select("symbol", "date", "close",
                       *[average_column(n).alias(f"ma_{n}") for n in spans])


def rolling_volatility(bars: DataFrame, n: int = 21) -> DataFrame:
    out = f"ann_volatility_{n}d"
    return (daily_returns(bars).filter(F.col("daily_return").isNotNull())
            .select("symbol", "date", volatility_column(n=n).alias(out)))


def session_number(bars: DataFrame) -> DataFrame:
    """Sessions counted from the newest one, which is 1."""
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return bars.select("symbol", "date", "close", "high", "low", "volume",
                       F.row_number().over(newest_first).alias("rn"))


def return_number(bars: DataFrame) -> DataFrame:
    """Non-null returns counted from the newest one, which is 1."""
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return (daily_returns(bars).filter(F.col("daily_return").isNotNull())
            .select("symbol", "date", F.col("daily_return").alias("r"),
                    F.row_number().over(newest_first).alias("rn")))


def with_features(bars: DataFrame) -> DataFrame:
    """Bars plus return, running peak, drawdown, averages and volatility."""
    return (bars
            .withColumn("daily_return", return_column())
            .withColumn("peak_close", peak_column())
            .withColumn("ma_50", average_column(50))
            .withColumn("ma_200", average_column(200))
            .withColumn("drawdown", G.change(F.col("close"), F.col("peak_close")))
            .withColumn("ann_volatility_21d", volatility_column()))


def symbol_history(bars: DataFrame, start, end) -> DataFrame:
    """Every derived series inside a date range, rebased to the range's first close.

    The windows run over the whole record first: an average or a peak inside the
    range must know the sessions before it.
    """
    opening = F.first("close").over(so_far())
    return (with_features(bars).filter(F.col("date").between(start, end))
            .withColumn("cumulative_return", G.ratio(F.col("close"), opening) - 1)
            .select("symbol", "date", "open", "high", "low", "close", "volume",
                    "daily_return", "ma_50", "ma_200", "ann_volatility_21d",
                    "drawdown", "cumulative_return"))
