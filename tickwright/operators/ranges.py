"""Reads of a date range, lookups and small projections."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions.places import after_row, sort_keys, with_place
from . import series as S


def _within(df: DataFrame, start, end) -> DataFrame:
    return df.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def symbol_directory(symbols: DataFrame) -> DataFrame:
    return (symbols.select("symbol", "name", "sector", "industry", "is_index")
            .orderBy(F.desc("is_index"), "symbol"))


def date_bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("*").alias("sessions"))


def global_last_date(bars: DataFrame) -> DataFrame:
    return bars.agg(F.max("date").alias("last_date"))


def row_count(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_rows"))


def prices_in_range(bars, start, end):
    return _within(bars, start, end).select(
        "symbol", "date", "open", "high", "low", "close", "volume")


def moving_averages_in_range(bars, start, end):
    return _within(S.moving_averages(bars), start, end)


def daily_returns_in_range(bars, start, end):
    return (_within(S.daily_returns(bars), start, end)
            .filter(F.col("daily_return").isNotNull())
            .select("symbol", "date", "daily_return"))


def drawdown_in_range(bars, start, end):
    return _within(S.drawdowns(bars), start, end)


def volatility_in_range(bars, start, end):
    return (_within(S.rolling_volatility(bars), start, end)
            .filter(F.col("ann_volatility_21d").isNotNull()))


def cumulative_return(bars, start, end):
    """Compounds every return dated in the range, the first one included."""
    running = F.sum(G.log_growth(F.col("daily_return"))).over(S.so_far())
    return daily_returns_in_range(bars, start, end).select(
        "symbol", "date", G.compounded(running).alias("cumulative_return"))


def indexed_comparison(bars, start, end, symbols=None):
    """Closes rebased to 100 at each symbol's first session in the range."""
    rows = _within(bars, start, end)
    if symbols is not None:
        rows = rows.filter(F.col("symbol").isin(list(symbols)))
    opening = F.first("close").over(S.so_far())
    return rows.select("symbol", "date",
                       G.ratio(F.lit(100.0) * F.col("close"), opening).alias("indexed_close"))


def indexed_pivot(bars, start, end, symbols):
    """Sessions down, the caller's symbols across, in the caller's order."""
    tall = indexed_comparison(bars, start, end, symbols)
    return tall.groupBy("date").pivot("symbol", list(symbols)).agg(F.first("indexed_close"))


def indexed_pivot_filled(bars, start, end, symbols):
    """The pivot with gaps carried forward, for reading end values.

    The one-row-per-date frame is bounded by the calendar, so ordering it in a
    single partition costs the same at any number of bars.
    """
    wide = indexed_pivot(bars, start, end, symbols)
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("date", *[F.last(F.col(f"`{s}`"), ignorenulls=True).over(w).alias(s)
                                 for s in symbols])


def comparison_spread(bars, start, end, symbols, threshold: float = 20.0):
    """One row: do the end values differ by more than the threshold ratio?"""
    ends = (indexed_comparison(bars, start, end, symbols)
            .groupBy("symbol").agg(F.max_by("indexed_close", "date").alias("v"))
            .filter(F.abs("v") > 0))
    spread = G.ratio(F.max(F.abs("v")), F.min(F.abs("v")))
    return ends.agg(F.count("*").alias("n_series"), spread.alias("spread"),
                    F.coalesce((F.count("*") >= 2) & (spread > threshold), F.lit(False))
                    .cast("int").alias("needs_log"))


# Metric label -> (value column, may be NULL in the source series).
COMPARISON_METRICS = {
    "Cumulative return": "cumulative_return",
    "Drawdown": "drawdown",
    "Rolling volatility": "ann_volatility_21d",
    "Daily returns": "daily_return",
    "Volume": "volume",
}


def comparison_series(bars, symbols, start, end, metric):
    """One tall (symbol, date, value) frame of one metric for several symbols."""
    if metric not in COMPARISON_METRICS:
        raise KeyError(metric)
    chosen = bars.filter(F.col("symbol").isin(list(symbols)))
    source = {
        "Cumulative return": cumulative_return,
        "Drawdown": drawdown_in_range,
        "Rolling volatility": volatility_in_range,
        "Daily returns": daily_returns_in_range,
        "Volume": prices_in_range,
    }[metric](chosen, start, end)
    return source.select("symbol", "date",
                         F.col(COMPARISON_METRICS[metric]).cast("double").alias("value"))


def tail(bars, sessions: int = 60):
    """Last n closes per symbol, oldest first inside each symbol."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    return (bars.select("symbol", "date", "close", F.row_number().over(newest).alias("rn"))
            .filter(F.col("rn") <= sessions).drop("rn")
            .sortWithinPartitions("symbol", "date"))


def events_in_window(market_events, start, end):
    return _within(market_events, start, end).orderBy("date")


# Preset label -> days back from the newest session, or a rule name.
PRESET_WINDOWS = {"1M": 30, "3M": 91, "6M": 182, "YTD": "ytd", "1Y": 365, "3Y": 1095,
                  "5Y": 1826, "10Y": 3653, "All": "all"}


def preset_windows(bars):
    """Each preset as a (start, end) pair, back from the newest session."""
    days = {k: v for k, v in PRESET_WINDOWS.items() if isinstance(v, int)}
    bounds = bars.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    starts = [F.struct(F.lit(name).alias("preset"),
                       F.greatest(F.date_sub("hi", n), F.col("lo")).alias("start_date"),
                       F.col("hi").alias("end_date")) for name, n in days.items()]
    starts.append(F.struct(F.lit("YTD").alias("preset"),
                           F.greatest(F.trunc("hi", "year"), F.col("lo")).alias("start_date"),
                           F.col("hi").alias("end_date")))
    starts.append(F.struct(F.lit("All").alias("preset"), F.col("lo").alias("start_date"),
                           F.col("hi").alias("end_date")))
    return bounds.select(F.inline(F.array(*starts)))


def distinct_sectors(symbols):
    return (symbols.filter(F.col("sector").isNotNull()).select("sector").distinct()
            .orderBy("sector"))


def table_query(df, term=None, search_cols=(), filters=None, sort=None, ascending=True,
                page: int = 1, per_page: int = 25, tie=("symbol",), after: dict | None = None):
    """Search, filter, sort and page a frame; one of the sort keys must be a column of it.

    Each page costs as the first one, the best per_page rows of each partition, when the
    keys of the row before it are handed in as `after`. A page by number alone is read from
    the places of all rows (functions.places); to turn many pages store the order once.
    """
    view = df
    if term and term.strip():
        needle = term.strip().lower()
        hits = [F.lower(F.col(c).cast("string")).contains(needle)
                for c in search_cols if c in df.columns]
        if hits:
            any_hit = hits[0]
            for h in hits[1:]:
                any_hit = F.coalesce(any_hit, F.lit(False)) | F.coalesce(h, F.lit(False))
            view = view.filter(any_hit)
    for column, allowed in (filters or {}).items():
        if allowed:
            view = view.filter(F.col(column).cast("string").isin(list(allowed)))
    order = {sort: ascending} if sort is not None and sort in df.columns else {}
    order |= {t: True for t in tie if t in df.columns and t != sort}
    keys = sort_keys(order)
    if after is not None:
        return view.filter(after_row(order, after)).orderBy(*keys).limit(per_page)
    if page <= 1:
        return view.orderBy(*keys).limit(per_page)
    first = (page - 1) * per_page
    placed = with_place(view, order, "_place").filter(F.col("_place").between(first + 1, first + per_page))
    return placed.orderBy("_place").select(*df.columns)
