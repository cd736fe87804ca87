"""Cross-section answers over a date window: movers, sectors, breadth, statistics."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions.ranks import grouped_median
from ..session import persist_table
from . import series as S
from .ranges import _within

# Sort words a caller may use -> column sorted by.
MOVER_SORTS = {"return": "period_return", "volume": "avg_dollar_volume",
               "turnover": "avg_dollar_volume", "liquidity": "avg_dollar_volume"}
STATS_SORTS = {"cagr": "cagr", "return": "total_return", "volatility": "ann_volatility",
               "risk": "ann_volatility", "drawdown": "max_drawdown", "years": "years",
               "volume": "avg_dollar_volume", "turnover": "avg_dollar_volume"}

LEADERBOARD_COLUMNS = ("symbol", "name", "sector", "industry", "first_date", "last_date",
                       "years", "last_close", "last_daily_return", "total_return", "cagr",
                       "ann_volatility", "current_volatility", "max_drawdown",
                       "highest_close", "lowest_close", "avg_volume", "avg_dollar_volume")


def period_returns(bars: DataFrame, start, end) -> DataFrame:
    """First to last close of each symbol inside the window, in one aggregate."""
    opened, closed = F.min_by("close", "date"), F.max_by("close", "date")
    return _within(bars, start, end).groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("*").alias("sessions"), opened.alias("start_close"), closed.alias("end_close"),
        G.change(closed, opened).alias("period_return"),
        F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume"))


def _movers(bars, symbols, start, end):
    companies = symbols.filter("is_index = 0").select("symbol", "name", "sector")
    return companies.join(period_returns(bars, start, end), "symbol")


def _stored_movers(bars, symbols, start, end, *columns):
    """One written row a symbol, for answers that read it more than once: the bars are read once."""
    return persist_table(_movers(bars, symbols, start, end).select(*columns), "movers")


def _order(column, ascending, nulls_last=True):
    if nulls_last:
        return F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return F.asc(column) if ascending else F.desc(column)


def top(df: DataFrame, column: str, ascending: bool = False, limit: int = -1,
        tie: str = "symbol") -> DataFrame:
    """Ordered rows; with a limit, only the top rows of each partition travel."""
    ordered = df.orderBy(_order(column, ascending), F.asc(tie))
    return ordered.limit(limit) if limit >= 0 else ordered


def period_movers(bars, symbols, start, end):
    return top(_movers(bars, symbols, start, end), "period_return")


def period_movers_ranked(bars, symbols, start, end, sort="return", ascending=False,
                         sector="", limit=-1):
    rows = _movers(bars, symbols, start, end)
    if sector:
        rows = rows.filter(F.col("sector") == sector)
    return top(rows, MOVER_SORTS.get(sort, MOVER_SORTS["return"]), ascending, limit)


def leaderboard(stats: DataFrame) -> DataFrame:
    return top(stats.filter("is_index = 0").select(*LEADERBOARD_COLUMNS), "cagr")


def leaderboard_ranked(stats, sort="cagr", ascending=False, sector="", limit=-1):
    """Rows without the sort figure are left out, not listed first or last."""
    column = STATS_SORTS.get(sort, STATS_SORTS["cagr"])
    rows = stats.filter((F.col("is_index") == 0) & F.col(column).isNotNull())
    if sector:
        rows = rows.filter(F.col("sector") == sector)
    return top(rows.select(*LEADERBOARD_COLUMNS), column, ascending, limit)


def sector_performance(bars, symbols, start, end):
    """Two-level: a return per symbol, then the spread of returns per sector."""
    per_symbol = _stored_movers(bars, symbols, start, end, "sector", "period_return")
    spread = per_symbol.groupBy("sector").agg(
        F.count("*").alias("n_symbols"), F.avg("period_return").alias("avg_return"),
        F.min("period_return").alias("worst_return"),
        F.max("period_return").alias("best_return"))
    middle = grouped_median(per_symbol, ["sector"], "period_return", "median_return")
    joined = spread.alias("s").join(
        middle.alias("m"), F.col("s.sector").eqNullSafe(F.col("m.sector")), "left")
    return (joined.select("s.sector", "n_symbols", "median_return", "avg_return",
                          "worst_return", "best_return")
            .orderBy(F.desc_nulls_last("median_return"), "sector"))


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def market_breadth(bars, symbols, start, end):
    """One row: how many names rose, the median move, and the two ends."""
    moves = _stored_movers(bars, symbols, start, end, F.lit("all").alias("scope"), "symbol", "period_return")
    r = F.col("period_return")
    named = F.when(r.isNotNull(), F.struct(r, "symbol"))      # equal moves are told apart by name
    ends = moves.groupBy("scope").agg(
        F.sum((r > 0).cast("int")).alias("advancing"),
        F.sum((r < 0).cast("int")).alias("declining"), F.count("*").alias("n"),
        F.max_by("symbol", named).alias("best_symbol"), F.max(r).alias("best_return"),
        F.min_by("symbol", named).alias("worst_symbol"), F.min(r).alias("worst_return"))
    middle = grouped_median(moves, ["scope"], "period_return", "median_return")
    return one_row(ends.drop("scope"), middle.drop("scope"))


def window_stats(bars: DataFrame, start, end) -> DataFrame:
    """Headline figures per symbol for a window.

    Returns and peaks come from the whole record, so the first session of the
    window has its return and a drawdown is against the all-time high.
    """
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    d0, d1 = F.min("date"), F.max("date")
    return _within(S.with_features(bars), start, end).groupBy("symbol").agg(
        d0.alias("first_date"), d1.alias("last_date"), F.count("*").alias("trading_days"),
        first.alias("first_close"), last.alias("last_close"),
        G.change(last, first).alias("period_return"),
        F.max("high").alias("period_high"), F.min("low").alias("period_low"),
        F.max("close").alias("highest_close"), F.min("close").alias("lowest_close"),
        F.avg("volume").alias("avg_volume"),
        F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume"),
        G.annualised(F.stddev_pop("daily_return")).alias("ann_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        G.growth_rate(first, last, d0, d1).alias("cagr"))


def risk_return_points(stats):
    return (stats.filter("is_index = 0").select("symbol", "name", "sector", "ann_volatility", "cagr")
            .dropna(subset=["ann_volatility", "cagr"]))


def rolling_returns(bars: DataFrame, sessions=(252, 756, 1260, 2520)) -> DataFrame:
    """Every holding period of each length, from one sort of the record."""
    periods = [F.struct(F.lit(k).alias("sessions"),
                        F.lag("date", k).over(S.sessions()).alias("start_date"),
                        F.lag("close", k).over(S.sessions()).alias("base")) for k in sessions]
    names = [f"_p{k}" for k in sessions]
    rows = S.valid_closes(bars).select("symbol", "date", "close",
                                       *[p.alias(n) for p, n in zip(periods, names)])
    multiple = F.col("close") / F.col("base")
    return (rows.select("symbol", "date", "close", F.inline(F.array(*names)))
            .filter(F.col("base").isNotNull())
            .select("symbol", "sessions", "date", "start_date",
                    (multiple - 1).alias("window_return"),
                    (G.pow_or_null(multiple, F.lit(252.0) / F.col("sessions")) - 1)
                    .alias("annualized_return")))


def rolling_return_summary(rolling: DataFrame) -> DataFrame:
    """The spread of outcomes per symbol and horizon; one group is one record long."""
    r = F.col("annualized_return")
    return rolling.groupBy("symbol", "sessions").agg(
        F.count("*").alias("periods"), F.min(r).alias("worst"), F.max(r).alias("best"),
        F.avg(r).alias("mean_return"), F.median(r).alias("median_return"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("share_positive"),
        F.min(F.when(r.isNotNull(), F.struct(r, "date")))["date"].alias("worst_end_date"),
        F.max(F.when(r.isNotNull(), F.struct(r.alias("r"), (-F.unix_date("date")).alias("d"))))["d"]
        .alias("_best")) \
        .withColumn("best_end_date", F.date_from_unix_date(-F.col("_best"))).drop("_best")


# Span label -> days back from the newest session.
TRAILING_SPANS = {"1M": 30, "3M": 91, "6M": 182, "1Y": 365, "3Y": 1095, "5Y": 1826}


def trailing_performance(bars: DataFrame) -> DataFrame:
    """Return since the last close on or before each span's start, and since the first.

    The newest date comes from a window over the same per-symbol shuffle, so all
    spans are conditional picks of one aggregate.
    """
    newest = F.max("date").over(Window.partitionBy("symbol"))
    rows = (bars.filter(F.col("close").isNotNull())
            .select("symbol", "date", "close", newest.alias("end")))
    bases = [F.max_by("close", F.when(F.col("date") <= F.date_sub("end", n), F.col("date")))
             .alias(f"b{n}") for n in TRAILING_SPANS.values()]
    agg = rows.groupBy("symbol").agg(
        F.max_by("close", "date").alias("last"), F.min_by("close", "date").alias("first"),
        F.count("*").alias("n"), *bases).filter("n >= 2")
    spans = [F.struct(F.lit(label).alias("span"), F.col(f"b{n}").alias("base"))
             for label, n in TRAILING_SPANS.items()]
    spans.append(F.struct(F.lit("All").alias("span"), F.col("first").alias("base")))
    return (agg.select("symbol", "last", F.inline(F.array(*spans)))
            .filter("base <> 0")
            .select("symbol", "span", G.change(F.col("last"), F.col("base")).alias("trailing_return")))


def peer_pick(bars, symbols, start, end, peers: int = 2):
    """The most traded other names of each company's sector.

    Each sector's leaders are picked once (a grouped top-n, which trims inside
    every partition before the shuffle); a company then meets those few rows and
    drops itself, so no pair of companies is ever formed.
    """
    rows = _stored_movers(bars, symbols, start, end, "symbol", "sector", "avg_dollar_volume")
    by_volume = Window.partitionBy("sector").orderBy(F.desc_nulls_last("avg_dollar_volume"), "symbol")
    leaders = (rows.withColumn("rn", F.row_number().over(by_volume)).filter(F.col("rn") <= peers + 1)
               .select("sector", F.col("symbol").alias("peer"),
                       F.col("avg_dollar_volume").alias("peer_dollar_volume"), "rn"))
    own = Window.partitionBy("symbol").orderBy("rn")
    return (rows.select("symbol", "sector").join(leaders, "sector")
            .filter(F.col("peer") != F.col("symbol"))
            .withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= peers)
            .select("symbol", "sector", "rank", "peer", "peer_dollar_volume"))
