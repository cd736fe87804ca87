"""Weighted baskets, every portfolio of the table in one job.

A basket's day counts only when every holding has a price and a return that day;
money goes in on the first fully priced session and returns start on the next.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..session import persist_table
from . import series as S
from .asof import bracket
from .ranges import _within


def normalize_weights(portfolios: DataFrame) -> DataFrame:
    """Weights that sum to one; a basket without positive weight is dropped.

    A symbol that a basket names twice is one holding with the sum of its weights.
    """
    portfolios = portfolios.groupBy("portfolio_id", "symbol").agg(F.sum("weight").alias("weight"))
    total = (portfolios.groupBy("portfolio_id").agg(F.sum("weight").alias("total"))
             .filter("total > 0"))
    return (portfolios.join(total, "portfolio_id")
            .select("portfolio_id", "symbol", (F.col("weight") / F.col("total")).alias("weight")))


def _holding_returns(bars, portfolios, start, end):
    """Dated returns of held symbols, one row per (portfolio, holding, session)."""
    held = bars.join(portfolios.select("symbol").distinct(), "symbol", "left_semi")
    return (_within(S.daily_returns(held), start, end)
            .join(portfolios, "symbol")
            .select("portfolio_id", "symbol", "weight", "date", "close", "daily_return"))


def joint_sessions(bars, portfolios, start, end, held: DataFrame | None = None) -> DataFrame:
    """Sessions on which every holding of a portfolio has a price; held may hand in _holding_returns."""
    sizes = portfolios.groupBy("portfolio_id").agg(F.count_distinct("symbol").alias("holdings"))
    r = F.col("daily_return")
    priced, returned = (F.when(c.isNotNull(), F.col("symbol")) for c in (F.col("close"), r))
    held = _holding_returns(bars, portfolios, start, end) if held is None else held
    days = held.groupBy("portfolio_id", "date").agg(
        F.count_distinct(priced).alias("priced"), F.count_distinct(returned).alias("returned"),
        F.sum(r * F.col("weight")).alias("port_return"))
    return days.join(sizes, "portfolio_id").filter("priced = holdings")


def basket_returns(bars, portfolios, start, end, held: DataFrame | None = None) -> DataFrame:
    """The daily weighted return after the investment date d0."""
    per = Window.partitionBy("portfolio_id")
    return (joint_sessions(bars, portfolios, start, end, held)
            .withColumn("d0", F.min("date").over(per))
            .filter("date > d0 and returned = holdings")
            .select("portfolio_id", "date", "d0", "port_return"))


def _per_portfolio():
    return Window.partitionBy("portfolio_id").orderBy("date")


def portfolio_series(bars, portfolios, start, end) -> DataFrame:
    grown = F.sum(G.log_growth(F.col("port_return"))).over(S.so_far(_per_portfolio()))
    return basket_returns(bars, portfolios, start, end).select(
        "portfolio_id", "date", "port_return", G.compounded(grown).alias("cumulative_return"))


def portfolio_stats(bars, portfolios, start, end) -> DataFrame:
    """One row per portfolio; a basket that never traded whole has zero sessions."""
    grown = F.sum(G.log_growth(F.col("port_return"))).over(S.so_far(_per_portfolio()))
    wealth = (basket_returns(bars, portfolios, start, end)
              .withColumn("wealth", G.exp_or_null(grown))
              .withColumn("peak", F.max("wealth").over(S.so_far(_per_portfolio()))))
    final, d0, d1 = F.max_by("wealth", "date"), F.min("d0"), F.max("date")
    stats = wealth.groupBy("portfolio_id").agg(
        F.count("*").alias("sessions"), d0.alias("first_date"), d1.alias("last_date"),
        (final - 1).alias("total_return"),
        G.growth_rate(F.lit(1.0), final, d0, d1).alias("cagr"),
        G.annualised(F.stddev_pop("port_return")).alias("ann_volatility"),
        F.min(G.change(F.col("wealth"), F.col("peak"))).alias("max_drawdown"),
        F.max("port_return").alias("best_day"), F.min("port_return").alias("worst_day"))
    return (portfolios.select("portfolio_id").distinct().join(stats, "portfolio_id", "left")
            .withColumn("sessions", F.coalesce("sessions", F.lit(0))))


def portfolio_contribution(bars, portfolios, symbols, start, end) -> DataFrame:
    """What each holding added. The terms of a basket sum to its total return.

    A holding's weighted return counts in proportion to the basket's wealth going
    into that session, so the compounding telescopes. The holdings' returns are
    written once, as the basket's wealth and the terms both come from them.
    """
    held = persist_table(_holding_returns(bars, portfolios, start, end), "holdings")
    before = _per_portfolio().rowsBetween(Window.unboundedPreceding, -1)
    opening = G.exp_or_null(F.coalesce(
        F.sum(G.log_growth(F.col("port_return"))).over(before), F.lit(0.0)))
    days = (basket_returns(bars, portfolios, start, end, held)
            .select("portfolio_id", "date", opening.alias("w_begin")))
    r = F.col("daily_return")
    terms = (held.filter(r.isNotNull())
             .join(days, ["portfolio_id", "date"])
             .groupBy("portfolio_id", "symbol", "weight").agg(
                 F.sum(r * F.col("weight") * F.col("w_begin")).alias("contribution"),
                 G.compounded(F.sum(G.log_growth(r))).alias("holding_return"),
                 F.count("*").alias("sessions")))
    return (terms.join(symbols.select("symbol", "name", "sector"), "symbol")
            .select("portfolio_id", "symbol", "name", "sector", "weight", "contribution",
                    "holding_return", "sessions"))


def portfolio_vs_index(bars, portfolios, start, end, index_symbol) -> DataFrame:
    """Basket against the index, both from the basket's first return date.

    The index needs its growth from a date on: the log growth up to the end less
    the log growth before that date, found by an as-of look-up of the few
    distinct first dates.
    """
    basket = persist_table(portfolio_series(bars, portfolios, start, end).groupBy("portfolio_id").agg(
        F.min("date").alias("date"), F.max_by("cumulative_return", "date").alias("basket_return")), "baskets")
    index = (_within(S.daily_returns(bars.filter(F.col("symbol") == index_symbol)), start, end)
             .filter(F.col("daily_return").isNotNull()))
    log = G.log_growth(F.col("daily_return"))
    before = F.coalesce(F.sum(log).over(
        S.sessions().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum(log).over(Window.partitionBy("symbol"))
    path = index.select("symbol", "date", before.alias("log_before"), whole.alias("log_total"))
    starts = basket.select(F.lit(index_symbol).alias("symbol"), "date").distinct()
    found = bracket(starts, path, ["log_before", "log_total"]).select("date", (G.exp_or_null(
        F.col("next.log_total") - F.col("next.log_before")) - 1).alias("index_return"))
    return (basket.join(found, "date", "left")
            .select("portfolio_id", F.col("date").alias("from_date"), "basket_return",
                    "index_return", (F.col("basket_return") - F.col("index_return")).alias("lead")))
