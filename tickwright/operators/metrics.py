"""The scored metrics of every company: prices, fundamentals and their panel."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions.places import with_place
from . import series as S
from .market import one_row

YEAR, QUARTER_BACK, MONTH_BACK, MONTH = 252, 64, 22, 21


def index_returns(index_bars: DataFrame) -> DataFrame:
    """Dated returns of one index: at most one row per calendar day."""
    return (S.daily_returns(index_bars).filter(F.col("daily_return").isNotNull())
            .select("date", F.col("daily_return").alias("ir")))


def price_metrics(bars: DataFrame, index_bars: DataFrame) -> DataFrame:
    """Every price metric per symbol: one shuffle by symbol, one aggregate.

    Sessions and returns are counted from the newest, so "22 sessions ago" is a
    condition inside the aggregate. The index is a single series with a row a day,
    whatever the number of symbols; its join has no hint, so Spark checks its size.
    """
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    counted = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (bars.select("symbol", "date", "close", "high", "volume",
                        F.row_number().over(newest).alias("rn"),
                        G.change(F.col("close"), F.lead("close").over(newest)).alias("r"))
            .withColumn("k", F.count("r").over(counted))
            .withColumn("in_year", F.col("rn") <= YEAR)
            .withColumn("peak", F.max("close").over(S.so_far(S.sessions("in_year"))))
            .join(index_returns(index_bars), "date", "left"))
    rn, r, ir = F.col("rn"), F.col("r"), F.col("ir")
    in_year = F.col("in_year")
    r_year = F.when(F.col("k") <= YEAR, r)
    r_14 = F.when((F.col("k") <= 14) & r.isNotNull(), r)
    gain = F.avg(F.when(r_14 > 0, r_14).when(r_14.isNotNull(), 0.0))
    loss = F.avg(F.when(r_14 < 0, -r_14).when(r_14.isNotNull(), 0.0))

    def close_at(n):
        return F.max(F.when(rn == n, F.col("close")))

    def tail_mean(x, n):
        return F.avg(F.when(rn <= n, x))

    agg = rows.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count("*").alias("sessions"), F.min_by("close", "date").alias("first_close"),
        F.max_by("close", "date").alias("last_close"),
        close_at(MONTH_BACK).alias("c_1m"), close_at(QUARTER_BACK).alias("c_3m"),
        close_at(YEAR + 1).alias("c_12m"),
        tail_mean(F.col("close") * F.col("volume"), YEAR).alias("dollar_volume"),
        F.max(F.when(in_year, F.col("high"))).alias("high_252"),
        tail_mean(F.col("volume"), YEAR).alias("vol_252"),
        tail_mean(F.col("volume"), MONTH).alias("vol_21"),
        tail_mean(F.col("close"), 50).alias("ma_50"), tail_mean(F.col("close"), 200).alias("ma_200"),
        F.count(r_year).alias("n_returns"), F.stddev_pop(r_year).alias("dev"),
        F.avg(F.when(r_year < 0, r_year * r_year)).alias("mean_sq_neg"),
        gain.alias("gain"), loss.alias("loss"),
        F.min(F.when(in_year, G.change(F.col("close"), F.col("peak")))).alias("max_dd_1y"),
        G.ratio(F.covar_pop(r_year, ir), F.var_pop(F.when(r_year.isNotNull(), ir))).alias("beta_1y"))
    last = F.col("last_close")
    rsi = (F.when((F.col("loss") == 0) & (F.col("gain") > 0), 100.0)
           .when(F.col("loss") == 0, 50.0)
           .otherwise(100.0 - 100.0 / (1.0 + G.ratio("gain", "loss"))))
    return agg.select(
        "symbol", "first_date", "last_date", "sessions", "last_close",
        G.change(last, F.col("c_1m")).alias("ret_1m"),
        G.change(last, F.col("c_3m")).alias("ret_3m"),
        G.change(F.col("c_1m"), F.col("c_12m")).alias("mom_12_1"),
        F.when(F.col("sessions") >= 1200, G.change(last, F.col("first_close"))).alias("ret_5y"),
        (G.ratio("last_close", "ma_50") - 1).alias("ma50_pos"),
        (G.ratio("last_close", "ma_200") - 1).alias("ma200_pos"),
        (G.ratio("last_close", "high_252") - 1).alias("pct_52w_high"), rsi.alias("rsi_14"),
        G.ratio("vol_21", "vol_252").alias("volume_trend"),
        F.when(F.col("n_returns") >= 200, G.annualised(F.col("dev"))).alias("vol_1y"),
        "max_dd_1y", "beta_1y",
        G.annualised(F.sqrt(F.coalesce("mean_sq_neg", F.lit(0.0)))).alias("downside_dev"),
        "dollar_volume")


def agg_beta(bars, index_bars):
    return price_metrics(bars, index_bars).select("symbol", "beta_1y")


def _with_ratios(df: DataFrame) -> DataFrame:
    """Ratios from fundamentals and last_close; one whose sign would flip its meaning is NULL.

    A loss does not make a low price-earnings ratio, and growth from a negative
    base says nothing, so each is computed over a positive denominator only.
    """
    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    base = (df.withColumn("market_cap", F.col("shares_outstanding") * F.col("last_close"))
            .withColumn("fcf", F.col("ocf") - zero("capex"))
            .withColumn("fcf_prior", F.col("ocf_prior") - zero("capex_prior"))
            .withColumn("debt", zero("long_term_debt") + zero("short_term_debt")))

    def over(top, bottom):
        return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom))

    ratios = {
        "pe": over("market_cap", "net_income"), "ps": over("market_cap", "revenue"),
        "pb": over("market_cap", "equity"), "fcf_yield": over("fcf", "market_cap"),
        "debt_to_equity": over("debt", "equity"),
        "current_ratio": over("assets_current", "liabilities_current"),
        "interest_coverage": over("operating_income", "interest_expense"),
        "roe": over("net_income", "equity"), "roa": over("net_income", "assets"),
        "gross_margin": over("gross_profit", "revenue"),
        "net_margin": over("net_income", "revenue"),
        "gross_profitability": over("gross_profit", "assets"),
        "revenue_growth": over("revenue", "revenue_prior") - 1,
        "earnings_growth": over("net_income", "net_income_prior") - 1,
        "fcf_growth": over("fcf", "fcf_prior") - 1,
    }
    return base.withColumns(ratios)


RATIOS = ("pe", "ps", "pb", "fcf_yield", "debt_to_equity", "current_ratio", "interest_coverage",
          "roe", "roa", "gross_margin", "net_margin", "gross_profitability", "revenue_growth",
          "earnings_growth", "fcf_growth")
_REPORTED = ("shares_outstanding", "earnings_stability", "revenue", "net_income", "assets", "equity")


def fundamental_ratios(fundamentals: DataFrame, prices: DataFrame) -> DataFrame:
    joined = fundamentals.join(prices.select("symbol", "last_close"), "symbol")
    return _with_ratios(joined).select("symbol", "asof", "market_cap", *_REPORTED, *RATIOS)


def metric_panel(universe, prices, fundamentals, analyst) -> DataFrame:
    """One row per priced company: what the scores read and the filters use.

    Ratios are columns over the joined row, so the price metrics are read once.
    """
    joined = (universe.select("symbol", "name", "sector", "exchange", F.lit(0).alias("is_index"))
              .join(prices.drop("first_date"), "symbol")
              .join(fundamentals.drop("cik").withColumnRenamed("asof", "fundamentals_asof"),
                    "symbol", "left")
              .join(analyst.drop("fetched"), "symbol", "left"))
    metrics = [c for c in prices.columns if c not in ("symbol", "first_date")]
    return _with_ratios(joined).select(
        "symbol", "name", "sector", "exchange", "is_index", *metrics, "market_cap",
        "fundamentals_asof", *RATIOS, *_REPORTED,
        "analyst_score", "target_upside", "eps_revision", "n_analysts")


def coverage_status(universe, bars, fundamentals, analyst) -> DataFrame:
    """One row: what the wide tables hold."""
    return one_row(
        universe.agg(F.count("*").alias("n_symbols")),
        bars.agg(F.count_distinct("symbol").alias("n_priced"), F.max("date").alias("last_date")),
        fundamentals.agg(F.count("asof").alias("n_fundamentals"),
                         F.max("asof").alias("fundamentals_asof")),
        analyst.agg(F.count("*").alias("n_analyst")))


def sector_coverage(panel: DataFrame, least: int = 3) -> DataFrame:
    return (panel.filter("sector is not null and sector <> ''").groupBy("sector")
            .agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy("sector"))


def panel_row(panel: DataFrame, symbol: str) -> DataFrame:
    return panel.filter(F.col("symbol") == symbol)


def universe_by_size(panel: DataFrame) -> DataFrame:
    """Companies with their place by size, the largest first; those without a size come last."""
    return with_place(panel.select("symbol", "name", "sector", "exchange", "last_close", "market_cap",
                                   "dollar_volume", "vol_1y", "last_date"), {"market_cap": False, "symbol": True})
