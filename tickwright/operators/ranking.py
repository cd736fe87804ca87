"""Scores from a metric registry: percentile ranks, category means, one composite.

A new metric is a panel column and a registry row. Every rank of every metric is
found in one job over the unpivoted panel, so a cross-section of any size spreads
over the cluster.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import with_place
from ..functions.ranks import grouped_percentile


@dataclass(frozen=True)
class Metric:
    key: str
    category: str
    higher_is_better: bool
    within_sector: bool = False
    optional: bool = False


# The categories and the metric registry (key, category, whether
# higher is better). Consensus metrics are optional: absent without that data.
CATEGORIES = ("Momentum", "Technical", "Risk", "Valuation", "Quality", "Profitability",
              "Growth", "Analyst")
METRICS = (
    Metric("ret_1m", "Momentum", False),
    Metric("ret_3m", "Momentum", True),
    Metric("mom_12_1", "Momentum", True),
    Metric("ret_5y", "Momentum", False),
    Metric("ma50_pos", "Technical", True),
    Metric("ma200_pos", "Technical", True),
    Metric("pct_52w_high", "Technical", True),
    Metric("rsi_14", "Technical", True),
    Metric("volume_trend", "Technical", True),
    Metric("vol_1y", "Risk", False),
    Metric("max_dd_1y", "Risk", True),
    Metric("beta_1y", "Risk", False),
    Metric("downside_dev", "Risk", False),
    Metric("dollar_volume", "Risk", True),
    Metric("pe", "Valuation", False, within_sector=True),
    Metric("ps", "Valuation", False, within_sector=True),
    Metric("pb", "Valuation", False, within_sector=True),
    Metric("fcf_yield", "Valuation", True, within_sector=True),
    Metric("debt_to_equity", "Quality", False),
    Metric("current_ratio", "Quality", True),
    Metric("interest_coverage", "Quality", True),
    Metric("earnings_stability", "Quality", True),
    Metric("roe", "Profitability", True),
    Metric("roa", "Profitability", True),
    Metric("gross_margin", "Profitability", True),
    Metric("net_margin", "Profitability", True),
    Metric("gross_profitability", "Profitability", True),
    Metric("revenue_growth", "Growth", True),
    Metric("earnings_growth", "Growth", True),
    Metric("fcf_growth", "Growth", True),
    Metric("analyst_score", "Analyst", True, optional=True),
    Metric("target_upside", "Analyst", True, optional=True),
    Metric("eps_revision", "Analyst", True, optional=True),
)
BY_KEY = {m.key: m for m in METRICS}

# Category weights per horizon, in the order of CATEGORIES.
_HORIZONS = {
    "Short-Term": (.30, .30, .20, .05, .05, 0, 0, .10),
    "Medium-Term": (.25, .15, .05, .10, .10, .15, .15, .05),
    "Long-Term": (.06, 0, .10, .22, .20, .22, .15, .05),
}
HORIZON_WEIGHTS = {h: dict(zip(CATEGORIES, w)) for h, w in _HORIZONS.items()}

# Metrics that carry a set share of their category.
METRIC_WEIGHTS = {
    "Short-Term": {"ret_1m": .35, "ret_3m": .45, "mom_12_1": .20, "ret_5y": 0.0},
    "Medium-Term": {"mom_12_1": .60, "ret_3m": .25, "ret_1m": .15, "ret_5y": 0.0},
    "Long-Term": {"ret_5y": .60, "mom_12_1": .40, "ret_1m": 0.0, "ret_3m": 0.0},
}

# Category multipliers per objective.
OBJECTIVES = {
    "Balanced": {},
    "Growth": {"Growth": 1.8, "Momentum": 1.4, "Valuation": .5},
    "Value": {"Valuation": 2.0, "Quality": 1.3, "Momentum": .6},
    "Income & Stability": {"Quality": 1.8, "Risk": 1.8, "Profitability": 1.2, "Momentum": .4},
    "Quality Compounders": {"Profitability": 1.8, "Quality": 1.5, "Growth": 1.2, "Technical": .5},
}

# Volatility bands, market-value bands and thresholds.
RISK_BANDS = {"Conservative": (0.0, .25), "Moderate": (0.0, .40), "Aggressive": None}
CAP_BANDS = {"Mega (>$200B)": (200e9, 1e15), "Large ($10B-$200B)": (10e9, 200e9),
             "Mid ($2B-$10B)": (2e9, 10e9), "Small (<$2B)": (0.0, 2e9)}
MIN_COVERAGE = 0.60
STRENGTH_AT, RISK_AT = 0.75, 0.25
SCORE_BANDS = ((75, "strong"), (55, "solid"), (40, "mixed"))


def validate_weights(horizons=None, overrides=None) -> None:
    """Refuse a weight table that lost a category, a metric or its unit sum."""
    for name, weights in (horizons or HORIZON_WEIGHTS).items():
        if set(weights) != set(CATEGORIES):
            raise ValueError(f"{name}: categories {sorted(set(weights) ^ set(CATEGORIES))}")
        if abs(sum(weights.values()) - 1.0) > 1e-9:
            raise ValueError(f"{name}: weights sum to {sum(weights.values())}")
    for name, chosen in (overrides or METRIC_WEIGHTS).items():
        if set(chosen) - set(BY_KEY):
            raise ValueError(f"{name}: unknown metric {sorted(set(chosen) - set(BY_KEY))}")


validate_weights()


def active_metrics(with_analyst: bool):
    return tuple(m for m in METRICS if with_analyst or not m.optional)


def metric_weight(horizon: str, metric: Metric) -> float:
    """Its set share, else an equal part of what the set shares leave over."""
    fixed = METRIC_WEIGHTS.get(horizon, {})
    if metric.key in fixed:
        return fixed[metric.key]
    members = [m.key for m in METRICS if m.category == metric.category]
    left = 1.0 - sum(fixed[k] for k in members if k in fixed)
    return max(left, 0.0) / len([k for k in members if k not in fixed])


def category_weights(horizon: str, objective: str = "Balanced", with_analyst: bool = True):
    """Horizon weights tilted by the objective, summing to one again."""
    tilt = OBJECTIVES.get(objective, {})
    raw = {c: 0.0 if c == "Analyst" and not with_analyst else w * tilt.get(c, 1.0)
           for c, w in HORIZON_WEIGHTS[horizon].items()}
    total = sum(raw.values())
    return {c: w / total for c, w in raw.items()} if total > 0 else dict(HORIZON_WEIGHTS[horizon])


def category_column(category: str) -> str:
    return "cat_" + category.lower()


def panel_filter(sectors=(), risk: str = "Aggressive", caps=(), min_price: float = 0.0) -> Column:
    """The peer set. It is applied before any rank, never to a ranked board."""
    keep = F.lit(True)
    band = RISK_BANDS.get(risk)
    if band:
        keep = keep & F.col("vol_1y").isNotNull() & F.col("vol_1y").between(*band)
    if min_price > 0:
        keep = keep & (F.col("last_close") >= min_price)
    if sectors:
        keep = keep & F.col("sector").isin(list(sectors))
    if caps:
        value = F.col("market_cap")
        inside = [(value >= lo) & (value < hi)
                  for lo, hi in (CAP_BANDS.get(c, (0.0, 1e15)) for c in caps)]
        keep = keep & reduce(lambda a, b: a | b, inside)
    return keep


def percentile_ranks(panel: DataFrame, metrics) -> DataFrame:
    """(symbol, metric, pr) for every present value; 1 is always the better end."""
    peers = {True: "coalesce(concat('sector ', sector), 'no sector')", False: "'all'"}
    cells = ", ".join(
        f"struct('{m.key}' AS metric, {peers[m.within_sector]} AS peers, "
        f"CAST({m.key} AS double) AS value, {str(m.higher_is_better).lower()} AS up)"
        for m in metrics)
    tall = panel.selectExpr("symbol", f"inline(array({cells}))").filter("value IS NOT NULL")
    ranked = grouped_percentile(tall, ["metric", "peers"], "value", "pr")
    return ranked.select("symbol", "metric",
                         F.when(F.col("up"), F.col("pr")).otherwise(1.0 - F.col("pr")).alias("pr"))


def rank_layer(panel: DataFrame, with_analyst: bool = False) -> DataFrame:
    """The panel plus one pr_<metric> column per active metric."""
    metrics = active_metrics(with_analyst)
    wide = percentile_ranks(panel, metrics).groupBy("symbol").agg(
        *[F.expr(f"max(CASE WHEN metric = '{m.key}' THEN pr END) AS pr_{m.key}") for m in metrics])
    return panel.join(wide, "symbol", "left")


def _present_mean(terms):
    """Weighted mean of the columns that are not NULL, and the weight they carry, as SQL."""
    value = " + ".join(f"coalesce({c} * {w!r}D, 0D)" for c, w in terms)
    weight = " + ".join(f"if({c} IS NULL, 0D, {w!r}D)" for c, w in terms)
    return f"(({value}) / nullif({weight}, 0D))", f"({weight})"


def category_score(ranked: DataFrame, horizon: str, with_analyst: bool = False,
                   categories=CATEGORIES) -> DataFrame:
    """Adds cat_<category>; NULL where the company has none of its metrics."""
    added = []
    for category in categories:
        terms = [(f"pr_{m.key}", float(metric_weight(horizon, m)))
                 for m in active_metrics(with_analyst)
                 if m.category == category and metric_weight(horizon, m) > 0]
        if terms:
            added.append(f"{_present_mean(terms)[0]} AS {category_column(category)}")
    return ranked.selectExpr("*", *added)


def score_board(panel: DataFrame, horizon: str, objective: str = "Balanced",
                with_analyst: bool = False, where: Column | None = None) -> DataFrame:
    """Filter, rank, score categories, and combine: coverage and overall_score."""
    peers = panel.filter("is_index = 0")
    if where is not None:
        peers = peers.filter(where)
    weights = {c: w for c, w in category_weights(horizon, objective, with_analyst).items() if w > 0}
    scored = category_score(rank_layer(peers, with_analyst), horizon, with_analyst, weights)
    terms = [(category_column(c), w) for c, w in weights.items()
             if category_column(c) in scored.columns]
    mean, coverage = _present_mean(terms)
    return scored.selectExpr("*", f"{coverage} AS coverage",
                             f"round(100D * {mean}, 1) AS overall_score")


def rankings(panel, horizon="Medium-Term", objective="Balanced", with_analyst=False,
             sectors=(), risk="Aggressive", caps=(), min_price=0.0, limit=25) -> DataFrame:
    """The board: companies scored on enough of the weight, best first."""
    board = (score_board(panel, horizon, objective, with_analyst,
                         panel_filter(sectors, risk, caps, min_price))
             .filter(F.col("coverage") >= MIN_COVERAGE)
             .orderBy(F.desc_nulls_last("overall_score"), "symbol"))
    return board.limit(limit) if limit >= 0 else board


def placed_rankings(panel, **choices) -> DataFrame:
    """The whole board with each company's place; equal scores go by symbol."""
    return with_place(rankings(panel, limit=-1, **choices), {"overall_score": False, "symbol": True})


def top_picks(panel, limit=5, with_analyst=False):
    return rankings(panel, limit=limit, with_analyst=with_analyst).select(
        "symbol", "name", "sector", "overall_score", "coverage")


def score_band(board: DataFrame) -> DataFrame:
    score = F.col("overall_score")
    band = F.lit("weak")
    for least, name in reversed(SCORE_BANDS):
        band = F.when(score >= least, name).otherwise(band)
    return board.select("symbol", "overall_score", F.when(score.isNotNull(), band).alias("band"))


def strengths_risks(board: DataFrame, with_analyst: bool = False, limit: int = 4) -> DataFrame:
    """Per company, the metrics in its top and bottom quartile, most decisive first.

    Percentiles equal to twelve digits tie, as one of them may be a difference from 1.
    """
    cells = F.array(*[F.struct(
        F.lit(i).alias("place"), F.lit(m.key).alias("metric"), F.lit(m.category).alias("category"),
        F.col(f"pr_{m.key}").alias("percentile"), F.col(m.key).cast("double").alias("value"))
        for i, m in enumerate(active_metrics(with_analyst))])
    pr = F.col("percentile")
    side = F.when(pr >= STRENGTH_AT, "strength").when(pr <= RISK_AT, "risk")
    decisive = F.round(F.when(pr >= STRENGTH_AT, -pr).otherwise(pr), 12)
    order = Window.partitionBy("symbol", "side").orderBy("decisive", "place")
    return (board.select("symbol", F.inline(cells)).withColumn("side", side)
            .filter(F.col("side").isNotNull()).withColumn("decisive", decisive)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
            .select("symbol", "side", "rank", "metric", "category", "percentile", "value"))


def category_breakdown(board, horizon, objective="Balanced", with_analyst=True) -> DataFrame:
    """Per company, each scored category with the weight it carried."""
    weights = category_weights(horizon, objective, with_analyst)
    cells = F.array(*[F.struct(
        F.lit(c).alias("category"),
        F.round(100.0 * F.col(category_column(c)), 1).alias("score"), F.lit(w).alias("weight"))
        for c, w in weights.items() if w > 0 and category_column(c) in board.columns])
    return (board.select("symbol", F.inline(cells)).filter(F.col("score").isNotNull())
            .sortWithinPartitions("symbol", F.desc("weight")))
