"""Registered queries over metrics, fundamentals, the universe and scores."""

from pyspark.sql import functions as F

from ..operators import facts as X
from ..operators import metrics as M
from ..operators import ranking as K
from ..operators import universe as V
from .checks import Check
from .oracle import VIEWS

VIEWS["v_stock_r"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM v_ret
WHERE r IS NOT NULL AND symbol <> 'MARKET'
"""
VIEWS["v_pm"] = """
SELECT b.*, x.vol_1y, x.downside_dev, x.beta_1y, d.max_dd_1y,
       CASE WHEN x.loss = 0 AND x.gain > 0 THEN 100 WHEN x.loss = 0 THEN 50
            ELSE 100 - 100 / (1 + x.gain / x.loss) END AS rsi_14
FROM (
  SELECT symbol, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS sessions,
    ARG_MAX(close, date) AS last_close,
    ARG_MAX(close, date) / MAX(close) FILTER (WHERE rn = 22) - 1 AS ret_1m,
    ARG_MAX(close, date) / MAX(close) FILTER (WHERE rn = 64) - 1 AS ret_3m,
    MAX(close) FILTER (WHERE rn = 22) / MAX(close) FILTER (WHERE rn = 253) - 1 AS mom_12_1,
    CASE WHEN COUNT(*) >= 1200 THEN ARG_MAX(close, date) / ARG_MIN(close, date) - 1 END AS ret_5y,
    ARG_MAX(close, date) / AVG(close) FILTER (WHERE rn <= 50) - 1 AS ma50_pos,
    ARG_MAX(close, date) / AVG(close) FILTER (WHERE rn <= 200) - 1 AS ma200_pos,
    ARG_MAX(close, date) / MAX(high) FILTER (WHERE rn <= 252) - 1 AS pct_52w_high,
    AVG(volume) FILTER (WHERE rn <= 21) / AVG(volume) FILTER (WHERE rn <= 252) AS volume_trend,
    AVG(close * volume) FILTER (WHERE rn <= 252) AS dollar_volume
  FROM v_seqn WHERE symbol <> 'MARKET' GROUP BY symbol) b
LEFT JOIN (
  SELECT s.symbol, CASE WHEN COUNT(*) >= 200 THEN STDDEV_POP(s.r) * SQRT(252) END AS vol_1y,
    SQRT(COALESCE(AVG(s.r * s.r) FILTER (WHERE s.r < 0), 0)) * SQRT(252) AS downside_dev,
    COVAR_POP(s.r, i.r) / NULLIF(VAR_POP(i.r), 0) AS beta_1y,
    AVG(GREATEST(s.r, 0)) FILTER (WHERE s.k <= 14) AS gain,
    AVG(GREATEST(-s.r, 0)) FILTER (WHERE s.k <= 14) AS loss
  FROM v_stock_r s LEFT JOIN v_ret i ON i.symbol = 'MARKET' AND i.date = s.date AND i.r IS NOT NULL
  WHERE s.k <= 252 GROUP BY s.symbol) x ON x.symbol = b.symbol
LEFT JOIN (
  SELECT symbol, MIN(close / pk - 1) AS max_dd_1y FROM (
    SELECT symbol, close, MAX(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk
    FROM v_seqn WHERE rn <= 252) GROUP BY symbol) d ON d.symbol = b.symbol
"""
_OVER = {
    "pe": "mc / net_income", "ps": "mc / revenue", "pb": "mc / equity", "fcf_yield": "fcf / mc",
    "debt_to_equity": "debt / equity", "current_ratio": "assets_current / liabilities_current",
    "interest_coverage": "operating_income / interest_expense", "roe": "net_income / equity",
    "roa": "net_income / assets", "gross_margin": "gross_profit / revenue",
    "net_margin": "net_income / revenue", "gross_profitability": "gross_profit / assets",
    "revenue_growth": "revenue / revenue_prior - 1",
    "earnings_growth": "net_income / net_income_prior - 1", "fcf_growth": "fcf / fcf_prior - 1",
}


def _guarded(expr):
    bottom = expr.split("/")[1].split("-")[0].strip()
    return f"CASE WHEN {bottom} > 0 THEN {expr} END"


VIEWS["v_fr"] = f"""
SELECT symbol, asof, mc AS market_cap, shares_outstanding, earnings_stability, revenue, net_income,
       assets, equity, {', '.join(f'{_guarded(e)} AS {k}' for k, e in _OVER.items())}
FROM (SELECT f.*, f.shares_outstanding * p.last_close AS mc, f.ocf - COALESCE(f.capex, 0) AS fcf,
             f.ocf_prior - COALESCE(f.capex_prior, 0) AS fcf_prior,
             COALESCE(f.long_term_debt, 0) + COALESCE(f.short_term_debt, 0) AS debt
      FROM fx_fundamentals f JOIN v_pm p ON p.symbol = f.symbol)
"""
VIEWS["v_panel"] = """
SELECT u.symbol, u.name, u.sector, u.exchange, p.* EXCLUDE (symbol), f.* EXCLUDE (symbol, asof),
       f.asof AS fundamentals_asof
FROM fx_universe u JOIN v_pm p ON p.symbol = u.symbol LEFT JOIN v_fr f ON f.symbol = u.symbol
"""

_PRICE = ("ret_1m~8 ret_3m~8 mom_12_1~8 ret_5y~8 ma50_pos~8 ma200_pos~8 pct_52w_high~8 rsi_14~6 "
          "volume_trend~8 vol_1y~8 max_dd_1y~8 beta_1y~8 downside_dev~8 dollar_volume~2")
_RATIO = " ".join(f"{k}~8" for k in _OVER)


#: The panel of parts: a cross-section that grows with the tables.
VIEWS["v_wide"] = f"""
SELECT 'P' || k AS symbol, p_name AS name, CASE WHEN k % 40 > 0 THEN p_brand END AS sector, '' AS exchange,
       p_retailprice AS last_close, b8 * 1000000.0 AS market_cap,
       {', '.join(f"CASE WHEN k % {i + 7} <> 3 THEN CAST(b{i % 9} AS DOUBLE) / CAST(b{(5 * i + 2) % 9} + 1 AS DOUBLE) END AS {m.key}"
                  for i, m in enumerate(K.METRICS))}
FROM fx_parts
"""


def _ranked_sql(horizon, where="TRUE", with_analyst=False):
    """Ranks over non-null values only, then the same registry as plain SQL."""
    metrics = K.active_metrics(with_analyst)

    def rank(m):
        part = f"PARTITION BY {m.key} IS NULL" + (", sector" if m.within_sector else "")
        n = f"COUNT(*) OVER ({part})"
        pct = f"PERCENT_RANK() OVER ({part} ORDER BY {m.key})"
        value = pct if m.higher_is_better else f"1 - {pct}"
        return f"CASE WHEN {m.key} IS NOT NULL AND {n} > 1 THEN {value} END AS pr_{m.key}"

    return f"SELECT *, {', '.join(rank(m) for m in metrics)} FROM v_wide WHERE {where}"


def _mean_sql(terms):
    up = " + ".join(f"COALESCE({c} * {w!r}, 0)" for c, w in terms)
    down = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {w!r} ELSE 0 END" for c, w in terms)
    return f"({up}) / NULLIF({down}, 0)", f"({down})"


def _board_sql(horizon, objective, where="TRUE", with_analyst=False):
    weights = K.category_weights(horizon, objective, with_analyst)
    cats = []
    for c in K.CATEGORIES:
        terms = [(f"pr_{m.key}", K.metric_weight(horizon, m)) for m in K.active_metrics(with_analyst)
                 if m.category == c and K.metric_weight(horizon, m) > 0]
        if terms and weights[c] > 0:
            cats.append((c, f"{_mean_sql(terms)[0]} AS {K.category_column(c)}"))
    mean, coverage = _mean_sql([(K.category_column(c), weights[c]) for c, _ in cats])
    return (f"SELECT *, {coverage} AS coverage, ROUND(100 * {mean}, 1) AS overall_score FROM "
            f"(SELECT *, {', '.join(x for _, x in cats)} FROM ({_ranked_sql(horizon, where, with_analyst)}))")


_PR = " ".join(f"pr_{m.key}~8" for m in K.active_metrics(False))
_MEDIUM = _board_sql("Medium-Term", "Balanced")
_VALUE = _board_sql("Long-Term", "Value", "sector IN ('Brand#2', 'Brand#17') AND last_close >= 901")
_WITH_ANALYST = _board_sql("Short-Term", "Growth", with_analyst=True)
_BOARD = ("symbol name sector " + _PR
          + " cat_momentum~8 cat_valuation~8 cat_growth~8 coverage~8 overall_score~1")

VIEWS["v_frames"] = """
SELECT 'revenue' AS frame, CAST(s_nationkey AS BIGINT) AS cik, SUM(l_extendedprice) AS val
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 2
UNION ALL
SELECT 'assets', CAST(c_nationkey AS BIGINT), SUM(o_totalprice) FROM orders
JOIN customer ON o_custkey = c_custkey GROUP BY 2
"""
VIEWS["v_directory"] = """
SELECT DISTINCT CONCAT('T', CAST(n_nationkey AS VARCHAR), CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-B'
       WHEN 2 THEN '-PK' WHEN 3 THEN '-WS' ELSE '-7' END) AS symbol, CAST(n_nationkey AS BIGINT) AS cik,
       n_name AS name, 'NYSE' AS exchange
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""
_COMMON_LINE = "symbol NOT LIKE '%-%' OR regexp_matches(symbol, '^[^-]*-[A-Za-z]$') OR NOT regexp_matches(symbol, '^[^-]*-[PWRU]')"
_TOP = 12
VIEWS["v_screen"] = f"""
SELECT cik, SUM((n - place) / n) AS score FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY frame) AS n FROM (
    SELECT frame, cik, ROW_NUMBER() OVER (PARTITION BY frame ORDER BY val DESC, cik) - 1 AS place FROM v_frames)
  WHERE place < {_TOP}) GROUP BY cik
"""


def _frames(f):
    li, s, o, c = (f.table(t) for t in ("lineitem", "supplier", "orders", "customer"))
    revenue = (li.join(s, li.l_suppkey == s.s_suppkey).groupBy(F.col("s_nationkey").cast("long").alias("cik"))
               .agg(F.sum("l_extendedprice").alias("val")).withColumn("frame", F.lit("revenue")))
    assets = (o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("cik"))
              .agg(F.sum("o_totalprice").alias("val")).withColumn("frame", F.lit("assets")))
    return revenue.unionByName(assets)


def _directory(f):
    s, n = f.table("supplier"), f.table("nation")
    k = F.col("s_suppkey") % 5
    tail = F.when(k == 0, "").when(k == 1, "-B").when(k == 2, "-PK").when(k == 3, "-WS").otherwise("-7")
    return (s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string"), tail).alias("symbol"),
        F.col("n_nationkey").cast("long").alias("cik"), F.col("n_name").alias("name"),
        F.lit("NYSE").alias("exchange")).distinct())


def _forced(f):
    return f.table("nation").filter("n_nationkey % 9 = 0").select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string"), F.lit("-PK")).alias("symbol"))


_TAGS = {"revenue": ("NoSuchTag", "Revenues"), "net_income": ("Revenues",), "assets": ("Assets",),
         "liabilities": ("NoSuchTag",)}

# One row per (company, tag, period end) and kind, the last filed value of each.
VIEWS["v_fact_span"] = """
SELECT *, CASE WHEN start IS NULL THEN NULL ELSE (year(end_) - year(start)) * 365
         + (month(end_) - month(start)) * 30 + day(end_) - day(start) END AS span,
       (year(end_) - year(start)) * 12 + month(end_) - month(start) AS months FROM fx_facts
"""
VIEWS["v_kind"] = """
SELECT cik, tag, kind, end_, ARG_MAX(val, filed) AS val,
       ROW_NUMBER() OVER (PARTITION BY cik, tag, kind ORDER BY end_ DESC) AS k
FROM (SELECT *, 'year' AS kind FROM v_fact_span WHERE span BETWEEN 330 AND 400
      UNION ALL SELECT *, 'quarter' FROM v_fact_span WHERE span BETWEEN 80 AND 100
      UNION ALL SELECT *, 'near' FROM v_fact_span WHERE months BETWEEN 2 AND 4
      UNION ALL SELECT *, 'level' FROM v_fact_span WHERE start IS NULL)
GROUP BY 1, 2, 3, 4
"""
VIEWS["v_ttm"] = """
SELECT cik, CASE WHEN ny > 0 THEN y1 WHEN nq >= 4 THEN q1 END AS current,
       CASE WHEN ny > 1 THEN y2 WHEN ny = 0 AND nq >= 8 THEN q2 END AS prior
FROM (SELECT cik, COUNT(*) FILTER (WHERE kind = 'year') AS ny, COUNT(*) FILTER (WHERE kind = 'quarter') AS nq,
        SUM(val) FILTER (WHERE kind = 'year' AND k = 1) AS y1, SUM(val) FILTER (WHERE kind = 'year' AND k = 2) AS y2,
        SUM(val) FILTER (WHERE kind = 'quarter' AND k <= 4) AS q1,
        SUM(val) FILTER (WHERE kind = 'quarter' AND k BETWEEN 5 AND 8) AS q2
      FROM v_kind WHERE tag = 'Revenues' GROUP BY cik)
"""
VIEWS["v_steady"] = """
SELECT cik, CASE WHEN COUNT(*) >= 8 THEN 1 / (1 + STDDEV_POP(val) / ABS(AVG(val))) END AS earnings_stability
FROM v_kind WHERE tag = 'Revenues' AND kind = 'near' AND k <= 20 GROUP BY cik
"""


def _sic(f):
    return f.table("part").select("p_partkey", (F.col("p_size") * 173).cast("string").alias("sic"))


_SIC_RANGES_SQL = ", ".join(f"({lo}, {hi}, '{s}')" for lo, hi, s in V.SIC_RANGES)
_SIC_SINGLE_SQL = ", ".join(f"({c}, '{s}')" for c, s in V.SIC_OVERRIDES)
_SIC_SQL = f"""
SELECT p.p_partkey, CAST(p.p_size * 173 AS VARCHAR) AS sic, COALESCE(o.s, r.s, 'Unclassified') AS sector
FROM part p LEFT JOIN (VALUES {_SIC_SINGLE_SQL}) AS o(c, s) ON o.c = p.p_size * 173
LEFT JOIN (VALUES {_SIC_RANGES_SQL}) AS r(lo, hi, s) ON p.p_size * 173 BETWEEN r.lo AND r.hi
"""

CHECKS = [
    Check("price_metrics", "symbol first_date@ last_date@ sessions# last_close~6 " + _PRICE,
          lambda f: f.price_metrics, "SELECT * FROM v_pm"),
    Check("agg_beta", "symbol beta_1y~8", lambda f: M.agg_beta(f.stocks, f.index_bars),
          "SELECT symbol, beta_1y FROM v_pm"),
    Check("agg_rsi14", "symbol rsi_14~6", lambda f: f.price_metrics, "SELECT * FROM v_pm"),
    Check("agg_downside", "symbol downside_dev~8", lambda f: f.price_metrics, "SELECT * FROM v_pm"),
    Check("max_dd_1y", "symbol max_dd_1y~8", lambda f: f.price_metrics, "SELECT * FROM v_pm"),
    Check("agg_pivot_anchor", "symbol ret_1m~8 ret_3m~8 mom_12_1~8", lambda f: f.price_metrics,
          "SELECT * FROM v_pm"),
    Check("agg_tail_means", "symbol ma50_pos~8 ma200_pos~8 volume_trend~8 dollar_volume~2",
          lambda f: f.price_metrics, "SELECT * FROM v_pm"),
    Check("join_index_beta", "symbol date@ r~8 ir~8",
          lambda f: _with_index(f),
          "SELECT s.symbol, s.date, s.r, i.r AS ir FROM v_stock_r s JOIN v_ret i ON i.symbol = 'MARKET' "
          "AND i.date = s.date AND i.r IS NOT NULL"),
    Check("fundamental_ratios", "symbol asof@ market_cap~2 revenue~2 net_income~2 assets~2 equity~2 " + _RATIO,
          lambda f: M.fundamental_ratios(f.fundamentals, f.price_metrics), "SELECT * FROM v_fr"),
    Check("metric_panel", "symbol name sector exchange last_date@ last_close~6 sessions# market_cap~2 "
          "fundamentals_asof@ " + _PRICE + " " + _RATIO, lambda f: f.panel, "SELECT * FROM v_panel"),
    Check("join_fan_in", "symbol sessions# vol_1y~8 pe~8 roe~8", lambda f: f.panel, "SELECT * FROM v_panel"),
    Check("join_left_optional", "symbol pe~8 analyst_score~8 target_upside~8", lambda f: f.panel,
          "SELECT p.symbol, p.pe, a.analyst_score, a.target_upside FROM v_panel p LEFT JOIN fx_analyst a USING (symbol)"),
    Check("panel_row", "symbol name sector pe~8 vol_1y~8", lambda f: M.panel_row(f.panel, "NATION_6"),
          "SELECT * FROM v_panel WHERE symbol = 'NATION_6'"),
    Check("universe_by_size", "symbol name sector exchange last_close~6 market_cap~2 dollar_volume~2 "
          "vol_1y~8 last_date@", lambda f: M.universe_by_size(f.panel), "SELECT * FROM v_panel"),
    Check("nulls_last_sort", "symbol market_cap~2 place#",
          lambda f: M.universe_by_size(f.panel).select("symbol", "market_cap", "place"),
          "SELECT symbol, market_cap, ROW_NUMBER() OVER (ORDER BY market_cap DESC NULLS LAST, symbol) AS place FROM v_panel"),
    Check("intel_status", "n_symbols# n_priced# n_fundamentals# n_analyst# last_date@ fundamentals_asof@",
          lambda f: M.coverage_status(f.universe, f.stocks, f.fundamentals, f.analyst),
          """SELECT (SELECT COUNT(*) FROM fx_universe) AS n_symbols,
                    (SELECT COUNT(DISTINCT symbol) FROM fx_bars WHERE symbol <> 'MARKET') AS n_priced,
                    (SELECT COUNT(asof) FROM fx_fundamentals) AS n_fundamentals, (SELECT COUNT(*) FROM fx_analyst) AS n_analyst,
                    (SELECT MAX(date) FROM fx_bars WHERE symbol <> 'MARKET') AS last_date,
                    (SELECT MAX(asof) FROM fx_fundamentals) AS fundamentals_asof"""),
    Check("sector_coverage", "sector n#", lambda f: M.sector_coverage(f.panel),
          "SELECT sector, COUNT(*) AS n FROM v_panel GROUP BY sector HAVING COUNT(*) >= 3"),
    Check("panel_filter", "symbol sector last_close~6 vol_1y~8 market_cap~2",
          lambda f: f.panel.filter(K.panel_filter(("ASIA", "AFRICA", "EUROPE"), "Aggressive",
                                                  ("Small (<$2B)", "Mega (>$200B)"), 940.0)),
          "SELECT * FROM v_panel WHERE sector IN ('ASIA', 'AFRICA', 'EUROPE') "
          "AND last_close >= 940 AND market_cap >= 0 AND market_cap < 2e9"),
    Check("percentile_rank_nullsafe", "symbol metric pr~8",
          lambda f: K.percentile_ranks(f.part_panel, [K.BY_KEY[k] for k in ("pe", "vol_1y", "rsi_14", "ret_5y")]),
          " UNION ALL ".join(
              f"SELECT symbol, '{k}' AS metric, pr_{k} AS pr FROM ({_ranked_sql('Medium-Term')}) WHERE {k} IS NOT NULL"
              for k in ("pe", "vol_1y", "rsi_14", "ret_5y"))),
    Check("rank_layer", "symbol " + _PR, lambda f: K.rank_layer(f.part_panel), _ranked_sql("Medium-Term")),
    Check("category_score", "symbol cat_momentum~8 cat_technical~8 cat_risk~8 cat_growth~8",
          lambda f: K.category_score(K.rank_layer(f.part_panel), "Medium-Term"), _MEDIUM),
    Check("score_board", _BOARD, lambda f: K.score_board(f.part_panel, "Medium-Term"), _MEDIUM),
    Check("rankings", "symbol name sector coverage~8 overall_score~1",
          lambda f: K.rankings(f.part_panel, "Long-Term", "Value", sectors=("Brand#2", "Brand#17"),
                               min_price=901.0, limit=6),
          f"SELECT * FROM ({_VALUE}) WHERE coverage >= 0.6 ORDER BY overall_score DESC NULLS LAST, symbol LIMIT 6"),
    Check("board_tiebreak", "symbol overall_score~1 place#",
          lambda f: K.placed_rankings(f.part_panel),
          f"""SELECT *, ROW_NUMBER() OVER (ORDER BY overall_score DESC NULLS LAST, symbol) AS place
              FROM ({_MEDIUM}) WHERE coverage >= 0.6"""),
    Check("top_picks", "symbol name sector overall_score~1 coverage~8",
          lambda f: K.top_picks(f.part_panel, 5),
          f"SELECT * FROM ({_MEDIUM}) WHERE coverage >= 0.6 ORDER BY overall_score DESC NULLS LAST, symbol LIMIT 5"),
    Check("score_band", "symbol overall_score~1 band",
          lambda f: K.score_band(K.score_board(f.part_panel, "Medium-Term")),
          f"""SELECT symbol, overall_score, CASE WHEN overall_score >= 75 THEN 'strong'
                WHEN overall_score >= 55 THEN 'solid' WHEN overall_score >= 40 THEN 'mixed'
                WHEN overall_score IS NOT NULL THEN 'weak' END AS band FROM ({_MEDIUM})"""),
    Check("strengths_risks", "symbol side rank# metric category percentile~8 value~6",
          lambda f: K.strengths_risks(K.rank_layer(f.part_panel)),
          "SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol, side ORDER BY ROUND(CASE side WHEN 'risk' THEN percentile ELSE -percentile END, 12), place) AS rank FROM ("
          + " UNION ALL ".join(
              f"SELECT symbol, {i} AS place, '{m.key}' AS metric, '{m.category}' AS category, "
              f"pr_{m.key} AS percentile, CAST({m.key} AS DOUBLE) AS value, "
              f"CASE WHEN pr_{m.key} >= 0.75 THEN 'strength' WHEN pr_{m.key} <= 0.25 THEN 'risk' END AS side "
              f"FROM v_all_ranks" for i, m in enumerate(K.active_metrics(False)))
          + ") WHERE side IS NOT NULL QUALIFY rank <= 4"),
    Check("category_breakdown", "symbol category score~1 weight~8",
          lambda f: K.category_breakdown(K.score_board(f.part_panel, "Medium-Term"), "Medium-Term",
                                         with_analyst=False),
          " UNION ALL ".join(
              f"SELECT symbol, '{c}' AS category, ROUND(100 * {K.category_column(c)}, 1) AS score, "
              f"{w!r} AS weight FROM v_medium WHERE {K.category_column(c)} IS NOT NULL"
              for c, w in K.category_weights("Medium-Term", "Balanced", False).items() if w > 0)),
    Check("analyst_board", "symbol sector coverage~8 overall_score~1 cat_analyst~8",
          lambda f: K.score_board(f.part_panel, "Short-Term", "Growth", with_analyst=True), _WITH_ANALYST),
    Check("flatten_facts", "cik# taxonomy tag unit start@ end_@ val~2 filed@",
          lambda f: _facts_round_trip(f), "SELECT * FROM fx_facts"),
    Check("tag_priority", "cik# concept tag unit prio#",
          lambda f: X.tag_priority(f.facts, _TAGS),
          """SELECT DISTINCT cik, c.concept, c.tag, 'USD' AS unit, c.prio FROM fx_facts
             JOIN (VALUES ('revenue','Revenues',1),('net_income','Revenues',0),('assets','Assets',0)) AS c(concept, tag, prio)
               ON c.tag = fx_facts.tag"""),
    Check("ttm_flow", "cik# concept current~2 prior~2", lambda f: X.ttm_flow(f.facts, {"revenue": ("Revenues",)}),
          "SELECT cik, 'revenue' AS concept, current, prior FROM v_ttm"),
    Check("latest_instant", "cik# concept value~2", lambda f: X.latest_instant(f.facts, _TAGS),
          "SELECT cik, 'assets' AS concept, val AS value FROM v_kind WHERE tag = 'Assets' AND k = 1"),
    Check("earnings_stability", "cik# earnings_stability~8", lambda f: X.earnings_stability(f.facts, _TAGS),
          "SELECT * FROM v_steady"),
    Check("share_count", "cik# shares_outstanding~2",
          lambda f: X.share_count(f.facts.replace("Assets", "CommonStockSharesOutstanding", ["tag"])),
          "SELECT cik, val AS shares_outstanding FROM v_kind WHERE tag = 'Assets' AND k = 1"),
    Check("facts_to_fundamentals", "cik# asof@ revenue~2 revenue_prior~2 net_income~2 assets~2 "
          "liabilities~2 equity~2 shares_outstanding~2 earnings_stability~8",
          lambda f: X.facts_to_fundamentals(f.facts, _TAGS),
          """SELECT t.cik, e.d AS asof, t.current AS revenue, t.prior AS revenue_prior, t.current AS net_income,
                    a.val AS assets, CAST(NULL AS DOUBLE) AS liabilities, CAST(NULL AS DOUBLE) AS equity,
                    CAST(NULL AS DOUBLE) AS shares_outstanding, s.earnings_stability
             FROM v_ttm t JOIN v_kind a ON a.cik = t.cik AND a.tag = 'Assets' AND a.k = 1
             JOIN v_steady s ON s.cik = t.cik
             JOIN (SELECT cik, MAX(end_) AS d FROM fx_facts GROUP BY cik) e ON e.cik = t.cik"""),
    Check("join_range_sic", "p_partkey# sic sector", lambda f: V.sector_from_sic(_sic(f)), _SIC_SQL),
    Check("sector_from_sic", "sector n#",
          lambda f: V.sector_from_sic(_sic(f)).groupBy("sector").agg(F.count("*").alias("n")),
          f"SELECT sector, COUNT(*) AS n FROM ({_SIC_SQL}) GROUP BY sector"),
    Check("topk_frames", "frame cik# place#", lambda f: V.topk_frames(_frames(f), _TOP),
          f"SELECT frame, cik, ROW_NUMBER() OVER (PARTITION BY frame ORDER BY val DESC, cik) - 1 AS place "
          f"FROM v_frames QUALIFY place < {_TOP}"),
    Check("derivative_line_filter", "symbol cik#", lambda f: V.derivative_line_filter(_directory(f)),
          f"SELECT * FROM v_directory WHERE {_COMMON_LINE}"),
    Check("universe_prescreen", "symbol cik# name exchange score~8",
          lambda f: V.universe_prescreen(_frames(f), _directory(f), _forced(f), _TOP),
          f"""SELECT d.symbol, d.cik, d.name, d.exchange, CASE WHEN {_COMMON_LINE.replace('symbol', 'd.symbol')}
                     THEN s.score END AS score
              FROM v_directory d LEFT JOIN (
                SELECT * FROM v_screen WHERE cik IN (SELECT cik FROM v_directory WHERE {_COMMON_LINE})
                ORDER BY score DESC, cik LIMIT {_TOP}) s ON s.cik = d.cik
              WHERE (s.cik IS NOT NULL AND ({_COMMON_LINE.replace('symbol', 'd.symbol')}))
                 OR (d.cik % 9 = 0 AND d.symbol LIKE '%-PK')"""),
    Check("liquidity_cut", "symbol cik# name sector exchange turnover~2",
          lambda f: V.liquidity_cut(f.stocks, f.universe, f.universe.filter(
              F.col("symbol").isin("NATION_1", "NATION_2", "NATION_3")), keep=3),
          """WITH t AS (SELECT u.*, x.turnover FROM fx_universe u JOIN (
               SELECT symbol, AVG(close * volume) FILTER (WHERE rn <= 252) AS turnover FROM v_seqn GROUP BY symbol
               HAVING COUNT(*) >= 252) x ON x.symbol = u.symbol),
             c AS (SELECT * FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY cik ORDER BY turnover DESC, symbol) = 1)
             SELECT * FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY turnover DESC, symbol) AS k FROM c)
             WHERE k <= 3 OR symbol IN ('NATION_1', 'NATION_2', 'NATION_3')"""),
]
VIEWS["v_all_ranks"] = _ranked_sql("Medium-Term")
VIEWS["v_medium"] = _MEDIUM


def _with_index(f):
    from ..operators.series import return_number
    r = return_number(f.stocks).select("symbol", "date", "r")
    return r.join(M.index_returns(f.index_bars), "date")


def _facts_round_trip(f):
    """Facts nested into per-company JSON documents and flattened again."""
    from ..sources.payloads import flatten_facts
    obs = F.struct(F.col("start").cast("string").alias("start"),
                   F.col("end_").cast("string").alias("end"), "val",
                   F.col("filed").cast("string").alias("filed"))
    by_unit = f.facts.groupBy("cik", "taxonomy", "tag", "unit").agg(F.collect_list(obs).alias("o"))
    by_tag = by_unit.groupBy("cik", "taxonomy", "tag").agg(
        F.map_from_entries(F.collect_list(F.struct("unit", "o"))).alias("units"))
    by_tax = by_tag.groupBy("cik", "taxonomy").agg(F.map_from_entries(
        F.collect_list(F.struct("tag", F.struct("units")))).alias("tags"))
    docs = by_tax.groupBy("cik").agg(F.map_from_entries(
        F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    return flatten_facts(docs.select(F.to_json(F.struct("cik", "facts")).alias("payload")))
