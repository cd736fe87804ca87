"""Registered queries over the cross-section, rolling periods, pairs and baskets."""

from ..operators import correlation as C
from ..operators import market as M
from ..operators import portfolio as P
from ..operators import rollups as U
from ..operators import series as S
from .checks import Check
from .entries_series import END, START, _WIN
from .fixtures import INDEX
from .oracle import VIEWS

HORIZONS = (63, 252, 504)

VIEWS["v_moves"] = f"""
SELECT s.symbol, s.name, s.sector, MIN(b.date) AS first_date, MAX(b.date) AS last_date,
       COUNT(*) AS sessions, ARG_MIN(b.close, b.date) AS start_close, ARG_MAX(b.close, b.date) AS end_close,
       ARG_MAX(b.close, b.date) / ARG_MIN(b.close, b.date) - 1 AS period_return,
       AVG(b.close * b.volume) AS avg_dollar_volume
FROM fx_bars b JOIN fx_symbols s ON s.symbol = b.symbol AND s.is_index = 0
WHERE b.{_WIN} GROUP BY 1, 2, 3
"""
VIEWS["v_roll"] = f"""
SELECT a.symbol, k.k AS sessions, a.date, b.date AS start_date, a.close / b.close - 1 AS w,
       POW(a.close / b.close, 252.0 / k.k) - 1 AS ann
FROM v_seqn a CROSS JOIN (VALUES {', '.join(f'({k})' for k in HORIZONS)}) AS k(k)
JOIN v_seqn b ON b.symbol = a.symbol AND b.i = a.i - k.k
"""
VIEWS["v_corr"] = f"""
SELECT a.symbol AS sym_a, b.symbol AS sym_b, COUNT(*) AS n,
       CASE WHEN COUNT(*) >= 3 THEN CORR(a.r, b.r) END AS correlation
FROM v_ret a JOIN v_ret b ON a.date = b.date AND a.r IS NOT NULL AND b.r IS NOT NULL
WHERE a.{_WIN} GROUP BY 1, 2
"""
VIEWS["v_joint"] = f"""
SELECT b.symbol AS s, p.portfolio_id, p.weight, b.date, b.close, r.r,
       COUNT(*) OVER (PARTITION BY p.portfolio_id, b.date) AS c,
       COUNT(r.r) OVER (PARTITION BY p.portfolio_id, b.date) AS cr, z.z
FROM fx_bars b JOIN v_ret r ON r.symbol = b.symbol AND r.date = b.date
JOIN fx_portfolios p ON p.symbol = b.symbol
JOIN (SELECT portfolio_id, COUNT(*) AS z FROM fx_portfolios GROUP BY 1) z ON z.portfolio_id = p.portfolio_id
WHERE b.{_WIN}
"""
VIEWS["v_d0"] = "SELECT portfolio_id, MIN(date) AS d0 FROM v_joint WHERE c = z GROUP BY 1"
VIEWS["v_port"] = """
SELECT j.portfolio_id, j.date, d.d0, SUM(j.r * j.weight) AS pr
FROM v_joint j JOIN v_d0 d ON d.portfolio_id = j.portfolio_id AND j.date > d.d0
WHERE j.c = j.z AND j.cr = j.z GROUP BY 1, 2, 3
"""
VIEWS["v_wealth"] = """
SELECT *, EXP(SUM(LN(1 + pr)) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING)) AS w
FROM v_port
"""
_MOVES = ("symbol name sector first_date@ last_date@ sessions# start_close~6 end_close~6 "
          "period_return~8 avg_dollar_volume~2")
_BOARD = ("symbol name sector industry first_date@ last_date@ years~6 last_close~6 "
          "last_daily_return~8 total_return~8 cagr~8 ann_volatility~8 current_volatility~8 "
          "max_drawdown~8 highest_close~6 lowest_close~6 avg_volume~4 avg_dollar_volume~2")


def _stats(f):
    return U.symbol_stats(f.bars, f.symbols)


def _pairs(f):
    return C.correlation_pairs(S.daily_returns(f.bars), START, END)


_SQUARE = ["NATION_3", "NATION_0", "MARKET"]

CHECKS = [
    Check("leaderboard", _BOARD, lambda f: M.leaderboard(_stats(f)),
          "SELECT * FROM v_stats WHERE is_index = 0"),
    Check("leaderboard_ranked", _BOARD,
          lambda f: M.leaderboard_ranked(_stats(f), "volatility", True, "ASIA", 3),
          "SELECT * FROM v_stats WHERE is_index = 0 AND sector = 'ASIA' AND ann_volatility IS NOT NULL "
          "ORDER BY ann_volatility, symbol LIMIT 3"),
    Check("period_movers", _MOVES, lambda f: M.period_movers(f.bars, f.symbols, START, END),
          "SELECT * FROM v_moves"),
    Check("period_movers_ranked", _MOVES,
          lambda f: M.period_movers_ranked(f.bars, f.symbols, START, END, "volume", False, "EUROPE", 4),
          "SELECT * FROM v_moves WHERE sector = 'EUROPE' ORDER BY avg_dollar_volume DESC NULLS LAST, symbol LIMIT 4"),
    Check("sort_whitelist", _MOVES,
          lambda f: M.period_movers_ranked(f.bars, f.symbols, START, END, "no such word", True, "", 5),
          "SELECT * FROM v_moves ORDER BY period_return NULLS LAST, symbol LIMIT 5"),
    Check("optional_filter", _MOVES,
          lambda f: M.period_movers_ranked(f.bars, f.symbols, START, END, "return", False, "", -1),
          "SELECT * FROM v_moves"),
    Check("topk_ordered", _MOVES,
          lambda f: M.period_movers_ranked(f.bars, f.symbols, START, END, "return", False, "", 7),
          "SELECT * FROM v_moves ORDER BY period_return DESC NULLS LAST, symbol LIMIT 7"),
    Check("sector_performance", "sector n_symbols# median_return~8 avg_return~8 worst_return~8 best_return~8",
          lambda f: M.sector_performance(f.bars, f.symbols, START, END),
          "SELECT sector, COUNT(*) AS n_symbols, MEDIAN(period_return) AS median_return, "
          "AVG(period_return) AS avg_return, MIN(period_return) AS worst_return, "
          "MAX(period_return) AS best_return FROM v_moves GROUP BY sector"),
    Check("agg_median", "symbol year median_return~8",
          lambda f: _grouped_median_of_returns(f),
          "SELECT symbol, strftime(date, '%Y') AS year, MEDIAN(r) AS median_return FROM v_ret "
          "WHERE r IS NOT NULL GROUP BY 1, 2"),
    Check("market_breadth", "advancing# declining# n# median_return~8 best_symbol best_return~8 "
          "worst_symbol worst_return~8",
          lambda f: M.market_breadth(f.bars, f.symbols, START, END),
          """SELECT SUM(CASE WHEN period_return > 0 THEN 1 ELSE 0 END) AS advancing,
                    SUM(CASE WHEN period_return < 0 THEN 1 ELSE 0 END) AS declining, COUNT(*) AS n,
                    MEDIAN(period_return) AS median_return, ARG_MAX(symbol, period_return) AS best_symbol,
                    MAX(period_return) AS best_return, ARG_MIN(symbol, period_return) AS worst_symbol,
                    MIN(period_return) AS worst_return FROM v_moves"""),
    Check("window_stats", "symbol first_date@ last_date@ trading_days# first_close~6 last_close~6 "
          "period_return~8 period_high~6 period_low~6 highest_close~6 lowest_close~6 avg_volume~4 "
          "avg_dollar_volume~2 ann_volatility~8 max_drawdown~8 cagr~8",
          lambda f: M.window_stats(f.bars, START, END),
          f"""SELECT b.symbol, MIN(b.date) AS first_date, MAX(b.date) AS last_date, COUNT(*) AS trading_days,
                     ARG_MIN(b.close, b.date) AS first_close, ARG_MAX(b.close, b.date) AS last_close,
                     ARG_MAX(b.close, b.date) / ARG_MIN(b.close, b.date) - 1 AS period_return,
                     MAX(b.high) AS period_high, MIN(b.low) AS period_low, MAX(b.close) AS highest_close,
                     MIN(b.close) AS lowest_close, AVG(b.volume) AS avg_volume,
                     AVG(b.close * b.volume) AS avg_dollar_volume,
                     STDDEV_POP(r.r) * SQRT(252) AS ann_volatility, MIN(d.dd) AS max_drawdown,
                     POW(ARG_MAX(b.close, b.date) / ARG_MIN(b.close, b.date),
                         1 / GREATEST((MAX(b.date) - MIN(b.date)) / 365.25, 0.01)) - 1 AS cagr
              FROM fx_bars b JOIN v_ret r USING (symbol, date) JOIN v_dd d USING (symbol, date)
              WHERE b.{_WIN} GROUP BY b.symbol"""),
    Check("risk_return_points", "symbol name sector ann_volatility~8 cagr~8",
          lambda f: M.risk_return_points(_stats(f)),
          "SELECT * FROM v_stats WHERE is_index = 0 AND ann_volatility IS NOT NULL AND cagr IS NOT NULL"),
    Check("rolling_returns", "symbol sessions# date@ start_date@ window_return~8 annualized_return~8",
          lambda f: M.rolling_returns(f.bars, HORIZONS),
          "SELECT symbol, sessions, date, start_date, w AS window_return, ann AS annualized_return FROM v_roll"),
    Check("join_self_offset", "symbol date@ start_date@ window_return~8",
          lambda f: M.rolling_returns(f.bars, (21,)),
          "SELECT a.symbol, a.date, b.date AS start_date, a.close / b.close - 1 AS window_return "
          "FROM v_seqn a JOIN v_seqn b ON b.symbol = a.symbol AND b.i = a.i - 21"),
    Check("rolling_return_summary", "symbol sessions# periods# worst~8 best~8 mean_return~8 "
          "median_return~8 share_positive~8 worst_end_date@ best_end_date@",
          lambda f: M.rolling_return_summary(M.rolling_returns(f.bars, HORIZONS)),
          """SELECT symbol, sessions, COUNT(*) AS periods, MIN(ann) AS worst, MAX(ann) AS best,
                    AVG(ann) AS mean_return, MEDIAN(ann) AS median_return,
                    AVG(CASE WHEN ann > 0 THEN 1.0 ELSE 0.0 END) AS share_positive,
                    MIN(date) FILTER (WHERE lo = 1) AS worst_end_date,
                    MIN(date) FILTER (WHERE hi = 1) AS best_end_date
             FROM (SELECT *, RANK() OVER (PARTITION BY symbol, sessions ORDER BY ann) AS lo,
                          RANK() OVER (PARTITION BY symbol, sessions ORDER BY ann DESC) AS hi FROM v_roll)
             GROUP BY 1, 2"""),
    Check("trailing_performance", "symbol span trailing_return~8",
          lambda f: M.trailing_performance(f.bars),
          """SELECT symbol, span, last / base - 1 AS trailing_return FROM (
               SELECT b.symbol, s.span, ARG_MAX(b.close, b.date) AS last,
                 CASE WHEN s.span = 'All' THEN ARG_MIN(b.close, b.date)
                      ELSE ARG_MAX(b.close, b.date) FILTER (WHERE b.date <= e.date - s.n) END AS base
               FROM fx_bars b JOIN v_seqn e ON e.symbol = b.symbol AND e.rn = 1
               CROSS JOIN (VALUES ('1M',30),('3M',91),('6M',182),('1Y',365),('3Y',1095),('5Y',1826),('All',0)) AS s(span, n)
               GROUP BY 1, 2) WHERE base IS NOT NULL"""),
    Check("peer_pick", "symbol sector rank# peer peer_dollar_volume~2",
          lambda f: M.peer_pick(f.bars, f.symbols, START, END),
          """SELECT a.symbol, a.sector, ROW_NUMBER() OVER (PARTITION BY a.symbol
                      ORDER BY b.avg_dollar_volume DESC, b.symbol) AS rank,
                    b.symbol AS peer, b.avg_dollar_volume AS peer_dollar_volume
             FROM v_moves a JOIN v_moves b ON a.sector = b.sector AND a.symbol <> b.symbol
             QUALIFY rank <= 2"""),
    Check("correlation_matrix", "sym_a sym_b n# correlation~8", _pairs, "SELECT * FROM v_corr"),
    Check("join_self_date", "sym_a sym_b n#", lambda f: _pairs(f), "SELECT * FROM v_corr"),
    Check("exact_pairs", "sym_a sym_b n# correlation~8", lambda f: C.exact_pairs(_pairs(f)),
          "SELECT * FROM v_corr WHERE sym_a < sym_b"),
    Check("correlation_wide", "sym_a " + " ".join(f"{s}~8" for s in _SQUARE),
          lambda f: C.correlation_wide(
              C.correlation_pairs(S.daily_returns(f.bars), START, END, _SQUARE), _SQUARE),
          "SELECT sym_a, " + ", ".join(
              f"MAX(CASE WHEN sym_b = '{s}' THEN correlation END) AS {s}" for s in _SQUARE)
          + f" FROM v_corr WHERE sym_a IN ({', '.join(repr(s) for s in _SQUARE)}) GROUP BY 1"),
    Check("nearest_partners", "symbol rank# partner n# correlation~8",
          lambda f: C.nearest_partners(S.daily_returns(f.bars), START, END, 3),
          """SELECT sym_a AS symbol, ROW_NUMBER() OVER (PARTITION BY sym_a ORDER BY correlation DESC, sym_b) AS rank,
                    sym_b AS partner, n, correlation FROM v_corr
             WHERE sym_a <> sym_b AND correlation IS NOT NULL QUALIFY rank <= 3"""),
    Check("correlation_summary", "most_pair most~8 least_pair least~8 mean_correlation~8 n_pairs# fewest_shared#",
          lambda f: C.correlation_summary(S.daily_returns(f.bars), START, END),
          """SELECT ARG_MAX(sym_a || ' ' || sym_b, correlation) AS most_pair, MAX(correlation) AS most,
                    ARG_MIN(sym_a || ' ' || sym_b, correlation) AS least_pair, MIN(correlation) AS least,
                    AVG(correlation) AS mean_correlation, COUNT(*) AS n_pairs, MIN(n) AS fewest_shared
             FROM v_corr WHERE sym_a < sym_b AND correlation IS NOT NULL"""),
    Check("normalize_weights", "portfolio_id symbol weight~10",
          lambda f: P.normalize_weights(_order_baskets(f)),
          """SELECT sector AS portfolio_id, symbol, w / SUM(w) OVER (PARTITION BY sector) AS weight
             FROM (SELECT sector, symbol, CAST(SUM(qty) AS DOUBLE) AS w FROM fx_trades GROUP BY 1, 2)"""),
    Check("join_literal_picks", "portfolio_id symbol date@ close~6 weight~4",
          lambda f: f.bars.join(f.portfolios, "symbol"),
          "SELECT p.portfolio_id, b.symbol, b.date, b.close, p.weight FROM fx_bars b "
          "JOIN fx_portfolios p ON p.symbol = b.symbol"),
    Check("join_relational_division", "portfolio_id date@",
          lambda f: P.joint_sessions(f.bars, f.portfolios, START, END),
          "SELECT DISTINCT portfolio_id, date FROM v_joint WHERE c = z"),
    Check("join_after_scalar", "portfolio_id date@ d0@ port_return~8",
          lambda f: P.basket_returns(f.bars, f.portfolios, START, END),
          "SELECT portfolio_id, date, d0, pr AS port_return FROM v_port"),
    Check("portfolio_series", "portfolio_id date@ port_return~8 cumulative_return~8",
          lambda f: P.portfolio_series(f.bars, f.portfolios, START, END),
          "SELECT portfolio_id, date, pr AS port_return, w - 1 AS cumulative_return FROM v_wealth"),
    Check("portfolio_stats", "portfolio_id sessions# first_date@ last_date@ total_return~8 cagr~8 "
          "ann_volatility~8 max_drawdown~8 best_day~8 worst_day~8",
          lambda f: P.portfolio_stats(f.bars, f.portfolios, START, END),
          """SELECT p.portfolio_id, COALESCE(n, 0) AS sessions, d0 AS first_date, d1 AS last_date,
                    w - 1 AS total_return, POW(w, 1 / GREATEST((d1 - d0) / 365.25, 0.01)) - 1 AS cagr,
                    dev * SQRT(252) AS ann_volatility, mdd AS max_drawdown, hi AS best_day, lo AS worst_day
             FROM (SELECT DISTINCT portfolio_id FROM fx_portfolios) p LEFT JOIN (
               SELECT portfolio_id, COUNT(*) AS n, MIN(d0) AS d0, MAX(date) AS d1, ARG_MAX(w, date) AS w,
                      STDDEV_POP(pr) AS dev, MIN(w / pk - 1) AS mdd, MAX(pr) AS hi, MIN(pr) AS lo
               FROM (SELECT *, MAX(w) OVER (PARTITION BY portfolio_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk
                     FROM v_wealth) GROUP BY 1) q ON q.portfolio_id = p.portfolio_id"""),
    Check("portfolio_contribution", "portfolio_id symbol name sector weight~8 contribution~8 "
          "holding_return~8 sessions#",
          lambda f: P.portfolio_contribution(f.bars, f.portfolios, f.symbols, START, END),
          """SELECT j.portfolio_id, j.s AS symbol, s.name, s.sector, j.weight,
                    SUM(j.r * j.weight * w.w / (1 + w.pr)) AS contribution,
                    EXP(SUM(LN(1 + j.r))) - 1 AS holding_return, COUNT(*) AS sessions
             FROM v_joint j JOIN v_wealth w ON w.portfolio_id = j.portfolio_id AND w.date = j.date
             JOIN fx_symbols s ON s.symbol = j.s GROUP BY 1, 2, 3, 4, 5"""),
    Check("agg_compound", "symbol year compounded~8", lambda f: _compound_by_year(f),
          "SELECT symbol, strftime(date, '%Y') AS year, EXP(SUM(LN(1 + r))) - 1 AS compounded "
          "FROM v_ret WHERE r IS NOT NULL GROUP BY 1, 2"),
    Check("portfolio_vs_index", "portfolio_id from_date@ basket_return~8 index_return~8 lead~8",
          lambda f: P.portfolio_vs_index(f.bars, f.portfolios, START, END, INDEX),
          f"""SELECT b.portfolio_id, b.d AS from_date, b.t AS basket_return,
                     EXP(SUM(LN(1 + r.r))) - 1 AS index_return, b.t - (EXP(SUM(LN(1 + r.r))) - 1) AS lead
              FROM (SELECT portfolio_id, MIN(date) AS d, ARG_MAX(w, date) - 1 AS t FROM v_wealth GROUP BY 1) b
              JOIN v_ret r ON r.symbol = 'MARKET' AND r.r IS NOT NULL AND r.date >= b.d AND r.date <= DATE '{END}'
              GROUP BY 1, 2, 3"""),
]


def _grouped_median_of_returns(f):
    from pyspark.sql import functions as F

    from ..functions.ranks import grouped_median
    r = S.daily_returns(f.bars).withColumn("year", F.date_format("date", "yyyy"))
    return grouped_median(r, ["symbol", "year"], "daily_return", "median_return")


def _compound_by_year(f):
    from pyspark.sql import functions as F

    from ..functions import guards as G
    r = S.daily_returns(f.bars).filter("daily_return is not null")
    return r.groupBy("symbol", F.date_format("date", "yyyy").alias("year")).agg(
        G.compounded(F.sum(G.log_growth(F.col("daily_return")))).alias("compounded"))


def _order_baskets(f):
    """A basket per sector weighted by traded quantity."""
    from pyspark.sql import functions as F
    return (f.trades.groupBy(F.col("sector").alias("portfolio_id"), "symbol")
            .agg(F.sum("qty").cast("double").alias("weight")))
