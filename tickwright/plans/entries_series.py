"""Registered queries over daily series, ranges, lookups and rollups."""

from ..operators import ranges as R
from ..operators import rollups as U
from ..operators import series as S
from ..functions.places import read_page, store_ordered
from ..session import scratch_path
from .checks import Check

START, END = "1997-01-01", "2000-12-31"
PICKS = ["NATION_3", "NATION_0", "NATION_7", "MARKET"]
_PICKS_SQL = ", ".join(f"'{p}'" for p in PICKS)
_WIN = f"date BETWEEN DATE '{START}' AND DATE '{END}'"

def _order_page(f):
    """Page 6 of all orders by price, read from a stored order."""
    path = scratch_path(f.spark, "orders-by-price")
    store_ordered(f.table("orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": False, "o_orderkey": True}, path)
    return read_page(f.spark, path, 6, 100)


CHECKS = [
    Check("scan_bars", "symbol date@ open~6 high~6 low~6 close~6 adj_close~6 volume#",
          lambda f: f.bars, "SELECT * FROM fx_bars"),
    Check("symbol_directory", "symbol name sector industry is_index#",
          lambda f: R.symbol_directory(f.symbols), "SELECT * FROM fx_symbols"),
    Check("date_bounds", "symbol first_date@ last_date@ sessions#",
          lambda f: R.date_bounds(f.bars),
          "SELECT symbol, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS sessions "
          "FROM fx_bars GROUP BY symbol"),
    Check("global_last_date", "last_date@", lambda f: R.global_last_date(f.bars),
          "SELECT MAX(date) AS last_date FROM fx_bars"),
    Check("row_count", "n_rows#", lambda f: R.row_count(f.bars),
          "SELECT COUNT(*) AS n_rows FROM fx_bars"),
    Check("prices_in_range", "symbol date@ open~6 high~6 low~6 close~6 volume#",
          lambda f: R.prices_in_range(f.bars, START, END), f"SELECT * FROM fx_bars WHERE {_WIN}"),
    Check("daily_returns", "symbol date@ close~6 volume# daily_return~8",
          lambda f: S.daily_returns(f.bars),
          "SELECT symbol, date, close, volume, r AS daily_return FROM v_ret"),
    Check("drawdowns", "symbol date@ close~6 peak_close~6 drawdown~8",
          lambda f: S.drawdowns(f.bars),
          "SELECT symbol, date, close, pk AS peak_close, dd AS drawdown FROM v_dd"),
    Check("moving_averages", "symbol date@ close~6 ma_50~6 ma_200~6",
          lambda f: S.moving_averages(f.bars), "SELECT * FROM v_ma"),
    Check("rolling_volatility", "symbol date@ ann_volatility_21d~8",
          lambda f: S.rolling_volatility(f.bars),
          "SELECT symbol, date, v AS ann_volatility_21d FROM v_vol"),
    Check("session_number", "symbol date@ close~6 high~6 low~6 volume# rn#",
          lambda f: S.session_number(f.bars),
          "SELECT symbol, date, close, high, low, volume, rn FROM v_seqn"),
    Check("return_number", "symbol date@ r~8 rn#", lambda f: S.return_number(f.bars),
          "SELECT symbol, date, r, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn "
          "FROM v_ret WHERE r IS NOT NULL"),
    Check("latest_row", "symbol date@ open~6 high~6 low~6 close~6 adj_close~6 volume#",
          lambda f: U.latest_row(f.bars), "SELECT * FROM v_seqn WHERE rn = 1"),
    Check("moving_averages_in_range", "symbol date@ close~6 ma_50~6 ma_200~6",
          lambda f: R.moving_averages_in_range(f.bars, START, END),
          f"SELECT * FROM v_ma WHERE {_WIN}"),
    Check("daily_returns_in_range", "symbol date@ daily_return~8",
          lambda f: R.daily_returns_in_range(f.bars, START, END),
          f"SELECT symbol, date, r AS daily_return FROM v_ret WHERE r IS NOT NULL AND {_WIN}"),
    Check("drawdown_in_range", "symbol date@ close~6 peak_close~6 drawdown~8",
          lambda f: R.drawdown_in_range(f.bars, START, END),
          f"SELECT symbol, date, close, pk AS peak_close, dd AS drawdown FROM v_dd WHERE {_WIN}"),
    Check("volatility_in_range", "symbol date@ ann_volatility_21d~8",
          lambda f: R.volatility_in_range(f.bars, START, END),
          f"SELECT symbol, date, v AS ann_volatility_21d FROM v_vol WHERE v IS NOT NULL AND {_WIN}"),
    Check("cumulative_return", "symbol date@ cumulative_return~8",
          lambda f: R.cumulative_return(f.bars, START, END),
          f"""SELECT symbol, date, EXP(SUM(LN(1 + r)) OVER (PARTITION BY symbol ORDER BY date
                 ROWS UNBOUNDED PRECEDING)) - 1 AS cumulative_return
              FROM v_ret WHERE r IS NOT NULL AND {_WIN}"""),
    Check("indexed_comparison", "symbol date@ indexed_close~6",
          lambda f: R.indexed_comparison(f.bars, START, END),
          f"""SELECT symbol, date, 100 * close / ARG_MIN(close, date) OVER (PARTITION BY symbol) AS indexed_close
              FROM fx_bars WHERE {_WIN}"""),
    Check("indexed_pivot", "date@ NATION_3~6 NATION_0~6 NATION_7~6 MARKET~6",
          lambda f: R.indexed_pivot(f.bars, START, END, PICKS),
          f"""SELECT date, {', '.join(f"MAX(CASE WHEN symbol = '{p}' THEN x END) AS {p}" for p in PICKS)}
              FROM (SELECT symbol, date, 100 * close / ARG_MIN(close, date) OVER (PARTITION BY symbol) AS x
                    FROM fx_bars WHERE {_WIN} AND symbol IN ({_PICKS_SQL})) GROUP BY date"""),
    Check("indexed_pivot_filled", "date@ NATION_3~6 NATION_0~6 NATION_7~6 MARKET~6",
          lambda f: R.indexed_pivot_filled(f.bars, START, END, PICKS),
          f"""SELECT date, {', '.join(f'LAST_VALUE({p} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS {p}' for p in PICKS)}
              FROM (SELECT date, {', '.join(f"MAX(CASE WHEN symbol = '{p}' THEN x END) AS {p}" for p in PICKS)}
              FROM (SELECT symbol, date, 100 * close / ARG_MIN(close, date) OVER (PARTITION BY symbol) AS x
                    FROM fx_bars WHERE {_WIN} AND symbol IN ({_PICKS_SQL})) GROUP BY date)"""),
    Check("comparison_spread", "n_series# spread~6 needs_log#",
          lambda f: R.comparison_spread(f.bars, START, END, PICKS, 1.0),
          f"""SELECT COUNT(*) AS n_series, MAX(v) / MIN(v) AS spread,
                     CASE WHEN COUNT(*) >= 2 AND MAX(v) / MIN(v) > 1.0 THEN 1 ELSE 0 END AS needs_log
              FROM (SELECT symbol, 100 * ARG_MAX(close, date) / ARG_MIN(close, date) AS v FROM fx_bars
                    WHERE {_WIN} AND symbol IN ({_PICKS_SQL}) GROUP BY symbol)"""),
    Check("comparison_series", "symbol date@ value~8",
          lambda f: R.comparison_series(f.bars, PICKS, START, END, "Drawdown"),
          f"SELECT symbol, date, dd AS value FROM v_dd WHERE {_WIN} AND symbol IN ({_PICKS_SQL})"),
    Check("wide_symbol_history", "symbol date@ close~6 volume# daily_return~8 ma_50~6 ma_200~6 "
          "ann_volatility_21d~8 drawdown~8 cumulative_return~8",
          lambda f: S.symbol_history(f.stocks, START, END),
          f"""SELECT b.symbol, b.date, b.close, b.volume, r.r AS daily_return, ma_50, ma_200,
                     v.v AS ann_volatility_21d, d.dd AS drawdown,
                     b.close / ARG_MIN(b.close, b.date) OVER (PARTITION BY b.symbol) - 1 AS cumulative_return
              FROM fx_bars b JOIN v_ret r USING (symbol, date) JOIN v_ma m USING (symbol, date)
              JOIN v_dd d USING (symbol, date) LEFT JOIN v_vol v USING (symbol, date)
              WHERE b.symbol <> 'MARKET' AND {_WIN.replace('date BETWEEN', 'b.date BETWEEN')}"""),
    Check("join_cross_scalar", "symbol date@ days_in# share_of_high~8",
          lambda f: _against_bounds(f.bars),
          """SELECT b.symbol, b.date, b.date - s.d0 AS days_in, b.close / s.hi AS share_of_high FROM fx_bars b
             JOIN (SELECT symbol, MIN(date) AS d0, MAX(close) AS hi FROM fx_bars GROUP BY 1) s ON s.symbol = b.symbol"""),
    Check("sparkline_tail", "symbol date@ close~6", lambda f: R.tail(f.stocks, 60),
          "SELECT symbol, date, close FROM v_seqn WHERE rn <= 60 AND symbol <> 'MARKET'"),
    Check("topk_per_symbol", "symbol date@ close~6", lambda f: R.tail(f.bars, 5),
          "SELECT symbol, date, close FROM v_seqn WHERE rn <= 5"),
    Check("events_in_window", "date@ title category description",
          lambda f: R.events_in_window(f.company_events, START, END),
          f"SELECT * FROM fx_company_events WHERE {_WIN}"),
    Check("preset_windows", "preset start_date@ end_date@",
          lambda f: R.preset_windows(f.bars),
          """SELECT preset, GREATEST(CASE preset WHEN 'YTD' THEN date_trunc('year', hi)::DATE
                    WHEN 'All' THEN lo ELSE hi - n END, lo) AS start_date, hi AS end_date
             FROM (SELECT MIN(date) AS lo, MAX(date) AS hi FROM fx_bars),
             (VALUES ('1M',30),('3M',91),('6M',182),('YTD',0),('1Y',365),('3Y',1095),('5Y',1826),
                     ('10Y',3653),('All',0)) AS p(preset, n)"""),
    Check("distinct_sectors", "sector", lambda f: R.distinct_sectors(f.symbols),
          "SELECT DISTINCT sector FROM fx_symbols WHERE sector IS NOT NULL"),
    Check("table_query", "symbol name sector cagr~8",
          lambda f: R.table_query(U.symbol_stats(f.bars, f.symbols), term="inc",
                                  search_cols=("symbol", "name"),
                                  filters={"sector": ["ASIA", "EUROPE", "AFRICA"]},
                                  sort="cagr", ascending=False, page=2, per_page=5),
          """SELECT symbol, name, sector, cagr FROM v_stats
             WHERE (LOWER(symbol) LIKE '%inc%' OR LOWER(name) LIKE '%inc%')
               AND sector IN ('ASIA', 'EUROPE', 'AFRICA')
             ORDER BY cagr DESC NULLS LAST, symbol LIMIT 5 OFFSET 5"""),
    Check("page_of_orders", "o_orderkey# o_totalprice~2 place#", _order_page,
          """SELECT * FROM (SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place
             FROM orders) WHERE place > 500 AND place <= 600"""),
    Check("agg_bounds", "symbol first_date@ last_date@ trading_days#",
          lambda f: U.agg_bounds(f.bars),
          "SELECT symbol, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS trading_days "
          "FROM fx_bars GROUP BY symbol"),
    Check("agg_extremes", "symbol highest_close~6 lowest_close~6 avg_volume~4 avg_dollar_volume~2",
          lambda f: U.agg_extremes(f.bars),
          "SELECT symbol, MAX(close) AS highest_close, MIN(close) AS lowest_close, AVG(volume) AS avg_volume, "
          "AVG(close * volume) AS avg_dollar_volume FROM fx_bars GROUP BY symbol"),
    Check("agg_moments", "symbol mean_ret~10 mean_sq~10 n# ann_volatility~8",
          lambda f: U.agg_moments(f.bars),
          "SELECT symbol, AVG(r) AS mean_ret, AVG(r * r) AS mean_sq, COUNT(*) AS n, "
          "SQRT(AVG(r * r) - AVG(r) * AVG(r)) * SQRT(252) AS ann_volatility "
          "FROM v_ret WHERE r IS NOT NULL GROUP BY symbol"),
    Check("join_bounds_back", "symbol first_close~6 last_close~6",
          lambda f: U.symbol_stats(f.bars, f.symbols).select("symbol", "first_close", "last_close"),
          """SELECT b.symbol, f.close AS first_close, l.close AS last_close
             FROM (SELECT symbol, MIN(date) AS d0, MAX(date) AS d1 FROM fx_bars GROUP BY symbol) b
             JOIN fx_bars f ON f.symbol = b.symbol AND f.date = b.d0
             JOIN fx_bars l ON l.symbol = b.symbol AND l.date = b.d1"""),
    Check("symbol_stats", "symbol name sector industry is_index# first_date@ last_date@ trading_days# "
          "first_close~6 last_close~6 total_return~8 years~8 cagr~8 ann_volatility~8 max_drawdown~8 "
          "current_volatility~8 last_daily_return~8 highest_close~6 lowest_close~6 avg_volume~4 "
          "avg_dollar_volume~2",
          lambda f: U.symbol_stats(f.bars, f.symbols), "SELECT * FROM v_stats"),
    Check("latest_quote", "symbol date@ open~6 high~6 low~6 close~6 volume# prev_close~6 "
          "daily_return~8 w52_high~6 w52_low~6",
          lambda f: U.latest_quote(f.bars),
          """SELECT q.symbol, q.date, q.open, q.high, q.low, q.close, q.volume, p.close AS prev_close,
                    q.close / NULLIF(p.close, 0) - p.close / NULLIF(p.close, 0) AS daily_return,
                    y.hi AS w52_high, y.lo AS w52_low
             FROM v_seqn q LEFT JOIN v_seqn p ON p.symbol = q.symbol AND p.rn = 2
             LEFT JOIN (SELECT b.symbol, MAX(b.high) AS hi, MIN(b.low) AS lo FROM fx_bars b
                        JOIN v_seqn e ON e.symbol = b.symbol AND e.rn = 1
                         AND b.date >= e.date - INTERVAL 12 MONTH GROUP BY b.symbol) y
               ON y.symbol = q.symbol
             WHERE q.rn = 1"""),
    Check("quote_lookup", "symbol date@ close~6 prev_close~6",
          lambda f: U.latest_quote(f.bars).filter("symbol = 'NATION_7'"),
          """SELECT q.symbol, q.date, q.close, p.close AS prev_close FROM v_seqn q
             JOIN v_seqn p ON p.symbol = q.symbol AND p.rn = 2 AND q.rn = 1 WHERE q.symbol = 'NATION_7'"""),
    Check("yearly_summary", "symbol year open_close~6 close_close~6 year_high~6 year_low~6 "
          "avg_volume~4 trading_days# year_return~8 is_partial#",
          lambda f: U.yearly_summary(f.bars),
          "SELECT symbol, year, o AS open_close, c AS close_close, hi AS year_high, lo AS year_low, "
          "av AS avg_volume, n AS trading_days, ret AS year_return, part AS is_partial FROM v_yearly"),
    Check("yearly_track_record", "symbol year year_return~8 is_partial#",
          lambda f: U.yearly_track_record(f.bars),
          "SELECT symbol, year, ret AS year_return, part AS is_partial FROM v_yearly"),
    Check("monthly_returns", "symbol year_month year month month_return~8",
          lambda f: U.monthly_returns(f.bars),
          "SELECT symbol, ym AS year_month, ym[1:4] AS year, ym[6:7] AS month, ret AS month_return FROM v_monthly"),
    Check("monthly_grid", "symbol year month month_return~8", lambda f: U.monthly_grid(f.bars),
          "SELECT symbol, ym[1:4] AS year, ym[6:7] AS month, ret AS month_return FROM v_monthly"),
    Check("monthly_pivot", "symbol year " + " ".join(f"m{m}~8" for m in U.MONTHS),
          lambda f: U.monthly_pivot(f.bars),
          "SELECT symbol, ym[1:4] AS year, "
          + ", ".join(f"MAX(CASE WHEN ym[6:7] = '{m}' THEN ret END) AS m{m}" for m in U.MONTHS)
          + " FROM v_monthly GROUP BY 1, 2"),
    Check("yearly_extremes", "symbol year year_return~8 is_partial# mark",
          lambda f: U.yearly_extremes(f.bars),
          """SELECT y.symbol, y.year, y.ret AS year_return, y.part AS is_partial,
                    CASE WHEN y.year = e.b AND part = 0 THEN 'best' WHEN y.year = e.w AND part = 0 THEN 'worst' END AS mark
             FROM v_yearly y LEFT JOIN (SELECT symbol, ARG_MAX(year, ret) AS b, ARG_MIN(year, ret) AS w
                                        FROM v_yearly WHERE part = 0 GROUP BY symbol) e ON e.symbol = y.symbol"""),
]


def _against_bounds(bars):
    """Each session against one-row figures of its symbol, joined on the symbol."""
    from pyspark.sql import functions as F
    scalars = bars.groupBy("symbol").agg(F.min("date").alias("d0"), F.max("close").alias("hi"))
    return bars.join(scalars, "symbol").select(
        "symbol", "date", F.date_diff("date", "d0").alias("days_in"),
        (F.col("close") / F.col("hi")).alias("share_of_high"))
