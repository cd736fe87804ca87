"""Registered queries over cursors, episodes, runs, records and dated events."""

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import events as E
from ..operators import history as H
from ..operators import rollups as U
from ..operators import series as S
from ..session import persist_table
from .checks import Check
from .oracle import VIEWS

DEPTH, MOVE, AHEAD = -0.02, 0.02, 5

# Bars as each cursor sees them: the plain, copied form of the cut.
VIEWS["v_seen"] = """
SELECT b.symbol, c.asof, b.date, b.close,
       MAX(b.close) OVER w AS pk, ROW_NUMBER() OVER w AS i
FROM fx_bars b JOIN fx_cutoffs c ON c.symbol = b.symbol AND b.date <= c.asof AND b.close > 0
WINDOW w AS (PARTITION BY b.symbol, c.asof ORDER BY b.date ROWS UNBOUNDED PRECEDING)
"""
VIEWS["v_snap"] = """
SELECT symbol, asof, MAX(date) AS date, ARG_MAX(close, date) AS close, ARG_MAX(pk, date) AS peak_close,
       COUNT(*) AS sessions_elapsed, MIN(date) AS first_date, ARG_MIN(close, date) AS first_close
FROM v_seen GROUP BY 1, 2
"""
VIEWS["v_eps"] = f"""
SELECT * FROM (
  SELECT symbol, asof, ep, MIN(date) AS peak_date, ARG_MIN(date, (close, date)) AS trough_date,
         LEAD(MIN(date)) OVER (PARTITION BY symbol, asof ORDER BY ep) AS recovery_date,
         MAX(pk) AS peak_close, MIN(close) AS trough_close, MIN(close) / MAX(pk) - 1 AS depth,
         COUNT(*) AS sessions
  FROM (SELECT *, SUM(CASE WHEN close >= pk THEN 1 ELSE 0 END) OVER
          (PARTITION BY symbol, asof ORDER BY date ROWS UNBOUNDED PRECEDING) AS ep FROM v_seen)
  GROUP BY 1, 2, 3) WHERE depth <= {DEPTH}
"""
VIEWS["v_rec"] = """
SELECT *, date - LAG(date) OVER (PARTITION BY symbol, asof ORDER BY date) AS gap
FROM v_seen WHERE close >= pk
"""
VIEWS["v_records"] = """
SELECT symbol, asof, COUNT(*) AS record_days, MAX(close) AS record_close,
       ARG_MIN(date, (-close, date)) AS record_date, MAX(gap) AS longest_dry_spell,
       ARG_MIN(date, (-gap, date)) FILTER (WHERE gap IS NOT NULL) AS dry_spell_end_date
FROM v_rec GROUP BY 1, 2
"""
VIEWS["v_runs"] = """
SELECT symbol, asof, direction, length, start_date, end_date, run_return FROM (
  SELECT symbol, asof, sg AS direction, COUNT(*) AS length, MIN(date) AS start_date, MAX(date) AS end_date,
         ARG_MAX(close, date) / ARG_MIN(before, date) - 1 AS run_return
  FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY symbol, asof, sg ORDER BY date) AS island FROM (
          SELECT r.symbol, c.asof, r.date, r.close, SIGN(r.r) AS sg,
                 ROW_NUMBER() OVER (PARTITION BY r.symbol, c.asof ORDER BY r.date) AS i,
                 p.close AS before
          FROM v_ret r JOIN fx_cutoffs c ON c.symbol = r.symbol AND r.date <= c.asof
          JOIN v_seqn q ON q.symbol = r.symbol AND q.date = r.date
          JOIN v_seqn p ON p.symbol = q.symbol AND p.i = q.i - 1
          WHERE r.r IS NOT NULL))
  WHERE sg <> 0 GROUP BY symbol, asof, sg, island)
QUALIFY ROW_NUMBER() OVER (PARTITION BY symbol, asof, direction ORDER BY length DESC, start_date) <= 3
"""
VIEWS["v_extreme"] = """
SELECT symbol, asof, direction, date, close, r FROM (
  SELECT r.symbol, c.asof, r.date, r.close, r.r, 'gain' AS direction,
         ROW_NUMBER() OVER (PARTITION BY r.symbol, c.asof ORDER BY r.r DESC, r.date) AS k
  FROM v_ret r JOIN fx_cutoffs c ON c.symbol = r.symbol AND r.date <= c.asof WHERE r.r IS NOT NULL
  UNION ALL
  SELECT r.symbol, c.asof, r.date, r.close, r.r, 'loss',
         ROW_NUMBER() OVER (PARTITION BY r.symbol, c.asof ORDER BY r.r, r.date)
  FROM v_ret r JOIN fx_cutoffs c ON c.symbol = r.symbol AND r.date <= c.asof WHERE r.r IS NOT NULL)
WHERE k <= 5
"""
VIEWS["v_periods"] = """
SELECT symbol, asof, period_type, 'best' AS extreme, ARG_MIN(period, (-ret, period)) AS period, MAX(ret) AS period_return
FROM v_full_periods GROUP BY 1, 2, 3
UNION ALL
SELECT symbol, asof, period_type, 'worst', ARG_MIN(period, (ret, period)), MIN(ret)
FROM v_full_periods GROUP BY 1, 2, 3
"""
VIEWS["v_full_periods"] = """
SELECT symbol, asof, 'month' AS period_type, ym AS period, ret FROM (
  SELECT m.symbol, c.asof, m.ym, m.ret,
         ROW_NUMBER() OVER (PARTITION BY m.symbol, c.asof ORDER BY m.ym) AS a,
         ROW_NUMBER() OVER (PARTITION BY m.symbol, c.asof ORDER BY m.ym DESC) AS z
  FROM v_monthly m JOIN fx_cutoffs c ON c.symbol = m.symbol AND m.ym <= strftime(c.asof, '%Y-%m'))
WHERE a > 1 AND z > 1
UNION ALL
SELECT y.symbol, c.asof, 'year', y.year, y.ret FROM v_yearly y
JOIN fx_cutoffs c ON c.symbol = y.symbol AND y.year <= strftime(c.asof, '%Y') WHERE y.part = 0
"""
VIEWS["v_cross"] = """
SELECT m.symbol, c.asof, m.date, m.close, CASE WHEN up THEN 'golden' ELSE 'death' END AS cross_type
FROM (SELECT *, ma_50 > ma_200 AS up, LAG(ma_50 > ma_200) OVER (PARTITION BY symbol ORDER BY date) AS was
      FROM v_ma WHERE ma_50 IS NOT NULL AND ma_200 IS NOT NULL) m
JOIN fx_cutoffs c ON c.symbol = m.symbol AND m.date <= c.asof WHERE up <> was
"""
VIEWS["v_placed"] = f"""
SELECT e.symbol, c.asof, e.date, e.title, e.description, e.category, e.source, k.tone, k.label,
       n.date AS session_date, n.close AS close_on, p.close AS close_before,
       f.close / p.close - 1 AS forward_return
FROM fx_company_events e JOIN fx_event_categories k ON k.name = e.category
JOIN fx_cutoffs c ON c.symbol = e.symbol AND e.date <= c.asof
ASOF LEFT JOIN v_seqn n ON n.symbol = e.symbol AND n.date >= e.date
ASOF LEFT JOIN v_seqn p ON p.symbol = e.symbol AND p.date < e.date
LEFT JOIN v_seqn f ON f.symbol = e.symbol AND f.i = n.i + {AHEAD}
"""
VIEWS["v_impact"] = f"""
SELECT * FROM (
  SELECT s.symbol, c.asof, m.date, m.title, m.category, m.description,
         p.close AS close_before, f.close AS close_after, f.close / p.close - 1 AS company_move
  FROM fx_market_events m CROSS JOIN fx_symbols s
  JOIN fx_cutoffs c ON c.symbol = s.symbol AND m.date <= c.asof
  ASOF JOIN v_seqn n ON n.symbol = s.symbol AND n.date >= m.date
  ASOF JOIN v_seqn p ON p.symbol = s.symbol AND p.date < m.date
  JOIN v_seqn f ON f.symbol = s.symbol AND f.i = n.i + {AHEAD})
WHERE ABS(company_move) >= {MOVE}
"""


def _written_states(f):
    """The record's states, computed in one pass over the bars and read by several operators."""
    return persist_table(H.record_states(f.bars), "record-states")


def _episodes(f, states=None):
    return H.drawdown_episodes(f.bars, f.cutoffs, DEPTH, states)


def _streaks(f, states=None):
    return H.streaks(f.bars, f.cutoffs, states=states)


def _extremes(f, states=None):
    return H.extreme_days(f.bars, f.cutoffs, 5, states)


def _periods(f):
    return H.best_worst_periods(U.monthly_returns(f.bars), U.yearly_summary(f.bars), f.cutoffs)


def _crossovers(f, states=None):
    return H.ma_crossovers(S.moving_averages(f.bars), f.cutoffs, states)


def _company(f, bars=None):
    return E.company_event_impact(f.bars if bars is None else bars, f.company_events, f.categories, f.cutoffs, AHEAD)


def _market(f, bars=None):
    return E.market_event_impact(f.bars if bars is None else bars, f.market_events, f.cutoffs, AHEAD, MOVE)


def _timeline(f):
    states = _written_states(f)
    return H.timeline(_company(f, states), _market(f, states), _episodes(f, states), _extremes(f, states))


def _facts(f):
    states = _written_states(f)
    return H.fact_selection(
        H.asof_snapshot(f.bars, f.cutoffs, states), H.record_summary(f.bars, f.cutoffs, states), _extremes(f, states),
        _streaks(f, states), _periods(f), _episodes(f, states), _crossovers(f, states), _company(f, states), ("1-URGENT",))


def _order_days(f):
    """Every order as a dated event of its customer's nation."""
    return f.orders_n.select("symbol", F.col("d").alias("date"), "o_orderkey")


def _hit(df, *extra):
    return df.select("symbol", "date", "o_orderkey", F.col("hit.date").alias("session_date"),
                     F.col("hit.close").alias("close"), *extra)


_ORDERS = ("SELECT e.symbol, e.d AS date, e.o_orderkey, {cols} FROM (SELECT o.o_orderkey, "
           "n.n_name AS symbol, CAST(o.o_orderdate AS DATE) AS d FROM orders o "
           "JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey) e ")
_ASOF = _ORDERS.format(cols="b.date AS session_date, b.close") + \
    "ASOF LEFT JOIN fx_bars b ON b.symbol = e.symbol AND b.date {op} e.d"
_HIT_COLS = "symbol date@ o_orderkey# session_date@ close~6"

CHECKS = [
    Check("asof_backward_strict", _HIT_COLS,
          lambda f: _hit(A.asof_join(_order_days(f), f.bars, ["close"], strict=True)),
          _ASOF.format(op="<")),
    Check("asof_backward", _HIT_COLS,
          lambda f: _hit(A.asof_join(_order_days(f), f.bars, ["close"])), _ASOF.format(op="<=")),
    Check("asof_forward", _HIT_COLS,
          lambda f: _hit(A.asof_join(_order_days(f), f.bars, ["close"], "forward")),
          _ASOF.format(op=">=")),
    Check("asof_forward_offset", _HIT_COLS + " later~6",
          lambda f: _hit(A.asof_join(_order_days(f), f.bars.withColumn(
              "later", F.lead("close", AHEAD).over(S.sessions())), ["close", "later"], "forward"),
              F.col("hit.later").alias("later")),
          _ORDERS.format(cols="b.date AS session_date, b.close, g.close AS later")
          + f"ASOF LEFT JOIN v_seqn b ON b.symbol = e.symbol AND b.date >= e.d "
            f"LEFT JOIN v_seqn g ON g.symbol = e.symbol AND g.i = b.i + {AHEAD}"),
    Check("lookup_exact_date", "symbol date@ o_orderkey# close_on~6",
          lambda f: A.lookup_exact_date(_order_days(f), f.bars),
          _ORDERS.format(cols="b.close AS close_on")
          + "LEFT JOIN fx_bars b ON b.symbol = e.symbol AND b.date = e.d"),
    Check("asof_snapshot", "symbol asof@ date@ close~6 peak_close~6 sessions_elapsed# first_date@ "
          "first_close~6 return_to_date~8 drawdown~8 at_record_high# years_elapsed~6 cagr_to_date~8",
          lambda f: H.asof_snapshot(f.bars, f.cutoffs),
          """SELECT *, close / first_close - 1 AS return_to_date, close / peak_close - 1 AS drawdown,
                    CASE WHEN close >= peak_close THEN 1 ELSE 0 END AS at_record_high,
                    (date - first_date) / 365.25 AS years_elapsed,
                    POW(close / first_close, 1 / GREATEST((date - first_date) / 365.25, 0.01)) - 1 AS cagr_to_date
             FROM v_snap"""),
    Check("state_band", "symbol asof@ drawdown~8 band tone",
          lambda f: H.state_band(H.asof_snapshot(f.bars, f.cutoffs)),
          """SELECT symbol, asof, d AS drawdown,
                    CASE WHEN d = 0 THEN 'record high' WHEN d >= -0.05 THEN 'near record'
                         WHEN d >= -0.2 THEN 'off high' WHEN d >= -0.5 THEN 'in drawdown' ELSE 'deep drawdown' END AS band,
                    CASE WHEN d >= -0.05 THEN 'positive' WHEN d >= -0.2 THEN 'neutral' ELSE 'negative' END AS tone
             FROM (SELECT *, (close - peak_close) / peak_close AS d FROM v_snap)"""),
    Check("drawdown_episodes", "symbol asof@ peak_date@ trough_date@ recovery_date@ peak_close~6 "
          "trough_close~6 depth~8 sessions# days_to_trough# days_to_recover#", _episodes,
          "SELECT *, trough_date - peak_date AS days_to_trough, recovery_date - trough_date AS days_to_recover "
          "FROM v_eps"),
    Check("record_summary", "symbol asof@ record_days# record_close~6 record_date@ "
          "longest_dry_spell# dry_spell_end_date@",
          lambda f: H.record_summary(f.bars, f.cutoffs), "SELECT * FROM v_records"),
    Check("streaks", "symbol asof@ direction# length# start_date@ end_date@ run_return~8", _streaks,
          "SELECT * FROM v_runs"),
    Check("extreme_days", "symbol asof@ direction date@ close~6 daily_return~8", _extremes,
          "SELECT *, r AS daily_return FROM v_extreme"),
    Check("union_extremes", "symbol asof@ direction date@",
          lambda f: H.extreme_days(f.stocks, f.cutoffs, 5),
          "SELECT symbol, asof, direction, date FROM v_extreme WHERE symbol <> 'MARKET'"),
    Check("best_worst_periods", "symbol asof@ period_type extreme period period_return~8", _periods,
          "SELECT * FROM v_periods"),
    Check("union_periods", "symbol asof@ period_type extreme period",
          lambda f: _periods(f).filter("period_type = 'year'"),
          "SELECT * FROM v_periods WHERE period_type = 'year'"),
    Check("ma_crossovers", "symbol asof@ date@ close~6 cross_type", _crossovers, "SELECT * FROM v_cross"),
    Check("price_path_thinned", "symbol date@ close~6 peak_close~6 drawdown~8",
          lambda f: H.price_path(f.bars, 3),
          "SELECT q.symbol, q.date, q.close, d.pk AS peak_close, d.dd AS drawdown FROM v_seqn q "
          "JOIN v_dd d USING (symbol, date) WHERE q.i % 3 = 0 OR q.i = 1 OR q.rn = 1 OR q.close >= d.pk"),
    Check("company_event_impact", "symbol asof@ date@ title description category source tone label "
          "session_date@ close_on~6 close_before~6 forward_return~8", _company, "SELECT * FROM v_placed"),
    Check("market_event_impact", "symbol asof@ date@ title category description close_before~6 "
          "close_after~6 company_move~8", _market, "SELECT * FROM v_impact"),
    Check("union_timeline", "symbol asof@ date@ title detail kind tone source move~8", _timeline,
          """SELECT symbol, asof, date, title, description AS detail, 'company' AS kind, tone, source,
                    forward_return AS move FROM v_placed WHERE session_date IS NOT NULL
             UNION ALL
             SELECT symbol, asof, date, title, description, 'market',
                    CASE category WHEN 'crisis' THEN 'negative' WHEN 'recovery' THEN 'positive' ELSE 'neutral' END,
                    'market', company_move FROM v_impact
             UNION ALL
             SELECT symbol, asof, trough_date, 'drawdown bottom',
                    CASE WHEN recovery_date IS NULL THEN 'not recovered' ELSE 'recovered' END,
                    'milestone', 'negative', '', depth FROM v_eps
             UNION ALL
             SELECT symbol, asof, date, 'largest ' || direction, '', 'milestone',
                    CASE direction WHEN 'gain' THEN 'positive' ELSE 'negative' END, '', r FROM v_extreme"""),
    Check("fact_selection", "symbol asof@ kind value~6 date@", _facts,
          """SELECT symbol, asof, 'company event' AS kind, forward_return AS value, date FROM v_placed
             WHERE category = '1-URGENT'
             UNION ALL SELECT symbol, asof, 'record close', record_close, record_date FROM v_records
             UNION ALL SELECT symbol, asof, 'record days', record_days, record_date FROM v_records
             UNION ALL SELECT symbol, asof, 'longest dry spell', longest_dry_spell, dry_spell_end_date
                       FROM v_records WHERE longest_dry_spell > 400
             UNION ALL SELECT symbol, asof, 'best day', MAX(r), ARG_MAX(date, (r, date)) FROM v_extreme
                       WHERE direction = 'gain' GROUP BY 1, 2
             UNION ALL SELECT symbol, asof, 'worst day', MIN(r), ARG_MIN(date, (r, date)) FROM v_extreme
                       WHERE direction = 'loss' GROUP BY 1, 2
             UNION ALL SELECT symbol, asof, CASE WHEN direction > 0 THEN 'longest rise' ELSE 'longest fall' END,
                       MAX(length), ARG_MIN(end_date, (-length, start_date)) FROM v_runs GROUP BY symbol, asof, direction
             UNION ALL SELECT symbol, asof, extreme || ' ' || period_type, period_return,
                       CAST(period || CASE period_type WHEN 'year' THEN '-12-31' ELSE '-28' END AS DATE) FROM v_periods
             UNION ALL SELECT symbol, asof, 'deepest drawdown', MIN(depth),
                       ARG_MIN(COALESCE(recovery_date, trough_date), (depth, peak_date)) FROM v_eps GROUP BY 1, 2
             UNION ALL SELECT symbol, asof, 'return to date', close / first_close - 1, first_date FROM v_snap
             UNION ALL SELECT symbol, asof, 'trend changes', COUNT(*), NULL FROM v_cross GROUP BY 1, 2
             UNION ALL SELECT symbol, asof, 'upward trend changes',
                       SUM(CASE WHEN cross_type = 'golden' THEN 1 ELSE 0 END), NULL FROM v_cross GROUP BY 1, 2"""),
]
