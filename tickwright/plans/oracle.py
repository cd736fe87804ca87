"""SQL views the oracle statements build on, as named common table expressions."""

import re

VIEWS: dict[str, str] = {}

VIEWS["fx_trades"] = """
SELECT n.n_name AS symbol, n.n_nationkey AS nk, r.r_name AS sector,
       CAST(l.l_shipdate AS DATE) AS date, p.p_retailprice AS px,
       CAST(ROUND(p.p_retailprice * 100) AS BIGINT) AS cents, CAST(l.l_quantity AS BIGINT) AS qty,
       l.l_orderkey * 10 + l.l_linenumber AS seq
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n   ON s.s_nationkey = n.n_nationkey
JOIN region r   ON n.n_regionkey = r.r_regionkey
JOIN part p     ON l.l_partkey = p.p_partkey
"""
VIEWS["fx_bars"] = """
SELECT symbol, date, MIN_BY(px, seq * 10000 + px) AS open, MAX(px) AS high, MIN(px) AS low,
       CAST(SUM(cents * qty) AS DOUBLE) / (100.0 * CAST(SUM(qty) AS DOUBLE)) AS close,
       CAST(SUM(cents * qty) AS DOUBLE) / (100.0 * CAST(SUM(qty) AS DOUBLE)) AS adj_close,
       CAST(SUM(qty) AS BIGINT) AS volume
FROM fx_trades GROUP BY symbol, date
UNION ALL
SELECT 'MARKET' AS symbol, date, MIN_BY(px, seq * 10000 + px) AS open, MAX(px) AS high, MIN(px) AS low,
       CAST(SUM(cents * qty) AS DOUBLE) / (100.0 * CAST(SUM(qty) AS DOUBLE)) AS close,
       CAST(SUM(cents * qty) AS DOUBLE) / (100.0 * CAST(SUM(qty) AS DOUBLE)) AS adj_close,
       CAST(SUM(qty) AS BIGINT) AS volume
FROM fx_trades GROUP BY date
"""
VIEWS["fx_symbols"] = """
SELECT n.n_name AS symbol, CONCAT(n.n_name, ' Inc') AS name, r.r_name AS sector,
       CONCAT(r.r_name, ' Industry') AS industry, 0 AS is_index
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL SELECT 'MARKET', 'Market Index', 'Index', 'Broad Market Index', 1
"""
VIEWS["fx_universe"] = """
SELECT n.n_name AS symbol, CAST(n.n_regionkey AS BIGINT) AS cik, CONCAT(n.n_name, ' Inc') AS name,
       r.r_name AS sector, CASE WHEN n.n_nationkey % 2 = 0 THEN 'NYSE' ELSE 'Nasdaq' END AS exchange
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
"""
VIEWS["fx_company_events"] = """
SELECT n.n_name AS symbol, CAST(o.o_orderdate AS DATE) AS date,
       CONCAT('Order ', CAST(o.o_orderkey AS VARCHAR)) AS title, 'order' AS description,
       o.o_orderpriority AS category, 'orders' AS source
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
UNION ALL
SELECT n_name, DATE '1990-01-01', 'Founding', 'before the record', '1-URGENT', 'fixture' FROM nation
"""
VIEWS["fx_event_categories"] = """
SELECT DISTINCT o_orderpriority AS name, 'neutral' AS tone, o_orderpriority AS label FROM orders
"""
VIEWS["fx_market_events"] = """
SELECT CAST(d AS DATE) AS date, t AS title, c AS category, t AS description
FROM (VALUES ('1995-08-19','first shock','crisis'), ('1997-10-27','second shock','crisis'),
             ('1999-03-29','turn','recovery'), ('2000-03-10','peak','milestone')) AS v(d, t, c)
"""
VIEWS["fx_cutoffs"] = """
SELECT s.symbol, CAST(v.a AS DATE) AS asof FROM fx_symbols s
CROSS JOIN (VALUES ('1997-06-30'), ('2000-12-31'), ('2001-11-04')) AS v(a)
"""
VIEWS["fx_portfolios"] = """
SELECT p AS portfolio_id, s AS symbol, CAST(w AS DOUBLE) AS weight
FROM (VALUES ('equal','NATION_0',0.25),('equal','NATION_1',0.25),('equal','NATION_2',0.25),('equal','NATION_3',0.25),
             ('pair','NATION_4',0.7),('pair','NATION_5',0.3), ('single','NATION_6',1.0)) AS v(p, s, w)
"""
VIEWS["fx_orders_n"] = """
SELECT n.n_nationkey AS nk, n.n_name AS symbol, CAST(o.o_orderdate AS DATE) AS d, o.o_totalprice AS v
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""
VIEWS["fx_rev"] = """
SELECT symbol, nk,
  ROUND(SUM(CASE WHEN d > DATE '2000-08-01' THEN v ELSE 0 END), 2) AS r0,
  ROUND(SUM(CASE WHEN d > DATE '1999-08-01' AND d <= DATE '2000-08-01' THEN v ELSE 0 END), 2) AS r1,
  ROUND(SUM(CASE WHEN d > DATE '1998-08-01' AND d <= DATE '1999-08-01' THEN v ELSE 0 END), 2) AS r2
FROM fx_orders_n GROUP BY symbol, nk
"""
VIEWS["fx_fundamentals"] = """
SELECT symbol, CAST(nk AS BIGINT) AS cik, DATE '2001-08-01' AS asof,
  r0 AS revenue, r1 AS revenue_prior, r0 - r1 AS net_income, r1 - r2 AS net_income_prior,
  0.4 * r0 AS gross_profit, 0.4 * r1 AS gross_profit_prior,
  0.2 * r0 AS operating_income, 0.2 * r1 AS operating_income_prior,
  CASE WHEN nk % 5 = 0 THEN NULL ELSE 0.01 * r0 END AS interest_expense, 0.01 * r1 AS interest_expense_prior,
  0.15 * r0 AS ocf, 0.15 * r1 AS ocf_prior,
  CASE WHEN nk % 4 = 0 THEN NULL ELSE 0.05 * r0 END AS capex, 0.05 * r1 AS capex_prior,
  2.0 * r0 AS assets, 1.2 * r0 AS liabilities,
  CASE WHEN nk % 6 = 0 THEN -0.1 * r0 ELSE 0.8 * r0 END AS equity,
  0.5 * r0 AS assets_current, CASE WHEN nk % 7 = 0 THEN NULL ELSE 0.3 * r1 END AS liabilities_current,
  0.3 * r1 AS long_term_debt, CASE WHEN nk % 3 = 0 THEN NULL ELSE 0.05 * r1 END AS short_term_debt,
  CAST(1000 * (nk + 1) AS DOUBLE) AS shares_outstanding, CAST(NULL AS DOUBLE) AS earnings_stability
FROM fx_rev WHERE nk % 8 <> 7
"""
VIEWS["fx_analyst"] = """
SELECT symbol, 1.0 * rich / n AS analyst_score, CASE WHEN nk % 5 > 0 THEN 1.0 * building / n END AS target_upside,
       1.0 * (rich - building) / n AS eps_revision, CAST(n AS DOUBLE) AS n_analysts
FROM (SELECT n_nationkey AS nk, n_name AS symbol, CAST(COUNT(*) AS DOUBLE) AS n,
             CAST(COUNT(*) FILTER (WHERE c_acctbal > 5000) AS DOUBLE) AS rich,
             CAST(COUNT(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS DOUBLE) AS building
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
WHERE nk % 9 <> 4
"""
VIEWS["fx_parts"] = """
SELECT p.p_partkey AS k, p_name, p_brand, p_retailprice, COALESCE(b0, 0) AS b0, COALESCE(b1, 0) AS b1, COALESCE(b2, 0) AS b2,
       COALESCE(b3, 0) AS b3, COALESCE(b4, 0) AS b4, COALESCE(b5, 0) AS b5, COALESCE(b6, 0) AS b6,
       CAST(p_size AS BIGINT) AS b7, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS b8
FROM part p LEFT JOIN (
  SELECT l_partkey, COUNT(*) AS b0, SUM(CAST(l_quantity AS BIGINT)) AS b1, MAX(CAST(l_quantity AS BIGINT)) AS b2,
         MIN(CAST(l_quantity AS BIGINT)) AS b3, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS b4,
         COUNT(*) FILTER (WHERE l_returnflag = 'A') AS b5, COUNT(*) FILTER (WHERE l_shipdate < DATE '1998-01-01') AS b6
  FROM lineitem GROUP BY 1) ON l_partkey = p.p_partkey
"""
VIEWS["fx_quarters"] = """
SELECT nk, CAST(date_trunc('quarter', d) AS DATE) AS q, ROUND(SUM(v), 2) AS val
FROM fx_orders_n GROUP BY 1, 2
"""
VIEWS["fx_facts"] = """
SELECT CAST(nk AS BIGINT) AS cik, 'us-gaap' AS taxonomy, 'Revenues' AS tag, 'USD' AS unit, q AS start,
       CAST(q + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE) AS end_, val,
       CAST(q + INTERVAL '4' MONTH AS DATE) AS filed
FROM fx_quarters a
UNION ALL
SELECT CAST(nk AS BIGINT), 'us-gaap', 'Revenues', 'USD', q,
       CAST(q + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE), ROUND(1.01 * val, 2),
       CAST(q + INTERVAL '7' MONTH AS DATE)
FROM fx_quarters b
WHERE EXTRACT(MONTH FROM q) = 1
UNION ALL
SELECT CAST(nk AS BIGINT), 'us-gaap', 'Revenues', 'USD', y,
       CAST(y + INTERVAL '12' MONTH - INTERVAL '1' DAY AS DATE), val, CAST(y + INTERVAL '14' MONTH AS DATE)
FROM (SELECT nk, CAST(date_trunc('year', d) AS DATE) AS y, ROUND(SUM(v), 2) AS val FROM fx_orders_n WHERE nk % 2 = 0 GROUP BY 1, 2) c
UNION ALL
SELECT CAST(nk AS BIGINT), 'us-gaap', 'Assets', 'USD', CAST(NULL AS DATE),
       CAST(q + INTERVAL '3' MONTH - INTERVAL '1' DAY AS DATE), ROUND(2 * val, 2), CAST(q + INTERVAL '4' MONTH AS DATE)
FROM fx_quarters e
"""

# --- derived series, written against the fixture views ------------------------
VIEWS["v_ret"] = """
SELECT symbol, date, close, volume, close / NULLIF(p, 0) - p / NULLIF(p, 0) AS r
FROM (SELECT *, LAG(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM fx_bars)
"""
VIEWS["v_dd"] = """
SELECT symbol, date, close, volume, pk, (close - pk) / NULLIF(pk, 0) AS dd
FROM (SELECT *, MAX(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk
      FROM fx_bars)
"""
VIEWS["v_ma"] = """
SELECT symbol, date, close,
       CASE WHEN i >= 50 THEN a50 END AS ma_50, CASE WHEN i >= 200 THEN a200 END AS ma_200
FROM (SELECT symbol, date, close,
        ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS i,
        AVG(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS a50,
        AVG(close) OVER (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING) AS a200
      FROM fx_bars)
"""
VIEWS["v_vol"] = """
SELECT symbol, date, CASE WHEN n = 21 THEN s * SQRT(252) END AS v
FROM (SELECT symbol, date,
        COUNT(*) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS n,
        STDDEV_POP(r) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING) AS s
      FROM v_ret WHERE r IS NOT NULL)
"""
VIEWS["v_seqn"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn,
       ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date) AS i FROM fx_bars
"""
VIEWS["v_yearly"] = """
SELECT symbol, strftime(date, '%Y') AS year, ARG_MIN(close, date) AS o, ARG_MAX(close, date) AS c,
       MAX(close) AS hi, MIN(close) AS lo, AVG(volume) AS av, COUNT(*) AS n,
       (ARG_MAX(close, date) - ARG_MIN(close, date)) / NULLIF(ARG_MIN(close, date), 0) AS ret,
       CASE WHEN COUNT(*) < 240 THEN 1 ELSE 0 END AS part
FROM fx_bars GROUP BY 1, 2
"""
VIEWS["v_monthly"] = """
SELECT symbol, strftime(date, '%Y-%m') AS ym,
       (ARG_MAX(close, date) - ARG_MIN(close, date)) / NULLIF(ARG_MIN(close, date), 0) AS ret
FROM fx_bars GROUP BY 1, 2
"""
VIEWS["v_stats"] = """
SELECT s.symbol, s.name, s.sector, s.industry, s.is_index, b.*, m.dev * SQRT(252) AS ann_volatility,
       d.max_drawdown, v.current_volatility, m.last_daily_return,
       (last_close - first_close) / first_close AS total_return,
       (last_date - first_date) / 365.25 AS years,
       POW(last_close / first_close, 1 / GREATEST((last_date - first_date) / 365.25, 0.01)) - 1 AS cagr
FROM fx_symbols s
JOIN (SELECT symbol AS k, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS trading_days,
             ARG_MIN(close, date) AS first_close, ARG_MAX(close, date) AS last_close,
             MAX(close) AS highest_close, MIN(close) AS lowest_close, AVG(volume) AS avg_volume,
             AVG(close * volume) AS avg_dollar_volume FROM fx_bars GROUP BY symbol) b ON b.k = s.symbol
JOIN (SELECT symbol, STDDEV_POP(r) AS dev, ARG_MAX(r, date) AS last_daily_return
      FROM v_ret WHERE r IS NOT NULL GROUP BY symbol) m ON m.symbol = s.symbol
LEFT JOIN (SELECT symbol, MIN(dd) AS max_drawdown FROM v_dd GROUP BY symbol) d ON d.symbol = s.symbol
LEFT JOIN (SELECT symbol, ARG_MAX(v, date) AS current_volatility FROM v_vol WHERE v IS NOT NULL
           GROUP BY symbol) v ON v.symbol = s.symbol
"""

_WORD = re.compile(r"[A-Za-z_]\w*")


def with_clause(body: str) -> str:
    """A WITH list holding exactly the views the text needs, dependencies first."""
    needed: list[str] = []

    def visit(text):
        for word in _WORD.findall(text):
            if word in VIEWS and word not in needed:
                visit(VIEWS[word])
                needed.append(word)

    visit(body)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed) if needed else ""
