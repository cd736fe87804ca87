"""Registered queries over reading, folding, validating, writing, building and streaming."""

from pyspark.sql import functions as F

from ..functions import guards as G
from ..operators import series as S
from ..session import scratch_path
from ..sources import bars as B
from ..sources import dimensions as D
from ..sources import events as E
from ..sources import payloads as P
from ..sources import sinks
from ..streaming import ingest as I
from . import build as X
from .checks import Check
from .fixtures import INDEX
from .oracle import VIEWS

_BAR = "symbol date@ open~6 high~6 low~6 close~6 adj_close~6 volume#"
# A second load that corrects some sessions: the close moves, the rest stays.
VIEWS["v_corrected"] = """
SELECT * REPLACE (CASE WHEN volume % 7 = 0 THEN close + 1 ELSE close END AS close) FROM fx_bars
"""


def _corrections(f):
    return f.bars.filter("volume % 7 = 0").withColumn("close", F.col("close") + 1)


def _through_csv(f):
    """Bars written as CSV and read back by the loader."""
    path = scratch_path(f.spark, "bars-csv")
    f.bars.write.option("header", True).csv(path)
    return B.read_bars(f.spark, path)


def _chart_documents(f):
    """Bars folded into one price document per symbol; some closes knocked out."""
    row = F.struct((F.unix_date("date").cast("long") * 86400 + 52200).alias("ts"), "open", "high", "low",
                   F.when(F.col("volume") % 11 != 0, F.col("close")).alias("close"),
                   F.when(F.col("volume") % 5 != 0, F.col("adj_close")).alias("adj"), "volume")
    packed = f.bars.groupBy("symbol").agg(F.array_sort(F.collect_list(row)).alias("r"))

    def series(name):
        return F.transform("r", lambda x: x[name])
    quote = F.struct(*[series(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    last, prev = F.element_at("r", -1), F.element_at("r", -2)
    meta = F.struct(F.lower("symbol").alias("symbol"), last["open"].alias("regularMarketPrice"),
                    F.when(F.substring("symbol", -1, 1) == "3", 0.0).otherwise(prev["open"])
                    .alias("chartPreviousClose"), last["high"].alias("regularMarketDayHigh"))
    result = F.struct(meta.alias("meta"), series("ts").alias("timestamp"), F.struct(
        F.array(quote).alias("quote"),
        F.array(F.struct(series("adj").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return packed.select("symbol", F.to_json(chart, {"ignoreNullFields": "false"}).alias("payload"))


def _directory_documents(f):
    """One columnar document per region, fields in another order than asked for."""
    s, n = f.table("supplier"), f.table("nation")
    venue = F.when(F.col("s_suppkey") % 3 == 0, "LSE").when(F.col("s_suppkey") % 3 == 1, "NYSE").otherwise("Nasdaq")
    row = F.array(F.lower(F.concat(F.lit("S."), F.col("s_suppkey").cast("string"))), venue,
                  F.col("s_suppkey").cast("string"), F.col("s_name"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_regionkey")
            .agg(F.collect_list(row).alias("data"))
            .select(F.to_json(F.struct(F.array(*[F.lit(x) for x in ("ticker", "exchange", "cik", "name")])
                                       .alias("fields"), "data")).alias("payload")))


def _search_documents(f):
    """Parts as search answers, one query per brand: quotes and news."""
    k = F.col("p_partkey")
    quote = F.struct(
        k.alias("k"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("symbol"),
        F.when(k % 4 != 0, F.col("p_name")).alias("shortname"), F.col("p_type").alias("longname"),
        F.when(k % 5 == 0, "ETF").otherwise("equity").alias("quoteType"),
        F.when(k % 3 == 0, "London").otherwise("NasdaqGS").alias("exchDisp"))
    pictures = F.array(F.struct(F.concat(F.lit("w/"), k.cast("string")).alias("url"), (k % 900 + 200).cast("int").alias("width")),
                       F.struct(F.concat(F.lit("n/"), k.cast("string")).alias("url"), F.lit(140).alias("width")))
    news = F.struct(k.alias("k"), F.when(k % 6 == 0, " ").otherwise(F.col("p_name")).alias("title"),
                    F.col("p_brand").alias("publisher"), k.alias("providerPublishTime"),
                    F.struct(F.when(k % 7 != 0, pictures).alias("resolutions")).alias("thumbnail"))
    packed = f.table("part").groupBy(F.col("p_brand").alias("query")).agg(
        F.array_sort(F.collect_list(quote)).alias("quotes"), F.array_sort(F.collect_list(news)).alias("news"))
    return packed.select("query", F.to_json(F.struct("quotes", "news")).alias("payload"))


def _raw_universe(f):
    k = F.col("c_custkey")
    return f.table("customer").select(
        F.col("c_name").alias("symbol"), F.when(k % 4 == 0, " ").otherwise(k.cast("string")).alias("cik"),
        F.col("c_name").alias("name"), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("sector"),
        F.when(k % 5 == 0, None).otherwise("NYSE").alias("exchange"))


def _dirty_numbers(f):
    k = F.col("c_custkey")
    text = (F.when(k % 4 == 0, "").when(k % 4 == 1, "None").when(k % 4 == 2, "n/a")
            .otherwise(F.col("c_acctbal").cast("string")))
    return f.table("customer").select(k.alias("c_custkey"), text.alias("figure"))


def _dirty_events(f):
    """Orders as curated events with planted faults."""
    k = F.col("o_orderkey")
    return f.orders_n.select(
        F.when(k % 11 == 0, "NOWHERE").otherwise(F.col("symbol")).alias("symbol"),
        F.when(k % 13 == 0, "1997-02-30").otherwise(F.col("d").cast("string")).alias("date"),
        F.when(k % 17 == 0, "  ").otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("title"),
        F.lit("text").alias("description"),
        F.when(k % 19 == 0, "OTHER").otherwise(F.col("o_orderpriority")).alias("category"),
        F.lit("orders").alias("source"))


def _event_documents(f):
    """Curated files of a few hundred events: one for each nation and month, one with the categories."""
    events = f.company_events.withColumn("date", F.col("date").cast("string"))
    e = (events.groupBy("symbol", F.substring("date", 1, 7).alias("month"))
         .agg(F.collect_list(F.struct(*events.columns)).alias("events")))
    c = f.categories.agg(F.collect_list(F.struct("*")).alias("categories"))     # the five priorities
    return e.select(F.to_json(F.struct("events")).alias("payload")).union(
        c.select(F.to_json(F.struct("categories")).alias("payload")))


def _loaded_events(f):
    events, categories = E.parse_company_events(_event_documents(f))
    return E.validate_events(events, f.symbols, categories)


def _sorted_csv(f):
    path = scratch_path(f.spark, "sorted-csv")
    sinks.sink_sorted_csv_gz(f.bars, path, 4)
    return B.read_bars(f.spark, path)


def _filtered_dimension(f):
    path = scratch_path(f.spark, "dimension-csv")
    sinks.sink_filtered_dimension(f.symbols, f.stocks.select("symbol").distinct(), path)
    return D.read_symbols(f.spark, path)


def _inputs(f):
    return {"prices": f.bars, "symbols": f.symbols, "company_events": f.company_events,
            "event_categories": f.categories, "market_events": f.market_events,
            "intel_prices": f.stocks, "intel_symbols": f.universe,
            "intel_fundamentals": f.fundamentals, "intel_analyst": f.analyst}


def _built(f):
    root = scratch_path(f.spark, "build")
    X.build_job(f.spark, _inputs(f), root, INDEX)
    return root


def _published(f):
    root = _built(f)
    tables = X.open_build(f.spark, root)
    quote = tables["latest_quote"].select("symbol", F.col("close").alias("newest_close"))
    panel = tables["metric_panel"].select("symbol", "vol_1y")
    return (tables["symbol_stats"].select("symbol", "cagr", "max_drawdown")
            .join(quote, "symbol").join(panel, "symbol", "left"))


def _manifest(f):
    root = _built(f)
    row = X.read_manifest(f.spark, root)
    current = X.build_is_current(f.spark, root)
    stale = X.build_is_current(f.spark, root, X.SCHEMA_VERSION + 1)
    return f.spark.createDataFrame([(row["data_version"], int(current), int(stale))],
                                   "data_version string, current int, current_under_newer int")


def _viewed(f):
    X.register_views(_inputs(f))
    return f.spark.sql("SELECT symbol, COUNT(*) AS n, MIN(drawdown) AS worst FROM drawdowns "
                       "WHERE symbol IN (SELECT symbol FROM symbols WHERE is_index = 0) GROUP BY symbol")


def _streamed(f, quotes=False):
    """Two landings taken by two runs of one query: the bars, then corrections."""
    base = scratch_path(f.spark, "stream")
    landing = f"{base}/landing"
    for i, rows in enumerate((f.bars, _corrections(f))):
        rows.repartition(4, "symbol").write.mode("append").option("header", True).csv(f"{landing}/load={i}")
        start = I.ingest_quotes if quotes else I.ingest
        start(f.spark, f"{landing}/load=*", f"{base}/log", f"{base}/checkpoint").awaitTermination()
    return (I.quotes_from_log if quotes else I.bars_from_log)(f.spark, f"{base}/log")


_CHART_SQL = """
SELECT symbol, date, open, high, low, close, CASE WHEN volume % 5 <> 0 THEN adj_close ELSE close END AS adj_close, volume
FROM fx_bars WHERE volume % 11 <> 0
"""


def _anniversaries(f):
    """Sessions on the calendar day of a market event."""
    day = F.date_format("date", "MM-dd")
    events = E.market_events(f.spark).select(day.alias("day"), "title", "category")
    return f.bars.select("symbol", "date", day.alias("day")).join(events, "day")


def _guarded(f):
    r = F.col("daily_return")
    big = F.abs(r) * 1e4
    return S.daily_returns(f.bars).filter(r.isNotNull()).select(
        "symbol", "date", G.sqrt_or_null(r).alias("root"), G.ln_or_null(r).alias("log"),
        G.ln_or_null(G.exp_or_null(big)).alias("exp_log"), G.pow_or_null(r, F.lit(0.5)).alias("power"),
        G.floor_at(r, 0.0).alias("floored"), G.ratio(r, r).alias("itself"))


CHECKS = [
    Check("scan_csv_bars", _BAR, _through_csv, "SELECT * FROM fx_bars"),
    Check("scan_wide_bars", "n#",
          lambda f: B.read_wide_bars(f.spark, scratch_path(f.spark, "absent")).unionByName(f.stocks)
          .agg(F.count("*").alias("n")), "SELECT COUNT(*) AS n FROM fx_bars WHERE symbol <> 'MARKET'"),
    Check("scan_symbols", "symbol name sector industry is_index#", 
          lambda f: D.read_symbols(f.spark, _written(f, f.symbols)), "SELECT * FROM fx_symbols"),
    Check("scan_universe", "symbol cik# name sector exchange", lambda f: D.read_universe(f.spark, _written(f, _raw_universe(f))),
          """SELECT c_name AS symbol, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS cik, c_name AS name,
                    CASE WHEN c_custkey % 3 = 0 THEN 'Unclassified' ELSE c_mktsegment END AS sector,
                    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'NYSE' END AS exchange FROM customer"""),
    Check("scan_fundamentals", "c_custkey# figure~2", lambda f: D.clean_numeric(_dirty_numbers(f), ["figure"]),
          "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_acctbal END AS figure FROM customer"),
    Check("scan_analyst", "symbol analyst_score~8 target_upside~8 eps_revision~8 n_analysts#",
          lambda f: f.universe.select("symbol").join(f.analyst.unionByName(
              D.read_analyst(f.spark, scratch_path(f.spark, "absent"))), "symbol", "left"),
          "SELECT u.symbol, a.* EXCLUDE (symbol) FROM fx_universe u LEFT JOIN fx_analyst a ON a.symbol = u.symbol"),
    Check("scan_company_events", "symbol date@ title description category source", _loaded_events,
          "SELECT * FROM fx_company_events"),
    Check("scan_market_events", "symbol date@ title category", _anniversaries,
          f"""SELECT b.symbol, b.date, m.title, m.category FROM fx_bars b
              JOIN (VALUES {', '.join(f"('{d[5:]}', '{t}', '{c}')" for d, t, c, _ in E.MARKET_EVENTS)}) AS m(day, title, category)
                ON strftime(b.date, '%m-%d') = m.day"""),
    Check("parse_price_payload", _BAR, lambda f: P.parse_price_payload(_chart_documents(f)), _CHART_SQL),
    Check("parse_quote_payload", "symbol name price~6 prev_close~6 change~6 change_pct~8 day_high~6",
          lambda f: P.parse_quote_payload(_chart_documents(f)),
          """SELECT q.symbol, q.symbol AS name, q.open AS price, CASE WHEN q.symbol[-1:] <> '3' THEN p.open END AS prev_close,
                    CASE WHEN q.symbol[-1:] <> '3' THEN q.open - p.open END AS change,
                    CASE WHEN q.symbol[-1:] <> '3' THEN q.open / p.open - 1 END AS change_pct, q.high AS day_high
             FROM v_seqn q JOIN v_seqn p ON p.symbol = q.symbol AND q.rn = 1 AND p.rn = 2"""),
    Check("parse_ticker_directory", "symbol cik# name exchange",
          lambda f: P.parse_ticker_directory(_directory_documents(f)),
          """SELECT CONCAT('S-', CAST(s_suppkey AS VARCHAR)) AS symbol, s_suppkey AS cik, s_name AS name,
                    CASE s_suppkey % 3 WHEN 1 THEN 'NYSE' ELSE 'Nasdaq' END AS exchange
             FROM supplier WHERE s_suppkey % 3 <> 0"""),
    Check("parse_search_payload", "query rank# symbol name exchange",
          lambda f: P.parse_search_payload(_search_documents(f), 6),
          """SELECT query, ROW_NUMBER() OVER (PARTITION BY query ORDER BY k) AS rank, symbol, name, 'NasdaqGS' AS exchange
             FROM (SELECT p_brand AS query, CONCAT('P', CAST(p_partkey % 40 AS VARCHAR)) AS symbol, MIN(p_partkey) AS k,
                          ARG_MIN(CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE p_type END, p_partkey) AS name
                   FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 GROUP BY 1, 2) QUALIFY rank <= 6"""),
    Check("parse_news_payload", "query rank# title publisher published# thumb",
          lambda f: P.parse_news_payload(_search_documents(f), 4),
          """SELECT p_brand AS query, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank,
                    TRIM(p_name) AS title, p_brand AS publisher, p_partkey AS published,
                    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE CONCAT('n/', CAST(p_partkey AS VARCHAR)) END AS thumb
             FROM part WHERE p_partkey % 6 <> 0 QUALIFY rank <= 4"""),
    Check("register_views", "symbol n# worst~8", _viewed,
          "SELECT symbol, COUNT(*) AS n, MIN(dd) AS worst FROM v_dd WHERE symbol <> 'MARKET' GROUP BY symbol"),
    Check("upsert_bars", _BAR, lambda f: B.upsert_bars(f.bars, _corrections(f)), "SELECT * FROM v_corrected"),
    Check("validate_events", "symbol date title category reason",
          lambda f: E.event_violations(_dirty_events(f), f.symbols, f.categories),
          """SELECT symbol, date, title, category, UNNEST(list_filter([
               CASE WHEN TRIM(title) = '' THEN 'blank title' END, CASE WHEN symbol = 'NOWHERE' THEN 'unknown symbol' END,
               CASE WHEN category = 'OTHER' THEN 'unknown category' END,
               CASE WHEN date = '1997-02-30' THEN 'date is not ISO' END], lambda x: x IS NOT NULL)) AS reason
             FROM (SELECT CASE WHEN k % 11 = 0 THEN 'NOWHERE' ELSE symbol END AS symbol,
                     CASE WHEN k % 13 = 0 THEN '1997-02-30' ELSE CAST(d AS VARCHAR) END AS date,
                     CASE WHEN k % 17 = 0 THEN '  ' ELSE CONCAT('order ', CAST(k AS VARCHAR)) END AS title,
                     CASE WHEN k % 19 = 0 THEN 'OTHER' ELSE p END AS category
                   FROM (SELECT o.o_orderkey AS k, n.n_name AS symbol, CAST(o.o_orderdate AS DATE) AS d, o.o_orderpriority AS p
                         FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                         JOIN nation n ON c.c_nationkey = n.n_nationkey))"""),
    Check("join_anti_validation", "symbol n#",
          lambda f: f.orders_n.select("symbol").join(f.universe.filter("exchange = 'NYSE'"), "symbol", "left_anti")
          .groupBy("symbol").agg(F.count("*").alias("n")),
          """SELECT n_name AS symbol, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 2 = 1 GROUP BY 1"""),
    Check("join_semi_membership", "symbol name",
          lambda f: sinks.surviving(f.symbols, f.orders_n.select("symbol").distinct()),
          """SELECT symbol, name FROM fx_symbols WHERE symbol IN (SELECT n_name FROM nation
             JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)"""),
    Check("join_dimension", "sector is_index# n# volume#",
          lambda f: f.bars.join(f.symbols, "symbol").groupBy("sector", "is_index")
          .agg(F.count("*").alias("n"), F.sum("volume").alias("volume")),
          """SELECT s.sector, s.is_index, COUNT(*) AS n, SUM(b.volume) AS volume FROM fx_bars b
             JOIN fx_symbols s ON s.symbol = b.symbol GROUP BY 1, 2"""),
    Check("join_left_on_date", "symbol date@ ann_volatility_21d~8",
          lambda f: S.with_features(f.bars),
          """SELECT symbol, date, CASE WHEN r IS NOT NULL AND COUNT(*) OVER w = 21
                    THEN STDDEV_POP(r) OVER w * SQRT(252) END AS ann_volatility_21d
             FROM v_ret WINDOW w AS (PARTITION BY symbol, r IS NULL ORDER BY date ROWS 20 PRECEDING)"""),
    Check("materialize_rollups", "symbol cagr~8 max_drawdown~8 newest_close~6 vol_1y~8", _published,
          """SELECT s.symbol, s.cagr, s.max_drawdown, s.last_close AS newest_close, p.vol_1y FROM v_stats s
             LEFT JOIN v_pm p ON p.symbol = s.symbol"""),
    Check("build_job", "data_version current# current_under_newer#", _manifest,
          "SELECT data_version, 1 AS current, 0 AS current_under_newer FROM v_version"),
    Check("data_version", "data_version",
          lambda f: X.data_version(f.stocks, f.fundamentals, f.analyst, f.bars), "SELECT * FROM v_version"),
    Check("build_is_current", "current#", _manifest, "SELECT 1 AS current"),
    Check("sink_sorted_csv_gz", _BAR, _sorted_csv, "SELECT * FROM fx_bars"),
    Check("sink_filtered_dimension", "symbol name sector industry is_index#", _filtered_dimension,
          "SELECT * FROM fx_symbols WHERE symbol IN (SELECT symbol FROM fx_bars WHERE symbol <> 'MARKET')"),
    Check("guarded_functions", "symbol date@ root~8 log~8 exp_log~6 power~8 floored~8 itself~4", _guarded,
          """SELECT symbol, date, CASE WHEN r >= 0 THEN SQRT(r) END AS root, CASE WHEN r > 0 THEN LN(r) END AS log,
                    CASE WHEN ABS(r) * 1e4 < 709.782712893 THEN ABS(r) * 1e4 END AS exp_log, CASE WHEN r >= 0 THEN SQRT(r) END AS power,
                    GREATEST(r, 0) AS floored, r / NULLIF(r, 0) AS itself FROM v_ret WHERE r IS NOT NULL"""),
    Check("stream_bar_ingest", _BAR, _streamed, "SELECT * FROM v_corrected"),
    Check("stream_latest_quote", "symbol date@ close~6 prev_close~6 daily_return~8 w52_high~6",
          lambda f: _streamed(f, True),
          """SELECT q.symbol, q.date, q.close, p.close AS prev_close, q.close / p.close - 1 AS daily_return, y.hi AS w52_high
             FROM v_cseq q JOIN v_cseq p ON p.symbol = q.symbol AND q.rn = 1 AND p.rn = 2
             JOIN (SELECT b.symbol, MAX(b.high) AS hi FROM v_cseq b JOIN v_cseq e ON e.symbol = b.symbol AND e.rn = 1
                   AND b.date >= e.date - INTERVAL 12 MONTH GROUP BY 1) y ON y.symbol = q.symbol"""),
]
VIEWS["v_cseq"] = """
SELECT *, ROW_NUMBER() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM v_corrected
"""
VIEWS["v_version"] = """
SELECT CONCAT_WS('|', (SELECT CONCAT_WS('|', MAX(date), COUNT(*)) FROM fx_bars WHERE symbol <> 'MARKET'),
       (SELECT CONCAT_WS('|', MAX(asof), COUNT(*)) FROM fx_fundamentals), (SELECT CAST(COUNT(*) AS VARCHAR) FROM fx_analyst),
       (SELECT CONCAT_WS('|', MAX(date), COUNT(*)) FROM fx_bars)) AS data_version
"""


def _written(f, df):
    path = scratch_path(f.spark, "csv")
    df.write.option("header", True).csv(path)
    return path
