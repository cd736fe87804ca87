"""Build, files, streaming, and the shape of plans."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from tickwright import schemas
from tickwright.operators import history as H
from tickwright.operators import market as M
from tickwright.operators import metrics as P
from tickwright.operators import portfolio as W
from tickwright.operators import rollups as U
from tickwright.operators import series as S
from tickwright.operators.asof import asof_join
from tickwright.plans import build as X
from tickwright.plans import partials as T
from tickwright.plans.entries_io import _inputs
from tickwright.plans.fixtures import INDEX
from tickwright.plans.templates import answer
from tickwright.sources import bars as B
from tickwright.sources import dimensions as D
from tickwright.sources import events as E
from tickwright.streaming import ingest as I
from tickwright.streaming import log as L


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- files ---------------------------------------------------------------------
def test_the_gzip_copy_is_read_first_and_blanks_are_null(spark, tmp_path):
    head = "symbol,date,open,high,low,close,adj_close,volume\n"
    (tmp_path / "p.csv").write_text(head + "OLD,2020-01-01,1,1,1,1,1,1\n")
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(head + "NEW,2020-01-01,1.5,,1,,1,9\n")
    row, = B.read_bars(spark, str(tmp_path / "p.csv")).collect()
    assert (row["symbol"], row["high"], row["close"], row["volume"]) == ("NEW", None, None, 9)
    with pytest.raises(FileNotFoundError):
        B.read_bars(spark, str(tmp_path / "absent.csv"))
    assert B.read_wide_bars(spark, str(tmp_path / "absent.csv")).schema == schemas.BARS


def test_optional_dimensions(spark, tmp_path):
    assert D.read_analyst(spark, str(tmp_path / "no.csv")).schema == schemas.ANALYST
    (tmp_path / "f.csv").write_text("symbol,cik,asof,revenue,equity\nA,7,2020-12-31,None,\nB,,,12.5,x\n")
    a, b = D.read_fundamentals(spark, str(tmp_path / "f.csv")).orderBy("symbol").collect()
    assert (a["cik"], a["revenue"], a["equity"], a["assets"]) == (7, None, None, None)
    assert (b["cik"], b["asof"], b["revenue"], b["equity"]) == (None, None, 12.5, None)


def test_last_load_of_a_key_wins(make_bars, spark):
    old = make_bars({"A": [1.0, 2.0], "B": [5.0]})
    new = (make_bars({"A": [9.0]}).withColumn("load_seq", F.lit(1))
           .unionByName(make_bars({"A": [8.0]}).withColumn("load_seq", F.lit(2))))
    got = {(r["symbol"], r["date"].day): r["close"] for r in B.upsert_bars(old, new).collect()}
    assert got == {("A", 1): 8.0, ("A", 2): 2.0, ("B", 1): 5.0}


def test_bad_events_fail_the_load(spark, small):
    events = small.company_events.withColumn("date", F.col("date").cast("string"))
    assert E.validate_events(events, small.symbols, small.categories).count() == events.count()
    for column, value in (("title", " "), ("symbol", "NOWHERE"), ("category", "NONE"), ("date", "2020-2-3"),
                          ("date", "2021-02-30"), ("source", None)):
        bad = events.unionByName(events.limit(1).withColumn(column, F.lit(value).cast("string")))
        with pytest.raises(ValueError):
            E.validate_events(bad, small.symbols, small.categories)


def test_market_events_are_dated_in_order(spark):
    rows = E.market_events(spark).orderBy("date").collect()
    assert len(rows) == 12 and str(rows[0]["date"]) == "2002-10-09"


# --- build ---------------------------------------------------------------------
def test_a_failed_build_leaves_the_published_one(spark, small, tmp_path):
    root = str(tmp_path / "store")
    assert X.read_manifest(spark, root) is None and not X.build_is_current(spark, root)
    first = X.build_job(spark, _inputs(small), root, INDEX)
    version = X.read_manifest(spark, root)["data_version"]
    broken = {**_inputs(small), "company_events": small.company_events.withColumn("title", F.lit(""))}
    with pytest.raises(ValueError):
        X.build_job(spark, broken, root, INDEX)
    assert X.read_manifest(spark, root)["run"] == first and X.build_is_current(spark, root)
    second = X.build_job(spark, _inputs(small), root, INDEX)
    again = X.read_manifest(spark, root)
    assert again["run"] == second != first and again["data_version"] == version
    os.remove(f"{root}/builds/{second}/latest_quote/_SUCCESS")
    assert not X.build_is_current(spark, root)


def test_a_delta_rewrites_only_the_months_it_touches(spark, small, tmp_path):
    root, bars = str(tmp_path / "store"), small.bars
    inputs = _inputs(small)
    last = bars.agg(F.max("date")).first()[0]

    def closely(df, want):
        a, b = (sorted(x.select(want.columns).collect(), key=lambda r: r["symbol"]) for x in (df, want))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for c in want.columns:
                assert x[c] == (pytest.approx(y[c], rel=1e-9, abs=1e-9) if isinstance(y[c], float) else y[c]), (x["symbol"], c)

    def check(prices):
        X.build_job(spark, {**inputs, "prices": prices}, root, INDEX)
        built = X.open_build(spark, root)
        closely(built["symbol_stats"], U.symbol_stats(prices, inputs["symbols"]))
        closely(built["latest_quote"], U.latest_quote(prices))
        assert rows_of(built["prices"]) == rows_of(prices)
        row = X.read_manifest(spark, root)
        index = {r["month"]: r["path"] for r in T.read_index(spark, f"{row['tables']['prices']}/index").collect()}
        return row, {m for m, p in index.items() if p.endswith(row["run"])}

    first, months = check(bars.filter(F.col("date") < last))
    assert len(months) > 50
    second, touched = check(bars)
    assert touched == {str(last)[:7]}
    assert second["tables"]["symbols"] == first["tables"]["symbols"] and second["tables"]["prices"] != first["tables"]["prices"]
    fixed = bars.withColumn("close", F.when(F.col("date") == "1996-03-05", F.col("close") * 3).otherwise(F.col("close")))
    more = fixed.union(bars.filter("symbol = 'NATION_1' AND date < '1995-03-01'").withColumn("symbol", F.lit("NEW")))
    _, touched = check(more.filter("symbol <> 'NATION_3' OR date < '2001-01-01'"))
    assert "1996-03" in touched and len(touched) < 20
    third, touched = check(more.filter("symbol <> 'NATION_3' OR date < '2001-01-01'"))
    assert touched == set() and X.build_is_current(spark, root)
    again, _ = check(more.filter("symbol <> 'NATION_3' OR date < '2001-01-01'"))
    assert again["tables"]["metric_panel"] == third["tables"]["metric_panel"]


def test_every_template_answers(spark, small):
    stats, quote = U.symbol_stats(small.bars, small.symbols), U.latest_quote(small.bars)
    tables = {"prices": small.bars, "symbols": small.symbols, "symbol_stats": stats, "latest_quote": quote}
    names = [r[0] for r in small.stocks.select("symbol").distinct().orderBy("symbol").limit(2).collect()]
    params = {"start": "1995-01-01", "end": "2001-12-31", "limit": 3, "symbols": names}
    from tickwright.operators.questions import INTENTS
    for intent, *_ in INTENTS:
        for part, df in answer(intent, tables, params).items():
            assert df.count() > 0, (intent, part)
    assert answer("biggest_winners", tables, params)["rows"].count() == 3
    upward = answer("biggest_winners", tables, params | {"metric": "volume", "ordering": "asc"})["rows"]
    volumes = [r["avg_dollar_volume"] for r in upward.collect()]
    assert volumes == sorted(volumes)


# --- streaming -----------------------------------------------------------------
def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_ingest_resumes_and_equals_the_batch(spark, make_bars, tmp_path):
    landing, log, quotes = (str(tmp_path / x) for x in ("landing", "log", "quotes"))
    first = make_bars({"A": [1.0, 2.0], "B": [5.0, 6.0]})
    later = make_bars({"A": {"2020-01-02": 3.0, "2020-01-03": 4.0}, "C": [7.0]})

    def run(rows, name):
        if rows is not None:
            rows.coalesce(1).write.option("header", True).csv(f"{landing}/{name}")
        I.ingest(spark, f"{landing}/*", log, str(tmp_path / "ckpt")).awaitTermination()
        I.ingest_quotes(spark, f"{landing}/*", quotes, str(tmp_path / "ckpt-quotes")).awaitTermination()
        return rows_of(I.bars_from_log(spark, log))

    assert run(first, "one") == rows_of(first)
    assert rows_of(I.quotes_from_log(spark, quotes)) == rows_of(U.latest_quote(first))
    want = rows_of(B.upsert_bars(first, later))
    assert run(later, "two") == want
    assert run(None, None) == want
    assert rows_of(I.quotes_from_log(spark, quotes)) == rows_of(U.latest_quote(B.upsert_bars(first, later)))
    assert rows_of(I.compact(spark, log)) == want and len(L.live_segments(spark, log)) == 1


def test_quotes_are_kept_without_the_log(spark, make_bars, tmp_path):
    """Corrections, late bars, gaps of over a year and blank prices, batch by batch, as one latest_quote over all."""
    import random
    pick = random.Random(8)
    landing, quotes = str(tmp_path / "landing"), str(tmp_path / "quotes")
    whole = None
    for i in range(5):
        closes = {}
        for s in ("A", "B", "C")[:1 + i % 3]:
            year = 2018 + i // 2
            days = {f"{year}-{pick.randrange(1, 13):02d}-{pick.randrange(1, 29):02d}" for _ in range(12)}
            days |= {"2020-02-29", "2019-02-28"} if i == 3 else set()
            closes[s] = {d: pick.choice([None, *range(1, 90)]) for d in days}
            closes[s] = {d: None if c is None else float(c) for d, c in closes[s].items()}
        rows = make_bars(closes)
        rows.coalesce(1).write.option("header", True).csv(f"{landing}/{i}")
        I.ingest_quotes(spark, f"{landing}/*", quotes, str(tmp_path / "ckpt")).awaitTermination()
        whole = rows if whole is None else B.upsert_bars(whole, rows)
        assert rows_of(I.quotes_from_log(spark, quotes)) == rows_of(U.latest_quote(whole)), i


def test_a_replayed_load_changes_nothing(spark, make_bars, tmp_path):
    log = str(tmp_path / "log")
    for closes in ([1.0, 2.0], [9.0, 9.0]):
        L.append_load(make_bars({"A": closes}), log, 0, I.BAR_KEY)
    assert [r["close"] for r in I.bars_from_log(spark, log).orderBy("date").collect()] == [1.0, 2.0]


def test_segments_stay_few_and_the_last_load_wins(spark, make_bars, tmp_path):
    log, want = str(tmp_path / "log"), {}
    most = 0
    for load in range(20):
        closes = {f"2020-01-{1 + (load * 7 + j) % 28:02d}": float(load * 10 + j) for j in range(3)}
        want.update(closes)
        L.append_load(make_bars({"A": closes}), log, load, I.BAR_KEY, fanout=3)
        most = max(most, len(L.live_segments(spark, log)))
    assert most <= 3
    assert {str(r["date"]): r["close"] for r in I.bars_from_log(spark, log).collect()} == want
    entries = L.live_segments(spark, log)
    assert entries[0]["first_load"] == 0 and entries[-1]["last_load"] == 19
    text = plan(I.bars_from_log(spark, log).filter("symbol = 'A'"))
    assert "EqualTo(symbol,A)" in text


def test_segments_merge_by_size():
    def entries(*sizes):
        return [{"rows": r, "path": str(i), "first_load": i, "last_load": i} for i, r in enumerate(sizes)]
    big = L.CLASS_ROWS * 100
    assert [len(r) for r in L._runs(entries(big, 1, 1, 1))] == [3, 4]
    assert max(len(r) for r in L._runs(entries(big, 1, 1))[:1]) == 2
    assert L.size_class(1) == 0 and L.size_class(L.CLASS_ROWS * 3) == 1 and L.size_class(big) > 3


# --- plans ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def table(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bars") / "t")
    B.write_bars_table(small.bars, "bars_by_symbol", path, buckets=4)
    return spark.table("bars_by_symbol")


def test_bucketed_bars_need_no_shuffle(table, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for df in (S.with_features(table), U.latest_quote(table), M.window_stats(table, "1995-01-01", "2001-01-01"),
                   M.rolling_return_summary(M.rolling_returns(table, (63,))), U.yearly_summary(table)):
            assert "Exchange" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_windows_share_one_sort(table):
    assert plan(S.daily_returns(table).select("*")).count("Sort [") <= 1
    assert plan(S.drawdowns(table)).count("Sort [") <= 1


def test_symbol_filter_reaches_the_scan_and_date_filter_does_not_pass_the_window(table):
    text = plan(S.moving_averages(table).filter("symbol = 'NATION_1' AND date > DATE '1999-01-01'"))
    scan = text[text.index("FileScan"):]
    assert "EqualTo(symbol,NATION_1)" in scan and "GreaterThan(date" not in scan
    assert "open" not in scan[scan.index("ReadSchema"):]


def test_no_nested_loops_or_single_partitions(table, small, spark):
    cutoffs = small.cutoffs
    for df in (asof_join(small.company_events, table, ["close"]),
               H.drawdown_episodes(table, cutoffs), H.record_summary(table, cutoffs),
               H.streaks(table, cutoffs), H.extreme_days(table, cutoffs),
               M.peer_pick(table, small.symbols, "1995-01-01", "2001-12-31"),
               P.price_metrics(table, table.filter(F.col("symbol") == INDEX))):
        text = plan(df)
        for word in ("NestedLoop", "Cartesian", "SinglePartition"):
            assert word not in text


def test_a_record_is_read_in_one_or_two_scans_whatever_the_limit(table, small, spark):
    cutoffs = small.cutoffs
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        def scans(df):
            return plan(df).count("FileScan parquet spark_catalog.default.bars_by_symbol")
        assert scans(H.record_states(table)) == 1 and "Exchange" not in plan(H.record_states(table))
        assert scans(H.extreme_days(table, cutoffs)) == 1
        assert scans(H.asof_snapshot(table, cutoffs)) == scans(H.record_summary(table, cutoffs)) == 1
        assert scans(H.drawdown_episodes(table, cutoffs)) == scans(H.streaks(table, cutoffs)) == 2
        for op in (H.extreme_days, H.streaks):
            few, many = (plan(op(table, cutoffs, limit=n)) for n in (3, 1000))
            assert few.count("\n") == many.count("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_answers_that_reduce_the_bars_twice_read_them_once(table, small):
    def scans(df):
        return plan(df).count("FileScan parquet spark_catalog.default.bars_by_symbol")
    dates = "1995-01-01", "2001-12-31"
    for df in (M.sector_performance(table, small.symbols, *dates), M.market_breadth(table, small.symbols, *dates),
               M.peer_pick(table, small.symbols, *dates),
               W.portfolio_contribution(table, W.normalize_weights(small.portfolios), small.symbols, *dates)):
        assert scans(df) == 0                 # the one scan went into the written table
    assert scans(W.portfolio_vs_index(table, W.normalize_weights(small.portfolios), *dates, INDEX)) == 1


def test_written_states_answer_like_the_bars(small, spark):
    from tickwright.session import persist_table
    bars, cutoffs = small.bars, small.cutoffs
    states = persist_table(H.record_states(bars), "record-states")
    deep = lambda b, c, states: H.drawdown_episodes(b, c, -0.02, states)      # noqa: E731
    for op in (H.asof_snapshot, H.record_summary, deep, H.streaks, H.extreme_days):
        one, other = (sorted(map(str, op(bars, cutoffs, states=x).collect())) for x in (None, states))
        assert one and one == other


def test_every_query_has_an_oracle():
    from tickwright.plans.registry import CHECKS
    assert all(check.sql is not None for check in CHECKS.values())
