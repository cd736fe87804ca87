"""Headline queries at one scale; prints one JSON line.

Bars are landed once as a bucketed table (build_bars_table), rollups once
(build_rollups); live_* queries compute from the bars, read_* queries read the
rollups, the comparison the published baseline makes. Each query runs once cold;
the value reported is the faster of the next two runs.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tickwright.operators import catalog as C  # noqa: E402
from tickwright.operators import correlation as K  # noqa: E402
from tickwright.operators import events as E  # noqa: E402
from tickwright.operators import facts as X  # noqa: E402
from tickwright.operators import history as H  # noqa: E402
from tickwright.operators import market as M  # noqa: E402
from tickwright.operators import metrics as P  # noqa: E402
from tickwright.operators import portfolio as B  # noqa: E402
from tickwright.operators import questions as Q  # noqa: E402
from tickwright.operators import ranges as R  # noqa: E402
from tickwright.operators import ranking as N  # noqa: E402
from tickwright.operators import rollups as U  # noqa: E402
from tickwright.operators import series as S  # noqa: E402
from tickwright.plans.fixtures import INDEX, Fixtures  # noqa: E402
from tickwright.session import local_session, scratch_path  # noqa: E402
from tickwright.sources.bars import upsert_bars, write_bars_table  # noqa: E402

START, END = "1997-01-01", "2000-12-31"


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SPARK_LOCAL_DIRS", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    spark = local_session(cpus, shuffle_partitions=int(cpus), app="bench")
    f = Fixtures(spark, sf_dir)
    seconds, cold = {}, {}

    def timed(name, action, runs=3):
        times = []
        for _ in range(runs):
            began = time.perf_counter()
            action()
            times.append(time.perf_counter() - began)
        cold[name], seconds[name] = round(times[0], 4), round(min(times[1:] or times), 4)

    def query(name, make):
        timed(name, lambda: make().write.format("noop").mode("overwrite").save())

    timed("build_bars_table", lambda: write_bars_table(
        f.bars, "bars", scratch_path(spark, "bars"), buckets=int(cpus)), runs=2)
    bars = spark.table("bars")
    stocks, index = bars.filter(F.col("symbol") != INDEX), bars.filter(F.col("symbol") == INDEX)

    def land(df, name):
        path = scratch_path(spark, name)
        df.coalesce(1).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    dims = {n: land(getattr(f, n), n) for n in
            ("symbols", "universe", "fundamentals", "company_events", "categories", "facts")}
    symbols = dims["symbols"]
    rolled = {}

    def build_rollups():
        prices = P.price_metrics(stocks, index)
        rolled["stats"] = land(U.symbol_stats(bars, symbols), "stats")
        rolled["quote"] = land(U.latest_quote(bars), "quote")
        rolled["panel"] = land(P.metric_panel(dims["universe"], prices, dims["fundamentals"], f.analyst), "panel")

    timed("build_rollups", build_rollups, runs=2)
    stats, quote, panel = rolled["stats"], rolled["quote"], rolled["panel"]
    returns = S.daily_returns(bars)

    query("live_leaderboard", lambda: M.leaderboard(U.symbol_stats(bars, symbols)))
    query("read_leaderboard", lambda: M.leaderboard(stats))
    query("live_quote", lambda: U.latest_quote(bars).filter("symbol = 'NATION_7'"))
    query("read_quote", lambda: quote.filter("symbol = 'NATION_7'"))
    query("one_symbol_series", lambda: R.moving_averages_in_range(
        bars.filter("symbol = 'NATION_7'"), START, END))
    query("all_symbol_history", lambda: S.symbol_history(bars, START, END))
    found = C.write_index(C.dedupe_catalog(symbols, dims["universe"]), scratch_path(spark, "search-index"))
    query("local_company_search", lambda: C.search_index(
        found, spark.createDataFrame([("nation_1",)], "term string"), 8))
    query("window_stats", lambda: M.window_stats(bars, START, END))
    query("sector_performance", lambda: M.sector_performance(bars, symbols, START, END))
    query("period_movers", lambda: M.period_movers(bars, symbols, START, END))
    query("rolling_summary", lambda: M.rolling_return_summary(M.rolling_returns(bars, (63, 252, 504))))
    query("correlation_matrix", lambda: K.correlation_pairs(returns, START, END, n_symbols=26))
    query("nearest_partners", lambda: K.nearest_partners(returns, START, END, 5, n_symbols=26))
    query("portfolio_contribution", lambda: B.portfolio_contribution(bars, f.portfolios, symbols, START, END))
    query("drawdown_episodes", lambda: H.drawdown_episodes(bars, f.cutoffs, -0.02))
    query("streaks", lambda: H.streaks(bars, f.cutoffs))
    query("company_event_impact", lambda: E.company_event_impact(
        bars, dims["company_events"], dims["categories"], f.cutoffs))
    query("market_event_impact", lambda: E.market_event_impact(
        bars, f.market_events, f.cutoffs, 5, 0.02))
    query("price_metrics", lambda: P.price_metrics(stocks, index))
    query("rankings", lambda: N.rankings(panel, "Medium-Term"))
    query("facts_to_fundamentals", lambda: X.facts_to_fundamentals(dims["facts"]))
    query("upsert_bars", lambda: upsert_bars(bars, bars.filter("volume % 7 = 0")))
    questions = scratch_path(spark, "questions")
    f.questions.repartition(int(cpus)).write.parquet(questions)
    asked = spark.read.parquet(questions)
    query("score_intents", lambda: Q.score_intents(Q.tag_symbols(asked, symbols), INDEX))

    print(json.dumps({"metric": "total_warm_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "cold": cold,
                      "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
