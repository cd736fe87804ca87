import math

import pytest
from pyspark.sql import functions as F

from tickwright.functions import guards as G
from tickwright.functions import places as P
from tickwright.operators import ranges as R
from tickwright.operators import rollups as U
from tickwright.operators import series as S


def value(spark, column, x):
    df = spark.createDataFrame([(x,)], "x double")
    return df.select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("column, x, want", [
    (G.sqrt_or_null, -1.0, None), (G.sqrt_or_null, 9.0, 3.0),
    (G.ln_or_null, 0.0, None), (G.exp_or_null, 1000.0, None),
    (lambda c: G.pow_or_null(c, F.lit(0.5)), -4.0, None),
    (lambda c: G.pow_or_null(c, F.lit(-1.0)), 0.0, None),
    (lambda c: G.floor_at(c, 0.0), None, None), (lambda c: G.floor_at(c, 0.0), -2.0, 0.0),
    (lambda c: G.ratio(F.lit(1.0), c), 0.0, None), (lambda c: G.clamp(c, -1.0, 1.0), 1.5, 1.0),
])
def test_guards_answer_null_outside_their_domain(spark, column, x, want):
    assert value(spark, column, x) == want


def test_growth_uses_a_shortest_span(spark):
    df = spark.sql("SELECT DATE '2020-01-01' a, DATE '2020-01-02' b")
    got = df.select(G.growth_rate(F.lit(1.0), F.lit(1.1), F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(1.1 ** 100 - 1)


def test_return_after_a_zero_close_is_null(make_bars):
    rows = S.daily_returns(make_bars({"A": [0.0, 5.0, 10.0]})).orderBy("date").collect()
    assert [r["daily_return"] for r in rows] == [None, None, 1.0]


def test_volatility_frame_counts_only_present_returns(make_bars):
    closes = [100.0 * 1.01 ** (i % 3) for i in range(30)]
    closes[10] = None
    rows = S.with_features(make_bars({"A": closes})).orderBy("date").collect()
    present = [r for r in rows if r["daily_return"] is not None]
    assert [r["ann_volatility_21d"] is None for r in present] == [True] * 20 + [False] * (len(present) - 20)
    assert all(r["ann_volatility_21d"] is None for r in rows if r["daily_return"] is None)
    tail = [r["daily_return"] for r in present[-21:]]
    mean = sum(tail) / 21
    want = math.sqrt(sum((x - mean) ** 2 for x in tail) / 21) * math.sqrt(252)
    assert present[-1]["ann_volatility_21d"] == pytest.approx(want)


def test_averages_are_null_until_full_and_know_the_past(make_bars):
    bars = make_bars({"A": [float(i) for i in range(1, 61)]})
    rows = R.moving_averages_in_range(bars, "2020-02-19", "2020-02-29").orderBy("date").collect()
    assert rows[0]["ma_50"] == pytest.approx(sum(range(1, 51)) / 50)
    assert rows[0]["ma_200"] is None


def test_cumulative_return_counts_the_first_return_of_the_window(make_bars):
    bars = make_bars({"A": [100.0, 110.0, 121.0]})
    first = R.cumulative_return(bars, "2020-01-02", "2020-01-03").orderBy("date").first()
    assert first["cumulative_return"] == pytest.approx(0.10)
    rebased = S.symbol_history(bars, "2020-01-02", "2020-01-03").orderBy("date").first()
    assert rebased["cumulative_return"] == pytest.approx(0.0)


def test_one_session_symbol_has_no_stats_but_has_a_quote(make_bars, spark):
    bars = make_bars({"A": [5.0]})
    symbols = spark.createDataFrame([("A", "A Co", "X", "Y", 0)],
                                    "symbol string, name string, sector string, industry string, is_index int")
    assert U.symbol_stats(bars, symbols).count() == 0
    quote = U.latest_quote(bars).first()
    assert quote["prev_close"] is None and quote["daily_return"] is None


def test_quote_range_is_the_last_year_only(make_bars):
    bars = make_bars({"A": {"2019-01-01": 900.0, "2020-06-01": 10.0, "2021-01-04": 20.0}})
    quote = U.latest_quote(bars).first()
    assert (quote["w52_high"], quote["w52_low"], quote["prev_close"]) == (20.0, 10.0, 10.0)


def test_comparison_rejects_unknown_metric(make_bars):
    with pytest.raises(KeyError):
        R.comparison_series(make_bars({"A": [1.0]}), ["A"], "2020-01-01", "2020-02-01", "nope")


def test_table_query_pages_and_keeps_nulls_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0), ("d", 2.0)], "symbol string, v double")
    first = [r[0] for r in R.table_query(df, sort="v", ascending=False, per_page=3).collect()]
    second = [r[0] for r in R.table_query(df, sort="v", ascending=False, per_page=3, page=2).collect()]
    assert (first, second) == (["c", "d", "a"], ["b"])
    hits = R.table_query(df, term=" B ", search_cols=("symbol",)).collect()
    assert [r[0] for r in hits] == ["b"]


def test_places_over_keys_with_nulls_and_ties(spark, tmp_path):
    import random
    pick = random.Random(3)
    rows = [(pick.choice([None, 1.0, 2.0, 2.5]), pick.choice([None, "a", "b"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "v double, s string, i int").repartition(7)
    order = {"v": False, "s": True, "i": False}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, r[1] or "", -r[2]))
    got = [tuple(r)[:3] for r in P.with_place(df, order).orderBy("place").collect()]
    assert got == want and [r["place"] for r in P.with_place(df, order).orderBy("place").collect()] == list(range(1, 401))
    twins = spark.createDataFrame([(1, "x")] * 5 + [(0, "y")], "a int, b string")
    assert sorted(r["place"] for r in P.with_place(twins, {"a": True}).collect()) == [1, 2, 3, 4, 5, 6]
    path = str(tmp_path / "ordered")
    P.store_ordered(df, order, path)
    assert [tuple(r)[:3] for r in P.read_page(spark, path, 3, 30).collect()] == want[60:90]
    assert "GreaterThan(place,60)" in P.read_page(spark, path, 3, 30)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        P.with_place(df, {})


def test_a_page_is_reached_by_number_and_by_the_row_before_it(spark):
    import random
    pick = random.Random(4)
    df = spark.createDataFrame([(f"s{i:03d}", pick.choice([None, 1.0, 2.0, 3.0])) for i in range(60)], "symbol string, v double")
    for up in (True, False):
        last, seen = None, []
        for page in range(1, 8):
            by_number = [tuple(r) for r in R.table_query(df, sort="v", ascending=up, page=page, per_page=9).collect()]
            if last is not None:
                rows = R.table_query(df, sort="v", ascending=up, per_page=9, after={"v": last[1], "symbol": last[0]}).collect()
                assert [tuple(r) for r in rows] == by_number
            seen += by_number
            last = by_number[-1]
        assert seen == sorted(map(tuple, df.collect()), key=lambda r: (r[1] is None, (r[1] or 0) * (1 if up else -1), r[0]))
    with pytest.raises(ValueError):
        R.table_query(df, sort="nope", tie=())
