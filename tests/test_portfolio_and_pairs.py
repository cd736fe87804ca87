import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.operators import correlation as C
from tickwright.operators import market as M
from tickwright.operators import portfolio as P
from tickwright.operators import series as S
from tickwright.plans.fixtures import INDEX

START, END = "1995-01-01", "2001-12-31"


def baskets(spark, rows):
    return spark.createDataFrame(rows, "portfolio_id string, symbol string, weight double")


def test_contributions_sum_to_the_total(small, spark):
    names = [r[0] for r in small.stocks.select("symbol").distinct().orderBy("symbol").limit(4).collect()]
    book = baskets(spark, [("four", s, 0.25) for s in names] + [("two", names[0], 0.9), ("two", names[1], 0.1)])
    parts = {r[0]: r[1] for r in P.portfolio_contribution(small.bars, book, small.symbols, START, END)
             .groupBy("portfolio_id").agg(F.sum("contribution")).collect()}
    totals = {r["portfolio_id"]: r["total_return"] for r in P.portfolio_stats(small.bars, book, START, END).collect()}
    assert set(parts) == {"four", "two"}
    for k in parts:
        assert parts[k] == pytest.approx(totals[k], abs=1e-9)


def test_money_goes_in_when_the_last_holding_lists(make_bars, spark):
    bars = make_bars({"A": {"2020-01-01": 10.0, "2020-01-02": 11.0, "2020-01-03": 12.1, "2020-01-04": 12.1},
                      "B": {"2020-01-02": 5.0, "2020-01-03": 5.5, "2020-01-04": 5.5}})
    book = baskets(spark, [("p", "A", 0.5), ("p", "B", 0.5)])
    stats = P.portfolio_stats(bars, book, START, "2021-01-01").first()
    assert str(stats["first_date"]) == "2020-01-02" and stats["sessions"] == 2
    assert stats["total_return"] == pytest.approx(0.1)


def test_a_basket_with_an_unknown_holding_has_no_sessions(make_bars, spark):
    bars = make_bars({"A": [1.0, 2.0, 3.0]})
    stats = P.portfolio_stats(bars, baskets(spark, [("p", "A", 0.5), ("p", "Z", 0.5)]), "2020-01-01", "2020-02-01")
    row = stats.first()
    assert row["sessions"] == 0 and row["total_return"] is None


def test_weights_are_normalised_and_empty_baskets_dropped(spark):
    rows = P.normalize_weights(baskets(spark, [("p", "A", 3.0), ("p", "B", 1.0), ("z", "A", 0.0)])).collect()
    assert {(r[0], r[1]): r[2] for r in rows} == {("p", "A"): 0.75, ("p", "B"): 0.25}


def test_index_lead_is_the_difference(small, spark):
    name = small.stocks.first()["symbol"]
    row = P.portfolio_vs_index(small.bars, baskets(spark, [("p", name, 1.0)]), START, END, INDEX).first()
    assert row["lead"] == pytest.approx(row["basket_return"] - row["index_return"])
    same = P.portfolio_vs_index(small.bars, baskets(spark, [("i", INDEX, 1.0)]), START, END, INDEX).first()
    assert same["lead"] == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("block, span", [(256, 1024), (3, 50)])
def test_correlation_equals_numpy_in_any_blocking(small, monkeypatch, block, span):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "SPAN_DAYS", span)
    returns = S.daily_returns(small.bars)
    got = {(r["sym_a"], r["sym_b"]): r["correlation"] for r in C.correlation_pairs(returns, START, END).collect()}
    wide = returns.toPandas().pivot(index="date", columns="symbol", values="daily_return")
    want = wide.corr(min_periods=3)
    assert len(got) == len(want) ** 2
    for (a, b), c in got.items():
        assert c == pytest.approx(want.loc[a, b], abs=1e-9) and -1 <= c <= 1 and c == got[b, a]


def test_correlation_needs_three_sessions_and_movement(make_bars):
    bars = make_bars({"A": [1.0, 2.0, 3.0], "B": [2.0, 3.0, 1.0]})
    assert all(r["correlation"] is None and r["n"] == 2
               for r in C.correlation_pairs(S.daily_returns(bars), "2020-01-01", "2020-12-31").collect())
    flat = make_bars({"A": [1.0, 2.0, 4.0, 3.0, 5.0], "B": [3.0] * 5})
    rows = {(r["sym_a"], r["sym_b"]): r["correlation"]
            for r in C.correlation_pairs(S.daily_returns(flat), "2020-01-01", "2020-12-31").collect()}
    assert rows["A", "B"] is None and rows["B", "B"] is None and rows["A", "A"] == pytest.approx(1.0)


def test_a_horizon_longer_than_the_record_has_no_periods(make_bars):
    assert M.rolling_returns(make_bars({"A": [1.0] * 10}), (252,)).count() == 0


def test_rolling_skips_closes_that_are_not_prices(make_bars):
    rows = M.rolling_returns(make_bars({"A": [10.0, 0.0, None, 20.0, 40.0]}), (1,)).orderBy("date").collect()
    assert [r["window_return"] for r in rows] == [1.0, 1.0]


def test_breadth_and_sectors(make_bars, spark):
    bars = make_bars({"A": [10.0, 11.0], "B": [10.0, 9.0], "C": [10.0, 10.0], "I": [1.0, 9.0]})
    symbols = spark.createDataFrame(
        [("A", "A", "x", "", 0), ("B", "B", "x", "", 0), ("C", "C", "y", "", 0), ("I", "I", "Index", "", 1)],
        "symbol string, name string, sector string, industry string, is_index int")
    row = M.market_breadth(bars, symbols, "2020-01-01", "2020-12-31").first()
    assert (row["advancing"], row["declining"], row["n"], row["best_symbol"], row["worst_symbol"]) == (1, 1, 3, "A", "B")
    sectors = {r["sector"]: r for r in M.sector_performance(bars, symbols, "2020-01-01", "2020-12-31").collect()}
    assert sectors["x"]["median_return"] == pytest.approx(0.0) and sectors["x"]["n_symbols"] == 2
    assert np.isclose(sectors["y"]["median_return"], 0.0)


@pytest.mark.parametrize("block, span, k", [(256, 1024, 3), (3, 64, 1), (3, 64, 4), (2, 8, 30)])
def test_nearest_partners_and_summary_equal_the_matrix(small, monkeypatch, block, span, k):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "SPAN_DAYS", span)
    returns = S.daily_returns(small.bars)
    pairs = [r for r in C.exact_pairs(C.correlation_pairs(returns, START, END)).collect() if r["correlation"] is not None]
    want = {}
    for r in pairs:
        for a, b in ((r["sym_a"], r["sym_b"]), (r["sym_b"], r["sym_a"])):
            want.setdefault(a, []).append((-r["correlation"], b))
    got = {}
    for r in C.nearest_partners(returns, START, END, k).orderBy("symbol", "rank").collect():
        got.setdefault(r["symbol"], []).append((-r["correlation"], r["partner"]))
    assert got.keys() == want.keys()
    for a, found in got.items():
        best = sorted(want[a])[:k]
        assert [b for _, b in found] == [b for _, b in best]
        assert [c for c, _ in found] == pytest.approx([c for c, _ in best], abs=1e-9)
    row = C.correlation_summary(returns, START, END).first()
    assert row["n_pairs"] == len(pairs) and row["fewest_shared"] == min(r["n"] for r in pairs)
    assert row["mean_correlation"] == pytest.approx(sum(r["correlation"] for r in pairs) / len(pairs), abs=1e-9)
    assert row["most"] == pytest.approx(max(r["correlation"] for r in pairs)) and row["least"] == pytest.approx(min(r["correlation"] for r in pairs))


def test_partners_on_one_calendar_are_found_though_most_are_given_up(make_bars):
    import random
    pick = random.Random(2)
    base = [[pick.gauss(0, 0.01) for _ in range(300)] for _ in range(3)]
    closes, noise = {}, 0.002
    for i in range(12):
        c, out = 100.0, []
        for j in range(300):
            c *= 1 + base[i % 3][j] + pick.gauss(0, noise)
            out.append(c)
        closes[f"S{i:02d}"] = out
    returns = S.daily_returns(make_bars(closes))
    wide = returns.toPandas().pivot(index="date", columns="symbol", values="daily_return").corr()
    old = C.BLOCK
    C.BLOCK = 4
    try:
        rows = C.nearest_partners(returns, "2020-01-01", "2030-01-01", 3).collect()
    finally:
        C.BLOCK = old
    for a in closes:
        best = wide[a].drop(a).sort_values(ascending=False).index[:3].tolist()
        assert [r["partner"] for r in sorted((r for r in rows if r["symbol"] == a), key=lambda r: r["rank"])] == best
