from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tickwright.operators import events as E
from tickwright.operators import history as H
from tickwright.operators import series as S
from tickwright.operators.asof import asof_join, bracket

D0 = date(2020, 1, 1)


def day(i):
    return D0 + timedelta(days=i)


@pytest.fixture
def cursors(spark):
    def make(*offsets, symbol="A"):
        return spark.createDataFrame([(symbol, day(i)) for i in offsets], "symbol string, asof date")
    return make


def test_recovery_is_the_next_record_whatever_its_depth(make_bars, cursors):
    # deep, shallow, deep: the first deep fall recovers at the shallow one's peak
    bars = make_bars({"A": [100.0, 50.0, 100.0, 99.0, 101.0, 40.0]})
    rows = H.drawdown_episodes(bars, cursors(5), -0.2).orderBy("peak_date").collect()
    assert [(r["peak_date"], r["recovery_date"]) for r in rows] == [(day(0), day(2)), (day(4), None)]


def test_a_cursor_inside_a_fall_sees_it_open(make_bars, cursors):
    bars = make_bars({"A": [100.0, 80.0, 60.0, 70.0, 120.0]})
    early, late = H.drawdown_episodes(bars, cursors(1, 4), -0.1).orderBy("asof").collect()
    assert (early["trough_date"], early["recovery_date"], early["sessions"]) == (day(1), None, 2)
    assert (late["trough_date"], late["recovery_date"], late["sessions"]) == (day(2), day(4), 4)


def test_a_flat_day_ends_a_run(make_bars, cursors):
    bars = make_bars({"A": [10.0, 11.0, 12.0, 12.0, 13.0]})
    rows = H.streaks(bars, cursors(4), 1).collect()
    assert [(r["length"], r["start_date"]) for r in rows] == [(2, day(1)), (1, day(4))]


def test_a_run_is_cut_at_the_cursor(make_bars, cursors):
    bars = make_bars({"A": [10.0, 11.0, 12.0, 13.0, 14.0]})
    row, = H.streaks(bars, cursors(2), 1).collect()
    assert (row["length"], row["end_date"]) == (2, day(2))
    assert row["run_return"] == pytest.approx(0.2)


def test_nothing_after_the_cursor_is_seen(spark, make_bars, cursors):
    """Every answer equals the answer on the record cut at the cursor."""
    import random
    rng = random.Random(4)
    closes, c = [], 100.0
    for _ in range(120):
        c *= 1 + rng.choice([-0.03, -0.01, 0.0, 0.01, 0.03])
        closes.append(c)
    whole = make_bars({"A": closes})
    for at in (30, 77):
        cut = make_bars({"A": closes[:at + 1]})
        for op in (lambda b, k: H.drawdown_episodes(b, k, -0.02), H.record_summary, H.asof_snapshot,
                   lambda b, k: H.streaks(b, k),
                   lambda b, k: H.extreme_days(b, k, 4)):
            key = lambda r: str(r)
            assert sorted(op(whole, cursors(at)).collect(), key=key) \
                == sorted(op(cut, cursors(at)).collect(), key=key)


def test_episodes_cover_the_record(make_bars, cursors, small):
    rows = H.drawdown_episodes(small.bars, small.cutoffs.filter("asof = '2001-11-04'"), 0.0)
    total = rows.groupBy("symbol").agg(F.sum("sessions").alias("n"))
    assert total.join(small.bars.groupBy("symbol").count(), "symbol").filter("n <> count").count() == 0


def test_record_ties_keep_the_first_date(make_bars, cursors):
    row = H.record_summary(make_bars({"A": [5.0, 7.0, 6.0, 7.0]}), cursors(3)).first()
    assert (row["record_days"], row["record_date"], row["longest_dry_spell"]) == (3, day(1), 2)


def test_extremes_with_more_cursors_than_days(make_bars, cursors):
    bars = make_bars({"A": [1.0, 2.0, 1.0, 3.0, 1.0]})
    rows = H.extreme_days(bars, cursors(1, 2, 3, 4), 1).filter("direction = 'gain'")
    assert [r["date"] for r in rows.orderBy("asof").collect()] == [day(1), day(1), day(3), day(3)]


def test_thinned_path_keeps_ends_and_records(make_bars):
    bars = make_bars({"A": [10.0, 12.0, 9.0, 8.0, 13.0, 7.0, 6.0]})
    kept = [r["date"] for r in H.price_path(bars, 100).orderBy("date").collect()]
    assert kept == [day(0), day(1), day(4), day(6)]


def test_asof_sides_and_strictness(spark, make_bars):
    bars = make_bars({"A": {"2020-01-02": 1.0, "2020-01-04": 2.0}})
    events = spark.createDataFrame([("A", date(2020, 1, d)) for d in (1, 2, 3, 4, 5, 5)], "symbol string, date date")

    def picks(**kw):
        return [r["hit"]["close"] if r["hit"] else None
                for r in asof_join(events, bars, ["close"], **kw).orderBy("date").collect()]
    assert picks() == [None, 1.0, 1.0, 2.0, 2.0, 2.0]
    assert picks(strict=True) == [None, None, 1.0, 1.0, 2.0, 2.0]
    assert picks(direction="forward") == [1.0, 1.0, 2.0, 2.0, None, None]
    assert picks(direction="forward", strict=True) == [1.0, 2.0, 2.0, None, None, None]
    both = bracket(events, bars, ["close"]).filter("date = '2020-01-04'").first()
    assert (both["prev"]["close"], both["next"]["close"]) == (1.0, 2.0)


def test_event_before_the_record_keeps_its_row(spark, make_bars):
    bars = make_bars({"A": [10.0, 11.0, 12.0]})
    events = spark.createDataFrame([("A", date(1990, 1, 1), "t", "d", "IPO", "s")],
                                   "symbol string, date date, title string, description string, category string, source string")
    cats = spark.createDataFrame([("IPO", "milestone", "IPO")], "name string, tone string, label string")
    cuts = spark.createDataFrame([("A", day(2))], "symbol string, asof date")
    row = E.company_event_impact(bars, events, cats, cuts, 1).first()
    assert row["close_before"] is None and row["forward_return"] is None and row["session_date"] == day(0)


def test_market_moves_shrink_with_the_threshold(small):
    keys = []
    for least in (0.0, 0.002, 0.01):
        rows = E.market_event_impact(small.bars, small.market_events, small.cutoffs, 5, least)
        keys.append({(r["symbol"], r["asof"], r["date"]) for r in rows.collect()})
    assert keys[0] >= keys[1] >= keys[2] and len(keys[0]) > len(keys[2])


def test_crossovers_alternate(make_bars, cursors):
    import math
    closes = [100 + 20 * math.sin(i / 60) for i in range(900)]
    bars = make_bars({"A": closes})
    rows = H.ma_crossovers(S.moving_averages(bars), cursors(899)).orderBy("date").collect()
    kinds = [r["cross_type"] for r in rows]
    assert len(kinds) > 2 and all(a != b for a, b in zip(kinds, kinds[1:]))
