import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwright.functions.ranks import (grouped_median, grouped_percentile, prefix_contenders, top_of,
                                        sub_band, value_band)
from tickwright.operators import ranking as K
from tickwright.operators.series import sessions


def panel(spark, n=60, null_rate=0.0, seed=7, edit=None):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        row = {"symbol": f"S{i:03d}", "name": f"Company {i}", "sector": f"Sector {i % 4}", "is_index": 0,
               "last_close": 10.0 + i, "market_cap": 1e9 * (i + 1)}
        for m in K.METRICS:
            row[m.key] = None if rng.random() < null_rate else rng.uniform(-2, 40)
        rows.append(edit(i, row) if edit else row)
    fields = ["symbol string", "name string", "sector string", "is_index int", "last_close double",
              "market_cap double"] + [f"{m.key} double" for m in K.METRICS]
    names = [x.split()[0] for x in fields]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(fields))


def test_bands_never_decrease(spark):
    xs = [-1e300, -5.0, -1e-300, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 1.0, 1.0000001, 2.0, 1e300]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    bands = [r[0] for r in df.select(value_band(F.col("x")), "i").orderBy("i").collect()]
    assert bands == sorted(bands) and bands[4] == bands[5] == 0


def test_crowded_values_are_split(spark):
    """A million values within a third of a percent: no task orders more than a few thousand of them."""
    x = (100 + F.col("id") * 0.3e-6).alias("x")
    for sign in (1, -1):
        cells = spark.range(1_000_000).select((F.lit(sign) * x).alias("x")).groupBy(
            value_band(F.col("x")).alias("b"), sub_band(F.col("x")).alias("s")).agg(
            F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b", "s").collect()
        assert max(r.n for r in cells) < 3000
        assert all(a.hi < b.lo for a, b in zip(cells, cells[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_median_is_exact(spark, seed):
    rng = random.Random(seed)
    groups = {"a": 1, "b": 2, "c": 101, "d": 1000, None: 7}
    rows = [(g, rng.choice([0.0, -1.5, rng.gauss(0, 1), rng.gauss(0, 1e6), None]))
            for g, n in groups.items() for _ in range(n)]
    rows += [("ties", 3.0)] * 500 + [("ties", 4.0)] * 2
    got = {r["g"]: r["median"] for r in
           grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in set(g for g, _ in rows):
        values = [v for h, v in rows if h == g and v is not None]
        if values:
            assert got[g] == pytest.approx(statistics.median(values), rel=1e-12)
        else:
            assert g not in got


@pytest.mark.parametrize("seed", range(2))
def test_percentile_matches_a_plain_rank(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("abc"), rng.choice([None, float(rng.randint(-3, 3)), rng.uniform(-50, 50)]))
            for i in range(400)] + [(1000, "alone", 5.0), (1001, "alone", None)]
    got = grouped_percentile(spark.createDataFrame(rows, "i int, g string, v double"), ["g"], "v", "pr").toPandas()
    frame = pd.DataFrame(rows, columns=["i", "g", "v"])
    frame["v"] = frame["v"].astype(float)
    by = frame.groupby("g")["v"]
    count = by.transform("count")
    frame["want"] = (by.rank(method="min") - 1) / (count - 1).where(count > 1)
    both = got.merge(frame[["i", "want"]], on="i")
    assert len(both) == len(rows)
    assert (both["pr"].isna() == both["want"].isna()).all()
    assert both["pr"].fillna(0).to_numpy() == pytest.approx(both["want"].fillna(0).to_numpy(), abs=1e-12)


def test_prefix_contenders_hold_every_prefix_top(spark):
    rng = random.Random(1)
    xs = [float(rng.randint(0, 30)) for _ in range(200)]
    df = spark.createDataFrame([("A", i, x) for i, x in enumerate(xs)] + [("B", 0, 1.0)], "symbol string, date int, x double")
    for n in (1, 3, 50):
        found = prefix_contenders(df, ["symbol"], "x", n, [])
        rows = {r["symbol"]: [c["date"] for c in r["contenders"]] for r in found.collect()}
        kept, seen = [], []
        for i, x in enumerate(xs):                   # a row enters while fewer than n are as large
            if sum(y >= x for y in seen) < n:
                kept.append(i)
            seen.append(x)
        assert rows == {"A": kept, "B": [0]}
        ends = spark.range(1, 200).select(F.col("id").cast("int").alias("end"))
        got = found.filter("symbol = 'A'").crossJoin(ends).select("end", top_of("contenders", F.col("end"), n).alias("top"))
        for r in got.collect():
            want = sorted(range(r["end"] + 1), key=lambda i: (-xs[i], i))[:n]
            assert [c["date"] for c in r["top"]] == want


def test_weights():
    for horizon in K.HORIZON_WEIGHTS:
        for objective in K.OBJECTIVES:
            for analyst in (True, False):
                assert sum(K.category_weights(horizon, objective, analyst).values()) == pytest.approx(1)
        for category in K.CATEGORIES:
            members = [m for m in K.METRICS if m.category == category]
            assert sum(K.metric_weight(horizon, m) for m in members) == pytest.approx(1)
    assert (len(K.METRICS), len(K.active_metrics(False))) == (33, 30)
    with pytest.raises(ValueError):
        K.validate_weights({"Short-Term": {c: 0.1 for c in K.CATEGORIES}})
    with pytest.raises(ValueError):
        K.validate_weights(overrides={"Short-Term": {"nope": 1.0}})


def test_every_board_scores(spark):
    p = panel(spark, 12).cache()
    for horizon in K.HORIZON_WEIGHTS:
        for objective, analyst in (("Balanced", True), ("Value", False)):
            rows = K.score_board(p, horizon, objective, analyst).select("overall_score", "coverage").collect()
            assert all(0 <= r[0] <= 100 and r[1] == pytest.approx(1) for r in rows)


def test_lower_is_better_metrics_are_flipped(spark):
    p = panel(spark, 20, seed=9, edit=lambda i, r: {**r, "vol_1y": float(i), "rsi_14": float(i)})
    rows = {r["symbol"]: r for r in K.rank_layer(p).select("symbol", "pr_vol_1y", "pr_rsi_14").collect()}
    assert rows["S000"]["pr_vol_1y"] == 1.0 and rows["S000"]["pr_rsi_14"] == 0.0
    assert rows["S019"]["pr_vol_1y"] == 0.0 and rows["S019"]["pr_rsi_14"] == 1.0


def test_missing_metrics_are_left_out_not_scored_low(spark):
    p = panel(spark, 40, seed=3, edit=lambda i, r: {**r, "roe": None, "roa": None} if i == 0 else r)
    row = K.category_score(K.rank_layer(p), "Medium-Term").filter("symbol = 'S000'").first()
    want = (row["pr_gross_margin"] + row["pr_net_margin"] + row["pr_gross_profitability"]) / 3
    assert row["pr_roe"] is None and row["cat_profitability"] == pytest.approx(want)


def test_filter_comes_before_the_rank(spark):
    p = panel(spark, 60, seed=21)
    one = K.panel_filter(sectors=("Sector 1",))
    inside = {r["symbol"]: r["pr_rsi_14"] for r in K.score_board(p, "Medium-Term", where=one).collect()}
    whole = {r["symbol"]: r["pr_rsi_14"] for r in K.rank_layer(p).collect()}
    assert len(inside) == 15 and min(inside.values()) == 0.0 and max(inside.values()) == 1.0
    assert any(inside[s] != whole[s] for s in inside)


def test_valuation_ranks_inside_the_sector(spark):
    p = panel(spark, 40, seed=5)
    pdf = K.rank_layer(p).select("sector", "pe", "pr_pe").toPandas()
    for _, g in pdf.groupby("sector"):
        assert sorted(g["pr_pe"]) == pytest.approx([i / 9 for i in range(10)])


def test_coverage_gate(spark):
    keep = {m.key for m in K.METRICS if m.category == "Momentum"}
    p = panel(spark, 30, seed=31, edit=lambda i, r: {
        k: (None if i == 0 and k in K.BY_KEY and k not in keep else v) for k, v in r.items()})
    shown = {r["symbol"] for r in K.rankings(p, limit=-1).select("symbol").collect()}
    assert "S000" not in shown and len(shown) == 29


def test_risk_and_size_bands(spark):
    p = panel(spark, 10, edit=lambda i, r: {**r, "vol_1y": None if i == 9 else i / 10,
                                            "market_cap": [1e9, 5e9, 50e9, 500e9][i % 4]})
    def names(**kw):
        return {r[0] for r in p.filter(K.panel_filter(**kw)).select("symbol").collect()}
    assert names(risk="Conservative") == {"S000", "S001", "S002"}
    assert names(risk="Moderate") == {"S000", "S001", "S002", "S003", "S004"}
    assert len(names(risk="Aggressive")) == 10
    assert names(caps=("Mega (>$200B)", "Mid ($2B-$10B)")) == {"S001", "S003", "S005", "S007", "S009"}
    assert names(min_price=18.0) == {"S008", "S009"}


def test_strengths_and_risks(spark):
    p = panel(spark, 30, seed=5)
    board = K.rank_layer(p)
    rows = K.strengths_risks(board).toPandas()
    assert rows.groupby(["symbol", "side"]).size().max() <= 4
    assert (rows[rows.side == "strength"].percentile >= .75).all() and (rows[rows.side == "risk"].percentile <= .25).all()
    for _, g in rows[rows.side == "strength"].sort_values("rank").groupby("symbol"):
        assert list(g.percentile) == sorted(g.percentile, reverse=True)


def test_bands(spark):
    df = spark.createDataFrame([("a", 75.0), ("b", 55.0), ("c", 40.0), ("d", 39.9), ("e", None)],
                               "symbol string, overall_score double")
    assert [r["band"] for r in K.score_band(df).orderBy("symbol").collect()] \
        == ["strong", "solid", "mixed", "weak", None]
