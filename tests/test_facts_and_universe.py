from datetime import date

import pytest

from tickwright import schemas
from tickwright.operators import facts as X
from tickwright.operators import universe as V


def quarter_rows(n, first=2018, val=lambda i: 10.0 * (i + 1), cik=1, tag="Revenues"):
    rows = []
    for i in range(n):
        y, q = first + i // 4, i % 4
        start, end = date(y, 3 * q + 1, 1), [date(y, 3, 31), date(y, 6, 30), date(y, 9, 30), date(y, 12, 31)][q]
        rows.append((cik, "us-gaap", tag, "USD", start, end, val(i), end, None))
    return rows


def long(spark, rows):
    return spark.createDataFrame(rows, schemas.FACTS_LONG)


def test_quarters_sum_when_no_year_is_reported(spark):
    row = X.ttm_flow(long(spark, quarter_rows(8))).first()
    assert (row["current"], row["prior"]) == (50 + 60 + 70 + 80, 10 + 20 + 30 + 40)
    short = X.ttm_flow(long(spark, quarter_rows(5))).first()
    assert (short["current"], short["prior"]) == (20 + 30 + 40 + 50, None)
    assert X.ttm_flow(long(spark, quarter_rows(3))).first()["current"] is None


def test_a_year_beats_quarters_and_a_restatement_replaces_it(spark):
    years = [(1, "us-gaap", "Revenues", "USD", date(y, 1, 1), date(y, 12, 31), v, date(f, 2, 1), None)
             for y, v, f in ((2018, 90.0, 2019), (2019, 100.0, 2020), (2019, 110.0, 2021))]
    row = X.ttm_flow(long(spark, quarter_rows(8) + years)).first()
    assert (row["current"], row["prior"]) == (110.0, 90.0)


def test_a_repeated_quarter_is_not_counted_twice(spark):
    rows = quarter_rows(8) + [(1, "us-gaap", "Revenues", "USD", date(2019, 10, 1), date(2019, 12, 31), 81.0,
                               date(2020, 8, 1), None)]
    assert X.ttm_flow(long(spark, rows)).first()["current"] == 50 + 60 + 70 + 81


def test_the_first_tag_with_rows_wins(spark):
    rows = quarter_rows(8, tag="SalesRevenueNet") + quarter_rows(4, val=lambda i: 1.0)
    row = X.tag_priority(long(spark, rows)).filter("concept = 'revenue'").first()
    assert row["tag"] == "Revenues"
    assert X.ttm_flow(long(spark, rows)).first()["current"] == 4.0


def test_levels_prefer_rows_without_a_start(spark):
    def level(start, end, v, filed):
        return (1, "us-gaap", "Assets", "USD", start, end, v, filed, None)
    rows = [level(None, date(2019, 6, 30), 5.0, date(2019, 8, 1)),
            level(None, date(2019, 6, 30), 6.0, date(2020, 8, 1)),
            level(date(2019, 1, 1), date(2019, 12, 31), 99.0, date(2020, 2, 1))]
    assert X.latest_instant(long(spark, rows)).first()["value"] == 6.0
    assert X.latest_instant(long(spark, rows[2:])).first()["value"] == 99.0


def test_stability(spark):
    def stability(rows):
        return X.earnings_stability(long(spark, rows)).first()["earnings_stability"]
    net = dict(tag="NetIncomeLoss")
    assert stability(quarter_rows(7, **net)) is None
    assert stability(quarter_rows(8, val=lambda i: 5.0, **net)) == 1.0
    assert stability(quarter_rows(8, val=lambda i: (-1.0) ** i, **net)) == 0.0
    assert stability(quarter_rows(24, val=lambda i: 1e9 if i < 4 else 2.0, **net)) == 1.0


def test_wide_row_and_shares(spark):
    rows = quarter_rows(8) + [
        (1, "dei", "EntityCommonStockSharesOutstanding", "shares", None, date(2021, 1, 1), 7.0, date(2021, 1, 2), None),
        (1, "us-gaap", "CommonStockSharesOutstanding", "shares", None, date(2021, 1, 1), 8.0, date(2021, 1, 2), None),
        (2, "dei", "EntityCommonStockSharesOutstanding", "shares", None, date(2021, 1, 1), 7.0, date(2021, 1, 2), None)]
    row, = X.facts_to_fundamentals(long(spark, rows)).collect()
    assert (row["cik"], row["asof"], row["shares_outstanding"], row["assets"]) == (1, date(2019, 12, 31), 7.0, None)
    assert set(schemas.FUNDAMENTALS.names) - {"symbol"} == set(row.asDict())


@pytest.mark.parametrize("sic, sector", [
    ("3674", "Information Technology"), ("2834", "Health Care"), ("2810", "Materials"),
    ("6798", "Real Estate"), ("6020", "Financials"), ("9999", "Unclassified"), (None, "Unclassified"),
    ("abc", "Unclassified")])
def test_sectors_from_industry_codes(spark, sic, sector):
    df = spark.createDataFrame([(1, sic)], "id int, sic string")
    assert V.sector_from_sic(df).first()["sector"] == sector


def test_lines_that_are_not_common_stock(spark):
    names = ["ABC", "BRK-B", "MER-PK", "XY-WS", "UN-UN", "RT-R", "HEI-A", "Q-7"]
    kept = {r[0] for r in V.derivative_line_filter(
        spark.createDataFrame([(n,) for n in names], "symbol string")).collect()}
    assert kept == {"ABC", "BRK-B", "RT-R", "HEI-A", "Q-7"}


def test_liquidity_keeps_one_line_per_company(make_bars, spark):
    bars = make_bars({"BIG": [10.0] * 260, "BIG-A": [20.0] * 260, "NOCIK": [1.0] * 260, "NEW": [99.0] * 100})
    listed = spark.createDataFrame([("BIG", 1, "b", "s", "x"), ("BIG-A", 1, "b", "s", "x"),
                                    ("NOCIK", None, "n", "s", "x"), ("NEW", 3, "n", "s", "x")],
                                   "symbol string, cik long, name string, sector string, exchange string")
    forced = spark.createDataFrame([("NOCIK",), ("BIG",)], "symbol string")
    got = {r["symbol"] for r in V.liquidity_cut(bars, listed, forced, keep=1).collect()}
    assert got == {"BIG-A", "NOCIK"}
