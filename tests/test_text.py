import pytest

from tickwright.operators import catalog as C
from tickwright.operators import questions as Q

INDEX = "^GSPC"
SECTORS = ["Information Technology", "Consumer Discretionary", "Consumer Staples", "Financials",
           "Health Care", "Real Estate", "Index"]
DIRECTORY = [("AAPL", "Apple Inc."), ("MSFT", "Microsoft Corporation"), ("BRK-B", "Berkshire Hathaway Inc."),
             ("T", "AT&T Inc."), (INDEX, "S&P 500 Index")]


@pytest.fixture(scope="module")
def ask(spark):
    directory = spark.createDataFrame(DIRECTORY, "symbol string, name string")

    def run(*texts):
        asked = spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")
        tagged = Q.score_intents(Q.tag_symbols(asked, directory), INDEX)
        rows = Q.resolve_params(tagged, "2015-01-01", "2020-06-30", "2001-01-02", "2020-12-31", SECTORS)
        return [r for r in rows.orderBy("question_id").collect()]
    return run


@pytest.mark.parametrize("text, intent", [
    ("best return in the past ten years", "biggest_winners"),
    ("who gained since 2012", "biggest_winners"),
    ("show the leaderboard", "biggest_winners"),
    ("which company lost money", "biggest_losers"),
    ("the bottom 7 performers", "biggest_losers"),
    ("how much did Apple return", "company_detail"),
    ("yearly return of the S&P 500 index", "market_summary"),
    ("highest trading volume", "top_volume"),
    ("which sector did best", "sector"),
    ("what is volatile these days", "most_volatile"),
    ("deepest drawdown ever", "biggest_drawdown"),
    ("Apple vs Microsoft", "compare"),
    ("calmest name", "safest"),
    ("microsoft", "company_detail"),
    ("good morning", ""),
])
def test_intents(ask, text, intent):
    assert ask(text)[0]["intent"] == intent


def test_companies_in_the_order_named(ask):
    rows = ask("microsoft before Apple", "is BRK-B fine", "at&t or berkshire", "pineapples and snapple",
               "t", "étapple")
    assert [r["symbols"] for r in rows] == [["MSFT", "AAPL"], ["BRK-B"], ["T", "BRK-B"], [], ["T"], []]


@pytest.mark.parametrize("text, limit", [("top 5 names", 5), ("five best", 5), ("best twenty of all", 20),
                                         ("top 400", 50), ("nothing stated", 10), ("top, 5", 10)])
def test_counts(ask, text, limit):
    assert ask(text)[0]["row_limit"] == limit


@pytest.mark.parametrize("text, start, end", [
    ("over the past 3 years", "2018-01-01", "2020-12-31"),
    ("last year", "2020-01-01", "2020-12-31"),
    ("previous two quarters", "2020-07-02", "2020-12-31"),
    ("since 2012", "2012-01-01", "2020-06-30"),
    ("since 1990", "2001-01-02", "2020-06-30"),
    ("past 90 years", "2001-01-02", "2020-12-31"),
    ("last 3 years since 2012", "2018-01-01", "2020-12-31"),
    ("no window", "2015-01-01", "2020-06-30"),
])
def test_windows(ask, text, start, end):
    row = ask(text)[0]
    assert (str(row["start_date"]), str(row["end_date"])) == (start, end)


def test_stated_fields_win_over_the_text(spark):
    rows = [(0, "top 5 tech over the past 3 years", "2016-05-01", None, 3, "financials", " Volume ", "ASC"),
            (1, "top 5 tech over the past 3 years", "soon", "2099-01-01", 0, "nothing", "", "up"),
            (2, "top 1000 of all", None, " ", None, None, None, None), (3, "top 400", None, None, None, None, None, None)]
    asked = spark.createDataFrame(rows, "question_id int, text string, asked_start string, asked_end string, "
                                  "asked_limit int, asked_sector string, asked_metric string, asked_ordering string")
    directory = spark.createDataFrame(DIRECTORY, "symbol string, name string")
    got = Q.resolve_params(Q.tag_symbols(asked, directory), "2015-01-01", "2020-06-30", "2001-01-02", "2020-12-31",
                           SECTORS).orderBy("question_id").collect()
    assert [(str(r.start_date), str(r.end_date), r.row_limit, r.limit_note, r.sector, r.metric, r.ordering)
            for r in got] == [
        ("2016-05-01", "2020-12-31", 3, "", "Financials", "volume", "asc"),
        ("2001-01-02", "2020-12-31", 5, "", "Information Technology", "", ""),
        ("2015-01-01", "2020-06-30", 10, "unreadable", "", "", ""),
        ("2015-01-01", "2020-06-30", 50, "cut", "", "", "")]
    assert got[0].window_source == got[0].metric_source == "question" and got[2].window_source == "window"


@pytest.mark.parametrize("text, sector", [
    ("top tech names", "Information Technology"), ("Consumer Staples please", "Consumer Staples"),
    ("banks", "Financials"), ("healthcare", "Health Care"), ("real estate", "Real Estate"),
    ("energy", ""), ("biotech", "")])
def test_sectors(ask, text, sector):
    assert ask(text)[0]["sector"] == sector


def test_catalog_tiers(spark):
    core = spark.createDataFrame([("AB", "Abacus", "s", "i", 0), ("IX", "Index", "s", "i", 1)],
                                 "symbol string, name string, sector string, industry string, is_index int")
    wide = spark.createDataFrame([("AB", "Other", "NYSE"), ("ABC", "Zed Corp", "NYSE"), ("XY", "The Abbey", ""),
                                  ("CAB", None, "Nasdaq")], "symbol string, name string, exchange string")
    terms = spark.createDataFrame([("ab",), (" AB ",), ("zed corp",), ("",), ("q%",)], "term string")
    rows = C.search_catalog(C.dedupe_catalog(core, wide), terms).orderBy("term", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r["term"], []).append((r["symbol"], r["tier"], r["exchange"]))
    want = [("AB", 0, "local"), ("ABC", 1, "NYSE"), ("CAB", 2, "Nasdaq"), ("XY", 2, "local")]
    assert by == {"ab": want, " AB ": want, "zed corp": [("ABC", 1, "NYSE")]}


def test_search_meets_every_substring(spark):
    catalog = spark.createDataFrame([("AB", "Abel abba", "X", 0), ("ABB", None, "", 1), ("ZZ", "A b", "N", 1), ("Q", "", "N", 0)],
                                    "symbol string, name string, exchange string, source int")
    rows = [(r["symbol"].upper(), (r["name"] or "").upper()) for r in catalog.collect()]
    texts = {x for pair in rows for x in pair}
    terms = sorted({t[i:j] for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)} | {"abx", "bbab", " ", "elab"})
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r["term"], r["symbol"]): r["tier"] for r in C.search_catalog(catalog, frame, 10).collect()}
    want = {}
    for term in terms:
        t = term.strip().upper()
        for symbol, name in rows:
            if t and (t in symbol or t in name):
                want[term, symbol] = 0 if symbol == t else 1 if symbol.startswith(t) or name.startswith(t) else 2
    assert got == want


def test_an_update_replaces_a_company_in_the_stored_index(spark, tmp_path):
    kind = "symbol string, name string, exchange string, source int"
    path = str(tmp_path / "index")
    C.write_index(spark.createDataFrame([("A", "Old name", "N", 0), ("B", "Other", "N", 0)], kind), path, 1)
    index = C.write_index(spark.createDataFrame([("A", "New title", "N", 0), ("C", "Third old", "N", 0)], kind), path, 2)
    terms = spark.createDataFrame([("old",), ("title",), ("oth",), ("name",)], "term string")
    assert {(r["term"], r["symbol"]) for r in C.search_index(index, terms).collect()} == {
        ("old", "C"), ("title", "A"), ("oth", "B")}


def test_words_meet_names_without_a_shuffle_of_words(spark):
    directory = spark.createDataFrame([("AA", "Alpha Inc"), ("BB", "Beta Corp")], "symbol string, name string")
    asked = spark.createDataFrame([(0, "beta, then alpha; Beta again and bb"), (1, "no name"), (2, None), (None, "aa"), (3, "")],
                                  "question_id int, text string")
    found = Q.symbol_mentions(asked, directory)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(question_id") == 1
    assert sorted((r.question_id, r.symbol, r.pos) for r in found.filter("question_id IS NOT NULL").collect()) == [
        (0, "AA", 2), (0, "BB", 0)]
    assert {r.question_id: r.symbols for r in Q.tag_symbols(asked, directory).collect()} == {
        0: ["BB", "AA"], 1: [], 2: [], None: [], 3: []}


def test_numbers_are_read_from_parts_taken_once(spark):
    asked = spark.createDataFrame([(0, "top twentyfive over the past 007 days"), (1, "Five\tBEST last year"), (2, "last 0 weeks"),
                                   (3, "in 1999"), (4, None), (5, "12 first, top 9")], "question_id int, text string")
    counts, back, years = Q.tag_count(asked), Q.tag_lookback(asked), Q.tag_year(asked)
    assert [r[1] for r in counts.orderBy("question_id").collect()] == [25, 5, 0, 0, 0, 12]
    assert [r[1] for r in back.orderBy("question_id").collect()] == [7, 365, 7, 0, None, 0]
    assert [r[1] for r in years.orderBy("question_id").collect()] == [0, 0, 0, 1999, 0, 0]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert plan.count("AS _times") == 1 and plan.count("regexp_extract(_back") == 2
