"""Reported company facts reduced to one fundamentals row per company.

A period is reported many times over: first filing, later filings that repeat it,
restatements. The first step keeps one value per period by a map-side combined
aggregate, whatever the number of filings; everything after works on at most one
row per period end of a concept.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FLOW_CONCEPTS, INSTANT_CONCEPTS

# The tags a concept may be reported under, most reliable first.
CONCEPT_TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax",
                "RevenueFromContractWithCustomerIncludingAssessedTax",
                "Revenues", "SalesRevenueNet", "SalesRevenueGoodsNet"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss",),
    "interest_expense": ("InterestExpense", "InterestExpenseDebt", "InterestIncomeExpenseNet"),
    "ocf": ("NetCashProvidedByUsedInOperatingActivities",
            "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"),
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity",
               "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "assets_current": ("AssetsCurrent",),
    "liabilities_current": ("LiabilitiesCurrent",),
    "long_term_debt": ("LongTermDebtNoncurrent", "LongTermDebt"),
    "short_term_debt": ("DebtCurrent", "ShortTermBorrowings"),
}
# Share counts, cover-page taxonomy first.
SHARE_TAGS = (("dei", "EntityCommonStockSharesOutstanding"),
              ("us-gaap", "CommonStockSharesOutstanding"),
              ("us-gaap", "WeightedAverageNumberOfDilutedSharesOutstanding"))
SHARES = "shares_outstanding"

# Period lengths in days that count as a year or a quarter, and
# the quarters an earnings-stability figure uses.
YEAR_SPAN, QUARTER_SPAN, QUARTER_MONTHS = (330, 400), (80, 100), (2, 4)
STABILITY_LATEST, STABILITY_LEAST = 20, 8


def tag_rows(concept_tags=None, share_tags=SHARE_TAGS):
    """(concept, taxonomy, tag, prio) rows; a few dozen, known at plan time."""
    rows = [(c, "us-gaap", t, i) for c, tags in (concept_tags or CONCEPT_TAGS).items()
            for i, t in enumerate(tags)]
    return rows + [(SHARES, taxonomy, t, i) for i, (taxonomy, t) in enumerate(share_tags)]


def _span(start, end):
    """Days between two dates on a 365-day year of 30-day months."""
    return ((F.year(end) - F.year(start)) * 365 + (F.month(end) - F.month(start)) * 30
            + F.day(end) - F.day(start))


def _tagged(facts_long, concept_tags):
    tags = facts_long.sparkSession.createDataFrame(
        tag_rows(concept_tags), "concept string, taxonomy string, tag string, prio int")
    return facts_long.join(F.broadcast(tags), ["taxonomy", "tag"])


def _first_source(df):
    """Keep one (tag, unit) per company and concept: the first tag with any rows."""
    choice = F.struct("prio", (F.col("unit") != "USD").alias("other"), "unit")
    best = F.min(choice).over(Window.partitionBy("cik", "concept"))
    return df.withColumn("_best", best).filter(choice == F.col("_best")).drop("_best")


def tag_priority(facts_long: DataFrame, concept_tags=None) -> DataFrame:
    """The tag and unit each company's concept is read from."""
    return _first_source(_tagged(facts_long, concept_tags)
                         .groupBy("cik", "concept", "taxonomy", "tag", "unit", "prio")
                         .agg(F.count("*").alias("n_rows")))


def period_values(facts_long: DataFrame, concept_tags=None) -> DataFrame:
    """One row per (company, concept, period end): the last filed value of each kind."""
    rows = _tagged(facts_long, concept_tags)
    start, end, val = F.col("start"), F.col("end_"), F.col("val")
    dated = start.isNotNull() & val.isNotNull()
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    span = _span(start, end)
    kinds = {
        "annual": dated & span.between(*YEAR_SPAN),
        "quarter": dated & span.between(*QUARTER_SPAN),
        "near_quarter": dated & months.between(*QUARTER_MONTHS),
        "instant": start.isNull() & val.isNotNull(),
        "any_value": val.isNotNull(),
    }
    filed = F.struct("filed", "val")
    reduced = (rows.groupBy("cik", "concept", "prio", "unit", "end_").agg(
        *[F.max_by("val", F.when(cond, filed)).alias(k) for k, cond in kinds.items()]))
    return _first_source(reduced).filter(F.col("end_").isNotNull())


def concept_values(periods: DataFrame) -> DataFrame:
    """Current and prior value of every concept, and its earnings stability."""
    w = (Window.partitionBy("cik", "concept").orderBy(F.desc("end_"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = periods.select("*", *[F.count(k).over(w).alias(f"{k}_n")
                                     for k in ("annual", "quarter", "near_quarter")])

    def nth(kind, lo, hi):
        return F.sum(F.when(F.col(f"{kind}_n").between(lo, hi), F.col(kind)))

    recent = F.when(F.col("near_quarter_n") <= STABILITY_LATEST, F.col("near_quarter"))
    agg = numbered.groupBy("cik", "concept").agg(
        F.count("annual").alias("years"), nth("annual", 1, 1).alias("y1"),
        nth("annual", 2, 2).alias("y2"), F.count("quarter").alias("quarters"),
        nth("quarter", 1, 4).alias("q1"), nth("quarter", 5, 8).alias("q2"),
        F.max_by("instant", F.when(F.col("instant").isNotNull(), F.col("end_"))).alias("instant"),
        F.max_by("any_value", F.when(F.col("any_value").isNotNull(), F.col("end_"))).alias("latest"),
        F.count(recent).alias("n_recent"), F.avg(recent).alias("mean"),
        F.stddev_pop(recent).alias("dev"), F.max("end_").alias("last_end"))
    has_year, has_quarters = F.col("years") >= 1, F.col("quarters") >= 4
    flow = F.when(has_year, F.col("y1")).when(has_quarters, F.col("q1"))
    prior = (F.when(F.col("years") >= 2, F.col("y2"))
             .when(~has_year & (F.col("quarters") >= 8), F.col("q2")))
    stability = F.when(F.col("n_recent") >= STABILITY_LEAST, F.when(
        F.abs("mean") < 1e-9, F.lit(0.0)).otherwise(
        1.0 / (1.0 + F.col("dev") / F.abs("mean"))))
    return agg.select("cik", "concept", flow.alias("flow"), prior.alias("flow_prior"),
                      F.coalesce("instant", "latest").alias("level"),
                      stability.alias("stability"), "last_end")


def ttm_flow(facts_long, concept_tags=None):
    """Trailing twelve months of each flow, and the twelve before."""
    return (concept_values(period_values(facts_long, concept_tags))
            .filter(F.col("concept").isin(list(FLOW_CONCEPTS)))
            .select("cik", "concept", F.col("flow").alias("current"),
                    F.col("flow_prior").alias("prior")))


def latest_instant(facts_long, concept_tags=None):
    """The newest balance figure of each level concept."""
    return (concept_values(period_values(facts_long, concept_tags))
            .filter(F.col("concept").isin(list(INSTANT_CONCEPTS)))
            .select("cik", "concept", F.col("level").alias("value")))


def earnings_stability(facts_long, concept_tags=None):
    return (concept_values(period_values(facts_long, concept_tags))
            .filter(F.col("concept") == "net_income")
            .select("cik", F.col("stability").alias("earnings_stability")))


def share_count(facts_long, concept_tags=None):
    return (concept_values(period_values(facts_long, concept_tags))
            .filter(F.col("concept") == SHARES)
            .select("cik", F.col("level").alias(SHARES)))


def facts_to_fundamentals(facts_long: DataFrame, concept_tags=None) -> DataFrame:
    """One wide row per company; companies without any dated concept are dropped."""
    values = concept_values(period_values(facts_long, concept_tags))

    def of(concept, column):
        return F.max(F.when(F.col("concept") == concept, F.col(column)))

    columns = []
    for c in FLOW_CONCEPTS:
        columns += [of(c, "flow").alias(c), of(c, "flow_prior").alias(f"{c}_prior")]
    columns += [of(c, "level").alias(c) for c in INSTANT_CONCEPTS]
    asof = F.max(F.when(F.col("concept") != SHARES, F.col("last_end")))
    return (values.groupBy("cik").agg(
        asof.alias("asof"), *columns, of(SHARES, "level").alias(SHARES),
        of("net_income", "stability").alias("earnings_stability"))
        .filter(F.col("asof").isNotNull()))


def company_fundamentals(universe: DataFrame, facts_long: DataFrame, concept_tags=None):
    """Fundamentals of every listed symbol; lines of one company share its figures."""
    return (universe.select("symbol", "cik")
            .join(facts_to_fundamentals(facts_long, concept_tags), "cik")
            .select("symbol", "cik", "asof", *[
                c for f in FLOW_CONCEPTS for c in (f, f"{f}_prior")],
                *INSTANT_CONCEPTS, SHARES, "earnings_stability"))
