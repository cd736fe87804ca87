"""Curated company events, their categories, and market-wide events."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import persist_table

_DOCUMENT = ("categories array<struct<name: string, tone: string, label: string>>, "
             "events array<struct<" + ", ".join(f"{c}: string" for c in schemas.EVENT_FIELDS) + ">>")

# Market-wide turning points (date, title, category, description).
MARKET_EVENTS = (
    ("2002-10-09", "Dot-com bottom", "recovery", "Low of the bear market that began in 2000."),
    ("2007-10-09", "Pre-crisis peak", "milestone", "Last high before the financial crisis."),
    ("2008-09-15", "Lehman collapse", "crisis", "An investment bank files for bankruptcy."),
    ("2009-03-09", "Financial crisis bottom", "recovery", "Low of the crisis bear market."),
    ("2010-05-06", "Flash Crash", "milestone", "A fall and rebound within one session."),
    ("2011-08-05", "US credit downgrade", "crisis", "The first cut of the US rating."),
    ("2015-08-24", "China devaluation shock", "crisis", "A currency move sets off a selloff."),
    ("2018-12-24", "Rate-hike selloff", "crisis", "A December fall amid rising rates."),
    ("2020-02-19", "Pre-COVID peak", "milestone", "Last high before the pandemic."),
    ("2020-03-23", "COVID crash bottom", "recovery", "Low of the pandemic fall."),
    ("2022-01-03", "Inflation-era peak", "milestone", "High before the tightening of 2022."),
    ("2022-10-12", "Inflation bear bottom", "recovery", "Low of the 2022 bear market."),
)


def market_events(spark: SparkSession) -> DataFrame:
    rows = [(date.fromisoformat(d), *rest) for d, *rest in MARKET_EVENTS]
    return spark.createDataFrame(rows, schemas.MARKET_EVENTS)


def parse_company_events(documents: DataFrame, payload: str = "payload"):
    """(events, categories) of {categories: [...], events: [...]} documents."""
    doc = documents.select(F.from_json(payload, _DOCUMENT).alias("d"))
    return doc.select(F.inline("d.events")), doc.select(F.inline("d.categories"))


def read_company_events(spark: SparkSession, path: str):
    """The curated file: one JSON document, a few hundred events."""
    documents = spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")
    events, categories = parse_company_events(documents)
    if categories.isEmpty():
        raise ValueError(f"{path}: no categories")
    return events, categories


def event_violations(events: DataFrame, symbols: DataFrame, categories: DataFrame) -> DataFrame:
    """Every broken rule of every event, one row each, with the reason.

    Events are read once: unknown names are the misses of two left joins, and the
    reasons of an event are one array.
    """
    def blank(c):
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    iso = F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date("date", "yyyy-MM-dd").isNotNull()
    known = symbols.select(F.col("symbol").alias("_symbol")).distinct()
    filed = categories.select(F.col("name").alias("_category")).distinct()
    rules = [F.when(blank(c), f"blank {c}") for c in schemas.EVENT_FIELDS]
    rules += [F.when(~blank("symbol") & F.col("_symbol").isNull(), "unknown symbol"),
              F.when(~blank("category") & F.col("_category").isNull(), "unknown category"),
              F.when(~blank("date") & ~iso, "date is not ISO")]
    return (events.join(known, F.col("symbol") == F.col("_symbol"), "left")
            .join(filed, F.col("category") == F.col("_category"), "left")
            .select(*schemas.EVENT_FIELDS, F.explode(F.array_compact(F.array(*rules))).alias("reason")))


def validate_events(events: DataFrame, symbols: DataFrame, categories: DataFrame) -> DataFrame:
    """Typed, trimmed events; a single bad one fails the load rather than vanish.

    All violations are written to the work folder; the error names the table, their
    number and one of them.
    """
    bad = persist_table(event_violations(events, symbols, categories), "event-violations")
    n = bad.count()
    if n:
        r = bad.first()
        raise ValueError(f"{n} violations by company events, in {bad.inputFiles()[0].rpartition('/')[0]}; one is "
                         f"{r['reason']} in {r['symbol']!r} {r['date']!r} {r['title']!r}")
    return events.select(*[F.to_date("date").alias("date") if c == "date" else F.trim(c).alias(c)
                           for c in schemas.EVENT_FIELDS])
