"""Declared schemas. Nothing in this package relies on schema inference."""

from pyspark.sql import types as T

_S, _D, _L, _I, _F = (T.StringType(), T.DateType(), T.LongType(),
                      T.IntegerType(), T.DoubleType())


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, nullable)
                         for name, kind, nullable in fields])


BARS = _struct(
    ("symbol", _S, False), ("date", _D, False), ("open", _F, True), ("high", _F, True),
    ("low", _F, True), ("close", _F, True), ("adj_close", _F, True), ("volume", _L, True))

SYMBOLS = _struct(
    ("symbol", _S, False), ("name", _S, False), ("sector", _S, True),
    ("industry", _S, True), ("is_index", _I, True))

UNIVERSE = _struct(
    ("symbol", _S, False), ("cik", _L, True), ("name", _S, False),
    ("sector", _S, True), ("exchange", _S, True))

# Reported concepts, in column order. Flows carry a prior period.
FLOW_CONCEPTS = ("revenue", "net_income", "gross_profit", "operating_income",
                 "interest_expense", "ocf", "capex")
INSTANT_CONCEPTS = ("assets", "liabilities", "equity", "assets_current",
                    "liabilities_current", "long_term_debt", "short_term_debt")

FUNDAMENTAL_NUMBERS = tuple(
    c for flow in FLOW_CONCEPTS for c in (flow, flow + "_prior")
) + INSTANT_CONCEPTS + ("shares_outstanding", "earnings_stability")

FUNDAMENTALS = _struct(
    ("symbol", _S, False), ("cik", _L, True), ("asof", _D, True),
    *[(c, _F, True) for c in FUNDAMENTAL_NUMBERS])

ANALYST_NUMBERS = ("analyst_score", "target_upside", "eps_revision", "n_analysts")
ANALYST = _struct(
    ("symbol", _S, False), ("analyst_score", _F, True), ("target_upside", _F, True),
    ("eps_revision", _F, True), ("n_analysts", _F, True), ("fetched", _S, True))

EVENT_FIELDS = ("symbol", "date", "title", "description", "category", "source")
COMPANY_EVENTS_RAW = _struct(*[(c, _S, True) for c in EVENT_FIELDS])
EVENT_CATEGORIES = _struct(("name", _S, False), ("tone", _S, False), ("label", _S, False))
MARKET_EVENTS = _struct(("date", _D, False), ("title", _S, False),
                        ("category", _S, False), ("description", _S, False))
PORTFOLIOS = _struct(("portfolio_id", _S, False), ("symbol", _S, False), ("weight", _F, False))
CUTOFFS = _struct(("symbol", _S, False), ("asof", _D, False))

FACTS_LONG = _struct(
    ("cik", _L, False), ("taxonomy", _S, False), ("tag", _S, False), ("unit", _S, True),
    ("start", _D, True), ("end_", _D, True), ("val", _F, True), ("filed", _D, True),
    ("fp", _S, True))
