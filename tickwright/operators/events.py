"""Price moves around dated events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import guards as G
from . import series as S
from .asof import bracket


def company_event_impact(bars: DataFrame, events: DataFrame, categories: DataFrame,
                         cutoffs: DataFrame, sessions: int = 5) -> DataFrame:
    """Each curated event with its session, the close before it and the move after.

    The move runs from the last close before the event to the close `sessions`
    sessions after its own. Events dated before the record keep their row with
    NULL prices.
    """
    ahead = F.lead("close", sessions).over(S.sessions())
    priced = bars.select("symbol", "date", "close", ahead.alias("later"))
    tagged = events.join(categories.withColumnRenamed("name", "category"), "category")
    placed = bracket(tagged, priced, ["close", "later"])
    return (placed.join(cutoffs, "symbol").filter("date <= asof")
            .select("symbol", "asof", "date", "title", "description", "category", "source",
                    "tone", "label", F.col("next.date").alias("session_date"),
                    F.col("next.close").alias("close_on"), F.col("prev.close").alias("close_before"),
                    (G.ratio(F.col("next.later"), F.col("prev.close")) - 1).alias("forward_return")))


def market_event_impact(bars: DataFrame, market_events: DataFrame, cutoffs: DataFrame,
                        sessions: int = 5, min_move: float = 0.05) -> DataFrame:
    """Market-wide events kept for the symbols that moved on them.

    A session owns the calendar days since the one before it. Spelled out, those
    days meet the events by equality, so events times symbols is never formed and
    each (symbol, event) finds its session, the close before and the close after
    on one row.
    """
    w = S.sessions()
    owned = (bars.select("symbol", "date", F.lag("date").over(w).alias("prev_date"),
                         F.lag("close").over(w).alias("close_before"),
                         F.lead("close", sessions).over(w).alias("close_after"))
             .filter(F.col("close_before").isNotNull() & F.col("close_after").isNotNull())
             .withColumn("move", G.ratio(F.col("close_after"), F.col("close_before")) - 1)
             .filter(F.abs("move") >= min_move)
             .select("symbol", "close_before", "close_after", "move",
                     F.explode(F.sequence(F.date_add("prev_date", 1), "date")).alias("day")))
    return (owned.join(market_events, owned["day"] == market_events["date"])
            .join(cutoffs, "symbol").filter("date <= asof")
            .select("symbol", "asof", "date", "title", "category", "description",
                    "close_before", "close_after", F.col("move").alias("company_move")))
