"""As-of look-ups: the session before, on or after a date.

Events and sessions are laid on one time line per symbol and a running "last
seen" value is carried along it: one shuffle, no inequality join. Only the
distinct (symbol, date) pairs of the events join the line, so a symbol with any
number of events adds at most one row per calendar day; the events themselves
pick their answer up by an equi-join on (symbol, date).
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SESSION, _EVENT = 0, 1


def _line(events, sessions, values, event_date):
    hit = F.struct("date", *values)
    points = events.select("symbol", F.col(event_date).alias("date")).distinct()
    kind = dict(sessions.select("symbol", "date", hit.alias("hit")).dtypes)["hit"]
    return (sessions.select("symbol", "date", hit.alias("hit"), F.lit(_SESSION).alias("side"))
            .unionByName(points.select("symbol", "date", F.lit(None).cast(kind).alias("hit"),
                                       F.lit(_EVENT).alias("side"))))


def _seen(backward: bool, inclusive: bool):
    """The nearest session value in one direction, for rows of the time line."""
    date = F.asc("date") if backward else F.desc("date")
    side = F.asc("side") if inclusive else F.desc("side")
    w = (Window.partitionBy("symbol").orderBy(date, side)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return F.last("hit", ignorenulls=True).over(w)


def _attach(events, found, names, event_date):
    found = found.select(F.col("symbol").alias("_s"), F.col("date").alias("_d"), *names)
    cond = reduce(lambda a, b: a & b, [events["symbol"] == F.col("_s"),
                                       events[event_date] == F.col("_d")])
    return events.join(found, cond, "left").drop("_s", "_d")


def asof_join(events: DataFrame, sessions: DataFrame, values, direction: str = "backward",
              strict: bool = False, event_date: str = "date", out: str = "hit") -> DataFrame:
    """Events plus a struct (date, *values) of the nearest session.

    backward: last session on or before the date (before it, when strict);
    forward: first session on or after it (after it, when strict).
    """
    line = _line(events, sessions, values, event_date)
    found = (line.withColumn(out, _seen(direction == "backward", not strict))
             .filter(F.col("side") == _EVENT))
    return _attach(events, found, [out], event_date)


def bracket(events: DataFrame, sessions: DataFrame, values,
            event_date: str = "date") -> DataFrame:
    """Events plus `prev`, the last session before, and `next`, the first on or after."""
    line = _line(events, sessions, values, event_date)
    found = (line.withColumn("prev", _seen(True, False)).withColumn("next", _seen(False, True))
             .filter(F.col("side") == _EVENT))
    return _attach(events, found, ["prev", "next"], event_date)


def lookup_exact_date(events: DataFrame, bars: DataFrame, event_date: str = "date") -> DataFrame:
    """The close on exactly the event's date, NULL when it is not a session."""
    closes = bars.select(F.col("symbol").alias("_s"), F.col("date").alias("_d"),
                         F.col("close").alias("close_on"))
    return events.join(closes, (events["symbol"] == F.col("_s"))
                       & (events[event_date] == F.col("_d")), "left").drop("_s", "_d")
