"""Bars arriving as files: resumable ingest and latest quotes kept in streaming state.

Two queries may follow one landing folder. `ingest` writes each micro-batch as a load of
a leveled log (streaming.log); the current bars are the log folded by key, last load
winning. `ingest_quotes` keeps a year of bars of each symbol in the state store and
writes the quotes that a batch changes; it reads no load again. Both resume from their
checkpoints, and a batch that is run again changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.rollups import latest_quote
from ..sources.bars import fold_by_key
from . import log as L

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR_KEY = ["symbol", "date"]


def _ddl(schema):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


BAR_SCHEMA = _ddl(schemas.BARS)


def bars_from_log(spark: SparkSession, log: str) -> DataFrame:
    """The current bars. A filter on the symbol reaches the files of every segment."""
    return L.read_log(spark, log, BAR_SCHEMA, BAR_KEY)


def quotes_from_log(spark: SparkSession, log: str, fields=None) -> DataFrame:
    """The newest quote row of each symbol."""
    return L.read_log(spark, log, _ddl(fields) if fields is not None else QUOTE, ["symbol"])


def _landed(spark, landing, max_files):
    reader = spark.readStream.schema(schemas.BARS).option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(landing).select(
        "*", F.col("_metadata.file_modification_time").alias("stamped"), F.col("_metadata.file_path").alias("file"))


def ingest(spark: SparkSession, landing: str, bars_log: str, checkpoint: str, max_files: int | None = None):
    """Starts a query that takes every file not yet taken, then stops.

    Files in one batch that hold the same key are ordered by their time stamp.
    """
    def take(batch: DataFrame, epoch: int):
        L.append_load(fold_by_key(batch, ["stamped", "file"]), bars_log, epoch, BAR_KEY)

    return (_landed(spark, landing, max_files).writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


_YEAR = "day array<int>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<bigint>"
QUOTE = ("symbol string, date date, open double, high double, low double, close double, volume bigint, "
         "prev_close double, daily_return double, w52_high double, w52_low double")


def _quote_state():
    """The processor, made here so that it travels with the plan and workers need not have this package."""
    import datetime

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = ("open", "high", "low", "close", "volume")
    zero = datetime.date(1970, 1, 1)

    def year_before(day):
        d = zero + datetime.timedelta(days=day)
        last = 28 if d.month == 2 and d.day == 29 else d.day
        return (datetime.date(d.year - 1, d.month, last) - zero).days

    class YearOfBars(StatefulProcessor):
        """State: the bars of the year up to the newest one, and the one before it, by day."""

        def init(self, handle):
            self.year = handle.getValueState("year", _YEAR)

        def handleInputRows(self, key, rows, timerValues):
            held = {}
            if self.year.exists():
                day, *columns = self.year.get()
                held = {d: (None, values) for d, *values in zip(day, *columns)}
            for part in rows:
                part = part.astype(object).where(part.notna(), None)
                for r in part.itertuples(index=False):
                    order = (r.stamped, r.file)
                    day = (r.date - zero).days
                    known = held.get(day)
                    if known is None or known[0] is None or order >= known[0]:
                        held[day] = (order, [getattr(r, c) for c in names])
            days = sorted(held)
            least = min([year_before(days[-1])] + days[-2:-1])
            days = [d for d in days if d >= least]
            columns = [[held[d][1][i] for d in days] for i in range(len(names))]
            self.year.update((days, *columns))
            yield pd.DataFrame([self.quote(key[0], days, columns)], columns=[c.split()[0] for c in QUOTE.split(", ")])

        def quote(self, symbol, days, columns):
            recent = [i for i, d in enumerate(days) if d >= year_before(days[-1])]
            close = columns[3]
            before = close[-2] if len(close) > 1 else None
            change = (close[-1] - before) / before if before and close[-1] is not None else None

            def best(values, pick):
                present = [values[i] for i in recent if values[i] is not None]
                return pick(present) if present else None
            return (symbol, zero + datetime.timedelta(days=days[-1]), *[c[-1] for c in columns], before, change,
                    best(columns[1], max), best(columns[2], min))

        def close(self):
            pass

    return YearOfBars()


def ingest_quotes(spark: SparkSession, landing: str, quotes_log: str, checkpoint: str, max_files: int | None = None):
    """Starts a query that brings the quotes of the symbols in each batch up to date.

    A symbol's state is a year of days, whatever its record. Bars older than that change
    no quote; a correction of a bar inside it does. The session needs the state store that
    keeps keyed columns, and gets it unless one is set.
    """
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    quotes = (_landed(spark, landing, max_files).groupBy("symbol")
              .transformWithStateInPandas(_quote_state(), QUOTE, "Update", "None"))

    def put(batch: DataFrame, epoch: int):
        L.append_load(batch, quotes_log, epoch, ["symbol"])

    return (quotes.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def compact(spark: SparkSession, bars_log: str) -> DataFrame:
    """Make the log one segment; readers of the version before are not disturbed."""
    L.merge_all(spark, bars_log, BAR_SCHEMA, BAR_KEY)
    return bars_from_log(spark, bars_log)
