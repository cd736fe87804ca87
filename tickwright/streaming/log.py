"""A leveled log of loads keyed by (symbol, date).

A load is one segment: a folder of rows sorted by symbol, in files cut by ranges of the
symbol, as many as its size asks for; a reader of some symbols skips the other files by
their statistics. A manifest version names the segments that make up the log, and a
reader takes the newest version whole, so it never sees half a load or half a
compaction. Segments of one size class are merged once there are FANOUT of them, the
last load of a key winning, so that a symbol lies in at most FANOUT - 1 segments of each
of a logarithmic number of classes.

One writer at a time is assumed, as a streaming query is. A load that is written again
under its number changes nothing; folders that no version names are left over by runs
that died and are never read.
"""

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dimensions import path_exists

FANOUT = 4
CLASS_ROWS = 1 << 16       # rows of the smallest size class
_ENTRY = "version long, path string, rows long, first_load long, last_load long"


def live_segments(spark: SparkSession, log: str) -> list:
    """The manifest rows of the newest version, oldest load first."""
    path = f"{log}/manifest"
    if not path_exists(spark, path):
        return []
    rows = spark.read.schema(_ENTRY).parquet(path)
    newest = rows.groupBy("version").agg(F.collect_list(F.struct("path", "rows", "first_load", "last_load")).alias("x"))
    got = newest.orderBy(F.desc("version")).limit(1).select("version", F.inline("x")).collect()
    return sorted(got, key=lambda r: r["first_load"])


def _publish(spark, log, version, entries):
    rows = [(version, e["path"], e["rows"], e["first_load"], e["last_load"]) for e in entries]
    spark.createDataFrame(rows, _ENTRY).coalesce(1).write.mode("append").parquet(f"{log}/manifest")


def _write(rows: DataFrame, log: str, first: int, last: int) -> dict:
    path = f"{log}/segments/{first}-{last}-{uuid.uuid4().hex[:8]}"
    rows.repartitionByRange("symbol").sortWithinPartitions(*rows.columns[:2]).write.parquet(path)
    n = rows.sparkSession.read.schema(rows.schema).parquet(path).count()      # read from the files' footers
    return {"path": path, "rows": n, "first_load": first, "last_load": last}


def newest_of_key(rows: DataFrame, keys: list) -> DataFrame:
    """One row of each key, that of the last load, with its load_seq; a map-side combined aggregate."""
    others = [c for c in rows.columns if c not in keys]
    row = F.struct(*[c for c in others if c != "load_seq"])
    return (rows.groupBy(*keys).agg(F.max(F.struct("load_seq", row.alias("row"))).alias("x"))
            .select(*keys, "x.row.*", "x.load_seq"))


def _read(spark: SparkSession, entries: list, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[e["path"] for e in entries])


def read_log(spark: SparkSession, log: str, schema: str, keys: list) -> DataFrame:
    """The newest row of each key over the live segments; schema is that of a load's rows."""
    entries = live_segments(spark, log)
    whole = schema + ", load_seq bigint"
    rows = _read(spark, entries, whole) if entries else spark.createDataFrame([], whole)
    return newest_of_key(rows, keys).drop("load_seq")


def size_class(rows: int) -> int:
    return max(0, math.floor(math.log(max(rows, 1) / CLASS_ROWS, FANOUT)) + 1) if rows > CLASS_ROWS else 0


def append_load(rows: DataFrame, log: str, load: int, keys: list, fanout: int = FANOUT) -> None:
    """Add rows, one a key, as a load, and merge what has grown to FANOUT segments of a size."""
    spark = rows.sparkSession
    entries = live_segments(spark, log)
    if any(e["first_load"] <= load <= e["last_load"] for e in entries):
        return
    version = max([e["version"] for e in entries], default=0) + 1
    entries = [e.asDict() for e in entries] + [_write(rows.withColumn("load_seq", F.lit(load).cast("long")), log, load, load)]
    _publish(spark, log, version, entries)
    merge_sizes(spark, log, _ddl(rows), keys, fanout)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def merge_sizes(spark: SparkSession, log: str, schema: str, keys: list, fanout: int = FANOUT) -> None:
    """Merge neighbouring segments of one size class until no class holds `fanout` of them.

    Only neighbours in order of loads are merged, so a segment always stands for a range
    of loads; of smaller ones in between the class is taken to be that of the run.
    """
    while True:
        entries = live_segments(spark, log)
        run = next((r for r in _runs(entries) if len(r) >= fanout), None)
        if run is None:
            return
        rows = newest_of_key(_read(spark, run, schema + ", load_seq bigint"), keys)
        merged = _write(rows, log, run[0]["first_load"], run[-1]["last_load"])
        rest = [e.asDict() for e in entries if e["path"] not in {r["path"] for r in run}]
        _publish(spark, log, entries[0]["version"] + 1, rest + [merged])


def _runs(entries: list) -> list:
    """The longest run of neighbours up to each size class, smallest class first."""
    classes = sorted({size_class(e["rows"]) for e in entries})

    def runs_of(k):
        def step(found, e):
            if size_class(e["rows"]) <= k:
                found[-1].append(e)
            elif found[-1]:
                found.append([])
            return found
        return reduce(step, entries, [[]])
    return [r for k in classes for r in runs_of(k)]


def merge_all(spark: SparkSession, log: str, schema: str, keys: list) -> None:
    """Make one segment of the whole log."""
    entries = live_segments(spark, log)
    if len(entries) > 1:
        rows = newest_of_key(_read(spark, entries, schema + ", load_seq bigint"), keys)
        _publish(spark, log, entries[0]["version"] + 1,
                 [_write(rows, log, entries[0]["first_load"], entries[-1]["last_load"])])
