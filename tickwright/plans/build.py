"""The build: load, validate, derive, roll up, then publish.

Tables of a run are written under builds/<run>. The manifest row naming the run
is written last, so a run that dies leaves the published one in place, and a
reader never sees half a build.

A build starts from the published one. A base table whose fingerprint did not change is
named where it lies instead of being written again; bars are compared by month and only
months that differ are stored, with one partial row a symbol, from which statistics and
quotes are merged (plans.partials). The metric panel is made again when one of the
tables it reads has changed.
"""

import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import metrics as M
from ..operators import rollups as U
from ..operators import series as S
from ..operators.market import one_row
from ..sources.dimensions import path_exists
from ..sources.events import validate_events
from . import partials as T

SCHEMA_VERSION = 2
BASE_TABLES = ("prices", "symbols", "company_events", "event_categories", "market_events",
               "intel_prices", "intel_symbols", "intel_fundamentals", "intel_analyst")
ROLLUPS = ("symbol_stats", "latest_quote", "metric_panel")
REQUIRED = BASE_TABLES + ROLLUPS
_MANIFEST = "run string, schema_version int, data_version string, published double, tables map<string,string>, prints map<string,string>"


def data_version(wide_bars, fundamentals, analyst, bars) -> DataFrame:
    """A fingerprint of the data: the same data gives the same text, new data another."""
    def part(name, df, *cols):
        text = [F.coalesce(c.cast("string"), F.lit("None")) for c in cols]
        return df.agg(F.concat_ws("|", *text).alias(name))

    row = one_row(part("v0", wide_bars, F.max("date"), F.count("*")),
                  part("v1", fundamentals, F.max("asof"), F.count("*")),
                  part("v2", analyst, F.count("*")), part("v3", bars, F.max("date"), F.count("*")))
    return row.select(F.concat_ws("|", "v0", "v1", "v2", "v3").alias("data_version"))


def derived_views(tables: dict) -> dict:
    """The series every reader may query by name; computed on read."""
    bars = tables["prices"]
    return {"daily_returns": S.daily_returns(bars), "drawdowns": S.drawdowns(bars),
            "moving_averages": S.moving_averages(bars),
            "rolling_volatility": S.rolling_volatility(bars),
            "yearly_summary": U.yearly_summary(bars), "monthly_returns": U.monthly_returns(bars)}


def rollups(tables: dict, index_symbol: str) -> dict:
    """The rollups computed from whole tables."""
    bars = tables["prices"]
    return {"symbol_stats": U.symbol_stats(bars, tables["symbols"]),
            "latest_quote": U.latest_quote(bars), "metric_panel": metric_panel(tables, index_symbol)}


def metric_panel(tables: dict, index_symbol: str) -> DataFrame:
    prices = M.price_metrics(tables["intel_prices"], tables["prices"].filter(F.col("symbol") == index_symbol))
    return M.metric_panel(tables["intel_symbols"], prices, tables["intel_fundamentals"], tables["intel_analyst"])


def fingerprint(name: str, df: DataFrame) -> DataFrame:
    """(name, print) of a table: its columns, rows and the sum of its rows' hashes."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return df.agg(F.concat_ws("|", F.lit(",".join(df.columns)), F.count("*"), total.cast("string")).alias("print")).select(
        F.lit(name).alias("name"), "print")


def register_views(tables: dict) -> list[str]:
    """Every table and derived series as a temporary view; the names registered."""
    named = {**tables, **derived_views(tables)}
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return sorted(named)


def _table_path(root, run, name):
    return f"{root.rstrip('/')}/builds/{run}/{name}"


def materialize(frames: dict, root: str, run: str, spark: SparkSession) -> dict:
    """Writes each frame once and returns readers of what was written."""
    out = {}
    for name, df in frames.items():
        path = _table_path(root, run, name)
        df.write.parquet(path)
        out[name] = spark.read.schema(df.schema).parquet(path)
    return out


def build_job(spark: SparkSession, inputs: dict, root: str, index_symbol: str) -> str:
    """Runs the build over `inputs` (the base tables by name); returns the run."""
    missing = set(BASE_TABLES) - set(inputs)
    if missing:
        raise ValueError(f"build inputs missing: {sorted(missing)}")
    run = f"{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
    checked = dict(inputs)
    events = inputs["company_events"].withColumn("date", F.col("date").cast("string"))
    checked["company_events"] = validate_events(events, inputs["symbols"], inputs["event_categories"])
    before = read_manifest(spark, root)
    usable = before is not None and before["schema_version"] == SCHEMA_VERSION
    index = T.refresh(spark, inputs["prices"], root, run, before["run"] if usable else None)
    parts = [fingerprint(n, inputs[n]) for n in BASE_TABLES if n != "prices"]
    prints = dict(reduce(DataFrame.unionByName, [*parts, fingerprint("prices", index.drop("path"))]).collect())
    prints["index"] = index_symbol
    same = {n for n in BASE_TABLES if usable and before["prints"].get(n) == prints[n] and n in before["tables"]}
    tables = {n: before["tables"][n] if n in same else _table_path(root, run, n) for n in BASE_TABLES}
    materialize({n: checked[n] for n in BASE_TABLES if n not in same and n != "prices"}, root, run, spark)
    base = {n: spark.read.schema(checked[n].schema).parquet(tables[n]) for n in BASE_TABLES if n != "prices"}
    base["prices"] = T.read_months(spark, index, "bars", schemas.BARS)
    tables["prices"] = f"{root.rstrip('/')}/months/{run}"
    merged = T.partials(spark, index)
    rolled = {"symbol_stats": T.symbol_stats(merged, base["symbols"]), "latest_quote": T.latest_quote(spark, merged, index)}
    panel_inputs = ("prices", "intel_prices", "intel_symbols", "intel_fundamentals", "intel_analyst")
    if usable and same.issuperset(panel_inputs) and before["prints"].get("index") == index_symbol:
        tables["metric_panel"] = before["tables"]["metric_panel"]
    else:
        rolled["metric_panel"] = metric_panel(base, index_symbol)
    materialize(rolled, root, run, spark)
    tables |= {n: _table_path(root, run, n) for n in rolled}
    version = data_version(base["intel_prices"], base["intel_fundamentals"],
                           base["intel_analyst"], base["prices"]).first()[0]
    row = spark.createDataFrame([(run, SCHEMA_VERSION, version, time.time(), tables, prints)], _MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return run


def read_manifest(spark: SparkSession, root: str):
    """The newest manifest row, or None when nothing was published."""
    path = f"{root.rstrip('/')}/manifest"
    if not path_exists(spark, path):
        return None
    rows = (spark.read.schema(_MANIFEST).parquet(path)
            .orderBy(F.desc("published"), F.desc("run")).limit(1).collect())
    return rows[0] if rows else None


def build_is_current(spark: SparkSession, root: str, schema_version: int = SCHEMA_VERSION) -> bool:
    """Published by this version of the code, with every required table in place."""
    row = read_manifest(spark, root)
    return (row is not None and row["schema_version"] == schema_version
            and all(path_exists(spark, f"{row['tables'][t]}{'/index' if t == 'prices' else ''}/_SUCCESS")
                    for t in REQUIRED))


def open_build(spark: SparkSession, root: str) -> dict:
    """Readers of the published tables."""
    row = read_manifest(spark, root)
    if row is None:
        raise FileNotFoundError(f"nothing published under {root}")
    out = {t: spark.read.parquet(row["tables"][t]) for t in REQUIRED if t != "prices"}
    out["prices"] = T.read_months(spark, T.read_index(spark, f"{row['tables']['prices']}/index"), "bars", schemas.BARS)
    return out
