"""A symbol's record as a sequence of states, read at any number of cursors.

Nearly everything a cursor may ask is a property of the sessions up to it: the
running peak, the open drawdown, the current streak. `record_states` computes all of
them in one ordered pass: every window has the same partition and order and looks
back only, so a cursor cannot see a later session. What ends (an episode, a run) is
told on the session that ends it, from the state before. A table of (symbol, asof)
cursors then looks states up; bars are not copied per cursor. A caller with several
questions writes the states once and passes them as `states`.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..functions.ranks import prefix_contenders, top_of
from . import series as S
from .asof import asof_join

_EPISODE = ["peak_close", "peak_date", "trough", "episode_sessions"]
_RUN = ["direction", "run_length", "start_date", "run_base", "run_date", "run_close"]


def record_states(bars: DataFrame, spans=(50, 200)) -> DataFrame:
    """Each session with its return, averages, and everything known of the record by then.

    Sessions without a positive close move no peak, episode or record; sessions without
    a return belong to no run. On both the states of the session before carry on.
    """
    w, line = S.so_far(), S.sessions()
    before = line.rowsBetween(Window.unboundedPreceding, -1)

    def carried(condition, value, frame=w):
        return F.last(F.when(condition, value), ignorenulls=True).over(frame)

    valid = F.col("close") > 0
    held = F.when(valid, F.col("close"))
    moved = F.col("daily_return").isNotNull()
    above = F.col(f"ma_{spans[0]}") > F.col(f"ma_{spans[1]}")
    rows = bars.select(
        "symbol", "date", "close", S.return_column().alias("daily_return"), F.lag("close").over(line).alias("close_before"),
        F.max(held).over(w).alias("peak_close"), F.max(held).over(before).alias("peak_before"),
        F.count(held).over(w).alias("sessions_elapsed"),
        F.first(F.when(valid, F.col("date")), ignorenulls=True).over(w).alias("first_date"),
        F.first(held, ignorenulls=True).over(w).alias("first_close"),
        carried(valid, F.col("date")).alias("seen_date"), carried(valid, F.col("close")).alias("seen_close"),
        *[S.average_column(n).alias(f"ma_{n}") for n in spans])
    rows = (rows.withColumn("is_peak", F.coalesce(valid & (F.col("close") >= F.col("peak_close")), F.lit(False)))
            .withColumn("is_new", F.coalesce(valid & (F.col("peak_before").isNull() | (F.col("close") > F.col("peak_before"))),
                                             F.lit(False)))
            .withColumn("sign", F.signum("daily_return").cast("int")).withColumn("above", above))
    rows = rows.select(
        "*", F.sum(F.col("is_peak").cast("int")).over(w).alias("record_days"),
        carried(F.col("is_peak"), F.col("date")).alias("peak_date"),
        carried(F.col("is_peak"), F.col("sessions_elapsed")).alias("peak_session"),
        carried(F.col("is_peak"), F.col("date"), before).alias("prev_record"),
        carried(F.col("is_new"), F.col("date")).alias("record_date"),
        F.last("above", ignorenulls=True).over(before).alias("was_above"),
        F.last("sign", ignorenulls=True).over(before).alias("sign_before"),
        F.last("sign", ignorenulls=True).over(w).alias("direction"), F.count("daily_return").over(w).alias("moves"),
        carried(moved, F.col("date")).alias("run_date"), carried(moved, F.col("close")).alias("run_close"))
    starts = moved & (F.col("sign_before").isNull() | (F.col("sign") != F.col("sign_before")))
    gap = F.when(F.col("is_peak") & F.col("prev_record").isNotNull(),
                 F.struct(F.date_diff("date", "prev_record").alias("days"), (-F.unix_date("date")).alias("minus_end")))
    # episodes only grow in number, so the least of all (-episode, close) so far is the low of the one going on
    low = F.when(valid, F.struct((-F.col("record_days")).alias("k"), F.col("close"), F.col("date")))
    rows = rows.withColumn("starts", starts).select(
        "*", F.max(gap).over(w).alias("gap"), F.min(low).over(w).alias("low"),
        carried(F.col("starts"), F.col("date")).alias("start_date"),
        carried(F.col("starts"), F.col("close_before")).alias("run_base"),
        carried(F.col("starts"), F.col("moves")).alias("start_move"))
    rows = (rows.withColumn("trough", F.struct("low.close", "low.date"))
            .withColumn("episode_sessions", F.col("sessions_elapsed") - F.col("peak_session") + 1)
            .withColumn("run_length", (F.col("moves") - F.col("start_move") + 1).cast("int")))
    lag = lambda names: F.lag(F.struct(*names)).over(line)      # noqa: E731
    return rows.select(
        "symbol", "date", "close", "daily_return", *[f"ma_{n}" for n in spans], "above", "was_above",
        "seen_date", "seen_close", "sessions_elapsed", "first_date", "first_close", "is_peak", "record_days",
        "record_date", "gap", *_EPISODE, F.when(F.col("is_peak"), lag(_EPISODE)).alias("closed"),
        *_RUN, F.when(F.col("starts"), lag(_RUN)).alias("ended"))


def _at_cursor(cutoffs, states, values):
    """Each cursor's state on its last session; cursors before the record drop out."""
    return (asof_join(cutoffs, states, values, event_date="asof")
            .filter(F.col("hit").isNotNull()).select("symbol", "asof", "hit.*"))


def _states(bars, states):
    return record_states(bars) if states is None else states


def asof_snapshot(bars: DataFrame, cutoffs: DataFrame, states: DataFrame | None = None) -> DataFrame:
    at = (_at_cursor(cutoffs, _states(bars, states), ["seen_date", "seen_close", "peak_close", "sessions_elapsed",
                                                      "first_date", "first_close"])
          .filter("sessions_elapsed > 0")
          .select("symbol", "asof", F.col("seen_date").alias("date"), F.col("seen_close").alias("close"), "peak_close",
                  F.col("sessions_elapsed").cast("int").alias("sessions_elapsed"), "first_date", "first_close"))
    close, first = F.col("close"), F.col("first_close")
    d0, d1 = F.col("first_date"), F.col("date")
    return (at.withColumn("return_to_date", close / first - 1)
            .withColumn("drawdown", G.change(close, F.col("peak_close")))
            .withColumn("at_record_high", (close >= F.col("peak_close")).cast("int"))
            .withColumn("years_elapsed", G.years_between(d0, d1))
            .withColumn("cagr_to_date", G.growth_rate(first, close, d0, d1)))


def state_band(snapshot: DataFrame) -> DataFrame:
    """Where the record stands, as a band of the drawdown."""
    d = F.col("drawdown")
    band = (F.when(F.col("at_record_high") == 1, "record high").when(d >= -0.05, "near record")
            .when(d >= -0.20, "off high").when(d >= -0.50, "in drawdown")
            .otherwise("deep drawdown"))
    tone = (F.when((F.col("at_record_high") == 1) | (d >= -0.05), "positive")
            .when(d >= -0.20, "neutral").otherwise("negative"))
    return snapshot.select("symbol", "asof", "drawdown", band.alias("band"), tone.alias("tone"))


def _flagged(bars):
    """Valid bars with the running peak and a flag on sessions that set or match it."""
    return (S.valid_closes(bars).select("symbol", "date", "close",
                                        S.peak_column().alias("peak_close"))
            .withColumn("is_peak", F.col("close") >= F.col("peak_close")))


def drawdown_episodes(bars: DataFrame, cutoffs: DataFrame, min_depth: float = -0.2,
                      states: DataFrame | None = None) -> DataFrame:
    """Every episode from a record close to the next, as known at each cursor.

    An episode whose next record lies on or before the cursor is final. The one
    still open there is read from its running state (lowest close so far, sessions
    so far) and has no recovery.
    """
    states = _states(bars, states)
    depth = F.col("trough.close") / F.col("peak_close") - 1
    closed = (states.filter("closed.peak_date is not null")
              .select("symbol", F.col("date").alias("recovery_date"), "closed.*").filter(depth <= min_depth)
              .join(cutoffs, "symbol").filter("recovery_date <= asof")
              .select("symbol", "asof", *_EPISODE, "recovery_date"))
    still_open = (_at_cursor(cutoffs, states, _EPISODE).filter(depth <= min_depth)
                  .select("symbol", "asof", *_EPISODE, F.lit(None).cast("date").alias("recovery_date")))
    low, low_date = F.col("trough.close"), F.col("trough.date")
    return (closed.unionByName(still_open)
            .select("symbol", "asof", "peak_date", low_date.alias("trough_date"),
                    "recovery_date", "peak_close", low.alias("trough_close"),
                    depth.alias("depth"), F.col("episode_sessions").cast("int").alias("sessions"),
                    F.date_diff(low_date, "peak_date").alias("days_to_trough"),
                    F.date_diff("recovery_date", low_date).alias("days_to_recover")))


def record_summary(bars: DataFrame, cutoffs: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Record-high behaviour up to each cursor, from running aggregates alone."""
    at = _at_cursor(cutoffs, _states(bars, states), ["record_days", "peak_close", "record_date", "gap"])
    return at.filter("record_days > 0").select(
        "symbol", "asof", "record_days", F.col("peak_close").alias("record_close"), "record_date",
        F.col("gap.days").alias("longest_dry_spell"),
        F.date_from_unix_date(-F.col("gap.minus_end")).alias("dry_spell_end_date"))


def streaks(bars: DataFrame, cutoffs: DataFrame, direction: int | None = None,
            limit: int = 3, states: DataFrame | None = None) -> DataFrame:
    """Longest runs of rising (+1) or falling (-1) sessions known at each cursor.

    A flat session ends a run and belongs to none. Runs that ended by the cursor
    are final, and only those that entered the top of their direction when they
    ended can be in it at a cursor; the run still going on is cut at the cursor.
    """
    states = _states(bars, states)
    run = F.struct(F.col("run_length").alias("length"), "start_date", F.col("run_date").alias("end_date"),
                   F.col("run_base").alias("base"), F.col("run_close").alias("close"))
    wanted = F.col("direction") != 0 if direction is None else F.col("direction") == direction
    ended = (states.filter("ended.direction is not null").select("symbol", "date", "ended.*").filter(wanted)
             .select("symbol", "direction", "date", "run_length", run.alias("run")))
    finished = (prefix_contenders(ended, ["symbol", "direction"], "run_length", limit, ["run"])
                .join(cutoffs, "symbol")
                .select("symbol", "asof", "direction", F.explode(F.filter("contenders", lambda r: r["date"] <= F.col("asof"))).alias("r"))
                .select("symbol", "asof", "direction", "r.run"))
    going_on = (_at_cursor(cutoffs, states, _RUN).filter(wanted)
                .select("symbol", "asof", "direction", run.alias("run")))
    # a cursor holds at most the contenders of its symbol and one run
    ranked = (finished.unionByName(going_on).groupBy("symbol", "asof", "direction")
              .agg(F.sort_array(F.collect_list(F.struct(
                  (-F.col("run.length")).alias("k"), F.col("run.start_date").alias("d"), "run"))).alias("runs")))
    return (ranked.select("symbol", "asof", "direction", F.explode(F.slice("runs", 1, limit)).alias("r"))
            .select("symbol", "asof", "direction", "r.run.length", "r.run.start_date", "r.run.end_date",
                    (G.ratio(F.col("r.run.close"), F.col("r.run.base")) - 1).alias("run_return")))


def extreme_days(bars: DataFrame, cutoffs: DataFrame, limit: int = 5,
                 states: DataFrame | None = None) -> DataFrame:
    """The largest gains and the largest losses up to each cursor.

    A day outside the top of its own past is in no cursor's answer, so only the
    few days that entered it meet the cursors. Gains and losses are found in one
    grouping of one scan.
    """
    rows = bars.select("symbol", "date", "close", S.return_column().alias("daily_return")) if states is None else states
    rows = rows.filter(F.col("daily_return").isNotNull()).select(
        "symbol", "date", "close", "daily_return",
        F.explode(F.array(F.struct(F.lit("gain").alias("direction"), F.col("daily_return").alias("score")),
                          F.struct(F.lit("loss").alias("direction"), (-F.col("daily_return")).alias("score")))).alias("side"))
    rows = rows.select("symbol", "date", "close", "daily_return", "side.*")
    return (prefix_contenders(rows, ["symbol", "direction"], "score", limit, ["close", "daily_return"])
            .join(cutoffs, "symbol")
            .select("symbol", "asof", "direction", F.explode(top_of("contenders", F.col("asof"), limit)).alias("r"))
            .select("symbol", "asof", "direction", "r.date", "r.close", "r.daily_return"))


def best_worst_periods(monthly: DataFrame, yearly: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Best and worst full month and full year up to each cursor.

    The first and the last visible month are left out as partial: a month's state
    covers the months before it but the first. A cursor reads the state of its
    last visible month and year. Ties go to the earlier period.
    """
    def states(df, period, ret, start, candidate, frame):
        k = F.regexp_replace(period, "-", "").cast("int")
        best = F.when(candidate, F.struct(F.col(ret).alias("ret"), (-k).alias("k"), period))
        worst = F.when(candidate, F.struct(F.col(ret).alias("ret"), k.alias("k"), period))
        return (df.filter(F.col(ret).isNotNull()).withColumn("date", start.cast("date"))
                .withColumn("place", F.row_number().over(S.sessions()))
                .select("symbol", "date", F.max(best).over(frame).alias("best"),
                        F.min(worst).over(frame).alias("worst")))

    def read(state, period_type, period):
        stacked = F.array(*[F.struct(F.lit(x).alias("extreme"), F.col(f"{x}.{period}").alias("period"),
                                     F.col(f"{x}.ret").alias("period_return"))
                            for x in ("best", "worst")])
        return (_at_cursor(cutoffs, state, ["best", "worst"]).filter("best is not null")
                .select("symbol", "asof", F.lit(period_type).alias("period_type"), F.inline(stacked)))

    months = states(monthly, "year_month", "month_return", F.concat("year_month", F.lit("-01")),
                    F.col("place") > 1,
                    S.sessions().rowsBetween(Window.unboundedPreceding, -1))
    years = states(yearly.filter("is_partial = 0"), "year", "year_return",
                   F.concat("year", F.lit("-01-01")), F.lit(True), S.so_far())
    return read(months, "month", "year_month").unionByName(read(years, "year", "year"))


def ma_crossovers(averages: DataFrame, cutoffs: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Sessions on which the 50-session mean changes sides of the 200-session one."""
    if states is None:
        full = averages.filter(F.col("ma_50").isNotNull() & F.col("ma_200").isNotNull())
        states = (full.withColumn("above", F.col("ma_50") > F.col("ma_200"))
                  .withColumn("was_above", F.lag("above").over(S.sessions())))
    return (states.filter(F.col("above") != F.col("was_above")).join(cutoffs, "symbol").filter("date <= asof")
            .select("symbol", "asof", "date", "close",
                    F.when(F.col("above"), "golden").otherwise("death").alias("cross_type")))


def price_path(bars: DataFrame, stride: int = 3) -> DataFrame:
    """Every stride-th session plus the first, the last and every record close."""
    n = F.row_number().over(S.sessions())
    last = F.lead("date").over(S.sessions()).isNull()
    rows = (_flagged(bars).withColumn("n", n).withColumn("is_last", last)
            .filter((F.col("n") % stride == 0) | (F.col("n") == 1) | F.col("is_last")
                    | F.col("is_peak")))
    return rows.select("symbol", "date", "close", "peak_close",
                       G.change(F.col("close"), F.col("peak_close")).alias("drawdown"))


_MARKET_TONE = {"crisis": "negative", "recovery": "positive"}


def timeline(company, market, episodes, extremes) -> DataFrame:
    """One dated list per cursor: curated events, market events and milestones.

    Events dated before the price record have no session and no place on it.
    """
    def rows(df, date, title, detail, kind, tone, source, move):
        return df.select("symbol", "asof", F.col(date).alias("date"), title.alias("title"),
                         detail.alias("detail"), F.lit(kind).alias("kind"), tone.alias("tone"),
                         source.alias("source"), F.col(move).alias("move"))
    tone = F.lit("neutral")
    for category, value in _MARKET_TONE.items():
        tone = F.when(F.col("category") == category, value).otherwise(tone)
    blank = F.lit("")
    up_down = F.when(F.col("direction") == "gain", "positive").otherwise("negative")
    parts = [
        rows(company.filter(F.col("session_date").isNotNull()), "date", F.col("title"),
             F.col("description"), "company", F.col("tone"), F.col("source"), "forward_return"),
        rows(market, "date", F.col("title"), F.col("description"), "market", tone,
             F.lit("market"), "company_move"),
        rows(episodes, "trough_date", F.lit("drawdown bottom"),
             F.when(F.col("recovery_date").isNull(), "not recovered")
             .otherwise("recovered"), "milestone", F.lit("negative"), blank, "depth"),
        rows(extremes, "date", F.concat(F.lit("largest "), "direction"), blank, "milestone",
             up_down, blank, "daily_return"),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.filter("date <= asof").sortWithinPartitions("symbol", "asof", "date")


# Event categories told as facts, and the dry spell worth telling.
FACT_CATEGORIES = ("IPO", "Split")
LONG_DRY_SPELL_DAYS = 400


def fact_selection(snapshot, records, extremes, runs, periods, episodes, crossovers,
                   company, fact_categories=FACT_CATEGORIES) -> DataFrame:
    """Typed facts (symbol, asof, kind, value, date) true at each cursor.

    Each source already holds few rows per cursor; a fact is its first, worst or
    counted row, taken by an aggregate keyed by (symbol, asof).
    """
    def fact(df, kind, value, date):
        kind = kind if not isinstance(kind, str) else F.lit(kind)
        return df.select("symbol", "asof", kind.alias("kind"), value.cast("double").alias("value"),
                         date.alias("date"))

    def extremum(df, pick, *fields):
        return df.groupBy("symbol", "asof").agg(pick(F.struct(*fields)).alias("x"))

    gains = extremes.filter("direction = 'gain'")
    losses = extremes.filter("direction = 'loss'")
    year_end = F.when(F.col("period_type") == "year", F.concat("period", F.lit("-12-31"))) \
        .otherwise(F.concat("period", F.lit("-28"))).cast("date")
    longest = runs.groupBy("symbol", "asof", "direction").agg(
        F.max(F.struct("length", (-F.unix_date("start_date")).alias("k"), "end_date")).alias("x"))
    deepest = extremum(episodes, F.min, "depth", "peak_date", "trough_date", "recovery_date")
    crosses = crossovers.groupBy("symbol", "asof").agg(
        F.count("*").alias("n"), F.sum((F.col("cross_type") == "golden").cast("int")).alias("up"))
    none = F.lit(None).cast("date")
    parts = [
        fact(company.filter(F.col("category").isin(list(fact_categories))), "company event",
             F.col("forward_return"), F.col("date")),
        fact(records, "record close", F.col("record_close"), F.col("record_date")),
        fact(records, "record days", F.col("record_days"), F.col("record_date")),
        fact(records.filter(F.col("longest_dry_spell") > LONG_DRY_SPELL_DAYS),
             "longest dry spell", F.col("longest_dry_spell"), F.col("dry_spell_end_date")),
        fact(extremum(gains, F.max, "daily_return", "date"), "best day",
             F.col("x.daily_return"), F.col("x.date")),
        fact(extremum(losses, F.min, "daily_return", "date"), "worst day",
             F.col("x.daily_return"), F.col("x.date")),
        fact(longest, F.when(F.col("direction") > 0, "longest rise").otherwise("longest fall"),
             F.col("x.length"), F.col("x.end_date")),
        fact(periods, F.concat_ws(" ", "extreme", "period_type"), F.col("period_return"), year_end),
        fact(deepest, "deepest drawdown", F.col("x.depth"),
             F.coalesce("x.recovery_date", "x.trough_date")),
        fact(snapshot.filter(F.col("return_to_date").isNotNull()), "return to date",
             F.col("return_to_date"), F.col("first_date")),
        fact(crosses, "trend changes", F.col("n"), none),
        fact(crosses, "upward trend changes", F.col("up"), none),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
