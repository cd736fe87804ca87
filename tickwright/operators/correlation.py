"""Pairwise correlation of daily returns.

Joining returns to themselves by date would send every pair of every session
through a shuffle. Instead symbols are cut into blocks and sessions into spans;
each (block, block, span) is one dense product of two small matrices inside a
task, and only the six sums of a pair leave it. A block pair holds at most
2 * BLOCK * SPAN_DAYS returns, so no task grows with the table.

The matrix has a row for every pair by nature. What is asked of it mostly is not that
large: `nearest_partners` (the best k of each symbol) and `correlation_summary` reduce
each block pair inside its task, so that rows grow with the symbols and with the block
pairs. A symbol's whole window is one row of a block there: a block pair holds at most
2 * BLOCK records.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import guards as G
from ..session import persist_table
from .ranges import _within

BLOCK = 256
SPAN_DAYS = 1024

_SUMS = "sym_a string, sym_b string, n double, sx double, sy double, sxy double, sxx double, syy double"


def _block_sums():
    """The task function, as a closure: it travels with the plan, so workers need
    numpy and pandas but not this package."""
    def block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over shared sessions for every pair of one block pair."""
        left_id, right_id = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        days, day_code = np.unique(pdf["day"].to_numpy(), return_inverse=True)

        def dense(part):
            names, code = np.unique(pdf["symbol"].to_numpy()[part].astype(str), return_inverse=True)
            values = np.zeros((len(names), len(days)))
            present = np.zeros_like(values)
            values[code, day_code[part]] = pdf["r"].to_numpy()[part]
            present[code, day_code[part]] = 1.0
            return names, values, present

        block = pdf["b"].to_numpy()
        a_names, x, mx = dense(block == left_id)
        b_names, y, my = (a_names, x, mx) if left_id == right_id else dense(block == right_id)
        n = mx @ my.T
        keep = n > 0
        if left_id == right_id:
            keep &= np.triu(np.ones(n.shape, dtype=bool))
        i, j = np.nonzero(keep)
        return pd.DataFrame({
            "sym_a": a_names[i], "sym_b": b_names[j], "n": n[i, j],
            "sx": (x @ my.T)[i, j], "sy": (mx @ y.T)[i, j], "sxy": (x @ y.T)[i, j],
            "sxx": ((x * x) @ my.T)[i, j], "syy": (mx @ (y * y).T)[i, j]})
    return block_sums


def _window_rows(returns: DataFrame, start, end, symbols=None) -> DataFrame:
    rows = (_within(returns, start, end).filter(F.col("daily_return").isNotNull())
            .select("symbol", F.unix_date("date").alias("day"), F.col("daily_return").alias("r")))
    return rows if symbols is None else rows.filter(F.col("symbol").isin(list(symbols)))


def _block_pairs(rows: DataFrame, n_symbols=None, diagonal: bool | None = None) -> DataFrame:
    """Rows once for every pair of blocks (bi <= bj) that theirs, b, is part of.

    diagonal picks the pairs of a block with itself, or those of two blocks.
    """
    if n_symbols is None:
        n_symbols = rows.select("symbol").distinct().count()
    blocks = max(1, math.ceil(n_symbols / BLOCK))
    b = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    spread = (rows.withColumn("b", b).withColumn("o", F.col("b") if diagonal else other)
              .withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o"))
    return spread.filter("bi < bj") if diagonal is False else spread


def _reduced(span_days: int, k: int):
    """The task function: a block pair's k best partners of each symbol, or its summary.

    With k, pairs on one calendar are given up early: what is left of the product after
    some spans is at most the product of what is left of the norms (Cauchy-Schwarz), and a
    pair that cannot reach the floor of either symbol any more is not finished.
    """
    margin = 1e-9

    def exact(x, mx, y, my):
        """(n, correlation) matrices over shared sessions; NaN under three or without movement."""
        n = mx @ my.T
        sx, sy, sxy = x @ my.T, mx @ y.T, x @ y.T
        sxx, syy = (x * x) @ my.T, mx @ (y * y).T
        under = np.sqrt(np.maximum(n * sxx - sx * sx, 0)) * np.sqrt(np.maximum(n * syy - sy * sy, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where((n >= 3) & (under > 0), np.clip((n * sxy - sx * sy) / under, -1, 1), np.nan)
        return n, value

    def unfinished(x, y, floor_x, floor_y):
        """Which pairs of complete records may reach the lower of their floors."""
        def scaled(m):
            m = m - m.mean(axis=1, keepdims=True)
            length = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, length, out=np.zeros_like(m), where=length > 0)
        x, y = scaled(x), scaled(y)
        part = np.zeros((len(x), len(y)))
        least = np.minimum.outer(floor_x, floor_y) - margin
        for at in range(0, x.shape[1], span_days):
            stop = at + span_days
            part += x[:, at:stop] @ y[:, at:stop].T
            left = np.outer(np.linalg.norm(x[:, stop:], axis=1), np.linalg.norm(y[:, stop:], axis=1))
            open_ = part + left >= least
            rows, columns = open_.any(axis=1), open_.any(axis=0)
            if not rows.any():
                return open_
            if not (rows.all() and columns.all()):       # go on with the part that is still open
                rest = np.zeros_like(open_)
                rest[np.ix_(rows, columns)] = unfinished_part(
                    x[rows], y[columns], part[np.ix_(rows, columns)], least[np.ix_(rows, columns)], stop)
                return rest
        return open_

    def unfinished_part(x, y, part, least, at):
        part = part + x[:, at:] @ y[:, at:].T
        return part >= least

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        left_id, right_id = pdf["bi"].iloc[0], pdf["bj"].iloc[0]
        days, day_code = np.unique(pdf["day"].to_numpy(), return_inverse=True)
        block = pdf["b"].to_numpy()

        def dense(part):
            names, first, code = np.unique(pdf["symbol"].to_numpy()[part].astype(str), return_index=True, return_inverse=True)
            values = np.zeros((len(names), len(days)))
            present = np.zeros_like(values)
            values[code, day_code[part]] = pdf["r"].to_numpy()[part]
            present[code, day_code[part]] = 1.0
            floors = pdf["floor"].to_numpy()[part][first] if k and "floor" in pdf else np.full(len(names), -2.0)
            return names, values, present, np.nan_to_num(floors, nan=-2.0)

        a, x, mx, fa = dense(block == left_id)
        same = left_id == right_id
        b, y, my, fb = (a, x, mx, fa) if same else dense(block == right_id)
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in (_PARTNERS if k else _SUMMARY)})
        wanted = np.ones((len(a), len(b)), dtype=bool)
        if same:
            wanted &= np.triu(np.ones(wanted.shape, dtype=bool), 1)
        if k:
            full_a, full_b = mx.all(axis=1), my.all(axis=1)
            if full_a.any() and full_b.any():
                both = np.ix_(full_a, full_b)
                wanted[both] &= unfinished(x[full_a], y[full_b], fa[full_a], fb[full_b])
        rows, columns = wanted.any(axis=1), wanted.any(axis=0)
        n, value = np.zeros(wanted.shape), np.full(wanted.shape, np.nan)
        if rows.any():
            n[np.ix_(rows, columns)], value[np.ix_(rows, columns)] = exact(x[rows], mx[rows], y[columns], my[columns])
        value[~wanted] = np.nan
        i, j = np.nonzero(~np.isnan(value))
        one, other, shared, found = a[i], b[j], n[i, j].astype("int64"), value[i, j]
        if k:
            one, other = np.concatenate((one, other)), np.concatenate((other, one))
            shared, found = np.tile(shared, 2), np.tile(found, 2)
            order = np.lexsort((other, -found, one))
            first = np.concatenate(([True], one[order][1:] != one[order][:-1]))
            place = np.arange(order.size) - np.maximum.accumulate(np.where(first, np.arange(order.size), 0)) if order.size else order
            order = order[place < k]
            return pd.DataFrame({"symbol": one[order].astype(object), "partner": other[order].astype(object),
                                 "n": shared[order], "correlation": found[order]})
        if not found.size:
            return pd.DataFrame({c: pd.Series(dtype=object) for c in _SUMMARY})
        pair = np.array([f"{x} {y}" if x < y else f"{y} {x}" for x, y in zip(one, other)], dtype=object)
        order = np.lexsort((pair.astype(str), found))
        return pd.DataFrame({
            "most": [found[order[-1]]], "most_pair": [pair[order[-1]]], "least": [found[order[0]]],
            "least_pair": [pair[order[0]]], "total": [found.sum()], "n_pairs": [found.size],
            "fewest_shared": [int(shared.min())]})
    return reduce


_PARTNERS = ("symbol", "partner", "n", "correlation")
_SUMMARY = ("most", "most_pair", "least", "least_pair", "total", "n_pairs", "fewest_shared")


def nearest_partners(returns: DataFrame, start, end, k: int = 5, symbols=None, n_symbols=None) -> DataFrame:
    """The k symbols of highest correlation with each: symbol, rank, partner, n, correlation.

    Each block is compared with itself first; the k-th best found there is a symbol's
    floor, under which pairs of other blocks are given up. A symbol's rows are k for each
    block at most, and k in the end. Equal values go by the partner's name.
    """
    rows = _window_rows(returns, start, end, symbols)
    if n_symbols is None:
        n_symbols = rows.select("symbol").distinct().count()
    kind = "symbol string, partner string, n long, correlation double"
    task = _reduced(max(1, SPAN_DAYS // 4), k)
    own = persist_table(_block_pairs(rows, n_symbols, True).groupBy("bi", "bj").applyInPandas(task, kind), "partners")
    floors = (own.groupBy("symbol").agg(F.min("correlation").alias("least"), F.count("*").alias("found"))
              .filter(F.col("found") >= k).select("symbol", F.col("least").alias("floor")))
    other = (_block_pairs(rows.join(floors, "symbol", "left"), n_symbols, False)
             .groupBy("bi", "bj").applyInPandas(task, kind))
    best = Window.partitionBy("symbol").orderBy(F.desc("correlation"), "partner")
    return (own.unionByName(other).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("symbol", "rank", "partner", "n", "correlation"))


def correlation_pairs(returns: DataFrame, start, end, symbols=None, n_symbols=None) -> DataFrame:
    """All ordered pairs, self-pairs included: sym_a, sym_b, n, correlation.

    symbols limits the universe. n_symbols sets the number of blocks; it is
    counted when not given.
    """
    rows = _window_rows(returns, start, end, symbols)
    if symbols is not None:
        n_symbols = n_symbols or len(symbols)
    spread = _block_pairs(rows, n_symbols).withColumn("span", F.floor(F.col("day") / SPAN_DAYS).cast("int"))
    sums = (spread.groupBy("bi", "bj", "span").applyInPandas(_block_sums(), _SUMS)
            .groupBy("sym_a", "sym_b")
            .agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")]))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread_x = F.sqrt(F.greatest(n * F.col("sxx") - sx * sx, F.lit(0.0)))
    spread_y = F.sqrt(F.greatest(n * F.col("syy") - sy * sy, F.lit(0.0)))
    value = G.clamp(G.ratio(n * F.col("sxy") - sx * sy, spread_x * spread_y), -1.0, 1.0)
    half = sums.select("sym_a", "sym_b", n.cast("long").alias("n"),
                       F.when(n >= 3, value).alias("correlation"))
    both = F.array(F.struct("sym_a", "sym_b"),
                   F.struct(F.col("sym_b").alias("sym_a"), F.col("sym_a").alias("sym_b")))
    sides = F.when(F.col("sym_a") == F.col("sym_b"), F.slice(both, 1, 1)).otherwise(both)
    return half.select(F.inline(sides), "n", "correlation")


def exact_pairs(pairs: DataFrame) -> DataFrame:
    """Each pair once: no mirror, no self-pair."""
    return pairs.filter("sym_a < sym_b")


def correlation_wide(pairs: DataFrame, symbols) -> DataFrame:
    """A square in the caller's order; row position keeps that order."""
    order = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("sym_a"))
    return (pairs.groupBy("sym_a").pivot("sym_b", list(symbols)).agg(F.first("correlation"))
            .filter(F.col("sym_a").isin(list(symbols))).orderBy(order))


def correlation_summary(returns: DataFrame, start, end, symbols=None, n_symbols=None) -> DataFrame:
    """One row: the closest and the loosest pair, the mean, the thinnest overlap.

    Each pair of blocks gives one row; no row is made for a pair of symbols. Equal values
    are told apart by name.
    """
    spread = _block_pairs(_window_rows(returns, start, end, symbols), n_symbols)
    parts = spread.groupBy("bi", "bj").applyInPandas(
        _reduced(SPAN_DAYS, 0), "most double, most_pair string, least double, least_pair string, total double, "
        "n_pairs long, fewest_shared long")
    return parts.agg(
        F.max_by("most_pair", F.struct("most", "most_pair")).alias("most_pair"), F.max("most").alias("most"),
        F.min_by("least_pair", F.struct("least", "least_pair")).alias("least_pair"), F.min("least").alias("least"),
        (F.sum("total") / F.sum("n_pairs")).alias("mean_correlation"), F.sum("n_pairs").alias("n_pairs"),
        F.min("fewest_shared").alias("fewest_shared"))
