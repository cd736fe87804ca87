"""Bit sets of a fixed size, made by aggregation.

A set is rows (word, bits) of 64 bits each, at most `words` rows whatever the
input holds, so it may be broadcast or sent to tasks. A larger input only makes
more false positives: callers use a set to leave rows out early and never to
decide.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import lean

WORDS = 1 << 18
SHIFTS = (0, 12)     # bits of the hash where the positions of its first and second probe begin


MOST = 1 << 24


def fitting(n: int) -> int:
    """Words for a set of n hashes: 32 bits or more each, up to MOST words (128 MB)."""
    return max(1 << 12, min(MOST, 1 << max(0, n // 2 - 1).bit_length()))


def word_of(position: Column) -> Column:
    return F.shiftright(position, 6)


def bit_of(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"),
                           position.bitwiseAND(F.lit(63)).cast("int"))


def bit_rows(hashes: DataFrame, column: str, words: int = WORDS, probes: int = 1) -> DataFrame:
    """Rows (word, bits) of the set of a 64-bit hash column; words is a power of two."""
    positions = [F.shiftright(column, shift).bitwiseAND(F.lit(words * 64 - 1)) for shift in SHIFTS[:probes]]
    return (hashes.select(F.explode(F.array(*positions)).alias("at"))
            .select(word_of(F.col("at")).alias("word"), bit_of(F.col("at")).alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def maybe_in(rows: DataFrame, column: str, bit_set: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows whose hash may be in the set: all that are, and few others."""
    position = F.col(column).bitwiseAND(F.lit(words * 64 - 1))
    known = F.broadcast(bit_set.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    return (rows.withColumn("_at", position)
            .join(known, word_of(F.col("_at")) == F.col("_word"))
            .filter(F.col("_bits").bitwiseAND(bit_of(F.col("_at"))) != 0)
            .drop("_at", "_word", "_bits"))


def flagged(rows: DataFrame, column: str, bit_set: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """All rows, with whether the hash may be in the set."""
    position = F.col(column).bitwiseAND(F.lit(words * 64 - 1))
    known = F.broadcast(bit_set.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    return (rows.withColumn("_at", position)
            .join(known, word_of(F.col("_at")) == F.col("_word"), "left")
            .withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(bit_of(F.col("_at"))) != 0, F.lit(False)))
            .drop("_at", "_word", "_bits"))


def to_array(bit_set: DataFrame, words: int = WORDS) -> np.ndarray:
    """The set as an array of 8 * words bytes, for use inside tasks."""
    out = np.zeros(words, dtype=np.int64)
    with lean(bit_set.sparkSession):
        got = bit_set.select("word", "bits").toArrow()
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint8)


def has(array: np.ndarray, hashes: np.ndarray, probes: int = 1) -> np.ndarray:
    """Which of the 64-bit hashes may be in the set (little-endian words)."""
    out = True
    for shift in SHIFTS[:probes]:
        at = (hashes.view(np.uint64) >> np.uint64(shift)) & np.uint64(array.size * 8 - 1)
        out &= (array[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
