"""Mixing sources to target weights on a low-discrepancy schedule.

Slot k of the schedule lies at the fractional part of k times the golden ratio,
mapped through the cumulative targets to a source. The r-th slot of a source takes
its r-th block of equally many words, over and over; blocks are cut from the
source's documents in shuffled order. Any stretch of the schedule therefore holds
the sources nearly in proportion, and no random state is kept.

Defined results: a null text has no words; a null source is a source of its own
and comes last; documents without words take nothing; rows with equal ids are
placed one after another and shuffled by the hash of the id, or of the text
without one; an empty table gives an empty result. There may be at
most MAX_SOURCES sources (more is an error), so their targets may be sent to tasks.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_total
from .tables import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 128
CHUNKS = 4096
COPY = 1 << 20      # one copy of a document, in the whole numbers that copies are summed in
MAX_SOURCES = 10_000
#: 2**31 and the odd number next to 2**31 divided by the golden ratio.
TURN, STEP = 1 << 31, 1_327_217_885


def count_words(text: Column) -> Column:
    """Words of a text; a word starts wherever a non-blank follows a blank or the start."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def targets(sizes: list, weights=WEIGHTS, repeats=REPEATS) -> list:
    """Words for each source: shares by repeating weights, at most repeats * size.

    What is above a limit is shared again by weight among the others until none
    is above.
    """
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weight[i] for i in free)
        over = {i for i in free if weight[i] * unit > repeats * sizes[i]}
        for i in over or free:
            out[i] = float(repeats * sizes[i]) if over else weight[i] * unit
        if not over:
            break
        left -= sum(out[i] for i in over)
        free -= over
    return out


def source_targets(sized: DataFrame, weights=WEIGHTS, repeats=REPEATS) -> list:
    """(n, source, source_size, target) for each source, n from 0 by code point, null last."""
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).take(MAX_SOURCES + 1)
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    shares = targets([r.source_size for r in found], weights, repeats)
    return [(i, r.source, r.source_size, t) for i, (r, t) in enumerate(zip(found, shares))]


def schedule(spark, rows, block_words=BLOCK_WORDS, repeats=REPEATS) -> DataFrame:
    """(slot, n, rank, block, pass_no): which block each slot of the schedule takes.

    A rank past the last repeat of a source's last block is left open.
    """
    goal = np.array([t for *_, t in rows], dtype=float)
    blocks = np.array([-(-size // block_words) for *_, size, _ in rows], dtype=np.int64)
    bounds = np.cumsum(goal) / max(goal.sum(), 1.0)
    if len(bounds):
        bounds[int(np.flatnonzero(goal)[-1]) if goal.any() else -1:] = 2.0
    slots = int(-(-int(round(goal.sum())) // block_words))

    @F.pandas_udf("int")
    def source_at(slot: pd.Series) -> pd.Series:
        point = (slot.to_numpy() % TURN) * STEP % TURN / TURN
        return pd.Series(np.searchsorted(bounds, point, side="right").astype(np.int32))

    @F.pandas_udf("long")
    def blocks_of(n: pd.Series) -> pd.Series:
        return pd.Series(blocks[n.to_numpy()])

    base = (spark.range(slots).withColumnRenamed("id", "slot")
            .withColumn("n", source_at("slot")).withColumn("chunk", F.expr("slot div 65536")))
    ranked = running_total(base, "n", "chunk", ["slot"], F.lit(1).cast("long"), "rank")
    return (ranked.withColumn("blocks", blocks_of("n"))
            .select("slot", "n", "rank", F.expr("rank % blocks").alias("block"),
                    F.expr("rank div blocks").alias("pass_no"))
            .filter(F.col("pass_no") < repeats))


def document_blocks(sized: DataFrame, block_words=BLOCK_WORDS) -> DataFrame:
    """The rows of sized (doc_id, n, size, mark) with begin, block and words, one per block met.

    Documents of a source stand in the order of their mark, a hash of the id; begin
    is the number of words before. A row without words stays, with a null block.
    """
    keyed = sized.withColumn("chunk", F.conv(F.substring("mark", 1, 3), 16, 10).cast("int"))
    placed = running_total(keyed, "n", "chunk", ["mark", "doc_id", "size"], F.col("size"), "begin")
    first, last = F.expr(f"begin div {block_words}"), F.expr(f"(begin + size - 1) div {block_words}")
    pieces = placed.withColumn("block", F.explode_outer(
        F.when(F.col("size") > 0, F.sequence(first, last))))
    words = (F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block_words)
             - F.greatest(F.col("begin"), F.col("block") * block_words))
    return pieces.withColumn("words", words)


def mark_of() -> Column:
    """The hash that shuffles a source: of the id, or of the text without one."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))


def mix(docs: DataFrame, weights=WEIGHTS, repeats=REPEATS, block_words=BLOCK_WORDS) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    return marked_mix(docs, weights, repeats, block_words).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def marked_mix(docs: DataFrame, weights=WEIGHTS, repeats=REPEATS, block_words=BLOCK_WORDS) -> DataFrame:
    """The rows of mix() with mark and n, the number of the source."""
    spark = docs.sparkSession
    sized = written(docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        count_words(F.col("text")).alias("size"), mark_of().alias("mark")), "sized-documents")
    rows = source_targets(sized, weights, repeats)
    known = spark.createDataFrame(rows, "n int, name string, source_size long, target double")
    times = (schedule(spark, rows, block_words, repeats)
             .groupBy("n", "block").agg(F.count(F.lit(1)).alias("times")))
    numbered = sized.join(known.select("n", "name"), F.col("source").eqNullSafe(F.col("name")))
    pieces = document_blocks(numbered.select("doc_id", "n", "size", "mark"), block_words)
    taken = (pieces.join(times, ["n", "block"], "left")
             .groupBy("doc_id", "n", "mark", "begin", "size")
             .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"),
                  F.when(F.col("size") > 0, 1).otherwise(F.count(F.lit(1))).cast("int").alias("rows"))
             .withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))))
    return taken.join(known, "n").select(
        "doc_id", F.col("name").alias("source"), "size", "source_size", "target", "taken", "mark", "n")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each as often as its taken words make up its size, rounded.

    What rounding leaves is carried to the next document of the source, by powers of 2
    of the size and then shuffled, so that a source keeps its share also where each of
    its documents takes less than half of itself. A source with a target keeps one
    document at least, the one nearest to it in words. Rows that share source and id,
    or text without an id, are repeated alike; a document without words is left out.
    """
    folded = written(marked_mix(docs, **options).filter("size > 0")
                     .groupBy("n", "source", "doc_id", "mark")
                     .agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.first("target").alias("target"))
                     .withColumn("part", F.round(F.col("taken") * COPY / F.col("size")).cast("long"))
                     .withColumn("chunk", F.log2("size").cast("int") * 256
                                 + F.conv(F.substring("mark", 1, 2), 16, 10).cast("int")), "mixed-documents")
    placed = running_total(folded, "n", "chunk", ["mark", "doc_id"], F.col("part"), "before")
    placed = placed.withColumn("times", F.expr(
        f"cast((before + part + {COPY // 2}) div {COPY} - (before + {COPY // 2}) div {COPY} as int)"))
    key = F.struct("mark", "doc_id")
    lone = (placed.groupBy("n").agg(F.sum("times").alias("all"), F.first("target").alias("target"),
                                    F.min(F.struct(F.abs(F.col("size") - F.col("target")).alias("off"),
                                                   key.alias("key")))["key"].alias("key"))
            .filter("all = 0 AND target > 0").select(F.col("n").alias("__lone_n"), "key"))
    copies = (placed.join(lone, (F.col("n") == F.col("__lone_n")) & F.col("key").eqNullSafe(key), "left")
              .withColumn("__mix_n", F.when(F.col("__lone_n").isNotNull(), 1).otherwise(F.col("times")))
              .filter("__mix_n > 0")
              .select("__mix_n", F.col("doc_id").alias("__mix_id"), F.col("mark").alias("__mix_mark"),
                      F.col("source").alias("__mix_source")))
    return (docs.join(copies, (mark_of() == F.col("__mix_mark")) & docs["doc_id"].eqNullSafe(F.col("__mix_id"))
                      & docs["source"].cast("string").eqNullSafe(F.col("__mix_source")))
            .withColumn("__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
            .select(*docs.columns))
