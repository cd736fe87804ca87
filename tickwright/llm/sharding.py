"""Jump consistent hashing: a key and a number of shards give the shard.

The key seeds a linear congruential generator whose draws name the shard counts
at which the key moves; its shard is the last such move below the count. One more
shard therefore takes rows only into itself, and no table of shards exists. All
of it is DataFrame functions.

Defined results: a null or empty text has the checksum 0; a null doc_id is keyed
by the checksum of its text; rows with equal doc_id share a shard and have
different slots; an empty table gives an empty result; new columns replace those of
the same name. The law is `key`, so
copies of a text with different ids may be in different shards.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_total

MULTIPLIER = "2862933555777941757"
CHUNKS = 4096   # per shard; chunks grow with the rows, a shard's number of chunks stays small
MOST_CHUNKS = 1 << 20    # of all shards, up to which their totals are sent to tasks (32 bytes each)


def jump_path(key: Column, shards: int) -> Column:
    """struct(at, next): the shard of an integer key, and its next move (>= shards).

    The moves rise strictly from 0, so at most `shards` draws reach past the last
    shard; draws after that change nothing.
    """
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")
    seed = F.pmod(key.cast("decimal(38,0)"), two64).cast("decimal(20,0)")
    start = F.struct(seed.alias("seed"), F.lit(0).cast("long").alias("at"),
                     F.lit(0).cast("long").alias("next"))

    def whole(x, y):
        """x div y; taking the remainder off first keeps the division exact."""
        return ((x - x % y) / y).cast("long")

    def draw(s, _):
        seed = F.pmod((s["seed"] * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast("decimal(38,0)")
                      + F.lit(1), two64).cast("decimal(20,0)")
        top = whole(seed, F.lit(1 << 33).cast("decimal(10,0)"))
        moved = whole((s["next"] + 1) * F.lit(1 << 31), top + 1)
        return F.when(s["next"] >= shards, s).otherwise(
            F.struct(seed.alias("seed"), s["next"].alias("at"), moved.alias("next")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, draw,
                       lambda s: F.struct(s["at"], s["next"]))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Per row: the columns of docs and size, text_crc32, shard, slot, grown_shard.

    slot numbers the rows of a shard from 0 without a gap; grown_shard is the shard
    when there is one more.
    """
    out = (docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16)
           .withColumn("text_crc32", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0).cast("long")))
           .withColumn("__shard_key", F.coalesce(F.col("doc_id").cast("long"), F.col("text_crc32")))
           .withColumn("__shard_path", jump_path(F.col("__shard_key"), shards))
           .withColumn("shard", F.col("__shard_path.at").cast("int"))
           .withColumn("grown_shard", F.when(F.col("__shard_path.next") <= shards, F.col("__shard_path.next"))
                       .otherwise(F.col("__shard_path.at")).cast("int")).drop("__shard_path")
           .withColumn("__shard_chunk", F.pmod(F.xxhash64("__shard_key", "text_crc32"), F.lit(CHUNKS))))
    numbered = running_total(out, "shard", "__shard_chunk", ["__shard_key", "text_crc32", "size"],
                             F.lit(1).cast("long"), "slot", few_chunks=shards * CHUNKS <= MOST_CHUNKS)
    return numbered.drop("__shard_key", "__shard_chunk")


def write_shards(sharded: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard; a shard's rows are split over files_per_shard tasks."""
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    (sharded.repartition("shard", part).write.partitionBy("shard").parquet(path))
