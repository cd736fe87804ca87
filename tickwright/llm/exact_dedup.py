"""Exact deduplication by content hash, with the bytes compared inside groups.

Rows are grouped by a 128-bit hash of the normalised text. Only texts whose hash
occurs more than once are grouped by their bytes, so a collision of hashes cannot
join two different texts; unique texts are never shuffled. All of it is DataFrame
functions.

Defined results: a null text counts as empty; rows with equal doc_id and text are
one document and share an answer; a null doc_id is kept only when its group holds
no other id; an empty table gives an empty result; columns other than the id and
the text are ignored.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits
from .tables import written

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def content_hash(text):
    """128 bits of the text."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, hash_of=content_hash) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points before normalising stays,
    then the one with the smallest id.
    """
    text = normalised(F.col("text"))
    keyed = docs.select("doc_id", text.alias("norm"),
                        F.char_length(F.coalesce("text", F.lit(""))).alias("points"))
    keyed = keyed.withColumn("h", hash_of(F.col("norm"))).withColumn("x", F.xxhash64("h"))
    small = keyed.select("doc_id", "points", "h", F.sha2("norm", 256).alias("text_sha256"))

    repeated = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = bits.bit_rows(repeated.select(F.xxhash64("h").alias("x")), "x")
    suspects = bits.maybe_in(keyed, "x", seen)
    texts = suspects.groupBy("h", "norm").agg(F.min("doc_id").alias("variant"))
    collided = written(
        texts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"),
        "collided-hashes")

    split = (keyed.join(collided, "h", "left_semi")
             .join(texts.join(collided, "h", "left_semi"), ["h", "norm"])
             .select("doc_id", "points", "h", F.sha2("norm", 256).alias("text_sha256"), "variant"))
    rows = (small.join(collided, "h", "left_anti")
            .withColumn("variant", F.lit(None).cast(docs.schema["doc_id"].dataType))
            .unionByName(split))

    best = F.min(F.struct((-F.col("points")).alias("points"),
                          F.col("doc_id").isNull().alias("unnamed"), "doc_id"))
    groups = written(
        rows.groupBy("h", "variant").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))
        .filter("n > 1")
        .select(F.col("h").alias("gh"), F.col("variant").alias("gv"), "n",
                F.col("best.doc_id").alias("best_id")), "equal-texts")
    joined = rows.join(groups, (rows.h == groups.gh) & rows.variant.eqNullSafe(groups.gv), "left")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best_id"))
    return joined.select(
        "doc_id", keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")
