"""URL rules by a Bloom filter cascade.

A rule is a host and a path prefix. A page's candidate keys are the suffixes of
its host with the prefixes of its path, in the shapes that the rules have. Over
the corpus's complete universe of candidate keys a cascade is built for the block
rules and one for the allow rules: level 1 encodes the listed keys, level 2 the
other keys of the universe that pass level 1, level 3 the listed keys that pass
level 2, and so on until nothing passes wrongly. For keys of that universe the
answer is exact, and a page is judged by bit tests alone, without a join. All of
it is DataFrame functions.

Defined results: a null url, or one without "://", has an empty host and path and
meets no rule; no rule means that neither cascade holds a key of the page, and
the verdict is then allow; a rule with
both actions blocks; repeated pages are judged alike; an empty table gives
an empty result. The bit arrays of a level hold at most MAX_BITS bits, more is an
error; they grow with the rules (and with log2 of the universe for each rule).
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bits
from .tables import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BITS = 1 << 28
MAX_SHAPES = 256


def url_host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: DataFrame      # one row, an array of bits / 64 longs

    def passes(self, key: Column, words: Column) -> Column:
        tests = [F.get(words, bits.word_of(p).cast("int")).bitwiseAND(bits.bit_of(p)) != 0
                 for p in positions(key, self.bits, self.hashes, self.seed)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def positions(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed * 64 + i), key).bitwiseAND(F.lit(size - 1)) for i in range(hashes)]


def level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """The bits of n keys (column key) at a rate of false positives of at most 1/2."""
    need = max(64.0, n * -math.log(rate) / math.log(2) ** 2)
    size = 1 << math.ceil(math.log2(need))
    if size > MAX_BITS:
        raise ValueError(f"a level of {size} bits is over the limit of {MAX_BITS}")
    hashes = max(1, min(16, round(size / n * math.log(2))))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), size, hashes, seed))).alias("at"))
    found = bits.bit_rows(at, "at", size // 64)
    filled = (keys.sparkSession.range(size // 64).withColumnRenamed("id", "place")
              .join(found, F.col("place") == F.col("word"), "left")
              .agg(F.array_sort(F.collect_list(F.struct(
                  "place", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("rows"))
              .select(F.col("rows.bits").alias("words")))
    return Level(size, hashes, seed, written(filled, "cascade-level"))


class Cascade:
    """Exact membership in the listed keys, for keys of the universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> "Cascade":
        """listed and universe: distinct keys (column key); other listed keys never pass wrongly."""
        levels: list[Level] = []
        inside = written(universe.join(listed, "key", "left_semi"), "cascade-in")
        outside = written(universe.join(listed, "key", "left_anti"), "cascade-out")
        n, others = inside.count(), outside.count()
        while n:
            rate = 0.5 if levels else min(0.5, max(n, 1) / (math.sqrt(2) * max(others, 1)))
            made = level(inside, n, rate, len(levels) + 1)
            levels.append(made)
            wrong = written(outside.filter(made.passes(F.col("key"), made.words.scalar())),
                                  "cascade-wrong")
            inside, outside, n = wrong, inside, wrong.count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(False)
        for i in range(len(self.levels) - 1, -1, -1):
            made = self.levels[i]
            out = made.passes(key, made.words.scalar()) & ~out
        return out


def candidates(host: Column, path: Column, shapes: list) -> list[Column]:
    """The keys host suffix + path prefix for shapes (labels, path length), null where there is none."""
    labels = F.split(host, r"\.")
    out = []
    for n, length in shapes:
        suffix = F.array_join(F.slice(labels, -n, n), ".")
        fits = (host != "") & (F.size(labels) >= n) & (F.char_length(path) >= length)
        out.append(F.when(fits, F.concat(suffix, F.substring(path, 1, length))))
    return out


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict. rules: (host, path, action allow or block)."""
    named = written(rules.select(
        F.concat("host", "path").alias("key"), "action",
        F.size(F.split("host", r"\.")).alias("labels"), F.char_length("path").alias("length")).distinct(),
        "url-rules")
    shapes = [(r.labels, r.length) for r in
              named.select("labels", "length").distinct().take(MAX_SHAPES + 1)]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"the rules have more than {MAX_SHAPES} shapes")
    shapes.sort(key=lambda s: (-s[0], -s[1]))
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"),
                          url_path(F.col("url")).alias("path"))
    keys = candidates(F.col("host"), F.col("path"), shapes)
    universe = written(
        parsed.select(F.explode(F.array_distinct(F.array(*keys))).alias("key")).filter("key IS NOT NULL").distinct()
        if keys else parsed.select(F.lit("").alias("key")).limit(0), "url-keys")
    block = Cascade.build(named.filter("action = 'block'").select("key").distinct(), universe)
    allow = Cascade.build(named.filter("action = 'allow'").select("key").distinct(), universe)

    parsed = parsed.select("*", *[k.alias(f"key{i}") for i, k in enumerate(keys)])
    hits = [F.when(cascade.holds(F.col(f"key{i}")),
                   F.struct(F.char_length(f"key{i}"), F.lit(action).alias("action"), F.col(f"key{i}").alias("key")))
            for i in range(len(keys)) for cascade, action in ((block, "block"), (allow, "allow"))]
    best = F.greatest(*hits) if hits else F.lit(None).cast("struct<n:int,action:string,key:string>")
    return parsed.withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.key").alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"))
