"""N-gram Jaccard join: grouped prefix join.

A document is its set of word shingles. Two sets of Jaccard similarity t or more
share a shingle among the first n - ceil(t n) + 1 of each, in any one order of all
shingles. The order here: frequent shingles come last, others by hash. A shingle is
frequent if it is in `often` of the sets whose hash falls on one in `sample`; which are
called so changes the work and no result.

So a set is a rare part R and a frequent part P, and similar sets meet in one of two ways:
 * They share a rare shingle. Then the first one is in both prefixes, where it has a
   short list. Documents with identical rare prefixes and size are one group; groups
   that share a prefix shingle are candidates, and members are verified on whole sets.
 * They share frequent shingles alone. Then their overlap is that of P and P', so that
   (P, size) decides: documents equal in both are one group, however many they are. Only
   sets with |P| of t n or more can take part, and a pair needs |P| and |P'| of
   t / (1 + t) of both sizes together. A crowd of copies with edits of their own loses
   its members of too small a P by that, before any pair is made.

Links are needed up to the components they make, so no all-pairs list is built:
 1. documents with the same set are one (the smallest id stands for them);
 2. each group is verified against the first of the list it shares most with, a star
    (for frequent parts the purest set of a list), and components are formed;
 3. of each list, only pairs from different components are left; they are filtered
    and verified. After that every candidate pair is linked, refuted, or within one
    component already.
The filters only leave out what cannot be similar: the sizes; the place of the shared
shingle, as some shared shingle is the first one and the rest must suffice; and the sum
of smaller counts by 256 ranges of the hash, which the overlap cannot exceed.

A shingle is a 64-bit hash; sets are compared by 128 bits and size. Bit sets, sized by
what they hold, decide which shingles leave a task; they leave out only what cannot meet.

Defined results: a null or empty text, or one without words, has no shingle and is
linked with nothing; a text shorter than a shingle is one shingle; a very long text is
one set of all its shingles; rows with one id are one node, whatever their texts; a row
without an id links nothing and takes the component of an equal set, if there is one;
an empty table gives an empty result; other columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bits, words
from .components import components
from .tables import written
from .tasks import flat_map

SHINGLE = 5
PERCENT = 80
SAMPLE, OFTEN = 16, 8    # a shingle in OFTEN of the sets of one hash in SAMPLE comes last in the order


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def shingle_sets(texts, k: int):
    """Yield (number of the text, sorted distinct shingle hashes)."""
    for piece in words.pieces(texts, words.NON_BLANK):
        hashes = piece.hashes()
        grams = words.grams(hashes, k)
        for i in range(piece.n):
            lo, hi = int(piece.bounds[i]), int(piece.bounds[i + 1])
            if hi - lo >= k:
                yield piece.first + i, np.unique(grams[lo:hi - k + 1])
            elif hi > lo:
                yield piece.first + i, words.grams(hashes[lo:hi], hi - lo)
            else:
                yield piece.first + i, grams[:0]


def parts(shingles: np.ndarray, frequent: np.ndarray, percent: int):
    """(rare prefix, all frequent shingles, those of them that a partner of frequent ones alone must share)."""
    late = bits.has(frequent, shingles)
    common = shingles[late]
    rare = shingles[~late][:prefix_length(shingles.size, percent)]
    needed = -(-percent * shingles.size // 100)
    return rare, common, common[:max(0, common.size - needed + 1)]


def set_key(shingles: np.ndarray):
    """Two 64-bit sums over a set."""
    one = words.mixed(shingles * words.BASE + np.uint64(1))
    two = words.mixed(shingles ^ words.BASE)
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def histogram(shingles: np.ndarray):
    """Shingles by range of the hash, as 8-bit counts; None if one is too large."""
    counts = np.bincount((shingles >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 1 << 8 else None


def _longs(parts: list):
    return [p.view(np.int64) for p in parts]


class Join:
    """One run of the join over docs (doc_id, text)."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT,
                 sample: int = SAMPLE, often: int = OFTEN):
        self.docs, self.k, self.percent = docs.select("doc_id", "text"), k, percent
        self.sample, self.often = sample, often
        self.context = docs.sparkSession.sparkContext

    def sent(self, hashes: DataFrame, column: str):
        """A written table's column as a bit set for tasks."""
        words_ = bits.fitting(hashes.count())
        return self.context.broadcast(bits.to_array(bits.bit_rows(hashes, column, words_), words_))

    def frequent_shingles(self):
        """The bit set of the shingles that come last."""
        k, sample = self.k, self.sample

        def chosen(texts):
            index, out = [], []
            for i, s in shingle_sets(texts, k):
                if s.size and set_key(s)[0] % sample == 0:
                    index.append(i)
                    out.append(s)
            yield index, [_longs(out)]

        counted = (flat_map(self.docs, ["text"], [], "shingles array<long>", chosen)
                   .select(F.explode("shingles").alias("shingle")).groupBy("shingle")
                   .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= self.often).select("shingle"))
        return self.sent(written(counted, "frequent-shingles"), "shingle")

    def index(self, late) -> DataFrame:
        """Every row: doc_id, n, keys of the set, of its frequent part, prefixes of both parts, histogram."""
        k, percent = self.k, self.percent

        def rows(texts):
            index, out = [], [[] for _ in range(10)]
            for i, s in shingle_sets(texts, k):
                rare, common, shared = parts(s, late.value, percent)
                index.append(i)
                made = (int(s.size), *set_key(s), set_key(rare)[0], rare.view(np.int64), int(common.size),
                        *set_key(common), shared.view(np.int64), histogram(s) if s.size else None)
                for column, value in zip(out, made):
                    column.append(value)
            yield index, out

        return written(flat_map(
            self.docs, ["text"], ["doc_id"], "n long, key_1 long, key_2 long, rare_key long, rare array<long>, "
            "p long, p_1 long, p_2 long, common array<long>, histogram binary", rows), "jaccard-index")

    def verified(self, pairs: DataFrame, late) -> DataFrame:
        """The pairs (a, b, alone) of documents similar enough, on frequent shingles alone where alone is set."""
        k, percent = self.k, self.percent
        pairs = written(pairs, "jaccard-pairs")
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = self.sent(written(ids.select(F.xxhash64("id").alias("h")), "jaccard-wanted"), "h")

        def sets(texts, hashes):
            at = np.flatnonzero(bits.has(wanted.value, np.array(hashes, dtype=np.int64)))
            index, held, size = [], [], 0
            for i, s in shingle_sets([texts[j] for j in at], k):
                index.append(int(at[i]))
                held.append(s.tobytes())
                size += len(held[-1])
                if size > 1 << 22:
                    yield index, [held]
                    index, held, size = [], [], 0
            yield index, [held]

        held = flat_map(self.docs.withColumn("h", F.xxhash64("doc_id")), ["text", "h"], ["doc_id"],
                        "shingles binary", sets)
        both = (pairs.join(held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s")), "a")
                .join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t")), "b"))

        def similar(ones, others, alone):
            out = []
            for i, (x, y, frequent_only) in enumerate(zip(ones, others, alone)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared = np.intersect1d(x, y, assume_unique=True)
                n = int(bits.has(late.value, shared).sum()) if frequent_only else shared.size
                if 100 * n >= percent * (x.size + y.size - n):
                    out.append(i)
            yield out, []

        return written(flat_map(both, ["s", "t", "alone"], ["a", "b", "alone"], "", similar).distinct(), "jaccard-links")

    def near(self, n: str, m: str):
        """Sizes that can be similar."""
        return ((F.col(n) * 100 >= F.col(m) * self.percent) & (F.col(m) * 100 >= F.col(n) * self.percent))

    def enough(self, left, n, m):
        """Whether `left` shared shingles can make sets of n and m similar."""
        return left * (100 + self.percent) >= (n + m) * self.percent

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(members, links): doc_id, n, component of every row; verified links (a, b) between documents."""
        late = self.frequent_shingles()
        index = self.index(late)
        real = index.filter("n > 0 AND doc_id IS NOT NULL")
        same = written(real.groupBy("n", "key_1", "key_2").agg(F.min("doc_id").alias("one")), "equal-sets")
        ones = same.select(F.col("one").alias("doc_id"), "n", "key_1", "key_2")
        reps = written(
            real.join(ones, ["doc_id", "n", "key_1", "key_2"], "left_semi")
            .dropDuplicates(["doc_id", "n", "key_1", "key_2"]).drop("key_1", "key_2"), "jaccard-sets")
        rare, common = Rare(self, reps), Common(self, reps)
        stars = self.verified(rare.star().withColumn("alone", F.lit(False)).unionByName(
            common.star().withColumn("alone", F.lit(True))), late)
        pairs = rare.across(components(stars.select("a", "b"))).withColumn("alone", F.lit(False)).unionByName(
            common.across(components(stars.filter("alone").select("a", "b"))).withColumn("alone", F.lit(True)))
        rest = self.verified(self.roomy(pairs, reps), late)
        every = stars.union(rest)
        links = written(every.filter("NOT alone").select("a", "b")
                        .union(common.expanded(every.filter("alone"))).distinct(), "jaccard-all-links")
        final = components(links)
        joined = (same.join(final.select(F.col("node").alias("one"), "component"), "one", "left")
                  .select(F.col("n").alias("_n"), F.col("key_1").alias("_1"), F.col("key_2").alias("_2"),
                          F.coalesce("component", "one").alias("component")))
        joined = written(joined, "jaccard-components")
        out = index.join(joined, (F.col("n") == F.col("_n")) & (F.col("key_1") == F.col("_1"))
                         & (F.col("key_2") == F.col("_2")), "left")
        return out.select("doc_id", F.col("n"), F.coalesce("component", "doc_id").alias("component")), links

    def roomy(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """The pairs whose histograms leave room for the overlap."""
        percent = self.percent
        held = reps.select("doc_id", "n", "histogram")
        both = (pairs.join(held.select(F.col("doc_id").alias("a"), "n", F.col("histogram").alias("s")), "a")
                .join(held.select(F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("histogram").alias("t")), "b"))

        def room(n, m, ones, others):
            out = []
            for i, (x, y) in enumerate(zip(ones, others)):
                most = min(n[i], m[i]) if x is None or y is None else int(np.minimum(
                    np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)).sum(dtype=np.int64))
                if most * (100 + percent) >= (n[i] + m[i]) * percent:
                    out.append(i)
            yield out, []

        return flat_map(both, ["n", "m", "s", "t"], ["a", "b", "alone"], "", room).distinct()


def placed(rows: DataFrame, column: str, kept: list, shared=None) -> DataFrame:
    """A row for each shingle of a prefix that `shared`, a bit set, may hold: kept, shingle, place."""

    def some(prefixes):
        index, out, places = [], [], []
        for i, prefix in enumerate(prefixes):
            prefix = np.array(prefix, dtype=np.int64)
            at = np.flatnonzero(bits.has(shared.value, prefix)) if shared else np.arange(prefix.size)
            if at.size:
                index.append(i)
                out.append(prefix[at])
                places.append(at.astype(np.int32))
        yield index, [out, places]

    return (flat_map(rows, [column], kept, "__s array<long>, __p array<int>", some)
            .select(*kept, F.explode(F.arrays_zip("__s", "__p")).alias("__e"))
            .select(*kept, F.col("__e.__s").alias("shingle"), F.col("__e.__p").alias("place")))


class Rare:
    """Sets that share a rare shingle: groups of one rare prefix and size, and the lists of its shingles."""

    def __init__(self, join: Join, reps: DataFrame):
        self.join = join
        group = F.xxhash64("n", "rare_key")
        rows = reps.filter(F.size("rare") > 0)
        self.leaders = written(rows.groupBy(group.alias("grp")).agg(
            F.min("doc_id").alias("leader"), F.count(F.lit(1)).alias("members")), "jaccard-leaders")
        self.members = written(rows.select(group.alias("grp"), "doc_id", "n").join(self.leaders, "grp"), "jaccard-groups")
        heads = rows.select(group.alias("grp"), "doc_id", "n", "rare").join(
            self.leaders.select(F.col("leader").alias("doc_id")), "doc_id", "left_semi")
        repeated = written(heads.select(F.explode("rare").alias("shingle")).groupBy("shingle")
                           .agg(F.count(F.lit(1)).alias("length")).filter("length > 1").select("shingle"), "jaccard-lists")
        self.entries = written(placed(heads, "rare", ["grp", "doc_id", "n"], join.sent(repeated, "shingle")), "jaccard-entries")

    def star(self) -> DataFrame:
        """(a, b): the first of the list, of those of near size, that shares most with b; and its leader."""
        lists = self.entries.groupBy("shingle").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count(F.lit(1)).alias("k"))
        near = (self.entries.join(lists.filter("k > 1").select("shingle", "first.doc_id", F.col("first.n").alias("m"))
                                  .withColumnRenamed("doc_id", "first"), "shingle")
                .filter((F.col("doc_id") != F.col("first")) & self.join.near("n", "m")))
        best = (near.groupBy("doc_id", "first").agg(F.count(F.lit(1)).alias("shared"))
                .groupBy("doc_id").agg(F.max(F.struct("shared", "first")).alias("best"))
                .select(F.col("best.first").alias("a"), F.col("doc_id").alias("b")))
        return best.union(self.members.filter("doc_id != leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")))

    def across(self, known: DataFrame) -> DataFrame:
        """Pairs (a, b) of documents in different components that sizes and places do not rule out."""
        join = self.join
        named = written(self.members.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
                        .select("grp", F.col("doc_id").alias("doc"), F.coalesce("component", "doc_id").alias("c")),
                        "jaccard-labelled")
        kinds = written(named.groupBy("grp").agg(F.min("c").alias("c_1"), F.max("c").alias("c_2")), "jaccard-kinds")
        one = self.entries.select("grp", "n", "shingle", "place").join(kinds, "grp")
        # a list of one component has nothing left to compare
        mixed = (one.groupBy("shingle").agg(F.min("c_1").alias("low"), F.max("c_2").alias("high"))
                 .filter("low < high").select("shingle"))
        one = written(one.join(mixed, "shingle", "left_semi"), "jaccard-open-lists")
        two = one.select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("grp", "n", "place", "c_1", "c_2")])
        n, m = F.col("n"), F.col("n_b")
        met = (one.join(two, "shingle")
               .filter((F.col("grp") < F.col("grp_b")) & join.near("n", "n_b")
                       & ((F.col("c_1") < F.col("c_2")) | (F.col("c_1_b") < F.col("c_2_b")) | (F.col("c_1") != F.col("c_1_b")))
                       & join.enough(n - F.col("place"), n, m) & join.enough(m - F.col("place_b"), n, m))
               .select("grp", "grp_b").distinct())
        inside = kinds.filter("c_1 < c_2").select("grp", F.col("grp").alias("grp_b"))
        other = named.select(F.col("grp").alias("grp_b"), F.col("doc").alias("doc_b"), F.col("c").alias("c_b"))
        pairs = (met.union(inside).join(named, "grp").join(other, "grp_b")
                 .filter((F.col("c") != F.col("c_b")) & ((F.col("grp") != F.col("grp_b")) | (F.col("doc") < F.col("doc_b")))))
        return pairs.select(F.least("doc", "doc_b").alias("a"), F.greatest("doc", "doc_b").alias("b")).distinct()


class Common:
    """Sets that share frequent shingles alone: groups of one frequent part and size, each decided once."""

    def __init__(self, join: Join, reps: DataFrame):
        self.join = join
        key = F.xxhash64("n", "p", "p_1", "p_2")
        rows = reps.filter(F.size("common") > 0)
        self.groups = written(rows.groupBy(key.alias("grp")).agg(F.min("doc_id").alias("g")), "common-groups")
        self.members = written(rows.select(key.alias("grp"), "doc_id", "n", "p").join(self.groups, "grp"), "common-members")
        heads = rows.join(self.groups.select(F.col("g").alias("doc_id")), "doc_id", "left_semi")
        self.entries = written(placed(heads.withColumnRenamed("doc_id", "g"), "common", ["g", "n", "p"]), "common-entries")

    def star(self) -> DataFrame:
        """(a, b): the purest set of a list that b shares most with."""
        pure = F.struct((F.col("p") / F.col("n")).alias("share"), "p", "n", "g")
        centres = (self.entries.groupBy("shingle").agg(F.max(pure).alias("x"), F.count(F.lit(1)).alias("k")).filter("k > 1")
                   .select("shingle", F.col("x.g").alias("a"), F.col("x.n").alias("m"), F.col("x.p").alias("q")))
        near = (self.entries.join(centres, "shingle").filter(F.col("g") != F.col("a"))
                .filter(self.join.enough(F.least("p", "q"), F.col("n"), F.col("m"))))
        return (near.groupBy("g", "a").agg(F.count(F.lit(1)).alias("shared"))
                .groupBy("g").agg(F.max(F.struct("shared", "a")).alias("best"))
                .select(F.col("best.a").alias("a"), F.col("g").alias("b")))

    def across(self, known: DataFrame) -> DataFrame:
        """Pairs (a, b) of groups in different components whose frequent parts leave room."""
        join = self.join
        label = known.select(F.col("node").alias("g"), "component")
        rows = (self.entries.join(label, "g", "left").withColumn("c", F.coalesce("component", "g")).drop("component"))
        least = self.entries.groupBy("shingle").agg(F.min("n").alias("least"))
        # a part too small for the smallest set of its list meets nobody there
        open_ = written(rows.join(least, "shingle").filter(join.enough(F.col("p"), F.col("n"), F.col("least"))), "common-open")
        sizes = open_.groupBy("shingle", F.col("n").alias("m")).agg(
            F.min("c").alias("c_1"), F.max("c").alias("c_2"), F.max("p").alias("most"))
        n, m = F.col("n"), F.col("m")
        with_size = (open_.join(sizes, "shingle")
                     .filter((m <= n) & (m * 100 >= n * join.percent) & join.enough(F.least("p", "most"), n, m)
                             & ((F.col("c_1") < F.col("c_2")) | (F.col("c_1") != F.col("c"))))
                     .select("shingle", "g", "n", "p", "place", "c", "m"))
        other = open_.select("shingle", F.col("n").alias("m"), F.col("g").alias("g_b"), F.col("p").alias("q"),
                             F.col("place").alias("place_b"), F.col("c").alias("c_b"))
        pairs = (with_size.join(other, ["shingle", "m"])
                 .filter((F.col("c") != F.col("c_b")) & ((n > m) | (F.col("g") < F.col("g_b")))
                         & join.enough(F.col("p") - F.col("place"), n, m) & join.enough(F.col("q") - F.col("place_b"), n, m)))
        return pairs.select(F.least("g", "g_b").alias("a"), F.greatest("g", "g_b").alias("b")).distinct()

    def expanded(self, links: DataFrame) -> DataFrame:
        """Links (a, b) of documents: those of groups, and of each member with one group that its own is linked with."""
        pairs = links.select("a", "b")
        partner = (pairs.union(pairs.select("b", "a")).toDF("g", "partner").groupBy("g").agg(F.min("partner").alias("partner")))
        alike = self.join.enough(F.col("p"), F.col("n"), F.col("n"))
        member = (self.members.join(partner, "g", "left")
                  .withColumn("partner", F.when(alike, F.col("g")).otherwise(F.col("partner")))
                  .filter(F.col("partner").isNotNull() & (F.col("partner") != F.col("doc_id"))))
        return pairs.union(member.select(F.col("partner").alias("a"), F.col("doc_id").alias("b")))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable by links)."""
    members, _ = Join(docs, **options).run()
    return members.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
