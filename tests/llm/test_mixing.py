import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.llm import mixing
from tickwright.llm.queries import ORACLE_SQL, QUERIES

from .cases import ODD, crowded, documents, prose, words
from .run_queries import differences, views


def test_targets():
    assert mixing.targets([100, 100, 100]) == [pytest.approx(187.5), pytest.approx(75), pytest.approx(37.5)]
    assert mixing.targets([10, 100, 100]) == [30, pytest.approx(120), pytest.approx(60)]
    assert mixing.targets([0, 50]) == [0, 50]
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0, 0]


def test_schedule_is_even_everywhere(spark):
    rows = [(0, "a", 64_000, 80_000.0), (1, "b", 64_000, 32_000.0), (2, "c", 64_000, 16_000.0)]
    got = mixing.schedule(spark, rows).orderBy("slot").toPandas()
    assert len(got) == 1000
    for n, share in ((0, 0.625), (1, 0.25), (2, 0.125)):
        seen = np.cumsum(got["n"].to_numpy() == n)
        assert np.abs(seen - share * np.arange(1, 1001)).max() < 4
    assert got.groupby("n")["rank"].apply(lambda r: list(r) == list(range(len(r)))).all()


def plain(docs, block=mixing.BLOCK_WORDS):
    """{doc_id: taken} by walking the schedule."""
    import hashlib
    sources = sorted({s for *_, s in docs}, key=lambda s: (s is None, s or ""))
    sized = {i: (len(words(t)), s) for i, t, s in docs}
    total = {s: sum(n for n, x in sized.values() if x == s) for s in sources}
    goal = mixing.targets([total[s] for s in sources])
    bounds = np.cumsum(goal) / max(sum(goal), 1.0)
    bounds[np.flatnonzero(np.array(goal) > 0)[-1]:] = 2
    times = {}
    ranks = dict.fromkeys(range(len(sources)), 0)
    for slot in range(-(-int(round(sum(goal))) // block)):
        n = int(np.searchsorted(bounds, slot % 2**31 * mixing.STEP % 2**31 / 2**31, side="right"))
        blocks = -(-total[sources[n]] // block)
        if ranks[n] < 3 * blocks:
            times[n, ranks[n] % blocks] = times.get((n, ranks[n] % blocks), 0) + 1
        ranks[n] += 1
    out = {}
    for n, s in enumerate(sources):
        at = 0
        for i in sorted((i for i, _, x in docs if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            size = sized[i][0]
            out[i] = sum(times.get((n, w // block), 0) for w in range(at, at + size))
            at += size
    return out


def test_taken_against_a_walk(spark):
    texts = [prose(i, 30 + 37 * i % 900) for i in range(60)] + ODD
    sources = [("big" if i % 3 else "b\u00e9" if i % 2 else None) for i in range(len(texts))]
    docs = crowded(documents(spark, texts, sources))
    got = mixing.mix(docs).collect()
    assert {r.doc_id: r.taken for r in got} == plain(list(zip(range(len(texts)), texts, sources)))
    assert all(r.taken <= 3 * r.size for r in got)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, ["a b c", "", "d e"])
    both = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted((r.doc_id or 0, r.size) for r in mixing.mix(both).collect()) == [
        (0, 3), (0, 3), (1, 0), (1, 0), (2, 2), (2, 2)]
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


def test_documents_of_the_mix(spark):
    texts = [prose(i, 400) for i in range(40)]
    sources = ["a"] * 20 + ["b"] * 20
    docs = documents(spark, texts, sources)
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    counts = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert counts["a"] / counts["b"] == pytest.approx(2.5, rel=0.15)


def test_sources_of_few_long_documents_keep_their_words(spark):
    texts = [prose(0, 60_000), prose(1, 60_000), *[prose(2 + i, 600) for i in range(100)],
             *[prose(200 + i, 300 + 10 * i) for i in range(120)]]
    sources = ["a", "c", *["b"] * 100, *["d"] * 120]
    docs = documents(spark, texts, sources).persist()
    size = {i: len(t.split()) for i, t in enumerate(texts)}
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = [(r.source, size[r.doc_id]) for r in mixing.mixed_documents(docs).collect()]
    assert target["c"] < 30_000
    for source in "abcd":
        taken = sum(n for s, n in got if s == source)
        longest = max(size[i] for i, s in enumerate(sources) if s == source)
        assert taken > 0 and abs(taken - target[source]) <= longest + 128, source


def test_rows_without_ids_and_shared_ids_are_mixed(spark):
    texts = [prose(i, 500) for i in range(40)]
    docs = documents(spark, texts, ["a"] * 20 + ["b"] * 20).withColumn(
        "doc_id", F.when(F.col("doc_id") < 20, F.lit(7)).cast("long"))
    words = {r.source: r.target for r in mixing.mix(docs).collect()}
    got = {r.source: 500 * r["count"] for r in mixing.mixed_documents(docs).groupBy("source").count().collect()}
    assert abs(got["b"] - words["b"]) <= 500 + 128
    assert got["a"] % (20 * 500) == 0 and got["a"] > 0


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "source").collect()]
    frame = QUERIES["op6_source_mixing"](spark, path)
    assert {r.doc_id: r.taken for r in frame.collect()} == plain(rows)
    found, problem = differences(frame, views(path), ORACLE_SQL["op6_source_mixing"])
    assert found and problem is None
