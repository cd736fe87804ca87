import hashlib

import numpy as np
from pyspark.sql import functions as F

from tickwright.llm import winnowing
from tickwright.llm.queries import QUERIES

from .cases import ODD, contamination, crowded, documents, prose

ITEMS = "item_id long, text string"


def answers(docs, items):
    judged, runs = winnowing.decontaminate(docs, items)
    return {r.doc_id: (r.n_words, r.n_hit, set(r.item_ids or ())) for r in judged.collect()}, runs


def test_smallest_keeps_one_of_every_window():
    values = np.array([5, 1, 1, 7, 2, 9, 9, 9, 0], dtype=np.uint64)
    assert winnowing.smallest(values, 3).tolist() == [2, 4, 7, 8]
    assert winnowing.smallest(values, 1).tolist() == list(range(9))
    assert winnowing.smallest(values[:2], 3).size == 0


def test_spans_of_every_kind(spark):
    items = [(i, prose(i, n)) for i, n in enumerate([0, 1, 2, 5, 6, 12, 13, 14, 40, 80])]
    items += [(50, None), (51, "..."), (52, "same same " * 10), (8, prose(88, 20)), (60, items[8][1])]
    long, dull = items[8][1].split(), "same " * 30
    texts = [*ODD, dull, items[1][1].upper(), items[5][1], " ".join(items[5][1].split()[:11]),
             f"{prose(70, 50)} {' '.join(long[10:23])} {prose(71, 50)}",
             f"{prose(72, 50)} {' '.join(long[10:22])} {prose(73, 50)}",
             f"{' '.join(long[:20])}, {' '.join(long[8:30])}! {prose(74, 900)}", items[9][1] * 3]
    got, _ = answers(crowded(documents(spark, texts)), crowded(spark.createDataFrame(items, ITEMS)))
    assert got == contamination(list(enumerate(texts)), items)


def test_threshold_repeats_and_empty(spark):
    item = prose(1, 13)
    items = spark.createDataFrame([(1, item), (1, item)], ITEMS)
    docs = documents(spark, [f"{prose(2, 247, 9999)} {item}", f"{prose(3, 248, 9999)} {item}", item])
    judged, runs = winnowing.decontaminate(docs.union(docs), items)
    rows = judged.collect()
    assert sorted((r.doc_id, r.n_hit, r.contaminated) for r in rows) == sorted(
        [(0, 13, True), (1, 13, False), (2, 13, True)] * 2)
    assert runs.count() == 6
    nothing, _ = winnowing.decontaminate(docs, items.limit(0))
    assert {(r.n_hit, r.contaminated) for r in nothing.collect()} == {(0, False)}
    assert winnowing.decontaminate(docs.limit(0), items)[0].count() == 0
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.n_hit for r in winnowing.decontaminate(unnamed, items)[0].collect()) == [13, 13, 13]


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{path}/{t}.parquet").select(k, "text").collect()]
                   for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = {}
    for i, (n, hit, found) in contamination(docs, items).items():
        ids = ",".join(sorted(map(str, found)))
        want[i] = (n, hit, len(found), hashlib.sha256(ids.encode()).hexdigest(), hit > 0 and 20 * hit >= n)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in QUERIES["op10_decontamination"](spark, path).collect()}
    assert got == want and any(v[4] for v in want.values())


def test_query_against_sql(spark):
    from tickwright.llm.queries import ORACLE_SQL

    from .run_queries import differences, views
    path = "/root/testdata/sf0.001"
    rows, problem = differences(QUERIES["op10_decontamination"](spark, path), views(path), ORACLE_SQL["op10_decontamination"])
    assert rows and problem is None
