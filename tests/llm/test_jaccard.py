import random

from pyspark.sql import functions as F

from tickwright.llm import jaccard
from tickwright.llm.queries import QUERIES

from .cases import ODD, crowded, documents, jaccard_components, prose


def answers(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, **options).collect()}


def edited(text, seed, edits):
    pick = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[pick.randrange(len(w))] = f"e{pick.randrange(10**6)}"
    return " ".join(w)


def test_odd_texts(spark):
    texts = [*ODD, "A b", "a  B", "a b c d e", "a b c d e a b c d e", "b c d e f", "a b c d"]
    assert answers(crowded(documents(spark, texts))) == jaccard_components(list(enumerate(texts)))


def test_chains_copies_and_a_common_passage(spark):
    base, common = prose(1, 200, 5000), prose(2, 60, 5000)
    texts = [base] * 7
    for i in range(60):                       # copies with edits: some linked to each other only through others
        texts.append(edited(base, i, i % 9))
    chain = base
    for i in range(12):
        chain = edited(chain, 1000 + i, 4)
        texts.append(chain)
    for i in range(90):                       # a passage in many documents that are otherwise different
        texts.append(f"{prose(100 + i, 150, 5000)} {common}")
    for i in range(20):                       # one prefix and size, other words behind
        texts.append(f"{prose(3, 100, 5000)} {prose(300 + i, 4, 5000)}")
    random.Random(5).shuffle(texts)
    want = jaccard_components(list(enumerate(texts)))
    assert answers(documents(spark, texts)) == want
    assert answers(documents(spark, texts), sample=1, often=3) == want
    assert answers(documents(spark, texts), sample=1, often=1) == want
    assert len({c for _, c in want.values()}) < len(texts) - 60


def test_links_are_verified(spark):
    base = prose(8, 120, 5000)
    texts = [base, edited(base, 1, 2), prose(9, 120, 5000)]
    _, links = jaccard.Join(documents(spark, texts)).run()
    assert [tuple(sorted(r)) for r in links.collect()] == [(0, 1)]


def test_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "x"])
    assert answers(docs.union(docs)) == {0: (2, 0), 1: (2, 0), 2: (1, 2)}
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert answers(unnamed) == {None: (2, 1), 1: (2, 1), 2: (1, 2)}
    assert answers(documents(spark, [])) == {}
    assert answers(documents(spark, [None, ""])) == {0: (0, 0), 1: (0, 1)}


def test_query(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_jaccard_join"](spark, path).collect()}
    assert got == jaccard_components(rows)


def test_query_against_sql(spark):
    from tickwright.llm.queries import ORACLE_SQL

    from .run_queries import differences, views
    path = "/root/testdata/sf0.001"
    rows, problem = differences(QUERIES["op7_jaccard_join"](spark, path), views(path), ORACLE_SQL["op7_jaccard_join"])
    assert rows and problem is None
