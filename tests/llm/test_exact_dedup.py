from pyspark.sql import functions as F

from tickwright.llm import exact_dedup
from tickwright.llm.queries import ORACLE_SQL, QUERIES

from .cases import ODD, crowded, documents
from .run_queries import differences, views

SF = "/root/testdata/sf0.001"


def answers(docs, **options):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept)
            for r in exact_dedup.exact_groups(docs, **options).collect()}


def expected(texts):
    def norm(t):
        return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(norm(t), []).append((-len(t or ""), i))
    out = {}
    for members in groups.values():
        for _, i in members:
            out[i] = (min(members)[1], len(members), i == min(members)[1])
    return out


TEXTS = [*ODD, "a b c", "abc", " a b c", "ab c", "abd", "word ", "\xa0word", "Word"]


def test_groups(spark):
    assert answers(crowded(documents(spark, TEXTS))) == expected(TEXTS)


def test_bytes_part_texts_of_one_hash(spark):
    def weak(text):
        return F.unhex(F.format_string("%02x", F.length(text) % 3))
    assert answers(documents(spark, TEXTS), hash_of=weak) == expected(TEXTS)


def test_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, ["same", "sa me"])
    assert answers(docs.union(docs)) == {0: (1, 4, False), 1: (1, 4, True)}
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") == 0, 0))
    got = exact_dedup.exact_groups(unnamed).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(0, None, False), (None, None, True)}
    assert answers(docs.limit(0)) == {}


def test_query_against_sql(spark):
    rows, problem = differences(QUERIES["op2_exact_dedup"](spark, SF), views(SF), ORACLE_SQL["op2_exact_dedup"])
    assert rows and problem is None


def test_no_python_in_the_plan(spark):
    plan = exact_dedup.exact_groups(documents(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
