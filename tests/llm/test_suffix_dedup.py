import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.llm import phrases, suffix_dedup
from tickwright.llm.queries import QUERIES

from .cases import ODD, crowded, documents, kept_bytes, prose


def answers(docs):
    return {r.doc_id: (r.n_bytes, len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()}


def test_every_window_has_one_trigger():
    text = prose(3, 300).encode()
    (parse,) = phrases.parses([text, b"short"], 50, 20)
    assert parse.n.sum() == len(text) - 49
    assert (parse.at[1:] == parse.at[:-1] + parse.n[:-1]).all()
    every = np.arange(parse.n.size)
    which, at, _, ahead = parse.windows(every)
    for i, a, d in zip(which, at, ahead):
        view = parse.grams[a:a + 31]
        assert view[d] == view.min() == parse.trigger[i] and (view[d + 1:] > view[d]).all()


def test_odd_texts_and_overlaps(spark):
    passage = prose(1, 40)
    texts = [*ODD, f"lead {passage} tail", f"{passage[3:]}", passage[:49], passage[:50], passage[:51],
             f"other {passage[:120]} and {passage[60:]} end", *ODD[4:7]]
    got = answers(crowded(documents(spark, texts)))
    assert got == kept_bytes(list(enumerate(texts)))


def test_repeated_rows_and_null_ids(spark):
    passage = prose(2, 60)
    docs = documents(spark, [passage, f"x {passage}"])
    twice = docs.union(docs).withColumn("doc_id", F.col("doc_id"))
    got = suffix_dedup.remove_repeats(twice).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in got) == [(0, len(passage))] * 2 + [(1, 2)] * 2
    unnamed = docs.withColumn("doc_id", F.when(F.col("doc_id") == 1, 1))
    assert {(r.doc_id, len(r.spans)) for r in suffix_dedup.remove_repeats(unnamed).collect()} == {(None, 0), (1, 0)}


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


def test_one_passage_in_most_documents(spark):
    passage = prose(5, 30)
    texts = [f"{prose(100 + i, 20)} {passage} {prose(500 + i, 20)}" for i in range(300)]
    assert answers(documents(spark, texts)) == kept_bytes(list(enumerate(texts)))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    import hashlib
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (n, n - len(k), s, hashlib.sha256(k).hexdigest()) for i, (n, s, k) in kept_bytes(rows).items()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op1_suffix_dedup"](spark, path).collect()}
    assert got == want


def test_query_against_sql(spark):
    from tickwright.llm.queries import ORACLE_SQL

    from .run_queries import differences, views
    path = "/root/testdata/sf0.001"
    rows, problem = differences(QUERIES["op1_suffix_dedup"](spark, path), views(path), ORACLE_SQL["op1_suffix_dedup"])
    assert rows and problem is None


def test_marks_of_many_texts_are_merged_as_arrays():
    offsets = np.array([0, 100, 100, 160, 400])
    owner, at = np.array([3, 0, 3, 2, 0, 3, 3]), np.array([120, 60, 0, 0, 30, 120, 55])
    n = np.array([1, 500, 1, 11, 1, 3, 1])
    text, begin, end = suffix_dedup.runs(offsets, owner, at, n, 50)
    assert list(zip(text.tolist(), begin.tolist(), end.tolist())) == [
        (0, 30, 100), (2, 100, 160), (3, 160, 210), (3, 215, 265), (3, 280, 332)]
    none = np.empty(0, dtype=np.int64)
    assert [x.size for x in suffix_dedup.runs(offsets, none, none, none, 50)] == [0, 0, 0]


def test_texts_are_cut_in_slices(spark, monkeypatch):
    passage = prose(7, 60)
    texts = [passage, None, f"é{passage}ü", "", passage[:80], passage + passage, None, "short", f"{passage[5:]}x"]
    monkeypatch.setattr(suffix_dedup, "FLUSH", 100)
    assert [list(s) for s in suffix_dedup.slices(np.array([60, 60, 0, 300, 1]))] == [[0, 2], [2, 4], [4, 5]]
    assert answers(documents(spark, texts)) == kept_bytes(list(enumerate(texts)))


def copies(n):
    """Texts of which many repeat whole or in part, and one repeats itself."""
    texts = [prose(1000 + i % (n // 2), 300) for i in range(n)]
    texts[3::7] = [f"{t[:500]} {prose(5000 + i, 20)} {t[300:]}" for i, t in enumerate(texts[3::7])]
    texts[5] = "\n".join([prose(9, 12)] * 20)
    return texts


def test_tables_are_small_beside_the_texts(spark, monkeypatch, tmp_path):
    from tickwright import session
    monkeypatch.setattr(session, "work_folder", lambda spark: str(tmp_path))
    texts = copies(600)
    assert len(answers(documents(spark, texts).repartition(4))) == 600
    held = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert 0 < held < 0.4 * sum(len(t.encode()) for t in texts)


def test_rows_over_many_batches_and_full_sieves(spark, monkeypatch):
    from tickwright.llm import tables
    texts = copies(60)
    docs = documents(spark, texts)
    want = kept_bytes(list(enumerate(texts)))
    monkeypatch.setattr(tables, "BATCH_ROWS", 3)
    assert answers(docs.repartition(5)) == want
    monkeypatch.setattr(suffix_dedup, "MOST_WORDS", 1)
    assert answers(docs.orderBy("text")) == want


def test_sieve_keeps_all_and_grows_with_what_it_holds(spark, monkeypatch):
    random = np.random.default_rng(4)
    hashes = random.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    keys, rests = suffix_dedup.split(suffix_dedup.bucket_of(hashes, 7), suffix_dedup.rest_of(hashes, 7))
    rows = spark.createDataFrame([(int(k), bytearray(r)) for k, r in zip(keys, rests)], "bucket long, rests binary")

    def share(held, h):
        return suffix_dedup.inside(held, 7, suffix_dedup.bucket_of(h, 7), suffix_dedup.rest_of(h, 7)).mean()
    held, other = suffix_dedup.sieve(rows, 7), random.integers(0, 1 << 63, 60_000, dtype=np.uint64)
    assert share(held, hashes) == 1 and share(held, other) < 0.05
    assert suffix_dedup.sieve(rows.limit(1), 7).size < held.size
    none = suffix_dedup.sieve(rows.limit(0), 7)
    assert share(none, other) == 0
    monkeypatch.setattr(suffix_dedup, "MOST_WORDS", 256)
    small = suffix_dedup.sieve(rows, 7)
    assert small.size == 256 * 8 and share(small, hashes) == 1


def test_marks_of_one_document_are_merged():
    doc, at, n = np.array([7, -2, 7, 7, -2]), np.array([60, 0, 0, 109, 50]), np.array([1, 1, 10, 3, 2])
    got = suffix_dedup.merged(doc, at, n, 50)
    assert [x.tolist() for x in got] == [[-2, 7, 7], [0, 0, 60], [52, 10, 52]]
