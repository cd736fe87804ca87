import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.llm import heldout, quality
from tickwright.llm.queries import QUERIES

from .cases import BLANK_WORD, ODD, crowded, documents, held_out, prose


def plain(text):
    """The base statistics, word by word."""
    w = BLANK_WORD.findall(text or "")
    at = {}
    for j in range(len(w) - 2):
        at.setdefault(tuple(w[j:j + 3]), []).append(j)
    inside = {j + k for places in at.values() if len(places) > 1 for j in places for k in range(3)}
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if BLANK_WORD.search(line):
            copies += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), copies, len(inside))


TEXTS = [*ODD, "a b c a b c d", "a a a a", "A b c a b c", "x\ny\nx\n \n \nx ", "# $| <b> && %", "a b\x1cc\x85d e f",
         "one two three one two\vthree", prose(1, 400, 12), prose(2, 300, 4000)]


def test_statistics(spark):
    got = {r.doc_id: tuple(r)[1:6] for r in quality.statistics(crowded(documents(spark, TEXTS))).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_many_distinct_words_are_packed_in_two_steps(monkeypatch):
    texts = [prose(s, 500, v) for s, v in ((1, 6), (2, 60), (3, 5000))]
    monkeypatch.setattr(quality, "PACKED", 5)
    assert [quality.statistics_of(t)[:5] for t in texts] == [plain(t) for t in texts]


def corpus(spark, n=400):
    """Prose, and rows with signs or with shouting, which are of quality 0."""
    texts, marks = [], []
    for i in range(n):
        text = prose(i, 80 + i % 40, 4000)
        if i % 7 == 0:
            text = text.replace(" ", "$$ ")
        elif i % 7 == 1:
            text = text.replace("w", "W! ")
        texts.append(text)
        marks.append(int(i % 7 > 1))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, quality int")
    return docs, labels, marks


def test_rules_are_learned_ordered_and_apply_alike_in_spark_and_numpy(spark):
    docs, labels, marks = corpus(spark)
    rows, rules = quality.judge(docs, labels)
    assert 1 <= len(rules) <= 4
    got = {r.doc_id: r for r in rows.collect()}
    assert all(got[i].kept == bool(m) for i, m in enumerate(marks))
    measured = quality.statistics(docs).select("doc_id", *[quality.feature(n).alias(n) for n, *_ in quality.FEATURES]).toPandas()
    columns = {n: measured[n].to_numpy() for n, *_ in quality.FEATURES}
    first = np.zeros(len(measured), dtype=int)
    for i, rule in reversed(list(enumerate(rules, 1))):
        first[quality.covered(rule, columns, len(measured))] = i
    assert {i: got[i].rule or 0 for i in got} == dict(zip(measured["doc_id"].tolist(), first.tolist()))


def test_held_out_rows_teach_nothing(spark):
    docs, labels, _ = corpus(spark)
    flip = F.when(heldout.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    flipped = labels.withColumn("quality", flip)
    measured = quality.statistics(docs)
    assert repr(quality.fit(measured, labels)) == repr(quality.fit(measured, flipped))


def test_ties_and_a_class_without_difference():
    pick = random.Random(1)
    bad = np.array([i % 3 == 0 for i in range(90)])
    noise = {"b": np.array([pick.random() for _ in range(90)]), "a": np.ones(90)}
    clear = {"b": bad.astype(float), "a": bad.astype(float)}
    growing = np.arange(90) % 2 == 0
    assert repr(quality.cover(clear, bad, growing)) == "[[a > 0.5]]"
    for rule in quality.cover(noise, bad, growing):
        inside = quality.covered(rule, noise, 90) & ~growing
        assert bad[inside].mean() >= quality.MIN_PRECISION


def test_nothing_to_learn_from_repeats_nulls_and_empty(spark):
    docs = documents(spark, TEXTS)
    docs = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows, rules = quality.judge(docs, none)
    got = rows.collect()
    assert rules == [] and len(got) == 2 * len(TEXTS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)
    odd = spark.createDataFrame([(3, None), (None, 0), (3, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    assert quality.judge(docs, odd)[0].count() == 2 * len(TEXTS)
    assert quality.judge(documents(spark, []), none)[0].count() == 0


@pytest.mark.parametrize("path", ["/root/testdata/sf0.1"])
def test_query(spark, path):
    rows = QUERIES["op12_quality_rules"](spark, path).toPandas()
    docs = spark.read.parquet(f"{path}/documents.parquet").toPandas()
    texts = dict(zip(docs["doc_id"], docs["text"]))
    assert sorted(rows["doc_id"]) == sorted(docs["doc_id"])
    for r in rows.iloc[::20].itertuples():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(texts[r.doc_id])
    marks = spark.read.parquet(f"{path}/labels.parquet").toPandas().merge(rows, on="doc_id")
    unseen = marks[[held_out(i) for i in marks["doc_id"]]]
    unseen = unseen[~unseen["base_failed"]]
    good, bad = unseen[unseen["quality"] == 1], unseen[unseen["quality"] == 0]
    assert good["kept"].mean() > 0.99 and bad["kept"].mean() < 0.1
