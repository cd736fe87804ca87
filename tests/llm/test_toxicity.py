import numpy as np
from pyspark.sql import functions as F

from tickwright.llm import heldout, toxicity
from tickwright.llm.queries import QUERIES

from .cases import ODD, crowded, documents, prose


def test_folding():
    assert toxicity.fold_words("St0PID 1d!ot tr@sh, 2024 \u0441l\u043ewn $$$ mail3") == [
        "stopid", "idiot", "trash", "clown", "maile"]
    assert toxicity.fold_words("$tupid @ss, as$ (the$$$ $$of) $5 5$ what!") == ["stupid", "ass", "ass", "the", "of", "what"]


def corpus(spark, n=400):
    texts, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = prose(i, 40).split()
        if bad:
            for j in range(3):
                w.insert(3 + 11 * j, ("gruntel", "zorkish", "zorkan")[(i // 4 + j) % 3])
        texts.append(" ".join(w))
        marks.append((i, int(bad)))
    return documents(spark, texts), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_learned_lexicon_and_odd_texts(spark):
    docs, labels = corpus(spark)
    lexicon = toxicity.fit(docs, labels)
    assert " gruntel " in lexicon.weights and " zork" in lexicon.weights
    texts = [*ODD, "a gruntel b gruntel", "gr\u03c5ntel zork1sh", "plain words of no interest", "gruntel " * 3000,
             "zorkunknown it is"]
    rows = {r.doc_id: r.score for r in toxicity.score(crowded(documents(spark, texts)), lexicon).collect()}
    n = len(ODD)
    assert all(rows[i] == 0.0 for i in range(n)) and rows[n + 2] == 0.0
    assert all(rows[n + i] >= toxicity.THRESHOLD for i in (0, 3, 4))
    assert all(0 <= s <= 1 for s in rows.values())


def test_exceptions_excuse_their_words(spark):
    lexicon = toxicity.Lexicon({" trash ": 5.0}, ("trash can",), 1.0)
    rate = lexicon.scorer()
    assert rate("the trash can is full") == 0.0 and rate("trash can trash") > 0 and rate("trash") > 0


def test_exceptions_are_learned_from_rows_of_label_0(spark):
    docs, labels = corpus(spark)
    more = documents(spark, [f"{prose(900 + i, 30)} gruntel cake {prose(950 + i, 5)}" for i in range(10)], first=1000)
    marks = spark.createDataFrame([(1000 + i, 0) for i in range(10)], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs.union(more), labels.union(marks))
    assert "gruntel cake" in lexicon.exceptions and not any(p.startswith("zork") for p in lexicon.exceptions)
    rate = lexicon.scorer()
    assert rate("one gruntel cake please") == 0.0 and rate("one gruntel please") > 0


def plain_rate(text, lexicon):
    """The rate of a text by trying every entry at every word."""
    words = toxicity.fold_words(text or "")
    excused = {j + d for j in range(len(words) - 1) for d in (0, 1) if f"{words[j]} {words[j + 1]}" in lexicon.exceptions}
    total = 0.0
    for j, word in enumerate(words):
        known = [w for e, w in lexicon.weights.items() if f" {word} ".startswith(e)]
        total += max(known, default=0.0) if j not in excused else 0.0
    return total / (len(words) + toxicity.PRIOR_WORDS)


def test_scores_of_the_query_against_trying_every_entry(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in QUERIES["op3_toxicity"](spark, path).collect()}
    assert got.keys() == texts.keys()
    for i, text in list(texts.items())[::7]:
        rate = plain_rate(text, lexicon)
        assert abs(got[i] - rate / (rate + lexicon.scale)) < 1e-9


def test_labels_of_held_out_rows_and_nulls_teach_nothing(spark):
    docs, labels = corpus(spark)
    flip = F.when(heldout.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    spoiled = labels.withColumn("toxic", flip).union(spark.createDataFrame(
        [(None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int"))
    assert toxicity.fit(docs, spoiled).weights == toxicity.fit(docs, labels).weights


def test_nothing_to_learn_from(spark):
    docs, labels = corpus(spark, 8)
    lexicon = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, lexicon).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def test_held_out_documents(spark):
    path = "/root/testdata/sf0.1"
    truth = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    got = QUERIES["op3_toxicity"](spark, path).join(truth, "doc_id").filter("held_out").collect()
    found = np.mean([r.predicted for r in got if r.toxic == 1])
    raised = np.mean([r.predicted for r in got if r.toxic == 0])
    assert found > 0.9 and raised < 0.02
