import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickwright.llm import heldout, language
from tickwright.llm.queries import QUERIES

from .cases import ODD, crowded, documents, held_out

KINDS = {"aa": ["bada", "gada", "daba"], "zz": ["kuto", "tuko", "toku"]}


def corpus(spark, n=80):
    texts, langs = [], []
    for i in range(n):
        lang = "aa" if i % 2 else "zz"
        texts.append(" ".join(KINDS[lang][(i + j) % 3] for j in range(5 + i % 7)))
        langs.append(lang)
    return documents(spark, texts, langs=langs)


def test_learned_and_odd_texts(spark):
    model = language.fit(corpus(spark))
    assert model.languages == sorted(model.languages) and set(model.languages) == {"aa", "zz"}
    assert all(model.languages.count(x) <= language.CENTROIDS for x in "az")
    texts = [*ODD, "gada bada", "TOKU kuto", "\u8a9e", "###"]
    rows = {r.doc_id: r for r in language.identify(crowded(documents(spark, texts)), model).collect()}
    assert len(rows) == len(texts) and rows[0].n == "odd"
    n = len(ODD)
    assert (rows[n].lang_pred, rows[n + 1].lang_pred) == ("aa", "zz")
    for i in (0, 1, 2, 3, n + 3):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert rows[n + 2].lang_pred in ("aa", "zz") and rows[n + 2].rejected
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_held_out_rows_and_nulls_teach_nothing(spark):
    docs = corpus(spark)
    flip = F.when(heldout.held_out(F.col("doc_id")), "other").otherwise(F.col("lang"))
    assert set(language.fit(docs.withColumn("lang", flip)).languages) == {"aa", "zz"}
    unnamed = docs.withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("null"))
    more = docs.union(unnamed).union(docs.withColumn("lang", F.lit(None).cast("string")))
    assert set(language.fit(more).languages) == {"aa", "zz"}


def test_the_split_is_that_of_the_checksum(spark):
    ids = spark.range(300).select("id", heldout.held_out(F.col("id")).alias("out")).collect()
    assert all(r.out == held_out(r.id) for r in ids)


def test_nothing_to_learn_from(spark):
    model = language.fit(documents(spark, []))
    got = language.identify(documents(spark, ["word", None]), model).collect()
    assert [(r.lang_pred, r.rejected) for r in got] == [("und", True)] * 2
    assert language.identify(documents(spark, []), model).count() == 0


def test_clusters_of_wrong_labels_are_dropped():
    rng = np.random.default_rng(1)

    def rows(*around):
        made = np.concatenate([np.abs(rng.normal(centre, 0.05, (n, 3))) for centre, n in around])
        return made / np.linalg.norm(made, axis=1, keepdims=True)
    a, held_a = language.clusters(rows(([1, 0.1, 0], 80), ([0.7, 0.7, 0], 15), ([0, 0.1, 1], 8)), 3)
    b, held_b = language.clusters(rows(([0, 0, 1], 90)), 1)
    assert held_a.tolist() == [80, 15, 8] and held_b.tolist() == [90]
    keep = language.own_centres(["a"] * 3 + ["b"], np.concatenate((a, b)))
    assert keep.tolist() == [True, True, False, True]


def unlearned():
    pick = random.Random(3)
    text = {
        "Russian": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом. ",
        "Japanese": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا ",
        "Polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni ",
    }
    out = {name: t * 20 for name, t in text.items()}
    out["hex"] = " ".join(pick.randbytes(32).hex() for _ in range(50))
    out["base64"] = base64.b64encode(pick.randbytes(3000)).decode()
    out["letters"] = " ".join("".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9)))
                              for _ in range(500))
    return out


def test_unlearned_languages_and_junk_are_rejected_and_short_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = unlearned()
    more = documents(spark, list(odd.values()), langs=[None] * len(odd), first=10_000_000)
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    kept = {r.doc_id for r in stage(spark, docs.unionByName(more.select(*docs.columns)), "").select("doc_id").collect()}
    assert [name for i, name in enumerate(odd) if 10_000_000 + i in kept] == []
    rows = docs.select("doc_id", F.length("text").alias("n")).collect()
    short = {r.doc_id for r in rows if r.n and r.n < 100}
    assert len(short) >= 15 and short <= kept
    assert len(kept) >= 0.998 * len(rows)


def test_limits_follow_language_and_size():
    found = np.zeros((2, language.SIZES, language.BANDS), dtype=np.int64)
    found[0, 4, 20], found[0, 8, 160], found[1, 8, 100] = 1000, 1000, 1000
    found[1, 6, 100] = 10
    short, long, other = *language.least_scores(found)[0, [4, 8]], language.least_scores(found)[1, 8]
    assert 0 < short < 0.1 and 0.4 < long < 0.8 and 0.2 < other < 0.5
    few = language.least_scores(found)[:, 6]
    assert (few > 0).all() and (few < 0.15).all()
    assert (language.least_scores(found)[:, 12] == language.least_scores(found)[:, 8]).sum() == 2
    assert not language.least_scores(np.zeros_like(found)).any()


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out_accuracy(spark, sf):
    path = f"/root/testdata/{sf}"
    truth = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op8_language_id"](spark, path).join(truth, "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def test_two_varieties_of_a_language_give_two_centroids(spark):
    texts, langs = [], []
    for i in range(120):
        lang, kind = ("aa", ["bada", "gada", "daba"]) if i % 2 else ("zz", ["kuto", "tuko", "toku"])
        if lang == "aa" and i % 20 == 1:                  # a twentieth of its rows, in another script
            kind = ["\u0430\u0431\u0432", "\u0432\u0430\u0431\u0430", "\u0431\u0430\u0432\u0430"]
        texts.append(" ".join(kind[(i + j) % 3] for j in range(5 + i % 7)))
        langs.append(lang)
    texts += ["kuto tuko toku kuto"] * 8                  # rows with a wrong label: no centroid of aa
    langs += ["aa"] * 8
    docs = documents(spark, texts, langs=langs)
    model = language.fit(docs)
    assert model.languages.count("aa") >= 2
    found = language.identify(documents(spark, ["\u0432\u0430\u0431\u0430 \u0430\u0431\u0432", "gada bada daba", "tuko kuto toku"]), model)
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["aa", "aa", "zz"]


def test_several_centroids_survive_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    assert len(model.languages) > len(set(model.languages)) == 4


def test_scores_of_the_query_against_every_centroid(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, path).collect()}
    assert got.keys() == texts.keys()
    for i, text in list(texts.items())[::9]:
        if not text or not language.has_letter(text):
            assert got[i].lang_pred == "und"
            continue
        counts = np.zeros(language.SIZE)
        raw = b" " + text.lower().encode().translate(language.BYTES) + b"  "
        for a, b, c in zip(raw, raw[1:], raw[2:]):
            if not (a == b == 32 or b == c == 32):
                counts[((a << 16 | b << 8 | c) * 2654435761 % (1 << 32)) >> 20] += 1
        weights = np.log1p(counts) * model.idf
        cosines = model.centres @ (weights / max(np.linalg.norm(weights), 1e-30))
        assert abs(got[i].score - min(max(cosines.max(), 0), 1)) < 1e-4
        near = {model.languages[k] for k in np.flatnonzero(cosines > cosines.max() - 1e-5)}
        assert got[i].lang_pred in near
