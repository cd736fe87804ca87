from pyspark.sql import functions as F

import corpus_pipeline
from tickwright.llm import mixing

from .cases import contamination, crowded, documents, jaccard_components, jump

PATH = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"{tmp_path}/{name}"
        stage(spark, docs, PATH).write.parquet(out)
        before, docs = {r.doc_id for r in docs.collect()}, spark.read.parquet(out)
        assert docs.columns[:5] == COLUMNS
        kept[name] = (before, docs)

    def ids(name):
        return kept[name][0], {r.doc_id for r in kept[name][1].collect()}
    before, after = ids("language_id")
    assert after == {i for i in before if texts[i] and any(map(str.isalpha, texts[i]))}
    before, after = ids("jaccard_join")
    assert after == {c for _, c in jaccard_components([(i, texts[i]) for i in before]).values()}
    before, after = ids("decontamination")
    judged = contamination([(i, texts[i]) for i in before], items)
    assert after == {i for i, (n, hit, _) in judged.items() if not (hit and 20 * hit >= n)}
    before, after = ids("source_mixing")
    assert after <= before
    rows = kept["source_mixing"][1].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in rows) <= mixing.REPEATS
    for r in kept["sharding"][1].collect():
        assert r.shard == jump(r.doc_id, corpus_pipeline.SHARDS)[0]


def test_run_and_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == [*COLUMNS, "shard", "slot"]


def test_nulls_repeats_and_clashing_columns_in_every_stage(spark, tmp_path):
    texts = [None, "", "Some words of a first text.", "Some words of a first text.", "other words in another text", "123",
             "x" * 30_000, "Some words of a first text, and more."] * 2
    docs = documents(spark, texts, sources=["a", None] * 8, first=1)
    docs = docs.union(docs.filter("doc_id < 4")).withColumn(
        "doc_id", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id")))
    odd = crowded(docs.withColumn("n_chars", F.lit(1).cast("long")))
    for name in ("text_crc32", "grown_shard", "component_id", "contaminated", "lang_pred", "rejected"):
        odd = odd.withColumn(name, F.lit("odd"))
    spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, str(tmp_path))
        kept = [c for c in odd.columns if c not in ("shard", "slot")]
        assert [c for c in out.columns if c not in ("shard", "slot")] == kept, name
        rows = out.collect()
        assert all(r[c] == "odd" for r in rows for c in ("size", "text_crc32", "grown_shard", "component_id", "n"))
        if name == "jaccard_join":
            own = [(r.doc_id, r.text) for r in odd.collect()]
            going = {i for i, (_, c) in jaccard_components([(i, t) for i, t in own if i is not None]).items() if c < i}
            assert sorted((r.doc_id or 0) for r in rows) == sorted((i or 0) for i, _ in own if i not in going)
        if name in ("decontamination", "sharding"):
            assert len(rows) == odd.count()
        if name == "sharding":
            assert {type(r.shard) for r in rows} == {int}
            for shard in {r.shard for r in rows}:
                own = sorted(r.slot for r in rows if r.shard == shard)
                assert own == list(range(len(own)))
