import zlib

from pyspark.sql import functions as F

from tickwright.llm import sharding
from tickwright.llm.queries import QUERIES

from .cases import ODD, crowded, documents, jump


def test_jump_is_the_textbook_loop(spark):
    keys = [0, 1, -1, 17, 2**63 - 1, -2**63, *range(1000, 1400)]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 40, 300):
        got = frame.select("k", sharding.jump_path(F.col("k"), shards).alias("p")).collect()
        assert {r.k: (r.p.at, r.p.next) for r in got} == {k: jump(k, shards) for k in keys}


def test_one_more_shard_only_takes_rows_itself(spark):
    docs = documents(spark, [str(i) for i in range(3000)])
    now = sharding.shard_documents(docs, 40)
    then = {r.doc_id: r.shard for r in sharding.shard_documents(docs, 41).collect()}
    for r in now.collect():
        assert r.grown_shard == then[r.doc_id] and r.grown_shard in (r.shard, 40)
    moved = now.filter("grown_shard != shard").count()
    assert 30 < moved < 130


def test_slots_sizes_and_odd_rows(spark):
    docs = crowded(documents(spark, [*ODD, *ODD]))
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == docs.count()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(documents(spark, []), 5).count() == 0


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [str(i) for i in range(200)])
    out = f"{tmp_path}/shards"
    sharding.write_shards(sharding.shard_documents(docs, 4), out, files_per_shard=2)
    assert spark.read.parquet(out).count() == 200


def test_query(spark):
    path = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = QUERIES["op9_sharding"](spark, path).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        at, after = jump(r.doc_id, 40)
        assert (r.size, r.text_crc32, r.law, r.shard) == (len(raw) + 16, zlib.crc32(raw), "key", at)
        assert r.grown_shard == (after if after <= 40 else at)
    for shard in range(40):
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
