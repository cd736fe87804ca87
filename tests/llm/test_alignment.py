import hashlib
from bisect import bisect

from pyspark.sql import functions as F

from tickwright.llm import alignment
from tickwright.llm.queries import QUERIES

from .cases import ODD, crowded, documents, prose

PATHS = [f"{alignment.FOLDER}/{alignment.BYTE_BPE}", f"{alignment.FOLDER}/{alignment.PIECES}"]


def plain(docs):
    """Every row's figures by comparing all pairs of tokens of a group, one text at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders
    a_side = Tokenizer.from_file(PATHS[0])
    a_side.encode_special_tokens = True
    b_side = SentencePieceProcessor(model_file=PATHS[1])
    letters = alignment.byte_letters()

    def spelled_a(i):
        return bytes(letters[c] for c in a_side.id_to_token(i))

    def spelled_b(i):
        return bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else \
            b_side.id_to_piece(i).replace("▁", " ").encode()

    def ends(pieces):
        out, at = [], 0
        for p in pieces:
            at += len(p)
            out.append(at)
        return out

    done = []
    for doc_id, text in docs:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        parts_a, parts_b = [spelled_a(i) for i in a], [spelled_b(i) for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(parts_a) != want or b"".join(parts_b) != want:
            done.append((doc_id, 0, 0, [], []))
            continue
        at_a, at_b = ends(parts_a), ends(parts_b)
        begin, groups = 0, []
        for end in sorted(set(at_a) & set(at_b)):
            groups.append((a[bisect(at_a, begin):bisect(at_a, end)], b[bisect(at_b, begin):bisect(at_b, end)]))
            begin = end
        done.append((doc_id, len(a), len(b), groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    held = {}
    for *_, pairs in done:
        for pair in set(pairs):
            held[pair] = held.get(pair, 0) + 1
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    rows = []
    for doc_id, n_a, n_b, groups, pairs in done:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((doc_id, n_a, n_b, len(groups), len(pairs), sum(held[p] == most[p[0]] for p in pairs),
                     sum(held[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return sorted(rows, key=str), held


def answers(frame):
    return sorted((tuple(r) for r in frame.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


TEXTS = [*ODD, "<|endoftext|> and </s> <unk>", "a▁b", "▁", "naïve 中文 \U0001f9d1‍\U0001f680", "a\x00b\r\n\tc",
         "é é ﬁ", " lead", "trail ", "  two", "1234567890 3.14", "don't I'll", "ÀÀÀ" * 50, prose(4, 300)]


def test_odd_texts_against_a_plain_version(spark):
    docs = crowded(documents(spark, TEXTS))
    want, held = plain(list(enumerate(TEXTS)))
    for top in (alignment.TOP, 64, 0):           # all counts in tasks, some, none
        rows, counts = alignment.align(docs, top=top)
        assert answers(rows) == want
    assert {(r.a, r.b): r.n for r in counts.collect()} == held


def test_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, ["one two", "two three", None])
    docs = docs.union(docs).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert answers(alignment.align(docs)[0]) == plain(rows)[0]
    assert answers(alignment.align(documents(spark, []))[0]) == []


def test_chunks_do_not_change_links(monkeypatch):
    import numpy as np
    pick = np.random.default_rng(3)
    a, b = pick.integers(0, 9, 400), pick.integers(0, 7, 300)
    cut_a, cut_b = np.array([1, 2, 150, 152, 390, 400]), np.array([2, 3, 100, 104, 299, 300])
    whole = alignment.links(a, b, cut_a, cut_b, 7)
    monkeypatch.setattr(alignment, "CHUNK", 50)
    cut = alignment.links(a, b, cut_a, cut_b, 7)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    want = {}
    for p, x, q, y in zip([0, *cut_a], cut_a, [0, *cut_b], cut_b):
        for i in a[p:x]:
            for j in b[q:y]:
                want[i * 7 + j] = want.get(i * 7 + j, 0) + 1
    assert dict(zip(*map(list, whole))) == want


def test_small_tables_are_few_files_and_rows_join_only_what_is_left(spark, monkeypatch):
    texts = [prose(k, 200) for k in range(12)]
    docs = documents(spark, texts).coalesce(2)
    files, write = {}, alignment.written

    def counted(df, label):
        done = write(df, label)
        files[label] = len(done.inputFiles())
        return done

    def shuffles(rows):
        return "Exchange" in rows._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(alignment, "written", counted)
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        whole, _ = alignment.align(docs)
        assert files["pair-counts"] <= files["aligned"] == 2
        some, _ = alignment.align(docs, top=8)
        assert shuffles(some) and not shuffles(whole)
        assert answers(whole) == answers(some) == plain(list(enumerate(texts)))[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert answers(QUERIES["op11_token_alignment"](spark, path)) == plain(docs)[0]
