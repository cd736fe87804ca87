"""Alignment of two tokenizers over one corpus, by the byte ends their tokens share.

Each text is encoded by both. A dictionary from end to index, an array with a place for
each byte, is made of the cumulative byte ends of either side; the ends in both, in
order, slice the two id lists into groups, and the links of a group are all pairs of its
A and B tokens. A link's count is the number of rows of the corpus that hold its id pair.

 1. texts are encoded in tasks and written as one row each: figures, and the distinct
    pairs with how often they occur. Nothing is encoded twice.
 2. pairs are counted over all rows: combined inside tasks, then by a shuffle of at most
    the distinct pairs of each task.
 3. counts go back to the rows. The most frequent pairs, at most `top` of them, are sent
    to tasks as arrays; pairs below that count, if there are any, are joined as rows. None
    of those is a hot key, as every pair above the limit is in the arrays.

Both tokenizers travel as bytes with the job, so workers need no copy of the files.

Defined results: a text that is null or empty, or whose tokens do not spell a space and
the text, has no tokens: zeros and an empty hash. Special tokens' strings are plain text.
Repeated rows count as rows of their own, with or without an id; ids are carried only.
A very long text is encoded whole, its links in chunks; a long group is folded to
distinct ids first. Ties: every B id with the highest count of an A id is its best. An
empty table gives an empty result; other columns are ignored.
"""

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean, written
from .tasks import flat_map

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
TOP = 1 << 20        # pairs held in tasks as arrays of 17 bytes each
CHUNK = 1 << 20      # links expanded at a time, and pairs a task holds before it passes counts on
TEXT = 1 << 18       # characters encoded at a time

FIGURES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> dict:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Fixed value: how a byte-level vocabulary of this kind cuts a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond which two engines' tables of letters and blanks might differ.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f\u2010-\u2027]")


class ByteLevel:
    """Side A: byte-level BPE; encodes a space and the text.

    Where the file describes plain merges in the order of the ids, texts of usual
    characters are merged by ranks, which gives the same ids at a third of the cost.
    """

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec.decode("utf-8"))
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        self.spelled = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.spelled[i] = (bytes(letters[c] for c in token) if all(c in letters for c in token)
                               else token.encode("utf-8"))
        self.ranks = self.by_ranks(json.loads(spec))

    def by_ranks(self, file: dict):
        import tiktoken
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges") or []]
        plain = (model.get("type") == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
                 and not file.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex")
                 and not cut.get("add_prefix_space")
                 and all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merges)))
        if not plain:
            return None
        return tiktoken.Encoding("merges", pat_str=CUT, special_tokens={},
                                 mergeable_ranks={self.spelled[i]: i for i in range(256 + len(merges))})

    def encode(self, texts: list) -> list:
        odd = [i for i, t in enumerate(texts) if self.ranks is None or UNUSUAL.search(t)]
        got = dict(zip(odd, self.tokenizer.encode_batch_fast([" " + texts[i] for i in odd], add_special_tokens=False)))
        return [np.array(got[i].ids, dtype=np.int64) if i in got
                else self.ranks.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64)
                for i, t in enumerate(texts)]


class Pieces:
    """Side B: sentence pieces with byte fallback; adds the space itself."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        self.processor = SentencePieceProcessor(model_proto=model)
        n = self.processor.get_piece_size()
        self.spelled = [bytes([int(p[3:5], 16)]) if self.processor.is_byte(i)
                        else p.replace("▁", " ").encode("utf-8")
                        for i, p in enumerate(self.processor.id_to_piece(list(range(n))))]

    def encode(self, texts: list) -> list:
        return [np.array(ids, dtype=np.int64) for ids in self.processor.encode(texts, num_threads=1)]


def batches(texts):
    """(indices, texts) of the texts that are not empty, some TEXT characters at a time."""
    index, held, size = [], [], 0
    for i, text in enumerate(texts):
        if text:
            index.append(i)
            held.append(text)
            size += len(text)
            if size > TEXT:
                yield index, held
                index, held, size = [], [], 0
    if held:
        yield index, held


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups end in two id lists, as exclusive indices, by the byte ends of their tokens."""
    size = 1 + max(ends_a.max(initial=0), ends_b.max(initial=0))
    index_a, index_b = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)     # 0: no token ends here
    index_a[ends_a] = np.arange(1, ends_a.size + 1)
    index_b[ends_b] = np.arange(1, ends_b.size + 1)
    common = np.flatnonzero((index_a > 0) & (index_b > 0))
    return index_a[common], index_b[common]


def folded(keys: np.ndarray, times: np.ndarray):
    """Distinct keys in order, and the sum of times of each."""
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, weights=times, minlength=distinct.size).astype(np.int64)


def block_links(a: np.ndarray, b: np.ndarray, width: int):
    """Links of one long group: distinct ids of either side with their numbers, block by block."""
    one, n = np.unique(a, return_counts=True)
    other, m = np.unique(b, return_counts=True)
    step = max(1, CHUNK // other.size)
    for k in range(0, one.size, step):
        keys = one[k:k + step, None] * width + other[None, :]
        yield keys.ravel(), (n[k:k + step, None] * m[None, :]).ravel()


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, width: int):
    """(distinct pairs a * width + b in order, how often each occurs) over all groups."""
    n, m = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
    size = n * m
    parts = []
    k = 0
    total = np.cumsum(size)
    while k < size.size:
        if size[k] > CHUNK:
            parts += list(block_links(a[cut_a[k] - n[k]:cut_a[k]], b[cut_b[k] - m[k]:cut_b[k]], width))
            k += 1
        else:
            end = max(k + 1, int(np.searchsorted(total, total[k] - size[k] + CHUNK, side="right")))
            big = np.flatnonzero(size[k:end] > CHUNK)
            end = k + int(big[0]) if big.size else end
            group = np.repeat(np.arange(k, end), size[k:end])
            at = np.arange(group.size) - np.repeat(total[k:end] - size[k:end] - (total[k] - size[k]), size[k:end])
            left = a[(cut_a - n)[group] + at // m[group]]
            right = b[(cut_b - m)[group] + at % m[group]]
            keys, times = np.unique(left * width + right, return_counts=True)
            parts.append((keys, times))
            k = end
        if len(parts) > 8:
            parts = [folded(np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]))]
    if len(parts) == 1:
        return parts[0]
    return folded(np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]))


class Aligner:
    """Both tokenizers and what is looked up by id."""

    def __init__(self, spec_a: bytes, spec_b: bytes):
        self.a, self.b = ByteLevel(spec_a), Pieces(spec_b)
        self.length_a, self.length_b = (np.array([len(x) for x in side.spelled]) for side in (self.a, self.b))
        self.other = 2 * len(self.a.spelled)
        self.names = ([f"{i}{mark}" for i in range(len(self.a.spelled)) for mark in ",|"]
                      + [f"{i}{mark}" for i in range(len(self.b.spelled)) for mark in ",;"])

    def aligned(self, texts):
        """For each text that has tokens: (index, a, b, cut_a, cut_b), as arrays of ids and cuts."""
        for index, held in batches(texts):
            for i, text, a, b in zip(index, held, self.a.encode(held), self.b.encode(held)):
                want = b" " + text.encode("utf-8", "surrogatepass")
                ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
                # A's tokens are parts of the text's bytes in order, so their length tells; pieces may be normalised
                if (a.size and b.size and ends_a[-1] == len(want) == ends_b[-1]
                        and b"".join(map(self.b.spelled.__getitem__, b.tolist())) == want):
                    yield i, a, b, *slices(ends_a, ends_b)

    def groups_hash(self, a, b, cut_a, cut_b) -> str:
        """SHA-256 of the groups as decimal ids: a1,a2|b1;a3|b2,b3"""
        n, m = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        left, right = 2 * a, 2 * b + self.other
        left[cut_a - 1] += 1
        right[cut_b - 1] += 1
        parts = np.empty(a.size + b.size, dtype=np.int64)
        parts[np.arange(a.size) + np.repeat(cut_b - m, n)] = left
        parts[np.arange(b.size) + np.repeat(cut_a, m)] = right
        text = "".join(map(self.names.__getitem__, parts.tolist()))[:-1]
        return hashlib.sha256(text.encode("ascii")).hexdigest()


def encoded(docs: DataFrame, spec_a: bytes, spec_b: bytes, width: int) -> DataFrame:
    """One row of each text: FIGURES, row, and its pairs and times as arrays of bytes."""
    wide = np.dtype(np.uint32) if width * len(ByteLevel(spec_a).spelled) < 1 << 32 else np.dtype(np.int64)
    specs = docs.sparkSession.sparkContext.broadcast((spec_a, spec_b))
    made_once = []

    def rows(texts):
        if not made_once:
            made_once.append(Aligner(*specs.value))
        aligner = made_once[0]
        done = 0
        zero = lambda n: [[0] * n, [0] * n, [0] * n, [0] * n, [""] * n, [b""] * n, [b""] * n]
        index, out, size = [], [[] for _ in range(7)], 0
        for i, a, b, cut_a, cut_b in aligner.aligned(texts):
            pairs, times = links(a, b, cut_a, cut_b, width)
            if i > done:
                yield range(done, i), zero(i - done)
            done = i + 1
            made = (len(a), len(b), len(cut_a), int(times.sum()), aligner.groups_hash(a, b, cut_a, cut_b),
                    pairs.astype(wide).tobytes(), times.astype(np.uint32).tobytes())
            index.append(i)
            for column, value in zip(out, made):
                column.append(value)
            size += pairs.size
            if size > CHUNK:
                yield index, out
                index, out, size = [], [[] for _ in range(7)], 0
        yield index, out
        if done < len(texts):
            yield range(done, len(texts)), zero(len(texts) - done)

    made = flat_map(docs.select("doc_id", "text"), ["text"], ["doc_id"], "n_a long, n_b long, n_groups long, "
                    "n_links long, groups_sha256 string, pairs binary, times binary", rows)
    return written(made.withColumn("row", F.monotonically_increasing_id()), "aligned"), wide


def pair_counts(held: DataFrame, wide: np.dtype, width: int) -> DataFrame:
    """(pair, n, best): rows that hold the pair; whether no pair of its A id has a higher count."""

    def totals(batches):
        import pyarrow as pa
        parts, size = [], 0

        def out():
            keys, n = folded(np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]))
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            got = np.frombuffer(b"".join(batch.column("pairs").to_pylist()), dtype=wide)
            if not got.size:
                continue
            keys, n = np.unique(got, return_counts=True)
            parts.append((keys, n))
            size += keys.size
            if size > CHUNK:
                kept = folded(np.concatenate([p for p, _ in parts]), np.concatenate([t for _, t in parts]))
                parts, size = [kept], kept[0].size
                if size > CHUNK // 2:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    counts = held.select("pairs").mapInArrow(totals, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    parts = max(1, len(held.inputFiles()))       # as many as tasks that encoded: each passes on one share of the counts
    counts = written(counts.withColumn("a", F.expr(f"pair div {width}")).coalesce(parts), "pair-counts")
    most = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most")))     # one row an A id of the vocabulary
    return written(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")),
                   "pair-best")


def frequent(counts: DataFrame, top: int):
    """The pairs of at least some power of two rows, at most `top`: sorted pairs, counts, best; whether that is all pairs."""
    sizes = dict(counts.groupBy(F.length(F.bin("n")).alias("bits")).count().collect())     # at most 64 rows
    least, n = 64, 0
    while least > 0 and n + sizes.get(least, 0) <= top:
        n += sizes.get(least, 0)
        least -= 1
    with lean(counts.sparkSession):
        got = counts.filter(F.length(F.bin("n")) > least).toArrow()
    pairs = got.column("pair").to_numpy()
    order = np.argsort(pairs)
    arrays = pairs[order], got.column("n").to_numpy()[order], got.column("best").to_numpy()[order]
    return arrays, least == 0


def align(docs: DataFrame, path_a: str = f"{FOLDER}/{BYTE_BPE}", path_b: str = f"{FOLDER}/{PIECES}",
          top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): FIGURES, n_best and count_sum of every row; (a, b, n, best) of every id pair.

    n_best counts links whose pair is held by as many rows as any of its A id; count_sum
    adds up the counts of all links.
    """
    spec_a, spec_b = read_bytes(path_a), read_bytes(path_b)
    width = len(Pieces(spec_b).spelled)
    held, wide = encoded(docs, spec_a, spec_b, width)
    counts = pair_counts(held, wide, width)
    arrays, all_known = frequent(counts, top)
    known = docs.sparkSession.sparkContext.broadcast(arrays)

    def looked_up(pairs, times):
        keys, n, best = known.value
        index, out, size = [], [[], [], [], []], 0
        for i, (p, t) in enumerate(zip(pairs, times)):
            p, t = np.frombuffer(p, dtype=wide).astype(np.int64), np.frombuffer(t, dtype=np.uint32).astype(np.int64)
            at = np.searchsorted(keys, p)
            at[at == keys.size] = 0
            here = keys[at] == p if keys.size else np.zeros(p.size, dtype=bool)
            at, found = at[here], t[here]
            index.append(i)
            for column, value in zip(out, (int(found[best[at]].sum()), int((found * n[at]).sum()),
                                           p[~here], t[~here])):
                column.append(value)
            size += p.size
            if size > CHUNK:
                yield index, out
                index, out, size = [], [[], [], [], []], 0
        yield index, out

    looked = written(flat_map(held, ["pairs", "times"], ["row", *FIGURES], "near_best long, near_sum long, "
                              "rest array<long>, rest_times array<long>", looked_up), "aligned-figures")
    pairs = counts.select(F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b"), "n", "best")
    if all_known:
        return looked.select(*FIGURES, F.col("near_best").alias("n_best"), F.col("near_sum").alias("count_sum")), pairs
    rest = (looked.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("p"))
            .select("row", F.col("p.rest").alias("pair"), F.col("p.rest_times").alias("times"))
            .join(counts, "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("far_best"),
                 F.sum(F.col("times") * F.col("n")).alias("far_sum")))
    rows = looked.join(rest, "row", "left").select(
        *FIGURES, (F.col("near_best") + F.coalesce("far_best", F.lit(0))).alias("n_best"),
        (F.col("near_sum") + F.coalesce("far_sum", F.lit(0))).alias("count_sum"))
    return rows, pairs
