"""Small tables and plain versions of the operators to compare with."""

import random
import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK_WORD = re.compile("[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Texts with a defined result each: null, empty, blank, no letter, one word, very long, repeated.
ODD = [None, "", " \t\n\x0b\x0c\r", "123 !? 4", "word", "a " * 50_000, "x" * 30_000,
       "Straße ÉCOLE niño 語 \U0001f600", "word"]


def documents(spark, texts, sources=None, langs=None, first=0):
    rows = [(first + i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i],
             len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def crowded(docs):
    """The same rows with columns whose names operators use inside."""
    from pyspark.sql import functions as F
    for name in ("size", "n", "h", "norm", "shard", "slot", "taken", "copy", "score", "rejected", "mark", "block"):
        docs = docs.withColumn(name, F.lit("odd"))
    return docs


def prose(seed, n_words, vocabulary=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(n_words))


def words(text, pattern=BLANK_WORD):
    return pattern.findall((text or "").translate(LOWER))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[j:j + k]) for j in range(len(w) - k + 1)}


def jaccard_components(docs):
    """{doc_id: (n_shingles, component)} by comparing every pair that shares a shingle."""
    sets = {i: shingles(t) for i, t in docs}
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, s in sets.items():
        for j in {j for g in s for j in holders[g] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def kept_bytes(docs, length=50):
    """{doc_id: (bytes, spans, remaining bytes)} for (doc_id, text) in order of the id."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        gone, own = bytearray(len(data)), []
        for j in range(len(data) - length + 1):
            own.append(data[j:j + length])
            if own[-1] in seen:
                gone[j:j + length] = b"\x01" * length
        seen.update(own)
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), spans, bytes(c for c, g in zip(data, gone) if not g))
    return out


def contamination(docs, items, window=13):
    """{doc_id: (n_words, hit words, item ids)}."""
    windows = {}
    for item, text in items:
        w = words(text, ALNUM_WORD)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[j:j + n]), set()).add(item)
    out = {}
    for i, text in docs:
        w, hit, found = words(text, ALNUM_WORD), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if got := windows.get(tuple(w[j:j + n])):
                    hit.update(range(j, j + n))
                    found |= got
        out[i] = (len(w), len(hit), found)
    return out


def jump(key, shards):
    """(shard, next move) by the textbook loop in whole numbers."""
    key %= 1 << 64
    at, after = -1, 0
    while after < shards:
        at = after
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        after = (at + 1) * (1 << 31) // ((key >> 33) + 1)
    return at, after
