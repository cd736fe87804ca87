"""Benchmark decontamination by winnowing.

The hashes of all k-grams of words are cut to the smallest of each w in a row, on
the documents and on the benchmark items alike, which keeps one of every k + w - 1
words in a row: any shared span of that length has a shared fingerprint at the same
place. Shared fingerprints are joined, and each meeting is extended word by word
to both sides; a meeting counts when the shared run holds a whole window of the
item. An item shorter than a window is one window; its own length then sets k and w,
so the guarantee holds for it too.

Only fingerprints that may occur in the benchmark leave a document's task, found by
a bit set of fixed size; with them go the words around. Texts are not shuffled.

Defined results: a null or empty text has no words, is never hit and, as an item,
has no window; repeated rows are judged alike, an item_id that occurs twice counts
once; empty tables give an empty or unhit result; other columns are ignored.
"""

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bits, words
from .tables import written
from .tasks import flat_map

WINDOW = 13
GRAM = 6


def shape(length: int, window: int = WINDOW, gram: int = GRAM):
    """(k, w) with k + w - 1 = min(length, window)."""
    n = min(length, window)
    k = min(gram, n)
    return k, n - k + 1


def smallest(values: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest value, the last of equals, in each w in a row."""
    if values.size < w:
        return np.empty(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, w)
    at = np.arange(view.shape[0]) + (w - 1) - view[:, ::-1].argmin(axis=1)
    return np.unique(at)


def fingerprints(hashes: np.ndarray, k: int, w: int):
    """(places, hashes) of the fingerprints of one text's words."""
    g = words.grams(hashes, k) ^ np.uint64(w)
    at = smallest(g, w)
    return at, g[at]


def _words(piece, lo, hi) -> list:
    return [piece.data[b:e].decode("utf-8", "replace")
            for b, e in zip(piece.begin[lo:hi].tolist(), piece.end[lo:hi].tolist())]


def item_prints(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, fp, item_at, span, item_words): the fingerprints of each item.

    span is the number of words of its windows; item_words are the words around that
    a run can reach, of which item_at stand before the fingerprint.
    """
    def prints(texts):
        for piece in words.pieces(texts, words.ALNUM):
            hashes, rows = piece.hashes(), []
            for i in range(piece.n):
                lo, hi = int(piece.bounds[i]), int(piece.bounds[i + 1])
                if lo == hi:
                    continue
                k, w = shape(hi - lo, window, gram)
                span = k + w - 1
                at, fp = fingerprints(hashes[lo:hi], k, w)
                for a, f in zip(at.tolist(), fp.view(np.int64).tolist()):
                    first = max(0, a - span + 1)
                    rows.append((piece.first + i, f, a - first, span,
                                 _words(piece, lo + first, min(hi, lo + a + k + span))))
            if rows:
                index, *columns = zip(*rows)
                yield index, columns

    return flat_map(items, ["text"], ["item_id"],
                    "fp long, item_at int, span int, item_words array<string>", prints)


def document_prints(docs: DataFrame, spans: list, known) -> DataFrame:
    """(doc_id, copy, n_words, fp, at, left, near): fingerprints that may be an item's.

    A row with a null fp stands for the document itself. near holds the words around
    the fingerprint, of which `left` stand before it. known: a broadcast bit set.
    """
    def prints(texts):
        seen = known.value
        for piece in words.pieces(texts, words.ALNUM):
            hashes = piece.hashes()
            n_words = np.diff(piece.bounds)
            rows = [(piece.first + i, int(n), None, None, None, None) for i, n in enumerate(n_words)]
            for k, w in spans:
                grams = words.grams(hashes, k) ^ np.uint64(w)
                may = bits.has(seen, grams)
                for i in np.unique(piece.text[:grams.size][may]).tolist():
                    lo, hi = int(piece.bounds[i]), int(piece.bounds[i + 1])
                    at = smallest(grams[lo:max(lo, hi - k + 1)], w)
                    for a in at[may[lo + at]].tolist():
                        first, reach = max(0, a - w - k + 2), k + w - 1
                        rows.append((piece.first + i, int(n_words[i]), int(grams[lo + a].view(np.int64)), a,
                                     a - first, _words(piece, lo + first, min(hi, lo + a + k + reach))))
            index, *columns = zip(*rows)
            yield index, columns

    return flat_map(docs, ["text"], ["doc_id", "copy"],
                    "n_words long, fp long, at long, left int, near array<string>", prints)


def shared_runs(met: DataFrame) -> DataFrame:
    """(doc_id, copy, item_id, begin, end): runs of words that hold a window of the item."""
    def runs(at, left, near, item_at, span, theirs):
        rows = []
        for n, (a, x, mine, y, need, other) in enumerate(zip(at, left, near, item_at, span, theirs)):
            back, on = 0, 0
            while back < min(x, y) and mine[x - back - 1] == other[y - back - 1]:
                back += 1
            while on < min(len(mine) - x, len(other) - y) and mine[x + on] == other[y + on]:
                on += 1
            if back + on >= need:
                rows.append((n, a - back, a + on))
        if rows:
            index, *columns = zip(*rows)
            yield index, columns

    return flat_map(met, ["at", "left", "near", "item_at", "span", "item_words"],
                    ["doc_id", "copy", "item_id"], "begin long, end long", runs)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  percent: int = 5):
    """(judged, runs). judged: a row per document with doc_id, copy, n_words, n_hit, item_ids, contaminated.

    copy tells rows of one doc_id apart. runs: doc_id, copy, item_id, begin, end in
    words. A document is contaminated when it has hit words and they are at least
    percent of its words.
    """
    prints = written(item_prints(items, window, gram), "item-fingerprints")
    lengths = prints.select("span").distinct().collect()         # at most `window` values
    spans = [shape(r.span, window, gram) for r in sorted(lengths)]
    known = docs.sparkSession.sparkContext.broadcast(
        bits.to_array(bits.bit_rows(prints.select("fp"), "fp")))
    docs = docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    found = written(document_prints(docs, spans, known), "document-fingerprints")
    met = found.filter("fp IS NOT NULL").join(prints, "fp")
    runs = written(shared_runs(met).distinct(), "shared-runs")

    ends = runs.groupBy("copy", "begin").agg(F.max("end").alias("end"))
    earlier = Window.partitionBy("copy").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    covered = ends.withColumn("from", F.greatest("begin", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    hits = covered.groupBy("copy").agg(
        F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).alias("n_hit"))
    named = (runs.select("copy", "item_id").distinct()
             .groupBy("copy").agg(F.collect_list("item_id").alias("item_ids")))
    each = found.filter("fp IS NULL").select("doc_id", "copy", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0))
    judged = (each.join(hits, "copy", "left").join(named, "copy", "left")
              .select("doc_id", "copy", "n_words", n_hit.cast("long").alias("n_hit"), "item_ids",
                      ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated")))
    return judged, runs
