"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, letters that look like Latin ones, and digits or
signs that stand for letters inside a word. Entries are whole words and beginnings
of words; an Aho-Corasick automaton finds all of them in one pass. Of the entries
that meet a word the heaviest counts, unless the word lies in an exception phrase.
The weights' sum, divided by the number of words, is the rate; the score is
rate / (rate + scale).

Exception phrases are learned too: two neighbouring words, one of them an entry, that
EXCUSED rows or more labelled 0 hold and no row labelled 1.

The lexicon is learned: an entry's weight is the log of the ratio of its frequencies
in toxic and other texts, counted once for each pair of neighbouring words, so that
copies of a text count once. It is fitted on at most SAMPLE rows of each label (the
bound of the sample); scoring covers every whole text.

Defined results: a null or empty text, or one without words, scores 0; rows without
an id or a label are not learned from; without toxic rows to learn from the lexicon
is empty and all score 0; repeated rows are judged alike; entries of equal weight at one
word count once, and any of them is the heaviest; very long texts are scored whole, as a
rate of their words; other columns are ignored.
"""

import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heldout import held_out, sample_ids
from .tables import written
from .tasks import flat_map

SAMPLE = {1: 3000, 0: 12_000}     # labelled rows learned from: toxic, other
STEMS = (3, 4, 5, 6)              # lengths of beginnings that may be entries
MIN_CONTEXTS = 5
MIN_WEIGHT = 3.0
EXCUSED = 5                       # rows labelled 0 that make two neighbouring words an exception
PRIOR_WORDS = 20                  # added to a text's length
THRESHOLD = 0.3

#: Letters that look like a Latin letter, and signs that stand for one inside a word.
HOMOGLYPHS = str.maketrans("абвгеёзіїјкмнорстухѕԁɡαβεικνορτυχ", "abbreesiijkmhopctyxsdgabeikvoptux")
SIGNS = str.maketrans("013456789@$!", "oieasgtbqasi")
#: A word; a lone @ or $ at either end stands for a letter too.
TOKEN = re.compile(r"(?:(?<![@$!\w])[@$])?[^\W_]+(?:[@$!]+[^\W_]+)*(?:[@$](?![@$!\w]))?")


def fold_words(text: str) -> list[str]:
    """The words of a text, folded; numbers are no words."""
    out = []
    for token in TOKEN.findall(text.lower().translate(HOMOGLYPHS)):
        if not token.isalpha():
            if not any(map(str.isalpha, token)):
                continue
            token = token.translate(SIGNS)
        out.append(token)
    return out


def entries_of(word: str):
    """Whole words end with a blank, beginnings do not; both begin with one."""
    yield f" {word} "
    for n in STEMS:
        if len(word) > n:
            yield f" {word[:n]}"


class Lexicon:
    """Weights by entry, exception phrases and the scale of the score."""

    def __init__(self, weights: dict, exceptions=(), scale: float = 1.0):
        self.weights, self.exceptions, self.scale = weights, exceptions, scale

    def scorer(self):
        """rate(text), from an automaton made once for a task's batch."""
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = " " + " ".join(fold_words(phrase)) + " "
            machine.add_word(entry, (len(entry), None))
        machine.make_automaton()

        def rate(text) -> float:
            found = fold_words(text) if text else []
            if not found or not self.weights:
                return 0.0
            best, excused = {}, []
            for end, (length, weight) in machine.iter(" " + " ".join(found) + " "):
                begin = end - length + 1
                if weight is None:
                    excused.append((begin, end))
                elif weight > best.get(begin, 0.0):
                    best[begin] = weight
            for lo, hi in excused:
                for at in [b for b in best if lo <= b < hi]:
                    del best[at]
            return sum(best.values()) / (len(found) + PRIOR_WORDS)
        return rate


def fit(docs: DataFrame, labels: DataFrame, sample: dict = SAMPLE) -> Lexicon:
    """Learn from the texts of docs (doc_id, text) by labels (doc_id, toxic), held-out rows left out."""
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic")
    chosen = [sample_ids(marked.filter(F.col("toxic") == y), "toxic", n) for y, n in sample.items()]
    chosen = written(chosen[0].unionByName(chosen[1]).dropDuplicates(["doc_id"]), "toxicity-sample")
    rows = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
                         .dropDuplicates(["doc_id"]), "toxicity-texts")

    def occurrences(texts, toxic):
        for i, text in enumerate(texts):
            found = fold_words(text or "")
            entries, contexts = [], []
            for before, word, after in zip(["", *found], found, [*found[1:], ""]):
                for entry in entries_of(word):
                    entries.append(entry)
                    contexts.append(f"{before} {after}")
            if entries:
                yield [i] * len(entries), [entries, contexts]

    seen = flat_map(rows, ["text", "toxic"], ["toxic"], "entry string, context string", occurrences)
    spread = (seen.groupBy("entry", F.xxhash64("context").alias("context"))
              .agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("other"))
              .groupBy("entry").agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"),
                                    F.sum(F.when(F.col("other") == 0, 1).otherwise(0)).alias("good")))
    totals = rows.groupBy("toxic").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()
    total = {r.toxic: r.n or 1 for r in totals}
    if 1 not in total:
        return Lexicon({})
    weight = (F.log((F.col("bad") + 0.5) / float(total[1]))
              - F.log((F.col("good") + 0.5) / float(total.get(0, 1))))
    kept = (spread.filter(F.col("bad") >= MIN_CONTEXTS).withColumn("weight", weight)
            .filter(F.col("weight") >= MIN_WEIGHT).collect())     # no more than the sample has words and beginnings
    weights = {r.entry: float(r.weight) for r in kept}
    lexicon = Lexicon(weights, learned_exceptions(rows, weights))
    rated = rates(rows, lexicon, ["toxic"]).select("toxic", "rate").toPandas()     # the bounded sample
    bad, good = (np.sort(rated[rated["toxic"] == y]["rate"].to_numpy()) for y in (1, 0))
    if len(bad):
        lexicon.scale = best_cut(bad, good) * (1 - THRESHOLD) / THRESHOLD
    return lexicon


def learned_exceptions(rows: DataFrame, weights: dict) -> tuple:
    """Phrases of two words with an entry in them that only rows labelled 0 hold, in order."""
    def phrases(texts):
        for i, text in enumerate(texts):
            found = fold_words(text or "")
            hit = [any(e in weights for e in entries_of(w)) for w in found]
            own = {f"{a} {b}" for a, b, x, y in zip(found, found[1:], hit, hit[1:]) if x or y}
            if own:
                yield [i] * len(own), [sorted(own)]

    counted = (flat_map(rows, ["text"], ["toxic"], "phrase string", phrases).groupBy("phrase")
               .agg(F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("good"), F.max("toxic").alias("toxic")))
    return tuple(sorted(r.phrase for r in counted.filter((F.col("toxic") == 0) & (F.col("good") >= EXCUSED)).collect()))


def best_cut(bad: np.ndarray, good: np.ndarray) -> float:
    """The rate that parts two sorted samples with the fewest mistakes, in the middle of its gap."""
    edges = np.unique(np.concatenate((bad, good, [0.0])))
    middle = (edges[1:] + edges[:-1]) / 2 if len(edges) > 1 else np.array([1.0])
    missed = np.searchsorted(bad, middle) / max(len(bad), 1)
    raised = 1 - np.searchsorted(good, middle) / max(len(good), 1)
    wrong = missed + raised
    return float(np.median(middle[wrong <= wrong.min() + 1e-9]))


def rates(docs: DataFrame, lexicon: Lexicon, keep: list) -> DataFrame:
    def rate(texts):
        one = lexicon.scorer()
        yield list(range(len(texts))), [[one(t) for t in texts]]
    return flat_map(docs, ["text"], keep, "rate double", rate)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, score): 0 to 1, at THRESHOLD where the lexicon was cut."""
    rated = rates(docs, lexicon, ["doc_id"])
    return rated.select("doc_id", (F.col("rate") / (F.col("rate") + lexicon.scale)).alias("score"))
