"""Language identification by nearest centroid.

A text's letters give hashed n-grams of three bytes, weighted by TF-IDF and scaled
to length 1. Each language has several centroids, clustered by spherical k-means that
starts from one cluster and splits the widest one along its main direction. A centroid
that lies nearer to the largest cluster of another language than to that of its own is
dropped: rows with a wrong label flock together.
A text gets the language of the centroid with the highest cosine, which is also its
score; it is rejected when it has no letter or its distance (1 - cosine) to every
centroid is over a limit.

The limit is learned: all rows learned from are scored, by the language found and by
how many different n-grams a text holds (in powers of 2), as short clean texts are far
from every centroid too. A text is rejected below MARGIN times the score that all but
LOWEST of such rows reach. Where few rows tell, the limit is lower: with n rows it is
n / (n + DOUBT) of that; a language with under ENOUGH rows of a size takes those of all.

Document frequencies cover all rows learned from. The clusters are fitted on at
most SAMPLE rows of each language. The model is heldout.MAX_GROUPS x CENTROIDS x SIZE
numbers at most (more languages are an error), so it may be sent to tasks.

Defined results: a null text, or one without a letter, is `und` with score 0 and
rejected; a text of unknown n-grams takes the first language by name with score 0;
rows without an id or a language are not learned from; a language is learned from
any one row; without rows to learn from every text is `und`; repeated rows are
judged alike; whole texts are read, at any length; of equally near centroids the first
counts, in order of the language's name and then of the size of its cluster.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heldout import held_out, sample_ids
from .tables import lean, written
from .tasks import flat_map

SIZE = 4096
SAMPLE = 400
CENTROIDS = 3
LEAST_ROWS = 5      # of either side of a split cluster
MAX_DISTANCE = 0.99     # the limit of any text, also where nothing was learned
LOWEST, MARGIN = 0.01, 0.6
ENOUGH, DOUBT = 100, 20
SIZES, BANDS = 13, 200  # powers of 2 up to SIZE; steps of a score that are counted
UNKNOWN = "und"
PIECE = 1 << 19

#: ASCII other than letters is blank; bytes of other characters stay.
BYTES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text) -> bool:
    return isinstance(text, str) and any(map(str.isalpha, text))


def gram_counts(texts):
    """Yield (numbers of the texts, matrix of their n-gram counts), some at a time."""
    held, index, size = [], [], 0
    for i, text in enumerate(texts):
        if text:
            raw = text.lower().encode("utf-8", "surrogatepass").translate(BYTES)
            held.append(raw)
            index.append(i)
            size += len(raw)
        if held and (size >= PIECE or len(held) == 128 or i == len(texts) - 1):
            yield index, _counts(held)
            held, index, size = [], [], 0
    if held:
        yield index, _counts(held)


def _counts(held):
    # a blank on both sides, so that no n-gram of a text reaches into its neighbour
    data = np.frombuffer(b"".join([b" " + r + b" " for r in held]) + b"  ", dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(r) + 2 for r in held])
    owner = np.repeat(np.arange(len(held), dtype=np.int64), lengths)
    a, b, c = data[:-2], data[1:-1], data[2:]
    n = owner.size
    gram = ((a[:n] << np.uint32(16)) | (b[:n] << np.uint32(8)) | c[:n]) * np.uint32(2654435761)
    cell = owner * SIZE + (gram >> np.uint32(20)).astype(np.int64)
    used = (a[:n] != 32) | (b[:n] != 32)
    used &= (b[:n] != 32) | (c[:n] != 32)
    return np.bincount(cell[used], minlength=len(held) * SIZE).reshape(len(held), SIZE)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1 (or 0)."""
    out = np.log1p(counts).astype(np.float32) * idf
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length > 0, length, 1)


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(number of texts, how many hold each n-gram)."""
    def seen(texts):
        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for index, counts in gram_counts(texts):
            total += (counts > 0).sum(axis=0)
            n += len(index)
        if texts:
            yield [0], [[[*total.tolist(), n]]]

    parts = flat_map(rows, ["text"], [], "found array<long>", seen)
    cells = (parts.select(F.posexplode("found").alias("cell", "found"))
             .groupBy("cell").agg(F.sum("found").alias("found")).toPandas())
    found = np.zeros(SIZE + 1, dtype=np.int64)
    found[cells["cell"].to_numpy(dtype=np.int64)] = cells["found"].to_numpy(dtype=np.int64)
    return int(found[SIZE]), found[:SIZE]


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centres, rows of each), the largest first, by spherical k-means that splits the widest cluster."""
    def scaled(m):
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length > 0, length, 1)

    centres = scaled(vectors.sum(axis=0, keepdims=True))
    while True:
        for _ in range(rounds):
            own = (vectors @ centres.T).argmax(axis=1)
            moved = scaled(np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centres[j]
                                     for j in range(len(centres))]))
            if np.allclose(moved, centres, atol=1e-6):
                break
            centres = moved
        own = (vectors @ centres.T).argmax(axis=1)
        held = np.bincount(own, minlength=len(centres))
        if len(centres) >= k:
            break
        width = [(1 - vectors[own == j] @ centres[j]).sum() if held[j] >= 2 * LEAST_ROWS else 0.0 for j in range(len(centres))]
        halves = None
        for j in np.argsort(-np.array(width), kind="stable"):
            if width[j] > 1e-6 and (halves := _halves(vectors[own == j])) is not None:
                centres = np.concatenate((np.delete(centres, j, axis=0), scaled(halves)))
                break
        if halves is None:
            break
    order = np.argsort(-held, kind="stable")
    return centres[order][held[order] > 0], held[order][held[order] > 0]


def _halves(vectors: np.ndarray):
    """Sums of the two sides of the main direction, or None if one has too few rows."""
    off = vectors - vectors.mean(axis=0)
    way = off[np.argmax((off * off).sum(axis=1))]
    for _ in range(20):
        way = off.T @ (off @ way)
        way = way / max(float(np.linalg.norm(way)), 1e-12)
    side = off @ way > 0
    if min(side.sum(), (~side).sum()) < LEAST_ROWS:
        return None
    return np.stack([vectors[side].sum(axis=0), vectors[~side].sum(axis=0)])


def own_centres(languages: list, centres: np.ndarray) -> np.ndarray:
    """Which centres to keep: rows are in order of language, the largest cluster of each first."""
    names = np.array(languages)
    first = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    near = centres @ centres[first].T
    own = np.searchsorted(first, np.arange(len(names)), side="right") - 1
    best = near.argmax(axis=1)
    keep = near[np.arange(len(names)), own] >= near[np.arange(len(names)), best]
    keep[first] = True
    return keep


class Model:
    """languages[i] is the language of centres[i]; both are in order of the language's name."""

    def __init__(self, languages: list, centres: np.ndarray, idf: np.ndarray, limits: np.ndarray | None = None):
        self.languages, self.centres, self.idf = languages, centres, idf
        #: The least score by centre and size class.
        self.limits = np.zeros((len(languages), SIZES)) if limits is None else limits


def size_class(counts: np.ndarray) -> np.ndarray:
    """The power of 2 of each row's number of different n-grams."""
    return np.log2(np.maximum((counts > 0).sum(axis=1), 1)).astype(int)


def best_centres(counts: np.ndarray, idf: np.ndarray, centres: np.ndarray):
    """(number of the nearest centre, score) of each row."""
    cosine = weighted(counts, idf) @ centres.T
    best = cosine.argmax(axis=1)
    return best, np.clip(cosine[np.arange(len(best)), best].astype(float), 0.0, 1.0)


def least_scores(found: np.ndarray) -> np.ndarray:
    """The limit of each size class, from the counts of rows by language, size class and band."""
    def limit(counts):
        n = counts.sum()
        low = int(np.argmax(np.cumsum(counts) > LOWEST * n)) / BANDS
        return MARGIN * low * n / (n + DOUBT)

    out = np.zeros(found.shape[:2])
    everyone = found.sum(axis=0)
    for i, own in enumerate(found):
        for k in range(SIZES):
            counts = own[k] if own[k].sum() >= ENOUGH else everyone[k]
            out[i, k] = limit(counts)
            if k and counts.sum() < DOUBT:
                out[i, k] = max(out[i, k], out[i, k - 1])
    return out


def learn_limits(rows: DataFrame, model: Model) -> np.ndarray:
    """The least score by centre and size class, from the rows whose lang is the one found."""
    languages, centres, idf = model.languages, model.centres, model.idf
    if not languages:
        return model.limits

    def scored(texts, langs):
        for index, counts in gram_counts(texts):
            best, score = best_centres(counts, idf, centres)
            own = np.array([languages[b] == langs[i] for i, b in zip(index, best)])
            band = np.minimum(score * BANDS, BANDS - 1).astype(int)
            yield (np.array(index)[own].tolist(),
                   [[languages[b] for b in best[own]], size_class(counts)[own].tolist(), band[own].tolist()])

    counted = (flat_map(rows, ["text", "lang"], [], "language string, size int, band int", scored)
               .groupBy("language", "size", "band").agg(F.count(F.lit(1)).alias("n")).toPandas())
    names = list(dict.fromkeys(languages))
    found = np.zeros((len(names), SIZES, BANDS), dtype=np.int64)
    at = {name: i for i, name in enumerate(names)}
    found[counted["language"].map(at).to_numpy(dtype=int), counted["size"].to_numpy(dtype=int),
          counted["band"].to_numpy(dtype=int)] = counted["n"].to_numpy(dtype=np.int64)
    return least_scores(found)[[at[name] for name in languages]]


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from the text and lang of the rows of docs that are not held out."""
    with lean(docs.sparkSession):
        return _fit(docs, sample, centroids)


def _fit(docs: DataFrame, sample: int, centroids: int) -> Model:
    rows = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n, found = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + found)) + 0.05).astype(np.float32)
    chosen = written(sample_ids(rows, "lang", sample), "language-sample")
    texts = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").dropDuplicates(["doc_id", "lang"])

    def vectors(texts):
        for index, counts in gram_counts(texts):
            yield index, [list(weighted(counts, idf))]

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        found, held = clusters(np.stack(group.sort_values("doc_id")["vector"].to_list()), centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "held": held, "centre": list(found.astype(np.float32))})

    made = (flat_map(texts, ["text"], ["doc_id", "lang"], "vector array<float>", vectors)
            .groupBy("lang").applyInPandas(centres, "lang string, held long, centre array<float>").toPandas())
    made = made.sort_values(["lang", "held"], ascending=[True, False], kind="stable")
    found = np.stack(made["centre"].to_list()).astype(np.float32) if len(made) else np.zeros((0, SIZE), np.float32)
    keep = own_centres(made["lang"].to_list(), found) if len(made) else np.zeros(0, dtype=bool)
    model = Model([name for name, k in zip(made["lang"], keep) if k], found[keep], idf)
    model.limits = learn_limits(rows, model)
    return model


def identify(docs: DataFrame, model: Model, max_distance: float = MAX_DISTANCE,
             names=("lang_pred", "score", "rejected")) -> DataFrame:
    """The rows of docs with lang_pred, score and rejected, which replace columns of the same name."""
    languages, centres, idf = model.languages, model.centres, model.idf
    limits = np.maximum(model.limits, 1 - max_distance)

    def nearest(texts):
        if languages:
            for index, counts in gram_counts(texts):
                best, score = best_centres(counts, idf, centres)
                least = limits[best, size_class(counts)]
                lettered = [has_letter(texts[i]) for i in index]
                yield index, [[languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)],
                              [s if ok else 0.0 for s, ok in zip(score.tolist(), lettered)],
                              [not ok or s < m for s, m, ok in zip(score.tolist(), least.tolist(), lettered)]]
        rest = [i for i, t in enumerate(texts) if not t or not languages]
        yield rest, [[UNKNOWN] * len(rest), [0.0] * len(rest), [True] * len(rest)]

    made = ", ".join(f"{n} {kind}" for n, kind in zip(names, ("string", "double", "boolean")))
    return flat_map(docs, ["text"], [c for c in docs.columns if c not in names], made, nearest)
