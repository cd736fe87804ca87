"""Quality rules: decision lists learned by sequential covering.

Each text is reduced to whole-number statistics in tasks. On a bounded sample of
labelled rows, rules are learned one after the other: a conjunction of thresholds is
grown by information gain on two thirds of the sample, cut back on the rest, and the
rows it covers are set aside before the next one is sought. The list is a chain of
Spark conditions, read in order; a row that meets none is kept.

Defined results: a null or empty text has no word and every statistic 0; a ratio over
nothing is 0. Rows without an id or a label are not learned from; a labelled id on
several rows is learned from as its least statistics, under both labels if it has two.
Without rows of either label the list is empty and only the base rule drops. Ties
between conditions: the greater gain, then the feature's name, then `<=`, then the
smaller threshold. Very long texts are read whole; repeated rows are judged alike; an
empty table gives an empty result; other columns are ignored.
"""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .heldout import held_out, sample_ids
from .tables import written
from .tasks import flat_map

SAMPLE = 10_000          # labelled rows of each label learned from, at most
MAX_RULES, MAX_CONDITIONS = 32, 6
MIN_COVER = 8            # bad rows a rule must cover in the growing part
MIN_PRECISION = 0.8      # of a rule, in the pruning part

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_distinct", "n_ends", "n_upper", "n_lower", "n_digits", "n_calls"]
STATISTICS = BASE + MORE
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
SYMBOLS = b"#*$%&|<>"
PACKED = 1 << 21         # words of a text that fit three to a 64-bit number

#: What a rule may put a threshold on: name, statistic, statistic it is divided by.
FEATURES = [
    ("calls", "n_calls", "n_words"), ("digits", "n_digits", "word_chars"), ("distinct", "n_distinct", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"), ("ends", "n_ends", "n_words"), ("line_words", "n_words", "n_lines"),
    ("lower", "n_lower", "word_chars"), ("repeats", "n_repeat_words", "n_words"),
    ("symbols", "n_symbols", "n_words"), ("upper", "n_upper", "word_chars"), ("word_length", "word_chars", "n_words"),
    ("words", "n_words", None),
]


def count_of(raw: bytes, these: bytes) -> int:
    return len(raw) - len(raw.translate(None, these))


def repeated_words(codes: np.ndarray, n_codes: int) -> int:
    """Words that lie in a window of three that occurs twice or more."""
    if codes.size < 4:
        return 0
    if n_codes < PACKED:
        windows = (codes[:-2] * n_codes + codes[1:-1]) * n_codes + codes[2:]
    else:
        pairs = np.unique(codes[:-1] * n_codes + codes[1:], return_inverse=True)[1]
        windows = pairs[:-1] * n_codes + codes[2:]
    _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = times[at] > 1
    inside = np.zeros(codes.size, dtype=bool)
    for k in range(3):
        inside[k:k + again.size] |= again
    return int(inside.sum())


def statistics_of(text) -> tuple:
    """STATISTICS of one text."""
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()                  # of bytes: at exactly the six blanks
    known: dict = {}
    codes = np.array([known.setdefault(w, len(known)) for w in found], dtype=np.int64)
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    return (len(found), len(text) - count_of(raw, BLANKS), count_of(raw, SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(codes, len(known)), len(lines), len(known), sum(w[-1] in b".!?" for w in found),
            count_of(raw, bytes(range(65, 91))), count_of(raw, bytes(range(97, 123))),
            count_of(raw, bytes(range(48, 58))), count_of(raw, b"!"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, STATISTICS) of every row."""
    def rows(texts):
        yield range(len(texts)), [list(c) for c in zip(*map(statistics_of, texts))] or [[] for _ in STATISTICS]
    return flat_map(docs, ["text"], ["doc_id"], ", ".join(f"{s} long" for s in STATISTICS), rows)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def feature(name: str) -> Column:
    part, whole = next((p, w) for n, p, w in FEATURES if n == name)
    if whole is None:
        return F.col(part).cast("double")
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


class Condition:
    """feature <= limit, or feature > limit."""

    def __init__(self, name: str, below: bool, limit: float):
        self.name, self.below, self.limit = name, below, limit

    def holds(self, rows: dict) -> np.ndarray:
        return rows[self.name] <= self.limit if self.below else rows[self.name] > self.limit

    def column(self) -> Column:
        return feature(self.name) <= F.lit(self.limit) if self.below else feature(self.name) > F.lit(self.limit)

    def __repr__(self):
        return f"{self.name} {'<=' if self.below else '>'} {self.limit:.6g}"


def covered(rule: list, rows: dict, n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for condition in rule:
        out &= condition.holds(rows)
    return out


def gain(bad, good, bad_before: int, good_before: int):
    """Information won on the bad rows that stay covered."""
    with np.errstate(divide="ignore", invalid="ignore"):
        won = bad * (np.log2(bad / (bad + good)) - np.log2(bad_before / (bad_before + good_before)))
    return np.where(bad > 0, won, -1.0)


def best_condition(rows: dict, bad: np.ndarray):
    """The condition of greatest gain over rows; bad marks those to cover."""
    n_bad, n_good = int(bad.sum()), int((~bad).sum())
    best, choice = 1e-9, None
    for name in sorted(rows):
        order = np.argsort(rows[name], kind="stable")
        values, marks = rows[name][order], bad[order]
        ends = np.flatnonzero(values[1:] > values[:-1])
        if not ends.size:
            continue
        low_bad = np.cumsum(marks)[ends]
        low_good = ends + 1 - low_bad
        for below in (True, False):
            b, g = (low_bad, low_good) if below else (n_bad - low_bad, n_good - low_good)
            won = np.where(b >= MIN_COVER, gain(b, g, n_bad, n_good), -1.0)
            k = int(np.argmax(won))
            if won[k] > best:
                best = float(won[k])
                choice = Condition(name, below, float((values[ends[k]] + values[ends[k] + 1]) / 2))
    return choice


def grow(rows: dict, bad: np.ndarray) -> list:
    """Add conditions while they win information and good rows are left."""
    rule = []
    while len(rule) < MAX_CONDITIONS and bad.any() and not bad.all():
        condition = best_condition(rows, bad)
        if condition is None:
            break
        rule.append(condition)
        inside = condition.holds(rows)
        rows, bad = {n: v[inside] for n, v in rows.items()}, bad[inside]
    return rule


def prune(rule: list, rows: dict, bad: np.ndarray) -> tuple[list, float]:
    """The beginning of the rule of greatest (bad - good) / (bad + good), shortest of equals; its precision."""
    best, kept, precision = -2.0, [], 0.0
    for n in range(1, len(rule) + 1):
        inside = covered(rule[:n], rows, bad.size)
        b, g = int(bad[inside].sum()), int((~bad[inside]).sum())
        worth = (b - g) / (b + g) if b + g else -1.0
        if worth > best:
            best, kept, precision = worth, rule[:n], b / (b + g) if b + g else 0.0
    return kept, precision


def cover(rows: dict, bad: np.ndarray, growing: np.ndarray) -> list:
    """Rules in order, by growing, pruning and setting aside what is covered."""
    rules = []
    while len(rules) < MAX_RULES and bad[growing].any() and bad[~growing].any():
        part = {n: v[growing] for n, v in rows.items()}
        rest = {n: v[~growing] for n, v in rows.items()}
        rule, precision = prune(grow(part, bad[growing]), rest, bad[~growing])
        if not rule or precision < MIN_PRECISION:
            break
        rules.append(rule)
        left = ~covered(rule, rows, bad.size)
        rows, bad, growing = {n: v[left] for n, v in rows.items()}, bad[left], growing[left]
    return rules


def fit(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list:
    """Learn rules for rows of quality 0 from statistics by labels (doc_id, quality), held-out rows left out.

    Rows that fail the base rule teach nothing, as they are dropped without the list.
    """
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    chosen = sample_ids(marked, "quality", sample)
    least = (measured.filter(~base_failed()).join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id", "quality").agg(F.min(F.struct(*STATISTICS)).alias("s"))
             .select("doc_id", "quality", "s.*"))
    got = least.select("doc_id", "quality", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 12 < 8)
                       .alias("growing"), *[feature(n).alias(f"f_{n}") for n, *_ in FEATURES]).toArrow()
    order = np.lexsort((got.column("quality").to_numpy(), got.column("doc_id").to_numpy()))
    rows = {n: got.column(f"f_{n}").to_numpy()[order] for n, *_ in FEATURES}
    return cover(rows, got.column("quality").to_numpy()[order] == 0,
                 got.column("growing").to_numpy(zero_copy_only=False)[order])


def rule_number(rules: list) -> Column:
    """The number of the first rule that a row meets, from 1; null if none."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        met = rule[0].column()
        for condition in rule[1:]:
            met = met & condition.column()
        out = F.when(met, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list]:
    """(rows, rules): doc_id, BASE, base_failed, rule and kept of every row of docs; the list learned."""
    measured = written(statistics(docs.select("doc_id", "text")), "quality-statistics")
    rules = fit(measured, labels, sample)
    return measured.select(
        "doc_id", *BASE, base_failed().alias("base_failed"), rule_number(rules).alias("rule"),
        (~base_failed() & rule_number(rules).isNull()).alias("kept")), rules
