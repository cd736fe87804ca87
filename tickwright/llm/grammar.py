"""Re-Pair over many short sequences, and edit costs evaluated on its rules.

A sequence is a list of symbols. Rounds count adjacent pairs over all sequences; the
most frequent pairs that do not touch each other become rules, and every sequence is
rewritten by them. A rule's transfer matrix is made once, of those of its two parts,
and serves every sequence in which it occurs.

A matrix holds, for each state before and after, the least cost, the rope of the
cheapest audit (the state between its two parts) and the audit's rank among those
from the same state. Audits of one symbol from one state to different states differ,
and none is the beginning of another, as each ends with the letter of a row. So two
ropes are put in order by the ranks of their parts, without their letters.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_WAY = 1 << 40
STATES = 4


class Matrix:
    """cost[s, t], rank[s, t] and, for a rule, middle[s, t]; for a row, audit[s][t]."""

    __slots__ = ("cost", "rank", "middle", "audit")

    def __init__(self, cost, rank, middle=None, audit=None):
        self.cost, self.rank, self.middle, self.audit = cost, rank, middle, audit


def ranked(order_keys) -> list:
    """Rank of each key among the keys; None (no way) comes last."""
    present = sorted({k for k in order_keys if k is not None})
    place = {k: i for i, k in enumerate(present)}
    return [place[k] if k is not None else STATES for k in order_keys]


def of_row(ways: dict) -> Matrix:
    """Matrix of one row from {(s, t): (cost, audit)}."""
    cost = [[NO_WAY] * STATES for _ in range(STATES)]
    audit = [[None] * STATES for _ in range(STATES)]
    for (s, t), (c, letters) in ways.items():
        cost[s][t], audit[s][t] = c, letters
    return Matrix(cost, [ranked(row) for row in audit], audit=audit)


def product(one: Matrix, two: Matrix) -> Matrix:
    """Min-plus product; of equal costs the audit that is less."""
    cost, rank, middle = [], [], []
    for s in range(STATES):
        costs, ropes, between = [], [], []
        for t in range(STATES):
            best = (NO_WAY, 0, 0, -1)
            for m in range(STATES):
                c = one.cost[s][m] + two.cost[m][t]
                if c < NO_WAY:
                    best = min(best, (c, one.rank[s][m], two.rank[m][t], m))
            costs.append(best[0])
            ropes.append(best[1:3] if best[3] >= 0 else None)
            between.append(best[3])
        cost.append(costs)
        rank.append(ranked(ropes))
        middle.append(between)
    return Matrix(cost, rank, middle)


class Rules:
    """Terminals 0 .. n - 1 and rules: number n + i is the pair pairs[i]."""

    def __init__(self, terminals: list, pairs: list = ()):
        self.n, self.pairs = len(terminals), list(pairs)
        self.matrices = list(terminals)
        for a, b in self.pairs:
            self.matrices.append(product(self.matrices[a], self.matrices[b]))

    def add(self, pair: tuple) -> int:
        self.pairs.append(pair)
        self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return len(self.matrices) - 1

    def letters(self, symbol: int, s: int, t: int) -> str:
        """The audit of a symbol between two states, read off its rope."""
        out, open_parts = [], [(symbol, s, t)]
        while open_parts:
            k, s, t = open_parts.pop()
            if k < self.n:
                out.append(self.matrices[k].audit[s][t])
            else:
                a, b = self.pairs[k - self.n]
                m = self.matrices[k].middle[s][t]
                open_parts += [(b, m, t), (a, s, m)]
        return "".join(out)


def chain(matrices: list) -> list:
    """Products of the first 1, 2, ... of the matrices."""
    out = [matrices[0]]
    for m in matrices[1:]:
        out.append(product(out[-1], m))
    return out


def states_of(products: list, t: int, s: int = 0) -> list:
    """The states after each part on the way of the whole product from s to t."""
    states = [t]
    for whole in reversed(products[1:]):
        states.append(whole.middle[s][states[-1]])
    return states[::-1]


END = np.uint16(65535)       # stands between the sequences of a batch


def rewritten(symbols: np.ndarray, pair: tuple, number: int) -> np.ndarray:
    """Every occurrence of the pair, from the left, as one symbol."""
    a, b = pair
    at = np.flatnonzero((symbols[:-1] == a) & (symbols[1:] == b))
    if not at.size:
        return symbols
    if a == b:                                     # of a run the first two, the next two, ...
        begins = np.diff(at, prepend=-2) > 1
        number_in_run = np.arange(at.size) - np.maximum.accumulate(np.where(begins, np.arange(at.size), 0))
        at = at[number_in_run % 2 == 0]
    out = symbols.copy()
    out[at] = number
    return np.delete(out, at + 1)


def joined(raws: list, pairs: list, first: int) -> np.ndarray:
    """The sequences of a batch behind each other, rewritten by pairs as symbols from `first` on."""
    symbols = np.frombuffer(b"".join([r + END.tobytes() for r in raws]), dtype=np.uint16)
    for i, pair in enumerate(pairs):
        symbols = rewritten(symbols, pair, first + i)
    return symbols


def disjoint(counted: list) -> list:
    """Of pairs in order of their number those whose symbols no earlier one uses."""
    used, out = set(), []
    for a, b in counted:
        if not {a, b} & used:
            used |= {a, b}
            out.append((a, b))
    return out


def pair_counts(sequences: DataFrame, pairs: list, first: int, least: int) -> list:
    """Rows (a, b, n) of the adjacent pairs of all rewritten sequences, the most frequent first."""

    def count(batches):
        import pyarrow as pa
        total: dict = {}
        for batch in batches:
            s = joined(batch.column("symbols").to_pylist(), pairs, first)
            inner = (s[:-1] != END) & (s[1:] != END)
            keys, n = np.unique(s[:-1][inner].astype(np.int64) << 16 | s[1:][inner], return_counts=True)
            for k, c in zip(keys.tolist(), n.tolist()):
                total[k] = total.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         names=["pair", "n"])

    return (sequences.select("symbols").mapInArrow(count, "pair long, n long")
            .groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
            .select(F.shiftright("pair", 16).alias("a"), F.expr("pair & 65535").alias("b"), "n")
            .orderBy(F.desc("n"), "a", "b").collect())


def repair(sequences: DataFrame, terminals: list, rounds: int = 5, least: int = 2) -> tuple[DataFrame, Rules]:
    """Learn rules over the column symbols (16-bit numbers as bytes) of a written table and rewrite it.

    Pairs of all rows are counted, inside tasks first. The driver sees one row a pair of
    symbols; a round makes at most half as many rules as there are symbols, so their
    number depends on the rounds alone. Fewer rounds only leave sequences longer.
    """
    rules = Rules(terminals)
    for _ in range(rounds):
        fresh = disjoint([(r.a, r.b) for r in pair_counts(sequences, list(rules.pairs), rules.n, least)])
        for pair in fresh:
            rules.add(pair)
        if not fresh:
            break
    pairs, first = list(rules.pairs), rules.n

    def rewrite(batches):
        import pyarrow as pa
        for batch in batches:
            s = joined(batch.column("symbols").to_pylist(), pairs, first)
            cuts = np.flatnonzero(s == END)
            raw = [s[i:j].tobytes() for i, j in zip([0, *(cuts[:-1] + 1)], cuts)] if cuts.size else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(raw, pa.binary()) if n == "symbols" else batch.column(n) for n in batch.schema.names],
                names=batch.schema.names)

    return sequences.mapInArrow(rewrite, sequences.schema), rules
