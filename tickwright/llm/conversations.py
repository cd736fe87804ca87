"""Repair of a conversation's turn structure at the least cost of edits.

A conversation is put in order by turn (none first), then role, then a hash of role and
text. A row's first fault counts: blank, a copy of an earlier row, cut off. Every row is
kept, given another role, or deleted, and rows are inserted, so that the roles follow
`(s?(ua)+)?`; the cheapest way is found, of equal ones the one whose audit (the edits'
initials in order) is least.

 1. thin rows without texts are folded, told first from repeated, and laid out in the
    order of all conversations by ranges, so a long one is spread over many tasks. Each
    task turns the rows of a conversation into pieces of at most PIECE symbols.
 2. grammar.repair makes rules of frequent pairs of symbols over all pieces; each rule
    has one transfer matrix, shared by all conversations.
 3. a conversation's matrices are multiplied piece by piece, and the audit is read off
    the ropes of its pieces.
 4. the texts are read again, one conversation after the other behind its audit. A hash
    over a whole text has to see it in order: that step streams a conversation through
    one task, holding its audit and one batch of rows.

Defined results: a null conversation is one of its own; a null role or text is one
blank; equal rows are interchangeable, all but the first are copies; rows of one turn
are ordered as above. A conversation without rows has zeros, an empty audit and the hash
of nothing. Very long texts are only hashed and trimmed; other columns are ignored; an
empty table gives an empty result.
"""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grammar
from .tables import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3      # costs
PIECE = 1 << 16
KNOWN = 1 << 16          # sequences whose answer a task remembers
BLANKS = " \t\n\x0b\f\r"
INITIALS = "sua"         # other initials are the fourth class
GONE = 8                 # symbol of a row that must be deleted; others are class + 4 * truncated
LEGAL = {(0, 1), (1, 2), (2, 1)}

#: States: nothing yet, after s, after u, after a. Only a user may follow all but u.
AFTER_S, AFTER_U, AFTER_A = 1, 2, 3
ENDINGS = {0: (0, ""), AFTER_S: (2 * INSERT, "II"), AFTER_U: (INSERT, "I"), AFTER_A: (0, "")}


def turned(state: int) -> int:
    """The state after the user or assistant that may follow."""
    return AFTER_A if state == AFTER_U else AFTER_U


def row_matrix(symbol: int) -> grammar.Matrix:
    """Ways through inserted rows and one row, by the states before and after."""
    kind, cut = symbol % 4, symbol // 4 == 1
    ways: dict = {}

    def offer(s, t, cost, audit):
        ways[s, t] = min(ways.get((s, t), (grammar.NO_WAY, "")), (cost, audit))

    for s in range(grammar.STATES):
        at = s
        for n in range(3):
            spent, letters = n * INSERT, "I" * n
            offer(s, at, spent + DELETE, letters + "D")
            if symbol < GONE:
                left = spent + TRUNCATED * cut
                offer(s, turned(at), left + REROLE, letters + "R")
                if kind == 0 and at == 0:
                    offer(s, AFTER_S, left + KEEP, letters + "K")
                elif kind in (1, 2) and turned(at) == (AFTER_U if kind == 1 else AFTER_A):
                    offer(s, turned(at), left + KEEP, letters + "K")
            at = turned(at)
    return grammar.of_row(ways)


TERMINALS = [row_matrix(symbol) for symbol in range(GONE + 1)]


def cheapest(whole: grammar.Matrix) -> int:
    """The state in which the cheapest way through the whole ends."""
    ends = [(whole.cost[0][t] + cost, whole.rank[0][t], t) for t, (cost, _) in ENDINGS.items()
            if whole.cost[0][t] < grammar.NO_WAY]
    return min(ends)[2]


def solved(rules: grammar.Rules, pieces: list) -> tuple[int, str]:
    """(cost, audit) of a conversation given as pieces of symbols."""
    parts = [grammar.chain([rules.matrices[k] for k in piece]) for piece in pieces]
    wholes = grammar.chain([p[-1] for p in parts])
    end = cheapest(wholes[-1])
    s, letters = 0, []
    for piece, products, t in zip(pieces, parts, grammar.states_of(wholes, end)):
        for symbol, after in zip(piece, grammar.states_of(products, t, s)):
            letters.append(rules.letters(symbol, s, after))
            s = after
    cost, tail = ENDINGS[end]
    return wholes[-1].cost[0][end] + cost, "".join(letters) + tail


def named(rows: DataFrame) -> DataFrame:
    """conv (text; one blank if null), at (order of the turn), role, text, key of role and text."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select(
        conversation(), F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn")).alias("at"),
        role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("key"))


def conversation() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")


def thin(rows: DataFrame) -> DataFrame:
    """Distinct rows without text: conv, at, role, key, kind, n copies, blank, cut, seen (at an earlier turn)."""
    bare = F.btrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    folded = (named(rows).select("conv", "at", "role", "key", kind.alias("kind"), (bare == "").alias("blank"),
                                 (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
              .groupBy("conv", "at", "role", "key", "kind", "blank", "cut").agg(F.count(F.lit(1)).alias("n")))
    folded = written(folded, "conversation-rows")
    again = (folded.groupBy("conv", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("turns"))
             .filter("turns > 1").select("conv", "key", "first"))
    return (folded.join(again, ["conv", "key"], "left")
            .withColumn("seen", F.coalesce(F.col("at") != F.col("first"), F.lit(False))).drop("first"))


PIECES = ("conv string, slab int, piece int, symbols binary, kind_1 int, kind_2 int, turn_1 long, turn_2 long, "
          "turns long, blank long, duplicate long, truncated long, illegal long")


def pieces(rows: DataFrame) -> DataFrame:
    """The thin rows in order, as pieces of symbols with what the figures need."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        slab, serial = TaskContext.get().partitionId(), 0
        conv = held = None
        done: list = []

        def close():
            nonlocal serial
            done.append((conv, slab, serial, np.array(held["symbols"], dtype=np.uint16).tobytes(),
                         *[held[k] for k in ("kind_1", "kind_2", "turn_1", "turn_2", "turns", "blank",
                                             "duplicate", "truncated", "illegal")]))
            serial += 1

        def out():
            names = [f.split()[0] for f in PIECES.split(", ")]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()] + [pa.int64()] * 7
            columns = list(zip(*done)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for c, turn, kind, blank, cut, seen, n in zip(*[batch.column(k).to_pylist() for k in (
                    "conv", "turn", "kind", "blank", "cut", "seen", "n")]):
                for copy in range(n):
                    if held is None or c != conv or len(held["symbols"]) >= PIECE:
                        if held is not None:
                            close()
                        conv = c
                        held = {"symbols": [], "kind_1": kind, "kind_2": None, "turn_1": None, "turn_2": None,
                                "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                    fault = "blank" if blank else "duplicate" if seen or copy else "truncated" if cut else None
                    if fault:
                        held[fault] += 1
                    if held["kind_2"] is not None and (held["kind_2"], kind) not in LEGAL:
                        held["illegal"] += 1
                    held["kind_2"] = kind
                    if turn is not None and turn != held["turn_2"]:
                        held["turns"] += 1
                        held["turn_2"] = turn
                        if held["turn_1"] is None:
                            held["turn_1"] = turn
                    held["symbols"].append(GONE if fault in ("blank", "duplicate") else kind + 4 * (fault == "truncated"))
                if len(done) >= 4096:
                    yield out()
                    done = []
        if held is not None:
            close()
        yield out()

    laid = rows.repartitionByRange("conv", "at", "role", "key").sortWithinPartitions("conv", "at", "role", "key")
    return laid.select("conv", "at.turn", "kind", "blank", "cut", "seen", "n").mapInArrow(run, PIECES)


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(cut: DataFrame, rules: grammar.Rules) -> DataFrame:
    """Per conversation its figures and audit, from its pieces in order."""

    def run(batches):
        import pyarrow as pa
        known: dict = {}
        conv, held, done = None, [], []

        def close():
            turns = [p for p in held if p["turn_1"] is not None]
            distinct = sum(p["turns"] for p in turns) - sum(
                a["turn_2"] == b["turn_1"] for a, b in zip(turns, turns[1:]))
            gaps = turns[-1]["turn_2"] - turns[0]["turn_1"] + 1 - distinct if turns else 0
            between = sum((a["kind_2"], b["kind_1"]) not in LEGAL for a, b in zip(held, held[1:]))
            key = tuple(p["symbols"] for p in held)
            if key not in known:
                if len(known) >= KNOWN:
                    known.clear()
                known[key] = solved(rules, [np.frombuffer(k, dtype=np.uint16).tolist() for k in key])
            sums = [sum(p[f] for p in held) for f in ("blank", "duplicate", "truncated", "illegal")]
            done.append((conv, gaps, *sums[:3], sums[3] + between, *known[key]))

        def out():
            columns = list(zip(*done)) or [()] * 8
            kinds = [pa.string()] + [pa.int64()] * 6 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["conv", *FIGURES, "audit"])

        for batch in batches:
            for piece in batch.to_pylist():
                if held and piece["conv"] != conv:
                    close()
                    held = []
                conv = piece["conv"]
                held.append(piece)
            if len(done) >= 4096:
                yield out()
                done = []
        if held:
            close()
        yield out()

    ordered = cut.repartition("conv").sortWithinPartitions("conv", "slab", "piece")
    return ordered.mapInArrow(run, "conv string, " + ", ".join(f"{f} long" for f in FIGURES) + ", audit string")


def edited(rows: DataFrame, audited: DataFrame, hashed: bool) -> DataFrame:
    """The repaired rows (conv, place, role, text), or per conversation the hash of them.

    A conversation's audit stands before its rows, which are read once, in order.
    """
    text = named(rows).withColumn("kind", F.lit(1))
    first = audited.select(
        "conv", F.lit(None).cast(text.schema["at"].dataType).alias("at"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("kind"))
    laid = (text.unionByName(first).repartition("conv").sortWithinPartitions("conv", "kind", "at", "role", "key")
            .select("conv", "kind", "role", "text"))

    def run(batches):
        import pyarrow as pa
        conv, audit, at, state, place, digest, done = None, "", 0, 0, 0, None, []

        def put(role, text):
            nonlocal place
            if hashed:
                digest.update((("\n" if place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            else:
                done.append((conv, place, role, text))
            place += 1

        def inserted():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, turned(state)
                put("user" if state == AFTER_U else "assistant", "")

        def close():
            inserted()
            if hashed:
                done.append((conv, digest.hexdigest()))

        def out():
            width = 2 if hashed else 4
            kinds = [pa.string(), pa.string()] if hashed else [pa.string(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*done)) or [()] * width
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                              names=["conv", "hash"] if hashed else ["conv", "place", "role", "text"])

        for batch in batches:
            for c, kind, role, text in zip(*[batch.column(k).to_pylist() for k in ("conv", "kind", "role", "text")]):
                if kind == 0:
                    if conv is not None:
                        close()
                    conv, audit, at, state, place, digest = c, text, 0, 0, 0, hashlib.sha256()
                    continue
                inserted()
                letter, at = audit[at], at + 1
                if letter == "K":
                    state = AFTER_S if role[:1] == "s" else turned(state)
                    put(role, text)
                elif letter == "R":
                    state = turned(state)
                    put("user" if state == AFTER_U else "assistant", text)
            yield out()
            done = []
        if conv is not None:
            close()
        yield out()

    return laid.mapInArrow(run, "conv string, hash string" if hashed else
                           "conv string, place long, role string, text string")


def audited(rows: DataFrame, rounds: int = 5) -> tuple[DataFrame, grammar.Rules]:
    """(conv, FIGURES, audit) of every conversation that has rows, and the rules learned."""
    cut = written(pieces(thin(rows)), "conversation-pieces")
    rewritten, rules = grammar.repair(cut, TERMINALS, rounds)
    return written(audits(rewritten, rules), "conversation-audits"), rules


def repair_conversations(rows: DataFrame, originals: DataFrame, rounds: int = 5) -> DataFrame:
    """One row of each conv_id of originals: FIGURES, audit, repaired_sha256 of rows (conv_id, turn, role, text)."""
    found, _ = audited(rows, rounds)
    hashes = edited(rows, found, hashed=True)
    every = originals.select("conv_id", conversation()).distinct()
    return (every.join(found, "conv", "left").join(hashes, "conv", "left").select(
        "conv_id", *[F.coalesce(f, F.lit(0).cast("long")).alias(f) for f in FIGURES],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("hash", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))


def repaired_rows(rows: DataFrame, rounds: int = 5) -> DataFrame:
    """The repaired conversations themselves: conv_id as text, place, role, text."""
    found, _ = audited(rows, rounds)
    return edited(rows, found, hashed=False).withColumnRenamed("conv", "conv_id")
