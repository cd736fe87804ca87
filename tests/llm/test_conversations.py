import hashlib
import random
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from tickwright.llm import conversations, grammar
from tickwright.llm.queries import QUERIES, damaged

ROWS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain(rows, originals):
    """Figures of every conversation by a search over rows and states."""
    out = []
    for conv in {r[0] for r in originals}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, *_ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))

        @lru_cache(maxsize=None)
        def best(i, state, free):
            """(cost, audit, roles) of what follows; free rows may still be inserted here."""
            ways = []
            after = "a" if state == "u" else "u"
            if free:
                cost, audit, made = best(i, after, free - 1)
                ways.append((cost + 3, "I" + audit, ((after, None), *made)))
            if i == len(own):
                if state in ("", "a"):
                    ways.append((0, "", ()))
            else:
                cost, audit, made = best(i + 1, state, 3)
                ways.append((cost + 4, "D" + audit, made))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 * (faults[i] == "truncated")
                    cost, audit, made = best(i + 1, after, 3)
                    ways.append((cost + 3 + more, "R" + audit, ((after, i), *made)))
                    if initials[i] == after:
                        ways.append((cost + more, "K" + audit, (("", i), *made)))
                    if initials[i] == "s" and state == "":
                        cost, audit, made = best(i + 1, "s", 3)
                        ways.append((cost + more, "K" + audit, (("", i), *made)))
            return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

        cost, audit, made = best(0, "", 3) if own else (0, "", ())
        name = {"u": "user", "a": "assistant"}
        text = "\n".join(f"{name[r] if r else own[i][1]}:{'' if i is None else own[i][2]}" for r, i in made)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def answers(frame):
    return sorted((tuple(r) for r in frame.select("conv_id", *conversations.FIGURES, "audit", "repaired_sha256").collect()),
                  key=str)


def made_up(seed, n):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((conv, pick.choice([turn, turn, turn + 1]),
                         pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", ""]),
                         pick.choice(["Yes.", "No", "  ", "", "Why? ", "Go!", f"t{turn}."])))
    return rows


def test_against_a_search_over_rows_and_states(spark, monkeypatch):
    rows = made_up(1, 120)
    frame = spark.createDataFrame(rows, ROWS)
    want = plain(rows, rows)
    assert answers(conversations.repair_conversations(frame, frame)) == want
    assert answers(conversations.repair_conversations(frame, frame, rounds=0)) == want
    monkeypatch.setattr(conversations, "PIECE", 3)           # a conversation over several pieces
    assert answers(conversations.repair_conversations(frame, frame)) == want


def test_nulls_copies_clashing_columns_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1, None, "assistant", "A."),
            (1, 3, None, "b"), (1, 7, "user", None), (2, 1, "user", "x" * 40_000 + "."), (2, 2, "assistant", "é 語?"),
            (3, 5, "system", "Only."), (4, None, "user", "q\x00.")]
    frame = spark.createDataFrame(rows, ROWS)
    known = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    odd = frame
    for name in ("conv", "at", "key", "kind", "n", "hash", "audit", "place"):
        odd = odd.withColumn(name, F.lit("odd"))
    assert answers(conversations.repair_conversations(odd, odd)) == plain(known, rows)
    lost = answers(conversations.repair_conversations(frame.filter("conv_id = 1"), frame))
    assert lost == plain([r for r in known if r[0] == 1], rows)
    assert answers(conversations.repair_conversations(frame.filter("false"), frame.filter("false"))) == []


def test_repaired_rows(spark):
    rows = [(1, 1, "assistant", "A."), (1, 2, "assistant", "B."), (1, 3, "user", " ")]
    got = conversations.repaired_rows(spark.createDataFrame(rows, ROWS)).orderBy("place").collect()
    assert [(r.role, r.text) for r in got] == [("user", "A."), ("assistant", "B.")]


def test_rewriting_takes_pairs_from_the_left():
    import numpy as np
    raws = [np.array(s, dtype=np.uint16).tobytes() for s in ([1, 1, 1, 2], [1], [], [1, 1, 1, 1])]
    got = grammar.joined(raws, [(1, 1), (9, 2)], 9).tolist()
    assert got == [9, 1, 2, 65535, 1, 65535, 65535, 9, 9, 65535]
    assert grammar.joined(raws[:1], [(1, 2)], 9).tolist() == [1, 1, 9, 65535]


def test_query(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select(*[c.split()[0] for c in ROWS.split(", ")]).collect()]
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in damaged(spark.read.parquet(f"{path}/conversations.parquet")).collect())
    assert got == sorted(damage(rows))
    assert answers(QUERIES["op13_conversation_repair"](spark, path)) == plain(damage(rows), rows)
