"""Run registered queries of the llm subpackage and compare with their SQL: NAME... [SF_DIR]."""

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


def views(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(frame, con, sql):
    """(rows, None) or (rows, what differs)."""
    got = sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    if sorted(names) != sorted(frame.columns):
        return len(got), f"columns {frame.columns} {names}"
    bad = [x for x in zip(got, want) if x[0] != x[1]]
    return len(got), None if not bad and len(got) == len(want) else f"{len(want)} wanted, {bad[:2]}"


def main(args):
    from tickwright.llm.queries import ORACLE_SQL, QUERIES
    from tickwright.session import local_session
    sf_dir = args.pop() if args and "/" in args[-1] else "/root/testdata/sf0.01"
    spark = local_session("8", 8, "llm")
    con = views(sf_dir)
    for name in args or QUERIES:
        began = time.time()
        frame = QUERIES[name](spark, sf_dir)
        if name in ORACLE_SQL:
            print(name, *differences(frame, con, ORACLE_SQL[name]), f"{time.time() - began:.1f}s", flush=True)
        else:
            rows = frame.collect()
            print(name, len(rows), rows[:3], f"{time.time() - began:.1f}s", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
