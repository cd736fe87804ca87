"""Run registered queries next to their SQL and report differences."""

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def compare(check, spark, con, sf_dir):
    """(row count, None) when equal, else (row count, what differs)."""
    df = check.frame(spark, sf_dir)
    got = sorted((tuple(r) for r in df.collect()), key=_key)
    sql = check.oracle()
    if sql is None:
        return len(got), None
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall(), key=_key)
    if names != df.columns:
        return len(got), f"columns {df.columns} vs {names}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}: {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return len(got), (f"{len(bad)} rows differ: {bad[:2]}" if bad else None)


def main():
    from tickwright.plans.registry import CHECKS
    from tickwright.session import local_session
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(CHECKS)
    spark, con, failed = local_session(), connect(sf_dir), 0
    for name in names:
        began = time.time()
        try:
            n, problem = compare(CHECKS[name], spark, con, sf_dir)
        except Exception as exc:
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:900]}"
        failed += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {n:7d} rows {time.time() - began:6.2f}s"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{len(names)} checked, {failed} failed")


if __name__ == "__main__":
    main()
