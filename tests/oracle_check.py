"""Compare registered queries with their SQL on DuckDB.

    python tests/oracle_check.py [name-part ...]     (CHECK_SF=0.01 by default)
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(value):
    import datetime
    import decimal

    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if value != value else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    data = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(data, key=repr)


def compare(spark, con, name, sf_dir, queries, oracles):
    """Return a list of differences (empty when both sides agree)."""
    df = queries[name](spark, sf_dir)
    got_cols, got = rows_of(df.columns, df.collect())
    if name not in oracles:
        return [] if got else ["no rows"]
    cur = con.execute(oracles[name])
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"{len(got)} rows, expected {len(want)}", f"{got[:2]} / {want[:2]}"]
    if not got:
        return ["both empty"]
    bad = [(g, w) for g, w in zip(got, want) if g != w or repr(g) != repr(w)]
    return [f"{len(bad)} of {len(got)} rows differ", *[f"{g}\n      {w}" for g, w in bad[:3]]] if bad else []


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tallywork.session import local_session

    sf_dir = f"/root/testdata/sf{os.environ.get('CHECK_SF', '0.01')}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not sys.argv[1:] or any(p in n for p in sys.argv[1:])]
    failed = 0
    for name in wanted:
        begin = time.time()
        try:
            problems = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as exc:  # show every query, whatever one of them does
            problems = [f"{type(exc).__name__}: {str(exc)[:700]}"]
        failed += bool(problems)
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problems else 'ok  '} {kind:4} {time.time() - begin:6.1f}s {name}", flush=True)
        for p in problems:
            print("      " + p)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
