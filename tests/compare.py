"""Run named queries and their check SQL side by side: python tests/compare.py [sf] [prefix ...]"""
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got[1]), None
    cur = con.execute(sql)
    want = sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return len(got[1]), f"rows {len(got[1])} != {len(want[1])}; got {got[1][:2]} want {want[1][:2]}"
    for g, w in zip(got[1], want[1]):
        if g != w:
            n = sum(a != b for a, b in zip(got[1], want[1]))
            return len(got[1]), f"{n} rows differ: {got[0]} got {g} want {w}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    duck = dict(zip([d[0] for d in cur.description], [str(d[1]) for d in cur.description]))
    odd = [(c, types[c], duck[c]) for c in types if SAME.get(types[c]) != duck[c]]
    return len(got[1]), f"types {odd}" if odd else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from genoloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, sf_dir = local_session(8), f"/root/testdata/{sf}"
    con, checks, bad = connect(sf_dir), entry.oracle_sql(), 0
    total = time.time()
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            n, err = compare(spark, con, sf_dir, name, fn, checks.get(name))
        except Exception as e:  # report and go on
            n, err = -1, f"{type(e).__name__}: {str(e)[:700]}"
        bad += err is not None
        flag = "BAD" if err else ("ok " if name in checks else "ok (no sql)")
        print(f"{flag} {name} rows={n} {time.time() - start:.1f}s {err or ''}", flush=True)
    print(f"bad={bad} total={time.time() - total:.0f}s")
