"""Compare registered queries with their SQL twins: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

NAMES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
         "benchmark labels conversations").split()


def engine(sf_dir: str):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{sf_dir}/{n}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


FAMILY = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "long",
          "hugeint": "HUGE", "double": "double", "float": "float", "varchar": "string", "string": "string",
          "date": "date", "timestamp": "ts", "timestamp_ntz": "ts", "boolean": "boolean"}


def compare(spark, con, q, sf_dir, frame=None):
    df = frame if frame is not None else q(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    return df, got_cols, got


def check(spark, con, name, run, sql, sf_dir):
    begin = time.time()
    df = run(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - begin
    if sql is None:
        return f"rows-only {len(got)} rows", took, True
    res = con.execute(sql)
    wcols, want = rows_of([d[0] for d in res.description], res.fetchall())
    if cols != wcols:
        return f"COLUMNS {cols} != {wcols}", took, False
    st = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dt = {r[0]: r[1].lower() for r in con.execute("DESCRIBE " + sql).fetchall()}
    odd = [(c, st[c], dt[c]) for c in cols if FAMILY.get(st[c], st[c]) != FAMILY.get(dt[c], dt[c])
           and not st[c].startswith("array")]
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}", took, False
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"VALUES {len(bad)} of {len(got)} differ, first\n    {bad[0][0]}\n    {bad[0][1]}\n    {cols}", took, False
    if not got:
        return "EMPTY result", took, False
    return f"ok {len(got)} rows" + (f" TYPES {odd}" if odd else ""), took, not odd


def main():
    sys.path.insert(0, ".")
    from ridewave.session import local_session
    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    only = sys.argv[2:]
    spark, con = local_session(), engine(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad, total, slow = [], 0, []
    for name, run in qs.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        if os.environ.get("SKIP_ROWS_ONLY") and name not in sqls:
            continue
        total += 1
        try:
            message, took, ok = check(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            message, took, ok = f"ERROR {type(error).__name__} {str(error)[:700]}", 0, False
        if not ok:
            bad.append(name)
        slow.append((took, name))
        if not ok or only:
            print(f"{'   ' if ok else 'BAD'} {name} {took:.1f}s {message}", flush=True)
    print("slowest", [(n, round(t, 1)) for t, n in sorted(slow, reverse=True)[:8]])
    print(f"{total - len(bad)} of {total} good; bad: {bad}")


if __name__ == "__main__":
    main()
