"""Run every registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

import duckdb

from clipgrove import workload
from clipgrove.fixtures import TABLES
from clipgrove.session import local_session


def kind(dtype) -> str:
    text = str(dtype).lower()
    for name, words in {"bool": ("bool",), "float": ("double", "float", "decimal"), "int": ("int", "long", "short"),
                        "str": ("str", "varchar", "object")}.items():
        if any(w in text for w in words):
            return name
    return text


def rows(cols, records, kinds):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in records:
        row = []
        for i in order:
            v = r[i]
            row.append(v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark, con, name, sf):
    t = time.time()
    df = workload.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if name not in workload.SQL:
        return f"rows-only {len(got)}", spent, len(got) > 0
    t = time.time()
    res = con.sql(workload.SQL[name])
    want = res.fetchall()
    duck = time.time() - t
    a, b = sorted(df.columns), sorted(res.columns)
    if a != b:
        return f"columns {a} vs {b}", spent, False
    ka = {c: kind(d) for c, d in df.dtypes}
    kb = {c: kind(d) for c, d in zip(res.columns, res.types)}
    huge = [c for c, d in zip(res.columns, res.types) if "HUGE" in str(d) or "UBIG" in str(d)]
    if huge:
        return f"huge ints in oracle: {huge}", spent, False
    if ka != kb:
        return f"types {[(c, ka[c], kb[c]) for c in a if ka[c] != kb[c]]}", spent, False
    ra, rb = rows(df.columns, got, ka), rows(res.columns, want, kb)
    if len(ra) != len(rb):
        return f"count {len(ra)} vs {len(rb)}", spent, False
    for x, y in zip(ra, rb):
        if x != y:
            return f"row {a}\n   spark {x}\n   duck  {y}", spent, False
    return f"ok {len(ra)} (duck {duck:.1f}s)" + (" EMPTY" if not ra else ""), spent, len(ra) > 0


def main():
    sf = "/root/testdata/sf0.01"
    args = [a for a in sys.argv[1:]]
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    workload.load()
    spark = local_session("8")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = [n for n in workload.QUERIES if not args or any(n.startswith(a) or workload.QUERIES[n].__module__.endswith("." + a) for a in args)]
    bad = 0
    for n in names:
        try:
            text, spent, ok = compare(spark, con, n, sf)
        except Exception as e:  # report and go on with the next query
            text, spent, ok = "ERR " + str(e)[:700], 0.0, False
        bad += not ok
        print(f"{'  ' if ok else '!!'} {n:38s} {spent:5.1f}s {text}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    spark.stop()


if __name__ == "__main__":
    main()
