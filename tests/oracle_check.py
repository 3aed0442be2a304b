"""Run registered queries next to their SQL and compare the rows.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
        return None
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return _plain(v.item())
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    rows = [tuple(_plain(v) for v in r) for r in pdf.itertuples(index=False)]
    return sorted(rows, key=repr)


KINDS = {"bigint": "int64", "long": "int64", "int": "int32", "double": "float64", "string": "object", "boolean": "bool"}


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, sf)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, {t1 - t0:.1f}s (rows only)"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = pd.DataFrame(res.fetchall(), columns=cols)
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    if sorted(got.columns) != sorted(cols):
        return False, f"columns {sorted(got.columns)} vs {sorted(cols)}"
    spark_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    pairs = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    odd = {c: (spark_types[c], types[c]) for c in cols if pairs.get(spark_types[c]) != types[c]}
    if odd:
        note += f" TYPES {odd}"
    a, b = rows_of(got), rows_of(want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return False, f"{note}; {len(a)} vs {len(b)}; spark only {only_a}; sql only {only_b}"
    return True, note


def main() -> None:
    import __spark_entry__ as e
    from notemill.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    names = [n for n in queries if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)]
    bad = 0
    for n in names:
        try:
            ok, note = compare(spark, con, sf, n, queries[n], oracles.get(n))
        except Exception as ex:  # noqa: BLE001
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", n, note[:1500], flush=True)
    print(f"{len(names) - bad}/{len(names)} match")


if __name__ == "__main__":
    main()
