"""Run registered queries against their SQL in DuckDB: python tests/compare.py [name or prefix*] ..."""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    import datetime
    import decimal
    import math

    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(plain(x) for x in v.values()) + "}"
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return repr(v)


def near(a: str, b: str) -> bool:
    """Numbers that differ by one in the last place they were rounded to, as sums in another order may."""
    try:
        x, y = float(a), float(b)
    except ValueError:
        return False
    return abs(x - y) <= 1.1e-5 + 1e-9 * abs(x)


def differences(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty if the rows are equal in any order."""
    df = query(spark, sf_dir)
    got_cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in got_cols) for r in df.collect())
    rel = con.sql(sql)
    cols = rel.columns
    if sorted(cols) != got_cols:
        return f"columns {got_cols} and {sorted(cols)}"
    order = [cols.index(c) for c in got_cols]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}; first {got[:1]} and {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b and not all(x == y or near(x, y) for x, y in zip(a, b))]
    return f"{len(bad)} of {len(got)} rows differ, as {bad[0]}" if bad else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = duck(sf), e.queries(), e.oracle_sql()
    names = [n for n in q if not sys.argv[1:] or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in sys.argv[1:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            if n in o:
                said = differences(spark, con, q[n], o[n], sf)
                bad += bool(said)
            else:
                said = f"{len(q[n](spark, sf).collect())} rows, no SQL"
        except Exception as x:
            bad += 1
            lines = [y for y in str(x).splitlines() if y.strip()]
            said = f"ERROR {type(x).__name__} {' '.join(lines[:3])[:600]}"
        print(f"{n}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print(f"{len(names)} queries, {bad} bad")
