"""Run registered Spark queries and their DuckDB oracles side by side; report matches.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]   (env ORACLE_SESSION_TZ: Spark session zone)
Compares row count, column names, and an order-insensitive multiset of rows.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fundflow import catalog  # noqa: E402
from fundflow.session import get_spark  # noqa: E402
from fundflow.sources.fixtures import TABLES  # noqa: E402


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "\x00NULL"
        return repr(v)
    if v is None:
        return "\x00NULL"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = sorted(tuple(norm(x) for x in r) for r in pdf[cols].astype(object).itertuples(index=False, name=None))
    return cols, out


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    tz = os.environ.get("ORACLE_SESSION_TZ")  # e.g. America/Los_Angeles: results must not move
    spark = get_spark("local[8]", 8, extra={"spark.sql.session.timeZone": tz} if tz else None)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, oracle = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracle:
            print(f"ROWS {name}: {len(sdf)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            odf = con.sql(oracle[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:400]}")
            bad += 1
            continue
        sc, sr = rows_of(sdf)
        oc, orr = rows_of(odf)
        ok = sc == oc and sr == orr
        if not ok:
            bad += 1
            print(f"FAIL {name}: spark {len(sr)} rows {sc} / oracle {len(orr)} rows {oc}")
            if sc == oc:
                ss, os_ = set(sr), set(orr)
                print("   spark-only:", sorted(ss - os_)[:3])
                print("   oracle-only:", sorted(os_ - ss)[:3])
        else:
            print(f"OK   {name}: {len(sr)} rows {ts:.1f}s")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
