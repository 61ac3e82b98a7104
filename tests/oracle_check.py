"""Compare ``queries()`` with ``oracle_sql()`` the way the driver does.

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from flowwatch.session import build_session  # noqa: E402
from flowwatch.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    spark = build_session("local[8]")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            scols = df.columns
            srows = df.collect()
            t1 = time.time()
            if k not in sql:
                print(f"{k:28s} rows-only {len(srows):8d}  spark {t1-t0:6.1f}s")
                continue
            res = con.execute(sql[k])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
            ok_cols = sorted(scols) == sorted(ocols)
            a, b = _rows(srows, scols), _rows(orows, ocols)
            ok = ok_cols and a == b
            extra = ""
            if not ok:
                bad += 1
                if not ok_cols:
                    extra = f" cols spark={sorted(scols)} oracle={sorted(ocols)}"
                else:
                    sa, sb = set(a), set(b)
                    extra = f" only-spark={list(sa - sb)[:2]} only-oracle={list(sb - sa)[:2]}"
            print(f"{k:28s} {'OK ' if ok else 'BAD'} spark={len(srows):7d} oracle={len(orows):7d} "
                  f"spark {t1-t0:6.1f}s{extra}", flush=True)
        except Exception as exc:  # report and continue
            bad += 1
            print(f"{k:28s} ERR {type(exc).__name__}: {str(exc)[:400]}", flush=True)
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
