"""Differential check: run a registered Spark query and its DuckDB oracle, compare results.

Comparison is order-insensitive over rows, by sorted column names; floats are
compared after rounding to 6 decimals, NULL and NaN are equal.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys

from lodestar.plans.fixtures import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, name: str, fn, sql: str, sf_dir: str, con=None) -> dict:
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(sql)
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    res = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "cols_match": sorted(s_cols) == sorted(d_cols)}
    if not res["cols_match"]:
        res["spark_cols"], res["duck_cols"] = s_cols, d_cols
        res["match"] = False
        return res
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    res["match"] = a == b
    if not res["match"]:
        sa, sb = set(map(repr, a)), set(map(repr, b))
        res["only_spark"] = sorted(sa - sb)[:3]
        res["only_duck"] = sorted(sb - sa)[:3]
        res["cols"] = sorted(s_cols)
    return res


def main(argv):
    from lodestar.plans.catalog import QUERIES
    from lodestar.session import local_session
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in names:
        fn, sql = QUERIES[n]
        if sql is None:
            rows = fn(spark, sf).count()
            print(f"ROWS-ONLY {n}: {rows}")
            continue
        try:
            r = compare(spark, n, fn, sql, sf, con)
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:600]}")
            continue
        ok = r["match"]
        bad += not ok
        print(("OK   " if ok else "FAIL ") + n, {k: v for k, v in r.items() if k not in ("name", "match")})
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
