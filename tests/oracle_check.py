"""Run registered queries against their DuckDB oracles (driver-style check).

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def compare(spark, sf_dir, keys=None, verbose=True):
    import __spark_entry__ as E
    qs, ors = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for k in (keys or sorted(qs)):
        if k not in ors:
            t = time.time()
            n = qs[k](spark, sf_dir).count()
            results[k] = ("rows-only", n, None, time.time() - t)
            if verbose:
                print(f"{k:32s} rows-only n={n} {time.time()-t:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            sdf = qs[k](spark, sf_dir)
            cols = sorted(sdf.columns)
            srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
        except Exception as e:  # noqa: BLE001
            results[k] = ("SPARK-ERROR", 0, 0, 0)
            print(f"{k:32s} SPARK-ERROR {str(e).splitlines()[0][:300]}", flush=True)
            continue
        ts = time.time() - t
        try:
            rel = con.execute(ors[k])
        except Exception as e:  # noqa: BLE001
            results[k] = ("DUCK-ERROR", 0, 0, 0)
            print(f"{k:32s} DUCK-ERROR {str(e).splitlines()[0][:300]}", flush=True)
            continue
        dcols = [d[0] for d in rel.description]
        drows_raw = rel.fetchall()
        idx = [dcols.index(c) if c in dcols else None for c in cols]
        ok_cols = sorted(dcols) == cols
        drows = sorted((tuple(norm(r[i]) if i is not None else None for i in idx) for r in drows_raw), key=repr)
        ok = ok_cols and srows == drows
        results[k] = ("ok" if ok else "MISMATCH", len(srows), len(drows), ts)
        if verbose:
            print(f"{k:32s} {'ok' if ok else 'MISMATCH'} spark={len(srows)} duck={len(drows)} {ts:.1f}s", flush=True)
            if not ok:
                if not ok_cols:
                    print("   cols spark:", cols, "duck:", sorted(dcols))
                diff_s = [r for r in srows if r not in set(drows)][:3]
                diff_d = [r for r in drows if r not in set(srows)][:3]
                print("   spark-only:", diff_s)
                print("   duck-only: ", diff_d)
    return results


if __name__ == "__main__":
    from grantlens.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, keys)
    bad = [k for k, v in res.items() if v[0] not in ("ok", "rows-only")]
    print("MISMATCHES:", bad)
