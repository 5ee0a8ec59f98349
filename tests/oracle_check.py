"""Run registered Spark queries and their DuckDB oracles side by side.

    python tests/oracle_check.py [sf_dir] [key ...]

Compares row count, column names and an order-insensitive hash of the
values (columns sorted by name), the way the round driver does.
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    try:
        if isinstance(v, float) and math.isnan(v):
            return None
    except TypeError:
        pass
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def frame_digest(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")]
    rows = sorted(repr(r) for r in rows)
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return cols, len(rows), h, rows


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from corpusprep.session import local_session

    spark = local_session(8)
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    keys = keys or sorted(qs)
    bad = 0
    for k in keys:
        t0 = time.time()
        try:
            sp = qs[k](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in orc:
            print(f"ROWS {k}: {len(sp)} rows (no oracle) {ts:.1f}s")
            continue
        t1 = time.time()
        try:
            dk = con.execute(orc[k]).df()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {k}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        td = time.time() - t1
        c1, n1, h1, r1 = frame_digest(sp)
        c2, n2, h2, r2 = frame_digest(dk)
        if (c1, n1, h1) == (c2, n2, h2):
            print(f"OK   {k}: {n1} rows spark {ts:.1f}s duck {td:.1f}s")
        else:
            bad += 1
            print(f"FAIL {k}: cols {c1} vs {c2}; rows {n1} vs {n2}")
            s1, s2 = set(r1), set(r2)
            print("   spark-only:", sorted(s1 - s2)[:3])
            print("   duck-only: ", sorted(s2 - s1)[:3])
    print(f"{len(keys) - bad}/{len(keys)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
