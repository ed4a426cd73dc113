"""Runs registered queries next to their SQL and compares the two results."""

from __future__ import annotations

import sys
import tempfile
import threading
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "~"
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6f}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns differ: {sorted(set(spark_df.columns) ^ set(sql_df.columns))}"
    a, b = canonical(spark_df), canonical(sql_df)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if not bad:
        return None
    x, y = bad[0]
    cols = sorted(spark_df.columns)
    cells = [(c, p, q) for c, p, q in zip(cols, x, y) if p != q]
    return f"{len(bad)} rows differ, first: {cells[:6]}"


def main() -> int:
    import __spark_entry__ as entry
    from paceline.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = get_spark(master="local[8]", shuffle_partitions=8, checkpoint_dir=tempfile.mkdtemp(prefix="compare-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            got = fn(spark, sf).toPandas()
            spent = time.time() - t
            if name in oracle:
                u = time.time()
                stop = threading.Timer(60, con.interrupt)
                stop.start()
                want = con.execute(oracle[name]).df()
                stop.cancel()
                why = difference(got, want)
                state = "ok" if why is None else f"FAIL {why}"
                dt = f" sql {time.time() - u:.2f}s"
                kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if c in want.columns and str(got[c].dtype) != str(want[c].dtype)}
                if kinds:
                    dt += f" types {kinds}"
            else:
                why, state, dt = None, "rows only", ""
            print(f"{name:28s} {len(got):7d} rows {spent:6.2f}s{dt} {state}", flush=True)
        except Exception as e:  # noqa: BLE001
            why = str(e)
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:1500]}", flush=True)
        failed += why is not None
    print("failed:", failed, "without SQL:", sorted(set(queries) - set(oracle)), "without query:", sorted(set(oracle) - set(queries)))
    return failed


if __name__ == "__main__":
    sys.exit(main())
