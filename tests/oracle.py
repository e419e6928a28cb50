"""Runs registered queries against their SQL in DuckDB and reports differences.

python tests/oracle.py [name-prefix ...] [--sf sf0.01]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when equal as multisets of rows, columns sorted by name."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    cols = sorted(got.columns)
    a, b = _norm(got[cols]), _norm(want[cols])
    order = sorted(cols, key=lambda c: (a[c].dtype == float, c))
    a = a.sort_values(order, na_position="last").reset_index(drop=True)
    b = b.sort_values(order, na_position="last").reset_index(drop=True)
    bad = []
    for c in cols:
        ne = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if ne.any():
            i = ne.idxmax()
            bad.append(f"{c}: {int(ne.sum())} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}")
    kinds = [f"{c}: {a[c].dtype} vs {b[c].dtype}" for c in cols if a[c].dtype != b[c].dtype]
    return "; ".join(bad[:6] + kinds[:3])


def _norm(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in df.columns:
        v = df[c]
        if v.dtype == object or str(v.dtype) in ("str", "string"):
            v = v.map(lambda x: None if x is None else (list(x) if hasattr(x, "tolist") else x))
            first = next((x for x in v if x is not None), None)
            if isinstance(first, list):
                v = v.map(str)
        elif str(v.dtype).startswith(("Int", "int", "uint", "UInt")):
            v = v.astype("float64") if v.isna().any() else v.astype("int64")
        elif str(v.dtype).startswith(("float", "Float")):
            v = v.astype("float64")
        out[c] = v
    return pd.DataFrame(out)


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = args[args.index("--sf") + 1] if "--sf" in args else "sf0.01"
    wanted = [a for i, a in enumerate(args) if not a.startswith("--") and (i == 0 or args[i - 1] != "--sf")]
    folder = f"/root/testdata/{sf}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toPandas()
            t1 = time.time()
            if name not in sqls:
                print(f"rows  {name:<40} {len(got):>8} {t1 - t0:6.1f}s (no SQL)", flush=True)
                continue
            want = con.execute(sqls[name]).df()
            msg = compare(got, want)
        except Exception as ex:  # report and go on to the next query
            msg, got, t1 = f"{type(ex).__name__}: {str(ex)[:700]}", [], time.time()
        failed += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '}  {name:<40} {len(got):>8} {t1 - t0:6.1f}s {time.time() - t1:5.1f}s {msg}", flush=True)
    print(f"{failed} failed")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
