"""Compare registered queries with their SQL, sorted by all columns; also usable from the shell."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(object)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float) + 0.0
        else:
            df[c] = ["" if v is None or v is pd.NA or v != v else str(v) for v in df[c]]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    for c in a.columns:
        if a[c].dtype == float and b[c].dtype == float:
            same = np.isclose(a[c], b[c], rtol=0, atol=1e-12, equal_nan=True)
        else:
            same = (a[c].astype(str) == b[c].astype(str)).to_numpy()
        if not same.all():
            i = int(np.argmin(same))
            return f"{(~same).sum()} values differ in {c}, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from gridloom.session import get_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = get_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        try:
            t0 = time.time()
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name not in oracles:
                print(f"ROWS {name} {len(got)} {t1 - t0:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            t2 = time.time()
            problem = difference(got, want)
            print(f"{'OK  ' if problem is None else 'DIFF'} {name} rows={len(got)} spark={t1 - t0:.1f}s sql={t2 - t1:.1f}s "
                  f"{problem or ''}"[:700], flush=True)
        except Exception as e:
            print(f"FAIL {name} {type(e).__name__}: {str(e)[:600]}", flush=True)
