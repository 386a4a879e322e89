"""Compare registered queries with their SQL on DuckDB. Run as a script: python tests/oracle.py SF_DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def kind(dtype) -> str:
    return {"i": "number", "u": "number", "f": "float", "b": "bool", "M": "time"}.get(getattr(dtype, "kind", "O"), "text")


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)

    def value(x):
        if x is None or (isinstance(x, float) and x != x) or x is pd.NaT:
            return "~"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, (int, float)):
            return f"{float(x) + 0.0:.9g}"
        return str(x)

    return sorted(tuple(value(x) for x in r) for r in df[cols].astype(object).itertuples(index=False))


def compare(spark_df, sql: str, con) -> list[str]:
    got, want = spark_df.toPandas(), con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    problems = []
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    for c in got.columns:
        a, b = got[c].dtype, want[c].dtype
        if kind(a) != kind(b) and len(got) and not (got[c].isna().all() or want[c].isna().all()):
            problems.append(f"type of {c}: {a} != {b}")
    if len(got) == 0:
        problems.append("no rows")
    a, b = rows(got), rows(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        problems.append(f"values differ ({sum(x != y for x, y in zip(a, b))} of {len(a)}): {diff}")
    return problems


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, qs, sqls = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and not any(n in name for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                problems = compare(df, sqls[name], con)
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:
            problems = [f"{type(e).__name__}: {str(e)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - t:.1f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
