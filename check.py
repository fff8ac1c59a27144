"""Run registered queries beside their SQL in DuckDB and compare rows, schema and values.

    python check.py [--sf 0.01] [--module power_queries] [key ...]
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time

import duckdb
import pandas as pd

from stridelake.plans import registry
from stridelake.session import get_spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        kind = str(pdf[c].dtype)
        if kind.startswith("datetime"):
            pdf[c] = pdf[c].astype(str)
        elif kind.startswith("float"):
            pdf[c] = pdf[c].map(lambda v: "∅" if pd.isna(v) else f"{v + 0.0:.9g}")
        else:
            pdf[c] = pdf[c].map(lambda v: "∅" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else
                                (f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)))
        pdf[c] = pdf[c].replace({"NaT": "∅"})
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def compare(spark, con, sf_dir: str, key: str, fn, sql: str | None) -> bool:
    t0 = time.time()
    got = fn(spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in got.schema.fields}
    left = got.toPandas()
    t1 = time.time()
    if sql is None:
        print(f"rows  {key:28s} {len(left):8d} rows  spark {t1 - t0:5.1f}s")
        return True
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    duck = {d[0]: str(d[1]) for d in rel.description}
    right = rel.df()
    t2 = time.time()
    ok = sorted(names) == sorted(left.columns) and len(left) == len(right)
    note = ""
    if ok:
        a, b = canonical(left), canonical(right)
        diff = (a != b).any(axis=1)
        if diff.any():
            ok = False
            bad = [c for c in a.columns if (a[c] != b[c]).any()]
            i = diff.idxmax()
            note = f"{int(diff.sum())} rows differ in {bad}\n   spark {a.loc[i].to_dict()}\n   sql   {b.loc[i].to_dict()}"
    else:
        note = f"columns {sorted(left.columns)} vs {sorted(names)}; rows {len(left)} vs {len(right)}"
    mapped = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE"}
    loose = {c: (types[c], duck[c]) for c in types if c in duck and mapped.get(types[c], duck[c]) != duck[c]}
    if loose:
        note += f"  types: {loose}"
    print(f"{'ok   ' if ok else 'DIFF '} {key:28s} {len(left):8d} rows  spark {t1 - t0:5.1f}s sql {t2 - t1:5.1f}s {note}")
    return ok and not loose


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--module")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    if args.module:
        found = importlib.import_module(f"stridelake.plans.{args.module}").QUERIES
    else:
        sqls = registry.oracle_sql()
        found = {k: (fn, sqls.get(k)) for k, fn in registry.queries().items()}
    if args.keys:
        found = {k: v for k, v in found.items() if k in args.keys}
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                             "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = []
    for key, (fn, sql) in found.items():
        try:
            if not compare(spark, con, sf_dir, key, fn, sql):
                bad.append(key)
        except Exception as e:  # report and go on to the next key
            bad.append(key)
            print(f"FAIL  {key}: {type(e).__name__} {str(e)[:1500]}")
    print(f"{len(found) - len(bad)}/{len(found)} ok; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
