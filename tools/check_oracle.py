"""Run registered queries on Spark and their oracle on DuckDB and compare the rows.

Usage: python tools/check_oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from rankloom import catalog  # noqa: E402
from rankloom.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (dt.datetime, dt.date)):
        return value.replace(tzinfo=None).isoformat() if isinstance(value, dt.datetime) else value.isoformat()
    return ("other", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name):
    """None if equal, else a description of the difference."""
    started = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    bad = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant", "binary")]
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in catalog.ORACLES:
        return (f"rows only: {len(got)}" if got else "EMPTY"), took, None
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} duck={sorted(columns)}", took, False
    if bad:
        return f"NESTED {bad}", took, False
    if got != want:
        a, b = [r for r in got if r not in want][:3], [r for r in want if r not in got][:3]
        return f"ROWS spark={len(got)} duck={len(want)} cols={sorted(columns)}\n   only spark {a}\n   only duck  {b}", took, False
    return f"ok {len(got)} rows" + ("" if got else " EMPTY"), took, True


def main():
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    catalog.load()
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    wrong = 0
    for name in catalog.QUERIES:
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            message, took, ok = compare(spark, con, sf_dir, name)
        except Exception as exc:  # noqa: BLE001
            message, took, ok = "ERROR " + str(exc)[:900], 0.0, False
        wrong += ok is False
        print(f"{'FAIL' if ok is False else '----' if ok is None else 'pass'} {name} {took:.2f}s {message}", flush=True)
    print("failures:", wrong)


if __name__ == "__main__":
    main()
