"""Compare registered queries with their SQL: ``python -m checks.compare [--sf DIR] [key ...]``."""

from __future__ import annotations

import argparse
import glob
import math
import os
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import SQL
from checks.registry import QUERIES
from checks.scratch import ensure_scratch


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if hasattr(x, "item"):
        return _plain(x.item())
    return x


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


_KIND = {"tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "integer": "int", "hugeint": "int",
         "double": "double", "decimal": "decimal", "string": "text", "varchar": "text", "boolean": "bool"}


def _kind(name: str) -> str:
    return _KIND.get(name.lower().split("(")[0], name.lower())


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, sf_dir: str, key: str) -> str | None:
    """None if equal, else what differs."""
    df = QUERIES[key](spark, sf_dir)
    cur = con.execute(SQL[key])
    want_names = [d[0] for d in cur.description]
    want_kinds = {d[0]: _kind(str(d[1])) for d in cur.description}
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} != {sorted(want_names)}"
    got_kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    kinds = {n: (got_kinds[n], want_kinds[n]) for n in want_names if got_kinds[n] != want_kinds[n]}
    got, want = _rows(df.columns, df.collect()), _rows(want_names, cur.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "no rows"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return f"types {kinds}" if kinds else None


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    ensure_scratch(spark).sparkContext.setLogLevel("ERROR")
    con, bad = connect(args.sf), 0
    for key in args.keys or QUERIES:
        if key not in SQL:
            print(f"{key:32s} no SQL, {QUERIES[key](spark, args.sf).count()} rows", flush=True)
            continue
        start = time.time()
        try:
            problem = compare(spark, con, args.sf, key)
        except Exception as e:  # noqa: BLE001 - the run goes on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{key:32s} {'ok' if problem is None else problem}  [{time.time() - start:.1f}s]", flush=True)
    print(f"{bad} differ; SQL without query: {sorted(set(SQL) - set(QUERIES))}")


if __name__ == "__main__":
    main()
