"""Runs registered queries on Spark and on DuckDB and compares names, types and all values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time

import duckdb

from workload.tables import NAMES

TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "smallint": "SMALLINT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v if v is None else str(v)


def order(row):
    return tuple((c is not None, c or "") for c in row)


def differences(spark_df, con, sql: str) -> list[str]:
    got_names = sorted(spark_df.columns)
    rows = spark_df.select(*[f"`{c}`" for c in got_names]).collect()
    cur = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cur.description}
    expected_rows = cur.fetchall()
    names = [d[0] for d in cur.description]
    problems = []
    if sorted(names) != got_names:
        return [f"columns {got_names} != {sorted(names)}"]
    kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema}
    for c in got_names:
        if TYPES.get(kinds[c], kinds[c]) != described[c]:
            problems.append(f"type of {c}: {kinds[c]} != {described[c]}")
    place = [names.index(c) for c in got_names]
    got = sorted((tuple(cell(v) for v in r) for r in rows), key=order)
    want = sorted((tuple(cell(r[i]) for i in place) for r in expected_rows), key=order)
    if len(got) != len(want):
        problems.append(f"{len(got)} rows != {len(want)}")
    if got != want:
        only_got, only_want = sorted(set(got) - set(want), key=order), sorted(set(want) - set(got), key=order)
        problems.append(f"values: {len(only_got)} only in Spark, {len(only_want)} only in SQL, e.g. {str(only_got[:2])[:700]} / {str(only_want[:2])[:700]}")
    return problems


def main(sf_dir: str, wanted: list[str]) -> int:
    from askspark.session import local_session
    from workload import registry

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), 0
    for name, fn in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in registry.ORACLES:
                problems = differences(df, con, registry.ORACLES[name])
                note = "ok"
            else:
                problems, note = [], f"rows only: {df.count()}"
        except Exception as error:
            problems, note = [f"{type(error).__name__}: {str(error)[:900]}"], ""
        failed += bool(problems)
        print(f"{time.time() - start:6.1f}s {name}: {problems or note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
