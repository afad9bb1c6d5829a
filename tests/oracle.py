"""Run registered queries against their SQL: ``python tests/oracle.py FOLDER [name part ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return "nan" if isinstance(value, float) and math.isnan(value) else round(float(value), 6) + 0.0
    return value


def compare(spark, con, folder: str, function, sql: str | None) -> str:
    df = function(spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    if sql is None:
        return f"rows only, {len(got)} rows" if got else "EMPTY"
    middle = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"COLUMNS {columns} against {sorted(names)}"
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in result.description}
    other = {n: (t, kinds[n]) for n, t in df.dtypes if t != kinds[n]}
    if other:
        return f"TYPES {other}"
    places = [names.index(c) for c in columns]
    want = sorted((tuple(plain(row[i]) for i in places) for row in result.fetchall()), key=repr)
    if got == want:
        return f"ok, {len(got)} rows, sql {time.time() - middle:.1f}s" if got else "EMPTY"
    differing = [(g, w) for g, w in zip(got, want) if g != w][:2]
    return f"DIFFERS: {len(got)} rows against {len(want)}; {str(differing)[:600]}"


def main() -> None:
    from conftest import session

    import __spark_entry__ as entry

    folder, parts = sys.argv[1], sys.argv[2:]
    spark, con, sql = session(), connect(folder), entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            said = compare(spark, con, folder, function, sql.get(name))
        except Exception as error:
            said = f"FAILED: {type(error).__name__} {str(error)[:500]}"
        bad += said[0].isupper()
        print(f"{name:40} {time.time() - start:6.1f}s  {said}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
