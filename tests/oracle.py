"""Run queries and their SQL side by side: ``python tests/oracle.py [folder] [query ...]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(v)
    return str(v)


_KIND = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int",
    "string": "text", "varchar": "text", "timestamp_ntz": "time", "timestamp": "time", "double": "double", "float": "double",
}


def kinds(types: dict[str, str]) -> dict[str, str]:
    return {c: _KIND.get(k.lower(), k.lower()) for c, k in types.items()}


def compare(df, con, sql: str) -> str | None:
    """None when columns, types, row count and values agree, else what differs."""
    ours = df.collect()
    cur = con.execute(sql)
    described = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(described):
        return f"columns {cols} != {sorted(described)}"
    a, b = kinds(dict(df.dtypes)), kinds(described)
    if a != b:
        return f"types { {c: (a[c], b[c]) for c in cols if a[c] != b[c]} }"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    at = {c: i for i, c in enumerate(described)}
    left = sorted(tuple(_value(r[c]) for c in cols) for r in ours)
    right = sorted(tuple(_value(r[at[c]]) for c in cols) for r in theirs)
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    return f"{len(bad)} of {len(left)} rows differ in {cols}, first {bad[0]}" if bad else None


def main() -> None:
    import __spark_entry__ as E
    from tidemark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    failed = 0
    for name, query in E.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            sql = E.oracle_sql().get(name)
            problem = compare(df, con, sql) if sql else f"no SQL; {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        rows = len(con.execute(sql).fetchall()) if problem is None else ""
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {rows} {problem or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
