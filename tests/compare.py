"""Run registered queries next to their SQL twins: python tests/compare.py SF_DIR [query ...]"""

from __future__ import annotations

import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


def duck(sf_dir: str):
    con = duckdb.connect()
    for f in pathlib.Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def _value(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def compare(spark, con, query, text: str, sf_dir: str) -> str | None:
    """None if both agree in rows, columns and types, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(text)
    want = rows_of(rel.columns, rel.fetchall())
    types = {n: KINDS[t] for n, t in df.dtypes}
    if types != dict(zip(rel.columns, map(str, rel.types))):
        return f"types {types} / {dict(zip(rel.columns, map(str, rel.types)))}"
    if not want:
        return "no rows"
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return f"{len(got)} rows / {len(want)}; extra {list(extra)[:3]}, missing {list(missing)[:3]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gantry.session import get_session

    spark = get_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = sys.argv[1], sys.argv[2:]
    con, texts, bad = duck(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        if name in texts:
            result = compare(spark, con, query, texts[name], sf)
        else:
            result = f"(no SQL) {query(spark, sf).count()} rows"
        ok = result is None or result.startswith("(no SQL)")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - start:6.2f}s {result or ''}",
              flush=True)
    print("failed:", bad)
