"""Rows of a Spark query and of its SQL, in a form that can be compared."""

import datetime
import decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if v == v else None
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def sql_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
