"""Compare a query with its SQL, run by DuckDB on the same tables."""

import datetime
import decimal
import math
import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, query, sql, folder=SMALL):
    frame = query(spark, folder)
    con = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    assert sorted(frame.columns) == sorted(found.columns)
    order = sorted(frame.columns)
    ours, theirs = rows_of(frame.columns, [tuple(r) for r in frame.collect()], order), rows_of(found.columns, found.fetchall(), order)
    assert len(ours) == len(theirs)
    assert ours == theirs
