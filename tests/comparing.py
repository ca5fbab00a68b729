"""Comparison of Spark and DuckDB results."""

import glob
import math
import os

import duckdb


def duck(directory):
    c = duckdb.connect()
    for f in glob.glob(f"{directory}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return v


def _sorted(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in data), key=repr)


def same_rows(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert _sorted(df.columns, df.collect()) == _sorted(relation.columns, relation.fetchall())
