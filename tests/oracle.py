"""Runs a query's SQL in DuckDB over the same tables."""

import math
import warnings
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        rows = Counter(tuple(_value(dict(zip(names, r, strict=True))[n]) for n in sorted(names)) for r in want.fetchall())
        df = query(spark, sf_dir)
        assert sorted(df.columns) == sorted(names)
        assert Counter(tuple(_value(r[n]) for n in sorted(names)) for r in df.collect()) == rows
    return sum(rows.values())
