"""Runs a query and its SQL side by side and compares their rows."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return round(float(x), 5) if type(x).__name__ == "Decimal" else x


def differences(spark, name, run, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = run(spark, sf_dir)
    rel = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(rel.columns):
        return f"{name}: columns {columns} and {sorted(rel.columns)}"
    rows = lambda names, data: sorted((tuple(value(r[names.index(c)]) for c in columns) for r in data), key=repr)
    a, b = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    if a != b:
        only = lambda x, y: [r for r in x if r not in set(y)][:2]
        return f"{name}: {len(a)} and {len(b)} rows; {only(a, b)} {only(b, a)}"
    return None
