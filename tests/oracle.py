"""Results of a query against those of its SQL."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def canonical(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted("|".join(canonical(v) for v in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def sql_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted("|".join(canonical(r[i]) for i in order) for r in found.fetchall())
