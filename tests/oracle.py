"""Run a registered query and its SQL on the same tables and compare all values."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def spark_rows(df):
    names = sorted(df.columns)
    return names, _sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], _sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())
