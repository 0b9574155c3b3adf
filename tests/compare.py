"""Spark results against SQL results, as the driver compares them: by column name, without order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(tuple(cell(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def sql(query, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(query).df()
