"""A copy of the small tables in which some prices, quantities and volumes are zero, and the comparison of a query with its SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def zero_tables(source: str, folder: str) -> str:
    """Every 23rd event has no value and every 19th no size; every 29th line no price, every 31st no quantity. The other tables are linked."""
    con = duckdb.connect()
    for t in TABLES:
        if t not in ("events", "lineitem"):
            os.symlink(f"{source}/{t}.parquet", f"{folder}/{t}.parquet")
    con.sql(f"""SELECT * REPLACE (CASE WHEN event_id % 23 = 0 THEN 0.0 ELSE value END AS value, CASE WHEN event_id % 19 = 0 THEN '{{"k": -1}}' ELSE props END AS props) FROM '{source}/events.parquet'""").write_parquet(f"{folder}/events.parquet")
    con.sql(f"""SELECT * REPLACE (CAST(CASE WHEN (l_orderkey + l_linenumber) % 29 = 0 THEN 0 ELSE l_extendedprice END AS DOUBLE) AS l_extendedprice, CAST(CASE WHEN (l_orderkey + l_linenumber) % 31 = 0 THEN 0 ELSE l_quantity END AS DOUBLE) AS l_quantity) FROM '{source}/lineitem.parquet'""").write_parquet(f"{folder}/lineitem.parquet")
    return folder


def sql_rows(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql("SET error_on_division_by_zero = false")
    con.sql("SET ieee_floating_point_ops = false")  # a number divided by zero is NULL, as it is in the library
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.sql(sql).df()


def sorted_rows(df: pd.DataFrame, digits: int = 4) -> list[tuple]:
    """Rows as text, numbers short enough for two engines to agree on."""

    def cell(x):
        if x is None or x is pd.NaT or isinstance(x, float) and x != x:
            return "-"
        if isinstance(x, float):
            return f"{round(x, digits) + 0.0:.{digits}f}"
        return str(x)[:10] if hasattr(x, "year") else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, row)) for row in df.itertuples(index=False))
