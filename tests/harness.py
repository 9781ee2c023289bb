"""Runs queries beside their SQL, as the driver does: sorted columns, rows as text."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings news_source story story_cluster story_batch raw_feed_item mix_target split_profile".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    df = query(spark, sf_dir)
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, res.fetchall())
    if a != b:
        left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only Spark {left}, only SQL {right}"
    return ""
