"""Comparing a query's rows with DuckDB's."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows):
    return sorted(repr(tuple(float(f"{x:.9g}") if isinstance(x, float) else x for x in r)) for r in rows)


def both(spark, sf_dir, query, sql):
    """(columns, rows) of Spark and of DuckDB, rows in a comparable order. The query must read given or derived tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    assert any(sf_dir in f or "/radiolake-" in f for f in df.inputFiles()), "reads no given table"
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    want = con.sql(sql)
    expected = sorted(want.columns)
    listed = ", ".join(f'"{c}"' for c in expected)
    return (columns, normal(rows)), (expected, normal(con.sql(f"select {listed} from ({sql})").fetchall()))
