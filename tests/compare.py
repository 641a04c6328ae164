"""Compare Spark results with DuckDB on the same Parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return con


def rows_of(pdf) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted([tuple(r) for r in pdf[cols].itertuples(index=False, name=None)], key=repr)


def difference(spark_pdf, duck_pdf) -> str | None:
    """None if both hold the same rows, columns and kinds of column, else what differs."""
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(set(spark_pdf.columns) ^ set(duck_pdf.columns))}"
    # Whole numbers among nulls: toPandas gives doubles where DuckDB has nullable integers.
    nullable = [c for c in spark_pdf.columns if spark_pdf[c].dtype == "float64" and duck_pdf[c].dtype == "Int64" and spark_pdf[c].isna().any()]
    spark_pdf = spark_pdf.astype(dict.fromkeys(nullable, "Int64"))
    for c in spark_pdf.columns:
        if spark_pdf[c].dtype != duck_pdf[c].dtype and len(duck_pdf):
            return f"{c}: {spark_pdf[c].dtype} against {duck_pdf[c].dtype}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        if repr(x) != repr(y):
            cols = sorted(spark_pdf.columns)
            off = {c: (p, q) for c, p, q in zip(cols, x, y) if repr(p) != repr(q)}
            return f"{sum(repr(p) != repr(q) for p, q in zip(a, b))} rows differ, first: {dict(zip(cols, x))} off: {off}"
    return None
