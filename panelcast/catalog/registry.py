"""Named queries: a Spark callable and, where SQL can say it, the SQL to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.catalog.tables import with_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits: sums differ in the last bits between runs."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def register(name: str, run: Query, sql: str | None = None, doubles: str | list[str] = "", digits: int = DIGITS) -> None:
    """``doubles`` names the columns of ``sql`` that are rounded as ``run``'s are."""
    if name in QUERIES:
        raise ValueError(f"query registered twice: {name}")
    QUERIES[name] = lambda spark, folder: rounded(run(spark, folder), digits)
    if sql is not None:
        names = doubles.split() if isinstance(doubles, str) else doubles
        if names:
            # adding zero turns -0.0 into 0.0
            swap = ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in names)
            head, ctes = "", with_tables(sql)
            start = ctes.index(sql) if ctes != sql else 0
            head = ctes[:start]
            sql = f"{head}SELECT * REPLACE ({swap}) FROM ({sql})"
        else:
            sql = with_tables(sql)
        ORACLE[name] = sql
