"""Ordered reports: pages, newest rows, heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with the total count of the whole result in ``total``."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total.scalar())


def newest(df: DataFrame, order: list[Column], n: int, condition: Column | None = None) -> DataFrame:
    rows = df if condition is None else df.filter(condition)
    return rows.orderBy(*order).limit(n)


def last_lines(log: DataFrame, pos: str, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc(pos)).limit(n)


def head(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """First rows for a preview, null as ''."""
    return df.orderBy(*order).limit(n).na.fill("")


def filter_present(df: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """Equality on each column whose wanted value is not empty."""
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df
