"""Projections: long to wide attributes, defaults, columns, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import names
from ..functions import numbers, text as tx


def attribute_columns(results: DataFrame, attribute: str = "attribute", code: str = "inferred_code") -> DataFrame:
    """One output row per result row: the column of its attribute is filled, the others are null."""
    wide = [
        F.when(F.col(attribute) == key, F.coalesce(F.col(code), F.lit(""))).alias(column)
        for key, column in names.ATTRIBUTE_COLUMNS.items()
    ]
    return results.select(*[c for c in results.columns if c not in (attribute, code)], *wide)


def benefit_rows(
    results: DataFrame, keys: list[str], pos: str, attribute: str = "attribute", code: str = "inferred_code"
) -> DataFrame:
    """One row per benefit with all nine attributes: of several codes the first non-null one by position."""
    first = F.min_by(F.col(code), F.when(F.col(code).isNotNull(), F.col(pos)))
    wide = results.groupBy(*keys).pivot(attribute, list(names.ATTRIBUTE_COLUMNS)).agg(first)
    return wide.select(*keys, *[F.col(k).alias(c) for k, c in names.ATTRIBUTE_COLUMNS.items()])


def confirmed(results: DataFrame) -> DataFrame:
    """Confirmed or approved, not exported yet."""
    return results.filter(F.col("verification_status").isin(names.CONFIRMED) & ~F.coalesce("is_exported", F.lit(False)))


def ensure_columns(df: DataFrame, required: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in required if c not in df.columns})


def ordered_columns(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(*[c for c in order if c in df.columns])


def risk_columns(columns: list[str], risk: str, items: list[str], reason: str = "선정근거") -> list[str]:
    """Id column when there is one, risk, item columns, reason."""
    id_column = find_id_column(columns, exclude=items)
    head = [id_column] if id_column and id_column != risk else []
    return [c for c in [*head, risk, *items, reason] if c in columns]


def find_risk_column(columns: list[str]) -> str:
    """Exact name, else a part of it, else the first column."""
    for exact in ("위험률명", "Risk Name"):
        if exact in columns:
            return exact
    for parts in (("위험률명", "Risk Name"), ("위험률", "Risk")):
        hits = [c for c in columns if any(p in c for p in parts)]
        if hits:
            return hits[0]
    return columns[0]


def find_id_column(columns: list[str], exclude: list[str] = ("항목구분코드", "항목값코드")) -> str | None:
    for exact in ("위험률ID", "Risk ID"):
        if exact in columns:
            return exact
    return next((c for c in columns if "ID" in c or ("코드" in c and c not in exclude)), None)


def coverage_attributes(df: DataFrame, numbers_: list[str], module: str) -> DataFrame:
    """Flags as whole numbers with default 0, module text '<v>모듈'."""
    text = tx.text_or_empty(F.col(module))
    return df.withColumns({
        **{c: numbers.lenient_int(F.col(c).cast("string")) for c in numbers_},
        module: F.when(text != "", F.concat(text, F.lit("모듈"))).otherwise(""),
    })


def row_window(grid: DataFrame, row_no: str, ref_row: int, start: int, end: int, columns: list[str], ref_column: int, width: int) -> DataFrame:
    """Rows ref+start..ref+end and ``width`` columns from the reference column."""
    rows = grid.filter(F.col(row_no).between(ref_row + start, ref_row + end))
    return rows.select(row_no, *columns[ref_column:ref_column + width])


def rows_matching(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(tx.strip(F.col(column)) == value)


def first_match(df: DataFrame, column: str, value: str, row_no: str, miss: int = -1) -> DataFrame:
    """Row number of the first hit, ``miss`` when there is none."""
    hit = F.min(F.when(tx.strip(F.col(column)) == value, F.col(row_no)))
    return df.agg(F.coalesce(hit, F.lit(miss)).alias("row_no"))


def waiver_flag(exits: Column) -> Column:
    return F.coalesce(exits > 0, F.lit(False))
