"""Checks on hand-off files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..functions import text as tx
from .ordered import running_before


def missing_columns(columns: list[str], required: list[str] = names.REQUIRED_COLUMNS) -> list[str]:
    return [c for c in required if c not in columns]


def header_message(columns: list[str]) -> str | None:
    gone = missing_columns(columns)
    return f"누락 컬럼: {', '.join(gone)}" if gone else None


def header_errors(headers: DataFrame, file: str, required: list[str] = names.REQUIRED_COLUMNS) -> DataFrame:
    """(file, message) of the files whose ``header`` lacks required columns."""
    gone = F.filter(F.array(*[F.lit(c) for c in required]), lambda c: ~F.array_contains(F.col("header"), c))
    missing = headers.select(file, gone.alias("__gone")).filter(F.size("__gone") > 0)
    return missing.select(file, F.concat(F.lit("누락 컬럼: "), F.array_join("__gone", ", ")).alias("message"))


def row_errors(
    rows: DataFrame, row_no: str, required: list[str], file: list[str] | None = None, limit: int | None = None,
    header_errors: str | None = None,
) -> DataFrame:
    """Messages (file, row, seq, message) of blank required values.

    With a ``limit`` reading stops at the row that brings the count above it: later rows give nothing, and one overflow message
    follows. A row may give several messages. The running count is taken over the rows with errors only. The column
    ``header_errors`` holds how many errors the file had before its first row.
    """
    file = file or []
    before = F.col(header_errors) if header_errors else F.lit(0)
    blank = lambda c: tx.strip(tx.text_or_empty(F.col(c))) == ""
    checks = F.array(*[
        F.when(blank(c), F.concat(F.lit("Row "), F.col(row_no).cast("string"), F.lit(f": {c} 누락"))) for c in required
    ])
    numbered = F.transform(F.array_compact(checks), lambda m, i: F.struct(i.alias("seq"), m.alias("message")))
    bad = rows.select(*file, row_no, before.alias("__header"), numbered.alias("messages")).filter(F.size("messages") > 0)
    if limit is not None:
        count = F.col("__before") + F.col("__header")
        bad = running_before(bad, file, row_no, F.size("messages"), "__before").filter(count <= limit)
        # the row that passes the limit is the last one read
        over = F.array(F.struct(F.lit(len(required)).alias("seq"), F.lit(names.OVERFLOW_MESSAGE).alias("message")))
        bad = bad.withColumn("messages", F.when(count + F.size("messages") > limit, F.concat("messages", over)).otherwise(F.col("messages")))
    return bad.select(*file, row_no, F.explode("messages").alias("__m")).select(*file, row_no, "__m.seq", "__m.message")


def rows_read(rows: DataFrame, errors: DataFrame, row_no: str, file: list[str]) -> DataFrame:
    """Rows read per file: all, or up to the row where reading stopped."""
    stop = errors.filter(F.col("message") == names.OVERFLOW_MESSAGE).select(*file, F.col(row_no).alias("__stop"))
    total = rows.groupBy(*file).agg(F.count("*").alias("__all"))
    return total.join(stop, file, "left").select(*file, F.coalesce("__stop", "__all").cast("long").alias("row_count"))


def checksum_errors(files: DataFrame, side_files: DataFrame, path: str = "path") -> DataFrame:
    """Files with ``sha``; those with a side file that differs get an error, those without one a warning."""
    side = side_files.select(path, F.lower(tx.strip(F.col("expected"))).alias("expected"))
    joined = files.join(side, path, "left")
    differ = F.col("expected") != F.col("sha")
    text = F.concat(
        F.lit("체크섬 불일치: expected="), F.substring("expected", 1, 16), F.lit("... actual="), F.substring("sha", 1, 16), F.lit("..."),
    )
    return joined.select(
        path, F.when(differ, text).otherwise("").alias("error"),
        F.col("expected").isNull().alias("warning"),
    )


def validity(files: DataFrame, errors: DataFrame, file: str) -> DataFrame:
    """Number of errors per file; a file without any is valid."""
    counts = errors.groupBy(file).agg(F.count("*").alias("__n"))
    joined = files.select(file).distinct().join(counts, file, "left")
    n = F.coalesce("__n", F.lit(0)).cast("long")
    return joined.select(file, n.alias("error_count"), (n == 0).alias("valid"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
