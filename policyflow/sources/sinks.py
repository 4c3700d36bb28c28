"""Writers: export, results by attribute, acknowledgements, audit log, versioned layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import names
from ..functions import text as tx
from ..operators.project import confirmed
from .tables import csv_reader, list_files


def export_rows(results: DataFrame) -> DataFrame:
    """Confirmed, not yet exported rows as text in the fixed columns; null and missing columns are ''."""
    rows = confirmed(results)
    out = []
    for c in names.EXPORT_COLUMNS:
        if c not in rows.columns:
            out.append(F.lit("").alias(c))
        elif c == "extracted_at":
            out.append(F.coalesce(tx.iso_stamp(F.col(c)), F.lit("")).alias(c))
        elif c == "confidence":
            # a confidence of 0 is written as ''
            out.append(F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c).cast("string")).otherwise("").alias(c))
        else:
            out.append(tx.text_or_empty(F.col(c)).alias(c))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> None:
    """CSV records with a header that starts with a byte order mark: doubled quotes, blanks and line breaks kept."""
    named = [c for c in rows.columns if c != partition]
    marked = rows.withColumnRenamed(named[0], "\ufeff" + named[0])
    writer = marked.write.mode(mode).option("header", True).option("emptyValue", "").option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(partition) if partition else writer).csv(path)


def write_export(results: DataFrame, path: str) -> None:
    """CSV per product below ``path/product=<code>``; the product also stays a column of the file."""
    rows = export_rows(results).withColumn("product", F.col("product_code"))
    # files of even size: a large product is split over several, small ones share a task
    write_csv(rows.hint("rebalance", "product"), path, "product")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export, cell for cell as they were written."""
    return csv_reader(spark).csv(path).select(*names.EXPORT_COLUMNS).na.fill("")


def transfer_log(spark: SparkSession, path: str, at: Column) -> DataFrame:
    """Pending outbound transfer rows for the files of an export, one per product: name, size and checksum of the parts."""
    files = list_files(spark, path, "*.csv", recursive=True, content=True)
    product = F.regexp_extract("path", "/product=([^/]*)/", 1)
    per = files.groupBy(product.alias("product_code")).agg(
        F.sum("length").alias("file_size"), F.sha2(F.array_join(F.array_sort(F.collect_set("sha")), ""), 256).alias("checksum_sha256")
    )
    return per.select(
        "product_code", F.concat("product_code", F.lit("_"), tx.file_stamp(at), F.lit(".csv")).alias("filename"), "file_size", "checksum_sha256",
        F.lit("outbound").alias("direction"), F.lit("pending").alias("status"), F.lit(0).alias("retry_count"),
    )


def mark_exported(results: DataFrame, at: Column) -> DataFrame:
    """Snapshot of the results after the export."""
    sent = F.col("verification_status").isin(names.CONFIRMED) & ~F.coalesce("is_exported", F.lit(False))
    stamped = F.when(sent, at).otherwise(F.col("exported_at") if "exported_at" in results.columns else F.lit(None))
    return results.withColumns({"exported_at": stamped, "is_exported": F.coalesce("is_exported", F.lit(False)) | sent})


def write_by_attribute(rows: DataFrame, path: str) -> None:
    rows.hint("rebalance", "attribute").write.partitionBy("attribute").parquet(path)


def ack_line(file: Column, valid: Column) -> Column:
    return F.concat_ws("|", F.lit("ACK"), file, F.when(valid, "OK").otherwise("FAILED"))


def write_acks(files: DataFrame, path: str) -> None:
    files.select(ack_line(F.col("file"), F.col("valid")).alias("value")).write.mode("append").text(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_versions(rows: DataFrame, path: str) -> None:
    """Layout type / safe name / version."""
    safe = rows.withColumn("product_name", tx.safe_name(F.col("product_name")))
    layout = ["product_type", "product_name", "version"]
    safe.hint("rebalance", *layout).write.partitionBy(*layout).parquet(path)
