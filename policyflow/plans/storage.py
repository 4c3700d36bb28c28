"""File listings, inventories, metadata and the versioned layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import files
from ..session import scratch
from ..sources import sinks, tables as src
from .registry import query, table


@query("s9", "SELECT c_mktsegment AS folder, 'csv' AS kind, CAST(sum(length(CAST(c_custkey AS VARCHAR)) + length(c_name) + 2) AS BIGINT) AS bytes FROM customer GROUP BY 1")
def s9(spark, d):
    """Directory listing with name, time and length; temporary names are left out."""
    path = scratch(spark, "tree")
    customers = table(spark, d, "customer")
    customers.select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment")).write.partitionBy("segment").csv(path)
    listed = src.list_files(spark, path, "*.csv", recursive=True)
    folder = F.replace(tx.folder_name(F.col("path")), F.lit("segment="), F.lit(""))
    kind = F.replace(tx.extension(F.col("name")), F.lit("."), F.lit(""))
    return listed.filter("mtime is not null").groupBy(folder.alias("folder"), kind.alias("kind")).agg(F.sum("length").alias("bytes"))


@query("s10", """WITH f AS (SELECT regexp_replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '[?#].*$', '') AS path, page_id FROM pages),
n AS (SELECT *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS product_name FROM f)
SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '미분류' END AS product_type, product_name, upper(substr(md5(product_name), 1, 8)) AS product_code,
  strftime(TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 700 AS INT)), 'v%y%m') AS version FROM n""")
def s10(spark, d):
    """Document inventory: type from the first folder, name, code, version."""
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1), "[?#].*$", "")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 700).cast("int")).cast("timestamp")
    listed = table(spark, d, "pages").select(path.alias("path"), day.alias("mtime"))
    return files.inventory(listed, "path", "mtime")


@query("s11", """WITH f AS (SELECT doc_id, sha256(text) AS sha, source || '/암보험' || doc_id || '.pdf' AS path FROM documents)
SELECT path, sha, upper(substr(md5('암보험' || doc_id), 1, 8)) AS product_code, '암보험' || doc_id AS product_name, '건강보험' AS product_type, strftime(TIMESTAMP '2024-03-01' + to_days(CAST(doc_id % 90 AS INT)), 'v%y%m') AS version
FROM f WHERE sha NOT IN (SELECT sha FROM f JOIN labels USING (doc_id))""")
def s11(spark, d):
    """New or changed documents by content hash."""
    day = F.date_add(F.lit("2024-03-01").cast("date"), (F.col("doc_id") % 90).cast("int")).cast("timestamp")
    listed = table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha"), F.concat("source", F.lit("/암보험"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), day.alias("mtime")
    )
    known = listed.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return files.new_documents(listed.drop("doc_id"), known, "path", "sha", "mtime")


@query("s12", "SELECT 'P' || c_custkey AS product_code, c_name AS product_name, c_mktsegment AS product_type, 'v2401' AS version, CAST(1000 + c_custkey % 500 AS VARCHAR) AS stored_at FROM customer")
def s12(spark, d):
    """Metadata objects below a folder, broken ones skipped."""
    path = scratch(spark, "meta")
    customers = table(spark, d, "customer")
    meta = customers.select(
        F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("product_code"), F.col("c_name").alias("product_name"),
        F.col("c_mktsegment").alias("product_type"), F.lit("v2401").alias("version"), (1000 + F.col("c_custkey") % 500).cast("string").alias("stored_at"),
    )
    lines = meta.select(F.col("product_type").alias("folder"), F.to_json(F.struct(*meta.columns)).alias("line"))
    broken = customers.select(F.col("c_mktsegment").alias("folder"), F.concat(F.lit("{broken "), "c_name").alias("line"))
    rows = lines.unionByName(broken)
    rows.write.partitionBy("folder").text(path)
    return src.read_meta(spark, path, "*.txt").select(*meta.columns)


@query("s13", "SELECT 'T' || (s_nationkey % 5) AS product_type, 'A_B' || (s_suppkey % 10) AS product_name, 'v240' || (s_suppkey % 2) AS version, count(*) AS n, count(DISTINCT s_suppkey) AS n_keys FROM supplier GROUP BY 1, 2, 3")
def s13(spark, d):
    """Versioned layout: type, safe name, version."""
    path = scratch(spark, "layout")
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").select(
        k, F.concat(F.lit("T"), (F.col("s_nationkey") % 5).cast("string")).alias("product_type"), F.concat(F.lit("A/B"), (k % 10).cast("string")).alias("product_name"),
        F.concat(F.lit("v240"), (k % 2).cast("string")).alias("version"),
    )
    sinks.write_versions(rows, path)
    return spark.read.parquet(path).groupBy("product_type", "product_name", "version").agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("n_keys"))
