"""Hand-off checks, diff, merge, export, audit and transfers on orders, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..operators import merge, quality, review
from ..session import cut, scratch
from ..sources import sinks
from ..sources.tables import headed_lines, named_fields
from .registry import query, table

# existing master rows and an incoming copy with new keys, changed and blank-padded values

_FIELDS = names.COMPARE_FIELDS
OLD_SQL = "old AS (SELECT 'P' || (o_custkey %% 50) AS product_code, 'B' || o_orderkey AS benefit_code, o_orderstatus AS sub_benefit_code, %s FROM orders)" % ", ".join(
    f"o_orderpriority || '{i}' AS {f}" for i, f in enumerate(_FIELDS)
)
NEW_SQL = "new AS (SELECT 'P' || (o_custkey %% 50) AS product_code, CASE WHEN o_orderkey %% 11 = 0 THEN 'N' ELSE 'B' END || o_orderkey AS benefit_code, o_orderstatus AS sub_benefit_code, %s FROM orders)" % ", ".join(
    f"CASE WHEN o_orderkey % 7 = {i} THEN o_orderstatus ELSE ' ' || o_orderpriority || '{i} ' END AS {f}" if i < 3 else f"' ' || o_orderpriority || '{i} ' AS {f}" for i, f in enumerate(_FIELDS)
)


def master(spark, d):
    k, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    orders = table(spark, d, "orders", spread=True)
    product = F.concat(F.lit("P"), (F.col("o_custkey") % 50).cast("string")).alias("product_code")
    sub = F.col("o_orderstatus").alias("sub_benefit_code")
    old = orders.select(
        product, F.concat(F.lit("B"), k.cast("string")).alias("benefit_code"), sub,
        *[F.concat(prio, F.lit(str(i))).alias(f) for i, f in enumerate(_FIELDS)],
    )
    padded = lambda i: F.concat(F.lit(" "), prio, F.lit(f"{i} "))
    value = lambda i: F.when(k % 7 == i, F.col("o_orderstatus")).otherwise(padded(i)) if i < 3 else padded(i)
    new = orders.select(
        product, F.concat(F.when(k % 11 == 0, "N").otherwise("B"), k.cast("string")).alias("benefit_code"), sub,
        *[value(i).alias(f) for i, f in enumerate(_FIELDS)],
    )
    return old, new


_KEYS = ", ".join(names.KEY_FIELDS)
CLASS_SQL = f"""{OLD_SQL}, {NEW_SQL}, cl AS (SELECT {', '.join('new.' + k for k in names.KEY_FIELDS)}, old.benefit_code IS NOT NULL AS known,
  concat_ws(';', {', '.join(f"CASE WHEN old.benefit_code IS NOT NULL AND trim(old.{f}) <> trim(new.{f}) THEN '{f}:' || trim(old.{f}) || '>' || trim(new.{f}) END" for f in _FIELDS)}) AS changes
  FROM new LEFT JOIN old USING ({_KEYS})),
kind AS (SELECT *, CASE WHEN NOT known THEN 'insert' WHEN changes <> '' THEN 'update' ELSE 'skip' END AS change_type FROM cl)"""


@query("u1", f"WITH {CLASS_SQL} SELECT {_KEYS}, change_type, changes FROM kind")
def u1(spark, d):
    """Insert, update or skip, with the changed fields."""
    old, new = master(spark, d)
    out = merge.classify(old, new)
    text = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["old"], F.lit(">"), c["new"])), ";")
    return out.select(*names.KEY_FIELDS, "change_type", text.alias("changes"))


@query("u1_merged", f"WITH {OLD_SQL}, {NEW_SQL} SELECT {_KEYS}, diagnosis_code, coverage_period FROM new UNION ALL SELECT {_KEYS}, diagnosis_code, coverage_period FROM old ANTI JOIN new USING ({_KEYS})")
def u1_merged(spark, d):
    """Master table after the merge."""
    return merge.merged(*master(spark, d)).select(*names.KEY_FIELDS, "diagnosis_code", "coverage_period")


@query("a16", f"WITH {CLASS_SQL} SELECT count(*) FILTER (change_type = 'insert') AS inserted, count(*) FILTER (change_type = 'update') AS updated, count(*) FILTER (change_type = 'skip') AS skipped, 0::BIGINT AS errors FROM kind")
def a16(spark, d):
    """Sync counts."""
    return merge.sync_counts(merge.classify(*master(spark, d)))


@query("j20", f"WITH {OLD_SQL}, {NEW_SQL} SELECT {_KEYS}, old.diagnosis_code AS old_value, new.diagnosis_code AS new_value FROM old FULL JOIN new USING ({_KEYS})")
def j20(spark, d):
    """Full outer view of one field."""
    return merge.diff_join(*master(spark, d), names.KEY_FIELDS, "diagnosis_code")


@query("u2", "SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def u2(spark, d):
    """Documents whose hash is not in the known set."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    known = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return merge.unseen(docs, known, "sha").select("doc_id", "sha")


@query("u4", "SELECT 'o' || o_orderkey AS id, o_orderstatus AS code, NULL::VARCHAR AS note FROM orders UNION ALL SELECT 'c' || c_custkey, c_mktsegment, c_name FROM customer UNION ALL SELECT 's' || s_suppkey, NULL, s_name FROM supplier")
def u4(spark, d):
    """All results of all batches, missing columns null."""
    o = table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("code"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("code"), F.col("c_name").alias("note"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("note"))
    return merge.append_all([o, c, s])


# --- checks: the orders of one priority are the rows of one incoming file

BAD_SQL = """f AS (SELECT o_orderpriority AS file, o_orderkey AS row_no, o_orderkey % 17 = 0 AS no_product, o_orderkey % 13 = 0 AS no_benefit FROM orders WHERE o_orderkey >= 0),
e AS (SELECT *, no_product::INT + no_benefit::INT AS n, coalesce(sum(no_product::INT + no_benefit::INT) OVER (PARTITION BY file ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f),
kept AS (SELECT * FROM e WHERE n > 0 AND before <= 20),
msg AS (SELECT file, row_no, CASE WHEN no_product THEN 'Row ' || row_no || ': product_code 누락' END AS m1, CASE WHEN no_benefit THEN 'Row ' || row_no || ': benefit_name 누락' END AS m2, before, n FROM kept),
errors AS (SELECT file, row_no, 0 AS seq, coalesce(m1, m2) AS message FROM msg UNION ALL SELECT file, row_no, 1, m2 FROM msg WHERE m1 IS NOT NULL AND m2 IS NOT NULL
  UNION ALL SELECT file, max(row_no), 2, '... (오류 20개 초과, 중단)' FROM msg GROUP BY 1 HAVING sum(n) > 20)"""


def incoming(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("file"), k.alias("row_no"), F.when(k % 17 == 0, "  ").otherwise("P1").alias("product_code"),
        F.when(k % 13 != 0, F.col("o_orderstatus")).alias("benefit_name"),
    )


def errors(spark, d) -> DataFrame:
    return quality.row_errors(incoming(spark, d), "row_no", ["product_code", "benefit_name"], ["file"], names.ERRORS_PER_FILE)


@query("q1_all", """SELECT o_orderpriority AS file, o_orderkey AS row_no, 0 AS seq, 'Row ' || o_orderkey || CASE WHEN o_orderkey % 17 = 0 THEN ': product_code 누락' ELSE ': benefit_name 누락' END AS message FROM orders WHERE o_orderkey % 17 = 0 OR o_orderkey % 13 = 0
UNION ALL SELECT o_orderpriority, o_orderkey, 1, 'Row ' || o_orderkey || ': benefit_name 누락' FROM orders WHERE o_orderkey % 17 = 0 AND o_orderkey % 13 = 0""")
def q1_all(spark, d):
    """Messages of all blank required values."""
    return quality.row_errors(incoming(spark, d), "row_no", ["product_code", "benefit_name"], ["file"])


@query("q1", f"WITH {BAD_SQL} SELECT * FROM errors")
def q1(spark, d):
    """Messages of blank required values, up to the row where reading stops."""
    return errors(spark, d)


@query("q1_header", """
SELECT 'p' || CAST(p_partkey AS VARCHAR) AS product_code, p_name || ', "x"' AS benefit_name, CASE WHEN p_size % 2 = 0 THEN p_type END AS template_name,
  CASE WHEN p_size % 2 = 0 THEN '' ELSE '누락 컬럼: template_name, diagnosis_code, confidence, verification_status' END AS message FROM part""")
def q1_header(spark, d):
    """Two deliveries with other column orders read by header name, with the message of the one that lacks columns."""
    path = scratch(spark, "handoff")
    part = table(spark, d, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("product_code"), F.concat("p_name", F.lit(', "x"')).alias("benefit_name"),
        F.col("p_type").alias("template_name"), *[F.lit("v").alias(c) for c in ("diagnosis_code", "confidence", "verification_status")], "p_size",
    )
    even = F.col("p_size") % 2 == 0
    write = lambda df: df.write.mode("append").option("header", True).option("escape", '"').csv(path)
    write(part.filter(even).select("confidence", "template_name", "benefit_name", "verification_status", "product_code", "diagnosis_code"))
    write(part.filter(~even).select("benefit_name", "product_code"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("pos"))
    headers, rows = headed_lines(cut(lines), "file", "pos")
    messages = quality.header_errors(headers, "file")
    named = named_fields(rows, ["product_code", "benefit_name", "template_name"])
    out = named.join(messages, "file", "left")
    return out.select("product_code", "benefit_name", "template_name", F.coalesce("message", F.lit("")).alias("message"))


@query("q1_rows", f"WITH {BAD_SQL}, st AS (SELECT file, row_no AS stop FROM errors WHERE seq = 2) SELECT file, coalesce(any_value(stop), count(*)) AS row_count FROM f LEFT JOIN st USING (file) GROUP BY 1")
def q1_rows(spark, d):
    """Rows read per file."""
    return quality.rows_read(incoming(spark, d), errors(spark, d), "row_no", ["file"])


@query("q2", """SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN '체크섬 불일치: expected=' || substr(sha256(lang), 1, 16) || '... actual=' || substr(sha256(text), 1, 16) || '...' ELSE '' END AS error,
  doc_id % 5 = 4 AND doc_id % 3 <> 0 AS warning FROM documents""")
def q2(spark, d):
    """Checksums against side files."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("f"), k.cast("string")).alias("path"), F.sha2("text", 256).alias("sha"))
    side = docs.select(
        F.concat(F.lit("f"), k.cast("string")).alias("path"),
        F.when(k % 3 == 0, F.sha2("lang", 256)).when(k % 5 != 4, F.concat(F.sha2("text", 256), F.lit("\n"))).alias("expected"),
    ).filter("expected is not null")
    return quality.checksum_errors(files, side)


@query("q3", f"WITH {BAD_SQL} SELECT file, count(errors.row_no) AS error_count, count(errors.row_no) = 0 AS valid FROM (SELECT DISTINCT file FROM f) LEFT JOIN errors USING (file) GROUP BY 1")
def q3(spark, d):
    """A file is valid when it has no errors."""
    return quality.validity(incoming(spark, d), errors(spark, d), "file")


@query("q4", "SELECT 'P' || (o_custkey % 100) AS product_code, strftime(o_orderdate, 'v%y%m') AS version, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def q4(spark, d):
    """Product and version that are not unique."""
    rows = table(spark, d, "orders").select(
        F.concat(F.lit("P"), (F.col("o_custkey") % 100).cast("string")).alias("product_code"), F.date_format("o_orderdate", "'v'yyMM").alias("version")
    )
    return quality.duplicates(rows, ["product_code", "version"])


# --- transfers and export


@query("v5", """SELECT event_id, CASE WHEN value > 10 THEN 'completed' WHEN event_id % 4 + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status,
  CAST(CASE WHEN value > 10 THEN event_id % 4 ELSE event_id % 4 + 1 END AS BIGINT) AS retry_count FROM events""")
def v5(spark, d):
    """Next state of a transfer attempt."""
    state = review.transfer_state(F.col("value") > 10, F.col("event_id") % 4)
    return table(spark, d, "events").select("event_id", *[c.alias(n) for n, c in state.items()])


@query("v6", """SELECT event_id, 'f' || user_id AS filename FROM events WHERE event_type IN ('view', 'click') AND user_id IN (SELECT s_suppkey FROM supplier)""")
def v6(spark, d):
    """Outbound pending transfers whose file is there."""
    kind = F.col("event_type")
    logs = table(spark, d, "events").select(
        "event_id", F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("filename"),
        F.when(kind == "error", "inbound").otherwise("outbound").alias("direction"), F.when(kind.isin("view", "click", "error"), "pending").otherwise("completed").alias("status"),
    )
    files = table(spark, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("filename"))
    return review.pending_transfers(logs, files).select("event_id", "filename")


EXPORT_SQL = """SELECT o_orderkey AS id, 'P' || (o_custkey % 8) AS product_code, CASE WHEN o_orderkey % 3 = 0 THEN 'auto_confirmed' WHEN o_orderkey % 3 = 1 THEN 'approved' ELSE 'review_needed' END AS verification_status,
  o_orderkey % 10 = 0 AS is_exported FROM orders"""


def exportable(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("P"), (F.col("o_custkey") % 8).cast("string")).alias("product_code"), F.concat(F.lit("B"), k.cast("string")).alias("benefit_code"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).alias("diagnosis_code"), (k % 101 / F.lit(100.0)).alias("confidence"),
        F.when(k % 3 == 0, "auto_confirmed").when(k % 3 == 1, "approved").otherwise("review_needed").alias("verification_status"),
        (k % 10 == 0).alias("is_exported"), F.col("o_orderdate").cast("timestamp").alias("extracted_at"),
    )
    return rows


@query("s17", f"""SELECT product_code, 'B' || id AS benefit_code, CASE WHEN id % 2 = 0 THEN o_orderstatus ELSE '' END AS diagnosis_code, verification_status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS extracted_at, '' AS template_name
FROM ({EXPORT_SQL}) JOIN orders ON o_orderkey = id WHERE NOT is_exported AND verification_status <> 'review_needed'""")
def s17(spark, d):
    """CSV export of confirmed rows in the 21 fixed columns, written per product and read back."""
    path = scratch(spark, "export")
    sinks.write_export(exportable(spark, d), path)
    back = sinks.read_export(spark, path)
    assert back.columns == names.EXPORT_COLUMNS
    return back.select("product_code", "benefit_code", "diagnosis_code", "verification_status", "extracted_at", "template_name")


ODD_SQL = "' b' || id || ' says \"x, y\"' || chr(10) || ' '"


@query("s17_quoted", f"SELECT product_code, 'B' || id AS benefit_code, {ODD_SQL} AS benefit_name, verification_status FROM ({EXPORT_SQL}) WHERE NOT is_exported AND verification_status <> 'review_needed'")
def s17_quoted(spark, d):
    """Export of cells with quotes, commas, outer blanks and line breaks, read back cell for cell."""
    path = scratch(spark, "export")
    sinks.write_export(odd_names(exportable(spark, d)), path)
    return sinks.read_export(spark, path).select("product_code", "benefit_code", "benefit_name", "verification_status")


def odd_names(rows: DataFrame) -> DataFrame:
    return rows.withColumn("benefit_name", F.concat(F.lit(" b"), F.col("id").cast("string"), F.lit(' says "x, y"\n ')))


@query("s17_log", f"SELECT DISTINCT product_code, product_code || '_20240102_030405.csv' AS filename, true AS has_content, 'outbound' AS direction, 'pending' AS status, 0 AS retry_count FROM ({EXPORT_SQL}) WHERE NOT is_exported AND verification_status <> 'review_needed'")
def s17_log(spark, d):
    """Transfer log of an export."""
    path = scratch(spark, "export")
    sinks.write_export(exportable(spark, d), path)
    log = sinks.transfer_log(spark, path, F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    filled = (F.col("file_size") > 0) & (F.length("checksum_sha256") == 64)
    return log.select("product_code", "filename", filled.alias("has_content"), "direction", "status", "retry_count")


@query("s17_flags", f"SELECT id, is_exported OR verification_status <> 'review_needed' AS is_exported FROM ({EXPORT_SQL})")
def s17_flags(spark, d):
    """Result snapshot after the export."""
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return sinks.mark_exported(exportable(spark, d), stamp).select("id", "is_exported")


@query("s18", "SELECT ['Inferred_Diagnosis_Code', 'Inferred_EDI_Code', 'Inferred_Accident_Type'][CAST(p_partkey % 3 AS INT) + 1] AS attribute, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS pages FROM part GROUP BY 1")
def s18(spark, d):
    """One result set per attribute, written partitioned and read back."""
    path = scratch(spark, "results")
    k = F.col("p_partkey")
    keys = F.array(F.lit("Inferred_Diagnosis_Code"), F.lit("Inferred_EDI_Code"), F.lit("Inferred_Accident_Type"))
    rows = table(spark, d, "part").select(F.element_at(keys, (k % 3 + 1).cast("int")).alias("attribute"), "p_name", F.col("p_size").alias("ref_page"))
    sinks.write_by_attribute(rows, path)
    return spark.read.parquet(path).groupBy("attribute").agg(F.count("*").alias("n"), F.sum("ref_page").alias("pages"))


@query("s20", "SELECT 'ACK|file' || s_suppkey || '.csv|' || CASE WHEN s_acctbal > 0 THEN 'OK' ELSE 'FAILED' END AS line FROM supplier")
def s20(spark, d):
    """Acknowledgement lines."""
    path = scratch(spark, "ack")
    rows = table(spark, d, "supplier").select(F.concat(F.lit("file"), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("file"), (F.col("s_acctbal") > 0).alias("valid"))
    sinks.write_acks(rows, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("s21", """SELECT 'transfer' AS event_type, 'file' AS entity_type, event_id AS entity_id, 'system' AS actor, event_type AS action, '{"user":' || user_id || '}' AS details FROM events
UNION ALL SELECT 'sync', 'master_db', c_custkey, c_name, 'synced', '{"segment":"' || c_mktsegment || '"}' FROM customer""")
def s21(spark, d):
    """Audit rows of two sources appended to one log."""
    path = scratch(spark, "audit")
    e = table(spark, d, "events").select(*review.audit("transfer", "file", F.col("event_id"), F.lit("system"), F.col("event_type"), F.to_json(F.struct(F.col("user_id").alias("user")))))
    c = table(spark, d, "customer").select(*review.audit("sync", "master_db", F.col("c_custkey"), F.col("c_name"), F.lit("synced"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment")))))
    sinks.append_audit(e, path)
    sinks.append_audit(c, path)
    return spark.read.parquet(path)
