"""Structures, groups and file lists on events, parts, customers, suppliers and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import assembly, files, lookups, structures
from .codes import REP_SQL, representatives
from .registry import query, table


# --- coverage -> model row -> structure run -> multiple row

def chain_inputs(spark, d):
    k, s, e, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("event_id"), F.col("p_partkey")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    cov = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("D"), (k % 53).cast("string")).alias("coverage_code"))
    model = table(spark, d, "supplier").select(
        F.concat(F.lit("D"), (s % 61).cast("string")).alias("coverage_code"), s.alias("row_no"), pad(F.col("s_nationkey")).alias("expansion")
    )
    multiple = table(spark, d, "part").select(
        F.concat(F.lit("M"), (p % 89).cast("string")).alias("multiple_key"), p.alias("row_no"),
        F.when(p % 4 != 0, F.col("p_size")).cast("string").alias("rate"), ((p % 3) * 30).cast("string").alias("exempt_days"),
        F.when(p % 2 == 0, "90").otherwise("").alias("days"), F.when(p % 6 == 0, "365").otherwise("0").alias("days2"),
        F.when(p % 12 == 0, "50").alias("ratio2"),
    )
    return cov, model, structure_rows(spark, d), multiple


def structure_rows(spark, d) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        F.concat(F.lit("P123_"), F.lpad((F.col("user_id") % 25).cast("string"), 2, "0")).alias("key"), e.alias("row_no"),
        F.floor("value").cast("int").alias("sequence"), F.concat(F.lit("M"), (e % 97).cast("string")).alias("multiple_key"),
        F.concat(F.lit("ZD"), F.lpad((e % 211).cast("string"), 7, "0")).alias("sub_code"), (e % 3).alias("exits2"),
    )


STRUCTURE_SQL = """st AS (
  SELECT 'P123_' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS key, event_id AS row_no, CAST(floor(value) AS INT) AS sequence,
         'M' || CAST(event_id % 97 AS VARCHAR) AS multiple_key, 'ZD' || lpad(CAST(event_id % 211 AS VARCHAR), 7, '0') AS sub_code, event_id % 3 AS exits2
  FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_no) - 1 AS sub_no FROM st),
ends AS (SELECT key, min(sub_no) AS e FROM numbered WHERE sub_no >= 2 AND NOT (sequence > sub_no - 1) GROUP BY 1),
run AS (SELECT numbered.* FROM numbered LEFT JOIN ends USING (key) WHERE e IS NULL OR sub_no < e)"""

CHAIN_SQL = f"""cov AS (SELECT c_custkey, 'D' || CAST(c_custkey % 53 AS VARCHAR) AS coverage_code FROM customer),
model AS (SELECT 'D' || CAST(s_suppkey % 61 AS VARCHAR) AS coverage_code, arg_min('P123_' || lpad(CAST(s_nationkey AS VARCHAR), 2, '0'), s_suppkey) AS key FROM supplier GROUP BY 1),
mult AS (SELECT * FROM (SELECT 'M' || CAST(p_partkey % 89 AS VARCHAR) AS multiple_key, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS rate, (p_partkey % 3) * 30 AS exempt_days,
   CASE WHEN p_partkey % 2 = 0 THEN 90 END AS days, CASE WHEN p_partkey % 6 = 0 THEN 365 ELSE 0 END AS days2, CASE WHEN p_partkey % 12 = 0 THEN 50 END AS ratio2, p_partkey
   FROM part) QUALIFY row_number() OVER (PARTITION BY multiple_key ORDER BY p_partkey) = 1),
{STRUCTURE_SQL},
chain AS (SELECT cov.c_custkey, cov.coverage_code, run.key, sub_no, sub_code, run.multiple_key, rate, exempt_days, days, days2, ratio2
  FROM cov JOIN model USING (coverage_code) JOIN run ON run.key = model.key AND sub_no > 0 LEFT JOIN mult ON mult.multiple_key = run.multiple_key)"""


def chain(spark, d) -> DataFrame:
    cov, model, structure, multiple = chain_inputs(spark, d)
    return structures.structure_chain(cov, model, structure, multiple, F.lit("P123"))


@query("w2", f"WITH {STRUCTURE_SQL} SELECT key, row_no, sequence, sub_no FROM run")
def w2(spark, d):
    """Ascending run that opens each structure key."""
    return structures.ascending_run(structure_rows(spark, d), "key", "row_no", "sequence").select("key", "row_no", "sequence", "sub_no")


@query("w2_count", f"WITH {STRUCTURE_SQL} SELECT key, count(*) - 1 AS sub_count FROM run GROUP BY 1")
def w2_count(spark, d):
    """Number of sub-coverages per key."""
    run = structures.ascending_run(structure_rows(spark, d), "key", "row_no", "sequence")
    return structures.run_length(run, "key")


@query("p15", f"WITH {STRUCTURE_SQL} SELECT key, exits2 > 0 AS waiver FROM run WHERE sub_no = 0")
def p15(spark, d):
    """Premium waiver of the header row."""
    run = structures.ascending_run(structure_rows(spark, d), "key", "row_no", "sequence")
    return structures.waiver(run, "key", "exits2")


@query("j14", f"WITH {CHAIN_SQL} SELECT c_custkey, coverage_code, key, sub_no, multiple_key, CAST(rate AS VARCHAR) AS rate FROM chain")
def j14(spark, d):
    """Coverage, model row, structure run, multiple row."""
    return chain(spark, d).select("c_custkey", "coverage_code", "key", "sub_no", "multiple_key", "rate")


@query("a2", f"""WITH {CHAIN_SQL}
SELECT c_custkey, CAST(coalesce(sum(exempt_days), 0) AS DOUBLE) AS sum_exempt, CAST(coalesce(sum(days), 0) AS DOUBLE) AS sum_reduce,
  CASE WHEN sum(exempt_days) > 0 THEN 1 ELSE 0 END AS exempt, CASE WHEN sum(days) > 0 THEN 1 ELSE 0 END AS reduce,
  NOT bool_or(coalesce(days2 > 0 AND ratio2 > 0, false)) AS once, bool_or(coalesce(days2 > 0 AND ratio2 > 0, false)) AS twice
FROM chain GROUP BY 1""")
def a2(spark, d):
    """Exemption and reduction sums and flags per coverage."""
    return structures.reduction_flags(chain(spark, d), ["c_custkey"], "exempt_days", "days", "days2", "ratio2")


@query("a3", """
SELECT p_brand AS key, CAST(min(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END) AS INT) AS age_from, CAST(max(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size + 40 END) AS INT) AS age_to
FROM part GROUP BY 1""")
def a3(spark, d):
    """Entry-age range per term key."""
    n = F.col("p_size")
    terms = table(spark, d, "part").select(
        F.col("p_brand").alias("key"), F.when(n % 7 == 0, "").otherwise(n.cast("string")).alias("c8"),
        F.when(n % 5 == 0, F.lit(None)).otherwise((n + 40).cast("string")).alias("c9"),
    )
    return structures.entry_ages(terms, ["key"], "c8", "c9")


@query("a3_rows", """
SELECT p_brand AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS entry_no, p_type AS c6, p_name AS c11, CAST(p_size AS VARCHAR) AS c12 FROM part""")
def a3_rows(spark, d):
    """Numbered term and payment period entries."""
    terms = table(spark, d, "part").select(
        F.col("p_brand").alias("key"), F.col("p_partkey").alias("row_no"), F.col("p_type").alias("c6"), F.col("p_name").alias("c11"),
        F.col("p_size").cast("string").alias("c12"),
    )
    return structures.period_rows(terms, ["key"], "row_no", ["c6", "c11", "c12"])


@query("a4", f"""WITH {CHAIN_SQL}
SELECT c_custkey, sub_no, array_to_string(list_filter([days, days2], lambda x: x IS NOT NULL AND x <> 0), ',') AS periods,
       CAST(CASE WHEN rate IS NULL OR rate = 0 THEN 100 ELSE rate END AS VARCHAR) || '.0' AS rates FROM chain""")
def a4(spark, d):
    """Reduction periods and pay rates per sub-coverage."""
    rows = chain(spark, d).select("c_custkey", "sub_no", *structures.period_and_rate("days", "days2", "rate"))
    return rows.select(
        "c_custkey", "sub_no", F.array_join(F.col("periods").cast("array<string>"), ",").alias("periods"),
        F.array_join(F.col("rates").cast("array<string>"), ",").alias("rates"),
    )


@query("j16", f"""WITH {STRUCTURE_SQL}, rep AS ({REP_SQL}),
nm AS (SELECT coverage_code, arg_min(CASE WHEN pos % 7 = 0 THEN ' ' ELSE rep_code END, pos) AS name FROM rep GROUP BY 1)
SELECT key, sub_no, sub_code, CASE WHEN coalesce(trim(name), '') = '' THEN sub_code ELSE name END AS name FROM run LEFT JOIN nm ON coverage_code = sub_code""")
def j16(spark, d):
    """Names of the sub-coverage codes, the code when there is none."""
    run = structures.ascending_run(structure_rows(spark, d), "key", "row_no", "sequence")
    rep = representatives(spark, d)
    texts = rep.select(F.col("coverage_code").alias("code"), "pos", F.when(F.col("pos") % 7 == 0, " ").otherwise(F.col("rep_code")).alias("name"))
    return lookups.sub_names(run, texts, ["key"], "sub_no", "sub_code", "code", "name", "pos")


# --- ordered groups

@query("a1", """
SELECT grp AS printed_name, code, name, pos, row_number() OVER (PARTITION BY grp ORDER BY code, pos) AS name_no
FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' alt' ELSE c_mktsegment END AS grp, 'C' || lpad(CAST(c_custkey % 50 AS VARCHAR), 3, '0') AS code,
             c_name AS name, c_custkey AS pos FROM customer)""")
def a1(spark, d):
    """Printed name -> benefit names by coverage code."""
    k = F.col("c_custkey")
    cov = table(spark, d, "customer").select(
        F.when(k % 4 == 0, "").otherwise(F.col("c_mktsegment")).alias("printed_name"), F.concat("c_mktsegment", F.lit(" alt")).alias("other_name"),
        F.concat(F.lit("C"), F.lpad((k % 50).cast("string"), 3, "0")).alias("code"), F.col("c_name").alias("name"), F.lit("").alias("sub_name"), k.alias("pos"),
    )
    return structures.ordered_group_rows(cov, "printed_name", "other_name", "code", "name", "sub_name", "pos")


@query("a15", "SELECT 'risk ' || CAST(user_id AS VARCHAR) AS risk, min(event_id) AS first_pos FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def a15(spark, d):
    """Distinct risks in first-seen order."""
    risks = table(spark, d, "events").select(F.concat(F.lit("risk "), F.col("user_id").cast("string")).alias("risk"), "event_id")
    return risks.filter("risk is not null").groupBy("risk").agg(F.min("event_id").alias("first_pos")).orderBy("first_pos")


@query("a19", "SELECT '{단체' || CAST(user_id % 10 AS VARCHAR) || '}' AS tag, arg_max(event_type, event_id) AS phrase FROM events GROUP BY 1")
def a19(spark, d):
    """Tag to phrase, later rows win; the phrase column is found under any of its names."""
    raw = table(spark, d, "events").select(
        F.lit("").alias("코드명"), F.concat(F.lit("{단체"), (F.col("user_id") % 10).cast("string"), F.lit("}")).alias("태그명"),
        F.col("event_type").alias("적용문구"), F.lit("단체").alias("담보속성"), F.lit("1").alias("적용구분"), "event_id",
    )
    phrases = assembly.phrase_table(raw, "event_id")
    return phrases.groupBy("tag").agg(F.max_by("phrase", "pos").alias("phrase"))


@query("a17", """
SELECT doc_id, coalesce(string_agg(' L' || CAST(i AS VARCHAR) || '수정,', '' ORDER BY i) FILTER (ok), '') AS success_log,
  coalesce(string_agg(' L' || CAST(i AS VARCHAR) || ':해당별표없음,', '' ORDER BY i) FILTER (NOT ok), '') AS failure_log
FROM (SELECT doc_id, i, length(l) % 3 <> 0 AS ok FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
GROUP BY 1""")
def a17(spark, d):
    """Success and failure log per item (here the lines of a document)."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = lines.select("doc_id", (F.col("i") + 1).alias("i"), F.concat(F.lit("L"), (F.col("i") + 1).cast("string")).alias("product"), (F.length("line") % 3 != 0).alias("ok"))
    return assembly.success_log(rows, ["doc_id"], "product", F.col("ok"), "i")


# --- file lists

def event_files(spark, d) -> DataFrame:
    """File names with equal times now and then."""
    kind, i = F.col("event_type"), F.col("event_id").cast("string")
    label = F.when(kind == "view", "상해").when(kind == "click", "질병").when(kind == "signup", "상해질병").when(kind == "error", "PET").otherwise("약관")
    return table(spark, d, "events").select(
        "event_id", F.concat(label, F.lit("_"), i, F.lit(".docx")).alias("name"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("mtime")
    )


FILES_SQL = """fl AS (SELECT event_id, CASE event_type WHEN 'view' THEN '상해' WHEN 'click' THEN '질병' WHEN 'signup' THEN '상해질병' WHEN 'error' THEN 'PET' ELSE '약관' END
  || '_' || CAST(event_id AS VARCHAR) || '.docx' AS name, date_trunc('hour', ts) AS mtime FROM events)"""


@query("a7", f"""
WITH {FILES_SQL}, t AS (SELECT unnest(['상해', '질병', '상해질병', 'pet', '태아']) AS term),
m AS (SELECT term, name, mtime, event_id FROM t JOIN fl ON contains(lower(name), lower(term)) AND NOT (term IN ('상해', '질병') AND contains(name, '상해질병')))
SELECT t.term, coalesce(name, '-') AS name, strftime(mtime, '%Y-%m-%d %H:%M') AS mtime FROM t LEFT JOIN
  (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY term ORDER BY mtime DESC, event_id) = 1) b ON b.term = t.term""")
def a7(spark, d):
    """Most recent file per term."""
    out = files.most_recent(event_files(spark, d), ["상해", "질병", "상해질병", "pet", "태아"], "name", "mtime", "event_id")
    return out.withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd HH:mm"))


@query("a8", """
WITH f AS (SELECT event_id, date_trunc('hour', ts) AS mtime, CASE WHEN event_type = 'error' THEN 'abc' ELSE CAST(user_id % 20 AS VARCHAR) END
  || CASE WHEN event_type = 'view' THEN '_간편_' WHEN event_type = 'click' THEN '-' ELSE '_일반_' END || CAST(event_id AS VARCHAR) AS name FROM events),
g AS (SELECT *, CASE WHEN contains(name, '_') THEN coalesce(TRY_CAST(split_part(name, '_', 1) AS INT), -1) ELSE -1 END AS group_no, contains(name, '_간편_') AS simple FROM f)
SELECT group_no, coalesce(arg_max(name, (mtime, -event_id)) FILTER (NOT simple), '') AS normal_file, coalesce(arg_max(name, (mtime, -event_id)) FILTER (simple), '') AS simple_file
FROM g GROUP BY 1""")
def a8(spark, d):
    """Most recent normal and simplified file per group number."""
    kind = F.col("event_type")
    head = F.when(kind == "error", "abc").otherwise((F.col("user_id") % 20).cast("string"))
    mid = F.when(kind == "view", "_간편_").when(kind == "click", "-").otherwise("_일반_")
    listed = table(spark, d, "events").select(
        "event_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("mtime"), F.concat(head, mid, F.col("event_id").cast("string")).alias("name")
    )
    return files.rider_files(listed, "name", "mtime", "event_id")


PATHS_SQL = """paths AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path FROM pages),
parts AS (SELECT page_id, path, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS stem,
  CASE WHEN regexp_extract(path, '([^/]*)/[^/]*$', 1) = '' THEN 'default_group' ELSE regexp_extract(path, '([^/]*)/[^/]*$', 1) END AS folder FROM paths)"""


def page_paths(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))


@query("a5", f"WITH {PATHS_SQL} SELECT stem AS group_key, count(*) AS n_files, min(path) AS first_file, max(path) AS last_file FROM parts GROUP BY 1")
def a5(spark, d):
    """Files grouped by stem."""
    return files.group_sizes(files.by_stem(page_paths(spark, d), "path"), "path")


@query("a6", f"WITH {PATHS_SQL} SELECT page_id, path, folder AS group_key FROM parts")
def a6(spark, d):
    """Files grouped by folder."""
    return files.by_folder(page_paths(spark, d), "path")


@query("a6_single", f"WITH {PATHS_SQL} SELECT page_id, '/docs/' || regexp_extract(path, '([^/]*)$', 1) AS path, stem AS group_key FROM parts")
def a6_single(spark, d):
    """All files in one folder: grouped by stem."""
    one = page_paths(spark, d).withColumn("path", F.concat(F.lit("/docs/"), tx.file_name(F.col("path"))))
    return files.by_folder(one, "path")


@query("a18", f"""
WITH {FILES_SQL} SELECT CASE WHEN contains(name, '상해질병') THEN '상해질병' WHEN contains(name, '상해') THEN '상해' WHEN contains(name, '질병') THEN '질병' ELSE '기타' END AS kind,
  arg_max(name, event_id) AS name FROM fl GROUP BY 1""")
def a18(spark, d):
    """Type to file, the last file of a type wins."""
    return files.last_of_type(event_files(spark, d), "name", tx.base_category(F.col("name")), "event_id")


@query("p10", """
WITH f AS (SELECT event_id, 'grp' || CAST(user_id AS VARCHAR) || CASE event_type WHEN 'view' THEN '.docx' WHEN 'click' THEN '.csv' WHEN 'signup' THEN '.DOC' WHEN 'error' THEN '.pdf' ELSE '.xlsx' END AS path FROM events),
g AS (SELECT *, split_part(path, '.', 1) AS k, lower(split_part(path, '.', 2)) AS ext FROM f)
SELECT k AS group_key, arg_min(path, event_id) FILTER (ext IN ('docx', 'doc')) AS document, arg_min(path, event_id) FILTER (ext IN ('csv', 'xlsx')) AS data
FROM g GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (ext IN ('docx', 'doc')) > 0 AND count(*) FILTER (ext IN ('csv', 'xlsx')) > 0""")
def p10(spark, d):
    """One document and one data file per reference group."""
    kind = F.col("event_type")
    ext = F.when(kind == "view", ".docx").when(kind == "click", ".csv").when(kind == "signup", ".DOC").when(kind == "error", ".pdf").otherwise(".xlsx")
    listed = table(spark, d, "events").select("event_id", F.concat(F.lit("grp"), F.col("user_id").cast("string"), ext).alias("path"))
    return files.reference_pairs(listed, "path", "event_id")
