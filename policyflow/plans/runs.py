"""The whole runs on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import flows, names
from ..operators import assembly
from .grouping import CHAIN_SQL, chain_inputs
from .registry import query, table
from .tagging import LOOKUP_SQL, PERIOD_SQL, PHRASES_SQL, phrase_rows

# --- extraction: part names and types are the items, every supplier is one answer about one attribute

_KEYS = ", ".join(f"'{k}'" for k in names.ATTRIBUTE_COLUMNS)
ANSWER_SQL = """ans AS (SELECT s_suppkey AS pos, [%s][CAST(s_suppkey %% 9 AS INT) + 1] AS attribute, CASE s_suppkey %% 4 WHEN 0 THEN 'ring' WHEN 1 THEN 'small' WHEN 2 THEN 'widget' ELSE 'blue' END AS rb,
  CASE WHEN s_suppkey %% 6 = 0 THEN '' ELSE 'Brand#' || s_nationkey END AS rt, 'C' || s_suppkey AS code, CASE s_suppkey %% 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf FROM supplier)""" % _KEYS
TITLES_SQL = "titles AS (SELECT * FROM (VALUES %s) v(attribute, attribute_name))" % ", ".join(f"('{k}', '{n}')" for k, n, _ in names.ATTRIBUTES)


def raw_answers(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    keys = F.array(*[F.lit(x) for x in names.ATTRIBUTE_COLUMNS])
    word = F.when(k % 4 == 0, "ring").when(k % 4 == 1, "small").when(k % 4 == 2, "widget").otherwise("blue")
    brand = F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")))
    conf = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    code = F.concat(F.lit("C"), k.cast("string"))
    obj = F.to_json(F.struct(
        word.alias("benefit_name"), brand.alias("template_name"), code.alias("inferred_code"), conf.alias("confidence"),
        F.lit("appendix").alias("source"), F.lit("3").alias("ref_page"), F.concat(F.lit("see "), code).alias("ref_sentence"),
    ))
    fenced = F.concat(F.lit("```json\n["), obj, F.lit("]\n```"))
    broken = F.concat(F.lit("Here: ["), obj, F.lit(", {oops},]"))
    return table(spark, d, "supplier").select(
        F.element_at(keys, (k % 9 + 1).cast("int")).alias("attribute"), k.alias("pos"), F.when(k % 2 == 0, fenced).otherwise(broken).alias("raw")
    )


@query("extraction", f"""
WITH items AS (SELECT p_partkey, p_name AS bn, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS tn FROM part), {ANSWER_SQL}, {TITLES_SQL},
r AS (SELECT attribute, rb, rt, min(pos) AS ord, arg_max(code, pos) AS code, arg_max(conf, pos) AS conf FROM ans GROUP BY 1, 2, 3),
dd AS (SELECT DISTINCT bn, tn FROM items),
near AS (SELECT r.attribute, bn, tn, arg_min(code, ord) AS code, arg_min(conf, ord) AS conf FROM dd JOIN r ON (contains(bn, rb) OR contains(rb, bn)) AND (contains(tn, rt) OR contains(rt, tn)) GROUP BY 1, 2, 3)
SELECT p_partkey, t.attribute, coalesce(code, '') AS inferred_code, '[' || attribute_name || '] ' || CASE WHEN code IS NULL THEN '[미매칭: API 응답에서 해당 담보를 찾지 못함]' ELSE 'see ' || code END AS reason,
  CASE WHEN conf = 'high' THEN 'auto_confirmed' ELSE 'review_needed' END AS verification_status
FROM items CROSS JOIN titles t LEFT JOIN near ON near.attribute = t.attribute AND near.bn = items.bn AND near.tn = items.tn""")
def extraction(spark, d):
    """Answers to result rows of all nine attributes, matched, reasoned, scored and gated."""
    n = F.col("p_size")
    items = table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("benefit_name"), F.when(n % 10 == 0, "").otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("template_name")
    )
    out = flows.extract(items, raw_answers(spark, d))
    return out.select("p_partkey", "attribute", "inferred_code", "reason", "verification_status")


# --- risk items: part names are the risks, every part is one answer with two items, some of them broken


def risk_targets(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("pos"), F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("위험률ID"), F.col("p_name").alias("위험률명")
    )


@query("risk_batches", """
WITH f AS (SELECT p_name AS risk, min(p_partkey) AS first_pos FROM part GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY first_pos) AS row_no FROM f)
SELECT risk, first_pos, row_no, CAST((row_no - 1) // 5 + 1 AS BIGINT) AS batch_no, (SELECT CAST(ceil(count(*) / 5.0) AS BIGINT) FROM f) AS batch_total FROM n""")
def risk_batches(spark, d):
    """Distinct risks in batches of five."""
    return flows.risk_batches(risk_targets(spark, d), "pos")


@query("risk_items", """
WITH t AS (SELECT p_name AS name, 'R' || CAST(min(p_partkey) AS VARCHAR) AS id FROM part GROUP BY 1), k AS (SELECT unnest(['보장유형', '지급유형']) AS kind)
SELECT id AS "위험률ID", name AS "위험률명", p_brand AS "항목구분코드", kind AS "항목구분명", CAST(p_size AS VARCHAR) AS "항목값코드", p_type AS "항목값명", 'why' AS "선정근거"
FROM part JOIN t ON t.name = p_name CROSS JOIN k WHERE p_size % 5 <> 0""")
def risk_items(spark, d):
    """Item rows of the answers with the id of their risk."""
    part = table(spark, d, "part", spread=True)
    one = lambda kind: F.to_json(F.struct(
        F.col("p_name").alias("위험률명"), F.col("p_brand").alias("항목구분코드"), F.lit(kind).alias("항목구분명"),
        F.col("p_size").alias("항목값코드"), F.col("p_type").alias("항목값명"), F.lit("why").alias("선정근거"),
    ))
    broken = F.when(F.col("p_size") % 5 == 0, ", {").otherwise("")
    raw = part.select(F.concat(F.lit("```json\n["), one("보장유형"), F.lit(", "), one("지급유형"), broken, F.lit("]\n```")).alias("raw"))
    return flows.risk_items(risk_targets(spark, d), raw, "pos")


# --- terms: customers are the coverages, parts the clauses, nations the sections

BODY = "{면책0-1}면책 {면책0-2}{감액있음1-3}전액 {감액있음1-4}{감액기간1-1}/{감액기간2-1}/{지급률1-1-1}%|{지급률1-2-1}*2|{세부보장2}{부모3}."


@query("terms", f"""
WITH {CHAIN_SQL}, {PHRASES_SQL}, {LOOKUP_SQL},
mp AS (SELECT s_suppkey AS pos, 'D' || CAST(s_suppkey % 47 AS VARCHAR) AS coverage_code, 'R' || CAST(s_suppkey % 31 AS VARCHAR) AS rep_code, CASE s_nationkey % 3 WHEN 0 THEN '상해' WHEN 1 THEN '질병' ELSE '펫' END AS category FROM supplier),
m1 AS (SELECT coverage_code, arg_min(rep_code, pos) AS code, arg_min(category, pos) AS category FROM mp GROUP BY 1),
sb AS (SELECT 'ZD' || lpad(CAST(s_suppkey % 150 AS VARCHAR), 7, '0') AS sub_code, arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY 1),
rg AS (SELECT 'R' || CAST(p_partkey % 40 AS VARCHAR) AS code, CASE p_size % 3 WHEN 0 THEN '상해' WHEN 1 THEN '질병' ELSE '펫' END AS category, p_partkey AS comment_no, 'T' || CAST(p_partkey % 500 AS VARCHAR) AS title, p_name AS body FROM part),
per AS (SELECT code, category, arg_max(title, comment_no) AS title, arg_max(body, comment_no) AS body, min(comment_no) AS seen FROM rg GROUP BY 1, 2),
fb AS (SELECT code, arg_min(title, seen) AS title, arg_min(body, seen) AS body FROM per GROUP BY 1),
f AS (SELECT c.c_custkey, m1.category, coalesce(per.title, fb.title) AS title, CASE WHEN per.title IS NOT NULL THEN per.body ELSE fb.body END AS body
  FROM cov c JOIN m1 USING (coverage_code) LEFT JOIN per ON per.code = m1.code AND per.category = m1.category LEFT JOIN fb ON fb.code = m1.code),
o AS (SELECT * FROM f WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY c_custkey) = 1),
sec AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN '상해' WHEN 1 THEN '질병' ELSE '펫' END || '관련 특별약관' AS section, min(n_nationkey) AS section_no FROM nation GROUP BY 1),
fl AS (SELECT c_custkey, sum(exempt_days) > 0 AS exempt, sum(days) > 0 AS reduce FROM chain GROUP BY 1),
nonempty AS (SELECT c_custkey, list_sort(list_filter([days, days2], lambda x: x IS NOT NULL AND x <> 0))[1] AS p, row_number() OVER (PARTITION BY c_custkey ORDER BY sub_no) AS n FROM chain WHERE coalesce(days, 0) <> 0 OR coalesce(days2, 0) <> 0),
rate AS (SELECT c_custkey, sub_no, CASE WHEN rate IS NULL OR rate = 0 THEN 100 ELSE rate END AS v, sub_code FROM chain)
SELECT CAST(section_no AS INT) AS section_no, row_number() OVER (PARTITION BY section_no ORDER BY o.c_custkey) AS line_no, title,
  o.body || CASE WHEN coalesce(fl.exempt, false) THEN '면책 ' ELSE '' END || CASE WHEN coalesce(fl.reduce, false) THEN '' ELSE '전액 ' END
  || coalesce({PERIOD_SQL.format('n1.p')}, 'NA') || '/' || coalesce({PERIOD_SQL.format('n2.p')}, 'NA') || '/'
  || CASE WHEN r1.v IS NULL THEN '' ELSE CAST(r1.v AS VARCHAR) || '%' END || '|' || CASE WHEN r2.v IS NULL THEN '' ELSE CAST(r2.v * 2 AS VARCHAR) END || '|'
  || CASE WHEN r1.sub_code IS NULL THEN '' ELSE '「' || coalesce(sb.name, r1.sub_code) || '」' END || coalesce(w.phrase, '') || '.' AS body
FROM o JOIN sec ON section = category || '관련 특별약관' LEFT JOIN fl ON fl.c_custkey = o.c_custkey
LEFT JOIN nonempty n1 ON n1.c_custkey = o.c_custkey AND n1.n = 1 LEFT JOIN nonempty n2 ON n2.c_custkey = o.c_custkey AND n2.n = 2
LEFT JOIN rate r1 ON r1.c_custkey = o.c_custkey AND r1.sub_no = 1 LEFT JOIN rate r2 ON r2.c_custkey = o.c_custkey AND r2.sub_no = 2
LEFT JOIN sb ON sb.sub_code = r1.sub_code LEFT JOIN w ON w.tag = '{{부모3}}' AND w.attribute = '부모' AND w.wanted = CASE WHEN o.c_custkey % 2 > 0 THEN 1 ELSE 0 END""")
def terms(spark, d):
    """Coverages to rendered clauses in document order."""
    _, model, structure, multiple = chain_inputs(spark, d)
    k, s, p, n = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey"), F.col("n_nationkey")
    kind = lambda c: F.when(c % 3 == 0, "상해").when(c % 3 == 1, "질병").otherwise("펫")
    coverages = table(spark, d, "customer").select(
        k.alias("pos"), F.concat(F.lit("D"), (k % 53).cast("string")).alias("coverage_code"), F.lit("").alias("module"), (k % 2).alias("parent")
    )
    suppliers = table(spark, d, "supplier")
    mapping = suppliers.select(
        s.alias("pos"), F.concat(F.lit("D"), (s % 47).cast("string")).alias("coverage_code"),
        F.concat(F.lit("R"), (s % 31).cast("string")).alias("rep_code"), kind(F.col("s_nationkey")).alias("category"), F.lit("").alias("name"),
    )
    sub_codes = suppliers.select(
        s.alias("pos"), F.concat(F.lit("ZD"), F.lpad((s % 150).cast("string"), 7, "0")).alias("coverage_code"), F.lit("").alias("rep_code"), F.lit("").alias("category"), F.col("s_name").alias("name")
    )
    clauses = table(spark, d, "part").select(
        F.concat(F.lit("R"), (p % 40).cast("string")).alias("code"), kind(F.col("p_size")).alias("category"), p.alias("comment_no"),
        F.concat(F.lit("T"), (p % 500).cast("string")).alias("title"), F.concat("p_name", F.lit(BODY)).alias("body"),
    )
    sections = table(spark, d, "nation").select(assembly.section_title(F.lit(""), kind(n)).alias("section"), n.alias("section_no"))
    return flows.generate_terms(
        coverages, mapping, clauses, sections, phrase_rows(spark, d), model, structure, multiple, F.lit("P123"), sub_names=sub_codes
    )
