"""Codes, ranges and lookups on parts, suppliers, customers and nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codes
from ..operators import containment, lookups, ranges
from .registry import query, table

# a code from a whole number: letter and two digits, some with a decimal
CODE_SQL = "chr(CAST(65 + {k} % 26 AS INT)) || lpad(CAST({k} % 100 AS VARCHAR), 2, '0') || CASE WHEN {k} % 7 = 0 THEN '.' || CAST({k} % 10 AS VARCHAR) ELSE '' END"


def code_of(k):
    plain = F.concat(F.char(65 + k % 26), F.lpad((k % 100).cast("string"), 2, "0"))
    return F.when(k % 7 == 0, F.concat(plain, F.lit("."), (k % 10).cast("string"))).otherwise(plain)


def ranges_of(spark, d) -> DataFrame:
    """One range per supplier: some within a letter, some over letters, some without TO or FROM."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    low = F.when(k % 31 == 30, "").otherwise(F.concat(F.char(65 + k % 26), F.lpad((k % 90).cast("string"), 2, "0")))
    high = F.concat(F.char(65 + (k % 26) + F.when(k % 5 == 0, 1).otherwise(0)), F.lpad((k % 90 + n % 10).cast("string"), 2, "0"))
    return table(spark, d, "supplier").select(
        low.alias("FROM_code"), F.when(k % 11 == 0, F.lit(None)).otherwise(high).alias("TO_code"),
        F.concat(F.lit("0"), n.cast("string")).alias("분류번호"),
    )


RANGES_SQL = """
rules AS (
  SELECT CASE WHEN s_suppkey % 31 = 30 THEN '' ELSE chr(CAST(65 + s_suppkey % 26 AS INT)) || lpad(CAST(s_suppkey % 90 AS VARCHAR), 2, '0') END AS lo,
         CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE chr(CAST(65 + (s_suppkey % 26) + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS INT))
              || lpad(CAST(s_suppkey % 90 + s_nationkey % 10 AS VARCHAR), 2, '0') END AS hi0,
         '0' || CAST(s_nationkey AS VARCHAR) AS code
  FROM supplier),
parsed AS (
  SELECT lo, coalesce(hi0, lo) AS hi, code,
    regexp_extract(lo, '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 1) AS fa, CAST(regexp_extract(lo, '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 2) AS DOUBLE) AS fx,
    CASE WHEN regexp_matches(coalesce(hi0, lo), '^[A-Z]+\\d') THEN regexp_extract(coalesce(hi0, lo), '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 1) ELSE coalesce(hi0, lo) END AS ta,
    coalesce(TRY_CAST(regexp_extract(coalesce(hi0, lo), '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 2) AS DOUBLE), 0) AS tx
  FROM rules WHERE lo <> ''),
points AS (
  SELECT p_partkey, kcd, regexp_extract(kcd, '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 1) AS a,
    CAST(regexp_extract(kcd, '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 2) AS DOUBLE) AS x
  FROM (SELECT p_partkey, CODE_EXPR AS kcd FROM part))
""".replace("CODE_EXPR", CODE_SQL.format(k="p_partkey"))


def parts_with_code(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", code_of(F.col("p_partkey")).alias("kcd"))


@query("f1", f"""
SELECT p_partkey, kcd, CASE WHEN regexp_matches(kcd, '^[A-Z]+\\d') THEN regexp_extract(kcd, '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 1) ELSE kcd END AS alpha,
       coalesce(TRY_CAST(regexp_extract(kcd, '^([A-Z]+)(\\d+(?:\\.\\d+)?)', 2) AS DOUBLE), 0.0) AS num
FROM (SELECT p_partkey, upper(CASE WHEN p_size % 9 = 0 THEN p_name ELSE {CODE_SQL.format(k='p_partkey')} END) AS kcd FROM part)
""")
def f1(spark, d):
    """Code parse."""
    raw = F.when(F.col("p_size") % 9 == 0, F.col("p_name")).otherwise(code_of(F.col("p_partkey")))
    parts = table(spark, d, "part").select("p_partkey", F.upper(raw).alias("kcd"))
    return parts.select("p_partkey", "kcd", codes.parse(F.col("kcd")).alias("p")).select("p_partkey", "kcd", "p.alpha", "p.num")


_F2 = """
SELECT p_partkey, kcd, lo, hi,
  CASE WHEN a = fa THEN x BETWEEN fx AND tx ELSE fa <= a AND a <= ta END AS reference_hit,
  (a > fa OR (a = fa AND x >= fx)) AND (a < ta OR (a = ta AND x <= tx)) AS ordered_hit,
  CASE WHEN a = fa THEN floor(x) BETWEEN floor(fx) AND floor(tx) ELSE fa <= a AND a <= ta END AS whole_hit
FROM (SELECT *, regexp_extract(kcd, '^([A-Z]+)', 1) AS a, CAST(regexp_extract(kcd, '([0-9.]+)$', 1) AS DOUBLE) AS x,
             substr(lo, 1, 1) AS fa, CAST(substr(lo, 2) AS DOUBLE) AS fx, substr(hi, 1, 1) AS ta, CAST(substr(hi, 2) AS DOUBLE) AS tx
      FROM (SELECT p_partkey, CODE_EXPR AS kcd, 'C' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS lo,
                   CASE WHEN p_size % 3 = 0 THEN 'F' ELSE 'C' END || lpad(CAST(p_size + 20 AS VARCHAR), 2, '0') AS hi FROM part))
""".replace("CODE_EXPR", CODE_SQL.format(k="p_partkey"))


@query("f2", _F2)
def f2(spark, d):
    """Code in range, with the documented modes."""
    size = F.lpad(F.col("p_size").cast("string"), 2, "0")
    top = F.lpad((F.col("p_size") + 20).cast("string"), 2, "0")
    rows = table(spark, d, "part").select(
        "p_partkey", code_of(F.col("p_partkey")).alias("kcd"), F.concat(F.lit("C"), size).alias("lo"),
        F.concat(F.when(F.col("p_size") % 3 == 0, "F").otherwise("C"), top).alias("hi"),
    )
    args = (F.col("kcd"), F.col("lo"), F.col("hi"))
    return rows.select(
        "*", codes.in_range(*args).alias("reference_hit"), codes.in_range(*args, mode="ordered").alias("ordered_hit"),
        codes.in_range(*args, whole=True).alias("whole_hit"),
    )


@query("j5", f"""
WITH {RANGES_SQL}
SELECT p_partkey, kcd, code, lo AS "from", hi AS "to", 'range' AS match_type
FROM points JOIN parsed ON CASE WHEN a = fa THEN x BETWEEN fx AND tx ELSE fa <= a AND a <= ta END
""")
def j5(spark, d):
    """Code range join, columns found by name."""
    rules = ranges_of(spark, d)
    found = ranges.find_range_columns(rules.columns)
    return ranges.map_codes(parts_with_code(spark, d), "kcd", rules, found["from"], found["to"], "분류번호")


@query("j5_ordered", f"""
WITH {RANGES_SQL}
SELECT p_partkey, kcd, code, lo AS "from", hi AS "to", 'range' AS match_type
FROM points JOIN parsed ON (a > fa OR (a = fa AND x >= fx)) AND (a < ta OR (a = ta AND x <= tx))
""")
def j5_ordered(spark, d):
    """Code range join with (letters, number) order."""
    return ranges.map_codes(parts_with_code(spark, d), "kcd", ranges_of(spark, d), "FROM_code", "TO_code", "분류번호", mode="ordered")


@query("flagship", f"""
WITH {RANGES_SQL.replace('p_partkey, kcd, regexp', 'kcd, regexp').replace("SELECT p_partkey, " + CODE_SQL.format(k='p_partkey') + " AS kcd FROM part", "SELECT DISTINCT " + CODE_SQL.format(k='l_partkey') + " AS kcd FROM lineitem")},
mapped AS (
  SELECT kcd, count(*) AS rules FROM points JOIN parsed ON CASE WHEN a = fa THEN x BETWEEN fx AND tx ELSE fa <= a AND a <= ta END GROUP BY kcd),
lines AS (SELECT {CODE_SQL.format(k='l_partkey')} AS kcd, l_returnflag, l_discount FROM lineitem)
SELECT l_returnflag, CASE WHEN l_discount >= 0.05 AND rules IS NOT NULL THEN 'auto_confirmed' ELSE 'review_needed' END AS verification_status,
       count(*) AS n_lines, CAST(sum(coalesce(rules, 0)) AS BIGINT) AS n_rules
FROM lines LEFT JOIN mapped USING (kcd) GROUP BY 1, 2
""")
def flagship(spark, d):
    """Codes of all lines mapped by range, gated and counted."""
    lines = table(spark, d, "lineitem").select(code_of(F.col("l_partkey")).alias("kcd"), "l_returnflag", "l_discount")
    found = ranges.matches(lines.select("kcd"), ranges_of(spark, d), "FROM_code", "TO_code", "분류번호")
    per_code = found.groupBy(F.col("probe").alias("kcd")).agg(F.count("*").alias("rules"))
    joined = lines.join(per_code, "kcd", "left")
    status = F.when((F.col("l_discount") >= 0.05) & F.col("rules").isNotNull(), "auto_confirmed").otherwise("review_needed")
    return joined.groupBy("l_returnflag", status.alias("verification_status")).agg(
        F.count("*").alias("n_lines"), F.sum(F.coalesce("rules", F.lit(0))).alias("n_rules")
    )


# coverage codes of customers, and a representative table from suppliers
COVER_SQL = "CASE WHEN c_custkey % 3 = 0 THEN 'ZX' ELSE 'ZD' END || lpad(CAST(c_custkey % 211 AS VARCHAR), 7, '0')"
REP_SQL = """SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 4 = 0 THEN 'ZR' ELSE 'ZD' END || lpad(CAST((s_suppkey * 3) % 157 AS VARCHAR), 7, '0') AS coverage_code,
  'R' || CAST(s_nationkey AS VARCHAR) AS rep_code, CASE WHEN s_acctbal < 0 THEN '상해' WHEN s_acctbal < 5000 THEN '질병' ELSE '기타' END AS category FROM supplier"""


def coverages(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    code = F.concat(F.when(k % 3 == 0, "ZX").otherwise("ZD"), F.lpad((k % 211).cast("string"), 7, "0"))
    return table(spark, d, "customer").select("c_custkey", code.alias("coverage_code"))


def representatives(spark, d) -> DataFrame:
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    code = F.concat(F.when(k % 4 == 0, "ZR").otherwise("ZD"), F.lpad(((k * 3) % 157).cast("string"), 7, "0"))
    kind = F.when(bal < 0, "상해").when(bal < 5000, "질병").otherwise("기타")
    return table(spark, d, "supplier").select(
        k.alias("pos"), code.alias("coverage_code"), F.concat(F.lit("R"), F.col("s_nationkey").cast("string")).alias("rep_code"), kind.alias("category")
    )


@query("j1", f"""
WITH rep AS ({REP_SQL}), firsts AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY coverage_code ORDER BY pos) = 1)
SELECT c_custkey, c.coverage_code, rep_code, category FROM (SELECT c_custkey, {COVER_SQL} AS coverage_code FROM customer) c LEFT JOIN firsts USING (coverage_code)
""")
def j1(spark, d):
    """Exact key lookup, first row wins."""
    return lookups.exact_lookup(coverages(spark, d), representatives(spark, d), "coverage_code", "coverage_code", ["rep_code", "category"], "pos")


_TIERS = f"""
WITH rep AS ({REP_SQL}), cov AS (SELECT c_custkey, {COVER_SQL} AS coverage_code FROM customer),
ex AS (SELECT coverage_code AS k, min(pos) AS p FROM rep GROUP BY 1), su AS (SELECT right(coverage_code, 7) AS k, min(pos) AS p FROM rep GROUP BY 1),
hit AS (SELECT c_custkey, coverage_code, ex.p AS ep, su.p AS sp FROM cov LEFT JOIN ex ON ex.k = coverage_code LEFT JOIN su ON su.k = right(coverage_code, 7))
SELECT c_custkey, h.coverage_code, coalesce(rep_code, '') AS rep_code, coalesce(category, '') AS category, CASE WHEN rep_code IS NULL THEN '찾기에러' ELSE '' END AS "check"
FROM hit h LEFT JOIN rep ON rep.pos = """


@query("j2", _TIERS + "coalesce(ep, sp)")
def j2(spark, d):
    """Exact, then last seven characters."""
    return lookups.tiered_lookup(coverages(spark, d), representatives(spark, d), "coverage_code", "coverage_code", ["rep_code", "category"], "pos")


@query("j2_row_order", _TIERS + "least(ep, sp)")
def j2_row_order(spark, d):
    """Exact or suffix, whichever row stands first."""
    return lookups.tiered_lookup(
        coverages(spark, d), representatives(spark, d), "coverage_code", "coverage_code", ["rep_code", "category"], "pos", priority="row_order"
    )


@query("j3", f"""
WITH rep AS (SELECT pos, right(coverage_code, 7) AS short_code, rep_code FROM ({REP_SQL})),
f AS (SELECT short_code, arg_min(rep_code, pos) AS rep_code FROM rep GROUP BY 1)
SELECT c_custkey, coverage_code, coalesce(rep_code, '찾기에러') AS rep_code
FROM (SELECT c_custkey, {COVER_SQL} AS coverage_code FROM customer) LEFT JOIN f ON short_code = right(coverage_code, 7)
""")
def j3(spark, d):
    """Last seven characters against whole stored codes."""
    short = representatives(spark, d).withColumn("coverage_code", F.right("coverage_code", F.lit(7)))
    return lookups.whole_suffix_lookup(coverages(spark, d), short, "coverage_code", "coverage_code", "rep_code", "pos")


@query("j4", f"""
WITH rep AS ({REP_SQL}), v AS (SELECT coverage_code, rep_code, min(pos) AS fp FROM rep GROUP BY 1, 2),
a AS (SELECT coverage_code, string_agg(rep_code, ',' ORDER BY fp) AS all_codes, count(*) AS n FROM v GROUP BY 1),
c AS (SELECT coverage_code, arg_max(category, pos) AS category FROM rep GROUP BY 1)
SELECT c_custkey, cov.coverage_code, CASE WHEN n IS NULL THEN '찾기에러' WHEN n = 1 THEN all_codes ELSE '' END AS rep_code,
  coalesce(category, '') AS category, CASE WHEN n > 1 THEN all_codes ELSE '' END AS rep_codes
FROM (SELECT c_custkey, {COVER_SQL} AS coverage_code FROM customer WHERE c_mktsegment <> 'BUILDING') cov LEFT JOIN a USING (coverage_code) LEFT JOIN c USING (coverage_code)
""")
def j4(spark, d):
    """All distinct representatives of a code; rows already filled are left out."""
    segments = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    todo = coverages(spark, d).join(segments, "c_custkey")
    out = lookups.multi_lookup(
        todo, representatives(spark, d), "coverage_code", "coverage_code", "rep_code", "category", "pos",
        F.col("c_mktsegment") == "BUILDING",
    )
    return out.drop("c_mktsegment")


@query("j6", """
WITH cells AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS code, n_nationkey AS pos, 'n_nationkey' AS col, upper(CAST(n_nationkey AS VARCHAR)) AS cell FROM nation
  UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey, 'n_name', upper(n_name) FROM nation
  UNION ALL SELECT CAST(n_nationkey AS VARCHAR), n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation)
SELECT c_custkey, probe, code, 'exact' AS match_type, col AS "column" FROM
  (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'nation_' || CAST(c_nationkey AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS probe FROM customer)
  JOIN cells ON cell = upper(probe)
""")
def j6(spark, d):
    """Code equal to any cell of a table without range columns."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    probe = table(spark, d, "customer").select(k, F.when(k % 2 == 0, F.concat(F.lit("nation_"), n)).otherwise(n).alias("probe"))
    cells = table(spark, d, "nation").withColumn("pos", F.col("n_nationkey"))
    return ranges.map_to_table(probe, "probe", cells, "pos").drop("column_no", "table_pos")


@query("j7", """
WITH known AS (SELECT '0' || CAST(s_nationkey AS VARCHAR) AS c FROM supplier UNION SELECT s_name FROM supplier)
SELECT c_custkey, probe, probe IN (SELECT c FROM known) AS valid
FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '0' || CAST(c_nationkey AS VARCHAR) ELSE replace(c_name, 'Customer', 'Supplier') END AS probe FROM customer)
""")
def j7(spark, d):
    """Code existence check."""
    k = F.col("c_custkey")
    probe = F.when(k % 2 == 0, F.concat(F.lit("0"), F.col("c_nationkey").cast("string"))).otherwise(F.regexp_replace("c_name", "Customer", "Supplier"))
    codes_ = table(spark, d, "supplier").select(
        F.concat(F.lit("0"), F.col("s_nationkey").cast("string")).alias("분류번호"), F.col("s_name").alias("담보코드"), "s_acctbal"
    )
    rows = table(spark, d, "customer").select(k, probe.alias("probe"))
    return lookups.code_exists(rows, codes_, "probe", ranges.find_code_columns(codes_.columns))


@query("j8", """
WITH r AS (SELECT p_name AS benefit_name, CASE WHEN p_size > 10 THEN p_brand ELSE p_brand || 'x' END AS template_name, arg_max(CAST(p_size AS VARCHAR), p_partkey) AS inferred_code, arg_max(p_type, p_partkey) AS mapping_reason
           FROM part GROUP BY 1, 2)
SELECT p_partkey, p.benefit_name, p.template_name, coalesce(inferred_code, '') AS inferred_code, coalesce(mapping_reason, '') AS mapping_reason
FROM (SELECT p_partkey, p_name AS benefit_name, p_brand AS template_name FROM part) p LEFT JOIN r USING (benefit_name, template_name)
""")
def j8(spark, d):
    """Composite exact join, later duplicates win, misses are ''."""
    part = table(spark, d, "part")
    items = part.select("p_partkey", F.col("p_name").alias("benefit_name"), F.col("p_brand").alias("template_name"))
    other = F.concat("p_brand", F.lit("x"))
    answers = part.select(
        F.col("p_name").alias("benefit_name"), F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise(other).alias("template_name"), F.col("p_partkey").alias("pos"),
        F.col("p_size").cast("string").alias("inferred_code"), F.col("p_type").alias("mapping_reason"),
    )
    return lookups.composite_lookup(items, answers, ["benefit_name", "template_name"], ["inferred_code", "mapping_reason"], "pos")


# items: part names and brands; responses: a coarser set of names per supplier with some empty ones
_J9_ITEMS = "SELECT p_partkey, p_name AS bn, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS tn FROM part"
_J9_ANSWERS = """
SELECT s_suppkey AS pos,
  CASE s_suppkey % 6 WHEN 0 THEN 'ring' WHEN 1 THEN 'small' WHEN 2 THEN 'a red widget set' WHEN 3 THEN 'blue' WHEN 4 THEN 'zz' ELSE 'widget' END AS rb,
  CASE WHEN s_suppkey % 17 = 0 THEN '' ELSE 'Brand#' || CAST(s_nationkey AS VARCHAR) END AS rt,
  'C' || CAST(s_suppkey AS VARCHAR) AS code FROM supplier"""
_J9_SQL = f"""
WITH items AS ({_J9_ITEMS}), ans AS ({_J9_ANSWERS}),
r AS (SELECT rb, rt, min(pos) AS ord, arg_max(code, pos) AS code FROM ans GROUP BY 1, 2),
d AS (SELECT DISTINCT bn, tn FROM items),
ex AS (SELECT bn, tn, code FROM d JOIN r ON rb = bn AND rt = tn),
near AS (SELECT bn, tn, arg_min(code, ord) AS code FROM d JOIN r
         ON (contains(bn, rb) OR contains(rb, bn)) AND (contains(tn, rt) OR contains(rt, tn)) GROUP BY 1, 2)
SELECT p_partkey, i.bn AS benefit_name, i.tn AS template_name, coalesce(ex.code, near.code, '') AS inferred_code,
       ex.code IS NOT NULL OR near.code IS NOT NULL AS matched
FROM items i LEFT JOIN ex USING (bn, tn) LEFT JOIN near USING (bn, tn)
"""


def match_items(spark, d) -> DataFrame:
    empty = F.col("p_size") % 10 == 0
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("benefit_name"),
        F.when(empty, "").otherwise(F.concat_ws(" ", "p_type", "p_brand")).alias("template_name"),
    )


def match_answers(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    word = F.when(k % 6 == 0, "ring").when(k % 6 == 1, "small").when(k % 6 == 2, "a red widget set").when(k % 6 == 3, "blue").when(k % 6 == 4, "zz").otherwise("widget")
    return table(spark, d, "supplier").select(
        k.alias("pos"), word.alias("benefit_name"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"))).alias("template_name"),
        F.concat(F.lit("C"), k.cast("string")).alias("inferred_code"),
    )


@query("j9", _J9_SQL)
def j9(spark, d):
    """Composite match with containment fallback."""
    return containment.match_responses(match_items(spark, d), match_answers(spark, d), "benefit_name", "template_name", ["inferred_code"], "pos")


@query("j10", """
WITH m AS (SELECT trim(p_brand) AS brand, arg_max(p_name, p_partkey) AS description FROM part GROUP BY 1)
SELECT s_suppkey, probe, coalesce(description, '') AS description
FROM (SELECT s_suppkey, ' Brand#' || CAST(s_nationkey AS VARCHAR) AS probe FROM supplier) LEFT JOIN m ON trim(probe) = brand
""")
def j10(spark, d):
    """Code to description, last duplicate wins."""
    texts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_name").alias("description"))
    probe = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit(" Brand#"), F.col("s_nationkey").cast("string")).alias("probe"))
    return lookups.describe_code(probe, texts, "probe", "brand", "description", "p_partkey")


@query("j11", """
SELECT o_orderkey, o_custkey % 97 AS risk, c_name, c_mktsegment FROM orders
LEFT JOIN (SELECT c_custkey % 89 AS risk, arg_min(c_name, c_custkey) AS c_name, arg_min(c_mktsegment, c_custkey) AS c_mktsegment FROM customer GROUP BY 1) t
ON t.risk = o_custkey % 97
""")
def j11(spark, d):
    """Item rows with the first target row of their risk."""
    items = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("risk"))
    targets = table(spark, d, "customer").select((F.col("c_custkey") % 89).alias("risk"), "c_custkey", "c_name", "c_mktsegment")
    return lookups.join_first(items, targets, "risk", "c_custkey").select("o_orderkey", "risk", "c_name", "c_mktsegment")


_J13_CATEGORY = "CASE c_nationkey % 3 WHEN 0 THEN '상해' WHEN 1 THEN '질병' ELSE '기타' END"


@query("j13", f"""
WITH rep AS ({REP_SQL}), per AS (SELECT rep_code, category, arg_max(coverage_code, pos) AS title, min(pos) AS seen FROM rep GROUP BY 1, 2),
fb AS (SELECT rep_code, arg_min(title, seen) AS any_title FROM per GROUP BY 1),
docs AS (SELECT category, arg_max(coverage_code, pos) AS doc FROM rep GROUP BY 1), first_doc AS (SELECT arg_min(coverage_code, pos) AS d0 FROM rep)
SELECT c_custkey, k.rep_code, k.category, coalesce(title, any_title) AS title, coalesce(doc, d0) AS document
FROM (SELECT c_custkey, 'R' || CAST(c_nationkey + c_custkey % 3 AS VARCHAR) AS rep_code, CASE WHEN c_custkey % 10 = 0 THEN '펫' ELSE {_J13_CATEGORY} END AS category FROM customer) k
LEFT JOIN per USING (rep_code, category) LEFT JOIN fb USING (rep_code) LEFT JOIN docs ON docs.category = k.category CROSS JOIN first_doc
""")
def j13(spark, d):
    """Clause range by code and category with fallback, base document by category with fallback."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    kind = F.when(k % 10 == 0, "펫").when(n % 3 == 0, "상해").when(n % 3 == 1, "질병").otherwise("기타")
    wanted = table(spark, d, "customer").select(k, F.concat(F.lit("R"), (n + k % 3).cast("string")).alias("rep_code"), kind.alias("category"))
    rep = representatives(spark, d)
    ranges_ = rep.select("rep_code", "category", "pos", F.col("coverage_code").alias("title"))
    documents = rep.select("category", F.col("coverage_code").alias("document"), "pos")
    found = lookups.category_lookup(wanted, ranges_, "rep_code", "category", ["title"], "pos")
    return lookups.document_for_category(found, documents, "category", "document", "pos")


@query("j15", """
WITH cov AS (SELECT c_custkey, 'ZD' || lpad(CAST(c_custkey % 509 AS VARCHAR), 7, '0') AS code FROM customer),
keys AS (SELECT DISTINCT 'P1_X' || lpad(CAST(s_suppkey % 211 AS VARCHAR), 7, '0') || '_' || CAST(s_nationkey AS VARCHAR) AS k FROM supplier),
gate AS (SELECT DISTINCT code FROM cov WHERE EXISTS (SELECT 1 FROM keys WHERE contains(k, right(code, 7)))),
mult AS (SELECT p_partkey, 'ZD' || lpad(CAST(p_partkey % 307 AS VARCHAR), 7, '0') AS a, 'ZD' || lpad(CAST(p_size AS VARCHAR), 7, '0') AS b,
                CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS exempt, CASE WHEN p_partkey % 5 = 0 THEN 90 ELSE 0 END AS reduce FROM part),
longs AS (SELECT 0 AS no, a AS cell, exempt, reduce FROM mult UNION ALL SELECT 1, b, exempt, reduce FROM mult),
per AS (SELECT cell, no, sum(exempt) AS se, sum(reduce) AS sr FROM longs GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cell ORDER BY no) = 1)
SELECT c_custkey, cov.code, CASE WHEN g.code IS NOT NULL AND se > 0 THEN 1 ELSE 0 END AS exempt_flag, CASE WHEN g.code IS NOT NULL AND sr > 0 THEN 1 ELSE 0 END AS reduce_flag
FROM cov LEFT JOIN gate g USING (code) LEFT JOIN per ON cell = cov.code
""")
def j15(spark, d):
    """Flags behind a containment gate, summed over the first leading column with a hit."""
    pad = lambda c: F.lpad(c.cast("string"), 7, "0")
    cov = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("ZD"), pad(F.col("c_custkey") % 509)).alias("code"))
    structure = table(spark, d, "supplier").select(
        F.concat(F.lit("P1_X"), pad(F.col("s_suppkey") % 211), F.lit("_"), F.col("s_nationkey").cast("string")).alias("key")
    )
    multiple = table(spark, d, "part").select(
        F.concat(F.lit("ZD"), pad(F.col("p_partkey") % 307)).alias("a"), F.concat(F.lit("ZD"), pad(F.col("p_size"))).alias("b"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(0).alias("exempt"),
        F.when(F.col("p_partkey") % 5 == 0, 90).otherwise(0).alias("reduce"),
    )
    return containment.gated_sums(cov, structure, multiple, "code", "key", ["a", "b"], {"exempt": "exempt_flag", "reduce": "reduce_flag"})


@query("j17", """
WITH lay AS (SELECT s_suppkey AS pos, 'Z' || CAST(s_nationkey AS VARCHAR) || '_' || CAST(s_suppkey % 4 AS VARCHAR) AS k,
                    CASE WHEN s_acctbal < 3000 THEN 'X' ELSE 'O' END AS red, CASE WHEN s_suppkey % 2 = 0 THEN '(X)' ELSE '' END AS exm FROM supplier),
f AS (SELECT k, arg_min(red, pos) AS red, arg_min(exm, pos) AS exm FROM lay GROUP BY 1)
SELECT c_custkey, code, kind, CASE WHEN red IS NOT NULL THEN CASE WHEN contains(red, 'X') THEN '감액없음' ELSE '감액있음' END END AS reduction_kind,
       CASE WHEN exm IS NOT NULL THEN CASE WHEN contains(exm, 'X') THEN '면책없음' ELSE '면책있음' END END AS exemption_kind
FROM (SELECT c_custkey, 'Z' || CAST(c_nationkey AS VARCHAR) AS code, CAST(c_custkey % 5 AS VARCHAR) AS kind FROM customer) LEFT JOIN f ON k = code || '_' || kind
""")
def j17(spark, d):
    """Rider layout lookup with X marks."""
    k = F.col("s_suppkey")
    layout = table(spark, d, "supplier").select(
        k.alias("pos"), F.concat(F.lit("Z"), F.col("s_nationkey").cast("string"), F.lit("_"), (k % 4).cast("string")).alias("key"),
        F.when(F.col("s_acctbal") < 3000, "X").otherwise("O").alias("red"), F.when(k % 2 == 0, "(X)").otherwise("").alias("exm"),
    )
    rows = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("Z"), F.col("c_nationkey").cast("string")).alias("code"), (F.col("c_custkey") % 5).cast("string").alias("kind")
    )
    return lookups.layout_flags(rows, layout, "code", "kind", "key", "red", "exm", "pos")


@query("j19", """
WITH sec AS (SELECT p_partkey AS pos, p_type || ' ' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN '[자녀]' ELSE '' END AS name, p_name AS body FROM part),
f AS (SELECT name, min(pos) AS pos, arg_min(body, pos) AS body FROM sec GROUP BY 1),
w AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'ECONOMY' WHEN 1 THEN 'STANDARD' ELSE 'PROMO' END || ' ' || CAST(s_suppkey % 60 AS VARCHAR) AS name, s_nationkey % 2 AS zero_age FROM supplier)
SELECT s_suppkey, w.name, zero_age, CASE WHEN c.pos < p.pos THEN c.body ELSE coalesce(p.body, c.body) END AS body, p.pos IS NOT NULL OR c.pos IS NOT NULL AS found
FROM w LEFT JOIN f p ON p.name = w.name LEFT JOIN f c ON zero_age > 0 AND c.name = w.name || '[자녀]'
""")
def j19(spark, d):
    """Appendix by name, or name with the child suffix."""
    part = table(spark, d, "part")
    label = F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))
    sections = part.select(
        F.col("p_partkey").alias("pos"), F.concat(label, F.when(F.col("p_partkey") % 3 == 0, "[자녀]").otherwise("")).alias("section"), F.col("p_name").alias("body")
    )
    k = F.col("s_suppkey")
    word = F.when(k % 3 == 0, "ECONOMY").when(k % 3 == 1, "STANDARD").otherwise("PROMO")
    wanted = table(spark, d, "supplier").select(
        k, F.concat_ws(" ", word, (k % 60).cast("string")).alias("name"), (F.col("s_nationkey") % 2).alias("zero_age")
    )
    return lookups.appendix_lookup(wanted, sections, "name", "zero_age", "section", "body", "pos")


@query("p11", _J9_SQL.replace("i.bn AS benefit_name, i.tn AS template_name, coalesce(ex.code, near.code, '') AS inferred_code,\n       ex.code IS NOT NULL OR near.code IS NOT NULL AS matched",
  "CASE WHEN coalesce(ex.code, near.code) IS NULL THEN '[진단코드 (Diagnosis Code)] [미매칭: API 응답에서 해당 담보를 찾지 못함]' "
  "WHEN right(coalesce(ex.code, near.code), 1) = '5' THEN '' ELSE '[진단코드 (Diagnosis Code)] see ' || coalesce(ex.code, near.code) END AS reason"))
def p11(spark, d):
    """Reason text of each match."""
    from .. import names

    answers = match_answers(spark, d).withColumn(
        "ref_sentence", F.when(F.endswith("inferred_code", F.lit("5")), "").otherwise(F.concat(F.lit("see "), "inferred_code"))
    )
    out = containment.match_responses(match_items(spark, d), answers, "benefit_name", "template_name", ["ref_sentence"], "pos")
    title = F.lit(names.ATTRIBUTES[0][1])
    return out.select("p_partkey", containment.reason(title, F.col("ref_sentence"), F.col("matched"), names.UNMATCHED).alias("reason"))


@query("a13", _J9_SQL.replace("SELECT p_partkey, i.bn AS benefit_name, i.tn AS template_name, coalesce(ex.code, near.code, '') AS inferred_code,\n       ex.code IS NOT NULL OR near.code IS NOT NULL AS matched",
  "SELECT 'Inferred_Diagnosis_Code' AS attribute, count(*) FILTER (coalesce(ex.code, near.code) IS NOT NULL) AS matched, count(*) AS total"))
def a13(spark, d):
    """Matched and total rows per attribute."""
    by = F.lit("Inferred_Diagnosis_Code").alias("attribute")
    out = containment.match_responses(
        match_items(spark, d).select("*", by), match_answers(spark, d).select("*", by),
        "benefit_name", "template_name", ["inferred_code"], "pos", by=["attribute"],
    )
    return out.groupBy("attribute").agg(F.count_if("matched").alias("matched"), F.count("*").alias("total"))
