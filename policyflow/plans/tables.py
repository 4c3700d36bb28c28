"""Scalar functions, sources and projections on customers, parts, orders, pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..functions import codes, numbers, text as tx
from ..operators import project, responses
from ..session import scratch
from ..sources import sinks, tables as src
from .registry import query, table

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"

# --- scalar functions


@query("f3", "SELECT c_custkey, upper(substr(md5(c_name), 1, 8)) AS code FROM customer")
def f3(spark, d):
    """Short code from a name."""
    return table(spark, d, "customer").select("c_custkey", tx.short_code(F.col("c_name")).alias("code"))


@query("f4", "SELECT o_orderkey, strftime(o_orderdate, 'v%y%m') AS version FROM orders")
def f4(spark, d):
    """Version label."""
    return table(spark, d, "orders").select("o_orderkey", tx.version_label(F.col("o_orderdate")).alias("version"))


WORDS = ["건강", "암", "질병", "자동차", "차량", "화재", "재물", "생명", "사망", "상해", "재해", "PET", "상해질병", "펫", "태아", "비용배상책임", "부양자"]
WORD_SQL = "[%s][CAST({0} AS INT) + 1]" % ", ".join(f"'{w}'" for w in WORDS)


def titled_parts(spark, d) -> DataFrame:
    """Part names with two keywords each."""
    k, n = F.col("p_partkey"), len(WORDS)
    words = F.array(*[F.lit(w) for w in WORDS])
    pick = lambda c: F.element_at(words, (c % n + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat_ws(" ", pick(k), "p_name", pick(k * 7 + F.col("p_size"))).alias("title"))


TITLED_SQL = f"SELECT p_partkey, {WORD_SQL.format(f'p_partkey % {len(WORDS)}')} || ' ' || p_name || ' ' || {WORD_SQL.format(f'(p_partkey * 7 + p_size) % {len(WORDS)}')} AS title FROM part"


@query("f5", f"SELECT p_partkey, CASE {' '.join(f'''WHEN contains(lower(title), '{w}') THEN '{v}' ''' for w, v in names.TYPE_KEYWORDS)} ELSE '미분류' END AS product_type FROM ({TITLED_SQL})")
def f5(spark, d):
    """Keyword to product type."""
    return titled_parts(spark, d).select("p_partkey", tx.product_type(F.col("title")).alias("product_type"))


@query("f6", f"SELECT p_partkey, CASE {' '.join(f'''WHEN contains(lower(title), '{w}') THEN '{w}' ''' for w in names.BASE_CATEGORIES)} ELSE '기타' END AS category FROM ({TITLED_SQL})")
def f6(spark, d):
    """Keyword to base category."""
    return titled_parts(spark, d).select("p_partkey", tx.base_category(F.col("title")).alias("category"))


@query("f7", """
SELECT o_orderkey, CASE label WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS score,
  CASE WHEN ratio >= 0.85 THEN 'high' WHEN ratio >= 0.6 THEN 'medium' ELSE 'low' END AS level, coalesce(TRY_CAST(replace(percent, '%', '') AS DOUBLE), 0.0) AS percent_value
FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' ELSE 'none' END AS label,
  (o_orderkey % 101) / 100.0::DOUBLE AS ratio, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(o_orderkey % 101 AS VARCHAR) || '%' END AS percent FROM orders)""")
def f7(spark, d):
    """Confidence conversions."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    label = F.when(p == "1-URGENT", "high").when(p == "2-HIGH", "medium").when(p == "3-MEDIUM", "low").otherwise("none")
    percent = F.when(k % 9 == 0, "bad").otherwise(F.concat((k % 101).cast("string"), F.lit("%")))
    return table(spark, d, "orders").select(
        k, numbers.label_score(label).alias("score"), numbers.score_label((k % 101) / F.lit(100.0)).alias("level"),
        numbers.percent_value(percent).alias("percent_value"),
    )


@query("f8", """SELECT p_partkey, lower(replace(a, ' ', '')) = lower(replace(b, ' ', '')) AS same FROM
  (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' ELSE upper(p_name) END AS a, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE replace(p_name, ' ', '  ') END AS b FROM part)""")
def f8(spark, d):
    """Code equality without case and blanks."""
    n = F.col("p_size")
    a = F.when(n % 5 == 0, "").otherwise(F.upper("p_name"))
    b = F.when(n % 3 == 0, F.col("p_name")).when(n % 3 == 1, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("  ")))
    return table(spark, d, "part").select("p_partkey", codes.same_code(a, b).alias("same"))


@query("f9", """SELECT p_partkey, days, CASE WHEN days = 0 THEN '' WHEN days < 30 THEN days || '일' WHEN days < 365 THEN CASE WHEN days % 30 = 0 THEN (days // 30) || '개월' ELSE days || '일' END
  WHEN days % 365 = 0 THEN (days // 365) || '년' ELSE days || '일' END AS period
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 30 WHEN 2 THEN p_size * 365 ELSE (p_size % 3) * 73 END AS days FROM part)""")
def f9(spark, d):
    """Period text."""
    k, n = F.col("p_partkey"), F.col("p_size")
    days = F.when(k % 4 == 0, n).when(k % 4 == 1, n * 30).when(k % 4 == 2, n * 365).otherwise((n % 3) * 73)
    return table(spark, d, "part").select("p_partkey", days.alias("days"), numbers.period_text(days).alias("period"))


@query("f10", """SELECT p_partkey, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%.1f', v) END || pct AS rate
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size * 2.0::DOUBLE WHEN 1 THEN p_size / 3.0::DOUBLE ELSE p_size::DOUBLE END AS v, CASE WHEN p_partkey % 2 = 0 THEN '%' ELSE '' END AS pct FROM part)""")
def f10(spark, d):
    """Rate text with arithmetic."""
    k = F.col("p_partkey")
    op = F.when(k % 3 == 0, "*").when(k % 3 == 1, "/").otherwise("")
    operand = F.when(k % 3 == 0, "2").when(k % 3 == 1, "3").otherwise("")
    percent = F.when(k % 2 == 0, "%").otherwise("")
    return table(spark, d, "part").select("p_partkey", numbers.rate_text(F.col("p_size").cast("double"), op, operand, percent).alias("rate"))


@query("f11", """SELECT page_id, CASE WHEN strpos(html, '<title>') = 0 THEN '' WHEN strpos(r, '</title>') > 0 THEN substr(r, 1, strpos(r, '</title>') - 1) ELSE r END AS title,
  CASE WHEN strpos(html, '<table>') = 0 THEN '' WHEN strpos(q, '<nothing>') > 0 THEN substr(q, 1, strpos(q, '<nothing>') - 1) ELSE q END AS tail
FROM (SELECT *, substr(html, strpos(html, '<title>') + 7) AS r, substr(html, strpos(html, '<table>') + 7) AS q FROM pages)""")
def f11(spark, d):
    """Text between markers; rest without end, '' without start."""
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", tx.between_markers(html, "<title>", "</title>").alias("title"), tx.between_markers(html, "<table>", "<nothing>").alias("tail")
    )


@query("f12", f"SELECT doc_id, {STRIP.format('translate(text, chr(14) || chr(13) || chr(10) || chr(160) || chr(9) || chr(12), chr(0))').replace('chr(0)', repr(''))} AS cleaned FROM documents")
def f12(spark, d):
    """Clean text."""
    return table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query("f13", "SELECT s_suppkey, array_to_string(list_transform(string_split(s_name || ' , ' || CAST(s_nationkey AS VARCHAR) || ',x ', ','), lambda x: trim(x)), '|') AS codes FROM supplier")
def f13(spark, d):
    """Comma code list."""
    text = F.concat("s_name", F.lit(" , "), F.col("s_nationkey").cast("string"), F.lit(",x "))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(tx.code_list(text), "|").alias("codes"))


@query("f14", """SELECT page_id, name, regexp_replace(name, '^(\\.*[^.].*)\\.[^.]*$', '\\1') AS stem, folder, lower(regexp_extract(name, '^\\.*[^.].*(\\.[^.]*)$', 1)) AS extension
FROM (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, CASE WHEN regexp_extract(url, '([^/]*)/[^/]*$', 1) = '' THEN 'default_group' ELSE regexp_extract(url, '([^/]*)/[^/]*$', 1) END AS folder FROM pages)""")
def f14(spark, d):
    """Name, stem, folder and extension of a path."""
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", tx.file_name(u).alias("name"), tx.stem(u).alias("stem"), tx.folder_name(u).alias("folder"), tx.extension(u).alias("extension")
    )


@query("f15", "SELECT page_id, replace(replace(url, '/', '_'), chr(92), '_') AS safe FROM pages")
def f15(spark, d):
    """Safe name."""
    return table(spark, d, "pages").select("page_id", tx.safe_name(F.col("url")).alias("safe"))


@query("f16", "SELECT p_partkey, regexp_extract(title, '약관_([^_]+)_', 1) AS rider FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name ELSE '특별약관_' || p_name || '_' || p_brand END AS title FROM part)")
def f16(spark, d):
    """Rider name from a file name."""
    name = F.when(F.col("p_size") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("특별약관_"), "p_name", F.lit("_"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", tx.rider_name(name).alias("rider"))


@query("f17", "SELECT p_partkey, CASE WHEN contains(name, '_') THEN coalesce(TRY_CAST(split_part(name, '_', 1) AS INT), -1) ELSE -1 END AS group_no FROM (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name ELSE CASE p_size % 5 WHEN 0 THEN 'a' ELSE CAST(p_size AS VARCHAR) END || '_' || p_name END AS name FROM part)")
def f17(spark, d):
    """Leading integer group key."""
    n = F.col("p_size")
    name = F.when(n % 3 == 0, F.col("p_name")).otherwise(F.concat(F.when(n % 5 == 0, "a").otherwise(n.cast("string")), F.lit("_"), "p_name"))
    return table(spark, d, "part").select("p_partkey", tx.group_number(name).alias("group_no"))


@query("f18", "SELECT doc_id, sha256(text) AS sha FROM documents")
def f18(spark, d):
    """SHA-256 of content."""
    return table(spark, d, "documents").select("doc_id", tx.checksum(F.col("text").cast("binary")).alias("sha"))


@query("f19", "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...(cut)' ELSE text END AS short_text, substr(sha256(text), 1, 16) AS head FROM documents")
def f19(spark, d):
    """Truncation with marker."""
    return table(spark, d, "documents").select(
        "doc_id", tx.cut(F.col("text"), 2000, "...(cut)").alias("short_text"), tx.cut(F.sha2("text", 256), 16).alias("head")
    )


@query("f20", "SELECT p_partkey, trim(' ' || p_name || ' ') AS stripped, upper(p_name) AS up, lower(p_type) AS low, contains(lower(p_name), 'ring') AS has_ring, replace(p_name, ' ', '_') AS joined FROM part")
def f20(spark, d):
    """Strip, upper, lower, contains, replace."""
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", tx.strip(F.concat(F.lit(" "), name, F.lit(" "))).alias("stripped"), F.upper(name).alias("up"), F.lower("p_type").alias("low"),
        F.contains(F.lower(name), F.lit("ring")).alias("has_ring"), F.replace(name, F.lit(" "), F.lit("_")).alias("joined"),
    )


@query("f21", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_size % 3 = 0 THEN p_type END, ''), '') AS value FROM part")
def f21(spark, d):
    """First non-empty of alternatives."""
    n = F.col("p_size")
    return table(spark, d, "part").select(
        "p_partkey", tx.first_filled(F.when(n % 2 == 0, "").otherwise(F.col("p_name")), F.when(n % 3 == 0, F.col("p_type"))).alias("value")
    )


@query("f22", "SELECT p_partkey, coalesce(TRY_CAST(t AS INT), 0) AS whole, coalesce(TRY_CAST(t AS DOUBLE), 0.0) AS number FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN p_name ELSE CAST(p_size AS VARCHAR) END AS t FROM part)")
def f22(spark, d):
    """Lenient numbers."""
    n = F.col("p_size")
    text = F.when(n % 4 == 0, "").when(n % 4 == 1, F.col("p_name")).otherwise(n.cast("string"))
    return table(spark, d, "part").select("p_partkey", numbers.lenient_int(text).alias("whole"), numbers.lenient_double(text).alias("number"))


@query("f23", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%H:%M:%S') AS clock FROM events")
def f23(spark, d):
    """Timestamps in names."""
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", tx.file_stamp(ts).alias("file_stamp"), tx.iso_stamp(ts).alias("iso"), tx.clock(ts).alias("clock"))


@query("f24", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_linenumber - 1) / 8.0::DOUBLE, 2) AS progress FROM lineitem")
def f24(spark, d):
    """Progress ratio."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numbers.progress(F.col("l_linenumber"), 8).alias("progress"))


@query("f25", "SELECT p_partkey, coalesce(CASE WHEN n = 0 THEN a[-1] ELSE a[n] END, 'NA') AS picked FROM (SELECT p_partkey, p_size % 5 AS n, string_split(p_name, ' ') AS a FROM part)")
def f25(spark, d):
    """n-th entry of an array, the last for 0, NA when out of range."""
    picked = numbers.pick(F.split("p_name", " "), F.col("p_size") % 5)
    return table(spark, d, "part").select("p_partkey", F.coalesce(picked, F.lit("NA")).alias("picked"))


@query("f26", "SELECT p_partkey, coalesce(CASE WHEN p_type = 'ECONOMY' THEN p_size * 1.0::DOUBLE WHEN p_type = 'PROMO' THEN 100.0::DOUBLE END, -1.0) AS rate FROM part")
def f26(spark, d):
    """Map lookup by code."""
    rates = F.create_map(F.lit("ECONOMY"), F.col("p_size").cast("double"), F.lit("PROMO"), F.lit(100.0))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(rates, F.col("p_type")), F.lit(-1.0)).alias("rate"))


@query("f27", "SELECT p_partkey, CAST(to_json({'inserted': p_size, 'type': p_type}) AS VARCHAR) AS details FROM part")
def f27(spark, d):
    """JSON text of a record."""
    return table(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("inserted"), F.col("p_type").alias("type"))).alias("details"))


@query("f28", """SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN '-' WHEN p_size * 2 >= 95 THEN 'high' WHEN p_size * 2 >= 70 THEN 'medium' ELSE 'low' END AS level,
  CASE p_size % 4 WHEN 0 THEN '별표' WHEN 1 THEN '매핑테이블' WHEN 2 THEN p_type ELSE '-' END AS source FROM part""")
def f28(spark, d):
    """Confidence level on the percent scale and source label."""
    n = F.col("p_size")
    key = F.when(n % 4 == 0, "appendix").when(n % 4 == 1, "mapping_table").when(n % 4 == 2, F.col("p_type")).otherwise("")
    share = F.when(n % 11 != 0, n / F.lit(50.0))
    return table(spark, d, "part").select(
        "p_partkey", numbers.percent_level(F.round(share * 100, 6)).alias("level"), tx.lookup_label(key, names.SOURCE_LABELS).alias("source")
    )


# --- sources: files are written to a fresh folder below the shared one and read back


@query("s1", "SELECT CAST(c_custkey AS VARCHAR) AS 고객번호, '고객 ' || c_name AS 고객명, c_mktsegment AS 구분 FROM customer")
def s1(spark, d):
    """Delimited scan that finds encoding and separator (Korean charset, tab)."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch(spark, "mapping")
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("고객번호"), F.concat(F.lit("고객 "), "c_name").alias("고객명"), F.col("c_mktsegment").alias("구분")
    )
    rows.write.option("header", True).option("sep", "\t").option("encoding", "MS949").csv(path)
    return src.read_csv_guessing(spark, path)


@query("s1_late", "SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN c_custkey % 97 = 50 THEN '담보코드 ' || c_custkey ELSE c_mktsegment END AS name FROM customer")
def s1_late(spark, d):
    """Delimited scan of files whose Korean text stands in late rows only: all of a file decides on its encoding."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch(spark, "mapping")
    key = F.col("c_custkey")
    name = F.when(key % 97 == 50, F.concat(F.lit("담보코드 "), key.cast("string"))).otherwise(F.col("c_mktsegment"))
    rows = table(spark, d, "customer").select(key.cast("string").alias("code"), name.alias("name"))
    rows.write.option("header", True).option("sep", "\t").option("encoding", "MS949").csv(path)
    return src.read_csv_guessing(spark, path)


_ODD_CELL = lambda name: F.concat(F.lit(" "), F.col(name), F.lit(' say "hi", ok\n, '))
_ODD_CELL_SQL = """' ' || {} || ' say "hi", ok' || chr(10) || ', '"""


@query("s2_quoted", f"SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, {_ODD_CELL_SQL.format('p_name')} AS p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS p_brand FROM part")
def s2_quoted(spark, d):
    """CSV with byte order mark whose cells hold quotes, commas, outer blanks and line breaks."""
    path = scratch(spark, "handoff")
    brand = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand"))
    sinks.write_csv(table(spark, d, "part").select("p_partkey", _ODD_CELL("p_name").alias("p_name"), brand.alias("p_brand")), path)
    return src.read_csv(spark, path)


@query("s2", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part")
def s2(spark, d):
    """CSV with byte order mark, all strings."""
    path = scratch(spark, "handoff")
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("\ufeffp_partkey"), "p_name", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("p_brand"), "p_size"
    )
    part.write.option("header", True).csv(path)
    return src.read_csv(spark, path)


def model_sheet(spark, d) -> DataFrame:
    """Header-less grid: a title row 0, a header row 1 with a repeated name, then one row per part."""
    part = table(spark, d, "part")
    body = part.select(
        (F.col("p_partkey") + 2).alias("row_no"), F.col("p_brand").alias("c0"), F.col("p_name").alias("c1"),
        F.col("p_size").cast("string").alias("c2"), (F.col("p_size") * 30).cast("string").alias("c3"),
    )
    top = spark.createDataFrame(
        [(0, "상품", None, None, None), (1, " 담보\n코드 ", "담보명", "감액기간", "감액기간")], "row_no long, c0 string, c1 string, c2 string, c3 string"
    )
    return top.unionByName(body)


@query("s3", "SELECT p_partkey + 2 AS row_no, p_brand AS c0, p_name AS c1, CAST(p_size AS VARCHAR) AS c2, CAST(p_size * 30 AS VARCHAR) AS c3 FROM part UNION ALL SELECT 0, '상품', NULL, NULL, NULL UNION ALL SELECT 1, '담보 코드', '담보명', '감액기간', '감액기간'")
def s3(spark, d):
    """Header-less sheet scan, the sheet picked by product code."""
    sheets = {"Main_P1": scratch(spark, "main-p1"), "Main_P2": scratch(spark, "main-p2")}
    chosen = sheets[src.sheet_name(list(sheets), "P2")]
    grid = model_sheet(spark, d)
    grid = grid.withColumn("c0", F.trim(F.replace("c0", F.lit("\n"), F.lit(" "))))
    grid.write.csv(chosen)
    return src.read_grid(spark, chosen, 4)


@query("s4", 'SELECT p_partkey + 2 AS row_no, p_brand AS "담보코드", p_name AS "담보명", CAST(p_size AS VARCHAR) AS "감액기간", CAST(p_size * 30 AS VARCHAR) AS "감액기간2" FROM part')
def s4(spark, d):
    """Header promotion with repeated names."""
    return src.promote_header(model_sheet(spark, d), 1, repeated=["탈퇴율개수", "감액기간", "감액비율"])


@query("s5", "SELECT p_name AS risk, p_brand AS risk_id, p_type AS from_code, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END, ''), p_brand) AS phrase FROM part")
def s5(spark, d):
    """Columns found under flexible names; values under alias names."""
    part = table(spark, d, "part").select(
        F.col("p_name").alias("신규 위험률명"), F.col("p_brand").alias("상품 ID"), F.col("p_type").alias("KCD시작"),
        F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("약관문구"), F.col("p_brand").alias("적용문구"),
    )
    risk, ident = project.find_risk_column(part.columns), project.find_id_column(part.columns)
    low = src.resolve(part.columns, ["FROM"], ["FROM", "시작"])
    return part.select(
        F.col(risk).alias("risk"), F.col(ident).alias("risk_id"), F.col(low).alias("from_code"),
        tx.first_filled(F.col("약관문구"), F.col("적용문구")).alias("phrase"),
    )


@query("s6", "SELECT p_name, CASE WHEN p_size % 3 <> 0 THEN p_type END AS p_type FROM (SELECT CASE WHEN p_size % 2 = 0 THEN p_name END AS p_name, p_type, p_size FROM part) WHERE p_name IS NOT NULL OR p_size % 3 <> 0")
def s6(spark, d):
    """All-null rows and columns dropped."""
    n = F.col("p_size")
    sheet = table(spark, d, "part").select(
        F.when(n % 2 == 0, F.col("p_name")).alias("p_name"), F.lit(None).cast("string").alias("memo"),
        F.when(n % 3 != 0, F.col("p_type")).alias("p_type"), F.lit(None).cast("int").alias("unused"),
    )
    return src.drop_empty(sheet)


@query("s7", "SELECT p_brand AS key, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1")
def s7(spark, d):
    """Key/value sheet, later rows win."""
    return src.key_values(table(spark, d, "part"), "p_brand", "p_name", "p_partkey")


@query("s7_rows", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS name, CASE WHEN p_size % 5 = 0 THEN p_size ELSE 0 END AS flag FROM part WHERE p_partkey >= 3 AND (p_size % 2 = 0 OR (p_size % 5 = 0 AND p_size > 0))")
def s7_rows(spark, d):
    """Coverage rows: from row 3, with any value besides the sequence number."""
    n = F.col("p_size")
    sheet = table(spark, d, "part").select(
        "p_partkey", F.col("p_partkey").alias("순번"), F.when(n % 2 == 0, F.col("p_name")).otherwise("").alias("name"), F.when(n % 5 == 0, n).otherwise(0).alias("flag")
    )
    return src.coverage_rows(sheet, "p_partkey", 3, ["순번"]).drop("순번")


@query("s8", """
WITH g AS (SELECT s_suppkey AS r, CASE WHEN s_suppkey % 50 = 7 THEN '상품코드' WHEN s_suppkey % 50 = 20 THEN '출력약관경로' ELSE s_name END AS c0, s_name AS c1 FROM supplier),
l AS (SELECT c0, max(r) AS r FROM g GROUP BY 1)
SELECT w.name, coalesce(g.c1, '') AS value FROM (VALUES ('product_code', '상품코드', 0), ('product_name', '상품코드', 1), ('path_0', '출력약관경로', 0), ('path_5', '출력약관경로', 5)) w(name, label, dr)
JOIN l ON l.c0 = w.label LEFT JOIN g ON g.r = l.r + dr""")
def s8(spark, d):
    """Label cells and the cells beside and below them."""
    k = F.col("s_suppkey")
    label = F.when(k % 50 == 7, "상품코드").when(k % 50 == 20, "출력약관경로").otherwise(F.col("s_name"))
    grid = table(spark, d, "supplier").select(k.alias("row_no"), label.alias("c0"), F.col("s_name").alias("c1"))
    wanted = {
        "product_code": ("상품코드", 0, 1), "product_name": ("상품코드", 1, 1),
        "path_0": ("출력약관경로", 0, 1), "path_5": ("출력약관경로", 5, 1),
    }
    return src.label_values(src.grid_cells(grid), wanted)


@query("s22", "SELECT s_suppkey AS pos, 'R' || CAST(s_nationkey AS VARCHAR) AS rep_code, s_name AS coverage_code, 'name' AS rep_name, 'c' || CAST(s_suppkey AS VARCHAR) AS coverage_name, 'k' AS category, '' AS \"check\" FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 5 <> 0")
def s22(spark, d):
    """Raw tab lines to mapping columns; short lines and the header are skipped."""
    k = F.col("s_suppkey")
    parts = [F.concat(F.lit("R"), F.col("s_nationkey").cast("string")), F.lit("name "), F.concat(F.lit(" "), "s_name"), F.concat(F.lit("c"), k.cast("string"))]
    lines = table(spark, d, "supplier").select(
        k.alias("pos"), F.concat_ws("\t", *parts, F.when(k % 5 != 0, "k ")).alias("line")
    )
    return src.reshape_mapping(lines, "line", "pos")


@query("s16", "SELECT p_partkey AS line_no, CAST(p_partkey AS VARCHAR) || ',' || p_name || ',' || p_brand || ',' || CAST(p_size AS VARCHAR) AS line FROM part UNION ALL SELECT -2, '=== part ===' UNION ALL SELECT -1, 'p_partkey,p_name,p_brand,p_size'")
def s16(spark, d):
    """A table as CSV lines under its name and header."""
    return responses.csv_lines(table(spark, d, "part"), "part", "p_partkey", ["p_partkey", "p_name", "p_brand", "p_size"])


# --- projections

ATTR_SQL = "[%s][CAST(o_orderkey %% 9 AS INT) + 1]" % ", ".join(f"'{k}'" for k in names.ATTRIBUTE_COLUMNS)


def long_results(spark, d) -> DataFrame:
    """One result row per order: attribute and code."""
    keys = F.array(*[F.lit(k) for k in names.ATTRIBUTE_COLUMNS])
    return table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("benefit_code"), F.element_at(keys, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("attribute"),
        F.concat(F.lit("V"), F.col("o_orderstatus")).alias("inferred_code"),
    )


LONG_SQL = f"long AS (SELECT o_orderkey, o_custkey AS benefit_code, {ATTR_SQL} AS attribute, 'V' || o_orderstatus AS inferred_code FROM orders)"


@query("p1", f"WITH {LONG_SQL} SELECT o_orderkey, benefit_code, {', '.join(f'''CASE WHEN attribute = '{k}' THEN inferred_code END AS {c}''' for k, c in names.ATTRIBUTE_COLUMNS.items())} FROM long")
def p1(spark, d):
    """Long result rows to wide attribute columns, one row each."""
    return project.attribute_columns(long_results(spark, d))


@query("p1_benefit", f"WITH {LONG_SQL} SELECT benefit_code, {', '.join(f'''arg_min(inferred_code, o_orderkey) FILTER (attribute = '{k}') AS {c}''' for k, c in names.ATTRIBUTE_COLUMNS.items())} FROM long GROUP BY 1")
def p1_benefit(spark, d):
    """One row per benefit with all nine attributes."""
    return project.benefit_rows(long_results(spark, d), ["benefit_code"], "o_orderkey")


@query("p6", "SELECT n_nationkey, n_name, '' AS confidence, '' AS source, p_partkey FROM nation JOIN part ON n_nationkey = p_size")
def p6(spark, d):
    """Missing columns added as ''."""
    part = table(spark, d, "part").select(F.col("p_size").alias("n_nationkey"), "p_partkey")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").join(part, "n_nationkey")
    return project.ensure_columns(rows, ["n_name", "confidence", "source"])


@query("p7", "SELECT p_brand AS \"상품 ID\", p_name AS 위험률명, p_type AS 항목구분명, CAST(p_size AS VARCHAR) AS 항목값명, 'why' AS 선정근거 FROM part")
def p7(spark, d):
    """Final column order: id, risk, items, reason; only those present."""
    part = table(spark, d, "part").select(
        F.col("p_size").cast("string").alias("항목값명"), F.lit("why").alias("선정근거"), F.col("p_name").alias("위험률명"),
        F.col("p_brand").alias("상품 ID"), F.col("p_type").alias("항목구분명"), F.col("p_retailprice").alias("기타"),
    )
    items = ["항목구분코드", "항목구분명", "항목값코드", "항목값명"]
    order = project.risk_columns(part.columns, project.find_risk_column(part.columns), items)
    return project.ordered_columns(part, order)


@query("p8", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size END AS exempt, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_type || '모듈' END AS module FROM part")
def p8(spark, d):
    """Default and flag projection."""
    n = F.col("p_size")
    rows = table(spark, d, "part").select(
        "p_partkey", F.when(n % 3 == 0, "").otherwise(n.cast("string")).alias("exempt"), F.when(n % 4 != 0, F.col("p_type")).alias("module")
    )
    return project.coverage_attributes(rows, ["exempt"], "module")


@query("p12", "SELECT page_id, split_part(replace(url, '://', ':///'), '///', 1) || '///***' AS masked FROM pages")
def p12(spark, d):
    """Setting mask."""
    return table(spark, d, "pages").select("page_id", tx.mask_url(F.replace("url", F.lit("://"), F.lit(":///"))).alias("masked"))


@query("p13", "SELECT p_partkey + 2 AS row_no, p_name AS c1, CAST(p_size AS VARCHAR) AS c2 FROM part WHERE p_partkey + 2 BETWEEN 15 AND 1010")
def p13(spark, d):
    """Row window and column slice of a grid, from a reference cell."""
    return project.row_window(model_sheet(spark, d), "row_no", 10, 5, 1000, ["c0", "c1", "c2", "c3"], 1, 2)


@query("p14", "SELECT p_partkey, p_name FROM part WHERE trim(p_brand) = 'Brand#7'")
def p14(spark, d):
    """All rows whose trimmed column equals a value."""
    return project.rows_matching(table(spark, d, "part"), "p_brand", "Brand#7").select("p_partkey", "p_name")


@query("p14_first", "SELECT coalesce(min(p_partkey) FILTER (p_brand = 'Brand#7'), -1) AS row_no, coalesce(min(p_partkey) FILTER (p_brand = 'none'), -999) AS missing FROM part")
def p14_first(spark, d):
    """Row number of the first hit, or the miss value."""
    part = table(spark, d, "part")
    hit = project.first_match(part, "p_brand", "Brand#7", "p_partkey")
    return hit.withColumn("missing", project.first_match(part, "p_brand", "none", "p_partkey", -999).scalar())


_P9_NAMES = "CASE p_partkey % 5 WHEN 0 THEN '1_진단분류코드_' WHEN 1 THEN 'x_edi_' WHEN 2 THEN '병원등급표 ' WHEN 3 THEN 'period ' ELSE 'misc ' END || p_name || '.xlsx'"


@query("p9", f"""
WITH t AS (SELECT p_partkey, {_P9_NAMES} AS name, p_type AS content FROM part),
cfg AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{n}', [{', '.join(repr(x) for x in p)}]::VARCHAR[])" for k, n, p in names.ATTRIBUTES)}) v(attribute, attribute_name, patterns)),
hit AS (SELECT attribute, p_partkey, content FROM cfg JOIN t ON len(list_filter(patterns, lambda p: contains(lower(name), lower(p)))) > 0)
SELECT attribute, p_partkey AS pos, content FROM hit
UNION ALL SELECT attribute, -1, CASE WHEN len(patterns) = 0 THEN '해당 속성에 대한 매핑 테이블이 없습니다.' ELSE '[주의] ''' || attribute_name || ''' 관련 매핑 파일을 찾지 못했습니다.' END
FROM cfg WHERE attribute NOT IN (SELECT attribute FROM hit)""")
def p9(spark, d):
    """Mapping tables that serve each attribute, or the fixed text when there is none."""
    k = F.col("p_partkey")
    head = F.when(k % 5 == 0, "1_진단분류코드_").when(k % 5 == 1, "x_edi_").when(k % 5 == 2, "병원등급표 ").when(k % 5 == 3, "period ").otherwise("misc ")
    tables_ = table(spark, d, "part").select(k.alias("pos"), F.concat(head, "p_name", F.lit(".xlsx")).alias("name"), F.col("p_type").alias("content"))
    return responses.mapping_context(responses.attributes(spark), tables_, "name", "content", "pos")


@query("u3", """SELECT p_partkey AS file, '누락 컬럼: ' || concat_ws(', ', CASE WHEN p_size % 2 = 0 THEN 'benefit_name' END, CASE WHEN p_size % 3 = 0 THEN 'template_name' END, 'confidence') AS message
FROM part WHERE p_size % 5 <> 0""")
def u3(spark, d):
    """Required columns that are missing, per file; a file that lacks none gives no row."""
    from ..operators import quality

    n = F.col("p_size")
    has = F.array_compact(F.array(
        F.lit("product_code"), F.when((n % 2 != 0) | (n % 5 == 0), "benefit_name"), F.when((n % 3 != 0) | (n % 5 == 0), "template_name"),
        F.lit("diagnosis_code"), F.lit("verification_status"), F.when(n % 5 == 0, "confidence"),
    ))
    return quality.header_errors(table(spark, d, "part").select(F.col("p_partkey").alias("file"), has.alias("header")), "file")
