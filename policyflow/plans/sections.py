"""Policy text made from the documents by giving lines the headers of the format; pages from lines and web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..operators import sections
from ..session import scratch
from .registry import query, table

# line i (from 0) -> the same line with a header in front
STYLE_SQL = """CASE (i - 1) % 11 WHEN 0 THEN '제' || CAST((i - 1) // 11 + 1 AS VARCHAR) || '조(' || l || ') tail' WHEN 1 THEN '① ' || l WHEN 2 THEN '1. ' || l
  WHEN 3 THEN ' ② ' || l || ' ' WHEN 4 THEN '2. ' || l WHEN 5 THEN '3.' || l WHEN 6 THEN '별표[질병관련' || CAST(i - 1 AS VARCHAR) || '] ' || l
  WHEN 7 THEN '<!-- Page ' || CAST(i - 1 AS VARCHAR) || ' -->' || l WHEN 8 THEN '무배당 암' || CAST(i - 1 AS VARCHAR) || '특약 약관 ' || l ELSE l END"""
POLICY_SQL = f"policy AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: {STYLE_SQL}), chr(10)) AS text FROM documents)"


def policies(spark, d) -> DataFrame:
    def style(line, i):
        n = i.cast("string")
        heads = [
            F.concat(F.lit("제"), F.floor(i / 11 + 1).cast("string"), F.lit("조("), line, F.lit(") tail")), F.concat(F.lit("① "), line),
            F.concat(F.lit("1. "), line), F.concat(F.lit(" ② "), line, F.lit(" ")), F.concat(F.lit("2. "), line), F.concat(F.lit("3."), line),
            F.concat(F.lit("별표[질병관련"), n, F.lit("] "), line), F.concat(F.lit("<!-- Page "), n, F.lit(" -->"), line),
            F.concat(F.lit("무배당 암"), n, F.lit("특약 약관 "), line),
        ]
        chain = F
        for k, head in enumerate(heads):
            chain = chain.when(i % 11 == k, head)
        return chain.otherwise(line)

    return table(spark, d, "documents", spread=True).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), style), "\n").alias("text"))


X1_SQL = f"""
WITH {POLICY_SQL},
raw AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS l0 FROM policy),
ln AS (SELECT doc_id, i, regexp_replace(l0, '^\\s+|\\s+$', '', 'g') AS l FROM raw),
k AS (SELECT *, regexp_matches(l, '^(제\\d+조(?:의\\d+)?)\\s*[\\(（](.+?)[\\)）]') AS is_art FROM ln WHERE l <> ''),
a AS (SELECT *, sum(is_art::INT) OVER (PARTITION BY doc_id ORDER BY i) AS art, NOT is_art AND regexp_matches(l, '^[①②③④⑤⑥⑦⑧⑨⑩]\\s*.+') AS is_par FROM k),
b AS (SELECT *, sum(is_par::INT) OVER (PARTITION BY doc_id, art ORDER BY i) AS par FROM a WHERE art > 0),
c AS (SELECT *, NOT is_art AND NOT is_par AND par > 0 AND regexp_matches(l, '^\\s*\\d+\\.\\s+.+') AS is_item FROM b),
pars AS (SELECT doc_id, art, par, max(CASE WHEN is_par THEN l END) AS head,
   coalesce(string_agg(regexp_extract(l, '^\\s*(\\d+)\\.\\s+(.+)', 1) || ':' || regexp_extract(l, '^\\s*(\\d+)\\.\\s+(.+)', 2), ';' ORDER BY i) FILTER (is_item), '') AS items
   FROM c WHERE par > 0 GROUP BY 1, 2, 3),
pj AS (SELECT doc_id, art, string_agg(regexp_extract(head, '^([①②③④⑤⑥⑦⑧⑨⑩])\\s*(.+)', 1) || '|' || regexp_extract(head, '^([①②③④⑤⑥⑦⑧⑨⑩])\\s*(.+)', 2) || '|' || items, chr(10) ORDER BY par) AS paragraphs FROM pars GROUP BY 1, 2),
arts AS (SELECT doc_id, art, max(CASE WHEN is_art THEN l END) AS head, coalesce(string_agg(l || chr(10), '' ORDER BY i) FILTER (NOT is_art AND NOT is_par AND NOT is_item), '') AS content FROM c GROUP BY 1, 2)
"""


def rendered_articles(docs: DataFrame) -> DataFrame:
    one = lambda p: F.concat(
        p["marker"], F.lit("|"), p["text"], F.lit("|"),
        F.array_join(F.transform(p["items"], lambda t: F.concat(t["number"], F.lit(":"), t["text"])), ";"),
    )
    rows = sections.article_rows(docs)
    return rows.withColumn("paragraphs", F.array_join(F.transform("paragraphs", one), "\n"))


@query("x1", X1_SQL + """SELECT doc_id, CAST(art AS INT) AS article_no, regexp_extract(head, '^(제\\d+조(?:의\\d+)?)\\s*[\\(（](.+?)[\\)）]', 1) AS number,
  regexp_extract(head, '^(제\\d+조(?:의\\d+)?)\\s*[\\(（](.+?)[\\)）]', 2) AS title, content, coalesce(paragraphs, '') AS paragraphs FROM arts LEFT JOIN pj USING (doc_id, art)""")
def x1(spark, d):
    """Articles, paragraphs and items."""
    return rendered_articles(policies(spark, d))


@query("w6_lines", X1_SQL + "SELECT doc_id, CAST(art AS INT) AS article_no, count(*) FILTER (is_par) AS paragraphs, count(*) FILTER (is_item) AS items FROM c GROUP BY 1, 2")
def w6_lines(spark, d):
    """Lines counted under the article and paragraph they belong to."""
    rows = sections.article_rows(policies(spark, d))
    items = F.aggregate("paragraphs", F.lit(0), lambda acc, p: acc + F.size(p["items"]))
    return rows.select("doc_id", "article_no", F.size("paragraphs").cast("long").alias("paragraphs"), items.cast("long").alias("items"))


APPENDIX_RE = "(별표\\s*[\\[【\\(]?\\s*(?:질병관련|수술관련|상해관련|보장관련)?\\s*\\d*\\s*[\\]】\\)]?)"
PARTS_SQL = "string_split(regexp_replace(text, '{0}', chr(1) || '\\1' || chr(1), 'g'), chr(1))"
X2_SQL = f"""ap AS (SELECT doc_id, list_transform(range(1, len(p) // 2 + 1), lambda k: {{'pos': k, 'name': regexp_replace(p[2 * k], '^\\s+|\\s+$', '', 'g'),
    'start_page': coalesce(TRY_CAST(regexp_extract(p[2 * k + 1], '<!-- Page (\\d+) -->', 1) AS INT), 0), 'content': substr(regexp_replace(p[2 * k + 1], '^\\s+|\\s+$', '', 'g'), 1, 50000)}}) AS a
  FROM (SELECT doc_id, {PARTS_SQL.format(APPENDIX_RE)} AS p FROM policy))"""


@query("x2", f"WITH {POLICY_SQL}, {X2_SQL}, u AS (SELECT doc_id, unnest(a) AS e FROM ap) SELECT doc_id, CAST(e.pos AS INT) AS pos, e.name AS name, e.start_page AS start_page, e.content AS content FROM u")
def x2(spark, d):
    """Appendices with their start page, cut at the format's limit."""
    return sections.appendix_rows(policies(spark, d), limit=names.APPENDIX_CHARACTERS)


@query("x2_whole", f"WITH {POLICY_SQL}, {X2_SQL.replace(', 1, 50000)', ', 1)')}, u AS (SELECT doc_id, unnest(a) AS e FROM ap) SELECT doc_id, CAST(e.pos AS INT) AS pos, e.name AS name, e.start_page AS start_page, e.content AS content FROM u")
def x2_whole(spark, d):
    """Appendices with all of their text."""
    return sections.appendix_rows(policies(spark, d))


BENEFIT_RE = "((?:무배당\\s+)?(?:\\S+)\\s*특약\\s*약관|(?:제\\d+관)\\s+(?:\\S+)\\s+특약)"
X3_SQL = f"""ch0 AS (SELECT doc_id, generate_subscripts(p, 1) AS j, unnest(p) AS content, p FROM (SELECT doc_id, {PARTS_SQL.format(BENEFIT_RE)} AS p FROM policy)),
ch1 AS (SELECT doc_id, j, content, CASE WHEN j = 1 THEN '메인 약관' ELSE p[j - 1] END AS title, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS trimmed FROM ch0 WHERE j % 2 = 1),
ch2 AS (SELECT doc_id, j, 0 AS k, title, trimmed AS content FROM ch1 WHERE length(content) <= 300 AND trimmed <> ''
  UNION ALL SELECT doc_id, j, k, title || ' (part ' || CAST(k AS VARCHAR) || ')', substr(content, (k - 1) * 300 + 1, 300) FROM (
    SELECT *, unnest(range(1, CAST(ceil(length(content) / 300.0) AS BIGINT) + 1)) AS k FROM ch1 WHERE length(content) > 300))"""


@query("x3", f"WITH {POLICY_SQL}, {X3_SQL} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY j, k) AS INT) AS part_no, title, content, CAST(length(content) AS INT) AS char_count FROM ch2")
def x3(spark, d):
    """Benefit chunks with fixed cuts."""
    return sections.chunk_rows(policies(spark, d), size=300)


@query("w10", f"WITH {POLICY_SQL}, {X3_SQL} SELECT doc_id, title, count(*) AS n FROM ch2 WHERE k > 0 GROUP BY 1, 2")
def w10(spark, d):
    """Part numbers of long chunks."""
    rows = sections.chunk_rows(policies(spark, d), size=300)
    return rows.filter(F.col("title").rlike(r" \(part \d+\)$")).groupBy("doc_id", "title").agg(F.count("*").alias("n"))


COUNTS_SQL = f"""{X1_SQL}, {X2_SQL}, {X3_SQL.replace('300.0', '8000.0').replace('300', '8000')}
SELECT p.doc_id, length(p.text) AS total_chars, coalesce(n_art, 0) AS article_count, coalesce(n_app, 0) AS appendix_count, coalesce(n_ch, 0) AS chunk_count FROM policy p
LEFT JOIN (SELECT doc_id, count(*) AS n_art FROM arts GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, len(a) AS n_app FROM ap) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n_ch FROM ch2 GROUP BY 1) USING (doc_id)"""


@query("a14", COUNTS_SQL)
def a14(spark, d):
    """Characters, articles, appendices and chunks per document."""
    counts = ["total_chars", "article_count", "appendix_count", "chunk_count"]
    return sections.preprocess(policies(spark, d)).select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts])


@query("x4", COUNTS_SQL.replace("SELECT p.doc_id, length(p.text)", "SELECT p.doc_id, coalesce(sections_hash, '') AS chunk_hash, '' AS error, length(p.text)").replace(
    "(SELECT doc_id, count(*) AS n_ch FROM ch2 GROUP BY 1)", "(SELECT doc_id, count(*) AS n_ch, md5(string_agg(title || content, chr(10) ORDER BY j, k)) AS sections_hash FROM ch2 GROUP BY 1)"))
def x4(spark, d):
    """The whole preprocessing result; an error text for empty documents."""
    counts = ["total_chars", "article_count", "appendix_count", "chunk_count"]
    out = sections.preprocess(policies(spark, d), appendix_limit=names.APPENDIX_CHARACTERS)
    joined = F.array_join(F.transform("chunks", lambda c: F.concat(c["title"], c["content"])), "\n")
    return out.select("doc_id", F.md5(joined).alias("chunk_hash"), F.coalesce("error", F.lit("")).alias("error"), *[F.col(c).cast("long").alias(c) for c in counts])


@query("x5", f"""WITH {POLICY_SQL}, t AS (SELECT doc_id, text, strpos(text, '별표') AS s, substr(text, strpos(text, '별표')) AS tail FROM policy WHERE strpos(text, '별표') > 0)
SELECT doc_id, md5(CASE WHEN strpos(substr(tail, 3), '무배당') > 0 THEN substr(tail, 1, strpos(substr(tail, 3), '무배당') + 1) ELSE tail END) AS region_hash FROM t""")
def x5(spark, d):
    """Region from the first start marker to the next end marker; documents without start are skipped."""
    out = policies(spark, d).select("doc_id", sections.region(F.col("text"), "별표", "무배당").alias("region"))
    return out.filter("region is not null").select("doc_id", F.md5("region").alias("region_hash"))


# --- pages: the lines of a document are its pages; every third is a table of word pairs

def page_rows(spark, d) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    words = F.split("line", " ")
    grid = F.array(F.array(F.lit("h1"), F.lit("h2")), F.array(words[0], F.try_element_at(words, F.lit(2))))
    single = F.array(F.array(F.lit("only"), F.lit("header")))
    none = F.array().cast("array<array<array<string>>>")
    kind = F.col("i") % 6
    return lines.select(
        "doc_id", (F.col("i") + 1).alias("page_no"), F.col("line").alias("text"),
        F.when(kind == 2, F.array(grid)).when(kind == 5, F.array(single, grid)).when(kind == 4, F.array(single)).otherwise(none).alias("tables"),
    )


@query("s14", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS l FROM documents),
p AS (SELECT doc_id, n, CASE (n - 1) % 6 WHEN 2 THEN 't' WHEN 5 THEN 't' WHEN 4 THEN 's' ELSE 'p' END AS kind, l FROM l)
SELECT doc_id, md5(string_agg(CASE kind WHEN 't' THEN chr(10) || '<!-- Page ' || CAST(n AS VARCHAR) || ' Table -->' || chr(10) || '| h1 | h2 |' || chr(10) || '|---|---|' || chr(10)
    || '| ' || split_part(l, ' ', 1) || ' | ' || split_part(l, ' ', 2) || ' |' || chr(10)
  WHEN 's' THEN '' ELSE CASE WHEN regexp_replace(l, '^\\s+|\\s+$', '', 'g') = '' THEN '' ELSE chr(10) || '<!-- Page ' || CAST(n AS VARCHAR) || ' -->' || chr(10) || l || chr(10) END END, '' ORDER BY n)) AS text_hash
FROM p GROUP BY 1""")
def s14(spark, d):
    """Pages to document text: tables as markdown, else the text."""
    pages = page_rows(spark, d)
    pieces = pages.select("doc_id", "page_no", sections.page_piece(F.col("page_no"), F.col("text"), F.col("tables")).alias("piece"))
    return sections.assemble(pieces, ["doc_id"], "page_no", "piece").select("doc_id", F.md5("text").alias("text_hash"))


@query("s14_html", """
SELECT page_id, len(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>')) AS n_tables,
  len(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>'), ''), '(?is)<tr[^>]*>(.*?)</tr>')) AS n_rows FROM pages""")
def s14_html(spark, d):
    """Tables and rows found in web pages."""
    tables = sections.html_tables(F.col("html"))
    rows = F.aggregate(tables, F.lit(0), lambda acc, t: acc + F.size(t))
    return table(spark, d, "pages").select("page_id", F.size(tables).cast("long").alias("n_tables"), rows.cast("long").alias("n_rows"))


@query("s15", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS l FROM documents),
k AS (SELECT doc_id, n, (n - 1) % 4 = 3 AS is_row, l FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN is_row THEN replace(l, ' ', ' | ') ELSE l END, chr(10) ORDER BY is_row, n)) AS text_hash
FROM k WHERE is_row OR regexp_replace(l, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY 1""")
def s15(spark, d):
    """Non-blank paragraphs, then table rows with their cells."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    is_row = F.col("i") % 4 == 3
    pieces = lines.select(
        "doc_id", F.struct(is_row.alias("is_row"), F.col("i")).alias("pos"),
        F.when(is_row, F.array_join(F.split("line", " "), " | ")).otherwise(F.col("line")).alias("piece"),
        (is_row | (sections.strip(F.col("line")) != "")).alias("keep"),
    ).filter("keep")
    return sections.assemble(pieces, ["doc_id"], "pos", "piece", "\n").select("doc_id", F.md5("text").alias("text_hash"))


@query("s19", COUNTS_SQL.replace("length(p.text) AS total_chars", "md5(p.text) AS text_hash").replace(", coalesce(n_ch, 0) AS chunk_count", ""))
def s19(spark, d):
    """Structure written as JSON and raw text apart, both read back."""
    out = sections.preprocess(policies(spark, d))
    structure, raw = scratch(spark, "structure"), scratch(spark, "raw")
    out.select("doc_id", "articles", "appendices").write.json(structure)
    out.select("doc_id", "text").write.parquet(raw)
    schema = "doc_id long, articles array<struct<number:string>>, appendices array<struct<name:string>>"
    back = spark.read.schema(schema).json(structure).select(
        "doc_id", F.size("articles").cast("long").alias("article_count"), F.size("appendices").cast("long").alias("appendix_count")
    )
    return spark.read.parquet(raw).select("doc_id", F.md5("text").alias("text_hash")).join(back, "doc_id")
