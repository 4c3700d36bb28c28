"""Order, numbering, neighbours, budgets and reports on events, orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import numbers
from .. import names
from ..operators import assembly, ordered, paging, responses
from .registry import query, table


@query("w1", "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def w1(spark, d):
    """First row per key."""
    return ordered.first_row(table(spark, d, "events"), ["user_id"], "event_id")


def comments(spark, d) -> DataFrame:
    kind = F.col("event_type")
    word = F.when(kind == "error", "상해관련 특별약관").when(kind == "view", "별표").otherwise(kind)
    return table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 10).alias("start"), word.alias("comment"))


COMMENTS_SQL = "c AS (SELECT user_id, event_id, event_id * 10 AS start, CASE event_type WHEN 'error' THEN '상해관련 특별약관' WHEN 'view' THEN '별표' ELSE event_type END AS comment FROM events)"


@query("w3", f"WITH {COMMENTS_SQL} SELECT *, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY event_id), start) AS range_end FROM c")
def w3(spark, d):
    """Range of a comment ends where the next one starts."""
    return assembly.comment_ranges(comments(spark, d), "user_id", "event_id", "start")


@query("w4", f"""WITH {COMMENTS_SQL},
m AS (SELECT user_id, event_id, start, comment FROM c WHERE contains(comment, '관련 특별약관') OR contains(comment, '별표'))
SELECT c.user_id, c.event_id, c.start, c.comment, min(m.start) AS section_end
FROM c LEFT JOIN m ON m.user_id = c.user_id AND m.event_id > c.event_id AND NOT contains(m.comment, c.comment) GROUP BY ALL""")
def w4(spark, d):
    """Next section marker of a different section."""
    return assembly.section_ends(comments(spark, d), "user_id", "event_id", "start", "comment", width=4096)


@query("w4_text", """
WITH t AS (SELECT doc_id, replace(replace(text, ' the ', ' 별표 '), ' de ', ' 제도성 특별약관 ') AS text, CAST(n_chars % 50 AS INT) AS start FROM documents),
a AS (SELECT *, strpos(substr(text, start + 1), '별표') AS p1, strpos(substr(text, start + 1), '제도성 특별약관') AS p2 FROM t),
b AS (SELECT *, CASE WHEN p1 > 0 THEN length(regexp_extract(substr(text, 1, start + p1 - 1), '(?s)^(.*\n)', 1)) END AS l1,
  CASE WHEN p2 > 0 THEN length(regexp_extract(substr(text, 1, start + p2 - 1), '(?s)^(.*\n)', 1)) END AS l2 FROM a)
SELECT doc_id, CAST(least(length(text), CASE WHEN l1 > start THEN l1 END, CASE WHEN l2 > start THEN l2 END) AS INT) AS section_end FROM b""")
def w4_text(spark, d):
    """Nearest later section marker in a text, else its end."""
    text = F.replace(F.replace("text", F.lit(" the "), F.lit(" 별표 ")), F.lit(" de "), F.lit(" 제도성 특별약관 "))
    docs = table(spark, d, "documents").select("doc_id", text.alias("text"), (F.col("n_chars") % 50).cast("int").alias("start"))
    return docs.select("doc_id", assembly.nearest_section(F.col("text"), F.col("start")).alias("section_end"))


@query("w5", "SELECT props AS title, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM events GROUP BY 1")
def w5(spark, d):
    """A title is copied once, the first wins."""
    clauses = table(spark, d, "events").select(F.col("props").alias("title"), "event_id", "user_id")
    return assembly.copy_once(clauses, "title", "event_id")


@query("w6", """SELECT event_id, event_type, last_value(CASE WHEN user_id % 5 = 0 THEN props END IGNORE NULLS)
  OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events""")
def w6(spark, d):
    """Forward fill of the last heading above; five keys hold the whole table, cut into small blocks."""
    rows = table(spark, d, "events").select("event_id", "event_type", "user_id", "props")
    out = ordered.last_filled(rows, ["event_type"], "event_id", F.when(F.col("user_id") % 5 == 0, F.col("props")), "heading", width=1000)
    return out.select("event_id", "event_type", "heading")


@query("w7", "SELECT p_brand, p_partkey, '[' || CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS VARCHAR) || '] 담보명: ' || p_name || ' / 세부담보템플릿명: ' || p_type AS item FROM part")
def w7(spark, d):
    """Numbered item lines per benefit list."""
    rows = ordered.number_in_order(table(spark, d, "part"), ["p_brand"], "p_partkey", "n")
    return rows.select("p_brand", "p_partkey", responses.item_line(F.col("n"), F.col("p_name"), F.col("p_type")).alias("item"))


@query("w8", """SELECT o_orderkey, n AS row_no, CAST((n - 1) // 20 + 1 AS BIGINT) AS batch_no, CAST(ceil(t / 20.0) AS BIGINT) AS batch_total
  FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS t FROM orders)""")
def w8(spark, d):
    """Batches of 20 over one list, cut into blocks."""
    return ordered.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20, width=4096)


@query("w9", """
WITH RECURSIVE p AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, 'doc' || CAST(doc_id AS VARCHAR) AS name, text FROM documents WHERE length(text) > 0),
b AS (SELECT *, coalesce(sum(length(text) + length(name) + 11) OVER (PARTITION BY source ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT source, CAST(sum(length(piece)) AS BIGINT) AS n_chars, md5(string_agg(piece, '' ORDER BY n)) AS text_hash
FROM (SELECT source, n, chr(10) || '=== ' || name || ' ===' || chr(10) || substr(text, 1, CAST(100000 - before AS BIGINT)) || chr(10) AS piece FROM b WHERE before < 100000) GROUP BY 1""")
def w9(spark, d):
    """Text of a group up to 100,000 characters."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    out = responses.budget_text(docs, ["source"], "doc_id", "name", "text", names.BUDGET_CHARACTERS)
    return out.select("source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_hash"))


@query("w9_whole", """
SELECT source, doc_id, CAST(coalesce(sum(length(text) + length(CAST(doc_id AS VARCHAR)) + 14) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
  md5(chr(10) || '=== doc' || doc_id || ' ===' || chr(10) || text || chr(10)) AS piece_hash FROM documents WHERE length(text) > 0""")
def w9_whole(spark, d):
    """Every piece of a group with its place in the group's text, nothing left out."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), "text")
    out = responses.budget_rows(docs, ["source"], "doc_id", "name", "text")
    return out.select("source", "doc_id", "before", F.md5("piece").alias("piece_hash"))


@query("w11", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber * 3 <= 15 THEN substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮', l_linenumber * 3, 1) ELSE '(' || (l_linenumber * 3) || ')' END AS mark FROM lineitem")
def w11(spark, d):
    """Circled numbers by position, in brackets where there is no circled one."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", assembly.circled(F.col("l_linenumber") * 3).alias("mark"))


@query("w12", "SELECT event_id, event_type, user_id FROM events ORDER BY event_id DESC LIMIT 100")
def w12(spark, d):
    """Last 100 log lines."""
    return paging.last_lines(table(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id")


@query("t1", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def t1(spark, d):
    """One page by newest, with the total."""
    out = paging.page(table(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 50)
    return out.select("o_orderkey", "o_totalprice", "total")


@query("t2", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50")
def t2(spark, d):
    """Newest 50 of one kind."""
    return paging.newest(table(spark, d, "events"), [F.desc("ts"), F.asc("event_id")], 50, F.col("event_type") == "error").select("event_id", "user_id")


@query("t3", "SELECT url, page_id FROM pages ORDER BY url, page_id LIMIT 1")
def t3(spark, d):
    """First file by name."""
    return paging.newest(table(spark, d, "pages").select("url", "page_id"), [F.asc("url"), F.asc("page_id")], 1)


@query("t4", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  list_sort([CAST(l_quantity AS INT), CAST(l_suppkey AS INT), CAST(l_linenumber * 9 AS INT)])[l_linenumber] AS kth FROM lineitem""")
def t4(spark, d):
    """k-th smallest entry of an array, null when out of range."""
    values = F.array(F.col("l_quantity").cast("int"), F.col("l_suppkey").cast("int"), (F.col("l_linenumber") * 9).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.kth_smallest(values, F.col("l_linenumber")).alias("kth"))


@query("t5", "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, '') AS p_name FROM part ORDER BY p_partkey LIMIT 50")
def t5(spark, d):
    """First 50 rows, null as ''."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).alias("p_name"))
    return paging.head(rows, [F.asc("p_partkey")], 50)
