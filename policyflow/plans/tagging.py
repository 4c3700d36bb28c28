"""Tag rendering, phrases and assembly on texts made from parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import tags, text as tx
from ..operators import assembly
from .registry import ORACLES, query, table

# Context of a part: flags from its keys.
FLAGS_SQL = """p_size % 2 AS exempt, p_size % 3 AS reduce, (p_partkey % 2) AS confirm, (p_partkey % 3) AS parent, (p_partkey % 4) AS reserve, (p_partkey % 5) AS extend,
  (p_size % 4) AS team, (p_partkey + p_size) % 2 AS renew, p_size % 5 AS no_renew, p_size % 7 AS independent, p_size % 2 = 0 AS once, p_size % 2 = 1 AS twice"""


def context():
    k, n = F.col("p_partkey").cast("int"), F.col("p_size")
    names_ = F.split("p_name", " ")
    periods = F.array(F.array(n * 30, F.lit(7)), F.array(F.lit(365), F.lit(45)))
    rates = F.create_map(F.col("p_brand"), F.array(F.array(n.cast("double")), F.array(F.lit(100.0), F.lit(50.0))))
    return F.struct(
        (n % 2).alias("exempt"), (n % 3).alias("reduce"), (k % 2).alias("confirm"), (k % 3).alias("parent"), (k % 4).alias("reserve"),
        (k % 5).alias("extend"), (n % 4).alias("team"), ((k + n) % 2).alias("renew"), (n % 5).alias("no_renew"), (n % 7).alias("independent"),
        (n % 2 == 0).alias("once"), (n % 2 == 1).alias("twice"), names_.alias("names"), periods.alias("periods"),
        F.array("p_brand").alias("codes"), rates.alias("rates"),
    )


_SECTIONS = [  # kind, truth in SQL
    ("면책", "exempt > 0"), ("감액있음", "reduce > 0"), ("비갱신", "(no_renew > 0 OR renew = 0)"), ("갱신", "renew > 0"), ("감액한번", "(once AND NOT twice)"),
    ("감액두번", "twice"), ("진단확정", "confirm > 0"), ("자동갱신형", "renew > 0"), ("독립특약", "independent > 0"),
]
PLAIN = "a"


def control_text():
    """Every control kind with a kept and a dropped passage around the part name, over two lines."""
    pieces = [F.lit(PLAIN)]
    for i, (kind, _) in enumerate(_SECTIONS):
        pieces += [
            F.lit("{%s%d-1}" % (kind, i)), F.col("p_name"), F.lit("\n%d{%s%d-2}-{%s%d-3}" % (i, kind, i, kind, i)), F.col("p_type"), F.lit("{%s%d-4}." % (kind, i)),
        ]
    return F.concat(*pieces)


def _control_sql():
    parts = [f"'{PLAIN}'"]
    for i, (_, truth) in enumerate(_SECTIONS):
        parts += [f"CASE WHEN {truth} THEN p_name || chr(10) || '{i}' ELSE '' END", "'-'", f"CASE WHEN {truth} THEN '' ELSE p_type END", "'.'"]
    return " || ".join(parts)


def get() -> dict:
    return tags.context_getters(F.col("ctx"))


def tagged(spark, d, text) -> DataFrame:
    return table(spark, d, "part", spread=True).select("p_partkey", text.alias("text"), context().alias("ctx"))


@query("g1", f"SELECT p_partkey, {_control_sql()} AS rendered FROM (SELECT *, {FLAGS_SQL} FROM part)")
def g1(spark, d):
    """Conditional sections of all nine kinds."""
    rows = tagged(spark, d, control_text())
    return rows.select("p_partkey", tags.render_control(F.col("text"), tags.attribute_truth(F.col("ctx"))).alias("rendered"))


@query("g2", "SELECT p_partkey, %s FROM (SELECT *, %s FROM part)" % (", ".join(f"{t} AS {k}" for k, t in _SECTIONS), FLAGS_SQL))
def g2(spark, d):
    """Attribute truth."""
    truth = tags.attribute_truth(F.col("ctx"))
    return tagged(spark, d, F.lit("")).select("p_partkey", *[c.alias(k) for k, c in truth.items()])


@query("p4", "SELECT p_partkey FROM part WHERE p_size % 3 = 0")
def p4(spark, d):
    """Texts with a control tag; other braces do not count."""
    n = F.col("p_size")
    text = F.when(n % 3 == 0, F.concat("p_name", F.lit("{갱신1-1}"))).when(n % 3 == 1, F.concat("p_name", F.lit("{x}"))).otherwise(F.col("p_name"))
    return tagged(spark, d, text).filter(tags.has_control_tag(F.col("text"))).select("p_partkey")


PHRASES_SQL = """ph AS (SELECT s_suppkey AS pos, CASE s_suppkey % 7 WHEN 0 THEN '{단체1}' WHEN 1 THEN '{감액2}' WHEN 2 THEN '{연장형}' WHEN 3 THEN '{부모3}' WHEN 4 THEN '{예약가입2}' WHEN 5 THEN '{진단확정1}' ELSE '{보통약관 해약환급금}' END AS tag,
  CASE s_suppkey % 7 WHEN 0 THEN '단체' WHEN 1 THEN '감액' WHEN 2 THEN '연장형' WHEN 3 THEN '부모' WHEN 4 THEN '예약가입연령' WHEN 5 THEN '진단확정' ELSE '' END AS attribute,
  CASE WHEN s_suppkey % 29 = 28 THEN '' WHEN s_suppkey % 11 = 3 THEN 'x' ELSE CAST(s_nationkey % 2 AS VARCHAR) END AS flag, 'phrase ' || CAST(s_suppkey AS VARCHAR) AS phrase FROM supplier)"""


def phrase_rows(spark, d) -> DataFrame:
    """Phrases under the column names of the second naming."""
    k = F.col("s_suppkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % 7 + 1).cast("int"))
    return table(spark, d, "supplier").select(
        k.alias("pos"), pick("{단체1}", "{감액2}", "{연장형}", "{부모3}", "{예약가입2}", "{진단확정1}", "{보통약관 해약환급금}").alias("태그명"),
        pick("단체", "감액", "연장형", "부모", "예약가입연령", "진단확정", "").alias("담보속성"),
        F.when(k % 29 == 28, "").when(k % 11 == 3, "x").otherwise((F.col("s_nationkey") % 2).cast("string")).alias("적용구분"),
        F.concat(F.lit("phrase "), k.cast("string")).alias("적용문구"),
    )


# answer of one lookup: first row in order that is blank (answer '') or has the wanted flag
LOOKUP_SQL = """w AS (SELECT tag, attribute, wanted, arg_min(CASE WHEN flag = '' THEN '' ELSE phrase END, pos) AS phrase
  FROM ph CROSS JOIN (VALUES (0), (1)) v(wanted) WHERE flag = '' OR TRY_CAST(flag AS INT) = wanted GROUP BY 1, 2, 3),
fr AS (SELECT tag, arg_min(CASE WHEN flag = '' THEN '' ELSE phrase END, pos) AS phrase FROM ph GROUP BY 1)"""


@query("g3", f"""WITH {PHRASES_SQL}, {LOOKUP_SQL},
q AS (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN '{{단체1}}' WHEN 1 THEN '{{감액2}}' WHEN 2 THEN '{{연장형}}' WHEN 3 THEN '{{부모3}}' WHEN 4 THEN '{{예약가입2}}' WHEN 5 THEN '{{진단확정1}}' WHEN 6 THEN '{{보통약관 해약환급금}}' ELSE '{{none}}' END AS tag,
  CASE p_partkey % 8 WHEN 0 THEN '단체' WHEN 1 THEN '감액' WHEN 2 THEN '연장형' WHEN 3 THEN '단체' WHEN 4 THEN '예약가입연령' WHEN 5 THEN '진단확정' END AS attribute, CASE WHEN p_partkey % 8 < 6 THEN p_size % 2 END AS wanted FROM part)
SELECT p_partkey, q.tag, coalesce(CASE WHEN q.attribute IS NULL THEN fr.phrase ELSE w.phrase END, '') AS phrase
FROM q LEFT JOIN w ON w.tag = q.tag AND w.attribute = q.attribute AND w.wanted = q.wanted LEFT JOIN fr ON fr.tag = q.tag""")
def g3(spark, d):
    """Phrase lookup by tag, attribute and flag."""
    k = F.col("p_partkey")
    tag = F.element_at(F.array(*[F.lit(x) for x in ("{단체1}", "{감액2}", "{연장형}", "{부모3}", "{예약가입2}", "{진단확정1}", "{보통약관 해약환급금}", "{none}")]), (k % 8 + 1).cast("int"))
    attribute = F.element_at(F.array(*[F.lit(x) for x in ("단체", "감액", "연장형", "단체", "예약가입연령", "진단확정", None, None)]), (k % 8 + 1).cast("int"))
    asked = table(spark, d, "part").select(k, tag.alias("tag"), attribute.alias("attribute"), F.when(k % 8 < 6, F.col("p_size") % 2).alias("wanted"))
    index = assembly.phrase_index(assembly.phrase_table(phrase_rows(spark, d), "pos"))
    return assembly.find_phrases(asked, index).select("p_partkey", "tag", "phrase")


_PHRASE_PARTS = [  # written tag, key, attribute, wanted in SQL
    ("{단체}", "{단체1}", "단체", "team"), ("{감액2-3}", "{감액2}", "감액", "reduce"), ("{연장형}", "{연장형}", "연장형", "extend"), ("{부모3}", "{부모3}", "부모", "parent"),
    ("{예약가입2}", "{예약가입2}", "예약가입연령", "reserve"), ("{진단확정1}", "{진단확정1}", "진단확정", "confirm"), ("{보통약관 해약환급금}", "{보통약관 해약환급금}", None, None), ("{부모9}", "{부모9}", "부모", "parent"),
]


def phrase_text():
    return F.concat(*[c for i, (t, *_) in enumerate(_PHRASE_PARTS) for c in (F.lit(f"{i}" + t), F.col("p_type"))])


def _phrase_sql():
    joins, parts = [], []
    for i, (_, key, attribute, flag) in enumerate(_PHRASE_PARTS):
        if attribute:
            joins.append(f"LEFT JOIN w w{i} ON w{i}.tag = '{key}' AND w{i}.attribute = '{attribute}' AND w{i}.wanted = CASE WHEN {flag} > 0 THEN 1 ELSE 0 END")
        else:
            joins.append(f"LEFT JOIN fr w{i} ON w{i}.tag = '{key}'")
        parts.append(f"'{i}' || coalesce(w{i}.phrase, '') || p_type")
    return " || ".join(parts), " ".join(joins)


@query("g4", f"WITH {PHRASES_SQL}, {LOOKUP_SQL} SELECT p_partkey, {_phrase_sql()[0]} AS rendered FROM (SELECT *, {FLAGS_SQL} FROM part) {_phrase_sql()[1]}")
def g4(spark, d):
    """Phrase tags in texts."""
    rows = tagged(spark, d, phrase_text())
    index = assembly.phrase_index(assembly.phrase_table(phrase_rows(spark, d), "pos"))
    maps = assembly.phrase_maps(rows, index, ["p_partkey"], "text", "ctx")
    joined = rows.join(maps, "p_partkey", "left")
    phrases = F.coalesce("phrases", F.create_map().cast(assembly.PHRASE_SCHEMA))
    return joined.select("p_partkey", tags.render_phrases(F.col("text"), phrases).alias("rendered"))


@query("g5", "SELECT p_partkey, 'x' || '「' || split_part(p_name, ' ', 2) || '」' || 'y' || '' || 'z' || '「' || split_part(p_name, ' ', 1) || '」' AS rendered FROM part")
def g5(spark, d):
    """Sub-coverage names by number, '' out of range."""
    rows = tagged(spark, d, F.lit("x{세부보장2}y{세부보장10}z{세부보장1}"))
    return rows.select("p_partkey", tags.map_matches(F.col("text"), tags.NAME_TAG, lambda t: tags.name_answer(t, get()["name_of"])).alias("rendered"))


PERIOD_SQL = "CASE WHEN {0} = 0 THEN '' WHEN {0} < 30 THEN {0} || '일' WHEN {0} < 365 THEN CASE WHEN {0} % 30 = 0 THEN ({0} // 30) || '개월' ELSE {0} || '일' END WHEN {0} % 365 = 0 THEN ({0} // 365) || '년' ELSE {0} || '일' END"


@query("g6", f"SELECT p_partkey, {PERIOD_SQL.format('least(p_size * 30, 7)')} || '/' || {PERIOD_SQL.format('greatest(p_size * 30, 7)')} || '/45일/1년/NA/NA' AS rendered FROM part")
def g6(spark, d):
    """k-th smallest reduction period, NA out of range."""
    rows = tagged(spark, d, F.lit("{감액기간1-1}/{감액기간1-2}/{감액기간2-1}/{감액기간2-2}/{감액기간2-3}/{감액기간5-1}"))
    return rows.select("p_partkey", tags.map_matches(F.col("text"), tags.PERIOD_TAG, lambda t: tags.period_answer(t, get()["periods_of"])).alias("rendered"))


@query("g7", """SELECT p_partkey, CAST(p_size * 2 AS VARCHAR) || '%|' || CASE WHEN p_size % 3 = 0 THEN CAST(p_size // 3 AS VARCHAR) ELSE printf('%.1f', p_size / 3.0::DOUBLE) END || '|' || CAST(p_size AS VARCHAR) || '|50|100%|' AS rendered FROM part""")
def g7(spark, d):
    """Pay rates with arithmetic."""
    rows = tagged(spark, d, F.lit("{지급률1-1-1}*2%|{지급률1-1-1}/3|{지급률1-1-1}|{지급률1-2-1}|{지급률1-2-2}%|{지급률2-1-1}"))
    return rows.select("p_partkey", tags.map_matches(F.col("text"), tags.RATE_TAG, lambda t: tags.rate_answer(t, get()["rates_of"])).alias("rendered"))


@query("g8", "SELECT p_partkey, p_name || '' || p_type || '{other}' AS cleaned FROM part")
def g8(spark, d):
    """Leftover known tags removed, other braces kept."""
    rows = tagged(spark, d, F.concat("p_name", F.lit("{감액기간3-9}{독립특약0-1}"), "p_type", F.lit("{other}{면책}")))
    return rows.select("p_partkey", tags.cleanup(F.col("text")).alias("cleaned"))


@query("g9", f"""WITH {PHRASES_SQL}, {LOOKUP_SQL} SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE {_control_sql()} || {_phrase_sql()[0]} || '「' || split_part(p_name, ' ', 1) || '」' || CAST(p_size AS VARCHAR) || '%' END AS rendered
FROM (SELECT *, {FLAGS_SQL} FROM part) {_phrase_sql()[1]}""")
def g9(spark, d):
    """Full rendering; texts without braces stay."""
    full = F.concat(control_text(), phrase_text(), F.lit("{세부보장1}{지급률1-1-1}%{독립특약9}"))
    rows = tagged(spark, d, F.when(F.col("p_partkey") % 6 == 0, F.col("p_name")).otherwise(full))
    index = assembly.phrase_index(assembly.phrase_table(phrase_rows(spark, d), "pos"))
    return assembly.render_clauses(rows, index, "text", "ctx").select("p_partkey", "rendered")


g9_joined = query("g9_joined", ORACLES["g9"])(g9)


@query("g10", f"""WITH {PHRASES_SQL}, {LOOKUP_SQL}, e AS (
  SELECT p_partkey, '{{단체1}}' AS tag, coalesce(w0.phrase, '') AS repl FROM (SELECT *, {FLAGS_SQL} FROM part) LEFT JOIN w w0 ON w0.tag = '{{단체1}}' AND w0.attribute = '단체' AND w0.wanted = CASE WHEN team > 0 THEN 1 ELSE 0 END
  UNION ALL SELECT p_partkey, '{{세부보장1}}', '「' || split_part(p_name, ' ', 1) || '」' FROM part
  UNION ALL SELECT p_partkey, '{{감액기간2-1}}', '45일' FROM part)
SELECT p_partkey, string_agg(tag || '=' || repl, ';' ORDER BY tag) AS entries FROM e GROUP BY 1""")
def g10(spark, d):
    """Replacement dictionary of a text; unresolved periods are left out."""
    rows = tagged(spark, d, F.lit("{단체1}{세부보장1}{감액기간2-1}{감액기간9-1}{단체1}"))
    index = assembly.phrase_index(assembly.phrase_table(phrase_rows(spark, d), "pos"))
    joined = rows.join(assembly.phrase_maps(rows, index, ["p_partkey"], "text", "ctx"), "p_partkey", "left")
    entries = F.map_entries(assembly.replacements(F.col("text"), F.col("ctx"), F.col("phrases")))
    return joined.select("p_partkey", F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("entries"))


# --- assembly: parts are coverages, suppliers their clauses, nations the sections


@query("g11", """
WITH cov AS (SELECT p_partkey AS pos, 'R' || CAST(p_size AS VARCHAR) AS code, CASE p_partkey % 3 WHEN 0 THEN '상해' WHEN 1 THEN '질병' ELSE '펫' END AS category, CASE WHEN p_partkey % 4 = 0 THEN 'A모듈' ELSE '' END AS module FROM part),
rg AS (SELECT 'R' || CAST(s_suppkey % 60 AS VARCHAR) AS code, CASE s_nationkey % 2 WHEN 0 THEN '상해' ELSE '질병' END AS category, s_suppkey AS comment_no, 'T' || CAST(s_suppkey % 40 AS VARCHAR) AS title,
       CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE s_name END AS body FROM supplier),
per AS (SELECT code, category, arg_max(title, comment_no) AS title, arg_max(body, comment_no) AS body, min(comment_no) AS seen FROM rg GROUP BY 1, 2),
fb AS (SELECT code, arg_min(title, seen) AS title, arg_min(body, seen) AS body FROM per GROUP BY 1),
f AS (SELECT pos, c.category, module, coalesce(per.title, fb.title) AS title, CASE WHEN per.title IS NOT NULL THEN per.body ELSE fb.body END AS body FROM cov c LEFT JOIN per USING (code, category) LEFT JOIN fb USING (code)),
o AS (SELECT * FROM f WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1),
sec AS (SELECT CASE WHEN n_nationkey < 12 THEN '' ELSE 'A모듈-' END || CASE n_nationkey % 3 WHEN 0 THEN '상해' WHEN 1 THEN '질병' ELSE '펫' END || '관련 특별약관' AS section, min(n_nationkey) AS section_no FROM nation GROUP BY 1)
SELECT CAST(section_no AS INT) AS section_no, row_number() OVER (PARTITION BY section_no ORDER BY pos) AS line_no, title, body
FROM o JOIN sec ON section = CASE WHEN module <> '' THEN module || '-' ELSE '' END || category || '관련 특별약관' WHERE body <> ''""")
def g11(spark, d):
    """Clauses in coverage order, copied once, at the end of their section."""
    k, s, n = F.col("p_partkey"), F.col("s_suppkey"), F.col("n_nationkey")
    kind = lambda c: F.when(c % 3 == 0, "상해").when(c % 3 == 1, "질병").otherwise("펫")
    cov = table(spark, d, "part").select(
        k.alias("pos"), F.concat(F.lit("R"), F.col("p_size").cast("string")).alias("code"), kind(k).alias("category"), F.when(k % 4 == 0, "A모듈").otherwise("").alias("module")
    )
    ranges = table(spark, d, "supplier").select(
        F.concat(F.lit("R"), (s % 60).cast("string")).alias("code"), F.when(F.col("s_nationkey") % 2 == 0, "상해").otherwise("질병").alias("category"),
        s.alias("comment_no"), F.concat(F.lit("T"), (s % 40).cast("string")).alias("title"), F.when(s % 13 == 0, "").otherwise(F.col("s_name")).alias("body"),
    )
    sections = table(spark, d, "nation").select(
        assembly.section_title(F.when(n >= 12, "A모듈").otherwise(""), kind(n)).alias("section"), n.alias("section_no")
    )
    return assembly.assemble_rows(cov, ranges, sections).select("section_no", "line_no", "title", "body")


@query("g12", """
WITH b AS (SELECT 'C' || CAST(s_nationkey % 3 AS VARCHAR) AS category, 'N' || CAST(s_suppkey % 70 AS VARCHAR) AS name, arg_min(s_name, s_suppkey) AS body FROM supplier GROUP BY 1, 2)
SELECT p_partkey, t.category, t.name, coalesce(b.body, t.body) AS body, b.body IS NOT NULL AS replaced
FROM (SELECT p_partkey, 'C' || CAST(p_partkey % 4 AS VARCHAR) AS category, 'N' || CAST(p_size * 2 AS VARCHAR) AS name, p_name AS body FROM part) t LEFT JOIN b USING (category, name)""")
def g12(spark, d):
    """Appendix bodies replaced by the base body of their category."""
    part, s = table(spark, d, "part"), F.col("s_suppkey")
    targets = part.select(
        "p_partkey", F.concat(F.lit("C"), (F.col("p_partkey") % 4).cast("string")).alias("category"),
        F.concat(F.lit("N"), (F.col("p_size") * 2).cast("string")).alias("name"), F.col("p_name").alias("body"),
    )
    base = table(spark, d, "supplier").select(
        F.concat(F.lit("C"), (F.col("s_nationkey") % 3).cast("string")).alias("category"), F.concat(F.lit("N"), (s % 70).cast("string")).alias("name"),
        F.col("s_name").alias("body"), s.alias("pos"),
    )
    return assembly.replace_appendices(targets, base, "category", "name", "body", "pos")


@query("x6", "SELECT doc_id, md5(CASE WHEN length(text) % 2 = 0 THEN 'head\n' || substr(text, 20) ELSE 'head' || substr(text, 1, 19) || substr(text, 20) END) AS text_hash FROM documents")
def x6(spark, d):
    """Zero-age passage deleted, or only its tags and the character before."""
    t = F.col("text")
    marked = F.concat(F.lit("head\n{0세자녀-1}"), F.substring(t, 1, 19), F.lit("{0세자녀-2}"), F.substring(t, F.lit(20), F.length(t)))
    return table(spark, d, "documents").select("doc_id", F.md5(tags.zero_age(marked, F.length(t) % 2)).alias("text_hash"))


@query("x7", "SELECT page_id, '{별표' || replace(trim(translate(url, chr(10), '')), ' ', '') || '}' AS placeholder FROM (SELECT page_id, ' ' || replace(url, '/', ' ') || chr(10) AS url FROM pages)")
def x7(spark, d):
    """Reference text to placeholder."""
    reference = F.concat(F.lit(" "), F.replace("url", F.lit("/"), F.lit(" ")), F.lit("\n"))
    return table(spark, d, "pages").select("page_id", assembly.cross_reference(reference).alias("placeholder"))


@query("x8", "SELECT doc_id, md5(replace(replace(replace(text, ' the ', ' [T] '), '[T] ', '<' || lang || '>'), '.', '')) AS text_hash FROM documents")
def x8(spark, d):
    """Several find/replace pairs applied in order."""
    pair = lambda f, r: F.struct(F.lit(f).alias("find"), r.alias("repl"))
    pairs = F.array(pair(" the ", F.lit(" [T] ")), pair("[T] ", F.concat(F.lit("<"), "lang", F.lit(">"))), pair(".", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.replace_all(F.col("text"), pairs)).alias("text_hash"))


@query("x9", """SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'ab' ELSE 'a' || text || 'b' END) AS text_hash, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS INT) AS pairs FROM documents""")
def x9(spark, d):
    """Tag pairs deleted with or without content, and counted."""
    t = F.concat(F.lit("a{갱신1-1}"), "text", F.lit("{갱신1-2}b"), F.when(F.col("doc_id") % 3 != 0, "{갱신1-1}{갱신1-2}").otherwise(""))
    out = tags.drop_pairs(t, "갱신", 1, 2, F.col("doc_id") % 2 == 1)
    return table(spark, d, "documents").select("doc_id", F.md5(out).alias("text_hash"), tags.pair_count(t, "갱신", 1, 2).alias("pairs"))
