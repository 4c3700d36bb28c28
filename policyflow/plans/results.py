"""Responses, vote, gate and review on orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..operators import lookups, paging, project, responses, review, vote
from .registry import query, table

# --- model responses: JSON text made from event properties, broken in several ways

_OBJ_SQL = """'{"benefit_name": "' || event_type || '", "template_name": "u' || user_id || '", "inferred_code": "C' || (event_id % 100) || '", "confidence": "high"}'"""
RAW_SQL = f"""raw AS (SELECT event_id, CASE event_id % 7
  WHEN 0 THEN '```json' || chr(10) || '[' || o || ', ' || o || ']' || chr(10) || '```'
  WHEN 1 THEN 'Answer: [' || o || ', {{"benefit_name": broken}}, ' || o || ',]'
  WHEN 2 THEN 'no array here'
  WHEN 3 THEN '[' || o || ']'
  WHEN 4 THEN '관련 내용 없음'
  WHEN 5 THEN ''
  ELSE '[]' END AS raw, o FROM (SELECT *, {_OBJ_SQL} AS o FROM events))"""


def raw_responses(spark, d) -> DataFrame:
    i = F.col("event_id")
    o = F.concat(
        F.lit('{"benefit_name": "'), F.col("event_type"), F.lit('", "template_name": "u'), F.col("user_id").cast("string"),
        F.lit('", "inferred_code": "C'), (i % 100).cast("string"), F.lit('", "confidence": "high"}'),
    )
    kind = i % 7
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n["), o, F.lit(", "), o, F.lit("]\n```")))
        .when(kind == 1, F.concat(F.lit("Answer: ["), o, F.lit(', {"benefit_name": broken}, '), o, F.lit(",]")))
        .when(kind == 2, "no array here").when(kind == 3, F.concat(F.lit("["), o, F.lit("]")))
        .when(kind == 4, names.NOTHING_FOUND).when(kind == 5, "").otherwise("[]")
    )
    return table(spark, d, "events", spread=True).select("event_id", raw.alias("raw"))


_FIELDS = ["benefit_name", "template_name", "inferred_code", "confidence"]


@query("k1", f"""WITH {RAW_SQL}
SELECT event_id, CASE event_id % 7 WHEN 0 THEN '[' || o || ', ' || o || ']' WHEN 1 THEN '[' || o || ', {{"benefit_name": broken}}, ' || o || ',]' WHEN 3 THEN '[' || o || ']' WHEN 6 THEN '[]' ELSE '' END AS slice,
  CASE event_id % 7 WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 6 THEN 0 ELSE -1 END AS n_objects FROM raw""")
def k1(spark, d):
    """Array slice of a response and the number of objects it parses to (-1 when it does not parse)."""
    parsed = responses.parse_slice(F.col("raw"))
    return raw_responses(spark, d).select(
        "event_id", responses.array_slice(F.col("raw")).alias("slice"), F.coalesce(F.size(parsed), F.lit(-1)).alias("n_objects")
    ).withColumn("n_objects", F.when(F.col("n_objects") < 0, -1).otherwise(F.col("n_objects")))


@query("k2", f"""WITH {RAW_SQL}, n AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n FROM raw)
SELECT event_id, CAST(k AS INT) AS obj_no, event_type AS benefit_name, 'u' || user_id AS template_name, 'C' || (event_id % 100) AS inferred_code, 'high' AS confidence
FROM (SELECT event_id, unnest(range(0, n)) AS k FROM n) JOIN events USING (event_id)""")
def k2(spark, d):
    """Rows recovered from responses, object by object where the array is broken."""
    rows = responses.response_rows(raw_responses(spark, d), "raw")
    return rows.select("event_id", "obj_no", *_FIELDS)


@query("k3", f"WITH {RAW_SQL} SELECT event_id, CASE event_id % 7 WHEN 0 THEN 2 WHEN 3 THEN 1 WHEN 6 THEN 0 ELSE -1 END AS n_objects FROM raw")
def k3(spark, d):
    """Fence-only parse: the whole text must be an array."""
    parsed = responses.parse_fenced(F.col("raw"), _FIELDS)
    return raw_responses(spark, d).select("event_id", F.when(parsed.isNull(), -1).otherwise(F.size(parsed)).alias("n_objects"))


@query("p5", f"WITH {RAW_SQL} SELECT event_id, raw FROM raw WHERE raw <> '' AND NOT contains(raw, '관련 내용 없음')")
def p5(spark, d):
    """Answers that say something."""
    return raw_responses(spark, d).filter(responses.useful(F.col("raw")))


_PROMPT_TAIL = f"Answer with a JSON array of objects with the fields {', '.join(names.RESPONSE_FIELDS)}. An empty inferred_code needs its reason in ref_sentence."


@query("k4", """
WITH a AS (SELECT * FROM (VALUES %s) v(attribute, attribute_name))
SELECT p_partkey, attribute, md5('Task: infer ''' || attribute_name || ''' for every item.' || chr(10)
  || CASE WHEN p_size %% 2 = 0 THEN 'Instructions:' || chr(10) || 'Look at ' || p_brand || ' first.' || chr(10) ELSE '' END || 'Mapping tables:' || chr(10) || p_type || chr(10)
  || 'Rules:' || chr(10) || '추출된 로직 없음. 표준 보험/의료 지식 활용.' || chr(10) || CASE WHEN p_size %% 3 = 0 THEN 'Example:' || chr(10) || p_type || ' -> ' || p_size || chr(10) ELSE '' END
  || 'Items:' || chr(10) || '[1] 담보명: ' || p_name || ' / 세부담보템플릿명: ' || p_brand || chr(10) || '%s') AS prompt_hash
FROM part CROSS JOIN a""" % (", ".join(f"('{k}', '{n}')" for k, n, _ in names.ATTRIBUTES), _PROMPT_TAIL))
def k4(spark, d):
    """One whole prompt per item and attribute, some with instructions or a worked example; the attributes are a fixed list of nine."""
    nine = F.array(*[F.struct(F.lit(k).alias("attribute"), F.lit(n).alias("attribute_name")) for k, n, _ in names.ATTRIBUTES])
    rows = table(spark, d, "part").select("*", F.explode(nine).alias("a"))
    item = responses.item_line(F.lit(1), F.col("p_name"), F.col("p_brand"))
    instructions = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Look at "), "p_brand", F.lit(" first.")))
    example = F.when(F.col("p_size") % 3 == 0, F.concat("p_type", F.lit(" -> "), F.col("p_size").cast("string")))
    prompt = responses.values_prompt(F.col("a.attribute_name"), F.col("p_type"), F.lit(names.DEFAULT_LOGIC), item, instructions, example)
    return rows.select("p_partkey", "a.attribute", F.md5(prompt).alias("prompt_hash"))


@query("k4_batches", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
b AS (SELECT (i - 1) // 20 + 1 AS batch_no, string_agg('[' || i || '] 담보명: ' || p_name || ' / 세부담보템플릿명: ' || p_brand, chr(10) ORDER BY i) AS items FROM n GROUP BY 1)
SELECT attribute, CAST(batch_no AS BIGINT) AS batch_no, (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) FROM part) AS batch_total, md5(items) AS items_hash
FROM b CROSS JOIN (VALUES %s) v(attribute)""" % ", ".join(f"('{k}')" for k, _, _ in names.ATTRIBUTES))
def k4_batches(spark, d):
    """One prompt per attribute and batch of 20 items; the hash is that of its item list."""
    config = responses.attributes(spark).select(
        "attribute", "attribute_name", F.lit("tables").alias("context"), F.lit(names.DEFAULT_LOGIC).alias("logic")
    )
    prompts = responses.batch_prompts(table(spark, d, "part"), config, "p_name", "p_brand", "p_partkey")
    listed = F.split_part(F.split_part("prompt", F.lit("\nItems:\n"), F.lit(2)), F.lit("\nAnswer with a JSON array"), F.lit(1))
    return prompts.select("attribute", "batch_no", "batch_total", F.md5(listed).alias("items_hash"))


@query("k4_rules", f"""SELECT s_suppkey, md5('Role: insurance terms analyst.' || chr(10) || 'Goal: from the reference group (g' || s_suppkey || ') derive the rules that lead to ''{names.ATTRIBUTES[1][1]}''.' || chr(10)
  || CASE WHEN s_nationkey % 2 = 0 THEN 'Instructions:' || chr(10) || 'Nation ' || s_nationkey || chr(10) ELSE '' END || 'Mapping tables:' || chr(10) || s_name || chr(10)
  || 'Answer with one JSON object: attribute, appendix_refs[], context_clues[], rules[{{template_pattern, code, kcd_range, exclusions[], note}}]; leave rules empty when there are none.') AS prompt_hash FROM supplier""")
def k4_rules(spark, d):
    """One whole rules prompt per reference group."""
    group = F.concat(F.lit("g"), F.col("s_suppkey").cast("string"))
    instructions = F.when(F.col("s_nationkey") % 2 == 0, F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")))
    prompt = responses.rules_prompt(F.lit(names.ATTRIBUTES[1][1]), group, F.col("s_name"), instructions)
    return table(spark, d, "supplier").select("s_suppkey", F.md5(prompt).alias("prompt_hash"))


@query("u5", """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS l FROM documents)
SELECT doc_id, md5(coalesce(string_agg('=== [Logic from g' || CAST(n AS VARCHAR) || '] ===' || chr(10) || l, chr(10) || chr(10) ORDER BY n) FILTER (l <> ''), '추출된 로직 없음. 표준 보험/의료 지식 활용.')) AS logic_hash
FROM (SELECT doc_id, n, CASE WHEN length(l) % 5 = 0 THEN '' ELSE l END AS l FROM l) GROUP BY 1""")
def u5(spark, d):
    """Rule texts of the groups of a run under headers; the default text when none says anything."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = lines.select(
        "doc_id", (F.col("i") + 1).alias("n"), F.concat(F.lit("g"), (F.col("i") + 1).cast("string")).alias("grp"),
        F.when(F.length("line") % 5 == 0, "").otherwise(F.col("line")).alias("raw"),
    )
    return responses.merge_rules(rows, ["doc_id"], "n", "grp", "raw").select("doc_id", F.md5("logic").alias("logic_hash"))


# --- vote: the primary model answers per order, the secondary per customer

PRIMARY_SQL = """p AS (SELECT o_orderkey, 'B' || (o_custkey % 400) AS benefit_name, o_orderstatus AS template_name, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'C ' || (o_orderkey % 3) END AS inferred_code,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' WHEN '3-MEDIUM' THEN 'low' WHEN '5-LOW' THEN 'odd' END AS confidence, 'appendix' AS source, CAST(o_orderkey % 50 AS VARCHAR) AS ref_page, 'primary' AS ref_sentence FROM orders),
s AS (SELECT c_custkey AS pos, ' B' || (c_custkey % 300) || ' ' AS benefit_name, CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS template_name, CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'c' || (c_custkey % 2) END AS inferred_code,
  CASE c_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'odd' END AS confidence, 'policy_text' AS source, '7' AS ref_page, 'secondary' AS ref_sentence FROM customer),
sl AS (SELECT trim(benefit_name) AS benefit_name, template_name, arg_max(inferred_code, pos) AS s_code, arg_max(confidence, pos) AS s_conf FROM s GROUP BY 1, 2),
j AS (SELECT p.*, coalesce(s_code, '') AS s_code, coalesce(s_conf, 'low') AS s_conf, s_code IS NOT NULL AS hit FROM p LEFT JOIN sl USING (benefit_name, template_name)),
sc AS (SELECT *, lower(replace(inferred_code, ' ', '')) = lower(replace(s_code, ' ', '')) AS agreement,
  CASE coalesce(confidence, 'low') WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS ps,
  CASE s_conf WHEN 'high' THEN 0.95::DOUBLE WHEN 'medium' THEN 0.7::DOUBLE WHEN 'low' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END AS ss FROM j),
v AS (SELECT *, CASE WHEN agreement THEN least(ps * 0.5::DOUBLE + ss * 0.5::DOUBLE + 0.15::DOUBLE, 1.0::DOUBLE) ELSE greatest(ps, ss) * 0.7::DOUBLE END AS raw_score, agreement OR ps >= ss AS lead FROM sc)"""


def model_answers(spark, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    pr = F.col("o_orderpriority")
    primary = table(spark, d, "orders").select(
        k, F.concat(F.lit("B"), (F.col("o_custkey") % 400).cast("string")).alias("benefit_name"), F.col("o_orderstatus").alias("template_name"),
        F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("C "), (k % 3).cast("string"))).alias("inferred_code"),
        F.when(pr == "1-URGENT", "high").when(pr == "2-HIGH", "medium").when(pr == "3-MEDIUM", "low").when(pr == "5-LOW", "odd").alias("confidence"),
        F.lit("appendix").alias("source"), (k % 50).cast("string").alias("ref_page"), F.lit("primary").alias("ref_sentence"),
    )
    secondary = table(spark, d, "customer").select(
        c.alias("pos"), F.concat(F.lit(" B"), (c % 300).cast("string"), F.lit(" ")).alias("benefit_name"),
        F.when(c % 3 == 0, "F").when(c % 3 == 1, "O").otherwise("P").alias("template_name"),
        F.when(c % 8 == 0, "").otherwise(F.concat(F.lit("c"), (c % 2).cast("string"))).alias("inferred_code"),
        F.when(c % 4 == 0, "high").when(c % 4 == 1, "medium").when(c % 4 == 2, "low").otherwise("odd").alias("confidence"),
        F.lit("policy_text").alias("source"), F.lit("7").alias("ref_page"), F.lit("secondary").alias("ref_sentence"),
    )
    return primary, secondary


def voted(spark, d) -> DataFrame:
    primary, secondary = model_answers(spark, d)
    return vote.vote_batch(primary, secondary, ["benefit_name", "template_name"], "pos")


@query("e1", f"""WITH {PRIMARY_SQL} SELECT DISTINCT CASE WHEN agreement THEN coalesce(nullif(inferred_code, ''), s_code) WHEN lead THEN inferred_code ELSE s_code END AS final_code,
  round(raw_score, 3) AS score, CASE WHEN raw_score >= 0.85::DOUBLE THEN 'high' WHEN raw_score >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS label, agreement FROM v""")
def e1(spark, d):
    """The distinct decisions of the vote."""
    return voted(spark, d).select("final_code", "score", "label", "agreement").distinct()


@query("e2", f"""WITH {PRIMARY_SQL} SELECT o_orderkey, benefit_name, template_name, CASE WHEN agreement THEN coalesce(nullif(inferred_code, ''), s_code) WHEN lead THEN inferred_code ELSE s_code END AS final_code,
  round(raw_score, 3) AS score, CASE WHEN raw_score >= 0.85::DOUBLE THEN 'high' WHEN raw_score >= 0.6::DOUBLE THEN 'medium' ELSE 'low' END AS label, agreement,
  CASE WHEN lead THEN 'appendix' ELSE CASE WHEN hit THEN 'policy_text' ELSE '' END END AS source, CASE WHEN lead THEN ref_page ELSE CASE WHEN hit THEN '7' ELSE '' END END AS ref_page,
  CASE WHEN lead THEN 'primary' ELSE CASE WHEN hit THEN 'secondary' ELSE '' END END AS ref_sentence, 'ensemble' AS provider FROM v""")
def e2(spark, d):
    """One decision per primary answer."""
    return voted(spark, d)


@query("j12", f"WITH {PRIMARY_SQL} SELECT benefit_name, template_name, count(*) AS n, count(*) FILTER (hit) AS n_hit FROM j GROUP BY 1, 2")
def j12(spark, d):
    """Primary answers with and without a secondary one; the last secondary row of a pair counts."""
    primary, secondary = model_answers(spark, d)
    joined = vote.with_secondary(primary.drop("pos"), secondary, ["benefit_name", "template_name"], "pos", ["pos"])
    return joined.groupBy("benefit_name", "template_name").agg(F.count("*").alias("n"), F.count("__s.pos").alias("n_hit"))


# --- gate and review

RESULTS_SQL = """r AS (SELECT o_orderkey AS id, 'P' || (o_custkey % 10) AS product_code, 'V' || o_orderstatus AS diagnosis_code, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 101) / 100.0::DOUBLE END AS confidence FROM orders),
g AS (SELECT *, CASE WHEN coalesce(confidence, 0) >= 0.95::DOUBLE THEN 'auto_confirmed' ELSE 'review_needed' END AS verification_status FROM r)"""


def results(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"), F.concat(F.lit("P"), (F.col("o_custkey") % 10).cast("string")).alias("product_code"),
        F.concat(F.lit("V"), "o_orderstatus").alias("diagnosis_code"), F.when(k % 13 != 0, (k % 101) / F.lit(100.0)).alias("confidence"),
    )


@query("v1", f"WITH {RESULTS_SQL} SELECT *, 'confidence=' || printf('%.3f', coalesce(confidence, 0.0)) || ', status=' || verification_status AS audit_details FROM g")
def v1(spark, d):
    """Confidence gate with audit text."""
    return review.gate(results(spark, d))


@query("v1_queue", f"WITH {RESULTS_SQL} SELECT id AS result_id, 'pending' AS status FROM g WHERE verification_status = 'review_needed'")
def v1_queue(spark, d):
    """Pending queue rows of the results below the limit."""
    return review.new_queue(review.gate(results(spark, d))).drop("id")


@query("a11", f"WITH {RESULTS_SQL} SELECT count(*) FILTER (verification_status = 'auto_confirmed') AS auto_confirmed, count(*) FILTER (verification_status = 'review_needed') AS review_needed FROM g")
def a11(spark, d):
    """Gate counts."""
    return review.gate_counts(review.gate(results(spark, d)))


QUEUE_SQL = f"""{RESULTS_SQL}, q AS (SELECT id, id AS result_id, CASE WHEN id % 9 = 0 THEN 'approved' ELSE 'pending' END AS status FROM g WHERE verification_status = 'review_needed'),
dec AS (SELECT c_custkey AS pos, c_custkey * 7 % 1601 AS review_id, CASE c_custkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'hold' ELSE 'approve' END AS action, c_name AS reviewer, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS comment,
  CASE WHEN c_custkey % 3 = 0 THEN 'K' || (c_custkey % 10) ELSE '' END AS corrected_code FROM customer),
fi AS (SELECT review_id, min(pos) AS fp FROM dec WHERE action <> 'hold' GROUP BY 1),
chk AS (SELECT dec.*, CASE WHEN q.id IS NULL THEN 'Review not found' WHEN q.status <> 'pending' THEN 'not pending' WHEN fp IS NOT NULL AND pos > fp THEN 'not pending' WHEN action = 'hold' THEN 'unknown action' ELSE '' END AS error
  FROM dec LEFT JOIN q ON q.id = review_id LEFT JOIN fi USING (review_id)),
good AS (SELECT * FROM chk WHERE error = ''),
qa AS (SELECT q.id, q.result_id, CASE WHEN action = 'approve' THEN 'approved' WHEN action = 'reject' THEN 'rejected' ELSE q.status END AS status, reviewer, comment AS review_comment,
  CASE WHEN action = 'approve' THEN nullif(corrected_code, '') END AS corrected_code, action FROM q LEFT JOIN good ON review_id = q.id)"""


def queue(spark, d) -> DataFrame:
    rows = review.gate(results(spark, d)).filter(F.col("verification_status") == "review_needed")
    return rows.select("id", F.col("id").alias("result_id"), F.when(F.col("id") % 9 == 0, "approved").otherwise("pending").alias("status"))


def decisions(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("pos"), (k * 7 % 1601).alias("review_id"), F.when(k % 5 == 0, "reject").when(k % 5 == 1, "hold").otherwise("approve").alias("action"),
        F.col("c_name").alias("reviewer"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("comment"),
        F.when(k % 3 == 0, F.concat(F.lit("K"), (k % 10).cast("string"))).otherwise("").alias("corrected_code"),
        F.timestamp_seconds(k).alias("decided_at"),
    )


def good_decisions(spark, d) -> DataFrame:
    return review.check_decisions(decisions(spark, d), queue(spark, d)).filter("error = ''")


@query("v4", f"WITH {QUEUE_SQL} SELECT pos, review_id, action, error FROM chk")
def v4(spark, d):
    """Preconditions of each decision."""
    return review.check_decisions(decisions(spark, d), queue(spark, d)).select("pos", "review_id", "action", "error")


@query("v2", f"WITH {QUEUE_SQL} SELECT g.id, product_code, coalesce(qa.corrected_code, diagnosis_code) AS diagnosis_code, CASE WHEN qa.status IN ('approved', 'rejected') THEN qa.status ELSE g.verification_status END AS verification_status FROM g LEFT JOIN qa ON qa.result_id = g.id")
def v2(spark, d):
    """Results after the decisions: approvals take the corrected code."""
    after = review.decided_queue(queue(spark, d), good_decisions(spark, d))
    out = review.apply_to_results(review.gate(results(spark, d)), after)
    return out.select("id", "product_code", "diagnosis_code", "verification_status")


@query("v3", f"WITH {QUEUE_SQL} SELECT id, result_id, status, reviewer, review_comment, corrected_code FROM qa")
def v3(spark, d):
    """Queue after the decisions, rejections included."""
    return review.decided_queue(queue(spark, d), good_decisions(spark, d)).drop("reviewed_at")


@query("v3_audit", f"""WITH {QUEUE_SQL} SELECT 'review' AS event_type, 'result' AS entity_type, review_id AS entity_id, reviewer AS actor, CASE WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END AS action,
  CASE WHEN action = 'approve' THEN 'corrected=' || corrected_code || ', comment=' || coalesce(comment, 'None') ELSE 'reason=' || coalesce(comment, 'None') END AS details FROM good""")
def v3_audit(spark, d):
    """Audit rows of the decisions."""
    return review.decision_audit(good_decisions(spark, d), queue(spark, d))


@query("a9", f"WITH {QUEUE_SQL} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) AS total FROM qa")
def a9(spark, d):
    """Status counts of the queue."""
    return review.status_counts(review.decided_queue(queue(spark, d), good_decisions(spark, d)))


@query("a10", f"WITH {QUEUE_SQL} SELECT (SELECT count(*) FROM part) AS policies, (SELECT count(*) FROM g) AS extractions, (SELECT count(*) FROM q WHERE status = 'pending') AS pending_reviews")
def a10(spark, d):
    """System counts."""
    policies = table(spark, d, "part").agg(F.count("*").alias("policies"))
    extractions = results(spark, d).agg(F.count("*").alias("extractions"))
    pending = queue(spark, d).agg(F.count_if(F.col("status") == "pending").alias("pending_reviews"))
    return policies.withColumns({"extractions": extractions.scalar(), "pending_reviews": pending.scalar()})


@query("a12", "SELECT CAST(p AS VARCHAR) AS product_code, round(coalesce(avg(c), 0), 1) AS overall FROM (SELECT 'P' || (o_custkey % 10) AS p, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 101) * 1.0::DOUBLE END AS c FROM orders) GROUP BY 1")
def a12(spark, d):
    """Mean confidence per product on the percent scale, one decimal."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.concat(F.lit("P"), (F.col("o_custkey") % 10).cast("string")).alias("product_code"), F.when(k % 13 != 0, (k % 101).cast("double")).alias("c"))
    return rows.groupBy("product_code").agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 1).alias("overall"))


@query("j18", f"WITH {QUEUE_SQL} SELECT q.result_id, q.id, q.status, product_code, diagnosis_code, confidence FROM q LEFT JOIN g ON g.id = q.result_id WHERE q.status = 'pending'")
def j18(spark, d):
    """Pending queue rows with their result columns."""
    return lookups.queue_with_results(queue(spark, d), results(spark, d), ["product_code", "diagnosis_code", "confidence"])


@query("p2", f"WITH {RESULTS_SQL} SELECT id, product_code, verification_status FROM g WHERE product_code = 'P3' AND verification_status = 'review_needed'")
def p2(spark, d):
    """Only the filters that are set apply."""
    rows = review.gate(results(spark, d))
    out = paging.filter_present(rows, {"product_code": "P3", "diagnosis_code": "", "verification_status": "review_needed"})
    return out.select("id", "product_code", "verification_status")


@query("p3", f"WITH {RESULTS_SQL} SELECT id, verification_status FROM g WHERE verification_status = 'auto_confirmed' AND id % 3 <> 0")
def p3(spark, d):
    """Confirmed and not exported."""
    rows = review.gate(results(spark, d)).withColumn("is_exported", F.when(F.col("id") % 3 == 0, True).when(F.col("id") % 3 == 1, False))
    return project.confirmed(rows).select("id", "verification_status")
