"""States that merge, and the library called from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sql
from ..operators import sketches
from ..session import cut
from .registry import query, table
from .results import RAW_SQL, raw_responses


@query("sketches", """WITH s AS (SELECT * FROM events WHERE day(ts) BETWEEN 5 AND 20)
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_close, true AS medians_close FROM s GROUP BY event_type""")
def merged_sketches(spark, d):
    """Users and quartiles of 16 days, merged from daily states, beside the exact number; close: within three standard errors."""
    events = table(spark, d, "events").select("ts", "event_type", "user_id", "value")
    day, span = F.dayofmonth("ts"), F.col("day").between(5, 20)
    states = cut(sketches.daily_states(events, day, ["event_type"], {"about": "user_id"}, {"medians": "value"}))
    found = sketches.read_states(sketches.merged(states, ["event_type"], ["about"], ["medians"], span), ["about"], {"medians": [0.25, 0.5, 0.75]})
    inside = events.withColumn("day", day).filter(span).join(found.select("event_type", "medians"), "event_type")
    below = [F.avg((F.col("value") <= F.col("medians")[k]).cast("double")).alias(f"below{k}") for k in range(3)]
    exact = inside.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), *below)
    near = [F.abs(F.col(f"below{k}") - (k + 1) / 4) < 0.04 for k in range(3)]
    return found.join(exact, "event_type").select(
        "event_type", "n", "users", (F.abs(F.col("about") - F.col("users")) <= 0.0195 * F.col("users") + 0.5).alias("users_close"), (near[0] & near[1] & near[2]).alias("medians_close"))


@query("table_function", f"""WITH {RAW_SQL}, n AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS n FROM raw)
SELECT event_id, CAST(k AS INT) AS obj_no, event_type AS benefit_name, 'u' || user_id AS template_name, 'C' || (event_id % 100) AS inferred_code, 'high' AS confidence
FROM (SELECT event_id, unnest(range(0, n)) AS k FROM n) JOIN events USING (event_id)""")
def table_function(spark, d):
    """Rows of responses by the table function, called from SQL with a partition for each event."""
    sql.register(spark)
    raw_responses(spark, d).createOrReplaceTempView("pf_responses")
    return spark.sql("""SELECT * FROM pf_response_items(TABLE(pf_responses) PARTITION BY event_id, key => 'event_id', text => 'raw', fields => 'benefit_name,template_name,inferred_code,confidence')""")


@query("sql_functions", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'D' END AS alpha, (c_custkey % 100)::DOUBLE AS number, c_custkey % 2 = 0 AND c_custkey % 100 <= 50 AS inside,
  upper(substr(md5(c_name), 1, 8)) AS short, CASE WHEN c_custkey % 12 = 0 AND c_custkey > 0 THEN (c_custkey // 12) || '년' WHEN c_custkey = 0 THEN '' ELSE NULL END AS years FROM customer""")
def sql_functions(spark, d):
    """Scalar functions in a statement over a table."""
    return sql.run(spark, d, """
        SELECT c_custkey, pf_code_alpha(code) AS alpha, pf_code_number(code) AS number, pf_code_in_range(code, 'C00', 'C50') AS inside, pf_short_code(c_name) AS short,
          CASE WHEN c_custkey % 12 = 0 THEN pf_period_text(CAST(c_custkey DIV 12 * 365 AS INT)) END AS years
        FROM (SELECT *, concat(CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'd' END, CAST(c_custkey % 100 AS STRING)) AS code FROM customer)""")


@query("sql_views", """WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL),
a AS (SELECT p.user_id, CASE WHEN epoch_us(p.ts) - epoch_us(c.ts) <= 43200 * 1000000::BIGINT THEN c.click_id END AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts)
SELECT user_id, count(*) AS purchases, count(click_id) AS after_a_click FROM a GROUP BY user_id""")
def sql_views(spark, d):
    """A statement over the view of a registered query."""
    return sql.run(spark, d, "SELECT user_id, count(*) AS purchases, count(click_id) AS after_a_click FROM pf_asof GROUP BY user_id")
