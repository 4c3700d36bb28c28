"""Joins and groups along time, ranks with ties, moving frames, grouping sets and intersection on the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..operators import ranked, timed
from .registry import query, table

CENTS_SQL = "CAST(round(value * 100) AS BIGINT)"



def cents() -> Column:
    return F.round(F.col("value") * 100).cast("long")


@query("asof", """
WITH c AS (SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT p.event_id, p.user_id, p.ts, CASE WHEN epoch_us(p.ts) - epoch_us(c.ts) <= 43200 * 1000000::BIGINT THEN c.click_id END AS click_id
FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof(spark, d):
    """Each purchase with the newest click of its user in the 12 hours before."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    buys, clicks = (events.filter(F.col("event_type") == kind).drop("event_type") for kind in ("purchase", "click"))
    return timed.asof_join(buys, clicks, [("user_id", "user_id")], "ts", "ts", "event_id", {"event_id": "click_id"}, 12 * 3600)


@query("asof_orders", """
WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS earlier_key FROM orders GROUP BY ALL),
p AS (SELECT *, arg_max(o_totalprice, o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS earlier_price FROM orders)
SELECT s.l_orderkey, s.l_linenumber, s.o_custkey, o.earlier_key, q.o_totalprice AS earlier_price
FROM (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) s
ASOF LEFT JOIN o ON s.o_custkey = o.o_custkey AND s.l_shipdate >= o.o_orderdate LEFT JOIN orders q ON q.o_orderkey = o.earlier_key""")
def asof_orders(spark, d):
    """Each shipped line with the newest order of its customer by then, however old."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    shipped = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    out = timed.asof_join(shipped, orders, [("o_custkey", "o_custkey")], "l_shipdate", "o_orderdate", "o_orderkey", {"o_orderkey": "earlier_key", "o_totalprice": "earlier_price"})
    return out.drop("l_shipdate")


SPANS_SQL = "spans AS (SELECT o_orderkey, o_custkey, o_orderdate AS opened, max(l_shipdate) AS closed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


@query("overlap", f"""WITH {SPANS_SQL}
SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other_key, (epoch_us(least(a.closed, b.closed)) - epoch_us(greatest(a.opened, b.opened))) / 1000000 AS overlap_seconds
FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.opened <= b.closed AND b.opened <= a.closed AND a.opened <= a.closed AND b.opened <= b.closed""")
def overlap(spark, d):
    """Pairs of orders of one customer that were open (from the order to the last shipment) at the same time."""
    closed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closed"))
    spans = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("opened")).join(closed, "o_orderkey")
    pairs = timed.overlap_join(spans, spans, [("o_custkey", "o_custkey")], ("opened", "closed"), ("opened", "closed"), {"o_orderkey": "other_key"})
    return pairs.filter("o_orderkey < other_key").drop("opened", "closed")


SESSIONS_SQL = f"""
m AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 1800 * 1000000::BIGINT, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM m)"""


@query("sessions", f"""WITH {SESSIONS_SQL}
SELECT user_id, session_no, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_rows, sum({CENTS_SQL})::BIGINT AS cents, count(*) FILTER (event_type = 'purchase') AS purchases FROM s GROUP BY ALL""")
def sessions(spark, d):
    """Runs of events of a user with gaps under 30 minutes."""
    sums = {"cents": F.sum(cents()), "purchases": F.count_if(F.col("event_type") == "purchase")}
    return timed.sessions(table(spark, d, "events"), ["user_id"], "ts", "event_id", 1800, sums)


@query("session_rows", f"WITH {SESSIONS_SQL} SELECT event_id, user_id, session_no FROM s")
def session_rows(spark, d):
    """Every event with the number of its session."""
    return timed.with_sessions(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", "event_id", 1800).drop("ts")


@query("ranks", """
SELECT l_returnflag, l_quantity, line, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist,
  ntile(7) OVER (PARTITION BY l_returnflag ORDER BY l_quantity, line) AS ntile
FROM (SELECT l_returnflag, l_quantity, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS line FROM lineitem) WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)""")
def ranks(spark, d):
    """Lines of a return flag by quantity, of which there are few values with many rows each."""
    line = F.expr("l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey")
    return ranked.ranks(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", line.alias("line")), ["l_returnflag"], "l_quantity", "line", 7)


def _moving() -> dict:
    return {"cents": F.sum(cents()), "least": F.min("value"), "most": F.max("value"), "n": F.count(F.lit(1))}


MOVING_SQL = f"event_id, user_id, sum({CENTS_SQL}) OVER w::BIGINT AS cents, min(value) OVER w AS least, max(value) OVER w AS most, count(*) OVER w AS n"


@query("moving_rows", f"SELECT {MOVING_SQL} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING)")
def moving_rows(spark, d):
    """Sum, least, most and number of the last 100 events of each user."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return ranked.moving_rows(events, ["user_id"], ["ts", "event_id"], 100, _moving()).drop("ts", "value")


@query("moving_time", f"SELECT {MOVING_SQL} FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)")
def moving_time(spark, d):
    """The same over the last seven days."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return ranked.moving_time(events, ["user_id"], "ts", 7 * 86_400, _moving()).drop("ts", "value")


CUBE_SQL = """SELECT l_returnflag, l_linestatus, ship_year, sum(l_quantity)::BIGINT AS quantity, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, grouping(l_returnflag, l_linestatus, ship_year) AS grouping_id
FROM (SELECT *, year(l_shipdate)::INT AS ship_year FROM lineitem) GROUP BY """


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("ship_year"), "l_quantity", "l_suppkey")


COLUMNS = ["l_returnflag", "l_linestatus", "ship_year"]


def _sums() -> dict:
    return {"quantity": F.col("l_quantity").cast("long"), "lines": F.lit(1)}


@query("cube", CUBE_SQL + "CUBE (l_returnflag, l_linestatus, ship_year)")
def cube(spark, d):
    """Quantities, lines and distinct suppliers for every set of three columns."""
    return ranked.cube(_lines(spark, d), COLUMNS, _sums(), {"suppliers": "l_suppkey"})


@query("rollup", CUBE_SQL + "ROLLUP (l_returnflag, l_linestatus, ship_year)")
def rollup(spark, d):
    """The same from the finest groups up to the total."""
    return ranked.cube(_lines(spark, d), COLUMNS, _sums(), {"suppliers": "l_suppkey"}, [COLUMNS[:k] for k in range(3, -1, -1)])


@query("grouping_sets", CUBE_SQL + "GROUPING SETS ((l_returnflag, ship_year), (l_linestatus), ())")
def grouping_sets(spark, d):
    """The same for three chosen sets."""
    return ranked.cube(_lines(spark, d), COLUMNS, _sums(), {"suppliers": "l_suppkey"}, [["l_returnflag", "ship_year"], ["l_linestatus"], []])


INTERSECT_SQL = """SELECT o_custkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders WHERE o_orderstatus = 'F'
INTERSECT {all} SELECT o_custkey, nullif(o_orderpriority, '5-LOW') FROM orders WHERE o_orderstatus <> 'F'"""


def _halves(spark, d):
    orders = table(spark, d, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"), ["o_custkey", "priority"]


@query("intersect", INTERSECT_SQL.format(all=""))
def intersect(spark, d):
    """Customers and priorities with closed and other orders; no priority is a value too."""
    return ranked.intersect(*_halves(spark, d))


@query("intersect_all", INTERSECT_SQL.format(all="ALL"))
def intersect_all(spark, d):
    """The same, as often as both sides have them."""
    return ranked.intersect(*_halves(spark, d), every=True)
