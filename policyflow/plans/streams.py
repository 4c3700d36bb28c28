"""Streams over files of the driver tables; each run reads all files that are there and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import names
from ..session import scratch
from ..sources import sinks
from ..streaming import events as events_in_time, monitor
from .handoff import EXPORT_SQL, NEW_SQL, ODD_SQL, OLD_SQL, exportable, master, odd_names
from .registry import query, table
from .results import QUEUE_SQL, decisions, queue


def streamed(spark, d, name) -> DataFrame:
    folder = d.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a glob, so that the table may be one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def _handoff(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(c) if c in rows.columns else F.lit("x").alias(c) for c in names.EXPORT_COLUMNS])


_KEYS = ", ".join(names.KEY_FIELDS)


@query("st1", f"WITH {OLD_SQL}, {NEW_SQL} SELECT {_KEYS}, diagnosis_code, coverage_period FROM (SELECT * FROM old UNION ALL SELECT {_KEYS}, {', '.join(f'trim({f}) AS {f}' for f in names.COMPARE_FIELDS)} FROM new ANTI JOIN old USING ({_KEYS})) WHERE true")
def st1(spark, d):
    """Directory monitor: files checked, the valid ones merged; a file with blank product codes is refused.

    The first delivery is the master, the second brings the new keys.
    """
    old, new = master(spark, d)
    incoming, target, out, check = (scratch(spark, n) for n in ("incoming", "master", "received", "check"))
    _handoff(old).write.option("header", True).csv(incoming)
    monitor.monitor(spark, incoming, target, out, check).awaitTermination()
    fresh = new.join(old.select(*names.KEY_FIELDS), names.KEY_FIELDS, "left_anti")
    trimmed = fresh.select(*names.KEY_FIELDS, *[F.trim(f).alias(f) for f in names.COMPARE_FIELDS])
    _handoff(trimmed).write.mode("append").option("header", True).csv(incoming)
    refused = table(spark, d, "customer").select(F.lit(" ").alias("product_code"), F.col("c_name").alias("benefit_code"))
    _handoff(refused).write.mode("append").option("header", True).csv(incoming)
    monitor.monitor(spark, incoming, target, out, check).awaitTermination()
    schema = ", ".join(f"{c} string" for c in names.EXPORT_COLUMNS)
    return monitor.master_view(spark, target, schema).select(*names.KEY_FIELDS, "diagnosis_code", "coverage_period")


@query("st1_quoted", f"SELECT product_code, 'B' || id AS benefit_code, {ODD_SQL} AS benefit_name FROM ({EXPORT_SQL}) WHERE NOT is_exported AND verification_status <> 'review_needed'")
def st1_quoted(spark, d):
    """The library's own export, with quotes, commas, blanks and line breaks in its cells, through its own monitor."""
    incoming, target, out, check = (scratch(spark, n) for n in ("incoming", "master", "received", "check"))
    sinks.write_export(odd_names(exportable(spark, d)), incoming)
    monitor.monitor(spark, incoming, target, out, check).awaitTermination()
    schema = ", ".join(f"{c} string" for c in names.EXPORT_COLUMNS)
    return monitor.master_view(spark, target, schema).select("product_code", "benefit_code", "benefit_name")


@query("st2", "SELECT event_id, event_type, user_id, props FROM events")
def st2(spark, d):
    """Event log appended by a stream."""
    path = scratch(spark, "log")
    events = streamed(spark, d, "events").select("event_id", "event_type", "user_id", "props")
    monitor.append_log(events, path, scratch(spark, "check")).awaitTermination()
    return spark.read.parquet(path)


@query("st3", f"WITH {QUEUE_SQL} SELECT review_id, pos, action, reviewer FROM good")
def st3(spark, d):
    """First applicable decision per review."""
    path = scratch(spark, "decisions")
    source = scratch(spark, "arrivals")
    decisions(spark, d).write.parquet(source)
    arrivals = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    monitor.first_decision_stream(arrivals, queue(spark, d), path, scratch(spark, "check")).awaitTermination()
    return spark.read.parquet(f"{path}/closed").select("review_id", "pos", "action", "reviewer")


@query("st4", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def st4(spark, d):
    """Status counts kept by a stream."""
    path = scratch(spark, "counts")
    monitor.count_stream(streamed(spark, d, "events"), F.col("event_type"), path, scratch(spark, "check")).awaitTermination()
    return monitor.current_counts(spark, path)


#: Deliveries of the events in order, of which some come one or three too late, and how late a row may be.
DELIVERIES, DELAY = 4, 86_400
ARRIVAL = "event_id * 4 DIV (1 + (SELECT max(event_id) FROM events)) + CASE WHEN event_id % 50 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END"
ARRIVED_SQL = f"""
a AS (SELECT *, CAST({ARRIVAL.replace(' DIV ', ' // ')} AS INT) AS delivery FROM events),
m AS (SELECT delivery, max(max(epoch_us(ts))) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a GROUP BY delivery),
r AS (SELECT a.*, coalesce(epoch_us(ts) < newest - {DELAY} * 1000000::BIGINT, false) AS is_late FROM a JOIN m USING (delivery))"""


def _delivered(spark, d) -> str:
    """A folder that the split events are in, after all deliveries; a last row far ahead closes all windows."""
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "user_id", "value")
    last = events.agg(F.max("event_id").alias("last"))
    arrival = F.expr("event_id * 4 DIV (1 + last) + CASE WHEN event_id % 50 = 0 THEN 3 WHEN event_id % 7 = 0 THEN 1 ELSE 0 END")
    placed = events.join(F.broadcast(last)).withColumn("delivery", arrival).drop("last")  # one row
    source, path, check = (scratch(spark, n) for n in ("arrivals", "split", "check"))
    end = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in ("event_type", "user_id", "value")])
    for k in range(DELIVERIES + 4):
        part = placed.filter(F.col("delivery") == k).drop("delivery") if k < DELIVERIES + 3 else end
        part.write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(events.schema).parquet(source)
        events_in_time.intake(arrivals, "ts", DELAY, path, check).awaitTermination()
    return path


def _windows(spark, d, slide: int | None) -> DataFrame:
    path = _delivered(spark, d)
    schema = spark.read.parquet(f"{path}/ontime").drop("batch").schema
    ontime = spark.readStream.schema(schema).parquet(f"{path}/ontime/batch=*")
    counted, check = scratch(spark, "windows"), scratch(spark, "check")
    n = {"n": F.count(F.lit(1))}
    events_in_time.window_stream(ontime, "ts", ["event_type"], 86_400, DELAY, n, counted, check, slide).awaitTermination()
    late = events_in_time.windows(spark.read.parquet(f"{path}/late"), "ts", ["event_type"], 86_400, n, slide).withColumnRenamed("n", "late")
    closed = spark.read.parquet(counted).filter("event_type IS NOT NULL")
    return closed.join(late, ["window_start", "window_end", "event_type"], "full").na.fill(0, ["n", "late"])


@query("st_windows", f"""WITH {ARRIVED_SQL}
SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS window_start, (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS window_end, count(*) FILTER (NOT is_late) AS n, count(*) FILTER (is_late) AS late FROM r GROUP BY ALL""")
def st_windows(spark, d):
    """Events per type and day, as the watermark closes the days, and those that came too late for it."""
    return _windows(spark, d, None)


@query("st_sliding", f"""WITH {ARRIVED_SQL}, s AS (SELECT *, date_trunc('hour', ts) - to_hours((hour(ts) % 6 + 6 * k)::INT) AS window_start FROM r, range(0, 4) t(k))
SELECT event_type, window_start::TIMESTAMP AS window_start, (window_start + INTERVAL 1 DAY)::TIMESTAMP AS window_end, count(*) FILTER (NOT is_late) AS n, count(*) FILTER (is_late) AS late FROM s GROUP BY ALL""")
def st_sliding(spark, d):
    """The same for the day before every sixth hour."""
    return _windows(spark, d, 6 * 3600)


@query("st_late", f"WITH {ARRIVED_SQL} SELECT event_id, ts, make_timestamp(newest - {DELAY} * 1000000::BIGINT) AS missed FROM r JOIN m USING (delivery) WHERE is_late")
def st_late(spark, d):
    """Each late event with the mark that it missed."""
    return spark.read.parquet(f"{_delivered(spark, d)}/late").select("event_id", "ts", "missed")


@query("st_distinct", "SELECT event_id, user_id, event_type FROM events")
def st_distinct(spark, d):
    """Events that come twice, in two deliveries."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    source, path, check = (scratch(spark, n) for n in ("twice", "distinct", "check"))
    for part in (events.unionByName(events.filter("event_id % 3 = 0")), events.filter("event_id % 5 = 0")):
        part.write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(events.schema).parquet(source)
        events_in_time.distinct_stream(arrivals, "ts", ["event_id"], 40 * 86_400, path, check).awaitTermination()
    return spark.read.parquet(path).drop("ts")


@query("st_status", """WITH c AS (SELECT *, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
ch AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM c WHERE before IS NULL OR before <> event_type)
SELECT user_id::VARCHAR AS key, event_type AS status, event_id AS pos, before, (epoch_us(ts) - epoch_us(since)) / 1000000 AS held_seconds FROM ch""")
def st_status(spark, d):
    """Changes of a running status per user, the kind of the last event, in two deliveries."""
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    source, path, check = (scratch(spark, n) for n in ("statuses", "changes", "check"))
    half = F.expr("timestamp'2024-01-15 00:00:00'")
    for part in (events.filter(F.col("ts") < half), events.filter(F.col("ts") >= half)):
        part.write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(events.schema).parquet(source)
        events_in_time.status_stream(arrivals, F.col("user_id"), F.col("event_type"), "ts", "event_id", 60 * 86_400, 0, path, check).awaitTermination()
    return spark.read.parquet(path).filter("NOT expired").select("key", "status", "pos", "before", "held_seconds")
