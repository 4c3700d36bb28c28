"""Streams over small folders, in several runs."""

import hashlib

from pyspark.sql import functions as F

from policyflow import names
from policyflow.streaming import monitor


def write(folder, name, rows, side=None):
    path = folder / name
    lines = [",".join(names.EXPORT_COLUMNS)]
    for product, benefit, code in rows:
        cells = {"product_code": product, "benefit_code": benefit, "benefit_name": "n", "sub_benefit_code": "s", "diagnosis_code": code}
        lines.append(",".join(cells.get(c, "") for c in names.EXPORT_COLUMNS))
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    if side:
        digest = hashlib.sha256(path.read_bytes()).hexdigest() if side == "good" else "0" * 64
        (folder / f"{name}.sha256").write_text(digest + "\n")


def run(spark, tmp_path):
    paths = [str(tmp_path / p) for p in ("in", "master", "out", "check")]
    monitor.monitor(spark, *paths).awaitTermination()


def test_monitor(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()
    write(incoming, "a.csv", [("P1", "B1", "x"), ("P1", "B2", "y")], "good")
    write(incoming, "b.csv", [("", "B3", "z")])
    write(incoming, "c.csv", [("P1", "B4", "z")], "bad")
    # columns in another order, with a byte order mark, quotes and a column more
    text = '\ufeffbenefit_name,confidence,extra,template_name,verification_status,diagnosis_code,sub_benefit_code,benefit_code,product_code\r\n'
    (incoming / "f.csv").write_text(text + '"n, ""x""",1,e,t,v,"q,1",s,B6,P1\r\n\r\n', encoding="utf-8", newline="")
    (incoming / "g.csv").write_text("product_code,benefit_name\nP1,n\n", encoding="utf-8")
    run(spark, tmp_path)
    write(incoming, "d.csv", [("P1", "B2", "changed"), ("P1", "B1", " x "), ("P1", "B5", "new")])
    run(spark, tmp_path)
    run(spark, tmp_path)  # nothing new
    schema = ", ".join(f"{c} string" for c in names.EXPORT_COLUMNS)
    now = monitor.master_view(spark, str(tmp_path / "master"), schema)
    assert sorted((r["benefit_code"], r["diagnosis_code"]) for r in now.collect()) == [("B1", "x"), ("B2", "changed"), ("B5", "new"), ("B6", "q,1")]
    monitor.compact(spark, str(tmp_path / "master"), 0)
    write(incoming, "e.csv", [("P1", "B5", "newer")])
    run(spark, tmp_path)
    again = monitor.master_view(spark, str(tmp_path / "master"), schema)
    assert sorted((r["benefit_code"], r["diagnosis_code"]) for r in again.collect()) == [("B1", "x"), ("B2", "changed"), ("B5", "newer"), ("B6", "q,1")]
    acks = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out" / "acks")).collect())
    assert acks == ["ACK|a.csv|OK", "ACK|b.csv|FAILED", "ACK|c.csv|FAILED", "ACK|d.csv|OK", "ACK|e.csv|OK", "ACK|f.csv|OK", "ACK|g.csv|FAILED"]
    messages = {r["message"] for r in spark.read.json(str(tmp_path / "out" / "errors")).collect()}
    assert "Row 1: product_code 누락" in messages and "누락 컬럼: template_name, diagnosis_code, confidence, verification_status" in messages
    audit = [r["details"] for r in spark.read.json(str(tmp_path / "out" / "audit")).orderBy("entity_id").collect()]
    assert audit == [
        '{"inserted":3,"updated":0,"skipped":0,"errors":0}', '{"inserted":1,"updated":1,"skipped":1,"errors":0}',
        '{"inserted":0,"updated":1,"skipped":0,"errors":0}',
    ]


def test_own_export_comes_back(spark, tmp_path):
    """Quotes, blanks, separators and line breaks written by the export and read by the monitor, over compacted batches."""
    from policyflow.sources import sinks

    incoming = str(tmp_path / "in")
    cells = ['say "hi", ok', " pad ", "two\nlines", "a,b", "back\\slash", 'end"', "x\r\ny"]
    paths = [str(tmp_path / p) for p in ("in", "master", "out", "check")]
    for n, cell in enumerate(cells):
        rows = [(f"P{k}", f"B{n}", "s", cell, "approved", False) for k in range(2)]
        frame = spark.createDataFrame(rows, "product_code string, benefit_code string, sub_benefit_code string, benefit_name string, verification_status string, is_exported boolean")
        sinks.write_csv(sinks.export_rows(frame).withColumn("product", F.col("product_code")), incoming, "product", mode="append")
        monitor.monitor(spark, *paths, compact_every=3).awaitTermination()
    schema = ", ".join(f"{c} string" for c in names.EXPORT_COLUMNS)
    now = monitor.master_view(spark, paths[1], schema).collect()
    assert sorted((r["product_code"], r["benefit_code"], r["benefit_name"]) for r in now) == sorted((f"P{k}", f"B{n}", c) for k in range(2) for n, c in enumerate(cells))
    assert monitor._numbers(spark, paths[1] + "/base", "upto") == [2, 5]
    acks = [r["value"] for r in spark.read.text(paths[2] + "/acks").collect()]
    assert len(acks) == len(set(acks)) and all(a.endswith("|OK") for a in acks)


def test_first_decisions_close_over_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / p) for p in ("src", "out", "check"))
    schema = "pos long, review_id long, action string, reviewer string"
    queue = spark.createDataFrame([(1, "pending"), (2, "pending"), (3, "approved")], "id long, status string")

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        monitor.first_decision_stream(stream, queue, out, check).awaitTermination()

    deliver([(0, 1, "approve", "kim"), (1, 1, "reject", "lee"), (2, 3, "approve", "kim")])
    deliver([(3, 1, "reject", "lee"), (4, 2, "reject", "lee")])
    closed = spark.read.parquet(f"{out}/closed").collect()
    assert sorted((r["review_id"], r["pos"], r["action"]) for r in closed) == [(1, 0, "approve"), (2, 4, "reject")]


def test_counts_follow_new_files(spark, tmp_path):
    source, out, check = (str(tmp_path / p) for p in ("src", "out", "check"))
    from pyspark.sql import functions as F

    for states in (["a", "b"], ["a"]):
        spark.createDataFrame([(s,) for s in states], "status string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("status string").parquet(source)
        monitor.count_stream(stream, F.col("status"), out, check).awaitTermination()
    got = {r["status"]: r["n"] for r in monitor.current_counts(spark, out).collect()}
    assert got == {"a": 2, "b": 1}


def _folders(spark, *paths):
    return sum(len(monitor._numbers(spark, p, n)) for p, n in paths)


def test_monitor_forgets_what_a_snapshot_holds(spark, tmp_path):
    """Batches far on find as few folders as early ones, and the master stays what it is."""
    incoming, target, out = (str(tmp_path / p) for p in ("in", "master", "out"))
    (tmp_path / "in").mkdir()
    counts = []
    schema = ", ".join(f"{c} string" for c in names.EXPORT_COLUMNS)
    for step, batch in enumerate([*range(3), *range(10_000, 10_003)]):
        write(tmp_path / "in", f"{step}.csv", [("P1", f"B{step % 4}", f"v{step}")])
        files = spark.createDataFrame([(f"file:{incoming}/{step}.csv",)], "path string")
        monitor.receive_batch(spark, files, batch, incoming, target, out, compact_every=2)
        counts.append(_folders(spark, (f"{target}/changes", "batch"), (f"{target}/base", "upto"), (f"{out}/received", "batch"), (f"{out}/staged", "batch")))
        if batch in (1, 10_001):  # a batch may run again after it has been compacted
            monitor.receive_batch(spark, files, batch, incoming, target, out, compact_every=2)
    assert max(counts) <= 6  # two snapshots, the changes since the older one
    now = monitor.master_view(spark, target, schema).collect()
    assert sorted((r["benefit_code"], r["diagnosis_code"]) for r in now) == [("B0", "v4"), ("B1", "v5"), ("B2", "v2"), ("B3", "v3")]


def test_counts_keep_two_runs(spark, tmp_path):
    source, out, check = (str(tmp_path / p) for p in ("src", "out", "check"))
    for step in range(5):
        spark.createDataFrame([("a",)], "status string").write.mode("append").parquet(source)
        monitor.count_stream(spark.readStream.schema("status string").parquet(source), F.col("status"), out, check).awaitTermination()
        assert _folders(spark, (out, "run")) <= 2
    assert monitor.current_counts(spark, out).first()["n"] == 5


def test_a_crowded_review_has_one_decision(spark, tmp_path):
    source, out, check = (str(tmp_path / p) for p in ("src", "out", "check"))
    schema = "pos long, review_id long, action string, amount long, at timestamp"
    queue = spark.createDataFrame([(1, "pending"), (2, "pending")], "id long, status string")
    rows = [(p, 1 if p % 50 else 2, "approve" if p % 3 else "hold", None, None) for p in range(2000, 0, -1)] + [(9, None, "approve", 1, None)]
    for part in (rows, rows[:10]):
        spark.createDataFrame(part, schema).repartition(4).write.mode("append").parquet(source)
        monitor.first_decision_stream(spark.readStream.schema(schema).parquet(source), queue, out, check).awaitTermination()
    closed = spark.read.parquet(f"{out}/closed")
    assert closed.columns == ["pos", "review_id", "action", "amount", "at"]
    assert sorted(tuple(r) for r in closed.collect()) == [(1, 1, "approve", None, None), (50, 2, "approve", None, None)]


def test_late_rows_are_accounted_for(spark, tmp_path):
    import datetime as dt
    import random

    from policyflow.streaming import events

    base, rnd = dt.datetime(2024, 1, 1), random.Random(3)
    minutes = list(range(600))
    order = sorted(minutes, key=lambda m: m + (rnd.random() < 0.1) * 200 + rnd.randrange(30))
    batches = [order[k : k + 150] for k in range(0, 600, 150)]
    source, path, check, done, check2 = (str(tmp_path / p) for p in ("src", "split", "check", "windows", "check2"))
    newest, late = None, set()
    for part in [*batches, [10_000]]:
        late |= {m for m in part if newest is not None and m < newest - 60}
        newest = max([*part, *([newest] if newest is not None else [])])
        rows = [(m, base + dt.timedelta(minutes=m), "hot" if m % 5 else "b") for m in part] + ([(-1, None, "hot")] if part is batches[0] else [])
        spark.createDataFrame(rows, "id long, t timestamp, k string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long, t timestamp, k string").parquet(source)
        events.intake(stream, "t", 3600, path, check).awaitTermination()
    assert late and {r["id"] for r in spark.read.parquet(f"{path}/late").collect()} == late | {-1}
    ontime = spark.readStream.schema("id long, t timestamp, k string").parquet(f"{path}/ontime/batch=*")
    query = events.window_stream(ontime, "t", ["k"], 3600, 3600, {"n": F.count(F.lit(1))}, done, check2)
    query.awaitTermination()
    dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    assert dropped == 0
    want = {}
    for m in minutes:
        if m not in late:
            key = base + dt.timedelta(hours=m // 60), "hot" if m % 5 else "b"
            want[key] = want.get(key, 0) + 1
    assert {(r["window_start"], r["k"]): r["n"] for r in spark.read.parquet(done).collect()} == want


def test_running_status_expires(spark, tmp_path):
    import datetime as dt

    from policyflow.streaming import events

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    source, path, check = (str(tmp_path / p) for p in ("src", "out", "check"))
    schema = "k string, s string, t timestamp, n long"
    for part in ([("a", "new", at(0), 1), ("a", "new", at(1), 2), ("a", "open", at(1), 3), (None, "x", at(1), 4), ("b", "new", at(2), 5)], [("b", "open", at(200), 6)], [("c", "new", at(500), 7)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        events.status_stream(stream, F.col("k"), F.col("s"), "t", "n", 3600, 0, path, check).awaitTermination()
    got = sorted((r["key"], r["status"], r["before"], r["held_seconds"], r["expired"]) for r in spark.read.parquet(path).fillna("-", ["before"]).fillna(-1.0).collect())
    assert ("a", "open", "new", 60.0, False) in got and ("a", "new", "-", -1.0, False) in got
    assert ("a", "open", "open", 0.0, True) in got and len([g for g in got if g[0] == "a"]) == 3


def test_repeated_rows_come_once(spark, tmp_path):
    import datetime as dt

    from policyflow.streaming import events

    source, path, check = (str(tmp_path / p) for p in ("src", "out", "check"))
    rows = [(i % 20, dt.datetime(2024, 1, 1, 0, i % 20), "x") for i in range(300)] + [(None, dt.datetime(2024, 1, 1), "null")] * 3
    for part in (rows, rows[:50]):
        spark.createDataFrame(part, "id long, t timestamp, v string").repartition(3).write.mode("append").parquet(source)
        events.distinct_stream(spark.readStream.schema("id long, t timestamp, v string").parquet(source), "t", ["id"], 3600, path, check).awaitTermination()
    assert sorted(str(r["id"]) for r in spark.read.parquet(path).collect()) == sorted(map(str, [*range(20), None]))
