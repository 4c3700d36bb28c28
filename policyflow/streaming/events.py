"""Streams in event time: windows with late rows accounted for, duplicates, running states.

Late means the same in all of them: a row is late if its time is more than ``delay`` seconds before the newest time of the batches before its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .monitor import _numbers, _remove


def _newest(spark: SparkSession, path: str, before: int):
    """Newest time of the batches before one; only the mark of the last of them is read."""
    marks = [n for n in _numbers(spark, f"{path}/mark", "batch") if n < before]
    return spark.read.parquet(f"{path}/mark/batch={marks[-1]}").first()["newest"] if marks else None


def _timed(rows: DataFrame, time: str) -> DataFrame:
    """The time as an instant; a time without a zone is one of the session's."""
    return rows.withColumn(time, F.col(time).cast("timestamp"))


def intake(stream: DataFrame, time: str, delay: int, path: str, checkpoint: str):
    """Splits what arrives into ``{path}/ontime`` and ``{path}/late`` (with the batch and the mark that it missed, so that each late row is accounted for).

    Rows without a time are late for ever: no window can hold them. A batch that is run again replaces its folders."""

    def split(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        newest = _newest(session, path, batch_id)
        mark = F.lit(newest).cast("timestamp") - F.make_dt_interval(secs=F.lit(delay).cast("decimal(18,6)"))
        late = F.col(time).isNull() | F.coalesce(F.col(time) < mark, F.lit(False))
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/ontime/batch={batch_id}")
        batch.filter(late).withColumn("missed", mark).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        seen = batch.agg(F.greatest(F.max(time), F.lit(newest).cast("timestamp")).alias("newest"))
        seen.write.mode("overwrite").parquet(f"{path}/mark/batch={batch_id}")
        for n in _numbers(session, f"{path}/mark", "batch"):
            if n < batch_id - 1:
                _remove(session, f"{path}/mark/batch={n}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(split).start()


def window_stream(
    stream: DataFrame, time: str, keys: list[str], width: int, delay: int, aggregates: dict[str, Column], path: str, checkpoint: str, slide: int | None = None,
):
    """Rows of each window of ``width`` seconds (every ``slide``) and key, combined, and written once when the watermark has passed the window's end.

    On rows that ``intake`` let through nothing is dropped: they are at most ``delay`` older than what came before. Open windows are in the state store, nothing else is."""
    window = F.window(time, f"{width} seconds", f"{slide or width} seconds")
    counted = _timed(stream, time).withWatermark(time, f"{delay} seconds").groupBy(window.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)
    return out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def windows(df: DataFrame, time: str, keys: list[str], width: int, aggregates: dict[str, Column], slide: int | None = None) -> DataFrame:
    """The same windows of a table."""
    window = F.window(time, f"{width} seconds", f"{slide or width} seconds")
    return _timed(df, time).groupBy(window.alias("window"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def distinct_stream(stream: DataFrame, time: str, keys: list[str], delay: int, path: str, checkpoint: str):
    """The first row of each key: repetitions within ``delay`` seconds are dropped, and a key is forgotten when the watermark has passed it by that. Late rows
    are dropped as well; put ``intake`` before to account for them."""
    out = _timed(stream, time).withWatermark(time, f"{delay} seconds").dropDuplicatesWithinWatermark(keys)
    return out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


CHANGES = "key string, status string, at timestamp, pos long, before string, held_seconds double, expired boolean"


def status_stream(stream: DataFrame, key: Column, status: Column, time: str, pos: str, expire: int, delay: int, path: str, checkpoint: str):
    """A running status per key: one row for each change (CHANGES), in the order of (time, pos) inside a batch; rows are expected in time order over batches.

    A key of which nothing is heard for ``expire`` seconds of event time gets a row with expired = true and leaves the state store, so the store holds active keys only; what comes
    after that starts anew. Rows with a null key, status or time are left out. The state of a key is its status and since when;
    its rows of one batch are sorted in one task, so bound a batch by the source's options (maxFilesPerTrigger)."""
    rows = stream.select(key.cast("string").alias("key"), status.alias("status"), F.col(time).cast("timestamp").alias("at"), F.col(pos).cast("long").alias("pos")).dropna()

    def follow(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, since, last = state.get
            state.remove()
            yield _changes([(group[0], status, pd.Timestamp(last, unit="us"), -1, status, (last - since) / 1e6, True)])
            return
        own = pd.concat(list(parts)).sort_values(["at", "pos"], kind="stable")
        status, since, last = state.get if state.exists else (None, None, None)
        out = []
        for new, at, number in zip(own["status"], own["at"], own["pos"]):
            now = at.value // 1000
            if new != status:
                out.append((group[0], new, at, number, status, None if since is None else (now - since) / 1e6, False))
                status, since = new, now
            last = now
        state.update((status, since, last))
        state.setTimeoutTimestamp(max(last // 1000 + expire * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield _changes(out)

    changes = rows.withWatermark("at", f"{delay} seconds").groupBy("key").applyInPandasWithState(
        follow, CHANGES, "status string, since long, last long", "append", GroupStateTimeout.EventTimeTimeout)
    return changes.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in CHANGES.split(", ")])
