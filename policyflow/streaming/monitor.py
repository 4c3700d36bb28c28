"""Streams: incoming directory, event log, review decisions, status counts.

Every micro-batch writes to a folder that carries its batch number, so a batch that is run again after a failure replaces
its own output. The checkpoint remembers which files were read. Folders go as soon as a snapshot holds what is in them, so a batch finds as many
of them after ten thousand batches as after a hundred. What must be known for ever (closed reviews) is kept by Spark's state store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StringType, StructField, StructType

from .. import names
from ..functions import text as tx
from ..operators import merge, quality, review
from ..operators.ordered import last_row, number_in_order
from ..sources.tables import csv_reader


#: Batches between two snapshots of the master, and buckets of keys that a snapshot is stored in.
COMPACT_EVERY, BUCKETS = 20, 64
# Fixed value: the columns of Spark's binary file source.
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished ``name=<number>`` folders, by a listing of names."""
    if not _exists(spark, folder):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(f.getPath().getName()) for f in files.listStatus(hadoop)]
    numbers = [int(f.split("=")[1]) for f in found if f.startswith(f"{name}=")]
    return sorted(n for n in numbers if _exists(spark, f"{folder}/{name}={n}/_SUCCESS"))


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _base(spark: SparkSession, master: str, before: int | None) -> int:
    """Number of the newest compacted snapshot (older than ``before``), -1 when there is none."""
    return max((n for n in _numbers(spark, f"{master}/base", "upto") if before is None or n < before), default=-1)


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def master_view(
    spark: SparkSession, master: str, schema, before: int | None = None, only: DataFrame | None = None
) -> DataFrame:
    """Current master rows: the last version of each key among the newest snapshot and the batches after it.

    ``only`` (key columns) restricts the view before the versions are compared.
    """
    upto = _base(spark, master, before)
    parts = []
    if upto >= 0:
        base = spark.read.option("basePath", f"{master}/base").parquet(f"{master}/base/upto={upto}").withColumnRenamed("upto", "batch")
        if only is not None:
            wanted = [r["bucket"] for r in only.select(_bucket(names.KEY_FIELDS).alias("bucket")).distinct().collect()]  # at most BUCKETS
            base = base.filter(F.col("bucket").isin(wanted))
        parts.append(base.drop("bucket"))
    later = [n for n in _numbers(spark, f"{master}/changes", "batch") if n > upto and (before is None or n < before)]
    if later:
        parts.append(spark.read.option("basePath", f"{master}/changes").parquet(*[f"{master}/changes/batch={n}" for n in later]))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = merge.append_all(parts)
    if only is not None:
        rows = rows.join(only, names.KEY_FIELDS, "left_semi")
    return last_row(rows, names.KEY_FIELDS, "batch").drop("batch")


def compact(spark: SparkSession, master: str, upto: int) -> None:
    """Write the state after batch ``upto`` as a snapshot in buckets of keys; later views start from it.

    The snapshot before it stays with the changes since, as batch ``upto`` may be run again; what is older goes."""
    before = _base(spark, master, upto)
    schema = spark.read.parquet(f"{master}/changes").drop("batch").schema
    now = master_view(spark, master, schema, upto + 1).withColumn("bucket", _bucket(names.KEY_FIELDS))
    now.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{master}/base/upto={upto}")
    for name, folder, last in (("batch", f"{master}/changes", before), ("upto", f"{master}/base", before - 1)):
        for n in _numbers(spark, folder, name):
            if n <= last:
                _remove(spark, f"{folder}/{name}={n}")


def _decoded(path: Column) -> Column:
    """The path of a file from its address in ``_metadata``."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _below(path: Column, folder: str) -> Column:
    """Path below a folder: the name of a delivered file, unique in its directory tree."""
    plain = re.sub(r"^[a-z0-9]+:/*", "/", folder.rstrip("/"))
    return F.regexp_extract(path, rf"^.*{re.escape(plain)}/(.*)$", 1)


def side_checksums(spark: SparkSession, incoming: str, files: list[str]) -> DataFrame | None:
    """Errors of the files of one batch that come with a '.sha256' side file."""
    found = [f for f in files if _exists(spark, f + ".sha256")]
    if not found:
        return None
    read = spark.read.format("binaryFile")
    sums = read.load(found).select(_below(F.col("path"), incoming).alias("path"), F.sha2("content", 256).alias("sha"))
    side = read.load([f + ".sha256" for f in found]).select(
        F.regexp_replace(_below(F.col("path"), incoming), r"\.sha256$", "").alias("path"), F.col("content").cast("string").alias("expected")
    )
    return quality.checksum_errors(sums, side).filter("error <> ''").select(F.col("path").alias("file"), F.col("error").alias("message"))


def file_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Column names of each CSV file, without byte order mark and outer blanks; one row per file reaches the driver."""
    lines = spark.read.text(paths).select(_decoded(F.col("_metadata.file_path")).alias("path"), F.monotonically_increasing_id().alias("pos"), "value")
    first = lines.filter(F.trim("value") != "").groupBy("path").agg(F.min_by("value", "pos").alias("head"))
    header = F.transform(tx.csv_fields(F.ltrim(F.replace("head", F.lit("\ufeff"), F.lit("")))), tx.strip)
    return {r["path"]: r["header"] for r in first.select("path", header.alias("header")).collect()}


def read_deliveries(spark: SparkSession, headers: dict[str, list[str]], columns: list[str], folder: str) -> DataFrame:
    """CSV records of files by column name: (file, pos, the columns as text), null where a file has no such column.

    Files of one header are read together. A quoted cell may hold line breaks; positions grow with file order.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in sorted(headers.items()):
        groups.setdefault(tuple(header), []).append(path)
    parts = []
    for header, paths in groups.items():
        schema = StructType([StructField(f"c{i}", StringType()) for i in range(len(header))])
        rows = csv_reader(spark).option("enforceSchema", True).schema(schema).csv(paths)
        named = [F.col(f"c{header.index(c)}").alias(c) if c in header else F.lit(None).cast("string").alias(c) for c in columns]
        parts.append(rows.select(_below(_decoded(F.col("_metadata.file_path")), folder).alias("file"), F.monotonically_increasing_id().alias("pos"), *named))
    return merge.append_all(parts)


def receive_batch(spark: SparkSession, batch: DataFrame, batch_id: int, incoming: str, master: str, out: str, compact_every: int = COMPACT_EVERY) -> None:
    """Check the files of a batch, merge the valid ones, write acknowledgements, messages and an audit row.

    Every ``compact_every`` batches the master is compacted, so that a batch reads one snapshot and a bounded number of change folders.
    """
    session = batch.sparkSession
    received, staged = f"{out}/received/batch={batch_id}", f"{out}/staged/batch={batch_id}"
    paths = [r["path"] for r in batch.select("path").distinct().collect()]  # at most the files of one trigger
    found = file_headers(session, paths)
    if not found:
        return
    # positions are fixed by a first write, row numbers by a second: the checks and the merge read the same rows
    read_deliveries(session, found, names.EXPORT_COLUMNS, incoming).write.mode("overwrite").parquet(received)
    lines = session.read.parquet(received).drop("batch")
    headers = session.createDataFrame(list(found.items()), "path string, header array<string>")
    headers = headers.select(_below(F.col("path"), incoming).alias("file"), "header")
    gone = quality.header_errors(headers, "file")
    flagged = gone.select("file", F.lit(1).alias("header_errors"))
    named = lines.join(flagged, "file", "left").na.fill(0, ["header_errors"])
    number_in_order(named, ["file"], "pos", "row_no").write.mode("overwrite").parquet(staged)
    rows = session.read.parquet(staged)
    blank = quality.row_errors(rows, "row_no", ["product_code", "benefit_name"], ["file"], header_errors="header_errors")
    errors = gone.unionByName(blank.select("file", "message"))
    files = headers.select("file")
    sums = side_checksums(session, incoming, paths)
    errors = (errors if sums is None else errors.unionByName(sums)).persist()
    state = quality.validity(files, errors, "file")
    errors.write.mode("overwrite").json(f"{out}/errors/batch={batch_id}")
    state.select(F.concat_ws("|", F.lit("ACK"), "file", F.when(F.col("valid"), "OK").otherwise("FAILED")).alias("value")).write.mode(
        "overwrite"
    ).text(f"{out}/acks/batch={batch_id}")
    good = rows.join(state.filter("valid").select("file"), "file", "left_semi")
    # of several rows with one key the last of the batch counts
    good = last_row(good.drop("file", "row_no", "header_errors").na.fill("", names.KEY_FIELDS), names.KEY_FIELDS, "pos").drop("pos").na.fill("")
    current = master_view(session, master, good.schema, batch_id, good.select(*names.KEY_FIELDS))
    changed = merge.classify(current, good).persist()
    changed.filter("change_type <> 'skip'").drop("change_type", "changes").write.mode("overwrite").parquet(f"{master}/changes/batch={batch_id}")
    counts = merge.sync_counts(changed)
    counts.select(
        *review.audit("sync", "master_db", F.lit(batch_id), F.lit("system"), F.lit("synced"), F.to_json(F.struct(*counts.columns)))
    ).write.mode("overwrite").json(f"{out}/audit/batch={batch_id}")
    changed.unpersist()
    errors.unpersist()
    if (batch_id + 1) % compact_every == 0:
        compact(session, master, batch_id)
    for folder in (received, staged):
        _remove(session, folder)


def monitor(spark: SparkSession, incoming: str, master: str, out: str, checkpoint: str, files_per_trigger: int = 1000, compact_every: int = COMPACT_EVERY):
    """Read every new CSV of a directory and hand it to ``receive_batch``; ends when all files are read."""
    # only the names come from the stream; the files of a batch are read as CSV records
    stream = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_trigger)
        .load(incoming).select("path")
    )
    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, n: receive_batch(spark, df, n, incoming, master, out, compact_every)).start()
    )


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Events appended to a log as they arrive."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )


def first_decision_stream(stream: DataFrame, queue: DataFrame, path: str, checkpoint: str):
    """Applicable decisions: the first of each pending review in arrival order; later ones find it closed.

    Which reviews are closed is one flag a review in Spark's state store; no earlier output is read, whatever has been decided before."""
    rest = [c for c in stream.columns if c not in ("review_id", "pos")]
    pending = queue.filter("status = 'pending'").select(F.col("id").alias("review_id"))
    known = stream.filter(F.col("action").isin("approve", "reject")).join(pending, "review_id", "left_semi")
    row = StructType([stream.schema[c] for c in rest])
    firsts = known.select("review_id", "pos", F.to_json(F.struct(*rest), _JSON).alias("row")).groupBy("review_id").applyInPandasWithState(
        _first_of_review, "review_id long, pos long, row string", "closed boolean", "append", "NoTimeout")
    out = firsts.withColumn("row", F.from_json("row", row, _JSON)).select(*[F.col(f"row.{c}") if c in rest else F.col(c) for c in stream.columns])
    return out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(f"{path}/closed")


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def _first_of_review(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = None
    for part in parts:  # Arrow batches: the decisions of a crowded review are never held together
        if not state.exists and len(part):
            own = part.loc[[part["pos"].idxmin()]]
            best = own if best is None or own["pos"].iloc[0] < best["pos"].iloc[0] else best
    if best is not None:
        state.update((True,))
        yield best


def count_stream(stream: DataFrame, key: Column, path: str, checkpoint: str):
    """Counts per status, the whole result after every batch; the newest folder is the current one, and only the one before it stays beside it."""
    counts = stream.groupBy(key).agg(F.count("*").alias("n"))

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/run={batch_id}")
        for n in _numbers(batch.sparkSession, path, "run"):
            if n < batch_id - 1:
                _remove(batch.sparkSession, f"{path}/run={n}")

    return (
        counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(store).start()
    )


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of the newest run; no other run is read."""
    newest = _numbers(spark, path, "run")[-1]
    return spark.read.parquet(f"{path}/run={newest}").drop("batch")
