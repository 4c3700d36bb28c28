"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

_SCRATCH: list[str] = []

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # Korean charsets of mapping files
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",  # shuffle files go with the statement that made them
}


def build_session(app: str = "policyflow", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="policyflow-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; ``remove_scratch`` deletes what was written there."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the library's sources to the session once, as ``--py-files`` would, through the shared folder: Python code inside tasks needs them on every executor."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.writestr(f"{root.name}/{file.relative_to(root)}", file.read_bytes())
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, 'code')}/{root.name}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    _SHIPPED.add(context.applicationId)


def remove_scratch(spark: SparkSession) -> int:
    """Delete the folders that ``scratch`` has named in this process, once their frames are no longer needed."""
    removed = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def cut(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder: worked out once, kept if executors are lost, and later reads take only the columns they need."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
