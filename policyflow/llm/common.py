"""Helpers that the operators of this package share: tables, bounded Arrow slices, vectorised word hashing.

Word and shingle identities are 64-bit hashes. Among n distinct strings the chance of any collision is about n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch, ship

#: Rows per Arrow batch, so that a batch of long texts stays small beside an executor's memory.
BATCH_ROWS = 128
#: Bytes of text that are worked on at once inside a task; one longer text is a slice of its own.
SLICE_BYTES = 1 << 21

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the DuckDB SQL of its rows where SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark from wherever it lies."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Makes a session ready for Python inside tasks: this package on every executor, and at most BATCH_ROWS rows per Arrow batch, as texts
    have no bounded length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    # what a job has shuffled goes with it: its result is a table by then
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    ship(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: worked out once, read by any number of branches, kept if executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Tables in the shared folder that a job makes for itself and drops as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        self.paths[name] = path = scratch(self.spark, name)
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, *names: str) -> DataFrame:
        """The named tables, all of one kind, as one."""
        return self.spark.read.parquet(*[self.paths[n] for n in names])

    def drop(self, *names: str) -> None:
        """Deletes the named tables, or all."""
        for name in names or list(self.paths):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def gathered(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.Table]:
    """Batches put together until the column holds about ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def text_column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    """The texts of a batch as one string array without nulls."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.fill_null("").cast(pa.large_string())


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the bounds of each text in them."""
    buffers = texts.buffers()
    bounds = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of one row."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = (_RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if size > 1 << 22:  # one very long text: not kept
            return have[:n]
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return data + np.where((data - np.uint8(65)) < 26, np.uint8(32), np.uint8(0)).astype(np.uint8)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\x09-\\x0D; no run crosses the bounds of a text."""
    inside = ~((data == 32) | ((data - np.uint8(9)) < 5))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    begins = edge[:-1] & inside
    ends = edge[1:] & inside
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    return mix(own + (ends - starts).astype(np.uint64) * _PLACES[63])


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts in order, and the bounds of each text in them."""
    data = lowered(data)
    starts, ends = word_spans(data, bounds)
    return span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the run of ``size`` words that starts at each word; the last words, which have no whole run, have none."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_BASE, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * _power(_INVERSE, len(words))[:n])


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` values in a row."""
    have = 1
    while have < size and len(values):
        step = min(have, size - have)
        values = np.minimum(values[: max(0, len(values) - step)], values[step:])
        have += step
    return values


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word runs of length ``size`` of each text; all of a shorter text is one run."""
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        runs += words[j : j + len(runs)] * _PLACES[j]
    runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            short = np.uint64(0)
            with np.errstate(over="ignore"):
                for j in range(b - a):
                    short += words[a + j] * _PLACES[j]
                short += np.uint64(b - a) * _PLACES[40]
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
