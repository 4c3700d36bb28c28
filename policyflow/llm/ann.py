"""Nearest neighbours by inner product through randomly rotated one-bit codes.

Every vector is centred, rotated at random and reduced to the signs of its coordinates, packed in bits, with two correction
scalars: the length of the centred vector and the inner product of its direction with its own code. A query's inner product with
a vector is estimated from the packed bits; the estimate's error bound holds with a chance set by ERROR_FACTOR. Vectors whose upper bound
reaches the K-th best lower bound are ranked again by the exact inner product of the original vectors.

Vectors are written once with their codes and stay where they are. Queries come to them in blocks of bounded size, which are broadcast: every task estimates a
block's inner products from the codes of its vectors, ranks those again that the bounds leave, and keeps the K best of each query, whose last one
is the limit for what follows. So all that is moved are queries and K rows for each query and task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from .common import Tables, bounded_batches, query, table

#: Neighbours of each query.
K = 20
#: Vectors of a task, at least and at most, and tasks that small inputs are dealt out to; queries that are broadcast together.
LEAST_VECTORS, VECTORS, TASKS, QUERIES_PER_BLOCK = 4096, 1 << 16, 12, 4096
#: Vectors that are estimated together.
STEP = 8192
#: Deviations of the estimate that the bound allows for.
ERROR_FACTOR = 3.0
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v) without null, zero, non-finite or other-sized vectors; null ids take no part either."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") == dim) & ~bad & F.exists("v", lambda x: x != 0)
    )


def index(vectors: DataFrame, dim: int, centre: np.ndarray) -> DataFrame:
    """vec_id, v, code (packed signs), length (of the centred vector) and own (inner product of its direction with its code)."""
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v")) if len(batch) else np.zeros((0, dim))
            rest = (v - centre) @ turn
            length = np.linalg.norm(rest, axis=1)
            direction = rest / np.where(length > 0, length, 1)[:, None]
            code = np.packbits(direction > 0, axis=1)
            own = np.abs(direction).sum(axis=1) / np.sqrt(dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(length), pa.array(own)],
                ["vec_id", "v", "code", "length", "own"],
            )

    return vectors.mapInArrow(run, "vec_id long, v array<double>, code binary, length double, own double")


_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Search:
    """The k best vectors of each query of a block, among the vectors shown so far."""

    def __init__(self, queries: dict[str, np.ndarray], dim: int, centre: np.ndarray, k: int, error_factor: float):
        self.rows, self.ids, self.q = queries["row"], queries["vec_id"], queries["v"]
        self.dim, self.k, self.factor = dim, k, error_factor
        self.turned = (self.q @ rotation(dim)).astype(np.float32)
        self.length = np.linalg.norm(self.q, axis=1)
        self.base = self.q @ centre
        self.best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(self.ids)  # score, id, row
        self.reranked = 0

    def show(self, block: pa.Table) -> None:
        rows, ids, v = block["row"].to_numpy(), block["vec_id"].to_numpy(), _matrix(block["v"])
        packed = np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        signs = np.unpackbits(packed, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        length, own = block["length"].to_numpy(), block["own"].to_numpy()
        safe = np.where(own > 0, own, 1)
        # an estimate is off by about sqrt((1 - own^2) / own^2 / (dim - 1)) times both lengths
        spread = np.where(own > 0, length * np.sqrt(np.maximum(1 - safe**2, 0)) / safe / np.sqrt(max(self.dim - 1, 1)), 0) * self.factor
        scale = np.where(own > 0, length / safe, 0) / np.sqrt(self.dim)
        rough = 1e-5 * scale * self.dim
        for at in range(0, len(self.ids), 64):
            estimates = (self.turned[at : at + 64] @ signs.T).astype(np.float64) * scale + self.base[at : at + 64, None]
            for me, estimate in enumerate(estimates, at):
                error = (spread + rough) * self.length[me] + 1e-5 * abs(self.base[me])
                other = ids != self.ids[me]
                have = self.best[me]
                limit = have[0][-1] if len(have[0]) == self.k else -np.inf
                if limit == -np.inf and len(ids) > 2 * self.k:  # the best by estimate first: their scores are a limit for the rest
                    some = np.argpartition(-np.where(other, estimate, -np.inf), 2 * self.k)[: 2 * self.k]
                    limit = self._rank(me, some[other[some]], v, ids, rows)
                    other[some] = False
                self._rank(me, np.flatnonzero(other & (estimate + error >= limit)), v, ids, rows)

    def _rank(self, me: int, near: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> float:
        """Takes the vectors in by their exact scores; returns the limit."""
        self.reranked += len(near)
        score, own, row = (np.concatenate(x) for x in zip(self.best[me], ((v[near] * self.q[me]).sum(axis=1), ids[near], rows[near])))
        order = np.lexsort((row, own, -score))[: self.k]
        self.best[me] = score[order], own[order], row[order]
        return score[order[-1]] if len(order) == self.k else -np.inf

    def found(self) -> pa.RecordBatch:
        sizes = [len(x[0]) for x in self.best]
        if not sizes:
            return pa.RecordBatch.from_pylist([], schema=_FOUND)
        score, ids, rows = (np.concatenate(c) for c in zip(*self.best))
        columns = np.repeat(self.rows, sizes), np.repeat(self.ids, sizes), rows, ids, score
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)


def visited(indexed: DataFrame, queries: Broadcast, dim: int, centre: np.ndarray, k: int, error_factor: float) -> DataFrame:
    """The k best of each query among the vectors of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(queries.value, dim, centre, k, error_factor)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= STEP:
                search.show(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            search.show(pa.Table.from_batches(held))
        yield search.found()

    return indexed.mapInArrow(run, "query_row long, query_id long, row long, vec_id long, score double")


def search(vectors: DataFrame, query_modulus: int = 20, k: int = K, error_factor: float = ERROR_FACTOR, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """For every vector whose id is divisible by ``query_modulus``, its k nearest others by inner product: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding (an array of numbers); the most frequent size is taken as the dimension. Null ids and vectors that are null, zero, of
    another size, or hold null or non-finite components take no part. Ties go to the smaller id. Repeated rows each take part, and as queries each has
    an answer of its own; a query finds no row of its own id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    made = Tables(spark)
    sizes = vectors.filter(F.col("embedding").isNotNull()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = int(sizes["d"]) if sizes and sizes["d"] > 0 else 1
    base = usable(vectors, dim)
    means = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % query_modulus == 0).alias("q"), *[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).first()
    centre = np.array([means[f"m{i}"] or 0.0 for i in range(dim)])
    tasks = max(1, -(-means["n"] // VECTORS), min(TASKS, means["n"] // LEAST_VECTORS))
    # rows get their numbers by being written
    indexed = made.write(index(base.repartition(tasks), dim, centre).withColumn("row", F.monotonically_increasing_id()), "index")
    blocks = max(1, -(-means["q"] // queries_per_block))
    asked = indexed.filter(F.col("vec_id") % query_modulus == 0).select("row", "vec_id", "v", F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"))
    out = Tables(spark)
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).toPandas()  # about queries_per_block of them
        own = {"row": rows["row"].to_numpy(np.int64), "vec_id": rows["vec_id"].to_numpy(np.int64), "v": np.array(rows["v"].tolist(), np.float64).reshape(len(rows), dim)}
        queries = spark.sparkContext.broadcast(own)
        best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
        found = visited(indexed, queries, dim, centre, k, error_factor).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        out.write(found.select("query_id", "rank", "vec_id", "score"), f"nearest-{block}")
        queries.unpersist()
    made.drop()
    return out.read(*out.paths)


@query("op2_rotated_codes")
def op2(spark, sf_dir):
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return search(table(spark, sf_dir, "embeddings"))
