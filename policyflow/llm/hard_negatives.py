"""Hard negatives by cover trees over norm-augmented candidates.

Every candidate gets one more coordinate that lifts it to the sphere of the largest norm, where inner product with an anchor (which has 0 there) falls with the angle. So a node's
covering radius, taken as an angle, bounds the inner products of all that it covers, from above and below.

The top level of the tree are cells around separated vectors of a bounded sample; every vector goes to its nearest cell, and cells are cut in blocks that one task can
hold. In a block the tree goes on level by level, each with a smaller radius, down to leaves. An anchor descends best first: first into the cells
and leaves with the highest bounds, then into all others that the scores found so far and its score windows do not exclude. Leaves are verified by exact whole-number inner products, so the
result is that of a comparison with every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Tables, bounded_batches, query, table

#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Whole numbers of a component of 1.
UNIT = 256
#: Cells at most, vectors that they are chosen from, and vectors of a block.
CELLS, SAMPLE, BLOCK = 1024, 8192, 4096
#: Anchors that meet a block together.
CHUNK = 1024
#: Ratio of the radii of two levels, and vectors below which a node is a leaf.
SHRINK, LEAF = 0.7, 24
#: Cells, and leaves of a block, that an anchor visits first.
FIRST_CELLS, FIRST_LEAVES = 2, 32
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
_LOWEST, _HIGHEST = -(1 << 62), 1 << 62

_ASK = "akey long, vec_id long, label long, v array<long>, lo array<long>, hi array<long>, least array<long>"
_FOUND = "akey long, w int, vec_id long, label long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): distinct rows in whole numbers that take part; see ``mine``."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(UNIT)) * x.cast("double")).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.filter((F.size("v") > 0) & (square < float(1 << 61))).dropDuplicates()


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    """Unit vectors on the sphere of squared radius ``square``: the rows with the coordinate that they lack to it."""
    x = x.astype(np.float64)
    last = np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, last[:, None]], axis=1) / np.sqrt(square)


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angles between unit vectors; from the distance, which small angles need."""
    dots = a @ b.T
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(0.0, 2 - 2 * dots)) / 2))


class Bounds:
    """Bounds of inner products of anchors with everything inside angles around centres."""

    def __init__(self, anchors: np.ndarray, square: float):
        x = anchors.astype(np.float64)
        self.norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt(square)
        length = np.sqrt((x * x).sum(axis=1))
        self.unit = np.concatenate([x / np.where(length > 0, length, 1)[:, None], np.zeros((len(x), 1))], axis=1)
        # of rounding
        self.slack = 1e-6 + 1e-6 * self.norm

    def of(self, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, anchors by centres."""
        middle = np.arccos(np.clip(self.unit @ centres.T, -1.0, 1.0))
        high = np.cos(np.maximum(0.0, middle - radius)) * self.norm[:, None] + self.slack[:, None]
        low = np.cos(np.minimum(np.pi, middle + radius)) * self.norm[:, None] - self.slack[:, None]
        return low, high


def separated(sample: np.ndarray, cells: int) -> np.ndarray:
    """Up to ``cells`` of the unit vectors, each the farthest from those before it."""
    out, far = [0], angles(sample, sample[:1])[:, 0]
    while len(out) < cells and far.max() > 1e-9:
        out.append(int(far.argmax()))
        far = np.minimum(far, angles(sample, sample[out[-1:]])[:, 0])
    return sample[out]


def covers(x: np.ndarray, rows: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """Balls of an angle around separated centres (the first is given) that cover the rows: (centre, rows)."""
    out, batch = [], np.array([centre])
    while len(rows):
        chosen: list[int] = []
        apart = angles(x[batch], x[batch])
        for k in range(len(batch)):
            if all(apart[k, j] > radius for j in chosen):
                chosen.append(k)
        near = angles(x[rows], x[batch[chosen]])
        best = near.argmin(axis=1)
        inside = near[np.arange(len(rows)), best] <= radius
        inside[np.isin(rows, batch[chosen])] = True
        for k, c in enumerate(chosen):
            own = rows[inside & (best == k)]
            if len(own):
                out.append((int(batch[c]), own))
        rows = rows[~inside]
        batch = rows[:64]
    return out


class Tree:
    """Levels of nodes (centre, angle that covers all below, parent); leaves hold ranges of the rows, which are put in their order."""

    def __init__(self, vectors: np.ndarray, square: float, top: float = np.pi):
        x = lifted(vectors, square)
        self.levels: list[list[tuple[int, float, int, int]]] = []  # centre, radius, parent, number of the leaf or -1
        self.leaves: list[np.ndarray] = []
        level = [(0, np.arange(len(x)), -1)]
        while level:
            now, below = [], []
            for centre, rows, parent in level:
                radius = float(angles(x[rows], x[[centre]]).max())
                if len(rows) <= LEAF or radius < 1e-7:
                    now.append((centre, radius + 1e-7, parent, len(self.leaves)))
                    self.leaves.append(rows)
                    continue
                step = int(np.floor(np.log(radius / top) / np.log(SHRINK))) + 1  # the first level whose radius is smaller
                below += [(c, own, len(now)) for c, own in covers(x, rows, centre, top * SHRINK**step)]
                now.append((centre, radius + 1e-7, parent, -1))
            self.levels.append(now)
            level = below

    def packed(self) -> dict[str, bytes]:
        flat = [(k, *node) for k, level in enumerate(self.levels) for node in level]
        return {
            "nodes": np.array([(k, c, p, leaf) for k, c, _, p, leaf in flat], "<i8").tobytes(), "radii": np.array([r for _, _, r, _, _ in flat], "<f8").tobytes(),
            "order": np.concatenate([np.zeros(0, np.int64), *self.leaves]).astype("<i8").tobytes(), "sizes": np.array([len(x) for x in self.leaves], "<i8").tobytes(),
        }


_BLOCK = "cell int, part int, vec_ids binary, labels binary, vectors binary, nodes binary, radii binary, order binary, sizes binary"


def grown(placed: DataFrame, square: float) -> DataFrame:
    """A row with the tree of each block of ``placed`` (cell, part, vec_id, label, v)."""

    def run(group: pa.Table) -> pa.Table:
        x = _matrix(group["v"])
        row = {
            "cell": group["cell"][0].as_py(), "part": group["part"][0].as_py(), "vec_ids": group["vec_id"].to_numpy().astype("<i8").tobytes(),
            "labels": group["label"].to_numpy().astype("<i8").tobytes(), "vectors": x.astype("<i8").tobytes(), **Tree(x, square).packed(),
        }
        kinds = [("cell", pa.int32()), ("part", pa.int32())] + [(c.split()[0], pa.binary()) for c in _BLOCK.split(", ")[2:]]
        return pa.Table.from_pylist([row], pa.schema(kinds))

    return placed.groupBy("cell", "part").applyInArrow(run, _BLOCK)


def first_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id, in that order."""
    at = np.arange(len(scores))
    if len(at) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores > cut)
        even = np.flatnonzero(scores == cut)
        at = np.concatenate([at, even[np.argsort(ids[even], kind="stable")[: k - len(at)]]])
    return at[np.lexsort((ids[at], -scores[at]))]


class Block:
    """A block that anchors descend into."""

    def __init__(self, row: dict, square: float):
        self.ids, self.labels = np.frombuffer(row["vec_ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(self.ids), -1)
        self.nodes, self.radii = np.frombuffer(row["nodes"], "<i8").reshape(-1, 4), np.frombuffer(row["radii"], "<f8")
        self.order, self.sizes = np.frombuffer(row["order"], "<i8"), np.frombuffer(row["sizes"], "<i8")
        self.square = square

    def leaves(self, bounds: Bounds, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower and upper bounds of the leaves, and which of them an anchor reaches; ``wanted(low, high)`` tells whether bounds are of use."""
        count, size = len(bounds.norm), len(self.sizes)
        lows, highs, reached = np.full((count, size), np.inf), np.full((count, size), -np.inf), np.zeros((count, size), bool)
        above = None
        for level in range(int(self.nodes[-1, 0]) + 1):
            at = np.flatnonzero(self.nodes[:, 0] == level)
            alive = np.ones((count, len(at)), bool) if above is None else above[:, self.nodes[at, 2]]
            open_ = np.flatnonzero(alive.any(axis=0))
            here = at[open_]
            low, high = bounds.of(lifted(self.vectors[self.nodes[here, 1]], self.square), self.radii[here])
            alive[:, open_] &= wanted(low, high)
            leaf = self.nodes[here, 3]
            own = leaf >= 0
            lows[:, leaf[own]], highs[:, leaf[own]], reached[:, leaf[own]] = low[:, own], high[:, own], alive[:, open_[own]]
            above = alive
        return lows, highs, reached

    def scores(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        x = self.vectors[rows]
        if np.sqrt((anchors.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < EXACT / 2:
            return (anchors.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
        return anchors.astype(object).dot(x.astype(object).T).astype(np.int64)

    def search(self, asks: pa.Table, k: int, same: bool) -> list[tuple]:
        """(akey, w, vec_id, label, score) of the first k rows inside each score window of each anchor, of its label or of others."""
        v, keys, own_ids, own_labels = _matrix(asks["v"]), asks["akey"].to_pylist(), asks["vec_id"].to_numpy(), asks["label"].to_numpy()
        lo, hi, least = (asks[c].to_pylist() for c in ("lo", "hi", "least"))
        best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in x] for x in lo]
        most = max(map(len, lo), default=0)
        padded = lambda lists, fill: np.array([[*map(float, x), *[fill] * (most - len(x))] for x in lists]).reshape(len(lists), most)
        floors, tops = np.maximum(padded(lo, np.inf), padded(least, np.inf)), padded(hi, -np.inf)

        def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(low.shape, bool)
            for w in range(most):
                out |= (high >= floors[:, w : w + 1]) & (low <= tops[:, w : w + 1])
            return out

        lows, highs, reached = self.leaves(Bounds(v, self.square), wanted)
        first = np.zeros(reached.shape, bool)
        if reached.shape[1] > FIRST_LEAVES:
            np.put_along_axis(first, np.argpartition(-np.where(reached, highs, -np.inf), FIRST_LEAVES, axis=1)[:, :FIRST_LEAVES], True, axis=1)
        else:
            first[:] = True
        for wave in (first, ~first):
            use = reached & wave & wanted(lows, highs)
            columns = np.flatnonzero(np.repeat(use.any(axis=0), self.sizes))
            if not len(columns):
                continue
            rows = self.order[columns]
            scores, ids, labels = self.scores(v, rows), self.ids[rows], self.labels[rows]
            seen = np.repeat(use, self.sizes, axis=1)[:, columns]
            seen &= (labels == own_labels[:, None]) == same
            seen &= ids != own_ids[:, None]
            for a in np.flatnonzero(seen.any(axis=1)).tolist():
                at = np.flatnonzero(seen[a] & (scores[a] >= floors[a, : len(lo[a])].min()))
                got = scores[a, at]
                for w in range(len(lo[a])):
                    fits = np.flatnonzero((got >= max(lo[a][w], least[a][w])) & (got <= hi[a][w]))
                    if len(fits):
                        have = best[a][w]
                        s, i, c = np.concatenate([have[0], got[fits]]), np.concatenate([have[1], ids[at[fits]]]), np.concatenate([have[2], labels[at[fits]]])
                        keep = first_of(s, i, k)
                        best[a][w] = s[keep], i[keep], c[keep]
                        if len(keep) == k:
                            floors[a, w] = max(floors[a, w], float(s[keep[-1]]))
        return [(keys[a], w, int(i), int(c), int(s)) for a, x in enumerate(best) for w, (ss, ii, cc) in enumerate(x) for s, i, c in zip(ss, ii, cc)]


class Search:
    """Searches in the trees of some candidates: each takes part of what a row of the asks wants (_ASK: an anchor, its score windows and the least score of use in each)."""

    def __init__(self, made: Tables, rows: DataFrame, cells: int = CELLS, block: int = BLOCK):
        self.made = made
        spark = rows.sparkSession
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square")).first()
        self.square = float(max(whole["square"] or 1.0, 1.0)) * (1 + 1e-9)
        sample = rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(SAMPLE).toPandas()["v"]
        sample = lifted(np.array(sample.tolist(), np.int64), self.square)
        centres = separated(sample, min(cells, -(-int(whole["n"]) // block)))
        schema = pa.schema([("cell", pa.int32()), ("angle", pa.float64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64()))])
        all_square = self.square

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    far = angles(lifted(_matrix(batch.column("v")), all_square), centres)
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell]), *(batch.column(c).cast(schema.field(c).type) for c in ("vec_id", "label", "v"))], schema=schema)

        placed = made.write(rows.select("vec_id", "label", "v").mapInArrow(place, "cell int, angle double, vec_id long, label long, v array<long>"), "placed")
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("cell").collect()
        self.cells = np.array([r["cell"] for r in sizes], np.int32)
        self.centres, self.radii = centres[self.cells], np.array([r["radius"] + 1e-7 for r in sizes])
        parts = spark.createDataFrame([(r["cell"], -(-r["n"] // block)) for r in sizes], "cell int, parts int")
        self.parts = F.broadcast(parts)  # one row per cell
        dealt = placed.join(self.parts, "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "label"), F.col("parts")).cast("int"))
        self.trees = made.write(grown(dealt.select("cell", "part", "vec_id", "label", "v"), self.square), "trees")
        made.drop("placed")

    def routed(self, asks: DataFrame, rest: bool) -> DataFrame:
        """The asks with the cells that they visit first, or with all others that their windows and least scores do not exclude."""
        cells, centres, radii, square = self.cells, self.centres, self.radii, self.square
        names = [x.split()[0] for x in _ASK.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high = Bounds(_matrix(batch.column("v")), square).of(centres, radii)
                by_bound = np.argsort(-high, axis=1, kind="stable")
                first = np.zeros(high.shape, bool)
                np.put_along_axis(first, by_bound[:, :FIRST_CELLS], True, axis=1)
                useful = np.zeros(high.shape, bool)
                windows = zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "least")))
                for a, (los, his, leasts) in enumerate(windows):
                    for lo, hi, least in zip(los, his, leasts):
                        useful[a] |= (high[a] >= max(lo, least)) & (low[a] <= hi)
                who, where = np.nonzero(useful & (~first if rest else first))
                yield pa.RecordBatch.from_arrays([pa.array(cells[where]), *(batch.column(c).take(pa.array(who)) for c in names)], ["cell", *names])

        return asks.select(names).mapInArrow(run, f"cell int, {_ASK}")

    def visited(self, asks: DataFrame, chunks: int, rest: bool, k: int, same: bool) -> DataFrame:
        square = self.square
        schema = pa.schema([("akey", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int64()), ("score", pa.int64())])

        def run(blocks: pa.Table, own: pa.Table) -> pa.Table:
            out = Block(blocks.slice(0, 1).to_pylist()[0], square).search(own, k, same) if blocks.num_rows and own.num_rows else []
            return pa.Table.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

        sent = self.routed(asks, rest).join(self.parts, "cell").withColumn("chunk", F.pmod(F.xxhash64("akey"), F.lit(chunks)).cast("int"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        trees = self.trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        return trees.groupBy("cell", "part", "chunk").cogroup(sent.groupBy("cell", "part", "chunk")).applyInArrow(run, _FOUND)

    def first(self, asks: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """The first k rows in each window of each ask: akey, w, rank, vec_id, label, score."""

        def ranked(rows: DataFrame) -> DataFrame:
            order = Window.partitionBy("akey", "w").orderBy(F.desc("score"), "vec_id", "label")
            return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

        chunks = max(1, -(-asks.count() // CHUNK))
        near = self.made.write(ranked(self.visited(asks, chunks, False, k, same)), f"{name}-near")
        full = near.groupBy("akey", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k)
        known = full.groupBy("akey").agg(F.map_from_entries(F.collect_list(F.struct("w", "least"))).alias("known"))
        told = F.transform("least", lambda x, w: F.greatest(x, F.coalesce(F.element_at("known", w), x)))
        again = asks.join(known, "akey", "left").withColumn("known", F.coalesce("known", F.expr("map()").cast("map<int,long>"))).withColumn("least", told).drop("known")
        both = near.drop("rank").unionByName(self.visited(again, chunks, True, k, same))
        return self.made.write(ranked(both), name)


def _window(asks: DataFrame, lo, hi) -> DataFrame:
    return asks.withColumn("lo", lo).withColumn("hi", hi).withColumn("least", F.transform("lo", lambda x: x))


def mine(vectors: DataFrame, anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the rows of ``vectors`` (vec_id, label, embedding) for which the Column ``anchor`` (over vec_id) is true.

    Components become floor(UNIT * x). An anchor's positives are the ``positives`` other rows of its label with the highest inner products; each gets the ``negatives`` rows of other labels
    with the highest ones between ``low`` and ``high`` percent of its own. Ties go to the smaller vec_id.

    Rows with a null id, label, vector or component, a component that is not finite, an empty vector, or one so large that products may pass 64 bits take no part; nor do
    vectors of another length than most have (the shorter on ties). Repeated rows are one row; rows with the anchor's id are never its partners. Other columns are
    ignored. No rows, or no anchors, give no rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    made = Tables(spark)
    rows = made.write(usable(vectors), "vectors")
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if sizes is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == sizes["size"])
    anchors = made.write(rows.filter(anchor).withColumn("akey", F.xxhash64("vec_id", "label", "v")), "anchors")
    if anchors.isEmpty():
        return spark.createDataFrame([], schema)
    search = Search(made, rows, cells, block)
    every = F.array(F.lit(_LOWEST)), F.array(F.lit(_HIGHEST))
    chosen = search.first(_window(anchors, *every), positives, True, "positives").withColumnRenamed("rank", "place")
    scores = chosen.groupBy("akey").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("own"))
    wide = lambda x: x["score"].cast("decimal(20,0)")
    asks = anchors.join(scores, "akey")
    asks = _window(
        asks,
        F.transform("own", lambda x: F.ceil(wide(x) * F.lit(low).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")).cast("long")),
        F.transform("own", lambda x: F.floor(wide(x) * F.lit(high).cast("decimal(10,0)") / F.lit(100).cast("decimal(10,0)")).cast("long")),
    ).drop("own")
    hard = search.first(asks, negatives, False, "negatives")
    pairs = chosen.select("akey", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = hard.select("akey", (F.col("w") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    result = out.join(pairs, ["akey", "place"]).join(anchors.select("akey", F.col("vec_id").alias("anchor_id")), "akey").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    kept = Tables(spark).write(result, "mined")
    made.drop()
    return kept


@query("op12_hard_negatives", f"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({UNIT} * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM whole a, whole b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
), negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND {LOW} * positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= {NEGATIVES}
""")
def op12(spark, sf_dir):
    """Hard negatives of every hundredth vector; every seventh row carries the next label."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
