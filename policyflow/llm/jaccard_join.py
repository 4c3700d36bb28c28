"""Jaccard join of word-shingle sets as a metric-space join.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric, so a pivot p bounds d(x, y) from d(x, p) and d(y, p).

1. Documents with equal sets are one class, a node of the join.
2. Regions. Under a fixed order of all shingles, two sets within the limit share a shingle among the first of either (as many as may
   be missing, and one). Every such shingle has an owner, the smallest node that has it there; the owner names the region of all
   nodes that meet it, so two linked nodes meet in a region. A region holds sizes that can be linked only. The order puts shingles that a
   sample has found to be frequent last: this changes the work, never the result.
3. Members that no other member can be linked with, by the part of both sets that the order has shown, leave the region. This bound is exact.
4. Regions join recursively: a pivot is linked with its core, all members within the limit e. Members of the core are connected through
   the pivot; by the triangle inequality a member outside the core can be linked with the core only if it is within 2e of the pivot, and then only with those at
   least d(y, p) - e away from it. These windows are verified, the core leaves, and what is left joins by its next pivot. Regions that are too large for a task
   take their first pivot row by row, and the rest goes on in pairs of blocks.
5. Links are contracted to components by rounds of small jobs over written tables.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables, bounded_batches, query, raw, shingle_sets, slices, table, text_column, word_hashes

#: Words of a shingle.
SIZE = 5
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Documents sampled for the order, how often a shingle occurs in them to be put last, and how many such shingles are shipped at most.
SAMPLE, OFTEN, MOST_OFTEN = 16384, 3, 1 << 18
#: Shingles of all members of a region that one task joins; beyond, blocks of so many are joined pairwise.
REGION = 1 << 20
#: Shown shingles of all members of a region that are compared together; beyond, blocks of so many.
SHOWN = 1 << 20
#: Documents to read again whose ids and digests are broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
_LAST = np.int64(1 << 62)


def key_sets(data: np.ndarray, bounds: np.ndarray, size: int, often: np.ndarray) -> list[np.ndarray]:
    """The shingles of each text as sorted distinct 62-bit keys; frequent ones come last."""
    out = []
    for s in shingle_sets(*word_hashes(data, bounds), size):
        keys = (s >> np.uint64(2)).astype(np.int64)
        if len(often) and len(keys):
            keys = np.where(often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys, keys + _LAST, keys)
        out.append(np.unique(keys))
    return out


def _sets_of(batch: pa.RecordBatch, size: int, often: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, bounds = raw(text_column(batch))
    for first, last in slices(bounds):
        yield first, last, key_sets(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], size, often)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """Keys of shingles that occur often in a bounded sample of documents; at most MOST_OFTEN."""
    n = docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(size)), F.lit(1 << 30)) / (1 << 30)
    some = docs.filter(place < F.lit(min(1 / 16, SAMPLE / max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _sets_of(batch, size, np.zeros(0, np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["key"])

    counts = some.mapInArrow(run, "key long").groupBy("key").count().filter(F.col("count") >= OFTEN)
    return np.sort(np.array([r["key"] for r in counts.orderBy(F.desc("count"), "key").limit(MOST_OFTEN).collect()], np.int64))


def shown_length(n: int, percent: int) -> int:
    """How many first keys a set of n must show: as many as a linked set may lack, and one."""
    return n - -(-percent * n // 100) + 1


def _node(keys: np.ndarray) -> int | None:
    """The 64-bit digest that stands for a set."""
    return int.from_bytes(hashlib.blake2b(keys.tobytes(), digest_size=8).digest(), "little", signed=True) if len(keys) else None


def with_sets(docs: DataFrame, size: int, percent: int, often: np.ndarray) -> DataFrame:
    """doc_id, mark, n_shingles, digest (of the whole set, null if empty), shown (its first keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, sets in _sets_of(batch, size, often):
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), batch.column("mark").slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(_node, sets)), pa.int64()), _lists([s[: shown_length(len(s), percent)] if len(s) else s for s in sets])],
                    ["doc_id", "mark", "n_shingles", "digest", "shown"],
                )

    return docs.mapInArrow(run, "doc_id long, mark long, n_shingles long, digest long, shown array<long>")


def whole_sets(docs: DataFrame, size: int, often: np.ndarray) -> DataFrame:
    """(digest, keys): all keys of each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets in _sets_of(batch, size, often):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(_node, sets)), pa.int64()), _lists(sets)], ["digest", "keys"])

    return docs.select("text").mapInArrow(run, "digest long, keys array<long>")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


class Limit:
    """The link test and what it implies, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def linked(self, both: int, m: int, n: int) -> bool:
        return 100 * both >= self.percent * (m + n - both)

    def most_apart(self, total, times: int = 1):
        """Largest symmetric difference of two sets of so many keys in all whose distance is within ``times`` the limit."""
        p = 100 - times * (100 - self.percent)
        return np.floor(total * (100 - p) / (100 + p) + 1e-9) if p > 0 else total


def can_link(shown: list[np.ndarray], n: np.ndarray, limit: Limit) -> np.ndarray:
    """For each member, whether another one can be linked with it by the keys both show.

    Below the smaller of the two last shown keys both sets are known, and what they differ in there, they differ in. Keys may be
    shortened as long as their order stays: keys that fall together only lower the difference found."""
    count = len(shown)
    out = np.zeros(count, bool)
    flat = np.concatenate(shown)
    owner = np.repeat(np.arange(count), [len(s) for s in shown])
    whole = np.array([len(s) for s in shown]) >= n
    last = np.where(whole, np.iinfo(np.int64).max, np.array([int(s[-1]) for s in shown]))
    by_key = np.argsort(flat, kind="stable")
    keys, owners = flat[by_key], owner[by_key]
    for x in range(count):
        if out[x]:
            continue
        own = np.unique(shown[x])
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        met = hi - lo > 1
        if not met.any():
            continue
        spans = np.concatenate([owners[a:b] for a, b in zip(lo[met], hi[met])])
        others, both = np.unique(spans[spans != x], return_counts=True)
        fits = 100 * np.minimum(n[others], n[x]) >= limit.percent * np.maximum(n[others], n[x])
        for y, shared in zip(others[fits].tolist(), both[fits].tolist()):
            upto = min(last[x], last[y])
            apart = np.searchsorted(shown[x], upto, "left") + np.searchsorted(shown[y], upto, "left") - 2 * min(shared, len(shown[x]), len(shown[y]))
            if apart <= limit.most_apart(n[x] + n[y]):
                out[x] = out[y] = True
                break
    return out


def region_links(sets: list[np.ndarray], limit: Limit) -> list[tuple[int, int]]:
    """Links between members of a region that connect all that the region's links connect; by pivots, see above."""
    n = np.array([len(s) for s in sets])
    # counts of keys by residue: their differences bound the symmetric difference from below
    rough = np.stack([np.bincount(s & 127, minlength=128) for s in sets]).astype(np.int32)
    links, left = [], np.argsort(-n, kind="stable")
    while len(left) > 1:
        pivot, left = int(left[0]), left[1:]
        near = left[np.abs(rough[left] - rough[pivot]).sum(axis=1) <= limit.most_apart(n[left] + n[pivot], 2)]
        if not len(near):
            continue
        both = np.array([common(sets[pivot], sets[y]) for y in near.tolist()])
        total = n[near] + n[pivot]
        apart = 1 - both / (total - both)
        core = 100 * both >= limit.percent * (total - both)
        links += [(pivot, y) for y in near[core].tolist()]
        shell = ~core & (apart <= 2 * (100 - limit.percent) / 100 + 1e-9)
        inside, depth = near[core], apart[core]
        for y, d in zip(near[shell].tolist(), apart[shell].tolist()):
            window = inside[depth >= d - (100 - limit.percent) / 100 - 1e-9]
            window = window[np.abs(rough[window] - rough[y]).sum(axis=1) <= limit.most_apart(n[window] + n[y])]
            for x in window.tolist():
                if limit.linked(common(sets[x], sets[y]), len(sets[x]), len(sets[y])):
                    links.append((x, y))
                    break
        left = left[~np.isin(left, inside)]
    return links


def _groups(*columns: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each group of equal values of the columns."""
    order = np.lexsort(columns)
    if len(order):
        new = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        yield from np.split(order, np.flatnonzero(new) + 1)


def _dealt(rows: DataFrame, weight: str, block: int, pack: int) -> DataFrame:
    """Members (owner, node, ...) of regions dealt out to groups of bounded weight.

    A region is cut in blocks of about ``block`` weight, and every two of its blocks i <= j are a group, so that all members meet; a region of one block is one group.
    Whole groups are dealt out to packs of at most about ``pack`` weight."""
    sizes = rows.groupBy("owner").agg(F.sum(weight).alias("weight")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("weight") / block)).cast("int"))
    total = sizes.agg(F.sum(F.col("weight") * F.col("blocks"))).first()[0] or 0
    packs = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // pack))
    placed = rows.join(sizes.drop("weight"), "owner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "blocks")
    return placed.withColumn("pack", F.pmod(F.xxhash64("owner", "i", "j"), F.lit(packs)).cast("int"))


def regions(sets: DataFrame, percent: int) -> DataFrame:
    """(owner, node, n): the nodes that meet at an owner's keys; members without another one of a size that can be linked are left out."""
    shown = sets.select("node", F.explode("shown").alias("key"))
    # a node has a key once, so two rows are two nodes
    owners = shown.groupBy("key").agg(F.min("node").alias("owner"), F.count(F.lit(1)).alias("uses")).filter("uses > 1").select("key", "owner")
    members = shown.join(owners, "key").select("owner", "node").distinct().join(sets.select("node", "n"), "node")
    # sizes in steps of slightly more than the largest ratio of linked sizes: linked sets lie in the same step or in two that follow
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent + 1e-4))).cast("int")
    placed = members.withColumn("band", F.explode(F.array(step, step + 1)))
    full = placed.groupBy("owner", "band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("owner", "band")
    return placed.join(full, ["owner", "band"]).select("owner", "node", "n").distinct()


def _ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    own = column.combine_chunks()
    return own.flatten().to_numpy(), own.offsets.to_numpy() - own.offsets[0].as_py()


def links(made: Tables, docs: DataFrame, sets: DataFrame, size: int, percent: int, often: np.ndarray, region: int = REGION, shown: int = SHOWN) -> DataFrame:
    """(a, b) links of nodes that connect all linked nodes; ``sets`` has node (a number), digest, rep (a document of it), n and shown of each node."""
    limit = Limit(percent)
    met = made.write(regions(sets, percent), "regions")
    payload = _dealt(met.withColumn("weight_shown", F.col("n") * (100 - percent) / 100 + 1), "weight_shown", shown, 2 * shown).drop("weight_shown")
    # the upper half of a key is enough here
    short = sets.select("node", F.transform("shown", lambda k: F.shiftright(k, 32).cast("int")).alias("shown"))
    payload = payload.join(short, "node")

    def hopeful(group: pa.Table) -> pa.Table:
        owner, i, j, node, n = (group[c].to_numpy() for c in ("owner", "i", "j", "node", "n"))
        flat, ends = _ragged(group["shown"])
        keep = np.zeros(len(node), bool)
        for rows in _groups(j, i, owner):
            if len(rows) > 1:
                keep[rows] = can_link([flat[ends[k] : ends[k + 1]] for k in rows], n[rows], limit)
        return pa.table({"owner": owner[keep], "node": node[keep], "n": n[keep]})

    alive = made.write(payload.groupBy("pack").applyInArrow(hopeful, "owner long, node long, n long").distinct(), "hopeful")
    made.drop("regions")
    wanted = made.write(sets.select("node", "digest", "rep").join(alive.select("node").distinct(), "node"), "wanted")
    ids, digests = wanted.select(F.col("rep").alias("doc_id")).distinct(), wanted.select("node", "digest")
    if wanted.count() <= BROADCAST_IDS:
        ids, digests = F.broadcast(ids), F.broadcast(digests)
    texts = docs.join(ids, "doc_id", "left_semi")
    # of a document in several versions, or repeated, all come along and the digest tells
    keys = made.write(whole_sets(texts, size, often).join(digests, "digest").select("node", "keys"), "whole-sets")
    made.drop("wanted")

    weights = alive.groupBy("owner").agg(F.sum("n").alias("weight"), F.min("node").alias("pivot"))
    small = alive.join(weights.filter(F.col("weight") <= region).select("owner"), "owner").select("owner", "node", "n")
    large = weights.filter(F.col("weight") > region)
    star, rest = None, small
    if not large.isEmpty():
        star, window = _first_pivots(made, alive.join(large, "owner"), keys, limit)
        rest = small.unionByName(window)
    members = _dealt(rest, "n", region, region).drop("n").join(keys, "node")

    def joined(group: pa.Table) -> pa.Table:
        owner, i, j, node = (group[c].to_numpy() for c in ("owner", "i", "j", "node"))
        flat, ends = _ragged(group["keys"])
        out = []
        for rows in _groups(j, i, owner):
            if len(rows) > 1:
                own = node[rows]
                out += [(own[x], own[y]) for x, y in region_links([flat[ends[k] : ends[k + 1]] for k in rows], limit)]
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": found.min(axis=1), "b": found.max(axis=1)})

    found = members.groupBy("pack").applyInArrow(joined, "a long, b long")
    out = made.write((found if star is None else found.unionByName(star)).distinct(), "links")
    made.drop("hopeful", "whole-sets", *(["first-pivots"] if star is not None else []))
    return out


def _first_pivots(made: Tables, large: DataFrame, keys: DataFrame, limit: Limit) -> tuple[DataFrame, DataFrame]:
    """Regions above a task's size take their first pivot row by row: links (a, b) of its core, and the members (owner, node, n) that go on.

    Those are the members outside the core, and of the core those in the window of any of them."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column("keys"), batch.column("theirs")):
                a, b = a.values.to_numpy(), b.values.to_numpy()
                both = common(a, b)
                out.append((1 - both / max(1, len(a) + len(b) - both), limit.linked(both, len(a), len(b))))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("owner", "node", "n", "pivot")), pa.array(list(columns[0]), pa.float64()), pa.array(list(columns[1]), pa.bool_())],
                ["owner", "node", "n", "pivot", "d", "core"],
            )

    measured = made.write(
        large.join(keys, "node").join(keys.select(F.col("node").alias("pivot"), F.col("keys").alias("theirs")), "pivot")
        .select("owner", "node", "n", "pivot", "keys", "theirs")
        .mapInArrow(distances, "owner long, node long, n long, pivot long, d double, core boolean"), "first-pivots",
    )
    e = (100 - limit.percent) / 100
    shell = measured.filter((~F.col("core")) & (F.col("d") <= 2 * e + 1e-9)).groupBy("owner").agg(F.min("d").alias("nearest"))
    window = measured.join(shell, "owner", "left").filter(~F.col("core") | (F.col("d") >= F.col("nearest") - e - 1e-9))
    star = measured.filter("core AND node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    return star, window.select("owner", "node", "n").distinct()


def components(made: Tables, edges: DataFrame) -> DataFrame:
    """(node, component) of all ends of edges (a, b): the smallest end that can be reached.

    Rounds of large and small stars: every node hands its larger, then its smaller neighbours to the smallest one it knows, until
    all edges are stars. A node's neighbours are never gathered; only their minimum is."""
    now = made.write(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges-0")
    before = None
    for turn in itertools.count(1):
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == (state["n"], state["s"]):
            break
        before = (state["n"], state["s"])
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("v"), F.col("m").alias("u")).filter("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v")
        now = made.write(
            small.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(small.select("v", F.col("m").alias("u"))).filter("u < v").distinct(), f"edges-{turn}"
        )
        made.drop(f"edges-{turn - 1}")
    return now.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, region: int = REGION, shown: int = SHOWN) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text), its mark and the node that names its component.

    The words of a text are the runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case; its set are the distinct runs of ``size`` words, or all
    words as one if there are fewer. Texts are linked whose sets agree by ``percent`` of their union; the component of a row is the smallest doc_id that links
    reach. Null and empty texts have no shingles and are linked with nothing. Rows of one id are joined each by its text. Rows without an id are
    not joined; their component is null. Repeated rows stay repeated, other columns are ignored."""
    bounded_batches(docs.sparkSession)
    base = docs.select("doc_id", "text", _mark(docs).alias("mark"))
    often = frequent(base, size)
    made, kept = Tables(docs.sparkSession), Tables(docs.sparkSession)
    wide = made.write(with_sets(base, size, percent, often), "wide")
    sets = kept.write(wide.drop("shown"), "sets")
    firsts = sets.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = (F.col("doc_id") == F.col("rep")) & (wide["digest"] == F.col("its"))
    # numbers are fixed by writing them; a repeated row gives a second node of its class, which is linked like any other
    nodes = made.write(
        wide.join(firsts.withColumnRenamed("digest", "its"), same).select("digest", "rep", F.col("n_shingles").alias("n"), "shown", F.monotonically_increasing_id().alias("node")), "nodes",
    )
    made.drop("wide")
    reps = made.write(nodes.select("node", "digest", "rep"), "reps")
    edges = links(made, base, nodes, size, percent, often, region, shown)
    made.drop("nodes")
    found = components(made, edges)
    placed = reps.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("rep").alias("least"))
    named = kept.write(placed.join(least, "component").groupBy(F.col("digest").alias("its")).agg(F.min("component").alias("component"), F.min("least").alias("least")), "named")
    made.drop()
    joined = F.col("doc_id").isNotNull()
    return sets.join(named, F.col("digest") == F.col("its"), "left").select(
        "doc_id", "n_shingles", F.when(joined, F.coalesce("least", "doc_id")).alias("component_id"),
        "mark", F.when(joined, F.col("component")).alias("component"),
    )


def _mark(docs: DataFrame) -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """All columns of the rows of ``docs`` that stay: of each component the document with the smallest id, and every row that is not joined.

    Repeated rows of one id and text are one document and stay or go together; of texts of one id that are linked, one stays."""
    found = join(docs, size, percent)
    chosen = found.groupBy("component", F.when(F.col("component").isNull(), F.col("mark")).alias("alone")).agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    marks = chosen.select(F.col("first.mark").alias("__mark")).distinct()
    return docs.join(marks, _mark(docs) == F.col("__mark"), "left_semi")


@query("op3_metric_regions")
def op3(spark, sf_dir):
    """The near-duplicate group of every document."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
