"""Benchmark passages in documents, found by CGK embedding and bit-sampling LSH.

Texts are sequences of normalised words. A random walk (CGK) turns a sequence into one of three times its length so that a small edit
distance becomes a small Hamming distance with good chance; sampled positions of the walk are the keys of hash tables. Windows of an
item's length are looked up in the tables of the items, walks are repeated until edited copies of items of that length reach the target recall (longer items
need more), and every candidate is verified by its exact word edit distance. For lengths that MOST_WALKS walks don't serve well enough, the item that the filter below names is verified at once.

Windows are taken where they can matter. Every edit breaks at most RUN of an item's runs of RUN words, so a window within k edits of an item of
n words holds at least n - RUN + 1 - RUN * k of its runs, and one of them stands in its place up to a shift of k. Windows without as many cannot match. Items
of fewer than RUN words have no edits to allow for and are found by equality.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, lowered, mix, query, raw, slices, span_hashes, table, text_column

#: Edits per word that an item may have undergone; items under six words must stand as they are.
RATE = 0.2
#: Words in a row that a window must have in common with an item.
RUN = 3
#: Sampled positions per table, tables per walk, most walks, and the recall that walks are repeated for.
SAMPLES, TABLES, MOST_WALKS, TARGET = 3, 4, 32, 0.99
#: Items that are shipped to every task at once; more items are worked on in several passes.
BLOCK_ITEMS = 20_000
#: Bytes of walks that are made together.
WALK_BYTES = 64 << 20
#: Ratio of the lengths that share their number of walks, and edited copies that tell it.
CLASS, COPIES = 1.15, 200
SEED = 3


def most_edits(n: int) -> int:
    return int(RATE * n) if n >= 2 * RUN else 0


def plain_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits (bytes over 127 are letters), in lower case, and the bounds of each text in them."""
    data = lowered(data)
    inside = ((data - np.uint8(97)) < 26) | (data >= 128) | ((data - np.uint8(48)) < 10)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    starts, ends = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1
    return span_hashes(data, starts, ends), np.searchsorted(starts, bounds)


def in_a_row(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        out = mix(out + words[j : j + len(out)])
    return out


def runs(words: np.ndarray) -> np.ndarray:
    return in_a_row(words, RUN)


def walk(windows: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CGK: for each seed, each window's words in the order of a walk that stays or moves on by a bit of word, step and seed.

    Shape (seeds, windows, 3 * length); steps past the end give 0."""
    count, n = windows.shape
    padded = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1)
    out = np.zeros((3 * n, len(seeds), count), np.uint64)
    at = np.zeros((len(seeds), count), np.int64)
    rows = np.arange(count)
    steps = mix(np.arange(1, 3 * n + 1, dtype=np.uint64))
    for step in range(3 * n):
        word = padded[rows, np.minimum(at, n)]
        out[step] = word
        at += (mix(word ^ (seeds[:, None] + steps[step])) & np.uint64(1)).astype(np.int64)
    return out.transpose(1, 2, 0)


class Tables:
    """Hash tables of the items of a block, and what it takes to look windows up."""

    def __init__(self, items: list[tuple[int, np.ndarray]], target: float = TARGET):
        self.items = [(i, w) for i, w in items if len(w) >= RUN]
        self.short: dict[int, dict[int, list[int]]] = {}
        for i, w in items:
            if 0 < len(w) < RUN:
                self.short.setdefault(len(w), defaultdict(list))[int(in_a_row(w, len(w))[0])].append(i)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            self.by_length[len(w)].append(k)
        draw = np.random.default_rng(SEED)
        self.seeds = draw.integers(0, 1 << 63, MOST_WALKS, dtype=np.uint64)
        self.places = {n: draw.integers(0, max(1, 2 * n), (MOST_WALKS, TABLES, SAMPLES)) for n in sorted(self.by_length)}
        self.walks = self._enough(target, draw)
        self.tables: dict[int, dict[int, list[int]]] = {}
        for n, own in self.by_length.items():
            if not self.walks[n]:
                continue
            found: dict[int, list[int]] = defaultdict(list)
            for k, keys in zip(own, self.keys(np.stack([self.items[k][1] for k in own]))):
                for key in keys.tolist():
                    found[key].append(k)
            self.tables[n] = found
        grouped: dict[int, set] = defaultdict(set)
        for k, (_, own) in enumerate(self.items):
            for o, r in enumerate(runs(own).tolist()):
                grouped[r].add((k, o))
        self.runs = np.array(sorted(grouped), np.uint64)
        self.posts = [sorted(grouped[int(r)]) for r in self.runs.tolist()]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.runs & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def keys(self, windows: np.ndarray, walks: int | None = None) -> np.ndarray:
        """One key per window and table: a hash of the sampled words, the table's number among them."""
        n = windows.shape[1]
        walks = self.walks[n] if walks is None else walks
        most = max(1, WALK_BYTES // (24 * n * walks))
        if len(windows) > most:
            return np.concatenate([self.keys(windows[k : k + most], walks) for k in range(0, len(windows), most)])
        walked = walk(windows, self.seeds[:walks])
        out = np.zeros((len(windows), walks * TABLES), np.uint64)
        for r in range(walks):
            for t in range(TABLES):
                key = np.full(len(windows), r * TABLES + t + 1, np.uint64)
                for p in self.places[n][r, t]:
                    key = mix(key + walked[r][:, p])
                out[:, r * TABLES + t] = key
        return out

    def _enough(self, target: float, draw: np.random.Generator) -> dict[int, int]:
        """For each length the walks after which copies of items with as many random edits as allowed share a table with the item often enough; 0 where
        MOST_WALKS are not enough. The longest of some similar lengths, which needs most, stands for all of them."""
        out: dict[int, int] = {}
        lengths = sorted(self.by_length, reverse=True)
        while lengths:
            n = lengths[0]
            alike = [m for m in lengths if m * CLASS >= n and bool(most_edits(m)) == bool(most_edits(n))]
            lengths = [m for m in lengths if m not in alike]
            walks = 1
            if most_edits(n):
                own = self.by_length[n]
                windows = []
                for k in range(COPIES):
                    item = self.items[own[k % len(own)]][1]
                    windows += [item, _edited(item, draw)]
                keys = self.keys(np.stack(windows), MOST_WALKS)
                same = keys[::2] == keys[1::2]
                first = np.where(same.any(axis=1), same.argmax(axis=1) // TABLES + 1, MOST_WALKS + 1)
                walks = int(max(1, np.quantile(first, target, method="higher")))
            out |= {m: walks if walks <= MOST_WALKS else 0 for m in alike}
        return out


def _edited(item: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """The item after as many random edits as are allowed, filled up or cut to its length."""
    copy = list(item)
    for _ in range(most_edits(len(item))):
        p, kind, new = int(draw.integers(0, len(copy))), int(draw.integers(0, 3)), np.uint64(draw.integers(0, 1 << 63))
        copy[p : p + 1] = {0: [], 1: [new], 2: [new, copy[p]]}[kind] if len(copy) > 1 else [new]
    copy = (copy + [np.uint64(draw.integers(0, 1 << 63)) for _ in item])[: len(item)]
    return np.array(copy, np.uint64)


def distance(item: list[int], words: list[int], bound: int) -> tuple[int, int]:
    """The least edit distance of the item to any run of the words, and where the first such run ends (bit-parallel, exact)."""
    n = len(item)
    where: dict[int, int] = defaultdict(int)
    for k, w in enumerate(item):
        where[w] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, now, best, end = full, 0, n, n, 0
    for k, w in enumerate(words):
        equal = where.get(w, 0)
        down_or_same = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (~(down_or_same | plus) & full), plus & down_or_same
        now += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(equal | minus | up) & full), up & (equal | minus)
        if now < best:
            best, end = now, k + 1
    return best, end


def matches(batch_words: list[np.ndarray], tables: Tables) -> list[list[tuple[int, int, int]]]:
    """(item id, least distance, first word of the window) for each item found in each of the texts."""
    todo: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for text, words in enumerate(batch_words):
        own = runs(words)
        some = np.flatnonzero(tables.bits[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(some) or not len(tables.runs):
            continue
        at = np.minimum(np.searchsorted(tables.runs, own[some]), len(tables.runs) - 1)
        good = tables.runs[at] == own[some]
        places: dict[int, list[int]] = defaultdict(list)
        starts: dict[int, set[int]] = defaultdict(set)
        for p, r in zip(some[good].tolist(), at[good].tolist()):
            for k, o in tables.posts[r]:
                if not places[k] or places[k][-1] != p:
                    places[k].append(p)
                starts[k].add(max(0, p - o))
        for k, seen in places.items():
            n = len(tables.items[k][1])
            edits = most_edits(n)
            least = max(1, n - RUN + 1 - RUN * edits)
            if len(seen) >= least:
                for start in starts[k]:
                    if bisect_left(seen, start + n + edits) - bisect_left(seen, start - edits) >= least:
                        todo[n].append((text, start, k))
    out: list[dict[int, tuple[int, int]]] = [{} for _ in batch_words]
    for n, places in todo.items():
        shift = most_edits(n)
        named: dict[tuple[int, int], set[int]] = defaultdict(set)
        for text, start, k in places:
            named[text, start].add(k)
        near = _looked_up(batch_words, sorted(named), n, tables) if tables.walks[n] else named
        for (text, start), found in near.items():
            for i in found:
                item_id, item = tables.items[i]
                around = batch_words[text][max(0, start - shift) : start + n + shift].tolist()
                least, _ = distance(item.tolist(), around, shift)
                if least <= shift and (least, start) < out[text].get(item_id, (shift + 1, 0)):
                    out[text][item_id] = (least, start)
    for n, known in tables.short.items():
        keys = np.array(sorted(known), np.uint64)
        for text, words in enumerate(batch_words):
            own = in_a_row(words, n)
            for at in np.flatnonzero(np.isin(own, keys)).tolist()[::-1]:
                for item_id in known[int(own[at])]:
                    out[text][item_id] = min(out[text].get(item_id, (0, at)), (0, at))
    return [[(i, d, s) for i, (d, s) in sorted(x.items())] for x in out]


def _looked_up(batch_words: list[np.ndarray], places: list[tuple[int, int]], n: int, tables: Tables) -> dict[tuple[int, int], set[int]]:
    """The items that share a table with the windows of ``n`` words at the places (text, first word)."""
    out: dict[tuple[int, int], set[int]] = defaultdict(set)
    found = tables.tables[n]
    size = max(1, WALK_BYTES // (8 * n))
    for k in range(0, len(places), size):
        part = places[k : k + size]
        windows = np.zeros((len(part), n), np.uint64)
        for row, (text, start) in enumerate(part):
            own = batch_words[text][start : start + n]
            windows[row, : len(own)] = own
        for place, keys in zip(part, tables.keys(windows).tolist()):
            out[place].update(i for key in keys if key in found for i in found[key])
    return out


def find(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, item_id, edits (words), item_words and at_word for every item that stands in a document's text within RATE edits per word.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Null texts are empty, rows without an item id take no part; rows of one
    item id are versions of it and the nearest counts. Items under RUN words are found by equality, wherever they stand; items without words nowhere. Case, punctuation and white space do not count. Repeated
    documents give repeated rows, null ids are kept, other columns ignored."""
    bounded_batches(docs.sparkSession)
    found = None
    for tables in _tables(benchmark, block_items):
        part = _found(docs.select("doc_id", "text"), tables)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item, by the same rules as ``find``. Nothing is shuffled."""
    bounded_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for tables in _tables(benchmark, block_items):

        def run(batches: Iterator[pa.RecordBatch], tables: Broadcast = docs.sparkSession.sparkContext.broadcast(tables)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not found for found in _matches_of(batch, tables.value)], pa.bool_()))

        docs = docs.mapInArrow(run, fields)
    return docs


def _tables(benchmark: DataFrame, block_items: int) -> Iterator[Tables]:
    """Tables of the items, at most about ``block_items`` of them at a time."""
    known = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    n_blocks = max(1, -(-known.count() // block_items))
    for block in range(n_blocks):
        rows = sorted(known.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect())
        words, at = plain_words(*raw(pa.array([r["text"] for r in rows], pa.large_string())))
        yield Tables([(r["item_id"], words[a:b]) for r, a, b in zip(rows, at[:-1], at[1:])])


def _matches_of(batch: pa.RecordBatch, tables: Tables) -> list[list[tuple[int, int, int]]]:
    data, bounds = raw(text_column(batch))
    out = []
    for first, last in slices(bounds):
        words, at = plain_words(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        out += matches([words[a:b] for a, b in zip(at[:-1], at[1:])], tables)
    return out


def _found(docs: DataFrame, tables: Tables) -> DataFrame:
    lengths = {i: n for n, known in tables.short.items() for ids in known.values() for i in ids}
    lengths |= {i: len(w) for i, w in sorted(tables.items, key=lambda x: len(x[1]))}
    # at most BLOCK_ITEMS items and their tables
    shipped = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            out = [(ids[k], i, d, lengths[i], s) for k, found in enumerate(_matches_of(batch, shipped.value)) for i, d, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in list(zip(*out)) or [()] * 5], ["doc_id", "item_id", "edits", "item_words", "at_word"])

    return docs.mapInArrow(run, "doc_id long, item_id long, edits long, item_words long, at_word long")


@query("op8_cgk_windows")
def op8(spark, sf_dir):
    """Benchmark items that stand in documents."""
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
