"""Substring dedup by automata of repeated passages.

A window is SIZE consecutive words. A word goes if a window that covers it also starts in a document with a smaller id.

1. Profile. Each document gives its anchors: of the runs of SIZE / 2 words inside each window, the one with the least hash. Equal windows have equal
   anchors, so a window that recurs has an anchor that recurs. Documents with the same words are one class, of which the first goes on; all windows of the others start in it.
2. Confirmation. Windows with anchors that recur are counted by their own hash; the smallest document that has one owns it, if it is not the only one. Runs of
   owned windows are the recurring passages of the owner, cut so that each window lies in one piece.
3. Automata. Documents are dealt out to slices. A slice gets the pieces that its documents need, enters blocks of words of each, spaced so that every window holds one, in an
   Aho-Corasick automaton over word numbers, and streams its documents through it. Each hit is extended word by word in the piece; what reaches a window's length
   and belongs to a smaller document is covered. Words are compared as they are here: a hash never decides that something goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Tables, bounded_batches, query, raw, run_hashes, least_of, slices, span_hashes, table, text_column, word_spans

#: Words of a window.
SIZE = 50
#: Windows of a piece of a passage at most.
PIECE = 512
#: Text of a slice that is streamed through one automaton, in bytes.
SLICE = 4 << 20


class Runs:
    """Words of the texts of a batch slice: hashes of their windows, and the anchor of each window."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, size: int):
        self.size = size
        starts, ends = word_spans(data, bounds)
        self.words = span_hashes(data, starts, ends)
        self.at = np.searchsorted(starts, bounds)
        self.anchors = least_of(run_hashes(self.words, size // 2), size - size // 2 + 1).view(np.int64)

    def spans(self) -> Iterator[tuple[int, int]]:
        """First window and the one after the last, of each text."""
        for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist()):
            yield a, max(a, b - self.size + 1)

    def windows(self) -> np.ndarray:
        return run_hashes(self.words, self.size).view(np.int64)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def profile(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, n_words, words_sha256 (of the words joined by spaces) and anchors of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            data, bounds = raw(texts)
            for first, last in slices(bounds):
                own = Runs(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], size)
                anchors = [np.unique(own.anchors[a:b]) for a, b in own.spans()]
                words = pa.array([" ".join(_words(t)) for t in texts.slice(first, last - first).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("mark").slice(first, last - first), pa.array(np.diff(own.at)), words, _longs(anchors)],
                    ["doc_id", "mark", "n_words", "words", "anchors"],
                )

    rows = docs.mapInArrow(run, "doc_id long, mark long, n_words long, words string, anchors array<long>")
    return rows.select("doc_id", "mark", "n_words", F.sha2("words", 256).alias("words_sha256"), "anchors")


def _words(text: str) -> list[str]:
    """Words of a text: str.split() knows more kinds of white space than these."""
    return [w.decode() for w in text.encode().split()]


def shared_windows(docs: DataFrame, size: int) -> DataFrame:
    """(h, anchor, doc_id): the distinct windows of each row that have one of its ``shared`` anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = raw(text_column(batch))
            ids, shared = batch.column("doc_id").to_pylist(), batch.column("shared")
            for first, last in slices(bounds):
                own = Runs(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], size)
                windows, out = own.windows(), []
                for k, (a, b) in enumerate(own.spans(), first):
                    at = a + np.flatnonzero(np.isin(own.anchors[a:b], shared[k].values.to_numpy()))
                    h, once = np.unique(windows[at], return_index=True)
                    out.append((h, own.anchors[at[once]], np.full(len(h), ids[k])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["h", "anchor", "doc_id"])

    return docs.mapInArrow(run, "h long, anchor long, doc_id long")


def _pieces(windows: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """First and last window of the runs of windows that are owned, each at its first place, cut after PIECE of them."""
    places = np.flatnonzero(np.isin(windows, own))
    places = np.sort(places[np.unique(windows[places], return_index=True)[1]])
    out = []
    for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
        out += [(int(x[0]), int(x[-1])) for x in (run[k : k + PIECE] for k in range(0, len(run), PIECE)) if len(x)]
    return out


def passages(docs: DataFrame, size: int) -> DataFrame:
    """(owner, piece, words, anchors): pieces of the recurring passages that each row owns, by the window hashes in ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch)
            data, bounds = raw(texts)
            ids, marks, owned = batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), batch.column("own")
            for first, last in slices(bounds):
                runs = Runs(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first], size)
                windows, out = runs.windows(), []
                for k, (a, b) in enumerate(runs.spans(), first):
                    words = _words(texts[k].as_py())
                    for p, q in _pieces(windows[a:b], owned[k].values.to_numpy()):
                        out.append((ids[k], f"{marks[k]}:{p}", " ".join(words[p : q + size]), np.unique(runs.anchors[a + p : a + q + 1]).tolist()))
                yield pa.RecordBatch.from_pylist([dict(zip(("owner", "piece", "words", "anchors"), x)) for x in out], _PIECES)

    return docs.mapInArrow(run, "owner long, piece string, words string, anchors array<long>")


_PIECES = pa.schema([("owner", pa.int64()), ("piece", pa.string()), ("words", pa.string()), ("anchors", pa.list_(pa.int64()))])


class Automaton:
    """The pieces of a slice. Every ``size`` words of a piece hold one of its blocks, which are the patterns."""

    def __init__(self, owners: list[int], pieces: list[str], size: int):
        self.size, self.block = size, size // 2
        self.owners = owners
        self.numbers: dict[str, int] = {}
        self.pieces = [np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in p.split(" ")], np.int64) for p in pieces]
        places: dict[tuple, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.pieces):
            own = words.tolist()
            for at in range(0, len(own) - self.block + 1, size - self.block + 1):
                places.setdefault(tuple(own[at : at + self.block]), []).append((k, at))
        self.places = list(places.values())
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, pattern in enumerate(places):
            self.found.add_word(pattern, k)
        if places:
            self.found.make_automaton()

    def covered(self, doc_id: int, words: list[str]) -> np.ndarray:
        """Which words lie in a window that a piece of a smaller document has."""
        size, block = self.size, self.block
        starts = max(0, len(words) - size + 1)
        hit = np.zeros(starts, bool)
        if not starts or not self.places:
            return np.zeros(len(words), bool)
        get = self.numbers.get
        row = [get(w, 0) for w in words]
        text = np.array(row, np.int64)
        for end, pattern in self.found.iter(tuple(row)):
            x = end - block + 1
            near = hit[max(0, x + block - size) : x + 1]
            for k, at in self.places[pattern]:
                if near.all():  # each window that holds this block is known already
                    break
                if self.owners[k] >= doc_id:
                    continue
                piece = self.pieces[k]
                back, on = min(x, at), min(len(text) - x, len(piece) - at)
                other = np.flatnonzero(text[x - back : x] != piece[at - back : at])
                before = back - 1 - int(other[-1]) if len(other) else back
                other = np.flatnonzero(text[x + block : x + on] != piece[at + block : at + on])
                after = block + int(other[0]) if len(other) else on
                if before + after >= size:
                    hit[x - before : x + after - size + 1] = True
        edges = np.zeros(len(words) + 1, np.int64)
        at = np.flatnonzero(hit)
        edges[at] += 1
        edges[at + size] -= 1
        return np.cumsum(edges[:-1]) > 0


def streamed(texts: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, n_removed, kept) of the rows of ``texts`` (slice, doc_id, mark, text) that lose words; ``pieces``: (slice, owner, words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        automaton = Automaton(known["owner"].to_pylist(), known["words"].to_pylist(), size)
        out = []
        for doc_id, mark, text in zip(own["doc_id"].to_pylist(), own["mark"].to_pylist(), own["text"]) if known.num_rows else ():
            words = _words(text.as_py())
            gone = automaton.covered(doc_id, words)
            if gone.any():
                out.append((doc_id, mark, int(gone.sum()), " ".join(w for w, g in zip(words, gone.tolist()) if not g)))
        return pa.Table.from_pylist([dict(zip(schema.names, x)) for x in out], schema)

    return texts.groupBy("slice").cogroup(pieces.groupBy("slice")).applyInArrow(run, "doc_id long, mark long, n_removed long, kept string")


def located(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, mark (of the text), n_words, n_removed, words_sha256 (of all words, joined by spaces) and kept, of every row of ``docs`` (doc_id, text).

    ``kept`` are the words that stay, joined by one space; it is null where all stay. Words are the runs of bytes other than space and \\x09-\\x0D. Null texts have no
    words. Rows without an id lose nothing and own nothing; rows of one id are versions of one document and are not compared with each other; repeated rows
    are treated alike. Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    made = Tables(spark)
    base = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    rows = Tables(spark).write(profile(base, size), "profile")
    long = rows.filter((F.col("n_words") >= size) & F.col("doc_id").isNotNull())
    firsts = long.groupBy("words_sha256").agg(F.min("doc_id").alias("first_id"))

    anchors = made.write(
        long.join(firsts, "words_sha256").filter("doc_id = first_id").select("doc_id", "mark", F.explode("anchors").alias("anchor")), "anchors")
    recurring = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    shared = made.write(anchors.join(recurring, "anchor").groupBy("doc_id", "mark").agg(F.collect_list("anchor").alias("shared")), "shared")
    made.drop("anchors")
    texts = made.write(base.filter("text IS NOT NULL").join(shared, ["doc_id", "mark"]), "texts")
    made.drop("shared")

    windows = made.write(shared_windows(texts.select("doc_id", "text", "shared"), size), "windows")
    confirmed = made.write(
        windows.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").select("h", "owner"), "confirmed")
    needs = made.write(windows.join(confirmed, "h").filter("doc_id > owner").select("doc_id", "owner", "anchor").distinct(), "needs")
    made.drop("windows")
    own = confirmed.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list("h").alias("own"))
    pieces = made.write(passages(texts.select("doc_id", "mark", "text").join(own, "doc_id"), size), "pieces")
    made.drop("confirmed")

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, -(-int(total) // SLICE)))).cast("int").alias("slice")
    held = pieces.select("owner", "piece", F.explode("anchors").alias("anchor"))
    wanted = needs.join(held, ["owner", "anchor"]).select(dealt, "owner", "piece").distinct()
    placed = wanted.join(pieces.select("owner", "piece", "words").dropDuplicates(["owner", "piece"]), ["owner", "piece"]).select("slice", "owner", "words")
    cut = Tables(spark).write(streamed(texts.select(dealt, "doc_id", "mark", "text"), placed, size).dropDuplicates(["doc_id", "mark"]), "cut")
    made.drop()

    copy = (F.col("n_words") >= size) & (F.col("doc_id") > F.col("first_id"))
    return rows.join(firsts, "words_sha256", "left").join(cut, ["doc_id", "mark"], "left").select(
        "doc_id", "mark", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        "words_sha256", F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def clean(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, others), then n_words and n_removed; one row per row.

    A text that loses words becomes the others, joined by one space; all other texts stay as they are. Columns with the names of the counts are
    replaced. See ``located``."""
    own = docs.drop("n_words", "n_removed")
    found = located(own, size).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "n_words", "n_removed", F.col("kept").alias("__kept"))
    same = own["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(own["text"]) == F.col("__mark"))
    joined = own.join(found.dropDuplicates(["__id", "__mark"]), same, "left")
    return joined.select(*(F.coalesce("__kept", "text").alias("text") if c == "text" else own[c] for c in own.columns), "n_words", "n_removed")


@query("op11_repeated_passages", r"""
WITH listed AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM listed)
), owners AS (
  SELECT run, min(doc_id) AS owner FROM windows GROUP BY run HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN owners USING (run) WHERE doc_id > owner
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM listed
), kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS text FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM listed LEFT JOIN kept USING (doc_id)
""")
def op11(spark, sf_dir):
    """Every document without the passages of 50 words or more that an earlier one has."""
    found = located(table(spark, sf_dir, "documents"))
    kept = F.when(F.col("n_removed") > 0, F.sha2("kept", 256)).otherwise(F.col("words_sha256"))
    return found.select("doc_id", "n_words", "n_removed", kept.alias("kept_sha256"))
