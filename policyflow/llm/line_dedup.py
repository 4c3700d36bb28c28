"""Line dedup by patience alignment with the owners of shared lines.

Every line that several documents share has an owner: the document with the smallest id. A shared line pairs a later document with its owner, whatever its number of occurrences, so a group of copies is
a star around its owner and is never paired among itself; rare lines find the pairs that overlap in passages, frequent ones add the pair of document and
owner that they stand for. A pair is aligned by patience diff over the lines that both have and the owner owns, then again over what is not aligned yet, until all is: blocks in crossed order
and passages that stand twice come in a later round. Consecutive aligned lines of at least MIN_WORDS words are deleted from the later document. A line's owner never
loses it, so one copy of everything stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Tables, bounded_batches, query, table

#: Words that a deleted block has at least.
MIN_WORDS = 5
#: Patience diffs of one pair, one after the other.
ROUNDS = 8


def _lis(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of pairs, sorted by the first, that also rises in the second."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(q)
            piles.append(k)
        else:
            tops[pile], piles[pile] = q, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: Sequence[int], b: Sequence[int], blank: int | None = None) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: equal ends, lines that are unique in both as anchors, and the same again between the anchors.

    ``blank`` is never an anchor. Where a range has no anchor, only its equal ends are aligned."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[k]: k for k in range(b0, b1) if in_b[b[k]] == 1}
        anchors = _lis([(k, place[a[k]]) for k in range(a0, a1) if a[k] != blank and in_a[a[k]] == 1 and a[k] in place])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(edges, edges[1:])]
    return out


def _line_hashes(text: Column) -> Column:
    """A hash per line without its outer white space; 0 for a blank line."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(F.translate(x, "\t\r", "  ")) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(F.trim(F.translate(x, "\t\r", "  ")))))


def rounds(theirs: list[int], own: list[int]) -> Iterator[list[int]]:
    """Places in ``own`` that patience diff aligns with ``theirs``, then those that it aligns of the rest, and so on until all lines that both have are aligned.

    Where no line of the rest is unique in both, or after ROUNDS of it (lines in reversed order align one by one), the runs of the rest go with the first places that they
    have in ``theirs``."""
    have = set(theirs)
    left = [k for k, h in enumerate(own) if h in have]
    for _ in range(ROUNDS):
        marks = {left[q] for _, q in patience(theirs, [own[k] for k in left])}
        if not marks:
            break
        yield sorted(marks)
        left = [k for k in left if k not in marks]
    if left:
        yield left


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document the lines that alignments with the owners of its shared lines find."""
    for batch in batches:
        out = []
        for shared in batch.column("shared").to_pylist():
            pairs: dict[int, list[dict]] = {}
            for line in shared:
                pairs.setdefault(line["owner"], []).append(line)
            marks: list[int] = []
            for lines in pairs.values():
                theirs = [x["h"] for x in sorted(lines, key=lambda x: x["place"])]
                theirs += [x["h"] for x in lines if x["times"] > 1]  # further places of a line: no anchor
                own = sorted((q, x["h"]) for x in lines for q in x["places"])
                for found in rounds(theirs, [h for _, h in own]):
                    marks += [own[k][0] for k in found]
            out.append(sorted(marks))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.list_(pa.int32()))], ["key", "marks"])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, h, place, times, places): the distinct lines of each document, with where and how often they stand."""
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in range(6)]
        for doc_id, key, own in zip(batch.column("doc_id").to_pylist(), batch.column("key").to_pylist(), batch.column("own")):
            hashes = own.values.to_numpy()
            at = np.flatnonzero(hashes)
            order = at[np.argsort(hashes[at], kind="stable")].astype(np.int32)
            h, start, times = np.unique(hashes[order], return_index=True, return_counts=True)
            for k, column in enumerate((np.full(len(h), doc_id), np.full(len(h), key), h, order[start], times.astype(np.int32), order)):
                out[k].append(column)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int32) for c in out]
        ends = np.concatenate([[0], np.cumsum(columns[4])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns[:5]), pa.ListArray.from_arrays(pa.array(ends), pa.array(columns[5]))], ["doc_id", "key", "h", "place", "times", "places"])


def marked(made: Tables, docs: DataFrame) -> DataFrame:
    """(key, marks): positions of lines that align with an earlier document's, by the key of a document, xxhash64(doc_id, text)."""
    base = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), _line_hashes(F.col("text")).alias("own"))
    lines = made.write(base.mapInArrow(_lines, "doc_id long, key long, h long, place int, times int, places array<int>"), "lines")
    owners = lines.groupBy("h").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place"), F.min_by("times", "doc_id").alias("times"))
    # as a table, so that the join deals out the rows of a line that stands in very many documents
    owners = made.write(owners.filter("owner < last").select("h", "owner", "place", "times"), "owners")
    shared = lines.select("doc_id", "key", "h", "places").join(owners, "h").filter("doc_id > owner")
    # the same row of documents that stand there twice is one
    pairs = shared.groupBy("key").agg(F.collect_set(F.struct("owner", "h", "place", "times", "places")).alias("shared"))
    found = made.write(pairs.mapInArrow(_aligned, "key long, marks array<int>"), "marks")
    made.drop("lines", "owners")
    return found


def _without(text: str, marks: set[int], min_words: int) -> tuple[str, int, int]:
    """The text without its marked blocks, its lines, and the lines deleted. Blank lines inside a block go with it."""
    lines = text.split("\n")
    words = [len(x.split()) for x in lines]
    gone: set[int] = set()
    block: list[int] = []

    def close() -> None:
        while block and not words[block[-1]]:
            block.pop()
        if sum(words[k] for k in block) >= min_words:
            gone.update(block)
        block.clear()

    for k in range(len(lines)):
        if k in marks and words[k] or block and not words[k]:
            block.append(k)
        else:
            close()
    close()
    return ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text), len(lines), len(gone)


def clean(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, others) with the text cleaned, then the numbers of its lines and of lines
    removed, named by ``counts``; one row per row.

    Rows without an id or a text stay as they are (no lines for a null text) and own no lines. Rows with the same id are versions of one document: they are not
    compared among themselves; repeated rows are treated alike. Lines are compared without outer blanks, tabs and carriage returns. A text all of whose lines go becomes
    empty. Columns with the names of the counts are replaced."""
    bounded_batches(docs.sparkSession)
    own = docs.drop(*counts)
    names = own.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    found = marked(Tables(docs.sparkSession), docs).select(F.col("key").alias("__key"), F.col("marks").alias("__marks"))
    rows = own.join(found, F.xxhash64(own["doc_id"], own["text"]) == F.col("__key"), "left").drop("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = [_without(t, set(m or ()), min_words) if t is not None else (None, 0, 0) for t, m in zip(texts, batch.column("__marks").to_pylist())]
            columns = [pa.array([x[0] for x in out], pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2))], [*names, *counts])

    return rows.mapInArrow(run, f"{fields}, `{counts[0]}` long, `{counts[1]}` long")


@query("op1_patience_lines")
def op1(spark, sf_dir):
    """Every document without the line blocks that it shares with earlier ones."""
    return clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
