"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded by surface features; gated attention weighs the
encoded passages, and the weighted sum is scored. Only document labels are known: attention and scorer are learned from them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, fold, lowered, query, raw, slices, span_hashes, table, text_column, word_spans

#: Words of a passage.
PASSAGE_WORDS = 64
#: Labelled documents learned from, by hash of the id, and bytes of all their texts; every one of them is learned from whole.
LEARN_DOCS, LEARN_BYTES = 3000, 128 << 20
HIDDEN, GATE = 24, 16
#: Passes over the sample, documents of one step, and the step's size.
PASSES, STEP_DOCS, RATE, DECAY = 16, 128, 0.01, 1e-4
SEED = 5

#: Byte classes that are counted: each printable ASCII sign by itself, letters by case, digits, line ends, other white space, other bytes.
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS = np.full(256, 5, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[10] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS))
N_CLASSES = 6 + len(_SIGNS)
N_LENGTHS = 8
#: Class shares, shares of word lengths, mean length, distinct share, repeated neighbours, words in capitals, words that end in two signs, sentence ends.
N_FEATURES = N_CLASSES + N_LENGTHS + 6


def passages(data: np.ndarray, bounds: np.ndarray, size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts in order, and the bounds of each text in them. A text without words has one passage of zeros."""
    starts, ends = word_spans(data, bounds)
    at = np.searchsorted(starts, bounds)
    n_words = np.diff(at)
    counts = np.maximum(1, -(-n_words // size))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    n = int(out_bounds[-1])
    doc = np.repeat(np.arange(len(n_words)), n_words)
    passage = out_bounds[doc] + (np.arange(len(starts)) - at[doc]) // size
    features = np.zeros((n, N_FEATURES))
    if not len(starts):
        return features, out_bounds
    words = np.bincount(passage, minlength=n).astype(float)
    per_word = 1 / np.maximum(words, 1)
    # bytes from a word's start to the next word of the text belong to its passage
    owner = np.repeat(passage, np.diff(np.append(starts, len(data))))
    seen = data[starts[0] :]
    by_class = np.bincount(owner * N_CLASSES + _CLASS[seen], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    features[:, :N_CLASSES] = by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1)
    lengths = ends - starts
    lengths_of = np.minimum(np.maximum(np.ceil(np.log2(lengths + 1) * 1.5).astype(int) - 1, 0), N_LENGTHS - 1)
    k = N_CLASSES
    features[:, k : k + N_LENGTHS] = np.bincount(passage * N_LENGTHS + lengths_of, minlength=n * N_LENGTHS).reshape(n, N_LENGTHS) * per_word[:, None]
    k += N_LENGTHS
    features[:, k] = np.bincount(passage, lengths, n) * per_word / 10
    hashes = span_hashes(lowered(data), starts, ends)
    order = np.lexsort((hashes, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    features[:, k + 1] = np.bincount(passage[order], fresh, n) * per_word
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    features[:, k + 2] = np.bincount(passage, same, n) * per_word
    capital = np.concatenate([[0], np.cumsum(_CLASS[data] == 1)])
    features[:, k + 3] = np.bincount(passage, ((capital[ends] - capital[starts]) * 2 > lengths) & (lengths > 1), n) * per_word
    sign = np.concatenate([[0], np.cumsum(_CLASS[data] >= 6)])
    features[:, k + 4] = np.bincount(passage, (sign[ends] - sign[np.maximum(ends - 2, starts)]) == 2, n) * per_word
    features[:, k + 5] = np.bincount(passage, np.isin(data[ends - 1], [33, 46, 63]), n) * per_word
    return features, out_bounds


class Attention:
    """Encoder, gated attention and scorer, as plain arrays."""

    def __init__(self, n: int = N_FEATURES, hidden: int = HIDDEN, gate: int = GATE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        wide = lambda a, b: draw.standard_normal((a, b)) / np.sqrt(a)
        self.mean, self.spread = np.zeros(n), np.ones(n)
        self.parts = [wide(n, hidden), np.zeros(hidden), wide(hidden, gate), wide(hidden, gate), draw.standard_normal(gate) / np.sqrt(gate), draw.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def scores(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """From 0 to 1 for each bag of passages."""
        return self.forward(self.scaled(x), bounds)[-1]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple:
        w, b, v, u, a, c, d = self.parts
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ a
        first, n = bounds[:-1], np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        weight = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(h * weight[:, None], first, axis=0)
        score = 1 / (1 + np.exp(-(z @ c + d)))
        return h, t, s, weight, z, score

    def gradients(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray, pull: np.ndarray) -> list[np.ndarray]:
        w, b, v, u, a, c, d = self.parts
        h, t, s, weight, z, score = self.forward(x, bounds)
        first, n = bounds[:-1], np.diff(bounds)
        by_bag = (score - label) * pull
        by_z = np.repeat(by_bag[:, None] * c, n, axis=0)
        by_weight = (by_z * h).sum(axis=1)
        inner = np.add.reduceat(by_weight * weight, first)
        by_e = weight * (by_weight - np.repeat(inner, n))
        by_t, by_s = by_e[:, None] * a * s * (1 - t**2), by_e[:, None] * a * t * s * (1 - s)
        by_h = (by_z * weight[:, None] + by_t @ v.T + by_s @ u.T) * (1 - h**2)
        return [x.T @ by_h, by_h.sum(axis=0), h.T @ by_t, h.T @ by_s, (t * s).T @ by_e, z.T @ by_bag, by_bag.sum(keepdims=True)]

    def fit(self, bags: list[np.ndarray], label: np.ndarray, passes: int = PASSES) -> Attention:
        """Adam over shuffled steps of STEP_DOCS documents; the rarer label pulls more, by a factor of three at most."""
        everything = np.concatenate(bags)
        self.mean, self.spread = everything.mean(axis=0), everything.std(axis=0) + 1e-3
        bags = [self.scaled(b) for b in bags]
        share = np.clip(label.mean(), 0.25, 0.75)
        pull = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
        first, second = [np.zeros_like(p) for p in self.parts], [np.zeros_like(p) for p in self.parts]
        draw, k = np.random.default_rng(SEED), 0
        for _ in range(passes):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), STEP_DOCS):
                some, k = order[at : at + STEP_DOCS], k + 1
                x, bounds = np.concatenate([bags[i] for i in some]), np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
                for p, g, m1, m2 in zip(self.parts, self.gradients(x, bounds, label[some], pull[some] / len(some)), first, second):
                    g = g + DECAY * p
                    m1 += 0.1 * (g - m1)
                    m2 += 0.001 * (g * g - m2)
                    p -= RATE * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        return self


def learn(docs: DataFrame, labels: DataFrame, at_most: int = LEARN_DOCS, at_most_bytes: int = LEARN_BYTES) -> Attention | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality 0 or 1); None if there is nothing to learn from.

    Learned from all passages of about ``at_most`` labelled documents, the first by a hash of the id; fewer where their texts come to more than
    ``at_most_bytes``, but one at least: a bounded sample, fitted on the driver. Null labels teach nothing; of repeated labels the largest counts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    some = known.filter(place < F.lit(min(1.0, at_most / max(n, 1)))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # about at_most rows of two numbers
    bags = docs.filter(place < F.lit(min(1.0, at_most / max(n, 1)))).select("doc_id", "text").join(F.broadcast(some), "doc_id")
    sizes = bags.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("bytes")).withColumn("place", place).orderBy("place", "doc_id").toPandas()
    over = np.flatnonzero(sizes["bytes"].fillna(0).cumsum().to_numpy()[1:] > at_most_bytes)
    if len(over):
        last = sizes.iloc[int(over[0])]
        bags = bags.filter((place < float(last["place"])) | ((place == float(last["place"])) & (F.col("doc_id") <= int(last["doc_id"]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = raw(text_column(batch))
            out = []
            for first, last in slices(bounds):
                x, at = passages(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                for a, b in zip(at[:-1], at[1:]):
                    out.append(x[a:b].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(out, pa.binary())], ["doc_id", "quality", "bag"])

    rows = sorted(bags.mapInArrow(run, "doc_id long, quality int, bag binary").collect(), key=lambda r: (r["doc_id"], bytes(r["bag"])))
    if not rows:
        return None
    x = [np.frombuffer(r["bag"], "<f4").reshape(-1, N_FEATURES).astype(np.float64) for r in rows]
    return Attention().fit(x, np.array([float(r["quality"]) for r in rows]))


def score(docs: DataFrame, model: Attention | None, keep: bool = False, into: str = "score") -> DataFrame:
    """Score from 0 to 1 of every row of docs (doc_id, text), from its whole text: doc_id, score; with ``keep``, all columns and score,
    which is named ``into``.

    Null texts are empty, and an empty text is a bag of one passage of zeros; without a model every score is 0.5. Null ids and repeated
    rows are kept. With ``keep`` a column of the name ``into`` is replaced."""
    bounded_batches(docs.sparkSession)
    chosen = docs.drop(into) if keep else docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = raw(text_column(batch))
            found = [np.zeros(0)]
            for first, last in slices(bounds):
                x, at = passages(data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                found.append(np.full(last - first, 0.5) if model is None else model.scores(x, at))
            columns = batch.columns if keep else [batch.column("doc_id")]
            names = batch.schema.names if keep else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found), pa.float64())], [*names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema) if keep else "doc_id long"
    return chosen.mapInArrow(run, f"{schema}, `{into}` double")


def fitted(docs: DataFrame, labels: DataFrame) -> Attention | None:
    """The model of the query and the pipeline: learned from labels whose fold is not 1."""
    return learn(docs, labels.filter(fold("doc_id", 3) != 1))


@query("op6_attention_bags")
def op6(spark, sf_dir):
    """Quality of every document, learned from labelled documents whose fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
