"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point by a fixed rule. The vector of a letter trigram is
the product (binding) of its letters' vectors, each permuted by its place; a text's vector is the sum (bundle) of the vectors of all its
trigrams, and a language's prototype the sum of the normalised vectors of its learning texts. A text gets the language whose
prototype has the largest cosine with its vector.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, fold, query, table, text_column

#: Dimensions of the vectors.
DIM = 512
#: Learning texts per language; a bounded sample by hash of the id.
LEARN_TEXTS = 1000
#: The language of a text without letters.
NO_LANGUAGE = "und"
#: Letters share LETTERS vectors by code point; the scripts that such a number of code points spans do not collide.
LETTERS = 4096
SEED = 11


@functools.cache
def letter_numbers() -> np.ndarray:
    """For every code point: 0 if it is no letter, else the number of its vector, from 1 on."""
    out = np.zeros(0x110000, np.int64)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    out[points] = points % (LETTERS - 1) + 1
    return out


@functools.cache
def letter_vectors(dim: int = DIM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of the letters at the first, second and third place of a trigram; number 0 is the gap between words."""
    own = np.where(np.random.default_rng(SEED).random((LETTERS, dim)) < 0.5, -1, 1).astype(np.int8)
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def bundle(text: str, dim: int = DIM) -> np.ndarray | None:
    """The vector of a text; None if it has no letter. Case is folded, and all that is no letter is one gap."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = letter_numbers()[points]
    if not letters.any():
        return None
    letters = np.concatenate([[0], letters, [0]])
    letters = letters[np.concatenate([[True], (letters[1:] != 0) | (letters[:-1] != 0)])]
    codes, counts = np.unique((letters[:-2] * LETTERS + letters[1:-1]) * LETTERS + letters[2:], return_counts=True)
    return trigrams(dim).bundle(codes, counts)


class Trigrams:
    """Vectors of the trigrams met so far in this process, bound once each; forgotten when there are too many."""

    MOST = 1 << 16

    def __init__(self, dim: int):
        self.dim = dim
        self.codes, self.vectors = np.zeros(0, np.int64), np.zeros((0, dim), np.int8)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        first, second, third = letter_vectors(self.dim)
        return first[codes // (LETTERS * LETTERS)] * second[codes // LETTERS % LETTERS] * third[codes % LETTERS]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of sorted distinct codes, each as often as it counts."""
        at = np.searchsorted(self.codes, codes)
        fresh = codes[self.codes[np.minimum(at, len(self.codes) - 1)] != codes] if len(self.codes) else codes
        if len(fresh):
            if len(self.codes) + len(fresh) > self.MOST:
                self.codes, self.vectors = self.codes[:0], self.vectors[:0]
            new = fresh[: self.MOST] if len(self.codes) else codes[: self.MOST]
            places = np.searchsorted(self.codes, new)
            self.codes, self.vectors = np.insert(self.codes, places, new), np.insert(self.vectors, places, self.bind(new), axis=0)
            at = np.searchsorted(self.codes, codes)
        total, weights = np.zeros(self.dim, np.float32), counts.astype(np.float32)
        for k in range(0, len(codes), 256):
            part = slice(k, k + 256)
            own = self.vectors[at[part]] if len(codes) <= self.MOST else self.bind(codes[part])
            total += weights[part] @ own.astype(np.float32)
        return total


@functools.cache
def trigrams(dim: int) -> Trigrams:
    return Trigrams(dim)


def learn(docs: DataFrame, dim: int = DIM, texts_per_language: int = LEARN_TEXTS) -> dict[str, np.ndarray]:
    """Unit prototypes by language from docs (doc_id, text, lang); rows without a language or letters teach nothing.

    Of each language about ``texts_per_language`` texts are taken by a hash of the id, so what is gathered is bounded by the number of
    languages."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, texts_per_language / n))])
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / (1 << 30)
    some = known.filter(place < share[F.col("lang")]).select("lang", "text").repartition(spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), text_column(batch).to_pylist()):
                v = bundle(text, dim)
                if v is not None and (size := np.linalg.norm(v)) > 0:
                    sums[lang] = sums.get(lang, 0) + v / size
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.astype(np.float64).tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"]
        )

    out: dict[str, np.ndarray] = {}
    for row in sorted(some.mapInArrow(run, "lang string, v array<double>").collect(), key=lambda r: r["lang"]):
        out[row["lang"]] = out.get(row["lang"], 0) + np.array(row["v"])
    return {lang: v / np.linalg.norm(v) for lang, v in out.items() if np.linalg.norm(v) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text).

    The score is the cosine with the chosen prototype, 0 where it is negative; ties go to the first language by name. Null texts
    and texts without a letter are ``und`` with score 0, as all are if nothing was learned. Null ids and repeated rows are kept, other columns ignored."""
    bounded_batches(docs.sparkSession)
    names = sorted(prototypes)
    dim = len(prototypes[names[0]]) if names else DIM
    weights = np.array([prototypes[n] for n in names], np.float32).reshape(len(names), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in text_column(batch).to_pylist():
                v = bundle(text, dim) if names else None
                size = 0.0 if v is None else float(np.linalg.norm(v))
                if size == 0:
                    langs.append(NO_LANGUAGE)
                    scores.append(0.0)
                else:
                    cosines = weights @ v / size
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


@query("op7_hyperdimensional")
def op7(spark, sf_dir):
    """The language of every document, learned from those whose fold is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    return predict(docs, learn(docs.filter(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
