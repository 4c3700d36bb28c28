"""Collocations by top-order marginalisation.

A window is led by every word: the word and up to three that follow it in its piece, padded at the end of the piece. Only these longest windows are
counted; ROLLUP sums them to the counts of all shorter phrases (a phrase's count is the sum over the windows that it leads), up to the words of a language.

A phrase that is frequent has frequent pairs and triples of neighbours only, so a window may end before its first rare one without a change of any count that is used. Pairs,
and then the triples of frequent pairs, are counted by 64-bit keys for that, and the frequent ones become a bitmap of fixed size, which is broadcast. A key that falls on another one's bit
only keeps a window longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Tables, bounded_batches, gathered, lowered, mix, query, raw, slices, span_hashes, table, text_column

#: Words of the longest phrase.
ORDER = 4
#: Occurrences that a phrase has at least, phrases of a language, and the percentage of its occurrences that a longer one must cover to replace it.
LEAST, BEST, COVERED = 30, 2000, 80
#: A phrase of which all occurrences of both parts are its own scores half of this.
SCALE = 2_000_000
#: Bits of the bitmap of frequent pairs and triples (16 MB).
BITS = 1 << 27
#: Text of a task that is counted together, in bytes.
SLICE = 4 << 20
#: Parts of a language's candidates that are ranked apart first.
PARTS = 64
#: Stands in the columns behind the end of a window; no word is empty.
PAD = ""
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each word whether the next one follows in the same piece."""
    breaks = _BREAKS[data]
    inside = ~(breaks | (data == 32) | (data == 9))
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    starts, ends = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside) + 1
    seen = np.cumsum(breaks, dtype=np.int64)
    text = np.searchsorted(bounds, starts, "right")
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (seen[starts[1:]] == seen[starts[:-1]]) & (text[1:] == text[:-1])
    return starts, ends, follows


class Words:
    """The words of some texts with their languages; a word of two languages is two words."""

    def __init__(self, part: pa.Table):
        data, bounds = raw(text_column(part))
        self.data = lowered(data)
        langs = part.column("lang").combine_chunks().cast(pa.large_string())
        langs = pa.concat_arrays(langs.chunks) if isinstance(langs, pa.ChunkedArray) else langs
        codes = langs.dictionary_encode()
        self.names = codes.dictionary.to_pylist()
        names, at = raw(codes.dictionary)
        of_lang = span_hashes(names, at[:-1], at[1:])
        number = codes.indices.to_numpy(zero_copy_only=False)
        found = []
        for first, last in slices(bounds):  # hashing takes many times the text's memory
            own, inner = self.data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
            starts, ends, follows = words_of(own, inner)
            lang = number[first + np.searchsorted(inner, starts, "right") - 1] if len(starts) else np.zeros(0, number.dtype)
            keys = mix(span_hashes(own, starts, ends) + of_lang[lang] * _ODD)
            found.append((starts + bounds[first], ends + bounds[first], follows, lang, keys))
        self.starts, self.ends, self.follows, self.lang, self.keys = map(np.concatenate, zip(*found))

    def pairs(self) -> np.ndarray:
        """Keys of the pairs led by each word but the last; without meaning where no word follows."""
        return mix(self.keys[:-1] * _ODD + self.keys[1:])

    def triples(self) -> np.ndarray:
        """Keys of the triples led by each word but the last two; without meaning where no two words follow."""
        return mix(self.pairs()[:-1] * _ODD + self.keys[2:])

    def paired(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words lead a pair that has its bit set, and which of them a triple of two such pairs."""
        pair = self.follows[:-1] & _has_bit(bits, self.pairs())
        return pair, pair[:-1] & pair[1:]

    def runs(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each number of words up to ORDER, which words lead such a run whose pairs and triples all have their bits set."""
        pair, triple = self.paired(bits)
        out = [np.ones(len(self.keys), bool), pair, triple]
        where = np.flatnonzero(triple)
        triple[where] = _has_bit(bits, self.triples()[where])
        while len(out) < ORDER:
            out.append(out[-1][:-1] & triple[len(out) - 2 :])
        return out


def _has_bit(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = (keys.view(np.int64) % (len(bits) * 8)).astype(np.int64)
    return (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def _frequent(docs: DataFrame, keys_of: Callable[[Words], np.ndarray], least: int) -> DataFrame:
    """The keys that occur ``least`` times, each slice's own counted in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, SLICE):
            own = Words(part)
            if len(own.keys) > 1:
                keys, n = np.unique(keys_of(own), return_counts=True)
                for k in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], ["key", "n"])
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def frequent_pairs(docs: DataFrame, least: int) -> DataFrame:
    """Keys of all pairs of neighbours that occur ``least`` times."""
    return _frequent(docs, lambda own: own.pairs()[own.follows[:-1]], least)


def frequent_triples(docs: DataFrame, bits: Broadcast, least: int) -> DataFrame:
    """Keys of the triples of neighbours that occur ``least`` times, of those whose two pairs have their bits set."""
    return _frequent(docs, lambda own: own.triples()[own.paired(bits.value)[1]], least)


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bytes in which the bit of each key (modulo ``bits``) is set: at most bits / 8 bytes reach the driver."""
    bit = F.pmod("key", F.lit(bits))
    rows = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("own"))
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in rows.collect():
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] |= np.frombuffer(row["own"], np.uint8)
    return out


def _window_rows(own: Words, alive: list[np.ndarray]) -> pa.RecordBatch:
    """(lang, w1, ..., n): distinct windows, each as long as its run is alive."""
    _, first, word = np.unique(own.keys, return_index=True, return_inverse=True)
    columns = np.zeros((ORDER, len(word)), np.int64)  # 0 is the pad
    for k in range(min(ORDER, len(word))):
        columns[k, : len(word) - k] = np.where(alive[k][: len(word) - k], word[k:] + 1, 0)
    key = columns[0]
    for k in range(1, ORDER):  # ranks of pairs, of triples, ... are smaller than the number of words: no product passes 64 bits
        key = np.unique(key * (len(first) + 1) + columns[k], return_inverse=True)[1]
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    used, place = np.unique(columns[:, at], return_inverse=True)
    texts = [PAD.encode()] if len(used) and used[0] == 0 else []
    texts += [own.data[own.starts[k] : own.ends[k]].tobytes() for k in first[used[used > 0] - 1].tolist()]
    texts = pa.array(texts, pa.binary()).cast(pa.string())
    langs = pa.array(own.names, pa.string()).take(pa.array(own.lang[at]))
    return pa.RecordBatch.from_arrays([langs, *(texts.take(pa.array(c)) for c in place.reshape(ORDER, -1)), pa.array(n)], ["lang", *_WORDS, "n"])


_WORDS = [f"w{k}" for k in range(1, ORDER + 1)]


def windows(docs: DataFrame, bits: Broadcast) -> DataFrame:
    """(lang, w1, ..., n) of the longest windows of each slice, padded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in gathered(batches, SLICE):
            own = Words(part)
            if len(own.keys):
                rows = _window_rows(own, own.runs(bits.value))
                for k in range(0, rows.num_rows, 1 << 15):
                    yield rows.slice(k, 1 << 15)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ", ".join(["lang string", *(f"{w} string" for w in _WORDS), "n long"]))


def phrases(counted: DataFrame, least: int) -> DataFrame:
    """(lang, words, f) of all phrases of up to ORDER words with ``least`` occurrences, and of each language as the phrase without words.

    ROLLUP runs over the windows of each length by itself, so that no group holds pads; what windows of several lengths lead is added up."""
    filled = [F.col(w) != PAD for w in _WORDS[1:]]
    parts = []
    for size in range(1, ORDER + 1):
        own = counted
        for k, full in enumerate(filled, 2):
            own = own.filter(full if k <= size else ~full)
        own = own.filter(F.col("w1") != PAD).rollup("lang", *_WORDS[:size]).agg(F.sum("n").alias("f")).filter(F.col("lang").isNotNull())
        if size == ORDER:  # only windows of this length have as many words
            own = own.filter(F.col(_WORDS[-1]).isNull() | (F.col("f") >= least))
        parts.append(own.select("lang", *(F.col(w) if k < size else F.lit(None).cast("string").alias(w) for k, w in enumerate(_WORDS)), "f"))
    sums = reduce(DataFrame.unionByName, parts).groupBy("lang", *_WORDS).agg(F.sum("f").alias("f"))
    return sums.filter((F.col("f") >= least) | F.col("w1").isNull()).select("lang", F.array_compact(F.array(*_WORDS)).alias("words"), "f")


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, words, phrase, a, l, r, score): each phrase of two words or more by its lowest cut."""
    several = grams.filter(F.size("words") > 1)
    cuts = several.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    cuts = cuts.withColumn("first", F.slice("words", F.lit(1), F.col("cut"))).withColumn("rest", F.slice("words", F.col("cut") + 1, F.size("words") - F.col("cut")))
    firsts = grams.select("lang", F.col("words").alias("first"), F.col("f").alias("l"))
    rests = grams.select("lang", F.col("words").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    lowest = F.min(F.struct(F.expr(f"CAST((CAST({SCALE} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) div CAST(l + r AS DECIMAL(38,0)) AS BIGINT)").alias("score"), "cut", "l", "r"))
    return both.groupBy("lang", "words", "a").agg(lowest.alias("low")).select("lang", "words", _joined(F.col("words")).alias("phrase"), "a", "low.l", "low.r", "low.score")


def covered(grams: DataFrame) -> DataFrame:
    """(lang, words, most): phrases of two words or more that lie in longer ones, and the count of the most frequent of these."""
    longer = grams.filter(F.size("words") > 2)
    parts = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("words") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.slice("words", i, k)),
    ))
    return longer.select("lang", F.explode(parts).alias("words"), "f").groupBy("lang", "words").agg(F.max("f").alias("most"))


def mine(docs: DataFrame, least: int = LEAST, best: int = BEST, cover: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of ``docs`` (lang, text).

    Texts are lowered (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and these into words at spaces and tabs. A phrase has 2 to ORDER words
    that follow each other in a piece, and at least ``least`` occurrences, a; l and r are those of its two parts at the cut with the lowest score, floor(SCALE * a / (l + r)), the first such
    cut on ties; n are all words of the language. Phrases inside a longer one with ``cover`` percent of their occurrences or more are left out. The ``best`` of a language by score, a (both
    falling) and phrase (in byte order) are ranked from 1.

    A null lang is ``und`` (together with texts that say so), a null text empty. Repeated rows count as often as they stand there; other columns are ignored, ids too; an
    empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    pairs = bitmap(frequent_pairs(own, least))
    bits = spark.sparkContext.broadcast(pairs)
    # one bitmap for both: a triple on a pair's bit only keeps windows longer
    both = pairs | bitmap(frequent_triples(own, bits, least))
    bits.unpersist()
    bits = spark.sparkContext.broadcast(both)
    made = Tables(spark)
    # each window once before ROLLUP expands them
    counted = made.write(windows(own, bits).groupBy("lang", *_WORDS).agg(F.sum("n").alias("n")), "windows")
    bits.unpersist()
    grams = Tables(spark).write(phrases(counted, least), "phrases")
    made.drop()
    hidden = covered(grams)
    found = scored(grams).join(hidden, ["lang", "words"], "left").filter(F.col("most").isNull() | (100 * F.col("most").cast("decimal(30,0)") < cover * F.col("a").cast("decimal(30,0)")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of parts first, so that no task ranks a whole language
    near = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = near.withColumn("near", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("near") <= best)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    totals = grams.filter(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query("op13_collocations", rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), listed AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM pieces
), led AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM listed
), runs AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM led, range(1, {ORDER + 1}) t(k) WHERE i + k - 1 <= len(words)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= {LEAST}
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM listed GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1
), divided AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(words[1 : j], ' ') AS head, array_to_string(words[j + 1 : k], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j, x.f AS l, y.f AS r, (({SCALE}::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM divided c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(words[i : i + m - 1], ' ') AS phrase, a AS longer FROM candidates, range(2, {ORDER}) t(m), range(1, {ORDER}) u(i) WHERE m < k AND i + m - 1 <= k
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest o
  WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = o.lang AND s.phrase = o.phrase AND 100 * s.longer >= {COVERED} * o.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang) WHERE rank <= {BEST}
""")
def op13(spark, sf_dir):
    """The best collocations of each language."""
    return mine(table(spark, sf_dir, "documents"))
