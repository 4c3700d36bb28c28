"""Katz backoff language model over word pairs.

Words and pairs are counted over all learning texts; every learned word has a symbol of its own. Pair counts are discounted by Good-Turing, what a
context saves goes to the words that it was not seen with, in proportion to their unigram probability, and the backoff weight makes each context
sum to one exactly. The unigrams back off once more, to the unknown symbol of the words that were not learned.

Documents are put into slices once: a table of distinct words and word numbers, which moves only twice, a share of the slices at a time: when the slices
are told the counts of their words over all slices, and when they are scored. Of its distinct words, and later of its distinct pairs, a slice gives a packed row to each
group, of which there are as many as the tokens need; a group adds up the counts of all slices and gives each slice its totals in the order in which it asked, and for pairs
also the sums of the contexts. A context that is very frequent is split over groups by its pairs; its sums are added up over the groups, and there are at most
MOST_SPLIT of them. A word or pair has at most one entry a slice, however often it occurs. Pairs are worked on in ROUNDS parts by their context, so that only one part of
them is under way at once. Nothing on the driver or in a broadcast grows with the vocabulary.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Tables, bounded_batches, fold, mix, query, raw, slices, table, text_column, word_hashes

#: Counts up to which Good-Turing discounts.
DISCOUNTED = 5
#: The end of a text and the beginning, among the word hashes.
END_HASH, BEGIN_HASH = np.uint64(0x5EED5EED5EED5EED), np.uint64(0x1BE91BE91BE91BE9)
#: Text of a slice, in bytes, and its most documents.
SLICE, SLICE_DOCS = 8 << 20, 1 << 15
#: Parts of the contexts, and of the slices.
ROUNDS, SHARES = 4, 4
#: Bits by which a pair's key turns its context.
TURN = 21
#: Tokens whose pairs make one group, occurrences of a context that are not split over groups, and most contexts that are.
GROUP, SPLIT, MOST_SPLIT = 1 << 20, 1 << 18, 1 << 13


class Slice:
    """Documents that one task works on together."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids: list = []
        self.learn: list[bool] = []
        self.words: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes with an end after every document, and the number of tokens of each document."""
        sizes = np.concatenate(self.sizes) + 1
        out = np.full(int(sizes.sum()), END_HASH)
        inside = np.ones(len(out), bool)
        inside[np.cumsum(sizes) - 1] = False
        out[inside] = np.concatenate(self.words)
        return out, sizes


def slices_of(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[Slice]:
    """Slices of about ``most`` bytes of the task's documents; numbers are the same whenever the task runs."""
    base = TaskContext.get().partitionId() << 32
    now = Slice(base)
    for batch in batches:
        texts = text_column(batch)
        data, bounds = raw(texts)
        ids, learn = batch.column("doc_id").to_pylist(), batch.column("learn").to_pylist()
        for first, last in slices(bounds):
            own = data[bounds[first] : bounds[last]]
            words, at = word_hashes(own, bounds[first : last + 1] - bounds[first])
            now.ids += ids[first:last]
            now.learn += [bool(x) for x in learn[first:last]]
            now.words.append(words)
            now.sizes.append(np.diff(at))
            now.bytes += len(own)
            if now.bytes >= most or len(now.ids) >= SLICE_DOCS:
                yield now
                now = Slice(now.number + 1)
    if now.ids:
        yield now


def _release() -> None:
    """Gives back what Arrow and the allocator keep for later: an executor's memory is shared by all of its workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: A slice: its share and numbers of tokens and distinct words; its distinct words, frequent ones first, the numbers of its tokens among them (lower and upper halves, so that
#: most bytes are alike), of each document the tokens, id, whether it has one and is learned from, and the learned counts of its words.
PACKED = "slice long, share int, n_tokens long, n_words long, words binary, low binary, high binary, sizes binary, ids binary, known binary, learn binary, counts binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in map(str.split, columns.split(", "))])


def share_of(number: int) -> int:
    return (number >> 32) % SHARES


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes()], pa.binary())


def sliced(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, learn) as slices; their words' counts are their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices_of(batches):
            tokens, sizes = part.tokens()
            words, numbers, uses = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-uses, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            words, numbers = words[order], rank[numbers]
            ids = np.array([i or 0 for i in part.ids], "<i8")
            learn = np.array(part.learn, bool)
            counts = np.bincount(numbers[np.repeat(learn, sizes)], minlength=len(words))
            fields = (words.astype("<u8"), (numbers & 0xFFFF).astype("<u2"), (numbers >> 16).astype("<u2"), sizes.astype("<i8"), ids, np.array([i is not None for i in part.ids], np.uint8), learn.astype(np.uint8), counts.astype("<i8"))
            yield pa.RecordBatch.from_arrays([pa.array([part.number]), pa.array([share_of(part.number)], pa.int32()), pa.array([len(tokens)]), pa.array([len(words)]), *map(_binary, fields)], schema=schema)
            _release()

    schema = _schema(PACKED)
    return docs.mapInArrow(run, PACKED)


class Open:
    """A slice that is worked on. Numbers of symbols are those of its words, and one more for the beginning."""

    def __init__(self, row: dict):
        self.number = row["slice"]
        self.words, self.sizes = np.frombuffer(row["words"], "<u8"), np.frombuffer(row["sizes"], "<i8")
        self.numbers = np.frombuffer(row["low"], "<u2").astype(np.int64) | np.frombuffer(row["high"], "<u2").astype(np.int64) << 16
        self.ids, self.known, self.learn = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], np.uint8) > 0, np.frombuffer(row["learn"], np.uint8) > 0
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.hashes = np.append(self.words, BEGIN_HASH).astype(np.uint64)

    def uses(self) -> np.ndarray:
        """How often each symbol was learned as a context: as often as itself, as every text has an end; and as many texts begin as end."""
        return np.append(self.counts, self.counts[self.words == END_HASH])

    def learned(self) -> np.ndarray:
        return np.repeat(self.learn, self.sizes)

    def pairs(self, turn: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens whose context belongs to a round; and the numbers of their contexts and of themselves, in one."""
        context = np.concatenate([[len(self.words)], self.numbers[:-1]])
        context[(np.cumsum(self.sizes) - self.sizes)[1:]] = len(self.words)
        at = np.flatnonzero((self.hashes % np.uint64(rounds) == turn)[context])
        return at, context[at] << 32 | self.numbers[at]

    def asked_words(self, groups: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words in the order of their groups; and the groups."""
        group = (mix(self.words) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        return order, group[order]

    def asked(self, pairs: np.ndarray, groups: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pairs whose context was learned, in the order of their groups; the groups; and where the runs of pairs of one context and group begin. Contexts with more uses than ``most`` are split."""
        uses = self.uses()
        own = np.flatnonzero(uses[pairs >> 32] > 0)
        context = pairs[own] >> 32
        split = mix(self.keys(pairs[own]).view(np.uint64)) % (uses[context] // most + 1).astype(np.uint64)
        group = (mix(mix(self.hashes[context]) + split) % np.uint64(groups)).astype(np.int32)
        order = np.argsort(group, kind="stable")
        context, group = context[order], group[order]
        begins = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (group[1:] != group[:-1]))[: len(group)])
        return own[order], group, begins

    def keys(self, pairs: np.ndarray) -> np.ndarray:
        context = self.hashes[pairs >> 32]
        return ((context << np.uint64(TURN) | context >> np.uint64(64 - TURN)) ^ self.hashes[pairs & 0xFFFFFFFF]).view(np.int64)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Open]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Open(batch.slice(k, 1).to_pylist()[0])


ASKED_WORDS = "slice long, part int, keys binary, n binary"
ASKED = "slice long, part int, keys binary, contexts binary, split binary, runs binary, n binary, of_word binary"


def _bounds(group: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of equal groups."""
    edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1)).tolist() if len(group) else []
    return list(zip(edges[:-1], edges[1:]))


def asked_words(parts: DataFrame, groups: int) -> DataFrame:
    """ASKED_WORDS: for each slice and group the words with their learned counts in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _opened(batches):
            order, group = part.asked_words(groups)
            words, n = part.words[order], part.counts[order].astype("<u4")
            for a, b in _bounds(group):
                yield pa.RecordBatch.from_arrays([pa.array([part.number]), pa.array([group[a]], pa.int32()), _binary(words[a:b]), _binary(n[a:b])], schema=schema)
            _release()

    schema = _schema(ASKED_WORDS)
    return parts.mapInArrow(run, ASKED_WORDS)


def asked_pairs(parts: DataFrame, turn: int, rounds: int, groups: int, most: int) -> DataFrame:
    """ASKED: for each slice and group the keys of the pairs, their contexts (each once, whether it is split, and the pairs that it has), learned counts in the slice and the counts of the second words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _opened(batches):
            at, own = part.pairs(turn, rounds)
            pairs, place = np.unique(own, return_inverse=True)
            n = np.bincount(place[part.learned()[at]], minlength=len(pairs))
            places, group, begins = part.asked(pairs, groups, most)
            pairs, n = pairs[places], n[places].astype("<u4")
            keys, of_word = part.keys(pairs), part.counts[pairs & 0xFFFFFFFF]
            context, split = part.hashes[pairs[begins] >> 32], (part.uses()[pairs[begins] >> 32] > most).astype(np.uint8)
            runs = np.diff(begins, append=len(pairs)).astype("<u4")
            for a, b in _bounds(group):
                c, d = np.searchsorted(begins, [a, b])
                fields = (keys[a:b], context[c:d], split[c:d], runs[c:d], n[a:b], of_word[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([part.number]), pa.array([turn * groups + group[a]], pa.int32()), *map(_binary, fields)], schema=schema)
            _release()

    schema = _schema(ASKED)
    return parts.mapInArrow(run, ASKED)


FEW = [f"n{r}" for r in range(1, DISCOUNTED + 2)]
#: Rows of slices (slice, part, totals: the counts of the keys that were asked for; sums: of the contexts, the pairs by small count and the unigram mass of the words seen
#: with them), of split contexts (context, its pairs by small count and its mass in the group) and of groups (keys by small count, all learned keys and their tokens).
COUNTED = ", ".join(["slice long, part int, totals binary, sums binary, context long", *(f"{c} long" for c in FEW), "mass double, keys long, tokens long"])


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The total of each key; a place of each learned key, and its total."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.add.reduceat(n[order], begins)
    totals = np.empty(len(keys), np.int64)
    totals[order] = np.repeat(total, np.diff(begins, append=len(keys)))
    return totals, order[begins][total > 0], total[total > 0]


def _arrays(rows: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in rows[column]]


def _counted(asked: pa.Table, totals: np.ndarray, learned: np.ndarray, sizes: list[int], sums: list[bytes] | None, of_split: dict) -> pa.Table:
    """COUNTED: rows of a group."""
    packed = []
    for k, size in zip(np.cumsum(sizes).tolist(), sizes):
        own = totals[k - size : k]
        packed.append((b"4" + own.astype("<u4").tobytes()) if own.max(initial=0) < 1 << 32 else (b"8" + own.astype("<i8").tobytes()))
    schema, slots, split = _schema(COUNTED), len(sizes), len(of_split.get("context", []))
    few = {c: int((learned == r).sum()) for r, c in enumerate(FEW, 1)} | {"keys": len(learned), "tokens": int(learned.sum())}
    own = {"slice": asked["slice"].combine_chunks(), "part": asked["part"].combine_chunks(), "totals": pa.array(packed, pa.binary()), "sums": pa.array(sums or [None] * slots, pa.binary())}
    columns = []
    for name, kind in zip(schema.names, schema.types):
        of_contexts = pa.array(of_split[name], kind) if name in of_split else pa.nulls(split, kind)
        columns.append(pa.concat_arrays([own.get(name, pa.nulls(slots, kind)), of_contexts, pa.array([few.get(name)], kind)]))
    return pa.Table.from_arrays(columns, schema=schema)


def counted_words(asked: DataFrame) -> DataFrame:
    """COUNTED: the counts of words over all slices."""

    def run(rows: pa.Table) -> pa.Table:
        keys = _arrays(rows, "keys", "<u8")
        totals, _, learned = _added(np.concatenate(keys), np.concatenate(_arrays(rows, "n", "<u4")).astype(np.int64))
        out = _counted(rows, totals, learned, [len(x) for x in keys], None, {})
        _release()
        return out

    return asked.groupBy("part").applyInArrow(run, COUNTED)


def counted(asked: DataFrame, model: Model) -> DataFrame:
    """COUNTED: the counts of pairs over all slices, and of each context its pairs by count and the unigram mass of the words seen with it; a context that is split has a row for each of its groups."""

    def run(rows: pa.Table) -> pa.Table:
        keys, contexts, runs = _arrays(rows, "keys", "<i8"), _arrays(rows, "contexts", "<u8"), np.concatenate(_arrays(rows, "runs", "<u4"))
        totals, one, learned = _added(np.concatenate(keys), np.concatenate(_arrays(rows, "n", "<u4")).astype(np.int64))
        context, place = np.unique(np.concatenate(contexts), return_inverse=True)
        of_pair, size = np.repeat(place.astype(np.int32), runs)[one], len(context)
        of_word = np.concatenate(_arrays(rows, "of_word", "<i8"))[one]
        few = [np.bincount(of_pair[learned == r], minlength=size) for r in range(1, DISCOUNTED + 2)]
        mass = np.bincount(of_pair, model.unigram(context[of_pair], of_word), size)
        split = np.zeros(size, bool)
        split[place] = np.concatenate(_arrays(rows, "split", "u1")) > 0
        sums = []
        for k, x in zip(np.cumsum([len(x) for x in contexts]).tolist(), contexts):
            own = place[k - len(x) : k]
            sums.append(b"".join(f[own].astype("<u4").tobytes() for f in few[:DISCOUNTED]) + mass[own].astype("<f8").tobytes())
        of_split = {"context": context[split].view(np.int64), "mass": mass[split], **{c: f[split] for c, f in zip(FEW, few)}}
        out = _counted(rows, totals, learned, [len(x) for x in keys], sums, of_split)
        _release()
        return out

    return asked.groupBy("part").applyInArrow(run, COUNTED)


def _totals(rows: pa.Table) -> np.ndarray:
    """The counts that a slice asked for; rows: COUNTED, in the order of their groups."""
    packed = [x.as_buffer() for x in rows["totals"]]
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<u4" if bytes(x[:1]) == b"4" else "<i8", offset=1) for x in packed)])


def discounts(of_counts: dict[int, int], upto: int = DISCOUNTED) -> np.ndarray:
    """Katz's factors for the counts 0 to ``upto``, from how many keys have each count; 1 where the formula has no valid value."""
    out = np.ones(upto + 1)
    n = [of_counts.get(r, 0) for r in range(upto + 2)]
    spare = (upto + 1) * n[upto + 1] / n[1] if n[1] else 1.0
    for r in range(1, upto + 1):
        if spare < 1 and n[r]:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare)
            out[r] = d if 0 < d <= 1 else 1.0
    return out


class Model:
    """Discounts and unigram probabilities by count: a few numbers, whatever the vocabulary."""

    def __init__(self, tokens: int, of_counts: dict[int, int]):
        """``of_counts``: how many words have each small count."""
        self.discount = discounts(of_counts)
        spare, self.total = sum(of_counts.get(r, 0) * r * (1 - self.discount[r]) for r in range(1, DISCOUNTED + 1)), float(tokens)
        if spare <= 1e-12:
            spare, self.total = 1.0, tokens + 1.0
        self.unknown = spare / self.total
        self.pair_discount = np.ones(DISCOUNTED + 1)

    def unigram(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        own = counts * np.where(counts <= DISCOUNTED, self.discount[np.minimum(counts, DISCOUNTED)], 1.0) / self.total
        # an end that was never learned is no unknown word: it has no mass
        return np.where((counts > 0) | (words == END_HASH), own, self.unknown)


def weighed(tokens: np.ndarray, few: list[np.ndarray], mass: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Norm and backoff weight of each context that was learned: of its tokens, its pairs by small count and the unigram mass of its words."""
    total, unseen = tokens.astype(np.float64), 1 - mass
    saved = sum((n * float(r * (1 - model.pair_discount[r])) for r, n in enumerate(few, 1)), np.zeros(len(total)))
    # a context that has saved nothing leaves the share of one more token
    norm = np.where(unseen > 1e-12, np.where(saved <= 1e-12, total + 1, total), total - saved)
    return norm, np.where(unseen > 1e-12, (1 - (total - saved) / norm) / np.where(unseen > 1e-12, unseen, 1.0), 0.0)


def recounted(parts: DataFrame, replies: DataFrame, groups: int) -> DataFrame:
    """The slices with the counts of their words over all slices; replies: COUNTED."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        part = Open(own.to_pylist()[0])
        counts = np.empty(len(part.words), "<i8")
        counts[part.asked_words(groups)[0]] = _totals(rows.sort_by("part"))
        out = own.set_column(own.column_names.index("counts"), "counts", _binary(counts)).cast(_schema(PACKED))
        _release()
        return out

    return parts.groupBy("slice").cogroup(replies.select("slice", "part", "totals").groupBy("slice")).applyInArrow(run, PACKED)


class Frequent:
    """Pairs by small count and mass of the contexts that are split, at most MOST_SPLIT."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r["context"])
        self.contexts = np.array([r["context"] for r in rows], np.int64)
        self.few = np.array([[r[c] for c in FEW[:DISCOUNTED]] for r in rows], np.float64).reshape(len(rows), DISCOUNTED).T
        self.mass = np.array([r["mass"] for r in rows], np.float64)


SCORES = "doc_id long, learn boolean, n_tokens long, n_known long, logs double, score double"


def by_document(parts: DataFrame, replies: DataFrame, model: Model, frequent: Frequent, rounds: int, groups: int, most: int) -> DataFrame:
    """SCORES: of each document its numbers of tokens, the sum of log10(count + 1/2) and that of Katz's log10 probabilities; replies: COUNTED of all rounds."""

    def run(own: pa.Table, rows: pa.Table) -> pa.Table:
        part = Open(own.to_pylist()[0])
        size, uses = len(part.sizes), part.uses()
        doc = np.repeat(np.arange(size, dtype=np.int32), part.sizes)
        score = np.zeros(size)
        rows = rows.sort_by("part")
        round_of = rows["part"].to_numpy() // groups
        for turn in range(rounds):
            at, tokens = part.pairs(turn, rounds)
            pairs, place = np.unique(tokens, return_inverse=True)
            places, _, begins = part.asked(pairs, groups, most)
            context = pairs[places[begins]] >> 32
            first, last = np.searchsorted(round_of, [turn, turn + 1])
            told = rows.slice(first, last - first)
            times = np.zeros(len(pairs), np.int64)
            times[places] = _totals(told)
            few, mass = [np.zeros((DISCOUNTED, 0))], [np.zeros(0)]
            for x in told["sums"]:
                packed = x.as_buffer()
                n = len(packed) // (4 * DISCOUNTED + 8)
                few.append(np.frombuffer(packed, "<u4", n * DISCOUNTED).reshape(DISCOUNTED, n))
                mass.append(np.frombuffer(packed, "<f8", n, 4 * DISCOUNTED * n))
            few, mass = np.concatenate(few, 1), np.concatenate(mass)
            split = np.flatnonzero(uses[context] > most)
            of_split = np.searchsorted(frequent.contexts, part.hashes[context[split]].view(np.int64))
            few[:, split], mass[split] = frequent.few[:, of_split], frequent.mass[of_split]
            norms, backoffs = np.ones(len(uses)), np.ones(len(uses))
            norms[context], backoffs[context] = weighed(uses[context], list(few), mass, model)
            context, word = pairs >> 32, pairs & 0xFFFFFFFF
            seen = times * np.where(times <= DISCOUNTED, model.pair_discount[np.minimum(times, DISCOUNTED)], 1.0) / norms[context]
            logs = np.log10(np.where(times > 0, seen, np.maximum(backoffs[context] * model.unigram(part.words[word], part.counts[word]), 1e-300)))
            score += np.bincount(doc[at], logs[place], size)
        known = np.bincount(doc, part.counts[part.numbers] > 0, size).astype(np.int64)
        logs = np.bincount(doc, np.log10(part.counts + 0.5)[part.numbers], size)
        out = pa.Table.from_arrays([pa.array(part.ids, mask=~part.known), pa.array(part.learn), pa.array(part.sizes), pa.array(known), pa.array(logs), pa.array(score)], schema=schema)
        _release()
        return out

    schema = pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64())])
    return parts.groupBy("slice").cogroup(replies.select("slice", "part", "totals", "sums").groupBy("slice")).applyInArrow(run, SCORES)


def score(docs: DataFrame, learn, rounds: int = ROUNDS, group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), the model being learned from the rows where the Column ``learn`` is true.

    doc_id, learn, n_tokens (words and one end), n_known (of words that were learned), train_tokens, base_score (add-half unigrams) and
    score (Katz), both sums of log10 probabilities over all tokens. Words are the runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case.
    Null texts are empty and have an end; a null ``learn`` is false; repeated rows and null ids are kept; other columns are ignored. With nothing
    learned, every word is unknown. An empty table gives no rows. ``group`` and ``split`` bound the groups of pairs, whatever they are the scores are the same."""
    bounded_batches(docs.sparkSession)
    made = Tables(docs.sparkSession)
    first = made.write(sliced(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))), "slices", compression="zstd")
    size = first.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words")).first()
    groups = (size["words"] or 0) // group + 1
    words = made.write(counted_words(asked_words(first, groups)), "words", compression="zstd")
    whole = words.filter("slice IS NULL").agg(*[F.sum(c).alias(c) for c in (*FEW, "keys", "tokens")]).first()
    tokens, distinct = int(whole["tokens"] or 0), int(whole["keys"] or 0)
    model = Model(tokens, {r: int(whole[c] or 0) for r, c in enumerate(FEW, 1)})
    in_share = F.pmod(F.shiftright("slice", 32), F.lit(SHARES))
    for share in range(SHARES):
        made.write(recounted(first.filter(F.col("share") == share), words.filter(in_share == share), groups), f"recounted-{share}", compression="zstd")
    made.drop("slices", "words")

    # at most as many pairs as tokens
    groups = (size["tokens"] or 0) // rounds // group + 1
    most = max(split, tokens // MOST_SPLIT)
    parts = made.read(*[f"recounted-{share}" for share in range(SHARES)])
    for turn in range(rounds):
        made.write(counted(asked_pairs(parts, turn, rounds, groups, most), model), f"counted-{turn}", compression="zstd")
    rows = made.read(*[f"counted-{turn}" for turn in range(rounds)])
    few = rows.filter("slice IS NULL AND context IS NULL").agg(*[F.sum(c).alias(c) for c in FEW]).first()
    model.pair_discount = discounts({r: int(few[c] or 0) for r, c in enumerate(FEW, 1)})
    frequent = Frequent(rows.filter("context IS NOT NULL").groupBy("context").agg(*[F.sum(c).alias(c) for c in (*FEW[:DISCOUNTED], "mass")]).collect())

    results = Tables(docs.sparkSession)
    for share in range(SHARES):
        results.write(by_document(made.read(f"recounted-{share}"), rows.filter(in_share == share), model, frequent, rounds, groups, most), f"scores-{share}")
        made.drop(f"recounted-{share}")
    made.drop()
    return results.read(*[f"scores-{share}" for share in range(SHARES)]).select(
        "doc_id", "learn", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (distinct + 1)))).alias("base_score"), "score",
    )


@query("op10_katz")
def op10(spark, sf_dir):
    """Log probability of every document under pairs learned from the documents whose fold is not 1."""
    found = score(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return found.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
