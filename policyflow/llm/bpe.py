"""BPE by tree concatenation.

A text is cut in halves, and these again, down to leaves of bounded length wherever the cuts fall. Leaves are encoded by
themselves (parts of long texts in different tasks), and neighbours are joined pairwise up the tree: a window of tokens
around the join is decoded and encoded again, and grows until its first tokens are the left side's own and its last tokens
the right side's own. Then everything outside the window stays as it is:

* Inside a piece of the pre-tokenizer, tokens are the encoding of their text if and only if every two neighbours are the
  encoding of their concatenation. Every two neighbours of the result stand side by side in the left, the window's or
  the right encoding.
* Piece bounds follow from the characters after the last common bound; where the overlap of OVERLAP tokens agrees, the window's
  bounds are those of the side.

Text without any white space needs no more than that, so no window has to hold a whole unsplit run.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, query, table, text_column

#: The pre-tokenizer's pieces (fixed value of this kind of tokenizer file).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of one leaf.
LEAF = 2048
#: Characters of the parts of a long text that are dealt out to different tasks.
PART = 1 << 16
#: Tokens that must agree on either side of a join, and tokens taken from either side at first.
OVERLAP, REACH = 8, 24


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of a byte-level BPE file; strings of special tokens in a text become these tokens, as with the file's own library."""

    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        to_byte = byte_characters()
        self.leaf, self.reach = leaf, reach
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.names = [str(i) for i in range(1 + max([*ranks.values(), *special.values()]))]

    def encode_leaf(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all")

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a text of any length."""
        if len(text) <= self.leaf:
            return self.encode_leaf(text)
        middle = len(text) // 2
        return self.join(self.encode(text[:middle]), self.encode(text[middle:]))

    def decode(self, ids: np.ndarray) -> str:
        return self.core.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two texts in one, from the encodings of both."""
        if not len(left) or not len(right):
            return left if len(left) else right
        reach = self.reach
        while True:
            a, before = self._window(left, max(0, len(left) - reach), -1)
            b, after = self._window(right, min(len(right), reach), 1)
            window = self.encode_leaf(before + after)
            agree_left = a == 0 or np.array_equal(window[:OVERLAP], left[a : a + OVERLAP])
            agree_right = b == len(right) or np.array_equal(window[-OVERLAP:], right[max(0, b - OVERLAP) : b])
            if agree_left and agree_right:
                return np.concatenate([left[:a], window, right[b:]])
            reach *= 2

    def _window(self, ids: np.ndarray, at: int, step: int) -> tuple[int, str]:
        """Text on the join's side of position ``at``, which moves away from the join until it lies between two characters."""
        while True:
            part = self.core.decode_bytes((ids[at:] if step < 0 else ids[:at]).tolist())
            try:
                return at, part.decode("utf-8")
            except UnicodeDecodeError:
                at += step


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def _summary(own: Codec, ids: np.ndarray) -> tuple[int, str, str, bytes]:
    digest = hashlib.sha256(",".join(map(own.names.__getitem__, ids.tolist())).encode()).hexdigest()
    return len(ids), digest, hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest(), ids.astype("<i4").tobytes()


SUMMARY = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", "ids binary"]


def encode(docs: DataFrame, path: str, keep_ids: bool = True, part: int = PART) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the
    token ids as little-endian 32-bit integers.

    Null texts count as empty, a null doc_id is kept, repeated rows stay repeated, other columns are ignored. Texts of up to
    ``part`` characters are encoded where they are read; longer ones are dealt out in parts and joined per text: what is
    gathered in one task is the result row of one text.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = ", ".join(["doc_id long", *(SUMMARY if keep_ids else SUMMARY[:-1])])
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary())][: 5 if keep_ids else 4])

    def rows(doc_ids: list, found: list[np.ndarray]) -> pa.RecordBatch:
        own = codec(path)
        columns = list(zip(*(_summary(own, ids) for ids in found))) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip([doc_ids, *columns], arrow)], schema=arrow)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.slice(at, 64)
                yield rows(some.column("doc_id").to_pylist(), [own.encode(t) for t in text_column(some).to_pylist()])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t).astype("<i4").tobytes() for t in text_column(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("copies"), batch.column("part"), pa.array(ids, pa.binary())], ["doc_id", "text_hash", "copies", "part", "ids"])

    def joined(group: pa.Table) -> pa.Table:
        own = codec(path)
        order = np.argsort(group["part"].to_numpy())
        level = [np.frombuffer(group["ids"][int(k)].as_py(), "<i4").astype(np.uint32) for k in order]
        while len(level) > 1:
            level = [own.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        copies = group["copies"][0].as_py()
        return pa.Table.from_batches([rows([group["doc_id"][0].as_py()] * copies, level * copies)])

    short = texts.filter(F.length("text") <= part).mapInArrow(whole, schema)
    leaves = (
        texts.filter(F.length("text") > part)
        .groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("text_hash", F.sha2("text", 256))
        .select(
            "doc_id", "text_hash", "copies",
            F.explode(F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / part).cast("int") - 1), lambda k: F.struct(k.alias("part"), F.col("text").substr(k * part + 1, F.lit(part)).alias("text")))).alias("x"),
        ).select("doc_id", "text_hash", "copies", "x.part", "x.text")
    )
    long = (
        leaves.repartition("doc_id", "part").mapInArrow(parts, "doc_id long, text_hash string, copies long, part int, ids binary")
        .groupBy("doc_id", "text_hash").applyInArrow(joined, schema)
    )
    return short.unionByName(long)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows that ``encode`` gave with their ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if x is None else own.decode(np.frombuffer(x, "<i4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary package keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_tree_bpe")
def op9(spark, sf_dir):
    """Every text encoded and decoded: token count and digests of ids and decoded text."""
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), keep_ids=False)
