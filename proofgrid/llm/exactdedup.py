"""Exact duplicates by an exchange of compressed fingerprints.

Blocks of rows send the sorted fingerprints of their texts, Golomb coded, to the owners of fingerprint ranges. An
owner answers each block with a bitmap: which of its fingerprints are somewhere else too. Only rows whose bit is set,
or whose fingerprint occurs twice in the block, are suspects; only their texts are shuffled and compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm import golomb
from proofgrid.plans.storage import stored

BLOCK_ROWS = 1 << 16  # rows whose fingerprints are sent together
OWNER_ROWS = 1 << 21  # fingerprints that an owner compares at once
SPARE_BITS = 12  # beyond one fingerprint per row: about one text in 2**12 is a suspect without a copy
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def normalised(text: str | None) -> bytes:
    """UTF-8 bytes of the text with A-Z in lower case; null is empty."""
    return (text or "").encode().translate(_LOWER)


def fingerprint_bits(n_rows: int) -> int:
    return min(64, max(16, math.ceil(math.log2(n_rows + 1)) + SPARE_BITS))


def _prints(digests: np.ndarray, bits: int) -> np.ndarray:
    """The first ``bits`` bits of each digest (rows of 32 bytes)."""
    first = np.ascontiguousarray(digests[:, :8]).view(">u8").ravel().astype(np.uint64)
    return first >> np.uint64(64 - bits)


def _owners(prints: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Which of ``owners`` equal ranges each fingerprint falls into; ascending as the fingerprints are."""
    return ((prints >> np.uint64(max(0, bits - 32))) * np.uint64(owners)) >> np.uint64(min(bits, 32))


def hashed_blocks(docs: DataFrame) -> DataFrame:
    """One row per block: its ids and the SHA-256 of its texts, both in the order of its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, digests = TaskContext.get().partitionId() << 32, [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "block": pa.array([first], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "digests": pa.array([b"".join(digests)], pa.binary()),
            })

        for batch in batches:
            ids += batch["doc_id"].to_pylist()
            digests += [hashlib.sha256(normalised(t.as_py())).digest() for t in batch["text"]]
            if len(ids) >= BLOCK_ROWS:
                yield block()
                first, ids, digests = first + 1, [], []
        if ids:
            yield block()

    return docs.mapInArrow(run, "block long, ids array<long>, digests binary")


def _block_prints(digests: bytes, bits: int) -> np.ndarray:
    return _prints(np.frombuffer(digests, np.uint8).reshape(-1, 32), bits)


def sent(blocks: DataFrame, bits: int, owners: int) -> DataFrame:
    """Rows (owner, block, code): the block's distinct fingerprints in the owner's range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, digests in zip(batch["block"].to_pylist(), batch["digests"], strict=True):
                prints = np.unique(_block_prints(digests.as_py(), bits))
                to = _owners(prints, bits, owners)
                cuts = np.flatnonzero(np.diff(to, prepend=to[:1] + np.uint64(1)))
                parts = np.split(prints, cuts[1:])
                yield pa.RecordBatch.from_pydict({
                    "owner": pa.array(to[cuts].astype(np.int32)), "block": pa.array([block] * len(cuts), pa.int64()),
                    "code": pa.array([golomb.encode(part) for part in parts], pa.binary()),
                })

    return blocks.select("block", "digests").mapInArrow(run, "owner int, block long, code binary")


def answers(codes: DataFrame) -> DataFrame:
    """Rows (block, owner, bitmap) for blocks that share a fingerprint with another; ``codes`` come sorted by owner.

    A bit stands for each fingerprint that the block sent, in its order.
    """

    def compare(at: int, blocks: list[int], codes: list[bytes]) -> pa.RecordBatch:
        parts = [golomb.decode(code) for code in codes]
        prints = np.concatenate(parts)
        order = np.argsort(prints, kind="stable")
        same = np.diff(prints[order]) == 0
        twice = np.zeros(len(prints), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        found = [
            (block, np.packbits(bits).tobytes())
            for block, bits in zip(blocks, np.split(twice, np.cumsum([len(p) for p in parts])[:-1]), strict=True)
            if bits.any()
        ]
        return pa.RecordBatch.from_pydict({
            "block": pa.array([block for block, _ in found], pa.int64()),
            "owner": pa.array([at] * len(found), pa.int32()),
            "bitmap": pa.array([bits for _, bits in found], pa.binary()),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, codes = None, [], []
        for batch in batches:
            for owner, block, code in zip(*(batch[c].to_pylist() for c in ("owner", "block", "code")), strict=True):
                if owner != at and codes:
                    yield compare(at, blocks, codes)
                    blocks, codes = [], []
                at = owner
                blocks.append(block)
                codes.append(code)
        if codes:
            yield compare(at, blocks, codes)

    return codes.mapInArrow(run, "block long, owner int, bitmap binary")


def marked_rows(blocks: DataFrame, bitmaps: DataFrame, bits: int, owners: int) -> DataFrame:
    """Rows (block, doc_id, digest, print, suspect) of all documents; ``bitmaps``: block, answers (owner, bitmap)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, digests, answers in zip(
                batch["block"].to_pylist(), batch["ids"], batch["digests"], batch["answers"].to_pylist(), strict=True
            ):
                data = digests.as_py()
                prints = _block_prints(data, bits)
                distinct, place, count = np.unique(prints, return_inverse=True, return_counts=True)
                suspect = count > 1
                starts = np.searchsorted(_owners(distinct, bits, owners), np.arange(owners + 1, dtype=np.uint64))
                for answer in answers or ():
                    low, high = starts[answer["owner"]], starts[answer["owner"] + 1]
                    said = np.unpackbits(np.frombuffer(answer["bitmap"], np.uint8), count=high - low)
                    suspect[low:high] |= said.astype(bool)
                n = len(prints)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * n, pa.int64()), "doc_id": ids.values,
                    "digest": pa.array([data[i : i + 32] for i in range(0, len(data), 32)], pa.binary()),
                    "print": pa.array(prints.view(np.int64)), "suspect": pa.array(suspect[place]),
                })

    held = blocks.join(bitmaps, "block", "left").select("block", "ids", "digests", "answers")
    return held.mapInArrow(run, "block long, doc_id long, digest binary, print long, suspect boolean")


def _texts(docs: DataFrame, bits: int) -> DataFrame:
    """Rows (doc_id, print, digest, bytes) of all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t.as_py()) for t in batch["text"]]
            digests = b"".join(hashlib.sha256(t).digest() for t in texts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "print": pa.array(_block_prints(digests, bits).view(np.int64)),
                "digest": pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()),
                "bytes": pa.array(texts, pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, print long, digest binary, bytes binary")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts are equal but for the case of A-Z.

    Of equal texts the row with the largest id stays. A null text is empty, so null and empty texts are one group. A
    null id is smaller than any other; where a group has no other, keep_id is null and its rows stay. Rows that repeat
    an id count as rows of their own; those with the id that stays all stay. An empty table gives no rows. Texts of
    any length are compared whole. Other columns are not read, so their names cannot clash. ``bits``: length of a
    fingerprint; without it, it follows the number of rows.
    """
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = stored(hashed_blocks(whole), "hash-blocks")
    n_rows = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    bits = bits or fingerprint_bits(n_rows)
    owners = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(n_rows / OWNER_ROWS))
    codes = sent(blocks, bits, owners).repartition(owners, "owner").sortWithinPartitions("owner", "block")
    answered = stored(answers(codes), "hash-answers")
    bitmaps = answered.groupBy("block").agg(F.collect_list(F.struct("owner", "bitmap")).alias("answers"))
    rows = stored(marked_rows(blocks, bitmaps, bits, owners), "hash-rows")

    # Equal texts meet within a task first, so that a hot group is a few rows before the shuffle.
    prints = stored(rows.filter("suspect").select("print").distinct(), "hash-prints")
    same_text = (
        _texts(whole, bits).join(prints, "print", "left_semi").groupBy("digest", "bytes")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    groups = stored(
        same_text.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_texts")
        ).withColumn(
            "group_size", F.when(F.col("_texts") == 1, F.col("group_size"))
            .otherwise(F.raise_error(F.lit("two texts have one SHA-256")))
        ).drop("_texts").filter("group_size > 1"),
        "hash-groups",
    )
    # A hot text is one row per block here, and its rows come back by block.
    in_block = rows.filter("suspect").select("block", "digest").distinct().join(groups, "digest")
    return rows.join(in_block, ["block", "digest"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
with t as materialized (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents
), g as materialized (
  select body, max(doc_id) as keep_id, count(*) as group_size from t group by body
)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept, sha256(t.body) as text_sha256
from t join g on t.body = g.body
"""
