"""Packing: optimal length buckets and batches with a token budget."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import number_within
from proofgrid.plans.storage import stored


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper ends of at most ``buckets`` buckets with the least padding, and that padding.

    ``lengths`` ascending. best[j] is the least padding of the first j lengths; one layer per bucket. Among
    equal costs the smallest cut wins.
    """
    n = len(lengths)
    if not n:
        return [], 0
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    tokens = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.int64)])
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    cuts = np.zeros((min(buckets, n) + 1, n + 1), np.int64)
    for layer in range(1, min(buckets, n) + 1):
        new = np.full(n + 1, far)
        line = best + tokens  # cost of [i, j): line[i] - lengths[j-1] * rows[i] + (terms of j)
        for j in range(layer, n + 1):
            costs = line[:j] - lengths[j - 1] * rows[:j]
            i = int(np.argmin(costs))
            new[j] = costs[i] + lengths[j - 1] * rows[j] - tokens[j]
            cuts[layer, j] = i
        best = new
    ends, j = [], n
    for layer in range(min(buckets, n), 0, -1):
        ends.append(int(lengths[j - 1]))
        j = int(cuts[layer, j])
    return ends[::-1], int(best[n])


def byte_tokens(text: str = "text") -> Column:
    """Tokens of a byte vocabulary with an end token; null counts as empty."""
    return F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long") + 1


def pack(
    docs: DataFrame, doc_id: str = "doc_id", tokens: Column | None = None, max_tokens: int = 4096,
    buckets: int = 16, budget: int = 65_536,
) -> DataFrame:
    """doc_id, piece, n_pieces, start, n_tokens, bucket, bucket_tokens, batch, slot, padding; a row per piece.

    A document longer than ``max_tokens`` becomes consecutive pieces, so that lengths are bounded and every
    token is packed. The counts of all lengths, ``max_tokens`` numbers at most, go to the driver; dynamic
    programming over them sets the bucket ends. A batch holds ``budget // bucket_tokens`` pieces of one bucket,
    the last one of a bucket possibly fewer. Null and empty texts are one piece of one token; documents with no
    tokens by another measure have one empty piece. Repeated rows are packed one by one. ``tokens`` may be any
    length expression over ``docs``; other columns are not read.
    """
    if budget < max_tokens:
        raise ValueError("the budget must hold a piece of max_tokens")
    length = F.greatest(F.coalesce(byte_tokens() if tokens is None else tokens, F.lit(0)).cast("long"), F.lit(0))
    whole = docs.select(F.col(doc_id).alias("doc_id"), length.alias("_length"))
    n_pieces = F.greatest(F.ceil(F.col("_length") / max_tokens), F.lit(1)).cast("int")
    pieces = (
        whole.withColumn("n_pieces", n_pieces)
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
        .withColumn("start", F.col("piece").cast("long") * max_tokens)
        .withColumn("n_tokens", F.least(F.col("_length") - F.col("start"), F.lit(max_tokens)).cast("int"))
        .drop("_length")
    )
    kept = stored(pieces, "pack-pieces")
    histogram = sorted(tuple(r) for r in kept.groupBy("n_tokens").count().collect())
    lengths = np.array([n for n, _ in histogram], np.int64)
    counts = np.array([c for _, c in histogram], np.int64)
    ends, _ = optimal_buckets(lengths, counts, buckets)
    bucket = F.lit(0)
    for end in ends[:-1]:
        bucket = bucket + (F.col("n_tokens") > end).cast("int")
    bounds = F.array(*[F.lit(end) for end in ends or [1]])
    placed = kept.withColumn("bucket", bucket).withColumn("bucket_tokens", F.get(bounds, F.col("bucket")))
    # Batches are numbered through all buckets; how many a bucket has follows from the histogram.
    sizes = [0] * max(1, len(ends))
    for n, c in histogram:
        sizes[int(np.searchsorted(ends, n))] += c
    held = [budget // max(1, end) for end in ends or [1]]
    first = np.cumsum([0, *(-(-s // h) for s, h in zip(sizes, held, strict=True))])[: len(held)]
    per = F.get(F.array(*[F.lit(h) for h in held]), F.col("bucket"))
    numbered = number_within(placed, "bucket", ["doc_id", "piece", "n_tokens"], "_number", int(counts.sum()))
    return (
        numbered.withColumn("batch", F.get(F.array(*[F.lit(int(x)) for x in first]), F.col("bucket"))
                            + F.floor(F.col("_number") / per))
        .withColumn("slot", (F.col("_number") % per).cast("int"))
        .withColumn("padding", F.col("bucket_tokens") - F.col("n_tokens"))
        .select("doc_id", "piece", "n_pieces", "start", "n_tokens", "bucket", "bucket_tokens", "batch", "slot",
                "padding")
    )
