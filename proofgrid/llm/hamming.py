"""Embedding near-duplicates: rotated balanced binary codes, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.graph import components
from proofgrid.plans.storage import stored

SAMPLE = 20_000  # vectors to which the rotation is fitted
ROUNDS = 40
TABLES = 5
REACH = 16  # Hamming distance beyond which a pair isn't reranked


@dataclass(frozen=True)
class Codes:
    """Bits are signs of ``matrix @ vector - offset``; several 64-bit codes, each with its own rotation."""

    matrices: tuple[np.ndarray, ...]
    offsets: tuple[np.ndarray, ...]

    @property
    def bits(self) -> int:
        return len(self.matrices[0])


def fit(vectors: np.ndarray, codes: int = 2, seed: int = 7) -> Codes:
    """Iterative quantisation: principal axes, then rotations that bring the vectors close to their signs."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    mean = unit.mean(0)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=False)
    axes = axes[:64]
    reduced = (unit - mean) @ axes.T
    random = np.random.default_rng(seed)
    matrices = []
    for _ in range(codes):
        turn = np.linalg.qr(random.standard_normal((len(axes), len(axes))))[0]
        for _ in range(ROUNDS):
            signs = np.where(reduced @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(reduced.T @ signs)
            turn = left @ right
        matrices.append(turn.T @ axes)
    return Codes(tuple(matrices), tuple(m @ mean for m in matrices))


def links(
    vectors: DataFrame, threshold: float, sample: int = SAMPLE, tables: int = TABLES
) -> DataFrame:
    """(a, b) with a < b of vectors of one ``bucket`` whose cosine reaches the threshold.

    ``vectors``: a stored table of id, bucket, vector (array of double, one length per bucket), norm. A pair is a
    candidate if, in one code, some of the ``tables`` substrings differ in at most one bit; it counts only in the
    first such table, so each pair comes once per code.
    """
    sizes = [r[0] for r in vectors.select(F.size("vector")).distinct().orderBy(F.size("vector")).collect()]
    found = None
    for size in sizes:
        own = vectors.filter(F.size("vector") == size)
        chosen = own.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample)
        fitted = fit(np.array([r["vector"] for r in chosen.collect()]))
        pairs = _pairs_within(_coded(own, fitted), fitted.bits, len(fitted.matrices), tables)
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    left = vectors.select(F.col("id").alias("a"), F.col("vector").alias("x"), F.col("norm").alias("p"))
    right = vectors.select(F.col("id").alias("b"), F.col("vector").alias("y"), F.col("norm").alias("q"))
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda total, v: total + v)
    ranked = found.join(left, "a").join(right, "b")
    return ranked.filter(dot >= threshold * F.col("p") * F.col("q")).select("a", "b")


def _coded(vectors: DataFrame, fitted: Codes) -> DataFrame:
    """id, bucket and one long per code."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            rows = batch["vector"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            unit = rows / batch["norm"].to_numpy(zero_copy_only=False)[:, None]
            out = [batch["id"], batch["bucket"]]
            for matrix, offset in zip(fitted.matrices, fitted.offsets, strict=True):
                bits = (unit @ matrix.T - offset) >= 0
                words = np.zeros((n, 64), np.uint8)
                words[:, : bits.shape[1]] = bits
                out.append(pa.array(np.packbits(words, axis=1, bitorder="little").view("<i8").ravel()))
            yield pa.RecordBatch.from_arrays(out, ["id", "bucket", *(f"c{i}" for i in range(len(out) - 2))])

    kind = vectors.schema["bucket"].dataType.simpleString()
    codes = ", ".join(f"c{i} long" for i in range(len(fitted.matrices)))
    return stored(
        vectors.select("id", "bucket", "vector", "norm").mapInArrow(run, f"id long, bucket {kind}, {codes}"), "codes"
    )


def _pairs_within(coded: DataFrame, bits: int, codes: int, tables: int) -> DataFrame:
    """Distinct (a, b), a < b, from the tables of all codes."""
    bounds = [round(i * bits / tables) for i in range(tables + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    every = None
    for code in range(codes):
        name = f"c{code}"
        exact = F.array(*[F.struct(F.lit(t).alias("t"), F.col(name).bitwiseAND(F.lit(m)).alias("key"))
                          for t, m in enumerate(signed)])
        near = F.array(*[
            F.struct(F.lit(t).alias("t"), F.col(name).bitwiseXOR(F.lit(_signed(flip))).bitwiseAND(F.lit(signed[t])).alias("key"))
            for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))
            for flip in [0, *(1 << k for k in range(a, b))]
        ])
        index = coded.select(F.col("id").alias("b"), "bucket", F.col(name).alias("y"), F.inline(exact))
        probe = coded.select(F.col("id").alias("a"), "bucket", F.col(name).alias("x"), F.inline(near))
        differ = F.col("x").bitwiseXOR(F.col("y"))
        earlier: Column = F.lit(False)
        for t, m in enumerate(signed[:-1]):
            earlier = earlier | ((F.col("t") > t) & (F.bit_count(differ.bitwiseAND(F.lit(m))) <= 1))
        met = (
            probe.join(index, ["bucket", "t", "key"]).filter((F.col("a") < F.col("b")) & ~earlier)
            .filter(F.bit_count(differ) <= REACH).select("a", "b")
        )
        every = met if every is None else every.unionByName(met)
    return every.distinct() if codes > 1 else every


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(
    df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; vec_id must be unique.

    Vectors are compared when labels are equal and not null. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor do vectors of different lengths. Equal vectors of a label form a
    class that is compared once; its members count as links of each other. Other columns are not read.
    """
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("bucket"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("bucket").isNotNull() & (F.size("vector") > 0) & finite, F.lit(False))
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    kept = stored(
        rows.withColumn("norm", F.when(usable, F.sqrt(squares)))
        .withColumn("norm", F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("norm"))), "vectors",
    )
    good = kept.filter("norm is not null")
    classes = stored(
        good.groupBy("bucket", "vector").agg(
            F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("norm").alias("norm")
        ), "vector-classes",
    )
    found = stored(links(classes, threshold), "vector-links")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = (
        both.join(classes.select(F.col("id").alias("b"), "copies"), "b").groupBy("a")
        .agg(F.sum("copies").alias("other"))
    )
    roots = components(found)
    per_class = (
        classes.join(counts.withColumnRenamed("a", "id"), "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("bucket", "vector", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"),
                F.coalesce("component", "id").alias("component_id"))
    )
    alone = kept.filter("norm is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return (
        good.select("vec_id", "bucket", "vector").join(per_class, ["bucket", "vector"])
        .select("vec_id", "n_links", "component_id").unionByName(alone)
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
