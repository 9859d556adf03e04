"""Minimax contiguous partition of ordered atomic groups into shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import number_within
from proofgrid.plans.storage import stored

CELLS = 1 << 16  # what the driver holds of the running totals in one round


def assign_shards(rows: DataFrame, key: str, size: str, position: str, shards: int) -> DataFrame:
    """``rows`` with ``shard``; rows with one ``key`` stay together. ``rows`` should be a stored table.

    The groups are put in an order and the order is cut into shards: first the groups that are larger than an even
    share of what is left, by size, each a shard of its own; then all others by their smallest ``position``, cut
    where the smallest feasible capacity says. No shard is empty as long as there are groups for it. Null keys form
    one group; of groups with one smallest position, that with the smaller key comes first.
    """
    grouped = rows.groupBy(key).agg(F.min(position).alias("_first"), F.sum(size).alias("_bytes"))
    groups = stored(grouped, "shard-groups")
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    alone, left = [], shards
    for group, amount in groups.select(key, "_bytes").orderBy(F.desc("_bytes"), key).limit(shards).collect():
        if left < 2 or amount * left <= total:
            break
        alone.append(group)
        total, left = total - amount, left - 1
    is_alone = lambda g: F.col(key).eqNullSafe(F.lit(g))
    rest = groups
    for group in alone:
        rest = rest.filter(~is_alone(group))
    running = _running_totals(rest, key)
    cuts = find_cuts(running, total, left)
    shard = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (F.col("_upto") > cut).cast("int")
    placed = running.select(key, shard.alias("shard"))
    for number, group in enumerate(alone):
        placed = placed.unionByName(
            groups.filter(is_alone(group)).select(key, F.lit(number).alias("shard"))
        )
    # The shards of the groups; a hot group is a hot key of the left side only, which Spark may split.
    return rows.join(
        placed.withColumnRenamed(key, "_group"), F.col(key).eqNullSafe(F.col("_group")), "left"
    ).drop("_group")


def _running_totals(groups: DataFrame, key: str) -> DataFrame:
    """(key, _bytes, _upto): sizes up to and with each group, from range partitions and their sums."""
    ranged = stored(
        groups.repartitionByRange("_first", key).withColumn("_part", F.spark_partition_id()), "shard-ranges"
    )
    sums = sorted(ranged.groupBy("_part").agg(F.sum("_bytes")).collect())
    starts = np.cumsum([0, *(int(n) for _, n in sums)])
    offsets = groups.sparkSession.createDataFrame(
        [(int(part), int(start)) for (part, _), start in zip(sums, starts, strict=False)],
        "_part int, _start long",
    )
    within = Window.partitionBy("_part").orderBy("_first", key).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_within", F.sum("_bytes").over(within)).join(offsets, "_part")
    return stored(
        summed.select(key, "_bytes", (F.col("_start") + F.col("_within")).alias("_upto")), "shard-totals"
    )


def find_cuts(running: DataFrame, total: int, shards: int, cells: int = CELLS) -> list[int]:
    """Where to cut: the running totals at which shards end under the smallest feasible capacity.

    Under that capacity a shard takes as many groups as fit, but leaves one for each shard after it.

    The driver sees at most ``cells`` cells of the running totals in a round, each with its smallest and largest
    value. Greedy checks with the low and the high end of a cell bound the capacity from both sides; the next
    round divides only the cells in which these checks part.
    """
    if cells < 8 * shards:
        raise ValueError("too few cells to divide the ranges of all cuts")
    if not total:
        return []
    tail = [int(r[0]) for r in running.select("_upto").orderBy(F.desc("_upto")).limit(shards).collect()][::-1]
    if len(tail) < shards:
        return tail[:-1]
    low = max(-(-total // shards), int(running.agg(F.max("_bytes")).first()[0])) - 1
    high = total
    known = Cells(*_cells(running, [(0, total)], cells))
    while True:
        high = _smallest(low, high, lambda c: known.greedy(c, shards, False)[-1] >= total)
        low = _smallest(low, high, lambda c: known.greedy(c, shards, True)[-1] >= total) - 1
        least, most = known.greedy(low + 1, shards, False), known.greedy(high, shards, True)
        if least == most:
            cuts = [min(cut, last) for cut, last in zip(least, tail, strict=True)]
            return [cut for cut in cuts if cut < total]
        known = known.refined(*_cells(running, known.windows(least, most), cells))


def _smallest(low: int, high: int, holds) -> int:
    """The smallest number in (low, high] for which a monotone condition holds; it holds for ``high``."""
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def _cells(running: DataFrame, windows: list[tuple[int, int]], cells: int) -> tuple[np.ndarray, np.ndarray]:
    width = max(1, -(-sum(b - a for a, b in windows) // cells))
    inside: Column = F.lit(False)
    for a, b in windows:
        inside = inside | F.col("_upto").between(a, b)
    found = (
        running.filter(inside).groupBy(F.expr(f"_upto div {width}").alias("_cell"))
        .agg(F.min("_upto").alias("a"), F.max("_upto").alias("b")).toArrow()
    )
    lows, highs = np.sort(found["a"].to_numpy()), np.sort(found["b"].to_numpy())
    return lows, highs


class Cells:
    """Disjoint ascending cells of running totals of which only the ends are known."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray):
        self.lows, self.highs = lows, highs

    def last_upto(self, limit: int, optimistic: bool) -> int:
        """A bound of the largest running total up to ``limit``."""
        at = int(np.searchsorted(self.lows, limit, "right")) - 1
        if at < 0:
            return 0
        if limit >= self.highs[at]:
            return int(self.highs[at])
        return int(limit if optimistic else self.lows[at])

    def greedy(self, capacity: int, shards: int, optimistic: bool) -> list[int]:
        ends = [0]
        for _ in range(shards):
            ends.append(self.last_upto(ends[-1] + capacity, optimistic))
        return ends[1:]

    def windows(self, least: list[int], most: list[int]) -> list[tuple[int, int]]:
        """Merged ranges of the cells between the two ends of each cut."""
        merged: list[tuple[int, int]] = []
        for a, b in zip(least, most, strict=True):
            if a != b:
                first = max(0, int(np.searchsorted(self.lows, a, "right")) - 1)
                last = max(0, int(np.searchsorted(self.lows, b, "right")) - 1)
                a, b = int(self.lows[first]), int(self.highs[last])
                if merged and a <= merged[-1][1]:
                    merged[-1] = (min(a, merged[-1][0]), max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
        return merged

    def refined(self, lows: np.ndarray, highs: np.ndarray) -> Cells:
        """The new cells, and the old ones between which none of them lies."""
        at = np.searchsorted(self.lows, lows, "right") - 1
        keep = np.ones(len(self.lows), bool)
        keep[at[at >= 0]] = False
        return Cells(np.sort(np.append(self.lows[keep], lows)), np.sort(np.append(self.highs[keep], highs)))


def shard_documents(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Equal texts share a shard; null texts count as empty. Sizes are UTF-8 bytes plus 16. Repeated rows are
    placed one by one; an empty table gives an empty result; other columns are not read.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.octet_length(whole) + 16).cast("long").alias("size"),
            F.crc32(whole).alias("text_crc32"), F.unhex(F.sha2(whole, 256)).alias("_text_key"),
        ),
        "shard-rows",
    )
    placed = assign_shards(base, "_text_key", "size", "doc_id", shards).drop("_text_key")
    kept = stored(placed, "shard-placed")
    numbered = number_within(kept, "shard", ["doc_id", "text_crc32", "size"], "slot", kept.count())
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
