"""Join of word sets by Jaccard similarity with signature trees.

Two sets that are similar enough share one of their rarest shingles (prefix filter). Sets that share such a key
are first linked to the first set of the key; what is left in different components is compared by signature
trees: nodes hold OR-combined bitmaps and size ranges, and node pairs are dropped when even the largest possible
overlap is too small. Where most sets of a cell remain candidates of each other, as in a group of near copies, the
cell sends the group's members instead of its pairs; such a group is compared in cells that hold the texts, where
pairs are counted as they are found and only links that join components leave. Every reported link was counted on
the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.graph import components
from proofgrid.llm.shingles import shingle_keys, shingle_sets
from proofgrid.plans.storage import stored

CELL_BITS = (16, 18)  # of the counts that order shingles from rare to frequent, on little and on much data
HOT_CELL = 1 << 20  # a key of a fuller cell, at sixteen times the mean at least, is dealt over several tasks
SLICE_CHARS = 1 << 19  # texts that a task cuts into shingles at once
KEY_BLOCK = 2048  # sets of one key that a task compares with as many others at once, by bitmaps
DENSE = 3  # candidate pairs per set beyond which a group is sent as its members
HELD_PAIRS = 1 << 18  # candidate pairs of a cell that are held; what comes later is sent as members
BLOCK = 256  # sets of a group that a task compares with as many others at once, by texts
BLOCK_SHINGLES = 2 << 20  # shingles in a block at most, on average
LEAF = 16
VERIFY_BLOCK = 256  # documents of a block whose pairs are counted on whole sets


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return (keys >> np.uint64(65 - int(cells).bit_length())).astype(np.int64)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, about ``SLICE_CHARS`` characters at a time."""
    for batch in batches:
        first, size = 0, 0
        texts: list[str] = []
        for row, value in enumerate(batch["text"]):
            texts.append(value.as_py() or "")
            size += len(texts[-1])
            if size >= SLICE_CHARS or row == batch.num_rows - 1:
                yield batch["doc_id"].slice(first, len(texts)), texts
                first, size, texts = row + 1, 0, []


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How many shingles of all documents fall into each cell; the number of cells follows the text."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    low, high = CELL_BITS
    cells = 1 << min(high, max(low, int(n_bytes >> 20).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for _, texts in _parts(batches):
            keys, _ = shingle_keys(texts)
            counts += np.bincount(_cell(keys, cells), minlength=cells)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(there.astype(np.int32)), "n": pa.array(counts[there])})

    found = docs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(cells, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def bitmap(keys: np.ndarray) -> bytes:
    """One bit per key in 2 to 4 bits a key, 64 at least."""
    width = 1 << max(6, int(2 * len(keys)).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(keys & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def features(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, f1 and f2 (a 128-bit key of the set), bits, and prefix: rarest keys with their slices."""
    held = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = held.value
        hot = max(HOT_CELL, 16 * int(counts.sum()) // len(counts))
        for ids, texts in _parts(batches):
            n, f1, f2, bits, prefix, slices, ends = [], [], [], [], [], [], [0]
            for doc, keys in zip(ids.to_pylist(), shingle_sets(texts), strict=True):
                size = len(keys)
                n.append(size)
                f1.append(keys.sum())
                f2.append(np.bitwise_xor.reduce(keys * np.uint64(0x94D049BB133111EB)) if size else np.uint64(0))
                bits.append(bitmap(keys))
                take = size - -(-percent * size // 100) + 1 if size else 0
                load = counts[_cell(keys, len(counts))]
                chosen = np.argsort(load, kind="stable")[:take]
                prefix.append(keys[chosen])
                over = load[chosen] // hot
                slices.append(np.where(over > 0, (hash(doc) & 0x7FFFFFFF) % (1 + over), -1))
                ends.append(ends[-1] + take)
            keys = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(prefix).view(np.int64)), pa.array(np.concatenate(slices).astype(np.int32))],
                ["key", "slice"],
            )
            yield pa.RecordBatch.from_pydict({
                "doc_id": ids, "n": pa.array(n, pa.int64()), "f1": pa.array(np.array(f1, np.uint64).view(np.int64)),
                "f2": pa.array(np.array(f2, np.uint64).view(np.int64)), "bits": pa.array(bits, pa.binary()),
                "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys),
            })

    return docs.mapInArrow(
        run, "doc_id long, n long, f1 long, f2 long, bits binary, prefix array<struct<key:long,slice:int>>"
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """Rows (key, slice, doc, n) of keys that several sets have, with the first set of the slice and its size.

    Rows come sorted by key; a run is passed on as it is read. Slice -1 means that all sets of the key are in the
    run; rows of other slices are always passed on.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "slice", "doc", "n"]
        held = {name: np.zeros(0, np.int64) for name in names}  # the last row so far
        held_leader = held_n = 0
        passed = True
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held["key"])
            rows = {
                name: np.concatenate([held[name], batch[name].to_numpy(zero_copy_only=False).astype(np.int64)])
                for name in names
            }
            start = np.ones(len(rows["key"]), bool)
            start[1:] = (np.diff(rows["key"]) != 0) | (np.diff(rows["slice"]) != 0)
            first = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
            leader, leader_n = rows["doc"][first], rows["n"][first]
            follows = np.append(~start[1:], False)
            out = ~start | follows | (rows["slice"] >= 0)
            if old:
                leader[first == 0], leader_n[first == 0] = held_leader, held_n
                out[0] = out[0] and not passed
            yield _record(rows | {"leader": leader, "leader_n": leader_n}, out)
            held = {name: rows[name][-1:] for name in names}
            held_leader, held_n, passed = leader[-1], leader_n[-1], bool(out[-1])

    return rows.mapInArrow(run, "key long, slice int, doc long, n long, leader long, leader_n long")


def _record(columns: dict[str, np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        name: pa.array(values[keep].astype(np.int32 if name == "slice" else np.int64))
        for name, values in columns.items()
    })


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """OR a bitmap down to ``size`` bytes."""
    return np.bitwise_or.reduce(bits.reshape(-1, size), axis=0)


def may_match(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes, percent: int) -> bool:
    """Whether sets with these bitmaps can be similar enough: a bit that the other lacks is a missing shingle."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    size = min(len(a), len(b))
    a, b = fold(a, size), fold(b, size)
    only_a, only_b = int(np.bitwise_count(a & ~b).sum()), int(np.bitwise_count(b & ~a).sum())
    overlap = min(n_a - only_a, n_b - only_b)
    return 100 * overlap >= percent * (n_a + n_b - overlap)


class Tree:
    """Sets sorted by size in leaves of ``LEAF``; pairs of nodes double up to the root."""

    def __init__(self, n: np.ndarray, group: np.ndarray, bits: np.ndarray):
        self.order = np.argsort(n, kind="stable")
        self.n, self.group, self.bits = n[self.order], group[self.order], bits[self.order]
        ones = np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        self.only = self.n - ones  # shingles beyond one per bit
        cuts = np.arange(0, len(n), LEAF)
        level = {
            "bits": np.bitwise_or.reduceat(self.bits, cuts), "low": np.minimum.reduceat(self.n, cuts),
            "high": np.maximum.reduceat(self.n, cuts), "only": np.maximum.reduceat(self.only, cuts),
            "g_low": np.minimum.reduceat(self.group, cuts), "g_high": np.maximum.reduceat(self.group, cuts),
        }
        self.levels = [level]
        joins = {"bits": np.bitwise_or, "low": np.minimum, "high": np.maximum, "only": np.maximum,
                 "g_low": np.minimum, "g_high": np.maximum}
        while len(level["low"]) > 1:
            cuts = np.arange(0, len(level["low"]), 2)
            level = {name: how.reduceat(level[name], cuts) for name, how in joins.items()}
            self.levels.append(level)


def node_pairs_left(a: dict, i: np.ndarray, b: dict, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs can hold a similar pair of different components."""
    sizes = (100 * a["high"][i] >= percent * b["low"][j]) & (100 * b["high"][j] >= percent * a["low"][i])
    one = (a["g_low"][i] == a["g_high"][i]) & (b["g_low"][j] == b["g_high"][j]) & (a["g_low"][i] == b["g_low"][j])
    keep = np.flatnonzero(sizes & ~one)
    common = np.bitwise_count(a["bits"][i[keep]] & b["bits"][j[keep]]).sum(1, dtype=np.int64)
    overlap = common + np.minimum(a["only"][i[keep]], b["only"][j[keep]])
    smallest = a["low"][i[keep]] + b["low"][j[keep]]
    return keep[(100 + percent) * overlap >= percent * smallest]


def tree_pairs(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of pairs of different components that the bitmaps leave; dual traversal.

    With ``a is b`` a pair may come in both orders.
    """
    up, other = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        keep = node_pairs_left(a.levels[up], i, b.levels[other], j, percent)
        i, j = i[keep], j[keep]
        if not len(i) or (not up and not other):
            break
        if up >= other:
            up -= 1
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
            there = i < len(a.levels[up]["low"])
        else:
            other -= 1
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
            there = j < len(b.levels[other]["low"])
        i, j = i[there], j[there]
    grid = np.arange(LEAF)
    for at in range(0, len(i), 512):
        x = (i[at : at + 512, None, None] * LEAF + grid[None, :, None]).repeat(LEAF, 2).ravel()
        y = (j[at : at + 512, None, None] * LEAF + grid[None, None, :]).repeat(LEAF, 1).ravel()
        there = (x < len(a.n)) & (y < len(b.n))
        x, y = x[there], y[there]
        there = a.group[x] != b.group[y]
        x, y = x[there], y[there]
        p, q = a.n[x], b.n[y]
        close = 100 * np.minimum(p, q) >= percent * np.maximum(p, q)
        x, y, p, q = x[close], y[close], p[close], q[close]
        both = np.bitwise_count(a.bits[x] & b.bits[y]).sum(1, dtype=np.int64)
        overlap = both + np.minimum(a.only[x], b.only[y])
        left = (100 + percent) * overlap >= percent * (p + q)
        yield a.order[x[left]], b.order[y[left]]


class Candidates:
    """Candidate pairs of a cell; groups with many of them are told by their members."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.pairs: list[tuple[int, int]] = []
        self.crowded: list[int] = []  # sets with pairs that were not held

    def find(self, x: int) -> int:
        root = x
        while self.root.setdefault(root, root) != root:
            root = self.root[root]
        while self.root[x] != root:
            self.root[x], x = root, self.root[x]
        return root

    def add(self, x: int, y: int) -> None:
        p, q = self.find(x), self.find(y)
        if p != q:
            self.root[max(p, q)] = min(p, q)
        if len(self.pairs) < HELD_PAIRS:
            self.pairs.append((min(x, y), max(x, y)))
        elif p != q or not self.crowded or self.crowded[-1] != x:
            self.crowded.append(x)

    def edges(self) -> Iterator[tuple[int, int, bool]]:
        """Pairs of sparse groups, and of dense ones (first member, member), marked."""
        self.pairs = list(set(self.pairs))
        members: dict[int, int] = {}
        for x in list(self.root):
            members[self.find(x)] = members.get(self.find(x), 0) + 1
        counts: dict[int, int] = {}
        for x, _ in self.pairs:
            counts[self.find(x)] = counts.get(self.find(x), 0) + 1
        dense = {g for g, n in counts.items() if n > DENSE * members[g]} | {self.find(x) for x in self.crowded}
        yield from ((x, y, False) for x, y in self.pairs if self.find(x) not in dense)
        yield from ((self.find(x), x, True) for x in self.root if self.find(x) in dense and self.find(x) != x)


def candidate_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b, dense) from cells (key, p, q) of rows (doc, n, component, bits, block), sorted by cell.

    A candidate pair is an edge, or its sets hang together by dense edges. A cell sends at most ``DENSE`` edges a set.
    """

    def pairs(cell: dict[str, list]) -> Iterator[tuple[int, int]]:
        # Similar sets have bitmaps of one length or of two that follow each other.
        lengths = np.array([len(b) for b in cell["bits"]])
        for size in np.unique(lengths):
            rows = np.flatnonzero((lengths == size) | (lengths == 2 * size))
            if len(rows) > 1:
                yield from pairs_of({name: [values[i] for i in rows] for name, values in cell.items()}, int(size))

    def pairs_of(cell: dict[str, list], size: int) -> Iterator[tuple[int, int]]:
        doc, n = np.array(cell["doc"], np.int64), np.array(cell["n"], np.int64)
        group = np.array(cell["component"], np.int64)
        bits = np.stack([fold(np.frombuffer(b, np.uint8), size) for b in cell["bits"]]).view(np.uint64)
        left = np.array(cell["block"]) == cell["p"][0]
        sides = [left] if cell["p"][0] == cell["q"][0] else [left, ~left]
        if not all(side.any() for side in sides):
            return
        trees = [(doc[side], Tree(n[side], group[side], bits[side])) for side in sides]
        (docs_a, a), (docs_b, b) = trees[0], trees[-1]
        for x, y in tree_pairs(a, b, percent):
            yield from zip(docs_a[x].tolist(), docs_b[y].tolist(), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n", "component", "bits", "block", "p", "q"]
        found: set[tuple[int, int, bool]] = set()
        cell: dict[str, list] = {name: [] for name in names}
        at = None

        def close() -> None:
            candidates = Candidates()
            for x, y in pairs(cell):
                candidates.add(x, y)
            found.update(candidates.edges())

        def record() -> pa.RecordBatch:
            a, b, dense = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_pydict(
                {"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "dense": pa.array(dense, pa.bool_())}
            )

        for batch in batches:
            columns = [batch[name].to_pylist() for name in ["key", *names]]
            for key, *values in zip(*columns, strict=True):
                here = (key, values[5], values[6])
                if here != at:
                    if at is not None:
                        close()
                    if len(found) > 100_000:
                        yield record()
                        found.clear()
                    cell, at = {name: [] for name in names}, here
                for name, value in zip(names, values, strict=True):
                    cell[name].append(value)
        if at is not None:
            close()
        yield record()

    return rows.mapInArrow(run, "a long, b long, dense boolean")


class Cell:
    """Sets of one or two blocks of a unit; finds the links that join their components."""

    def __init__(self, percent: int):
        self.percent = percent
        self.doc: list[int] = []
        self.group: list[int] = []
        self.left: list[bool] = []
        self.sets: list[np.ndarray] = []

    def add(self, doc: int, component: int, left: bool, keys: np.ndarray) -> None:
        self.doc.append(doc)
        self.group.append(component)
        self.left.append(left)
        self.sets.append(keys)

    def links(self, one_block: bool) -> list[tuple[int, int]]:
        """Pairs that are similar enough and join components, counted on whole sets.

        Similar sets have bitmaps of one length or of two that follow each other.
        """
        n, group, left = np.array([len(s) for s in self.sets]), np.array(self.group, np.int64), np.array(self.left)
        if len(np.unique(group)) < 2:
            return []
        bits = [bitmap(s) for s in self.sets]
        lengths = np.array([len(b) for b in bits])
        root: dict[int, int] = {}

        def find(g: int) -> int:
            while g in root:
                g = root[g]
            return g

        found = []
        for size in np.unique(lengths):
            rows = np.flatnonzero((lengths == size) | (lengths == 2 * size))
            sides = [rows] if one_block else [rows[left[rows]], rows[~left[rows]]]
            if min(map(len, sides)) == 0 or len(rows) < 2:
                continue
            trees = [
                Tree(n[side], group[side], np.stack([fold(np.frombuffer(bits[i], np.uint8), size) for i in side]).view(np.uint64))
                for side in sides
            ]
            for xs, ys in tree_pairs(trees[0], trees[-1], self.percent):
                for x, y in zip(sides[0][xs].tolist(), sides[-1][ys].tolist(), strict=True):
                    if one_block and x > y:
                        continue  # comes in both orders
                    p, q = find(self.group[x]), find(self.group[y])
                    if p != q and self.similar(self.sets[x], self.sets[y]):
                        root[max(p, q)] = min(p, q)
                        found.append((min(self.doc[x], self.doc[y]), max(self.doc[x], self.doc[y])))
        return found

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        if len(a) > len(b):
            a, b = b, a
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        common = int(np.count_nonzero(b[at] == a))
        return 100 * common >= self.percent * (len(a) + len(b) - common)


def cell_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) from cells (unit, p, q) of rows (doc, component, block, packed), sorted by cell.

    A cell sends fewer links than it has components.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["unit", "p", "q", "doc", "component", "block", "packed"]
        at, cell = None, Cell(percent)
        unpack = zstandard.ZstdDecompressor().decompress

        def record(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            found: list[tuple[int, int]] = []
            for unit, p, q, doc, component, block, packed in zip(*(batch[n].to_pylist() for n in names), strict=True):
                if (unit, p, q) != at:
                    if at is not None:
                        found += cell.links(at[1] == at[2])
                    cell, at = Cell(percent), (unit, p, q)
                cell.add(doc, component, block == p, shingle_sets([unpack(packed).decode()])[0])
            yield record(found)
        if at is not None:
            yield record(cell.links(at[1] == at[2]))

    return rows.select("unit", "p", "q", "doc", "component", "block", "packed").mapInArrow(run, "a long, b long")


def _unit_facts(members: DataFrame, unit: str, block: int, shingles: int | None) -> DataFrame:
    """Per unit its largest component and into how many blocks its sets fall.

    ``members``: unit, doc, n, component, each doc once. The sets outside the largest component are the minor ones.
    Minor sets meet each other and all the rest in cells of two blocks; sets of the largest component meet only minor
    ones.
    """
    sizes = members.groupBy(unit, "component").agg(F.count("*").alias("_k"), F.sum("n").alias("_s"))
    main = sizes.groupBy(unit).agg(
        F.max_by("component", F.struct("_k", "component")).alias("main"), F.max("_k").alias("_most"),
        F.sum("_k").alias("_all"), F.sum("_s").alias("_sum"), F.count("*").alias("_components"),
    ).filter("_components > 1")
    size = lambda k: F.greatest(k / block, F.col("_sum") * k / F.col("_all") / shingles) if shingles else k / block
    blocks = lambda k: F.ceil(size(k)).cast("int")
    return main.select(
        unit, "main", blocks(F.col("_all") - F.col("_most")).alias("minors"), blocks(F.col("_most")).alias("majors")
    )


def _in_cells(members: DataFrame, facts: DataFrame, unit: str) -> DataFrame:
    """Rows of ``members`` with ``block``, once for each cell (p, q) of their unit."""
    minor = F.col("component") != F.col("main")
    part = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    mine = members.join(facts.select(unit, "main", "minors", "majors"), unit).withColumn(
        "block", F.when(minor, part(F.col("minors"))).otherwise(F.col("minors") + part(F.col("majors")))
    )
    partners = F.when(minor, F.col("minors") + F.col("majors")).otherwise(F.col("minors"))
    return (
        mine.withColumn("_other", F.explode(F.sequence(F.lit(0), partners - 1)))
        .withColumn("p", F.least("block", "_other")).withColumn("q", F.greatest("block", "_other"))
        .select(*members.columns, "block", "p", "q")
    )


def remaining_candidates(
    shared: DataFrame, roots: DataFrame, bits: DataFrame, percent: int, block: int = KEY_BLOCK
) -> DataFrame:
    """Candidate edges (a, b, dense) between components that share a key, stored.

    Keys of three or more sets and dealt keys: two sets of one slice were compared as leader and follower, but a dealt
    key may hold its two in different slices. Of keys with the same sets one is enough.
    """
    placed = (
        shared.select("key", "slice", "doc", "n").join(roots.select(F.col("node").alias("doc"), "component"), "doc", "left")
        .withColumn("component", F.coalesce("component", "doc"))
    )
    placed = stored(placed, "placed")
    counted = placed.groupBy("key").agg(
        F.count("*").alias("_all"), F.max("slice").alias("_slice"), F.min("doc").alias("low"), F.max("doc").alias("_high"),
        F.min("component").alias("_c"), F.max("component").alias("_d"), F.bit_xor(F.xxhash64("doc")).alias("_mark"),
    ).filter("_c <> _d and (_all > 2 or _slice >= 0)")
    once = counted.groupBy("_all", "low", "_high", "_mark").agg(F.min("key").alias("key")).select("key")
    members = placed.join(once, "key").select("key", "doc", "n", "component")
    cells = _in_cells(members, _unit_facts(members, "key", block, None), "key")
    whole = cells.join(bits.select(F.col("doc_id").alias("doc"), "bits"), "doc")
    dealt = whole.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return stored(candidate_edges(dealt, percent).distinct(), "set-candidates")


def dense_links(
    edges: DataFrame, roots: DataFrame, bits: DataFrame, whole: DataFrame, percent: int, block: int = BLOCK,
    shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """Links between components within the groups that dense ``edges`` (a, b) make, stored.

    A group's sets go once to each cell of two blocks, with their texts.
    """
    groups = components(edges).select(F.col("node").alias("doc"), F.col("component").alias("unit"))
    members = (
        groups.join(roots.select(F.col("node").alias("doc"), "component"), "doc", "left")
        .join(bits.select(F.col("doc_id").alias("doc"), "n"), "doc")
        .select("unit", "doc", "n", F.coalesce("component", "doc").alias("component"))
    )
    members = stored(members, "dense-sets")
    cells = stored(_in_cells(members, _unit_facts(members, "unit", block, shingles), "unit"), "dense-cells")
    texts = texts_of(cells.select("doc"), whole).withColumnRenamed("doc_id", "doc")
    dealt = cells.join(texts, "doc").repartition("unit", "p", "q").sortWithinPartitions("unit", "p", "q")
    return stored(cell_links(dealt, percent), "set-links")


def texts_of(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """doc_id and the compressed text of the documents named in the one column of ``docs``; no other text moves."""
    ids = stored(docs.toDF("doc_id").distinct(), "set-ids")
    needed = whole.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stored(_packed(needed), "set-texts")


def verified(pairs: DataFrame, whole: DataFrame, percent: int, block: int = VERIFY_BLOCK) -> DataFrame:
    """The stored ``pairs`` whose whole sets are similar enough; ``whole``: doc_id and text of all documents.

    Documents fall into blocks of about ``block``; a pair belongs to the cell of its two blocks. A text goes once
    to each cell where it has a pair, and its set is made once there, however many pairs it has.
    """
    texts = texts_of(pairs.select(F.explode(F.array("a", "b"))), whole)
    blocks = -(-texts.count() // block) or 1
    part = lambda name: F.pmod(F.xxhash64(name), F.lit(blocks)).cast("int")
    placed = pairs.select(part("a").alias("p"), part("b").alias("q"), "a", "b")
    members = (
        placed.select("p", "q", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(texts, "doc_id")
        .select("p", "q", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "packed")
    )
    rows = members.unionByName(placed.withColumn("packed", F.lit(None).cast("binary")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = (batch[name].to_pylist() for name in ("p", "q", "a", "b", "packed"))
            for p, q, a, b, packed in zip(*columns, strict=True):
                if (p, q) != at:
                    at, sets = (p, q), {}
                if b is None:
                    sets[a] = shingle_sets([zstandard.decompress(packed).decode()])[0]
                    continue
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    found.append((a, b))
            left, right = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    # Null sorts first: a cell's texts come before its pairs.
    dealt = rows.repartition("p", "q").sortWithinPartitions("p", "q", F.asc_nulls_first("b"))
    return dealt.select("p", "q", "a", "b", "packed").mapInArrow(run, "a long, b long")


def bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs that the bitmaps leave."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (batch[name].to_pylist() for name in ("n_a", "bits_a", "n_b", "bits_b"))
            keep = [may_match(*v, percent) for v in zip(*values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: bits.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ``doc_id`` should be unique.

    Null and empty texts have no shingles and link with nothing; equal sets are compared once. A null id gets no
    component; rows that repeat stay, each with the same answer. Other columns are not read. Shingles are
    compared as 64-bit keys.
    """
    whole = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    feats = stored(features(whole, percent), "set-features")
    classes = stored(
        feats.filter("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("first")),
        "set-classes",
    )
    firsts = classes.select(F.col("first").alias("doc_id"))
    rare = feats.select("doc_id", "n", "prefix").join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    keys = rare.select(F.inline("prefix"), F.col("doc_id").alias("doc"), "n")
    shared = stored(
        shared_keys(keys.repartition("key", "slice").sortWithinPartitions("key", "slice", "doc").select("key", "slice", "doc", "n")),
        "shared-keys",
    )
    involved = shared.select(F.col("doc").alias("doc_id")).distinct()
    bits = stored(
        feats.select("doc_id", "n", "bits").join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "set-bits"
    )
    near = shared.filter(
        (F.col("doc") != F.col("leader"))
        & (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n"))
    ).select(F.least("leader", "doc").alias("a"), F.greatest("leader", "doc").alias("b")).distinct()
    near = stored(bounded(near, bits, percent), "set-pairs")
    to_leaders = stored(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "set-pairs")
    links = stored(verified(to_leaders, whole, percent), "set-links")
    roots = components(links)
    edges = remaining_candidates(shared, roots, bits, percent)
    left = _apart(near, roots).unionByName(edges.filter("not dense").select("a", "b")).distinct()
    rest = stored(verified(stored(left, "set-pairs"), whole, percent), "set-links")
    every = links.unionByName(rest)
    dense = edges.filter("dense").select("a", "b")
    if not dense.isEmpty():
        every = every.unionByName(dense_links(dense, roots, bits, whole, percent))
    roots = components(every)
    named = classes.join(roots.withColumnRenamed("node", "first"), "first", "left").select(
        "n", "f1", "f2", F.coalesce("component", "first").alias("component_id")
    )
    own = feats.select("doc_id", "n", "f1", "f2")
    return own.join(named, ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    root = lambda x: roots.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    placed = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return placed.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def _packed(whole: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack = zstandard.ZstdCompressor(level=1).compress
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([pack(t.as_py().encode()) for t in batch["text"]], pa.binary())],
                ["doc_id", "packed"],
            )

    return whole.mapInArrow(run, "doc_id long, packed binary")
