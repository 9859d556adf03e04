"""Byte-level BPE: distinct words are encoded once, their ids joined back to the blocks of text they stand in.

Texts are dealt into blocks. A block yields its distinct words; these meet in one shuffle by word, where each is
encoded once, and go back to the blocks as a dictionary. A block then puts the ids in the order of its words.
So a frequent word is one row per block, whatever its share of the corpus, and no position leaves its text.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.hashing import span_keys

BLOCK_BYTES = 12 << 20  # of text whose distinct words travel together
GROWTH = 0.6  # distinct words grow as a power of the text; so does the number of their shares
KNOWN_BYTES = 64 << 20  # of words and ids that a share remembers
SLICE_CHARS = 1 << 20
# The pattern that the scanner below follows, and the endings it splits off after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
EDGE, LETTER, NUMBER, OTHER, SPACE = range(5)


def read_ranks(path: str) -> bytes:
    """The rank file as it is; a vocabulary file, so its size does not depend on the data."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def _ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=2)
def _encoding(raw: bytes):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=_ranks(raw), special_tokens={})


class Ragged:
    """Many byte strings or number lists in one array; picking entries copies them in the order asked for."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    @classmethod
    def of_bytes(cls, parts: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts], np.int64))

    def pick(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen entries one after another, and their lengths."""
        lengths = self.lengths[index]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.starts[index] - (ends - lengths), lengths) + np.arange(total)
        return self.flat[where], lengths


@lru_cache(maxsize=2)
def _tables(raw: bytes) -> tuple[Ragged, Ragged]:
    """By id: the token's bytes, and the id in decimal with a comma."""
    ranks = _ranks(raw)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return Ragged.of_bytes(tokens), Ragged.of_bytes([b"%d," % i for i in range(len(tokens))])


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(name, every):
            a, b = (ord(m[0][0]), ord(m[0][-1]) + 1)
            kinds[a:b] = kind
    return kinds


class Scan:
    """The pre-tokens of some texts: where they start and end in ``joined``, their keys, and texts' token counts.

    It finds what ``PATTERN`` matches, for all texts at once: runs of one class are tokens; a space before a run
    of another class belongs to that run; of longer white space only the last character does, if it is a space;
    a single apostrophe splits off a known ending. Keys are 64-bit hashes.
    """

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts) + "\n"
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        edges = np.cumsum(lengths + 1) - 1
        kind = _classes()[points]
        kind[edges] = EDGE
        n = len(points)
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start[edges] = start[edges + 1] = True
        runs = np.flatnonzero(start)
        # White space before another run.
        gap = np.flatnonzero((kind[runs[:-1]] == SPACE) & (np.append(kind, EDGE)[runs[1:]] != EDGE))
        last = runs[gap + 1] - 1
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        # A single apostrophe at a token's start before a letter.
        single = runs[:-1][np.diff(runs) == 1]
        single = single[(points[single] == 39) & start[single]]
        single = single[kind[single + 1] == LETTER]
        for ending in ENDINGS:
            at = single[single + len(ending) < n]
            for k, letter in enumerate(ending, 1):
                at = at[points[at + k] == ord(letter)]
            start[at + 1] = False
            start[at + 1 + len(ending)] = True
        bounds = np.flatnonzero(start)
        token = kind[bounds[:-1]] != EDGE
        self.starts, self.ends = bounds[:-1][token], bounds[1:][token]
        self.keys = span_keys(points, self.starts, self.ends)
        self.counts = np.diff(np.searchsorted(self.starts, edges), prepend=0)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, about ``SLICE_CHARS`` characters at a time."""
    part, size = [], 0
    for value in texts:
        part.append(value)
        size += len(value)
        if size >= SLICE_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _pack(texts: list[str]) -> bytes:
    """Compressed: how many, their lengths in bytes, the bytes."""
    parts = [t.encode() for t in texts]
    sizes = np.array([len(parts), *map(len, parts)], np.int64)
    return zstandard.compress(sizes.tobytes() + b"".join(parts), 3)


def _unpack(blob: bytes) -> list[str]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int64, n, 8))]) + 8 * (n + 1)
    return [raw[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _pack_ids(lists: list[bytes]) -> bytes:
    """Compressed: lengths and ids (four bytes each), byte planes of like places together."""
    sizes = np.array([len(lists), *(len(ids) // 4 for ids in lists)], "<i4")
    flat = np.frombuffer(sizes.tobytes() + b"".join(lists), np.uint8)
    return zstandard.compress(np.ascontiguousarray(flat.reshape(-1, 4).T).tobytes(), 3)


def _unpack_ids(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    flat = np.ascontiguousarray(planes.T).view("<i4").ravel()
    return flat[1 : flat[0] + 1], flat[flat[0] + 1 :]


def encode(docs: DataFrame, ranks: bytes, doc_id: str = "doc_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id and ids (array of int) of every row, without special tokens.

    Each match of ``PATTERN`` is encoded by itself. Null and empty texts have no ids; repeated rows are encoded
    one by one; other columns are not read.

    Texts, words and ids travel compressed: a row holds the texts of a block from one task, the words of a block
    that fall into one share of all words, or their ids in the same order. Blocks follow the bytes of text and shares
    a power of them below one, neither the number of partitions, so there are never more rows than one per block and
    distinct word, and as a rule thousands of words in each. A text is never cut; a task holds the texts of its blocks,
    and rows that repeat both id and text share a block.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ranks)
    cores = spark.sparkContext.defaultParallelism
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_bytes = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * cores, math.ceil(n_bytes / block_bytes))
    shares = 8 * cores * math.ceil(max(1.0, n_bytes / (1 << 30)) ** GROWTH)
    # By content alone: a row's place may change when a lost task runs again.
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    kind = docs.schema[doc_id].dataType.simpleString()

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch["block"].to_numpy(zero_copy_only=False)
            order = np.argsort(numbers, kind="stable")
            found, first = np.unique(numbers[order], return_index=True)
            groups = np.split(order, first[1:])
            ids, texts = batch["doc_id"], batch["text"].to_pylist()
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(found),
                "ids": pa.ListArray.from_arrays(
                    pa.array(np.append(first, len(order)).astype(np.int32)), ids.take(pa.array(order))
                ),
                "texts": pa.array([_pack([texts[i] for i in group]) for group in groups], pa.binary()),
            })

    def scans(blobs: Iterable[bytes]) -> Iterator[Scan]:
        for blob in blobs:
            for part in _slices(_unpack(blob)):
                yield Scan(part)

    def in_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys by (share, key), and their shares."""
        keys = np.unique(keys)
        share = (keys % np.uint64(shares)).astype(np.int32)
        order = np.argsort(share, kind="stable")
        return keys[order], share[order]

    def distinct_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            for number, blob in zip(batch["block"].to_pylist(), batch["texts"].to_pylist(), strict=True):
                blobs.setdefault(number, []).append(blob)
        while blobs:
            number, held_blobs = blobs.popitem()
            words: dict[int, str] = {}
            for scan in scans(held_blobs):
                keys, first = np.unique(scan.keys, return_index=True)
                for key, a, b in zip(keys.tolist(), scan.starts[first].tolist(), scan.ends[first].tolist(), strict=True):
                    if key not in words:
                        words[key] = scan.joined[a:b]
            keys, share = in_order(np.fromiter(words, np.uint64, len(words)))
            found, first = np.unique(share, return_index=True)
            lists = np.split(keys, first[1:]) if len(found) else []
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(found), number, np.int32)), "share": pa.array(found),
                "words": pa.array([_pack([words[k] for k in part.tolist()]) for part in lists], pa.binary()),
            })

    def encode_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, known, size, at = _encoding(held.value), {}, 0, None
        for batch in batches:
            out = []
            for share, blob in zip(batch["share"].to_pylist(), batch["words"].to_pylist(), strict=True):
                if share != at or size > KNOWN_BYTES:  # beyond the bound a word may be encoded again
                    known, size, at = {}, 0, share
                words = _unpack(blob)
                new = [w for w in words if w not in known]
                coded = encoding.encode_ordinary_batch(new, num_threads=1)
                known.update((w, np.array(ids, "<i4").tobytes()) for w, ids in zip(new, coded, strict=True))
                size += sum(len(w) + 4 * len(ids) + 150 for w, ids in zip(new, coded, strict=True))
                out.append(_pack_ids([known[w] for w in words]))
            yield pa.RecordBatch.from_arrays(
                [batch["block"], batch["share"], pa.array(out, pa.binary())], ["block", "share", "coded"]
            )

    def put_back(texts: pa.Table, entries: pa.Table) -> pa.Table:
        blobs = texts["texts"].to_pylist()
        parts = [_unpack_ids(b) for b in entries.sort_by("share")["coded"].to_pylist()]
        by_word = Ragged(
            np.concatenate([ids for _, ids in parts]) if parts else np.zeros(0, np.int32),
            np.concatenate([sizes for sizes, _ in parts]) if parts else np.zeros(0, np.int64),
        )
        keys, _ = in_order(np.concatenate([np.zeros(0, np.uint64), *(np.unique(s.keys) for s in scans(blobs))]))
        if len(keys) != len(by_word.lengths):
            raise ValueError("words and ids of a block differ")
        number = pd.Index(keys)
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for scan in scans(blobs):
            flat, lengths = by_word.pick(number.get_indexer(scan.keys))
            upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(scan.counts)])]
            flats.append(flat.astype(np.int32))
            sizes.append(np.diff(upto))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
        doc_ids = [chunk.flatten() for chunk in texts["ids"].chunks]
        return pa.table({
            "doc_id": pa.chunked_array(doc_ids).combine_chunks(),
            "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flats))),
        })

    dealt = (
        whole.select("doc_id", "text", block.alias("block"))
        .mapInArrow(gather, f"block int, ids array<{kind}>, texts binary").repartition(blocks, "block")
    )
    words = dealt.mapInArrow(distinct_words, "block int, share int, words binary")
    coded = words.repartition(shares, "share").sortWithinPartitions("share").mapInArrow(encode_words, "block int, share int, coded binary")
    return dealt.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(
        put_back, f"doc_id {kind}, ids array<int>"
    )


def decode(coded: DataFrame, ranks: bytes, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens and the decoded bytes, or with ``digest`` the SHA-256 of the decimal ids and of the bytes.

    Ids are joined with the token-byte table, which is bounded by the vocabulary and sits in every task. Null
    ids count as none; an id without a token fails.
    """
    held = coded.sparkSession.sparkContext.broadcast(ranks)
    kind = coded.schema["doc_id"].dataType.simpleString()

    def spans(table: Ragged, ids: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
        flat, lengths = table.pick(ids)
        upto = np.concatenate([[0], np.cumsum(lengths)])[ends]
        view = memoryview(flat)
        return (view[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, decimals = _tables(held.value)
        sha = lambda v: hashlib.sha256(v).hexdigest()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                lists = batch["ids"]
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                out = {"doc_id": batch["doc_id"], "n_tokens": pa.array(sizes)}
                if digest:
                    out["ids_sha256"] = pa.array([sha(v[:-1]) for v in spans(decimals, ids, ends)])
                    out["decoded_sha256"] = pa.array([sha(v) for v in spans(tokens, ids, ends)])
                else:
                    out["decoded"] = pa.array([bytes(v) for v in spans(tokens, ids, ends)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    last = "ids_sha256 string, decoded_sha256 string" if digest else "decoded binary"
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, n_tokens long, {last}")


def query(docs: DataFrame, path: str) -> DataFrame:
    ranks = read_ranks(path)
    return decode(encode(docs, ranks), ranks, digest=True)
