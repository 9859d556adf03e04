"""Phrase collocations: frequent n-grams by Misra-Gries summaries, then exact counts and cut scores.

First pass: tasks send the hashes of their n-grams with counts to hash shares; each share merges them into one
Misra-Gries summary whose capacity exceeds the share's mass divided by the threshold, so every n-gram as frequent as
the threshold survives. The survivors become a filter of bounded size without false negatives. Second pass: the texts
are read again, and the n-grams that pass the filter are counted exactly, as text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm import golomb
from proofgrid.llm.hashing import mix, span_keys
from proofgrid.plans.storage import stored

LONGEST = 3  # words of a phrase
SLICE_BYTES = 2 << 20  # of one language that a task counts at once
HELD_BYTES = 6 << 20  # of all languages that a task holds
SENT_GRAMS = 1 << 20  # distinct n-grams after which a task sends what it has
SHARE_MASS = (4 << 20, 16 << 20)  # occurrences that a share summarises, on little and on much data
SLACK = 2  # capacity of a summary against the least that keeps all frequent n-grams
MERGE = 1 << 19  # entries that a share takes in before it merges them
PLACE_BITS = 34  # of an n-gram's hash inside its share
FILTER_BYTES = 64 << 20  # the filter's size at most
BITS_PER_GRAM = 12
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
TOP_SLICES = 64
UNNAMED = "und"
_STEP = np.uint64(0xD6E8FEB86659FD93)
_CUT = re.compile(rb"[.,;:!?\x0a-\x0d]")
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else 0x0A if _CUT.match(bytes([b])) else 0x20 if b == 0x09 else b for b in range(256)
)


def slices(text: bytes, limit: int) -> Iterator[bytes]:
    """The text in slices of about ``limit`` bytes that end where pieces end; a piece is never cut."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, about ``SLICE_BYTES`` of them."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, value in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
            for part in slices((value.as_py() or "").encode(), SLICE_BYTES):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                full = lang if sizes[lang] >= SLICE_BYTES else None
                if full is None and sum(sizes.values()) >= HELD_BYTES:
                    full = max(sizes, key=sizes.get)
                if full is not None:
                    del sizes[full]
                    yield full, held.pop(full)
    yield from held.items()


class Grams:
    """The distinct n-grams of some texts, by length, and how often each occurs.

    Words are numbered by their bytes and an n-gram is the tuple of its numbers, so no two are taken for one.
    """

    def __init__(self, texts: list[bytes]):
        tokens = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        numbers: dict[bytes, int] = {b"\n": 0, b"": -1}
        ids = np.fromiter((numbers.setdefault(t, len(numbers) - 1) for t in tokens), np.int64, len(tokens))
        del tokens
        ids = ids[ids >= 0]  # what stands between two spaces is no word; 0 is the end of a piece
        self.words = [b"", *list(numbers)[2:]]
        self.n_words = int(np.count_nonzero(ids))
        n, counts = len(self.words), np.bincount(ids, minlength=1)
        there = np.flatnonzero(counts[1:]) + 1
        self.members = [there.reshape(-1, 1)]  # per length: the words of each distinct n-gram
        self.counts = [counts[there]]
        start, heads = ids, np.arange(n).reshape(-1, 1)  # heads: the words that each number in start stands for
        for length in range(2, LONGEST + 1):
            last = ids[length - 1 :]
            whole = (start[: len(last)] > 0) & (last > 0)
            codes = np.where(whole, start[: len(last)] * n + last, 0)
            found, place, counts = np.unique(codes, return_inverse=True, return_counts=True)
            if not len(found) or found[0] != 0:
                found, place, counts = np.append(0, found), place + 1, np.append(0, counts)
            heads = np.column_stack([heads[found // n], found % n])
            start = place  # number 0 again stands for no n-gram
            self.members.append(heads[1:])
            self.counts.append(counts[1:])

    def keys(self, lang: str) -> list[np.ndarray]:
        """64-bit hashes of the n-grams of each length."""
        data = np.frombuffer(b"".join(self.words), np.uint8).astype(np.uint32)
        ends = np.cumsum([len(w) for w in self.words])
        words = span_keys(data, np.concatenate([[0], ends[:-1]]), ends)
        name = np.frombuffer(lang.encode() + b"\n", np.uint8).astype(np.uint32)
        seed = span_keys(name, np.array([0]), np.array([len(name)]))[0]
        found = []
        for members in self.members:
            key = np.full(len(members), seed)
            for column in members.T:
                key = mix(key * _STEP + words[column])
            found.append(mix(key))
        return found


def places(keys: np.ndarray, shares: int) -> np.ndarray:
    """The share of each key and, in the low ``PLACE_BITS`` bits, its place there; ascending as the keys are."""
    return ((keys >> np.uint64(24)) * np.uint64(shares)) >> np.uint64(40 - PLACE_BITS)


def added(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places with the sums of their counts."""
    order = np.argsort(places)
    places, counts = places[order], counts[order]
    first = np.flatnonzero(np.append(True, np.diff(places) != 0)[: len(places)])
    return places[first], np.add.reduceat(counts, first) if len(first) else counts


def sent(docs: DataFrame, shares: int) -> DataFrame:
    """Rows (share, kind, mass, places, counts) of a task's hashed n-grams that belong to the share.

    Kind 0 holds their mass alone, so that a share that reads its rows by kind knows its mass before it needs it.
    """

    def records(places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        owner = places >> np.uint64(PLACE_BITS)
        low = places & np.uint64((1 << PLACE_BITS) - 1)
        starts = np.flatnonzero(np.append(True, np.diff(owner) != 0)[: len(owner)])
        spans = list(zip(starts, [*starts[1:], len(owner)], strict=True))
        pack = zstandard.ZstdCompressor(level=1).compress
        none = [None] * len(spans)
        return pa.RecordBatch.from_pydict({
            "share": pa.array(np.tile(owner[starts].astype(np.int32), 2)),
            "kind": pa.array(np.repeat(np.array([0, 1], np.int32), len(spans))),
            "mass": pa.array([int(counts[a:b].sum()) for a, b in spans] + none, pa.int64()),
            "places": pa.array(none + [golomb.encode(low[a:b]) for a, b in spans], pa.binary()),
            "counts": pa.array(none + [pack(counts[a:b].tobytes()) for a, b in spans], pa.binary()),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for lang, texts in by_language(batches):
            grams = Grams(texts)
            held.append(added(places(np.concatenate(grams.keys(lang)), shares), np.concatenate(grams.counts)))
            size += len(held[-1][0])
            if size >= SENT_GRAMS:
                held = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size >= SENT_GRAMS // 2:
                    yield records(*held.pop())
                    size = 0
        if size:
            yield records(*added(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return docs.mapInArrow(run, "share int, kind int, mass long, places binary, counts binary")


class Summary:
    """Misra-Gries counters; a counter is at most ``error`` below the true count, ``error`` < mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.error = max(1, capacity), 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        keys, counts = added(np.append(self.keys, keys), np.append(self.counts, counts))
        over = len(counts) - self.capacity
        if over > 0:
            least = np.partition(counts, over - 1)[over - 1]  # the largest count that finds no counter
            keep = counts > least
            keys, counts = keys[keep], counts[keep] - least
            self.error += int(least)
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys that may occur ``threshold`` times; each key that does is one of them."""
        return self.keys[self.counts + self.error >= threshold]


def probes(places: np.ndarray, width: np.ndarray | int) -> list[np.ndarray]:
    """Bit numbers below ``width`` for each place."""
    spread = [mix(places * np.uint64(p)) >> np.uint64(32) for p in PROBES]
    return [((s * width) >> np.uint64(32)).astype(np.int64) for s in spread]


def survivors(codes: DataFrame, threshold: int, most_bits: int) -> DataFrame:
    """Rows (share, width, bits): a filter of the share's surviving n-grams; ``codes`` come by share and kind."""

    def filtered(share: int, summary: Summary) -> pa.RecordBatch:
        keys = summary.frequent(threshold)
        width = min(most_bits, BITS_PER_GRAM * len(keys)) // 64 * 64 + 64
        bits = np.zeros(width, np.uint8)
        for at in probes(keys, np.uint64(width)):
            bits[at] = 1
        return pa.RecordBatch.from_pydict({
            "share": pa.array([share], pa.int32()), "width": pa.array([width], pa.int64()),
            "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
        })

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, summary, held, size = None, 0, None, [], 0

        def merge() -> None:
            if held:
                summary.merge(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("share", "kind", "mass", "places", "counts"))
            for share, kind, mass, code, counts in zip(*columns, strict=True):
                if share != at:
                    if summary is not None:
                        merge()
                        yield filtered(at, summary)
                    at, total, summary, size = share, 0, None, 0
                if kind == 0:
                    total += mass
                    continue
                if summary is None:
                    summary = Summary(SLACK * -(-total // threshold) + 1)
                held.append((golomb.decode(code), np.frombuffer(unpack(counts), np.int64)))
                size += len(held[-1][0])
                if size >= MERGE:
                    merge()
                    size = 0
        if summary is not None:
            merge()
            yield filtered(at, summary)

    return codes.mapInArrow(run, "share int, width long, bits binary")


class Filter:
    """The shares' filters side by side; its size has a bound that does not depend on the data."""

    def __init__(self, rows: list, shares: int):
        self.shares = shares
        self.width, self.offset = np.zeros(shares, np.uint64), np.zeros(shares, np.int64)
        end = 0
        for share, width, bits in rows:
            self.width[share], self.offset[share] = width, end
            end += len(bits)
        self.bits = np.frombuffer(b"".join(bytes(bits) for *_, bits in rows) or b"\0", np.uint8)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = places(keys, self.shares)
        share = (at >> np.uint64(PLACE_BITS)).astype(np.int64)
        low, width = at & np.uint64((1 << PLACE_BITS) - 1), self.width[share]
        ok = width > 0
        for bit in probes(low, width):
            byte = np.minimum(self.offset[share] + (bit >> 3), len(self.bits) - 1)
            ok &= (self.bits[byte] >> (bit & 7).astype(np.uint8)) & 1 == 1
        return ok


def exact_counts(docs: DataFrame, chosen: Filter) -> DataFrame:
    """Rows (lang, words, phrase, n) of the n-grams that pass, one per task's slice; words 0: all words of the slice."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_language(batches):
            grams = Grams(texts)
            words = pa.array(grams.words, pa.binary()).cast(pa.string())
            yield _counted(lang, 0, pa.array([""]), np.array([grams.n_words], np.int64))
            for length, (keys, members, counts) in enumerate(zip(grams.keys(lang), grams.members, grams.counts, strict=True), 1):
                keep = np.flatnonzero(shared.value.passes(keys))
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(c)) for c in members[keep].T), " ")
                yield _counted(lang, length, phrase, counts[keep])

    return docs.mapInArrow(run, "lang string, words int, phrase string, n long")


def _counted(lang: str, length: int, phrase: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "lang": pa.array([lang] * len(phrase), pa.string()), "words": pa.array([length] * len(phrase), pa.int32()),
        "phrase": phrase, "n": pa.array(counts.astype(np.int64)),
    })


def frequent_grams(docs: DataFrame, threshold: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Rows (lang, words, phrase, n) of all n-grams that occur ``threshold`` times in a language, stored.

    Words 0 stands for the language's words. ``docs``: lang and text.
    """
    mass = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2  # about a word for six bytes, three n-grams each
    least, most = (-(-mass // share) for share in reversed(SHARE_MASS))
    shares = max(docs.sparkSession.sparkContext.defaultParallelism, min(most, 256), least)
    dealt = sent(docs, shares).repartition(shares, "share").sortWithinPartitions("share", "kind")
    filters = stored(survivors(dealt, threshold, 8 * filter_bytes // shares), "gram-filters")
    chosen = Filter(filters.collect(), shares)  # at most filter_bytes and 16 bytes a share
    counted = exact_counts(docs, chosen).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return stored(counted.filter((F.col("words") == 0) | (F.col("n") >= threshold)), "gram-counts")


def _scored(rows: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """``rows`` with floor(1000000 a² / (left right)); exact for counts below 10**15."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return rows.withColumn(score, F.expr(f"(1000000BD * {wide('a')} * {wide('a')}) div ({wide(left)} * {wide(right)})"))


def _with_scores(counts: DataFrame) -> DataFrame:
    """Rows (lang, phrase, a, l, r, score, inside): phrases of 2 and 3 words by their lowest-scoring cut.

    ``inside`` is the largest count of a longer phrase that holds the phrase. Parts of a frequent phrase are at least
    as frequent, so each is found among ``counts``.
    """
    grams = counts.filter("words > 0")

    def with_count(rows: DataFrame, part: str, name: str) -> DataFrame:
        found = grams.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
        return rows.join(found, ["lang", part])

    def phrases(words: int) -> DataFrame:
        rows = grams.filter(F.col("words") == words).select("lang", "phrase", F.col("n").alias("a"))
        part = F.split("phrase", " ")
        return rows.select("*", *(part[i].alias(f"w{i + 1}") for i in range(words)))

    two = with_count(with_count(phrases(2), "w1", "l"), "w2", "r")
    three = phrases(3).withColumn("head", F.concat_ws(" ", "w1", "w2")).withColumn("tail", F.concat_ws(" ", "w2", "w3"))
    for part, name in (("w1", "l1"), ("tail", "r1"), ("head", "l2"), ("w3", "r2")):
        three = with_count(three, part, name)
    three = stored(_scored(_scored(three, "l1", "r1", "s1"), "l2", "r2", "s2"), "gram-scores")
    second = F.col("s2") < F.col("s1")
    pick = lambda name: F.when(second, F.col(f"{name}2")).otherwise(F.col(f"{name}1"))
    longer = (
        three.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    )
    return (
        _scored(two, "l", "r", "score").join(longer, ["lang", "phrase"], "left")
        .select("lang", "phrase", "a", "l", "r", "score", "inside")
        .unionByName(three.select(
            "lang", "phrase", "a", pick("l").alias("l"), pick("r").alias("r"), pick("s").alias("score"),
            F.lit(None).cast("long").alias("inside"),
        ))
    )


def collocations(
    docs: DataFrame, threshold: int = 10, top: int = 2000, contained: int = 50,
    lang: str = "lang", text: str = "text", filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases of 2 and 3 words that occur ``threshold`` times in the pieces of a language's texts; a phrase goes if a
    longer one that holds it is at least ``contained`` per cent as frequent. Ties of score go by count, then by the
    phrase's bytes. A null language is ``und``; a null or empty text has no words; repeated rows count each. An empty
    table gives no rows. Texts are read in slices that end with pieces, so only a piece is held whole. Other columns
    are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNNAMED)).alias("lang"), F.col(text).alias("text"))
    counts = frequent_grams(rows, threshold, filter_bytes)
    left = _with_scores(counts).filter(F.col("inside").isNull() | (100 * F.col("inside") < contained * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    sliced = left.withColumn("_slice", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SLICES)))
    first = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order)))
    ranked = first.filter(F.col("rank") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    )
    words = counts.filter("words = 0").select("lang", "n")
    return ranked.filter(F.col("rank") <= top).join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


SQL = r"""
with d as materialized (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body
  from documents
), p as materialized (
  select lang, unnest(string_split_regex(body, '[.,;:!?\x0A-\x0D]')) as piece from d
), w as materialized (
  select lang, [x for x in string_split_regex(piece, '[\x20\x09]+') if x <> ''] as ws from p
), g as materialized (
  select lang, 1 as words, unnest(ws) as phrase from w
  union all
  select lang, 2, unnest([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) from w
  union all
  select lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) from w
), f as materialized (
  select lang, words, phrase, count(*) as c from g group by lang, words, phrase
), total as materialized (
  select lang, sum(c)::bigint as n from f where words = 1 group by lang
), cand as materialized (
  select lang, words, phrase, c as a, string_split(phrase, ' ') as ws from f where words > 1 and c >= 10
), cuts as materialized (
  select lang, phrase, words, a, ws, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:], ' ') as tail
  from cand, range(1, 3) r(k) where k < words
), scored as materialized (
  select x.lang, x.phrase, x.words, x.a, x.k, h.c as l, t.c as r,
    ((1000000::hugeint * x.a * x.a) // (h.c::hugeint * t.c))::bigint as score
  from cuts x join f h on h.lang = x.lang and h.phrase = x.head join f t on t.lang = x.lang and t.phrase = x.tail
), best as materialized (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as materialized (
  select lang, phrase, max(a) as inside from (
    select lang, array_to_string(ws[1:2], ' ') as phrase, a from cand where words = 3
    union all
    select lang, array_to_string(ws[2:3], ' '), a from cand where words = 3
  ) group by lang, phrase
), kept as materialized (
  select best.* from best left join longer on best.words = 2 and longer.lang = best.lang and longer.phrase = best.phrase
  where inside is null or 100 * inside < 50 * a
), ranked as materialized (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join total on total.lang = ranked.lang where rank <= 2000
"""
