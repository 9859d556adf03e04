"""What each filter removes, in every order in which the filters can be applied.

A document's failures are a bit mask. With M[mask, filter] = 0 where the filter fails (else infinite) and
P[filter, order] = the filter's place in the order (the order's inverse permutation), the min-plus product of M and P
is the step at which an order removes a mask. Documents are only counted per part and mask; these counts are then
scattered to the steps.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.plans.storage import stored

WEIGHTS = ("n", "good", "toxic")
PARTS_AT_ONCE = 64  # parts whose reports a task builds together
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)
NEVER = 127


def masks_by_filter(n: int) -> np.ndarray:
    """(2**n, n): whether a mask holds a filter's bit."""
    return (np.arange(1 << n)[:, None] >> np.arange(n)) & 1 == 1


def places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All orders (n!, n) and the place of each filter in each of them (n, n!), from 1."""
    orders = np.array(list(itertools.permutations(range(n)))).reshape(-1, n)
    return orders, np.argsort(orders, axis=1).T + 1


def removal_steps(n: int) -> np.ndarray:
    """(2**n, n!): the step at which an order removes a mask, ``NEVER`` for the empty mask."""
    fails = np.where(masks_by_filter(n), 0, NEVER)
    _, place = places(n)
    return np.minimum(NEVER, (fails[:, :, None] + place[None]).min(axis=1))


class Audit:
    """The matrices of ``n`` filters, and reports of counts per mask."""

    def __init__(self, n: int):
        self.n, (self.orders, _) = n, places(n)
        steps, holds = removal_steps(n), masks_by_filter(n)
        self.removed = np.stack([steps == s for s in range(1, n + 1)], axis=2)  # mask, order, step
        fails = holds[:, self.orders]  # mask, order, step: whether the step's filter fails
        self.redundant = fails & (steps[:, :, None] < np.arange(1, n + 1))
        self.alone = np.array([1 << f for f in range(n)])

    def report(self, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays (part, order, step) from counts (part, mask, weight)."""
        scatter = lambda chosen, weight: np.einsum(
            "pm,mos->pos", counts[:, :, weight], chosen.astype(np.int64)
        )
        removed = scatter(self.removed, 0)
        total = counts[:, :, 0].sum(1)
        by_filter = np.zeros((len(counts), self.n), np.int64)
        for f in range(self.n):
            by_filter[:, f] = (removed * (self.orders == f)).sum((1, 2))
        return {
            "kept": total[:, None, None] - np.cumsum(removed, axis=2), "removed": removed,
            "redundant": scatter(self.redundant, 0), "unique_fails": counts[:, self.alone, 0][:, self.orders],
            "good_lost": scatter(self.removed, 1), "toxic_lost": scatter(self.removed, 2),
            "shapley": by_filter[:, self.orders],
        }


def audit(counts: DataFrame, names: str) -> DataFrame:
    """The report from rows (part, mask, n, good, toxic); bit i of ``mask`` is the filter ``names[i]``.

    One row per part, order and step, zeros included. A part is one row of counts before it becomes a report.
    """
    n = len(names)
    cells = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(w))), F.lit(0)) for m in range(1 << n) for w in WEIGHTS]
    by_part = counts.groupBy("part").agg(F.array(*cells).alias("counts"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrices = Audit(n)
        orders, steps = len(matrices.orders), np.arange(1, n + 1, dtype=np.int32)
        labels = ["".join(names[f] for f in order) for order in matrices.orders]
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(at, PARTS_AT_ONCE)
                values = some["counts"].flatten().to_numpy().reshape(some.num_rows, 1 << n, len(WEIGHTS))
                columns = {k: pa.array(v.ravel()) for k, v in matrices.report(values).items()}
                rows = np.repeat(np.arange(some.num_rows), orders * n)
                yield pa.RecordBatch.from_pydict({
                    "part": some["part"].take(pa.array(rows)),
                    "filter_order": pa.array(labels * some.num_rows).take(
                        pa.array(np.repeat(np.arange(orders * some.num_rows), n))
                    ),
                    "step": pa.array(np.tile(steps, orders * some.num_rows)),
                } | columns)

    return by_part.mapInArrow(run, REPORT)


def text_filters(text: str) -> int:
    """Bits of the filters A to D that a text fails.

    A: under 50 words. B: distinct words under 65 % of all. C: A-Z over 5 % of all characters. D: one of ``#$%&*|``.
    """
    data = text.encode()
    words = data.split()  # at the ASCII white space \x20 and \x09-\x0D
    letters = np.frombuffer(data, np.uint8)
    upper = int(np.count_nonzero((letters >= 65) & (letters <= 90)))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * upper > 5 * len(text)) << 2
        | any(c in data for c in b"#$%&*|") << 3
    )


COPY = 16  # filter E


def text_masks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, mask, digest): the filters A to D, and the SHA-256 of the text for E."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch["text"]:
                text = value.as_py() or ""
                masks.append(text_filters(text))
                digests.append(hashlib.sha256(text.encode()).digest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "part": batch["part"], "mask": pa.array(masks, pa.int32()),
                "digest": pa.array(digests, pa.binary()),
            })

    return docs.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def _flag(name: str) -> Column:
    return F.max(F.when(F.col(name) == 1, 1).otherwise(0))


def counts_by_mask(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, mask, n, good, toxic) of the filters A to E.

    E: an equal text has a smaller id. The first id of a text is looked up by text and id together, so a text of many
    copies is no hot key.
    """
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("text").alias("text"),
    )
    rows = stored(text_masks(whole), "filter-masks")
    firsts = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.withColumn("first", F.lit(True))
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").filter("doc_id is not null")
        .groupBy("doc_id").agg(_flag("quality").alias("good"), _flag("toxic").alias("toxic"))
        .filter("good + toxic > 0")
    )
    named = rows.filter("doc_id is not null").join(firsts, ["doc_id", "digest"], "left").select(
        "doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + COPY).alias("mask")
    )
    flag = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0)))
    counted = named.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), flag("good").alias("good"), flag("toxic").alias("toxic")
    )
    nameless = rows.filter("doc_id is null").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic")
    )
    return counted.unionByName(nameless)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source, order of the filters A to E and step: what the step keeps, removes and repeats.

    A null text is empty, a null source the empty string. A null id is smaller and larger than no id, so E leaves its
    row alone, and it has no label. Rows that repeat an id count each; equal texts with one smallest id are all first.
    A label counts if any row of the id has it. Empty tables give no rows. Texts of any length are tested whole. Only
    doc_id, text and source, and of the labels doc_id, quality and toxic, are read.
    """
    return audit(counts_by_mask(docs, labels), "ABCDE")


SQL = r"""
with t as materialized (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as body from documents
), w as materialized (
  select *, string_split_regex(regexp_replace(body, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') as ws0
  from t
), x as materialized (
  select doc_id, part, body, case when ws0 = [''] then [] else ws0 end as ws from w
), firsts as materialized (
  select body, min(doc_id) as first_id from t group by body
), known as materialized (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
), m as materialized (
  select x.part,
    (case when len(ws) < 50 then 'A' else '' end)
    || (case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(x.body, '[^A-Z]', '', 'g')) > 5 * length(x.body) then 'C' else '' end)
    || (case when regexp_matches(x.body, '[#$%&*|]') then 'D' else '' end)
    || (case when x.doc_id > f.first_id then 'E' else '' end) as failed,
    count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
  from x join firsts f on x.body = f.body left join known k on k.doc_id = x.doc_id
  group by 1, 2
), letters as materialized (
  select unnest(['A', 'B', 'C', 'D', 'E']) as c
), orders as materialized (
  select a.c || b.c || d.c || e.c || f.c as filter_order
  from letters a, letters b, letters d, letters e, letters f
  where len(list_distinct([a.c, b.c, d.c, e.c, f.c])) = 5
), steps as materialized (
  select filter_order, s::int as step, substr(filter_order, s::int, 1) as letter from orders, range(1, 6) r(s)
), removal as materialized (
  select failed, filter_order, coalesce(min(step) filter (contains(failed, letter)), 99) as gone
  from (select distinct failed from m), steps group by 1, 2
), rows as materialized (
  select m.part, s.filter_order, s.step, s.letter,
    sum(case when gone > s.step then n else 0 end)::bigint as kept,
    sum(case when gone = s.step then n else 0 end)::bigint as removed,
    sum(case when gone < s.step and contains(m.failed, s.letter) then n else 0 end)::bigint as redundant,
    sum(case when m.failed = s.letter then n else 0 end)::bigint as unique_fails,
    sum(case when gone = s.step then good else 0 end)::bigint as good_lost,
    sum(case when gone = s.step then toxic else 0 end)::bigint as toxic_lost
  from m join removal r on m.failed = r.failed join steps s on s.filter_order = r.filter_order
  group by 1, 2, 3, 4
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, letter))::bigint as shapley
from rows
"""
