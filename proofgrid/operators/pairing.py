"""From headed tables to the long ``pairs`` relation, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofgrid.config import (
    DEFAULT_MAPPING,
    FIELD_CATEGORY,
    FIELD_ICD,
    FIELD_LEVEL,
)
from proofgrid.functions.textnorm import column, text
from proofgrid.operators.grid import ID_HEADER, SUBJECT_HEADER
from proofgrid.operators.layout import MAPPING_TYPE, position_of, positions_where

# Older alias table, target column and the names it may have, in order.
ALIASES = {
    "正面_障礙等級": ["障礙等級", "等級", "正面障礙等級", "原始障礙等級"],
    "反面_障礙等級": ["AI障礙等級", "預測障礙等級", "反面障礙等級", "gemma障礙等級"],
    "正面_障礙類別": ["障礙類別", "類別", "正面障礙類別", "原始障礙類別"],
    "反面_障礙類別": ["AI障礙類別", "預測障礙類別", "反面障礙類別", "gemma障礙類別"],
    "正面_ICD診斷": ["ICD診斷", "ICD", "正面ICD", "原始ICD"],
    "反面_ICD診斷": ["AI_ICD", "預測ICD", "反面ICD", "gemma_ICD"],
    "正面_證明手冊": ["證明手冊", "手冊類型", "正面證明", "原始證明"],
    "反面_證明手冊": ["AI證明", "預測證明", "反面證明", "gemma證明"],
}
TRUTH_PREFIX = "正面_"

# Words of the older suffix pairing and the suffixes a prediction column ends with.
SUFFIX_WORDS = {FIELD_LEVEL: "障礙等級", FIELD_CATEGORY: "障礙類別", FIELD_ICD: "ICD"}
SUFFIXES = (".1", ".2")


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def wide_to_pairs(
    df: DataFrame,
    mapping: dict[str, tuple[str, str]] = DEFAULT_MAPPING,
    row_idx: str = "row_idx",
    workbook: str | None = None,
    model: str | None = None,
) -> DataFrame:
    """Long pairs of a headed table: one row per record and mapped field, nulls kept."""
    present = {
        field: pair for field, pair in mapping.items() if all(c in df.columns for c in pair)
    }
    if not present:
        raise ValueError(f"no mapped column pair among {df.columns}")
    number = (F.col(row_idx) + 1).cast("string")
    record = F.coalesce(_named(ID_HEADER).cast("string"), F.lit("nan")) \
        if ID_HEADER in df.columns else number
    subject = F.coalesce(_named(SUBJECT_HEADER).cast("string"), F.lit("nan")) \
        if SUBJECT_HEADER in df.columns else F.concat(F.lit("記錄"), number)
    entries = F.array(
        *[
            F.struct(
                F.lit(field).alias("field"), F.lit(i).alias("field_order"),
                _named(truth).cast("string").alias("correct"),
                _named(predicted).cast("string").alias("predicted"),
            )
            for i, (field, (truth, predicted)) in enumerate(present.items())
        ]
    )
    return df.select(
        (F.col(workbook) if workbook else F.lit("")).alias("workbook"),
        (F.col(model) if model else F.lit("")).alias("model"),
        F.col(row_idx).cast("bigint").alias("row_idx"),
        record.alias("record_id"),
        F.coalesce(F.nullif(subject, F.lit("")), record).alias("subject_id"),
        F.inline(entries),
    )


def rename_columns(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(names or {})


def missing_columns(df: DataFrame, mapping: dict[str, tuple[str, str]] = DEFAULT_MAPPING) -> list:
    """Mapped columns that a table lacks, in mapping order."""
    return [name for pair in mapping.values() for name in pair if name not in df.columns]


def map_by_suffix(header: Column) -> Column:
    """Older pairing: truth without a copy suffix, prediction the next fitting column to its right."""
    entries = []
    for order, (field, word) in enumerate(SUFFIX_WORDS.items()):
        strict = field != FIELD_LEVEL

        def suffixed(h: Column, n: int) -> Column:
            hit = F.endswith(text(h), F.lit(SUFFIXES[0]))
            return hit if n == 1 else hit | F.endswith(text(h), F.lit(SUFFIXES[1]))

        truth = F.get(
            positions_where(
                header,
                lambda h, i: F.contains(text(h), F.lit(word)) & ~suffixed(h, 2 if strict else 1),
            ),
            F.lit(0),
        )
        predicted = F.get(
            positions_where(
                header,
                lambda h, i: F.contains(text(h), F.lit(word))
                & (suffixed(h, 2) if strict else F.lit(True))
                & (i > truth),
            ),
            F.lit(0),
        )
        entries.append(
            F.when(
                truth.isNotNull() & predicted.isNotNull(),
                F.struct(
                    F.lit(field).alias("field"), F.lit(order).alias("field_order"),
                    truth.alias("truth_col"), predicted.alias("pred_col"),
                ),
            )
        )
    return F.filter(F.array(*entries), lambda e: e.isNotNull()).cast(MAPPING_TYPE)


def map_by_alias(headers: DataFrame) -> DataFrame:
    """``(workbook, mapping)`` by the older alias table: pairs whose two targets both exist.

    A target takes the first column, alias by alias, that holds the alias or is held by it. A column
    taken by several targets goes to the last one. Columns that already have a target's name and are
    not renamed count as well.
    """
    aliases = F.array(
        *[
            F.struct(
                F.lit(t).alias("target"), F.lit(a).alias("rank"), F.lit(name.lower()).alias("alias")
            )
            for t, names in enumerate(ALIASES.values())
            for a, name in enumerate(names)
        ]
    )
    cells = headers.select("workbook", F.posexplode("header").alias("col", "name")).withColumn(
        "name", text("name")
    )
    lowered = F.lower("name")
    hits = cells.select("workbook", "col", lowered.alias("name"), F.inline(aliases)).filter(
        F.contains("name", F.col("alias")) | F.contains("alias", F.col("name"))
    )
    taken = (
        hits.groupBy("workbook", "target").agg(F.min(F.struct("rank", "col"))["col"].alias("col"))
        .groupBy("workbook", "col").agg(F.max("target").alias("target"))
    )
    target_of = F.array_position(F.array(*map(F.lit, ALIASES)), F.col("name")).cast("int") - 1
    own = (
        cells.join(taken, ["workbook", "col"], "left_anti")
        .select("workbook", "col", target_of.alias("target"))
        .filter(F.col("target") >= 0)
    )
    places = (
        taken.withColumn("_own", F.lit(0)).unionByName(own.withColumn("_own", F.lit(1)))
        .groupBy("workbook", "target").agg(F.min(F.struct("_own", "col"))["col"].alias("col"))
    )
    names = F.array(
        *[F.lit(t.removeprefix(TRUTH_PREFIX)) for t in ALIASES if t.startswith(TRUTH_PREFIX)]
    )
    is_truth = F.col("target") % 2 == 0
    return (
        places.groupBy("workbook", F.floor(F.col("target") / 2).cast("int").alias("field_order"))
        .agg(
            F.max(F.when(is_truth, F.col("col"))).alias("truth_col"),
            F.max(F.when(~is_truth, F.col("col"))).alias("pred_col"),
        )
        .filter(F.col("truth_col").isNotNull() & F.col("pred_col").isNotNull())
        .withColumn("field", F.get(names, F.col("field_order")))
        .groupBy("workbook")
        .agg(
            F.array_sort(F.collect_list(F.struct("field_order", "field", "truth_col", "pred_col")))
            .alias("_entries")
        )
        .select(
            "workbook",
            F.transform(
                "_entries",
                lambda e: F.struct(e["field"], e["field_order"], e["truth_col"], e["pred_col"]),
            ).cast(MAPPING_TYPE).alias("mapping"),
        )
    )


def pair_map_from(mapping: dict[str, tuple[int, int]]) -> Column:
    """A caller's own mapping by column position."""
    entries = [
        F.struct(
            F.lit(field).alias("field"), F.lit(i).alias("field_order"),
            F.lit(truth).alias("truth_col"), F.lit(predicted).alias("pred_col"),
        )
        for i, (field, (truth, predicted)) in enumerate(mapping.items())
    ]
    return F.array(*entries).cast(MAPPING_TYPE)


def header_position(header, name: str) -> Column:
    return position_of(column(header), name)
