"""Finding model blocks and truth/prediction columns in certificate sheets.

Every function works on many workbooks at once. A block is described by two relations:
``headers(workbook, model, header)`` with one row per block and ``data(workbook, model, row_idx,
values)`` with one row per data row. Column search is pure array work on the single header row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from proofgrid.config import (
    DEFAULT_MAPPING,
    FIELD_CATEGORY,
    FIELD_ICD,
    FIELD_LEVEL,
    ScoringConfig,
)
from proofgrid.functions.textnorm import contains_any, strip, text
from proofgrid.operators import grid, profile as profiles
from proofgrid.operators.joins import sliced_join, with_facts
from proofgrid.operators.ordered import carry_forward, number_rows
from proofgrid.operators.profile import FIELD_POSITIONS
from proofgrid.plans.storage import stored

DEFAULT = ScoringConfig()

# Header words per field, headers of answer sheets.
FIELD_WORDS = {
    FIELD_LEVEL: ["障礙等級"],
    FIELD_CATEGORY: ["障礙類別"],
    FIELD_ICD: ["ICD診斷", "ICD", "診斷"],
}
POSITIONAL_COLUMNS = 10
ANSWER_HEADER, LLM_HEADER = "解答", "LLM辨識"
PREFIX_COLUMNS = 6

MAPPING_TYPE = "array<struct<field:string,field_order:int,truth_col:int,pred_col:int>>"


class Blocks(NamedTuple):
    headers: DataFrame
    data: DataFrame


# --- model blocks below each other ---------------------------------------------------------------


def _cleaned(values: Column) -> Column:
    return F.transform(values, lambda v: strip(text(v)))


def block_starts(rows: DataFrame) -> DataFrame:
    """Rows that name a model; each starts a block."""
    values = F.col("values")
    return rows.filter(grid.names_model(values)).select(
        "workbook", "row_idx", strip(grid.model_cell_of(values)).alias("model")
    )


def last_at(starts: Column, position: Column) -> Column:
    """The last entry of a sorted array whose ``row_idx`` is at most ``position``, in an array; empty without one."""
    return F.slice(F.filter(starts, lambda s: s["row_idx"] <= position), -1, 1)


def _vertical_members(rows: DataFrame, starts: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """Rows of blocks with their block: naming rows and rows with content. ``starts`` is stored.

    Cells stay as they are: white space at their ends changes neither names, header words nor content.

    A workbook's starts are an array that is searched per row. Only in workbooks with more than
    ``max_starts`` of them the block is carried from row to row.
    """
    per_book = starts.groupBy("workbook").agg(F.count(F.lit(1)).alias("_n"))
    crowded = stored(per_book.filter(F.col("_n") > cfg.max_starts).select("workbook"), "crowded")
    index = stored(
        starts.join(crowded, "workbook", "left_anti").groupBy("workbook")
        .agg(F.array_sort(F.collect_list(F.struct("row_idx", "model"))).alias("_starts")),
        "block-starts",
    )
    rows = rows.select("workbook", "row_idx", "values")
    found = with_facts(rows, index, ["workbook"], "row_idx", cfg.hot_splits)
    found = found.select(  # unpacked as rows, so that the search stands in the plan once
        "workbook", "row_idx", "values",
        F.inline(last_at(F.col("_starts"), F.col("row_idx"))).alias("block_row", "model"),
    )
    if not crowded.isEmpty():
        rest = with_facts(rows, crowded, ["workbook"], "row_idx", cfg.hot_splits)
        name = strip(grid.model_cell_of(F.col("values")))
        start = F.when(
            name.isNotNull(), F.struct(F.col("row_idx").alias("block_row"), name.alias("model"))
        )
        carried = carry_forward(rest, ["workbook"], "row_idx", start, "_block", cfg.chunk_rows)
        found = found.unionByName(carried.select("workbook", "row_idx", "values", "_block.*"))
    is_start = F.col("row_idx") == F.col("block_row")
    return found.filter(
        F.col("block_row").isNotNull() & (is_start | grid.has_content(F.col("values")))
    ).withColumn("_member", ~is_start)


def _vertical_winners(members: DataFrame) -> DataFrame:
    """The block kept per model: the last one with data, and whether its first row is a header."""
    header_like = grid.holds_header_words(F.col("values"), 3)
    blocks = stored(
        members.select(
            "workbook", "model", "block_row", "row_idx", "_member",
            (F.col("_member") & header_like).alias("_head"), F.size("values").alias("_width"),
        )
        .groupBy("workbook", "model", "block_row").agg(
            F.count_if("_member").alias("n"),
            F.bool_or("_head").alias("head"),
            F.min(F.when(F.col("_member"), F.col("row_idx"))).alias("first_row"),
            F.max("_width").alias("width"),
        ),
        "blocks",
    )
    last = blocks.groupBy("workbook").agg(
        F.max("block_row").alias("last_block"), F.max("width").alias("sheet_width")
    )
    used = F.col("head") & ((F.col("n") > 1) | (F.col("block_row") < F.col("last_block")))
    with_data = (
        blocks.join(last, "workbook").withColumn("head_used", used)
        .filter(F.col("n") - F.col("head_used").cast("int") > 0)
        .select("workbook", "model", "block_row", "first_row", "head_used", "sheet_width")
    )
    kept = with_data.groupBy("workbook", "model").agg(F.max("block_row").alias("block_row"))
    return with_data.join(kept, ["workbook", "model", "block_row"], "left_semi")


def _number_labels(width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: i.cast("string"))


def split_vertically(rows: DataFrame, cfg: ScoringConfig = DEFAULT) -> Blocks:
    """Blocks that start with a row naming a model; blank cells become empty text.

    ``rows`` are read three times (starts, block sizes, data) and never shuffled as long as the
    starts and the blocks fit into every task.
    """
    members = _vertical_members(rows, stored(block_starts(rows), "starts"), cfg)
    winners = stored(_vertical_winners(members), "winners")
    kept = with_facts(
        members.filter("_member").drop("_member"), winners, ["workbook", "model", "block_row"],
        "row_idx", cfg.hot_splits,
    ).withColumn(
        "values",
        F.concat(
            _cleaned(F.col("values")),
            F.array_repeat(F.lit(""), F.col("sheet_width") - F.size("values")),
        ),
    )
    first = F.col("row_idx") == F.col("first_row")
    headers = kept.filter(first).select(
        "workbook", "model",
        F.when(F.col("head_used"), F.col("values"))
        .otherwise(_number_labels(F.col("sheet_width")))
        .alias("header"),
    )
    data = kept.filter(~(F.col("head_used") & first)).select(
        "workbook", "model", "row_idx", "values"
    )
    return Blocks(headers, data)


# --- model blocks side by side -------------------------------------------------------------------


def horizontal_spans(profile: DataFrame) -> DataFrame:
    """Column range of every model named in the first five rows of a sheet with two or more."""
    return profiles.column_spans(profile).select("workbook", F.inline("spans"))


def _part(values: Column, start: Column, end: Column) -> Column:
    missing = F.greatest(F.lit(0), end + 1 - F.size(values))
    padded = F.concat(values, F.array_repeat(F.lit(None).cast("string"), missing))
    return F.slice(padded, start + 1, end - start + 1)


def _prefix_end(start: Column) -> Column:
    return F.least(F.lit(PREFIX_COLUMNS), start) - 1


def horizontal_headers(profile: DataFrame) -> DataFrame:
    """Spans with their header row, the first head row that suits; spans without one are left out."""
    spans = profiles.column_spans(profile).select("workbook", "head", F.inline("spans"))
    fitting = F.filter(
        "head",
        lambda r: grid.header_words_in(
            _part(r["values"], F.col("start_col"), F.col("end_col")), grid.SHORT_HEADER_WORDS
        ) >= 2,
    )
    labels = F.concat(
        F.transform(
            _part(F.col("_head.values"), F.lit(0), _prefix_end(F.col("start_col"))),
            lambda v, i: F.coalesce(v, F.concat(F.lit("col_"), i.cast("string"))),
        ),
        F.transform(
            _part(F.col("_head.values"), F.col("start_col"), F.col("end_col")),
            lambda v, i: F.coalesce(
                v, F.concat(F.lit("model_col_"), (i + F.col("start_col")).cast("string"))
            ),
        ),
    )
    return (
        spans.withColumn("_head", F.get(fitting, F.lit(0))).filter(F.col("_head").isNotNull())
        .select(
            "workbook", "model", "start_col", "end_col",
            F.col("_head.row_idx").alias("header_row"), labels.alias("header"),
        )
    )


def split_horizontally(
    rows: DataFrame, cfg: ScoringConfig = DEFAULT, profile: DataFrame | None = None
) -> Blocks:
    """Blocks next to each other: shared first columns plus the model's own; blanks stay null.

    The spans of a workbook are an array next to its rows; each row yields one part per span.
    """
    profile = stored(profiles.workbook_profile(rows), "profile") if profile is None else profile
    spans = stored(horizontal_headers(profile), "spans")
    span = F.struct("model", "start_col", "end_col", "header_row")
    index = stored(
        spans.groupBy("workbook").agg(F.collect_list(span).alias("_spans")), "span-index"
    )

    def part(values: Column, s: Column) -> Column:
        return F.concat(
            _part(values, F.lit(0), _prefix_end(s["start_col"])),
            _part(values, s["start_col"], s["end_col"]),
        )

    parts = F.transform(
        F.filter("_spans", lambda s: F.col("row_idx") > s["header_row"]),
        lambda s: F.struct(
            s["model"].alias("model"), s["start_col"].alias("start_col"),
            part(F.col("values"), s).alias("values"),
        ),
    )
    joined = (
        with_facts(rows, index, ["workbook"], "row_idx", cfg.hot_splits)
        .select("workbook", "row_idx", F.inline(parts))
        .filter(grid.has_content(F.col("values")))
    )
    # A model named twice keeps its last block that has data.
    winners = stored(
        joined.groupBy("workbook", "model").agg(F.max("start_col").alias("start_col")), "winners"
    )
    headers = spans.join(winners, ["workbook", "model", "start_col"], "left_semi")
    data = with_facts(
        joined, winners, ["workbook", "model", "start_col"], "row_idx", cfg.hot_splits, "left_semi"
    )
    return Blocks(
        headers.select("workbook", "model", "header"),
        data.select("workbook", "model", "row_idx", "values"),
    )


# --- choice of layout ----------------------------------------------------------------------------


def _block_counts(headers: DataFrame, name: str) -> DataFrame:
    return headers.groupBy("workbook").agg(F.count(F.lit(1)).alias(name))


def choose_layout(
    census: DataFrame, vertical_headers: DataFrame, horizontal_headers: DataFrame
) -> DataFrame:
    """``layout`` per workbook: vertical, horizontal, single (own header) or raw (no header)."""
    multi = F.col("is_multi_model")
    return (
        census.join(_block_counts(vertical_headers, "n_vertical"), "workbook", "left")
        .join(_block_counts(horizontal_headers, "n_horizontal"), "workbook", "left")
        .select(
            "workbook",
            F.when(multi & (F.coalesce("n_vertical", F.lit(0)) > 1), "vertical")
            .when(multi & (F.coalesce("n_horizontal", F.lit(0)) > 1), "horizontal")
            .when(multi, "raw")
            .otherwise("single")
            .alias("layout"),
        )
    )


def single_headers(
    rows: DataFrame, layouts: DataFrame, profile: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """``(workbook, model, header_row, header)`` of sheets with one model, stored.

    The model is named by the sheet itself. ``profile`` and ``layouts`` are stored tables.
    """
    raw = F.col("layout") == "raw"
    mine = layouts.filter(F.col("layout").isin("single", "raw"))
    heads = (
        profile.join(mine, "workbook").select("workbook", "width", "layout")
        .join(profiles.headers(profile), "workbook", "left")
        .filter(raw | F.col("header_row").isNotNull())
        .select(
            "workbook",
            F.when(raw, -1).otherwise(F.col("header_row")).alias("header_row"),
            F.when(raw, _number_labels(F.col("width")))
            .otherwise(
                grid.distinct_headers(
                    grid.filled_headers(_part(F.col("header"), F.lit(0), F.col("width") - 1))
                )
            )
            .alias("header"),
        )
    )
    heads = stored(heads, "single-headers")
    return stored(heads.join(profiles.model_names(profile, rows, heads, cfg), "workbook"), "heads")


def below_headers(
    rows: DataFrame, heads: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Rows below the header of their sheet with the other columns of ``heads``, a stored table."""
    return with_facts(rows, heads, ["workbook"], "row_idx", cfg.hot_splits).filter(
        F.col("row_idx") > F.col("header_row")
    )


def single_blocks(
    rows: DataFrame, layouts: DataFrame, profile: DataFrame, cfg: ScoringConfig = DEFAULT
) -> Blocks:
    """Sheets with one model."""
    heads = single_headers(rows, layouts, profile, cfg)
    data = below_headers(rows, heads.drop("header"), cfg)
    return Blocks(
        heads.select("workbook", "model", "header"),
        data.select("workbook", "model", "row_idx", "values"),
    )


# --- truth and prediction columns ----------------------------------------------------------------


def _pair(field: str, order: int, truth: Column, predicted: Column) -> Column:
    """A mapping entry, null when one of the two columns is missing."""
    return F.when(
        truth.isNotNull() & predicted.isNotNull(),
        F.struct(
            F.lit(field).alias("field"), F.lit(order).alias("field_order"),
            truth.cast("int").alias("truth_col"), predicted.cast("int").alias("pred_col"),
        ),
    )


def _mapping(entries: list[Column]) -> Column:
    return F.filter(F.array(*entries), lambda e: e.isNotNull()).cast(MAPPING_TYPE)


def positions_where(header: Column, predicate) -> Column:
    """0-based positions of the header cells for which ``predicate`` holds, in order."""
    marked = F.transform(header, lambda h, i: F.when(predicate(h, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def position_of(header: Column, name: str) -> Column:
    return F.get(positions_where(header, lambda h, i: h == name), F.lit(0))


def map_by_name(header: Column) -> Column:
    """Per field the first two columns whose header holds its word: truth, then prediction."""
    entries = []
    for order, (field, words) in enumerate(FIELD_WORDS.items()):
        hits = positions_where(header, lambda h, i, w=words: contains_any(strip(h), w))
        entries.append(_pair(field, order, F.get(hits, F.lit(0)), F.get(hits, F.lit(1))))
    return _mapping(entries)


def map_by_position(header: Column) -> Column:
    """Fixed positions, for sheets with ten or more columns."""
    wide = F.size(header) >= POSITIONAL_COLUMNS
    entries = [
        F.when(wide, _pair(field, order, F.lit(truth), F.lit(predicted)))
        for order, (field, (truth, predicted)) in enumerate(FIELD_POSITIONS.items())
    ]
    return _mapping(entries)


def is_answer_sheet(header: Column) -> Column:
    return F.array_contains(header, ANSWER_HEADER) & F.array_contains(header, LLM_HEADER)


def map_answer_sheet(header: Column) -> Column:
    """Answer and recognition columns: a name and its ``.1``; else fixed positions after the ids."""
    twice = _mapping(
        [
            _pair(field, order, position_of(header, field), position_of(header, f"{field}.1"))
            for order, field in enumerate(FIELD_WORDS)
        ]
    )
    ids_first = (position_of(header, grid.ID_HEADER) == 0) & (
        position_of(header, grid.SUBJECT_HEADER) == 1
    )
    empty = F.array().cast(MAPPING_TYPE)
    return F.when(F.size(twice) > 0, twice).otherwise(
        F.when(ids_first, map_by_position(header)).otherwise(empty)
    )


def map_default_names(header: Column) -> Column:
    """The default column names; all six must be there."""
    entries = _mapping(
        [
            _pair(field, order, position_of(header, truth), position_of(header, predicted))
            for order, (field, (truth, predicted)) in enumerate(DEFAULT_MAPPING.items())
        ]
    )
    return F.when(F.size(entries) == len(DEFAULT_MAPPING), entries).otherwise(
        F.array().cast(MAPPING_TYPE)
    )


def check_content(data: DataFrame) -> DataFrame:
    """Fields whose fixed positions hold fitting values in a block."""
    flags = data.select("workbook", "model", profiles.position_flags(F.col("values")).alias("_flags"))
    return flags.groupBy("workbook", "model").agg(F.bit_or("_flags").alias("_flags")).select(
        "workbook", "model", profiles.fitting_fields(F.col("_flags")).alias("valid_fields")
    )


def missing_columns(header: Column) -> Column:
    """Default columns that the header lacks."""
    required = [name for pair in DEFAULT_MAPPING.values() for name in pair]
    return F.array_except(F.array(*map(F.lit, required)), header)


def choose_mapping(header: Column, by_name: Column, valid_fields: Column) -> Column:
    """The mapping of one block.

    Order of rules: header words, then the answer-sheet form or fixed positions with a content
    check, then the default names. Empty where no rule fits.
    """
    positional = F.filter(
        map_by_position(header),
        lambda e: F.coalesce(F.array_contains(valid_fields, e["field"]), F.lit(False)),
    )
    later = F.when(is_answer_sheet(header), map_answer_sheet(header)).otherwise(positional)
    return (
        F.when(F.size(by_name) > 0, by_name)
        .when(F.size(later) > 0, later)
        .otherwise(map_default_names(header))
    )


def _pair_map(named: DataFrame, *more: str) -> DataFrame:
    """From header, ``_by_name`` and ``valid_fields`` to the pair map."""
    header = F.col("header")
    return named.select(
        "workbook", "model", *more, "header",
        choose_mapping(header, F.col("_by_name"), F.col("valid_fields")).alias("mapping"),
        position_of(header, grid.ID_HEADER).alias("id_col"),
        position_of(header, grid.SUBJECT_HEADER).alias("subject_col"),
    )


def detect_mapping(blocks: Blocks, cfg: ScoringConfig = DEFAULT) -> DataFrame:
    """``pair_map(workbook, model, header, mapping, id_col, subject_col)``, one row per block.

    Only blocks that no header words map and that are wide enough have their rows looked at.
    """
    header = F.col("header")
    named = stored(blocks.headers.withColumn("_by_name", map_by_name(header)), "named-blocks")
    asking = (F.size("_by_name") == 0) & ~is_answer_sheet(header) & (F.size(map_by_position(header)) > 0)
    asking = named.filter(asking).select("workbook", "model")
    if asking.isEmpty():
        no_fields = F.lit(None).cast("array<string>")
        return _pair_map(named.withColumn("valid_fields", no_fields))
    content = check_content(
        with_facts(blocks.data, asking, ["workbook", "model"], "row_idx", cfg.hot_splits)
    )
    return _pair_map(named.join(content, ["workbook", "model"], "left"))


def map_singles(heads: DataFrame, profile: DataFrame) -> DataFrame:
    """``pair_map`` with ``header_row`` of sheets with one model, from their profiles alone."""
    facts = profile.select("workbook", "tail_flags", "head")
    named = heads.join(facts, "workbook").withColumns({
        "_by_name": map_by_name(F.col("header")),
        "valid_fields": profiles.fitting_fields(profiles.data_flags(F.col("header_row"))),
    })
    return _pair_map(named, "header_row")


def extract_pairs(
    data: DataFrame, pair_map: DataFrame, cfg: ScoringConfig = DEFAULT,
    number_missing_ids: bool = True,
) -> DataFrame:
    """Long pairs of all data rows. Ids come from their columns, else from the row number.

    Where it is known that every block has both id columns, ``number_missing_ids=False`` leaves the
    numbering out.
    """
    joined = sliced_join(
        data, pair_map.drop("header").filter(F.size("mapping") > 0), ["workbook", "model"],
        "row_idx", cfg.hot_splits,
    )
    return mapped_pairs(joined, cfg, number_missing_ids)


def lacks_ids(pair_map: DataFrame) -> bool:
    """Whether a block of the stored pair map has no column for one of the two ids."""
    return not pair_map.filter(F.col("id_col").isNull() | F.col("subject_col").isNull()).isEmpty()


def extract_single_pairs(
    rows: DataFrame, pair_map: DataFrame, cfg: ScoringConfig = DEFAULT
) -> DataFrame:
    """Long pairs of sheets with one model: one scan of the rows next to the stored pair map."""
    facts = pair_map.drop("header").filter(F.size("mapping") > 0)
    return mapped_pairs(below_headers(rows, facts, cfg), cfg, lacks_ids(pair_map))


def mapped_pairs(
    joined: DataFrame, cfg: ScoringConfig = DEFAULT, number_missing_ids: bool = True
) -> DataFrame:
    """Pairs of data rows that stand next to their block's mapping and id columns."""
    has_ids = F.col("id_col").isNotNull() & F.col("subject_col").isNotNull()
    no_position = F.lit(None).cast("bigint")
    if number_missing_ids:
        numbered = number_rows(
            joined.filter(~has_ids), ["workbook", "model"], "row_idx", "_position", cfg.chunk_rows
        ).withColumn("_position", F.col("_position") + 1)
        everything = (
            joined.filter(has_ids).withColumn("_position", no_position).unionByName(numbered)
        )
    else:
        everything = joined.withColumn("_position", no_position)
    number = F.col("_position").cast("string")

    def identity(position: str, otherwise: Column) -> Column:
        value = grid.cell(F.col(position))
        return F.when(F.col(position).isNull(), otherwise).otherwise(
            F.coalesce(value, F.lit("nan"))
        )

    return (
        everything.select(
            "workbook", "model", "row_idx", "values",
            identity("id_col", number).alias("record_id"),
            identity("subject_col", F.concat(F.lit("記錄"), number)).alias("_subject"),
            F.inline("mapping"),
        )
        .select(
            "workbook", "model", "row_idx", "record_id",
            F.coalesce(F.nullif("_subject", F.lit("")), F.col("record_id")).alias("subject_id"),
            "field", "field_order",
            grid.cell(F.col("truth_col")).alias("correct"),
            grid.cell(F.col("pred_col")).alias("predicted"),
        )
    )
