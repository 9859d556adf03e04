"""From certificate sheets to scores, aggregates and reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from proofgrid.config import ScoringConfig
from proofgrid.operators import aggregate, diagnostics, layout, profile as profiles, reports
from proofgrid.operators.joins import sliced_join, with_facts
from proofgrid.operators.layout import Blocks
from proofgrid.operators.scoring import score_pairs
from proofgrid.plans.storage import stored
from proofgrid.sources.tables import spread

DEFAULT = ScoringConfig()


class Evaluation(NamedTuple):
    scores: DataFrame
    fields: DataFrame
    records: DataFrame
    overall: DataFrame
    summary: DataFrame
    statistics: DataFrame
    distribution: DataFrame
    report: DataFrame
    diagnostics: DataFrame | None = None


def evaluate_pairs(
    pairs: DataFrame, cfg: ScoringConfig = DEFAULT, value_set_id: str | None = None,
    keep_scores: bool = False, scores_path: str | None = None,
) -> Evaluation:
    """Everything that follows from pairs.

    With ``keep_scores`` the scores are written once and all aggregates read them, so a job that
    needs several results computes each distance once.
    """
    scores = score_pairs(pairs, cfg)
    if keep_scores or scores_path:
        scores = stored(scores, "scores", scores_path)
    fields = aggregate.field_evaluation(scores)
    records = aggregate.record_evaluation(scores)
    return Evaluation(
        scores=scores,
        fields=fields,
        records=records,
        overall=aggregate.overall_accuracy(fields, cfg=cfg),
        summary=aggregate.evaluation_summary(scores, records, cfg),
        statistics=aggregate.field_statistics(scores),
        distribution=aggregate.accuracy_distribution(records),
        report=reports.individual_lines(scores, value_set_id),
    )


def _of_layout(blocks: Blocks, layouts: DataFrame, name: str, cfg: ScoringConfig) -> Blocks:
    mine = layouts.filter(F.col("layout") == name).select("workbook")
    return Blocks(
        blocks.headers.join(mine, "workbook", "left_semi"),
        sliced_join(blocks.data, mine, ["workbook"], "row_idx", cfg.hot_splits),
    )


def _union(parts: list[Blocks]) -> Blocks:
    headers, data = parts[0]
    for part in parts[1:]:
        headers, data = headers.unionByName(part.headers), data.unionByName(part.data)
    return Blocks(headers, data)


def find_blocks(rows: DataFrame, cfg: ScoringConfig = DEFAULT) -> tuple[DataFrame, Blocks]:
    """Layout per workbook and the blocks of all workbooks.

    One pass makes the profiles. Only workbooks that name several models go through the two splits;
    layouts that do not occur cost no scan.
    """
    profile = stored(profiles.workbook_profile(rows), "profile")
    census = profiles.census(profile)
    if census.filter("is_multi_model").isEmpty():
        layouts = census.select("workbook", F.lit("single").alias("layout"))
        return layouts, layout.single_blocks(rows, layouts, profile, cfg)
    multi = stored(profile.filter("model_cells > 1"), "multi-profile")
    several = with_facts(rows, multi.select("workbook"), ["workbook"], "row_idx", cfg.hot_splits)
    several = stored(spread(several), "several")
    vertical = layout.split_vertically(several, cfg)
    horizontal = layout.split_horizontally(several, cfg, multi)
    layouts = stored(layout.choose_layout(census, vertical.headers, horizontal.headers), "layouts")
    present = {r.layout for r in layouts.select("layout").distinct().collect()}  # four names at most
    parts = []
    if "vertical" in present:
        parts.append(_of_layout(vertical, layouts, "vertical", cfg))
    if "horizontal" in present:
        parts.append(_of_layout(horizontal, layouts, "horizontal", cfg))
    if present & {"single", "raw"}:
        parts.append(layout.single_blocks(rows, layouts, profile, cfg))
    return layouts, _union(parts)


def evaluate_workbooks(
    rows: DataFrame, cfg: ScoringConfig = DEFAULT, value_set_id: str | None = None,
    keep_scores: bool = True,
) -> Evaluation:
    """Score all certificate sheets in ``rows``; failed blocks end up in ``diagnostics``."""
    layouts, blocks = find_blocks(rows, cfg)
    pair_map = layout.detect_mapping(blocks, cfg)
    pair_map = stored(pair_map, "pair-map")
    pairs = layout.extract_pairs(blocks.data, pair_map, cfg, layout.lacks_ids(pair_map))
    result = evaluate_pairs(pairs, cfg, value_set_id, keep_scores)
    problems = diagnostics.without_header(layouts, blocks.headers).unionByName(
        diagnostics.without_mapping(pair_map)
    )
    return result._replace(diagnostics=problems)
