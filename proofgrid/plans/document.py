"""From document sheets to scores, aggregates and reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from proofgrid.config import ScoringConfig
from proofgrid.operators import aggregate, diagnostics, documents, reports
from proofgrid.operators.scoring import either_side, score_document_pairs
from proofgrid.plans.storage import stored

DEFAULT = ScoringConfig()


class DocumentEvaluation(NamedTuple):
    pair_map: DataFrame
    scores: DataFrame
    fields: DataFrame
    summary: DataFrame
    cases: DataFrame
    report: DataFrame
    diagnostics: DataFrame


def evaluate_documents(
    rows: DataFrame, cfg: ScoringConfig = DEFAULT, value_set_id: str | None = None,
    keep_scores: bool = False, scores_path: str | None = None,
) -> DocumentEvaluation:
    """Score all document sheets in ``rows``."""
    pair_map = stored(documents.document_pair_map(rows), "pair-map")
    scores = score_document_pairs(either_side(documents.document_pairs(rows, pair_map, cfg)), cfg)
    if keep_scores or scores_path:
        scores = stored(scores, "document-scores", scores_path)
    fields = aggregate.document_field_evaluation(scores)
    return DocumentEvaluation(
        pair_map=pair_map,
        scores=scores,
        fields=fields,
        summary=aggregate.document_summary(pair_map, fields, documents.count_cases(rows)),
        cases=aggregate.document_cases_with_texts(scores),
        report=reports.document_lines(aggregate.document_cases(scores), value_set_id),
        diagnostics=diagnostics.short_documents(rows).unionByName(
            diagnostics.documents_without_fields(rows, pair_map)
        ),
    )
