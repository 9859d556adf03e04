"""Registered queries over the given tables."""

from __future__ import annotations

from proofgrid.catalog import (  # noqa: F401
    certificates,
    document_sheets,
    registry,
    sheets,
    texts,
    typed_documents,
)


def all_queries():
    return dict(registry.QUERIES)


def all_sql():
    return dict(registry.SQL)


flagship = certificates.overall_by_model
