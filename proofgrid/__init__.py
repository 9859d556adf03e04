"""Prediction-versus-truth evaluation as Spark DataFrame jobs."""

from proofgrid.config import ScoringConfig

__all__ = ["ScoringConfig"]
