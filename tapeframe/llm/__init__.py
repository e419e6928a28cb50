"""Operators of a training-data pipeline. Nothing outside this subpackage and corpus_pipeline.py imports it."""

from .queries import QUERIES, SQL  # noqa: F401
