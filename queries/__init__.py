"""Checked queries: each runs an operator over whole tables, most with DuckDB SQL beside it."""

from . import bundles_models, categories, classifiers, cleaning, evaluation, features, profiling, sets, sources, vectors  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
