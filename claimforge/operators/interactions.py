"""Joint category keys."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

PAIRS = {
    "fe_speaker_subject": ("speaker_clean", "subject_clean"),
    "fe_speaker_party": ("speaker_clean", "party_affiliation_clean"),
    "fe_subject_party": ("subject_clean", "party_affiliation_clean"),
    "fe_speaker_job_subject": ("speaker_job_clean", "subject_clean"),
    "fe_state_party": ("state_info_clean", "party_affiliation_clean"),
}


def have(df: DataFrame, feature: str, *cols: str) -> bool:
    """Warn and report False when a source column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        warnings.warn(f"skipping {feature}: no column {missing}")
    return not missing


def interaction_key(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    if not have(df, out, a, b):
        return df
    return df.withColumn(out, F.concat(X.text(a), F.lit("__"), X.text(b)))


def speaker_length_key(
    df: DataFrame, col: str, statement: str, bins: tuple[int, int] = (50, 150), out: str = "fe_speaker_len_bucket"
) -> DataFrame:
    if not have(df, out, col, statement):
        return df
    bucket = X.length_bucket(X.word_count(X.text(statement)), bins)
    return df.withColumn(out, F.concat(X.text(col), F.lit("__"), bucket))
