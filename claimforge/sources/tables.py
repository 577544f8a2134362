"""Claim tables, score tables and feature tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import require

CLAIM_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("statement", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("speaker_job", T.StringType()),
        T.StructField("state_info", T.StringType()),
        T.StructField("party_affiliation", T.StringType()),
    ]
)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows by ``key`` over all cores, but only when the input has fewer splits than cores.

    A lone small file would run heavy text work on one core. Inputs of cluster size
    have many splits and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def read_claims(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = CLAIM_SCHEMA, labeled: bool = True) -> DataFrame:
    """Typed claim table. CSV cells may span lines and hold doubled quotes.

    Multi-line CSV is read one file per task: store large inputs as many files, or as parquet.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt != "csv":
        raise ValueError("fmt must be 'csv' or 'parquet'")
    if schema is not None and not labeled:
        schema = T.StructType([f for f in schema.fields if f.name != "label"])
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"').option("quoteAll", True).csv(path)


def write_predictions(df: DataFrame, path: str, key: str = "id", label: str = "label", mode: str = "overwrite") -> None:
    """Two columns ``id,label`` with a header."""
    require(df, key, label)
    df.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).write.mode(mode).option("header", True).csv(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("id string, label int").csv(path)


def write_oof(df: DataFrame, path: str, key: str, score: str, label: str, mode: str = "overwrite") -> None:
    """Out-of-fold scores under their real id, for later joins."""
    require(df, key, score, label)
    table = df.select(F.col(key).alias("id"), F.col(score).cast("double").alias("oof_proba"), F.col(label).cast("int").alias("label"))
    table.write.mode(mode).parquet(path)


def write_features(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read, on any file system Spark knows."""
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return True


def first_available_scores(spark: SparkSession, candidates: Sequence[dict[str, str]]) -> tuple[str, dict[str, DataFrame]] | None:
    """First candidate whose every part (``oof``, ``holdout``, ``test``) exists.

    Candidates map part names to paths; ``name`` labels the source.
    """
    for candidate in candidates:
        paths = {k: v for k, v in candidate.items() if k != "name"}
        if all(path_exists(spark, p) for p in paths.values()):
            return candidate["name"], {k: spark.read.parquet(p) for k, p in paths.items()}
    return None
