"""A corpus from raw documents to packed sequences, one operator a stage.

Each stage takes all its predecessor kept and returns the columns of documents; the last returns the packed
pieces. ``run`` writes every stage as Parquet in the shared folder and reads it back, so that a stage is
worked out once and a lost executor costs no more than its own stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm.common import written
from claimforge.llm.decontaminate import find_leaks
from claimforge.llm.jaccard_join import one_of_each
from claimforge.llm.packing import best_fit_pack, token_pieces
from claimforge.llm.quality import judge_quality
from claimforge.llm.sanitise import sanitise

#: SQL cannot express the learnt references, the latent space or the tokenizer.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality rules keep."""
    return judge_quality(docs).where("kept").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows that share an id, or have none, are told apart by their text."""
    row = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64("doc_id", F.coalesce("text", F.lit("\x00"))))
    named = docs.withColumn("_leaking_row", row)
    leaked = find_leaks(named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_leaking_row").select("_leaking_row").distinct()
    return named.join(leaked, "_leaking_row", "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sanitised; ``n_chars`` follows the text."""
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_pack(digests, order=["doc_id", "piece", "start", "ids_crc32"])


STAGES = [
    ("quality_rules", keep_good),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)[0]
    return docs
