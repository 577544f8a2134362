"""Query registry and the table views queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.sources.tables import spread

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return add


TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as claims: label null where unlabelled."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("text").alias("statement"),
        F.col("source").alias("speaker"), F.col("lang").alias("party_affiliation"),
    )


CLAIMS = """claims AS (
  SELECT d.doc_id AS id, l.quality AS label, d.text AS statement, d.source AS speaker, d.lang AS party_affiliation
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def full_claims(spark: SparkSession, sf: str) -> DataFrame:
    """All eight claim columns; context comes from part, customer and nation by key."""
    part, cust, nation = table(spark, sf, "part"), table(spark, sf, "customer"), table(spark, sf, "nation")
    subject = part.select(F.col("p_partkey").alias("id"), F.concat_ws(",", "p_name", "p_brand", "p_type").alias("subject"))
    place = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("speaker_job"), F.col("n_name").alias("state_info")
    )
    return (
        claims(spark, sf).join(subject, "id", "left").join(place, "id", "left")
        .select("id", "label", "statement", "subject", "speaker", "speaker_job", "state_info", "party_affiliation")
    )


FULL_CLAIMS = CLAIMS + """, full_claims AS (
  SELECT c.id, c.label, c.statement,
         CASE WHEN p.p_partkey IS NOT NULL THEN concat_ws(',', p.p_name, p.p_brand, p.p_type) END AS subject,
         c.speaker, u.c_mktsegment AS speaker_job, n.n_name AS state_info, c.party_affiliation
  FROM claims c LEFT JOIN part p ON p.p_partkey = c.id LEFT JOIN customer u ON u.c_custkey = c.id
  LEFT JOIN nation n ON n.n_nationkey = u.c_nationkey)"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled claims with two deterministic scores and a fold."""
    c = claims(spark, sf).where(F.col("label").isNotNull())
    return c.withColumns(
        {
            "s1": ((F.col("id") * 7919) % 1000).cast("double") / 1000,
            "s2": ((F.col("id") * 104729 + 31) % 1000).cast("double") / 1000,
            "fold": (F.col("id") % 5).cast("int"),
        }
    )


SCORED = CLAIMS + """, scored AS (
  SELECT *, CAST((id * 7919) % 1000 AS DOUBLE) / 1000 AS s1, CAST((id * 104729 + 31) % 1000 AS DOUBLE) / 1000 AS s2,
         CAST(id % 5 AS INTEGER) AS fold
  FROM claims WHERE label IS NOT NULL)"""


def topics_view(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(",", "p_name", "p_brand", "p_type").alias("subject"))


TOPICS = """topics AS (SELECT p_partkey, concat_ws(',', p_name, p_brand, p_type) AS subject FROM part)"""

# --- SQL fragments ----------------------------------------------------------


def s_count(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{pattern}')) AS INTEGER)"


def s_words(x: str) -> str:
    return s_count(x, "\\S+")


def s_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def s_clean(x: str) -> str:
    x = f"lower(translate(coalesce({x}, ''), '“”‘’–—', '\"\"''''--'))"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    x = f"regexp_replace({x}, 'https?://\\S+|www\\.\\S+', ' ', 'g')"
    return s_squeeze(f"regexp_replace({x}, '[^a-z0-9\\s''?!.,%\\-]', ' ', 'g')")


def s_repair(x: str) -> str:
    seg = f"([{s_strip('g')} FOR g IN regexp_split_to_array({x}, '[\\t\\r\\n]+') IF regexp_matches(g, '\\S')])[1]"
    return s_squeeze(f"trim(trim(coalesce({seg}, ''), '\"'), '''')")


def s_base(x: str) -> str:
    x = f"lower({s_strip(f'coalesce({x}, {chr(39)}{chr(39)})')})"
    return f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g')"


def s_unknown(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'unknown')"


def s_topics(x: str) -> str:
    return f"[{s_strip('g')} FOR g IN regexp_split_to_array({x}, '[,|/;]+') IF {s_strip('g')} <> '']"


def s_clean_subject(x: str) -> str:
    x = f"regexp_replace({s_base(x)}, '[|/;]+', ',', 'g')"
    return s_squeeze(f"regexp_replace({x}, '[^a-z0-9,\\s&-]', ' ', 'g')")


def s_terms(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def s_in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
