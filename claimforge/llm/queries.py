"""Registered queries of the pipeline operators, and the SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_chunks import encode_and_decode
from .decontaminate import find_leaks
from .id_files import round_trip
from .jaccard_join import similar_documents
from .packing import best_fit_pack, token_pieces
from .quality import judge_quality
from .repeats import without_repeats
from .sanitise import KINDS, all_spans, span_string
from .token_counts import token_counts
from .toxicity import fit as fit_toxicity
from .turn_trie import conversation_trie
from .url_rules import UNWANTED_WORDS, judge_urls, rule_table, site_rule, word_rules
from .whitening import whiten

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_pack(digests, order=["doc_id", "piece", "start", "ids_crc32"])


@query("op4_token_id_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49_408)


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


SITE_RULES = [
    site_rule("com", "/", "allow"), site_rule("example.com", "/en/", "block"), site_rule("www.example.com", "/en/", "allow"),
    site_rule("net", "/es/", "block"), site_rule("net", "/fr/", "block"),
]

_HOST = "coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '')"
_PATH = "coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') END, '')"


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


_RULES = [("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/")]
_BLOCKED = ("example.com/en/", "net/es/", "net/fr/")


@query("op2_url_filters", f"""
WITH sites AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
named AS (SELECT *, CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p in _RULES)} END AS rule FROM sites)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN {_BLOCKED} THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(lower(host || path), '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(UNWANTED_WORDS)})([^\\p{{L}}\\p{{N}}]|$)') THEN 'block'
       ELSE 'allow' END AS verdict
FROM named""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, SITE_RULES + word_rules()))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


@query("op9_pii_sanitising")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(F.col("_id").alias("doc_id"), *counts, F.sha2(span_string(base), 256).alias("base_sha256"), span_string(F.col("spans")).alias("spans"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = fit_toxicity(docs, labels.where(~fold)).scores(docs)
    return scored.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op3_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query("op6_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d),
w AS (SELECT doc_id, pos, ws[pos] AS word, CASE WHEN pos <= len(ws) - 19 THEN array_to_string(ws[pos:pos + 19], ' ') END AS seq FROM p),
r AS (SELECT *, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1 AS repeats FROM w),
c AS (SELECT *, max(repeats::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS covered FROM r),
k AS (SELECT doc_id, sum(covered::INTEGER) AS removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT covered) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_ngram_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END AS l FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, unnest(l) AS shingle FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(other), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component._id").alias("component_id"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    n, error = (model.n, model.identity_error) if model else (0, 0.0)
    shares = F.array(*[F.lit(float(v)) for v in model.explained]) if model and len(model.explained) else F.array().cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    found = [(F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened"]
    return each.select("vec_id", *found, F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


# CRC-32 bit by bit over the decimal digits, lowest bit of each first.
_CRC = """xor(list_reduce(flatten(list_transform(range(1, length(c::VARCHAR) + 1), lambda i: list_transform(range(0, 8), lambda b: ((ascii((c::VARCHAR)[i]) >> b) & 1)::BIGINT))),
  lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1)), 4294967295::BIGINT), 4294967295)"""


@query("op12_conversation_trie", f"""
WITH turns AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'said': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT *, ({_CRC} % 6)::INTEGER AS h FROM turns),
rebuilt AS (SELECT a.c, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS seq FROM heads a LEFT JOIN turns b ON b.c = a.c - a.c % 100),
prefixes AS (SELECT c, unnest(range(0, len(seq) + 1)) AS d, seq FROM rebuilt),
members AS (SELECT c, d, CASE WHEN d = 0 THEN [] ELSE seq[1:d] END AS prefix, len(seq) = d AS ended FROM prefixes),
nodes AS (
  SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(prefix[d].said) END AS saved,
    sha256(coalesce(string_agg(CASE WHEN ended THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM members GROUP BY prefix, d),
children AS (SELECT CASE WHEN d = 1 THEN [] ELSE prefix[1:d - 1] END AS prefix, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix, d)),
upwards AS (SELECT *, unnest(range(0, d + 1)) AS up FROM counted),
sums AS (
  SELECT CASE WHEN up = 0 THEN [] ELSE prefix[1:up] END AS prefix, up AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM upwards GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (prefix, d) LEFT JOIN counted p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = CASE WHEN n.d = 1 THEN [] ELSE n.prefix[1:n.d - 1] END""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_bpe_chunks")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
