"""Text vectorisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import text as X
from claimforge.operators import vectorize as V

from .registry import query, s_terms, table


def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def r6(c):
    return F.round(c, 6).alias(c)


# (doc, term, tf) over all documents, plus document counts.
_TF = f"""t AS (SELECT doc_id, unnest({s_terms('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM documents)"""


def _weights(local: str, vocab: str, tf: str = "tf", key: str = "doc_id") -> str:
    return f"""raw AS (SELECT {key}, term, {local} * idf AS w FROM {tf} JOIN {vocab} USING (term)),
  norm AS (SELECT {key}, sqrt(sum(w * w)) AS s FROM raw GROUP BY {key})
  SELECT {key}, term, round(w / s, 6) AS value FROM raw JOIN norm USING ({key})"""


@query(
    "I1_tfidf",
    f"WITH {_TF}, v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term), {_weights('tf', 'v')}",
)
def i1(spark, sf):
    return V.tfidf(docs(spark, sf), "doc_id", V.word_terms("text")).select("doc_id", "term", r6("value"))


def _ngram_sql(n: int) -> str:
    pieces = ["SELECT doc_id, unnest(toks) AS term FROM w"]
    for k in range(2, n + 1):
        pieces.append(f"SELECT doc_id, array_to_string(toks[i:i + {k - 1}], ' ') FROM (SELECT doc_id, toks, unnest(range(1, len(toks) - {k - 2})) AS i FROM w)")
    return f"w AS (SELECT doc_id, {s_terms('text')} AS toks FROM documents), t AS ({' UNION ALL '.join(pieces)}), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"


@query("I2_count_ngrams", f"WITH {_ngram_sql(2)} SELECT doc_id, term, tf FROM tf")
def i2(spark, sf):
    return V.count_ngrams(docs(spark, sf), "doc_id", "text")


@query("I3_binary_bow", f"SELECT DISTINCT doc_id, unnest({s_terms('text')}) AS term, CAST(1 AS INTEGER) AS value FROM documents")
def i3(spark, sf):
    return V.binary_bow(docs(spark, sf), "doc_id", "text")


@query(
    "I4_word_tfidf_sublinear",
    f"""WITH {_ngram_sql(2)}, n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n
      HAVING count(*) >= 2 AND count(*) <= 0.9::DOUBLE * n ORDER BY sum(tf) DESC, term LIMIT 5000), {_weights('(1 + ln(tf))', 'v')}""",
)
def i4(spark, sf):
    w = V.tfidf(docs(spark, sf), "doc_id", V.word_terms("text", (1, 2)), 2, 0.9, 5000, sublinear=True)
    return w.select("doc_id", "term", r6("value"))


_CHARS = """p AS (SELECT conv_id || ':' || turn AS k, unnest([' ' || w || ' ' FOR w IN regexp_extract_all(lower(text), '\\S+')]) AS p FROM conversations),
  t AS (SELECT k, unnest([substring(p, i, 3) FOR i IN range(1, length(p) - 1)]) AS term FROM p UNION ALL
        SELECT k, unnest([substring(p, i, 4) FOR i IN range(1, length(p) - 2)]) FROM p UNION ALL
        SELECT k, unnest([substring(p, i, 5) FOR i IN range(1, length(p) - 3)]) FROM p),
  tf AS (SELECT k, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM conversations)"""


@query(
    "I5_char_tfidf",
    f"""WITH {_CHARS}, v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term HAVING count(*) >= 3 ORDER BY sum(tf) DESC, term LIMIT 3000),
      {_weights('(1 + ln(tf))', 'v', key='k')}""",
)
def i5(spark, sf):
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    return V.tfidf(c, "k", V.char_terms("text", (3, 5)), 3, 1.0, 3000, sublinear=True).select("k", "term", r6("value"))


_SPANS = """x AS (SELECT item_id, regexp_replace(lower(text), '\\s\\s+', ' ', 'g') AS x FROM benchmark),
  t AS (SELECT item_id, unnest([substring(x, i, 3) FOR i IN range(1, length(x) - 1)]) AS term FROM x UNION ALL
        SELECT item_id, unnest([substring(x, i, 4) FOR i IN range(1, length(x) - 2)]) FROM x)"""


@query("I5_char_counts_across_text", f"WITH {_SPANS} SELECT item_id, term, count(*) AS tf FROM t GROUP BY ALL")
def i5_across(spark, sf):
    return V.term_counts(table(spark, sf, "benchmark"), "item_id", V.char_terms("text", (3, 4), word_boundary=False))


@query("I6_hashing_tfidf")
def i6(spark, sf):
    d = V.hashing_tfidf(docs(spark, sf), V.word_terms("text"))
    # The vectors are sparse: only the values they hold are added.
    total = F.aggregate(F.unwrap_udt("features")["values"], F.lit(0.0), lambda a, x: a + x)
    return d.select("doc_id", F.round(total, 6).alias("weight_sum"))


@query(
    "I7_vocabulary",
    f"""WITH {_TF} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, round(ln((1 + max(n)) / (1 + count(*))) + 1, 6) AS idf FROM tf, n GROUP BY term, n
      HAVING count(*) >= 2 AND count(*) <= 0.5::DOUBLE * n ORDER BY cf DESC, term LIMIT 2000""",
)
def i7(spark, sf):
    return V.vocabulary(docs(spark, sf), "doc_id", V.word_terms("text"), 2, 0.5, 2000).select("term", "df", "cf", r6("idf"))


@query(
    "I8_transform_with_vocabulary",
    f"""WITH b AS (SELECT item_id, unnest({s_terms('text')}) AS term FROM benchmark), bf AS (SELECT item_id, term, count(*) AS tf FROM b GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark),
      v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM bf, n GROUP BY term),
      t AS (SELECT doc_id, unnest({s_terms('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), {_weights('tf', 'v')}""",
)
def i8(spark, sf):
    vocab = V.vocabulary(table(spark, sf, "benchmark"), "item_id", V.word_terms("text"))
    return V.transform_with_vocabulary(docs(spark, sf), "doc_id", V.word_terms("text"), vocab).select("doc_id", "term", r6("value"))


@query(
    "I9_assemble_blocks",
    f"""SELECT DISTINCT doc_id, 'word:' || unnest({s_terms('text')}) AS term, CAST(1 AS DOUBLE) AS value FROM documents
    UNION ALL SELECT doc_id, 'num:n_chars', CAST(n_chars AS DOUBLE) FROM documents""",
)
def i9(spark, sf):
    nums = table(spark, sf, "documents").select("doc_id", F.lit("n_chars").alias("term"), F.col("n_chars").alias("value"))
    return V.assemble_blocks({"word": V.binary_bow(docs(spark, sf), "doc_id", "text"), "num": nums}, "doc_id")


@query("I10_truncated_svd")
def i10(spark, sf):
    d = docs(spark, sf)
    tr, _, _ = V.tfidf_vectors(d, d, V.word_terms("text"), 300, 2.0)
    return V.truncated_svd(tr, "features", [2, 5, 10])


@query("I11_embed_text")
def i11(spark, sf):
    d = V.embed_text(docs(spark, sf), "text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return d.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 3).alias("norm"))


@query(
    "I11_embeddings_join",
    "SELECT doc_id, len(embedding) AS dim, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
)
def i11_join(spark, sf):
    d = V.embeddings_join(docs(spark, sf), "doc_id", table(spark, sf, "embeddings"), "vec_id", "embedding")
    dim = F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("bigint"))
    return d.select("doc_id", dim.alias("dim"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query(
    "I12_select_k_best_chi2",
    f"""WITH {_TF}, y AS (SELECT doc_id, quality FROM labels), o AS (SELECT term, quality, sum(tf)::DOUBLE AS o FROM tf JOIN y USING (doc_id) GROUP BY ALL),
      c AS (SELECT quality, count(*) / (SELECT count(*) FROM y) AS p FROM y GROUP BY quality), tt AS (SELECT term, sum(o) AS total FROM o GROUP BY term),
      e AS (SELECT term, quality, p * total AS e FROM tt, c)
    SELECT term, round(sum(pow(coalesce(o, 0) - e, 2) / e), 6) AS chi2 FROM e LEFT JOIN o USING (term, quality) GROUP BY term ORDER BY round(sum(pow(coalesce(o, 0) - e, 2) / e), 6) DESC, term LIMIT 200""",
)
def i12(spark, sf):
    tf = V.count_ngrams(docs(spark, sf), "doc_id", "text", (1, 1)).select("doc_id", "term", F.col("tf").cast("double").alias("value"))
    return V.select_k_best_chi2(tf, table(spark, sf, "labels"), "doc_id", "quality", 200).select("term", r6("chi2"))
