"""Per-row numeric features and joint keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import text as X
from claimforge.functions import words as W
from claimforge.operators import interactions as I
from claimforge.operators import textstats as S

from .registry import query, s_clean, s_count, s_in, s_repair, s_squeeze, s_strip, s_words, table

_R, _K = s_repair("text"), s_clean("text")


@query(
    "C1_lexical_features",
    f"""SELECT doc_id, CAST(length(o) AS INTEGER) AS original_char_len, {s_words('o')} AS original_word_count,
      round({s_count('o', chr(92) + 'p{Lu}')} / greatest(length(o), 1), 6) AS text_upper_ratio, {s_count('o', '!')} AS text_exclamation_count,
      {s_count('o', chr(92) + '?')} AS text_question_count, round({s_count('c', '[0-9]')} / greatest(length(c), 1), 6) AS clean_digit_ratio
    FROM (SELECT doc_id, {_R} AS o, {_K} AS c FROM documents)""",
)
def c1(spark, sf):
    d = table(spark, sf, "documents").withColumns({"original": X.repair_statement("text"), "clean": X.clean_statement("text")})
    out = S.lexical_features(d, "original", "clean", "text").drop("text", "original", "clean", "lang", "source", "n_chars")
    return out.withColumns({c: F.round(c, 6) for c in ("text_upper_ratio", "clean_digit_ratio")})


@query(
    "C2_manual_text_features",
    f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS length, {s_words('text')} AS word_count,
      round(coalesce(length(regexp_replace(text, '\\s+', '', 'g')) / nullif({s_words('text')}, 0), 0), 6) AS avg_word_length,
      {s_count('text', '!')} AS exclamation, {s_count('text', chr(92) + '?')} AS question,
      round({s_count('text', chr(92) + 'p{Lu}')} / greatest(length(text), 1), 6) AS uppercase_ratio,
      {s_count('text', chr(92) + 'p{Nd}')} AS digit_count, {s_count('text', ',')} AS comma_count FROM documents""",
)
def c2(spark, sf):
    out = S.manual_text_features(table(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_word_length", "uppercase_ratio")})


def _lex(words) -> str:
    return f"CAST(len([t FOR t IN toks IF t IN ({s_in(words)})]) AS INTEGER)"


@query(
    "C3_lexicon_counts",
    f"""SELECT doc_id, {_lex(W.NEGATION_WORDS)} AS fe_negation_count, {_lex(W.HEDGE_WORDS)} AS fe_hedge_count,
      {_lex(W.ABSOLUTIST_WORDS)} AS fe_absolutist_count FROM
      (SELECT doc_id, regexp_extract_all(lower(text || ' ' || CASE doc_id % 3 WHEN 0 THEN 'Never say maybe, not all lies' WHEN 1 THEN 'can''t always; nothing'
        ELSE 'seems certain' END), '[a-z'']+') AS toks FROM documents)""",
)
def c3(spark, sf):
    said = F.when(F.col("doc_id") % 3 == 0, "Never say maybe, not all lies").when(F.col("doc_id") % 3 == 1, "can't always; nothing").otherwise("seems certain")
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "text", said).alias("text"))
    return S.lexicon_counts(d, "text").drop("text")


@query("C4_numeral_count", f"SELECT doc_id, {s_count('text', '[0-9]+')} AS fe_numeral_count FROM documents")
def c4(spark, sf):
    return S.numeral_count(table(spark, sf, "documents"), "text").select("doc_id", "fe_numeral_count")


_MARKED = "regexp_replace(" + s_squeeze("text") + ", '([.!?]) ', '\\1' || chr(10), 'g')"


@query(
    "C5_proper_noun_count",
    f"""SELECT doc_id, CAST(list_sum([len([w FOR w IN string_split(s, ' ')[2:] IF regexp_full_match(w, '\\p{{Lu}}\\p{{L}}*')])
      FOR s IN string_split({_MARKED}, chr(10))]) AS INTEGER) AS fe_proper_noun_count FROM documents""",
)
def c5(spark, sf):
    return S.proper_noun_count(table(spark, sf, "documents"), "text").select("doc_id", "fe_proper_noun_count")


_SYL = (
    "CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiou]+')) - "
    "CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiou]+')) > 1 THEN 1 ELSE 0 END) END"
)


@query(
    "C6_flesch_reading_ease",
    f"""SELECT doc_id, round(CASE WHEN n = 0 THEN 0 ELSE 206.835::DOUBLE - 1.015::DOUBLE * (n / sents) - 84.6::DOUBLE * (syl / n) END, 6) AS fe_readability FROM
     (SELECT doc_id, len(string_split_regex({s_strip('text')}, '[.!?]+')) AS sents, len(regexp_extract_all(text, '\\S+')) AS n,
        list_sum([{_SYL} FOR w IN [regexp_replace(lower(t), '[^a-z]', '', 'g') FOR t IN regexp_extract_all(text, '\\S+')]]) AS syl FROM documents)""",
)
def c6(spark, sf):
    d = S.flesch_reading_ease(table(spark, sf, "documents"), "text")
    return d.select("doc_id", F.round("fe_readability", 6).alias("fe_readability"))


_BUCKET = "CASE WHEN {n} < 50 THEN 'short' WHEN {n} <= 150 THEN 'medium' ELSE 'long' END"


@query("C7_length_bucket", f"SELECT doc_id, {_BUCKET.format(n=s_words('text'))} AS length_bucket FROM documents")
def c7(spark, sf):
    return S.length_bucket(table(spark, sf, "documents"), "text").select("doc_id", "length_bucket")


@query(
    "C8_shape_features",
    f"""SELECT o_orderkey, CAST(length(c) AS INTEGER) AS p_char_len, {s_words('c')} AS p_token_count, CAST(contains(r, '/') AS INTEGER) AS p_has_slash,
      CAST(contains(r, '&') AS INTEGER) AS p_has_ampersand, CAST(contains(r, ',') AS INTEGER) AS p_has_comma, CAST(contains(r, '.') AS INTEGER) AS p_has_period,
      CAST(regexp_matches(r, '[()]') AS INTEGER) AS p_has_parentheses
    FROM (SELECT o_orderkey, o_orderpriority || CASE o_orderkey % 4 WHEN 0 THEN ' (x)' WHEN 1 THEN ' a/b & c' WHEN 2 THEN ', etc.' ELSE '' END AS r,
      lower(o_orderpriority) AS c FROM orders)""",
)
def c8(spark, sf):
    tail = F.when(F.col("o_orderkey") % 4 == 0, " (x)").when(F.col("o_orderkey") % 4 == 1, " a/b & c").when(F.col("o_orderkey") % 4 == 2, ", etc.").otherwise("")
    o = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", tail).alias("r"), F.lower("o_orderpriority").alias("c"))
    flags = ["slash", "ampersand", "comma", "period", "parentheses"]
    return S.shape_features(o, "r", "c", flags, "p").drop("r", "c")


def _title(words) -> str:
    return f"CAST(regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])') AS INTEGER)"


_WITH_TITLES = "text || CASE doc_id % 5 WHEN 0 THEN ' Dr. Who' WHEN 1 THEN ' the CEO' WHEN 2 THEN ' drastic' ELSE '' END"


@query(
    "C9_title_flag",
    f"SELECT doc_id, {_title(W.SPEAKER_TITLES)} AS speaker_title, {_title(W.JOB_TITLES)} AS job_title FROM (SELECT doc_id, {_WITH_TITLES} AS t FROM documents)",
)
def c9(spark, sf):
    tail = F.when(F.col("doc_id") % 5 == 0, " Dr. Who").when(F.col("doc_id") % 5 == 1, " the CEO").when(F.col("doc_id") % 5 == 2, " drastic").otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return S.title_flag(S.title_flag(d, "t", W.SPEAKER_TITLES, "speaker_title"), "t", W.JOB_TITLES, "job_title").drop("t")


@query(
    "C10_membership_flags",
    "SELECT c_custkey, CAST(c_mktsegment IN ('BUILDING', 'MACHINERY') AS INTEGER) AS is_industrial, "
    "CAST(regexp_matches(lower(c_mktsegment) || CASE c_custkey % 3 WHEN 0 THEN ' us' ELSE 'us' END, '(^|[^\\p{L}\\p{N}_])(us|united states|usa)($|[^\\p{L}\\p{N}_])') AS INTEGER) AS has_us_words FROM customer",
)
def c10(spark, sf):
    c = table(spark, sf, "customer")
    c = c.withColumn("s", F.concat(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, " us").otherwise("us")))
    c = S.membership_flag(c, "c_mktsegment", ["BUILDING", "MACHINERY"], "is_industrial")
    return S.us_words_flag(c, "s", "has_us_words").select("c_custkey", "is_industrial", "has_us_words")


_DENSE = "[.,!?;:\"''\\-()\\[\\]{}]"


@query(
    "C11_density_features",
    f"SELECT doc_id, round({s_count('text', _DENSE)} / greatest(length(text), 1), 6) AS punct_density, "
    f"round({s_count('text', '[0-9]')} / greatest(length(text), 1), 6) AS digit_ratio FROM documents",
)
def c11(spark, sf):
    d = S.density_features(table(spark, sf, "documents"), "text")
    return d.select("doc_id", F.round("punct_density", 6).alias("punct_density"), F.round("digit_ratio", 6).alias("digit_ratio"))


_WRAPPED = "regexp_replace(lower(t), '([\\p{L}\\p{N}_]+)', chr(1) || '\\1' || chr(2), 'g')"
_NEG_ALTS = "|".join("\x01" + w.replace("'", "\x02''\x01") + "\x02" for w in W.NEGATION_FORMS)
_PUNCT_CLASS = "[!-/:-@\\[-`{-~]"


@query(
    "C12_basic_text_stats",
    f"""SELECT doc_id, {s_words('t')} AS word_count, {s_count('t', _PUNCT_CLASS)} AS punct_count, {s_count(_WRAPPED, _NEG_ALTS)} AS neg_count,
      CAST(len([w FOR w IN regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+') IF regexp_full_match(w, '[0-9]+')]) AS INTEGER) AS num_count
    FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' Can''t, won''t; NOT now 12 a34' WHEN 1 THEN ' nobody said no-one isn''t' ELSE '' END AS t FROM documents)""",
)
def c12(spark, sf):
    tail = F.when(F.col("doc_id") % 3 == 0, " Can't, won't; NOT now 12 a34").when(F.col("doc_id") % 3 == 1, " nobody said no-one isn't").otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return S.basic_text_stats(d, "t").drop("t")


# Lexicon derived from the benchmark texts: polarity by word length, subjectivity by first letter.
_LEXICON = """lex AS (SELECT DISTINCT w AS word, (length(w) % 5 - 2) / 2.0::DOUBLE AS polarity, CASE WHEN w < 'm' THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS subjectivity
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark))"""


@query(
    "C13_lexicon_sentiment",
    f"""WITH {_LEXICON}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents),
      m AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM t JOIN lex USING (word) GROUP BY doc_id)
    SELECT d.doc_id, round(coalesce(p, 0), 6) AS fe_sentiment_polarity, round(coalesce(s, 0), 6) AS fe_sentiment_subjectivity
    FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""",
)
def c13(spark, sf):
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    lex = table(spark, sf, "benchmark").select(w).distinct().select(
        "word", ((F.length("word") % 5 - 2) / 2).alias("polarity"), F.when(F.col("word") < "m", 0.25).otherwise(0.75).alias("subjectivity")
    )
    out = S.lexicon_sentiment(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", lex)
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("fe_sentiment_polarity", "fe_sentiment_subjectivity")])


_GAZ = """b AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '\\S+')) AS w FROM benchmark)),
  pairs AS (SELECT DISTINCT toks[i] || ' ' || toks[i + 1] AS w FROM (SELECT toks, unnest(range(1, len(toks))) AS i FROM (SELECT regexp_extract_all(text, '\\S+') AS toks FROM benchmark))),
  gaz AS (SELECT w AS phrase, CASE WHEN length(w) % 7 = 0 THEN 'PERSON' WHEN length(w) % 7 = 1 THEN 'MONEY' WHEN length(w) % 7 = 2 THEN 'GPE' WHEN length(w) % 7 = 3 THEN 'EVENT'
    WHEN length(w) % 7 = 4 THEN 'ORG' ELSE 'DATE' END AS type FROM (SELECT * FROM b UNION SELECT * FROM pairs)),
  toks AS (SELECT doc_id, regexp_extract_all(text, '\\S+') AS toks FROM documents),
  g AS (SELECT doc_id, unnest(toks) AS phrase FROM toks UNION ALL SELECT doc_id, toks[i] || ' ' || toks[i + 1] FROM (SELECT doc_id, toks, unnest(range(1, len(toks))) AS i FROM toks)),
  h AS (SELECT doc_id, count(*) AS n_all, count(*) FILTER (type = 'PERSON') AS n_p, count(*) FILTER (type = 'ORG') AS n_o, count(*) FILTER (type = 'GPE') AS n_g,
    count(*) FILTER (type = 'DATE') AS n_d, count(*) FILTER (type = 'MONEY') AS n_n, count(*) FILTER (type = 'EVENT') AS n_x FROM g JOIN gaz USING (phrase) GROUP BY doc_id)"""


def _gazetteer(spark, sf):
    toks = table(spark, sf, "benchmark").select(X.words(F.col("text")).alias("t"))
    phrases = toks.select(F.explode(X.ngrams(F.col("t"), 1, 2)).alias("phrase")).distinct()
    n = F.length("phrase") % 7
    kind = F.when(n == 0, "PERSON").when(n == 1, "MONEY").when(n == 2, "GPE").when(n == 3, "EVENT").when(n == 4, "ORG").otherwise("DATE")
    return phrases.withColumn("type", kind)


@query(
    "C14_gazetteer_entity_counts",
    f"""WITH {_GAZ} SELECT d.doc_id, coalesce(n_all, 0) AS entity_total_entities, coalesce(n_p, 0) AS "entity_PERSON", coalesce(n_o, 0) AS "entity_ORG",
      coalesce(n_g, 0) AS "entity_GPE", coalesce(n_d, 0) AS "entity_DATE", coalesce(n_n, 0) AS "entity_NUM", coalesce(n_x, 0) AS "entity_OTHER"
    FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id""",
)
def c14(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return S.gazetteer_entity_counts(d, "doc_id", "text", _gazetteer(spark, sf)).drop("text")


@query(
    "C15_oov_count",
    """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\S+')) AS word FROM benchmark),
      t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '\\S+'))) AS word FROM documents),
      o AS (SELECT doc_id, count(*) AS n FROM t ANTI JOIN v USING (word) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS oov, CAST(len([w FOR w IN regexp_extract_all(text, '\\S+') IF NOT regexp_matches(w, '\\p{L}')]) AS BIGINT) AS no_letter
    FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id""",
)
def c15(spark, sf):
    vocab = table(spark, sf, "benchmark").select(F.explode(X.words(F.lower("text"))).alias("word"))
    d = table(spark, sf, "documents").select("doc_id", X.words(F.col("text")).alias("tokens"))
    return S.oov_count(S.oov_count(d, "doc_id", "tokens", vocab, "oov"), "doc_id", "tokens", out="no_letter").drop("tokens")


@query(
    "C16_rare_token_features",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents), f AS (SELECT w, count(*) AS freq FROM t GROUP BY w),
      r AS (SELECT doc_id, count(*) FILTER (freq <= 1) AS rare, avg(freq) AS af FROM t JOIN f USING (w) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(rare, 0) AS rare_token_count, round(coalesce(af, 0), 6) AS avg_token_freq FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id""",
)
def c16(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.words(F.lower("text")).alias("tokens"))
    return S.rare_token_features(d, "doc_id", "tokens").select("doc_id", "rare_token_count", F.round("avg_token_freq", 6).alias("avg_token_freq"))


@query(
    "C17_softmax_score",
    """SELECT vec_id, round(exp(v[2] - m) / list_sum([exp(x - m) FOR x IN v]), 6) AS proba, CAST(list_position(v, m) - 1 AS INTEGER) AS pred
    FROM (SELECT vec_id, v, list_max(v) AS m FROM (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings))""",
)
def c17(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return S.softmax_score(e, "v").select("vec_id", F.round("proba", 6).alias("proba"), "pred")


@query("F1_interaction_key", "SELECT o_orderkey, o_orderstatus || '__' || o_orderpriority AS fe_pair FROM orders")
def f1(spark, sf):
    return I.interaction_key(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", "fe_pair").select("o_orderkey", "fe_pair")


@query("F2_speaker_length_key", f"SELECT doc_id, source || '__' || {_BUCKET.format(n=s_words('text'))} AS fe_speaker_len_bucket FROM documents")
def f2(spark, sf):
    return I.speaker_length_key(table(spark, sf, "documents"), "source", "text").select("doc_id", "fe_speaker_len_bucket")
