"""Text and category cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import text as X
from claimforge.functions import words as W
from claimforge.operators import cleaning as C

from .registry import (
    CLAIMS, FULL_CLAIMS, TOPICS, claims, full_claims, query, s_base, s_clean, s_clean_subject, s_in, s_repair, s_squeeze, s_strip, s_unknown,
    s_words, table, topics_view,
)


@query("B1_clean_statement", f"SELECT doc_id, {s_clean('text')} AS text_clean FROM documents")
def b1(spark, sf):
    return C.clean_statement(table(spark, sf, "documents"), "text").select("doc_id", "text_clean")


@query("B1_clean_statement_html", f"SELECT page_id, {s_clean('html')} AS html_clean FROM pages")
def b1_html(spark, sf):
    return C.clean_statement(table(spark, sf, "pages"), "html").select("page_id", "html_clean")


# Every digit run in the tables is a whole token or sits beside ASCII, where \b agrees in both engines.
_NUMBERS = s_squeeze(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(translate(coalesce(text, ''), '“”‘’–—', '\"\"''''--')), "
    "'<[^>]+>', ' ', 'g'), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '\\b\\d+[\\d,.:/-]*\\b', ' num ', 'g'), '[^a-z0-9\\s''?!.,%\\-]', ' ', 'g')"
)


@query("B1_clean_statement_numbers", f"SELECT doc_id, {_NUMBERS} AS text_clean FROM documents")
def b1_numbers(spark, sf):
    return C.clean_statement(table(spark, sf, "documents"), "text", replace_numbers=True).select("doc_id", "text_clean")


@query("B2_repair_statement", f"SELECT doc_id, {s_repair('text')} AS text_original FROM documents")
def b2(spark, sf):
    return C.repair_statement(table(spark, sf, "documents"), "text").select("doc_id", "text_original")


def s_pollution(min_tabs: int) -> str:
    n = "CAST(len(regexp_extract_all(x, '{}')) AS INTEGER)"
    return f"""p1 AS (SELECT doc_id, text, coalesce(text, '') AS x FROM documents),
 p2 AS (SELECT *, CAST(length(x) AS INTEGER) AS statement_length, greatest({s_words('x')}, 1) AS word_count,
   {n.format(chr(92) + 't')} AS tab_count, {n.format('[' + chr(92) + 'n' + chr(92) + 'r]')} AS newline_count,
   {n.format('https?://|www' + chr(92) + '.')} AS url_count, {n.format('[' + chr(34) + chr(39) * 2 + ']')} AS quote_count,
   {n.format('[^A-Za-z0-9' + chr(92) + 's]')} AS special_char_count FROM p1),
 p3 AS (SELECT *, special_char_count / greatest(statement_length, 1) AS special_char_ratio, tab_count / word_count AS tab_to_word_ratio,
   (tab_count >= {min_tabs} OR newline_count > 0) AS row_spillover_flag FROM p2),
 pollution AS (SELECT *, tab_count * 25 + newline_count * 25 + url_count * 4 + quote_count * 2 + special_char_ratio * 10
   + least(tab_to_word_ratio, 10.0::DOUBLE) * 10 + least(statement_length / word_count, 30.0::DOUBLE) AS pollution_score FROM p3)"""


_POLLUTION_COLS = [
    "doc_id", "statement_length", "word_count", "tab_count", "newline_count", "url_count", "quote_count", "special_char_count",
]


@query(
    "B3_pollution_profile",
    f"WITH {s_pollution(1)} SELECT {', '.join(_POLLUTION_COLS)}, row_spillover_flag, round(special_char_ratio, 6) AS special_char_ratio, "
    "round(tab_to_word_ratio, 6) AS tab_to_word_ratio, round(pollution_score, 6) AS pollution_score FROM pollution",
)
def b3(spark, sf):
    p = C.pollution_profile(table(spark, sf, "documents"), "text")
    rounded = [F.round(c, 6).alias(c) for c in ("special_char_ratio", "tab_to_word_ratio", "pollution_score")]
    return p.select(*_POLLUTION_COLS, "row_spillover_flag", *rounded)


@query("B4_tokenize", "SELECT doc_id, array_to_string(regexp_extract_all(text, '\\S+'), '|') AS tokens FROM documents")
def b4(spark, sf):
    return C.tokenize(table(spark, sf, "documents"), "text").select("doc_id", F.array_join("tokens", "|").alias("tokens"))


_PUNCT = W.ASCII_PUNCTUATION.replace("'", "''")


@query(
    "B5_strip_token_punct",
    f"SELECT doc_id, array_to_string([translate(t, '{_PUNCT}', '') FOR t IN regexp_extract_all(text, '\\S+') "
    f"IF translate(t, '{_PUNCT}', '') <> ''], ' ') AS tokens FROM documents",
)
def b5(spark, sf):
    d = C.strip_token_punct(C.tokenize(table(spark, sf, "documents"), "text"))
    return d.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


STOPS = ["the", "a", "and", "of", "to", "in", "is", "that", "for", "it", "not", "no", "la", "de", "der", "und"]


@query(
    "B6_remove_stopwords",
    f"SELECT doc_id, array_to_string([t FOR t IN regexp_extract_all(lower(text), '\\S+') "
    f"IF t NOT IN ({s_in([s for s in STOPS if s not in ('not', 'no')])})], ' ') AS tokens FROM documents",
)
def b6(spark, sf):
    d = C.tokenize(table(spark, sf, "documents").withColumn("text", F.lower("text")), "text")
    return C.remove_stopwords(d, "tokens", STOPS).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


# The dictionary comes from the benchmark texts: a plural-looking form maps to the form without its ending.
_DICT = """dict AS (SELECT DISTINCT form, left(form, length(form) - 1) AS base FROM
  (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS form FROM benchmark) WHERE length(form) > 3 AND form LIKE '%s')"""


def _dictionary(spark, sf):
    form = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("form")
    forms = table(spark, sf, "benchmark").select(form).where((F.length("form") > 3) & F.col("form").endswith("s"))
    return forms.distinct().withColumn("base", F.expr("left(form, length(form) - 1)"))


@query(
    "B7_normalize_tokens_by_dictionary",
    f"""WITH {_DICT}, t AS (SELECT doc_id, unnest(toks) AS form, generate_subscripts(toks, 1) AS pos FROM
      (SELECT doc_id, regexp_extract_all(lower(text), '\\S+') AS toks FROM documents))
    SELECT d.doc_id, coalesce(r.tokens, '') AS tokens FROM documents d LEFT JOIN
      (SELECT doc_id, string_agg(coalesce(base, form), ' ' ORDER BY pos) AS tokens FROM t LEFT JOIN dict USING (form) GROUP BY doc_id) r
      ON d.doc_id = r.doc_id""",
)
def b7(spark, sf):
    d = table(spark, sf, "documents").withColumn("tokens", X.words(F.lower("text"))).select("doc_id", "tokens")
    out = C.normalize_tokens_by_dictionary(d, "doc_id", "tokens", _dictionary(spark, sf))
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def s_contractions(x: str) -> str:
    """Words are wrapped in marker characters so that whole-word rules need no look-around."""
    open_, close = "\x01", "\x02"

    def wrap(s: str) -> str:
        out, word = "", ""
        for ch in s + " ":
            if ch.isalnum():
                word += ch
                continue
            if word:
                out, word = out + open_ + word + close, ""
            out += ch
        return out[:-1].replace("'", "''")

    x = f"translate(lower(coalesce({x}, '')), '’', '''')"
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_]+)', '{open_}\\1{close}', 'g')"
    for form, expansion in W.CONTRACTIONS + W.BARE_CONTRACTIONS + W.NAME_FIXES:
        x = f"replace({x}, '{wrap(form)}', '{wrap(expansion)}')"
    x = f"regexp_replace({x}, '{open_}([a-z]+){close}''{open_}s{close}', '{open_}\\1{close}', 'g')"
    return f"translate({x}, '{open_}{close}', '')"


# Whole table of turns, with spoken forms mixed in by turn so that every rule family is met.
_SPOKEN = "text || CASE turn % 4 WHEN 0 THEN ' I can''t say; they''re here' WHEN 1 THEN ' dont, wont or Obama''s' WHEN 2 THEN ' it’s what weve got' ELSE ' who''d go, let''s' END"


@query("B8_expand_contractions", f"SELECT conv_id, turn, {s_contractions(_SPOKEN)} AS text FROM conversations")
def b8(spark, sf):
    spoken = (
        F.when(F.col("turn") % 4 == 0, " I can't say; they're here").when(F.col("turn") % 4 == 1, " dont, wont or Obama's")
        .when(F.col("turn") % 4 == 2, " it’s what weve got").otherwise(" who'd go, let's")
    )
    c = table(spark, sf, "conversations").withColumn("text", F.concat("text", spoken))
    return C.expand_contractions(c, "text").select("conv_id", "turn", "text")


_B9 = s_contractions("regexp_replace(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), '(?i)\\bNo\\.\\s*(\\d+)', 'number \\1', 'g')")
_B9 = f"regexp_replace(strip_accents({_B9}), '[^\\x00-\\x7F]', '', 'g')"
_B9 = f"lower(regexp_replace({_B9}, '\\S+\\.(?:edu|com|gov|net)\\S*', '', 'g'))"


@query("B9_normalize_unicode_text", f"SELECT doc_id, {_B9} AS text_normalized FROM documents")
def b9(spark, sf):
    return C.normalize_unicode_text(table(spark, sf, "documents"), "text").select("doc_id", "text_normalized")


_B10 = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\d+/\\d+(?:st|nd|rd|th)?', ' fraction ', 'g'), "
    "'\\d+(?:st|nd|rd|th)', ' ordinal ', 'g'), '\\d+(?:[.,]\\d+)*', ' number ', 'g'), '[^a-zA-Z'']', ' ', 'g')"
)


@query(
    "B10_typed_number_tokens",
    f"SELECT doc_id, array_to_string([t FOR t IN regexp_extract_all({_B10}, '\\S+') IF regexp_full_match(t, '[a-zA-Z]{{2,}}')], ' ') AS tokens FROM documents",
)
def b10(spark, sf):
    return C.typed_number_tokens(table(spark, sf, "documents"), "text").select("doc_id", F.array_join("tokens", " ").alias("tokens"))


_LIGHT = {
    "numbers": s_squeeze("regexp_replace(regexp_replace(lower(text), '\\d+', ' number ', 'g'), '[^a-zA-Z\\s]', ' ', 'g')"),
    "social": s_squeeze(
        "regexp_replace(translate(regexp_replace(regexp_replace(lower(text), 'http\\S+|www\\S+', '', 'g'), '[@#][\\p{L}\\p{N}_]+', '', 'g'), "
        f"'{_PUNCT}', ''), '\\d+', '', 'g')"
    ),
    "brackets": s_squeeze("regexp_replace(regexp_replace(lower(text), '\\[[^\\n]*?\\]', '', 'g'), '[^a-z0-9\\s-]', '', 'g')"),
    "annotations": s_strip(f"regexp_replace({s_strip('text')}, '\\([^\\n]*?\\)', '', 'g')"),
}


@query("B11_light_clean", "SELECT doc_id, " + ", ".join(f"{e} AS {v}" for v, e in _LIGHT.items()) + " FROM documents")
def b11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[X.light_clean("text", v).alias(v) for v in _LIGHT])


@query("B12_clean_subject", f"WITH {TOPICS} SELECT p_partkey, {s_clean_subject('subject')} AS subject_clean FROM topics")
def b12(spark, sf):
    return C.clean_category(topics_view(spark, sf), "subject", "subject").select("p_partkey", "subject_clean")


_SPEAKER = s_unknown(s_squeeze(f"regexp_replace(regexp_replace({s_base('c_name')}, '[|/_;,-]+', ' ', 'g'), '[^a-z0-9\\s''.]', ' ', 'g')"))


@query("B13_clean_speaker", f"SELECT c_custkey, {_SPEAKER} AS c_name_clean FROM customer")
def b13(spark, sf):
    return C.clean_category(table(spark, sf, "customer"), "c_name", "speaker").select("c_custkey", "c_name_clean")


_JOB = s_unknown(s_squeeze(f"regexp_replace(regexp_replace({s_base('j')}, '[|/;,&]+', ' ', 'g'), '[^a-z0-9\\s''.-]', ' ', 'g')"))


@query("B14_clean_job", f"SELECT p_partkey, {_JOB} AS job_clean FROM (SELECT p_partkey, p_name || ' / ' || p_brand || ', ' || p_type AS j FROM part)")
def b14(spark, sf):
    p = table(spark, sf, "part").withColumn("job", F.expr("p_name || ' / ' || p_brand || ', ' || p_type"))
    return C.clean_category(p, "job", "job").select("p_partkey", "job_clean")


@query("B15_clean_party", f"SELECT o_orderkey, {s_unknown(s_squeeze(s_base('o_orderpriority')))} AS o_orderpriority_clean FROM orders")
def b15(spark, sf):
    return C.clean_category(table(spark, sf, "orders"), "o_orderpriority", "party").select("o_orderkey", "o_orderpriority_clean")


_STATE = s_unknown(s_squeeze(f"regexp_replace(lower({s_strip('n_name')}), '<[^>]+>', ' ', 'g')"))


@query("B16_clean_state", f"SELECT c_custkey, {_STATE} AS n_name_clean FROM customer JOIN nation ON c_nationkey = n_nationkey")
def b16(spark, sf):
    geo = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return C.clean_state(geo, "n_name").select("c_custkey", "n_name_clean")


@query(
    "B17_normalize_by_lookup",
    "SELECT c_custkey, coalesce(n_name, code) AS place FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'ZZ' ELSE 'N' || c_nationkey END AS code FROM customer) "
    "LEFT JOIN nation ON code = 'N' || n_nationkey",
)
def b17(spark, sf):
    code = F.when(F.col("c_custkey") % 7 == 0, "ZZ").otherwise(F.concat(F.lit("N"), "c_nationkey"))
    c = table(spark, sf, "customer").select("c_custkey", code.alias("place"))
    lookup = table(spark, sf, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("code"), "n_name")
    return C.normalize_by_lookup(c, "place", lookup, "code", "n_name").select("c_custkey", "place")


@query(
    "B18_map_region",
    "SELECT c_custkey, coalesce(r_name, 'unknown') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 6 <> 0 "
    "LEFT JOIN region ON n_regionkey = r_regionkey",
)
def b18(spark, sf):
    n = table(spark, sf, "nation").where(F.col("n_nationkey") % 6 != 0)
    lookup = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = table(spark, sf, "customer")
    return C.map_region(c, "c_nationkey", lookup, "n_nationkey", "r_name", "region").select("c_custkey", "region")




@query(
    "B19_canonicalize_alias",
    "SELECT c_custkey, CASE WHEN s = 'building' THEN 'construction' WHEN contains(s, 'auto') THEN 'cars' WHEN contains(s, 'hold') THEN 'home' "
    "WHEN contains(s, 'mach') THEN 'tools' WHEN s = '' THEN 'unknown' ELSE s END AS segment FROM (SELECT c_custkey, lower(c_mktsegment) AS s FROM customer)",
)
def b19(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.lower("c_mktsegment").alias("segment"))
    # Aliases come from the segments themselves: the one that starts with 'b'.
    aliases = c.where(F.col("segment").startswith("b")).select(F.col("segment").alias("alias"), F.lit("construction").alias("canonical")).distinct()
    rules = [("auto", "cars"), ("hold", "home"), ("mach", "tools")]
    return C.canonicalize_alias(c, "segment", aliases, rules)


@query(
    "B20_fill_category",
    f"WITH {FULL_CLAIMS} SELECT id, lower({s_strip(chr(99) + 'oalesce(subject, ' + chr(39) + 'missing' + chr(39) + ')')}) AS subject, "
    f"lower({s_strip('coalesce(speaker_job, ' + chr(39) + 'missing' + chr(39) + ')')}) AS speaker_job FROM full_claims",
)
def b20(spark, sf):
    return C.fill_category(full_claims(spark, sf), ["subject", "speaker_job"]).select("id", "subject", "speaker_job")


@query(
    "B21_missing_flags",
    f"WITH {FULL_CLAIMS} SELECT id, CAST(label IS NULL AS INTEGER) AS label_missing, CAST(state_info IS NULL AS INTEGER) AS state_info_missing FROM full_claims",
)
def b21(spark, sf):
    return C.missing_flags(full_claims(spark, sf), ["label", "state_info"]).select("id", "label_missing", "state_info_missing")


@query(
    "B22_normalize_label_text",
    "SELECT doc_id, CAST(CASE lower(trim(w)) WHEN 'false' THEN 1 WHEN 'pants-fire' THEN 1 ELSE 0 END AS INTEGER) AS label FROM "
    "(SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN ' Pants-Fire' WHEN quality = 1 THEN 'FALSE' WHEN toxic = 1 THEN 'half' ELSE 'mostly-true' END AS w FROM labels) "
    "WHERE w <> 'half'",
)
def b22(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 1
    w = F.when(q & t, " Pants-Fire").when(q, "FALSE").when(t, "half").otherwise("mostly-true")
    return C.normalize_label(table(spark, sf, "labels").select("doc_id", w.alias("w")), "w").select("doc_id", "label")


@query("B22_normalize_label_rank", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS label FROM (SELECT doc_id, quality + 1 AS y FROM labels)")
def b22_rank(spark, sf):
    y = table(spark, sf, "labels").select("doc_id", (F.col("quality") + 1).alias("y"))
    return C.normalize_label(y, "y").select("doc_id", "label")


@query("B23_label_option_drop", "SELECT doc_id, toxic FROM labels")
def b23(spark, sf):
    return C.label_option(table(spark, sf, "labels"), "drop", "quality")


ROLES = {"statement": "statement", "subject": "subject", "speaker": "speaker", "job": "speaker_job", "state": "state_info", "party": "party_affiliation"}


def _low(c: str, missing: str = "unknown") -> str:
    return f"lower(coalesce({c}, '{missing}'))"


def _piped(c: str) -> str:
    return s_unknown(s_strip(f"lower(coalesce({c}, ''))"))


_TEMPLATES = {
    "piped": f"'speaker: ' || {_piped('speaker')} || ' | party: ' || {_piped('party_affiliation')} || ' | subject: ' || {s_strip('split_part(' + _piped('subject') + ', ' + chr(39) + ',' + chr(39) + ', 1)')} || ' | ' || statement",
    "prefixed": "concat_ws(' | ', 'Speaker: ' || speaker, 'Party: ' || party_affiliation, 'Job: ' || speaker_job, 'State: ' || state_info, 'Topic: ' || subject) || ' [SEP] Claim: ' || statement",
    "labelled": " || ' ' || ".join(
        f"'{p}: ' || {s_strip(_low(c))}"
        for p, c in [("statement", "statement"), ("subject", "subject"), ("speaker", "speaker"), ("job", "speaker_job"), ("state", "state_info"), ("party", "party_affiliation")]
    ),
    "plain": " || ' ' || ".join(f"coalesce({c}, '')" for c in ROLES.values()),
    "said": "'speaker ' || speaker || ' party ' || party_affiliation || ' subject ' || coalesce(subject, 'unknown') || ' said ' || regexp_replace(lower(statement), '[^a-z0-9\\s-]', '', 'g')",
    "sentences": "statement || '. Subject: ' || coalesce(subject, '') || '. Speaker: ' || speaker || '. Job: ' || coalesce(speaker_job, '') || '. State: ' || coalesce(state_info, '') || '. Party: ' || party_affiliation",
    "separated": f"'speaker: ' || {_low('speaker', 'none')} || ' (' || {_low('party_affiliation', 'none')} || ') topic: ' || {_low('subject', 'none')} || ' </s> statement: ' || {_low('statement', 'none')}",
    "statement_last": "'Speaker: ' || speaker || '. Party: ' || party_affiliation || '. Statement: ' || statement",
}


@query("B24_enriched_text", f"WITH {FULL_CLAIMS} SELECT id, " + ", ".join(f"md5({e}) AS {t}" for t, e in _TEMPLATES.items()) + " FROM full_claims")
def b24(spark, sf):
    df = full_claims(spark, sf)
    for t in _TEMPLATES:
        df = C.enriched_text(df, t, ROLES, f"t_{t}")
    return df.select("id", *[F.md5(f"t_{t}").alias(t) for t in _TEMPLATES])


def s_md5_mod(x: str, n: int) -> str:
    chunk = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
    acc = f"{chunk.format(1)} % {n}"
    for start in (9, 17, 25):
        acc = f"(({acc}) * {2**32 % n} + {chunk.format(start)}) % {n}"
    return f"(SELECT CAST({acc} AS INTEGER) FROM (SELECT md5({x}) AS h))"


@query("B25_id_bucket", f"SELECT doc_id, {s_md5_mod('CAST(doc_id AS VARCHAR)', 100)} AS id_bucket, {s_md5_mod('source || doc_id', 7)} AS b7 FROM documents")
def b25(spark, sf):
    d = table(spark, sf, "documents").withColumn("k", F.concat("source", "doc_id"))
    return C.id_bucket(C.id_bucket(d, "doc_id", 100, drop_source=False).withColumn("doc_id", F.col("doc_id").cast("bigint")), "k", 7, "b7").select("doc_id", "id_bucket", "b7")


@query("B26_id_option_pair", f"SELECT n_name, CAST(NULL AS INTEGER) AS id_bucket FROM nation WHERE n_nationkey < 0 UNION ALL SELECT c_name AS n_name, {s_md5_mod('CAST(c_custkey AS VARCHAR)', 100)} FROM customer UNION ALL SELECT s_name, {s_md5_mod('CAST(s_suppkey AS VARCHAR)', 100)} FROM supplier")
def b26(spark, sf):
    train = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("n_name"))
    test = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("n_name"))
    a, b = C.id_option_pair(train, test, "hash_bucket")
    return a.unionByName(b)


@query("B27_first_of_delimited", f"WITH {TOPICS} SELECT p_partkey, {s_unknown(s_strip('split_part(subject, ' + chr(39) + ',' + chr(39) + ', 1)'))} AS subject_primary FROM topics")
def b27(spark, sf):
    return C.first_of_delimited(topics_view(spark, sf), "subject").select("p_partkey", "subject_primary")


@query(
    "B28_coerce_numeric",
    "SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE), 0) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0) AS event_type FROM events",
)
def b28(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.regexp_extract("props", "-?[0-9]+", 0).alias("k"), "event_type")
    return C.coerce_numeric(e, ["k", "event_type"])


@query("B29_separator_clean", f"SELECT o_orderkey, {s_squeeze('translate(lower(o_orderpriority), ' + chr(39) + '-_.,' + chr(39) + ', ' + chr(39) + '    ' + chr(39) + ')')} AS o_orderpriority_clean FROM orders")
def b29(spark, sf):
    return C.separator_clean(table(spark, sf, "orders"), "o_orderpriority", "-_.,").select("o_orderkey", "o_orderpriority_clean")
