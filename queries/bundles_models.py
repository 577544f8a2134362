"""Model fitting, bundles and the whole preparation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from claimforge.functions import words as W
from claimforge.operators import encode as E
from claimforge.operators import evaluate as N
from claimforge.operators import models as O
from claimforge.operators import prepare as Q
from claimforge.operators import splits as K
from claimforge.operators import target as G
from claimforge.operators import textstats as S
from claimforge.operators import vectorize as V
from claimforge.session import scratch_path
from claimforge.sources import bundles as BN

from .categories import r6
from .cleaning import _B9, _B10, _JOB, _SPEAKER, _STATE
from .features import _SYL, _lex, _title
from .registry import (
    CLAIMS, FULL_CLAIMS, full_claims, query, s_base, s_clean, s_clean_subject, s_count, s_repair, s_squeeze, s_strip, s_terms, s_topics, s_unknown, s_words, scored, table,
)

NUMERIC = ["length", "word_count", "avg_word_length", "exclamation", "question", "uppercase_ratio", "digit_count", "comma_count"]


def model_frame(spark, sf):
    """Labelled claims with text statistics, an out-of-fold speaker rate and balanced weights."""
    d = S.manual_text_features(scored(spark, sf), "statement")
    d = G.oof_rate(d, "speaker", "label", "fold", "speaker_rate")
    d = K.add_class_weights(d, "label").select("id", "label", "fold", "weight", *NUMERIC, "speaker_rate")
    raw = O.assemble(d, [*NUMERIC, "speaker_rate"], "raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    return O.cache_for_fit(scaler.fit(raw).transform(raw).select("id", "label", "fold", "weight", "features"))


def logistic(df, **params):
    return O.fit_logistic(df, weight="weight", max_iter=25, **params)


def score_all(model, df):
    return O.add_score(model, df, "score").select("id", "label", F.round("score", 6).alias("score"))


@query("O1_fit_logistic")
def o1(spark, sf):
    d = model_frame(spark, sf)
    return score_all(logistic(d, C=1.0, l1_ratio=0.2), d)


@query("O2_fit_linear_svm")
def o2(spark, sf):
    d = model_frame(spark, sf)
    return score_all(O.fit_linear_svm(d, weight="weight", max_iter=15), d)


@query("O4_fit_random_forest")
def o4(spark, sf):
    d = model_frame(spark, sf)
    return score_all(O.fit_random_forest(d, trees=10, depth=4, weight="weight"), d)


@query("O5_fit_gbt")
def o5(spark, sf):
    d = model_frame(spark, sf).withColumn("is_val", F.col("fold") == 0)
    return score_all(O.fit_gbt(d, rounds=5, depth=3, weight="weight", validation="is_val"), d)


@query("O6_calibrate")
def o6(spark, sf):
    d = model_frame(spark, sf)
    out = O.calibrate(d, d, "fold", range(5), logistic, "label", "id", "isotonic")
    return out.select("id", F.round("score", 6).alias("score"))


@query("O7_random_search")
def o7(spark, sf):
    d = model_frame(spark, sf)
    draws = O.random_draws({"C": O.log_uniform(1e-3, 10), "l1_ratio": [0.0, 1.0]}, 3)
    ranked = O.search(d, "label", "fold", range(5), logistic, draws)
    return spark.createDataFrame([(i, r["C"], r["l1_ratio"], r["mean_macro_f1"]) for i, r in enumerate(ranked)], "rank int, C double, l1_ratio double, macro_f1 double")


@query("O9_oof_predict")
def o9(spark, sf):
    d = model_frame(spark, sf)
    oof = O.oof_predict(d, "fold", range(5), logistic)
    return oof.select("id", "fold", "label", F.round("oof_proba", 6).alias("oof_proba"))


@query("O10_stack")
def o10(spark, sf):
    d = model_frame(spark, sf)
    lr = O.oof_predict(d, "fold", range(5), logistic).select("id", "label", "oof_proba")
    rf = O.oof_predict(d, "fold", range(5), lambda x: O.fit_random_forest(x, trees=5, depth=3)).select("id", "oof_proba")
    model, joined, _ = O.stack({"lr": lr, "rf": rf}, "label")
    return score_all(model, joined)


@query("N10_feature_ranking")
def n10(spark, sf):
    d = model_frame(spark, sf)
    model = O.fit_random_forest(d, trees=10, depth=4)
    return N.feature_ranking(spark, [*NUMERIC, "speaker_rate"], model.featureImportances.toArray().tolist())


_ROLES = {"id": "numeric", **{c: "text" for c in ("statement", "subject", "speaker", "speaker_job", "state_info", "party_affiliation")}}


@query("J3_column_roles", f"WITH {FULL_CLAIMS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{r}' AS role, count({c}) AS filled, count(DISTINCT {c}) AS distinct_values FROM full_claims" for c, r in _ROLES.items()
))
def j3(spark, sf):
    return E.column_role_table(full_claims(spark, sf))


# --- preparation ------------------------------------------------------------

_PARTY = s_unknown(s_squeeze(s_base("party_affiliation")))


def _on(expr: str, old: str, new: str) -> str:
    return expr.replace(old, new)


_CLEAN_COLS = {
    "subject_clean": s_clean_subject("subject"),
    "statement_clean": s_clean(s_repair("statement")),
    "speaker_clean": _on(_SPEAKER, "c_name", "speaker"),
    "speaker_job_clean": _on(_JOB, "coalesce(j,", "coalesce(speaker_job,"),
    "party_affiliation_clean": _PARTY,
    "state_info_clean": _on(_STATE, "n_name", "coalesce(state_info, '')"),
}


@query("Q1_prepare_default", f"WITH {FULL_CLAIMS} SELECT label, statement, " + ", ".join(f"{e} AS {c}" for c, e in _CLEAN_COLS.items()) + " FROM full_claims")
def q1(spark, sf):
    return Q.prepare(full_claims(spark, sf))


_FLAT = dict(
    id_option="hash_bucket", label_option="drop", subject_add_primary=True, subject_add_topic_count=True, speaker_add_frequency=True,
    speaker_add_grouped_speaker=True, speaker_group_rare=True, speaker_job_add_length_features=True, state_add_us_region=True, statement_add_lexical_features=True,
    fe_add_speaker_party=True, fe_add_negation_count=True,
)


@query(
    "Q1_prepare_flat_options",
    f"""WITH {FULL_CLAIMS}, c AS (SELECT id, statement, {', '.join(f'{e} AS {c}' for c, e in _CLEAN_COLS.items())}, {s_repair('statement')} AS o FROM full_claims),
      t AS (SELECT *, {s_topics('subject_clean')} AS topics, count(*) OVER (PARTITION BY speaker_clean) AS n FROM c)
    SELECT statement, subject_clean, statement_clean, speaker_clean, speaker_job_clean, party_affiliation_clean, state_info_clean, coalesce(topics[1], 'unknown') AS subject_primary,
      CAST(len(topics) AS INTEGER) AS subject_topic_count, n AS speaker_frequency, round(n / (SELECT count(*) FROM t), 6) AS speaker_frequency_pct, CASE WHEN n < 5 THEN 'other' ELSE speaker_clean END AS speaker_grouped,
      CAST(length(speaker_job_clean) AS INTEGER) AS speaker_job_char_len, 'unknown' AS state_info_us_region,
      CAST(length(o) AS INTEGER) AS statement_original_char_len, {s_words('o')} AS statement_original_word_count, round({s_count('o', chr(92) + 'p{Lu}')} / greatest(length(o), 1), 6) AS statement_upper_ratio,
      {s_count('o', '!')} AS statement_exclamation_count, {s_count('o', chr(92) + '?')} AS statement_question_count, round({s_count('statement_clean', '[0-9]')} / greatest(length(statement_clean), 1), 6) AS statement_clean_digit_ratio,
      speaker_clean || '__' || party_affiliation_clean AS fe_speaker_party, (SELECT {_lex(W.NEGATION_WORDS)} FROM (SELECT regexp_extract_all(statement_clean, '[a-z'']+') AS toks)) AS fe_negation_count,
      (SELECT CAST(((((CAST('0x' || substr(h, 1, 8) AS BIGINT) % 100) * 96 + CAST('0x' || substr(h, 9, 8) AS BIGINT)) % 100 * 96 + CAST('0x' || substr(h, 17, 8) AS BIGINT)) % 100 * 96 + CAST('0x' || substr(h, 25, 8) AS BIGINT)) % 100 AS INTEGER)
        FROM (SELECT md5(CAST(id AS VARCHAR)) AS h)) AS id_bucket FROM t""",
)
def q1_flat(spark, sf):
    d = Q.prepare(full_claims(spark, sf), Q.PrepareOptions.from_flat(**_FLAT))
    return d.withColumns({c: F.round(c, 6) for c in ("speaker_frequency_pct", "statement_upper_ratio", "statement_clean_digit_ratio")})


_STOPS = ["the", "and", "of", "to", "no"]
_TOPIC_FLAGS = ["economy", "large", "medium", "promo", "small", "standard"]
_TYPED = _B10.replace("coalesce(text, '')", "b9")


@query(
    "Q2_prepare_topn",
    f"""WITH {FULL_CLAIMS}, p AS (SELECT label, CAST(speaker_job IS NULL AS INTEGER) AS speaker_job_missing, CAST(state_info IS NULL AS INTEGER) AS state_info_missing, lower(speaker) AS speaker,
      lower(coalesce(speaker_job, 'missing')) AS speaker_job, lower(coalesce(state_info, 'missing')) AS state_info, lower(party_affiliation) AS party_affiliation, {_B9.replace('(text,', '(statement,')} AS b9,
      [{s_strip('x')} FOR x IN string_split(lower(coalesce(subject, 'missing')), ',')] AS sl FROM full_claims),
      ts AS (SELECT speaker AS v FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10), tj AS (SELECT speaker_job AS v FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
      tt AS (SELECT state_info AS v FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
    SELECT label, speaker_job_missing, state_info_missing, speaker, speaker_job, state_info, party_affiliation, b9 AS statement_normalized,
      array_to_string([t FOR t IN regexp_extract_all({_TYPED}, '\\S+') IF regexp_full_match(t, '[a-zA-Z]{{2,}}') AND t NOT IN ('the', 'and', 'of', 'to')], ' ') AS statement_clean,
      {', '.join(f"CAST(list_contains(sl, '{v}') AS INTEGER) AS subject_{v}" for v in _TOPIC_FLAGS)},
      CASE WHEN speaker IN (SELECT v FROM ts) THEN speaker ELSE 'other' END AS speaker_top, CASE WHEN speaker_job IN (SELECT v FROM tj) THEN speaker_job ELSE 'other' END AS speaker_job_top,
      CASE WHEN state_info IN (SELECT v FROM tt) THEN state_info ELSE 'other' END AS state_info_top, 'other' AS party_top FROM p""",
)
def q2(spark, sf):
    d = Q.prepare_topn(full_claims(spark, sf), 10, 3, 8, stoplist=_STOPS, vocabulary=_TOPIC_FLAGS)
    return d.drop("statement", "subject", "subject_list")


def s_preset(raw: str, clean: str, flags: dict[str, str], threshold: int = 5) -> str:
    extra = "".join(f", CAST({e} AS INTEGER) AS {raw}_{n}" for n, e in flags.items())
    return f"""WITH {FULL_CLAIMS}, c AS (SELECT id, coalesce({raw}, '') AS r, {clean} AS v FROM full_claims), n AS (SELECT *, count(*) OVER (PARTITION BY v) AS n FROM c)
    SELECT id, v AS {raw}_clean, n AS {raw}_frequency, round(n / (SELECT count(*) FROM c), 6) AS {raw}_frequency_pct, CAST(n < {threshold} AS INTEGER) AS {raw}_is_rare,
      CASE WHEN n < {threshold} THEN 'other' ELSE v END AS {raw}_grouped, CAST(length(v) AS INTEGER) AS {raw}_char_len, {s_words('v')} AS {raw}_token_count{extra} FROM n"""


_COMMA, _SLASH, _AMP, _DOT = "contains(r, ',')", "contains(r, '/')", "contains(r, '&')", "contains(r, '.')"


def _preset_query(group: str, name: str, drop: tuple[str, ...] = ()):
    def run(spark, sf):
        o = Q.preset(group, name)
        d = Q.prepare_category(full_claims(spark, sf), o)
        keep = ["id", *[c for c in d.columns if c.startswith(o.source_col + "_")]]
        # speaker_job is a column of its own, not a feature of speaker
        keep = [c for c in keep if c != "speaker_job"]
        pct = f"{o.source_col}_frequency_pct"
        return d.select(*keep).withColumn(pct, F.round(pct, 6))

    return run


query("Q5_preset_speaker_expanded", s_preset("speaker", _CLEAN_COLS["speaker_clean"], {"has_title": _title(W.SPEAKER_TITLES).replace("(t,", "(r,"), "has_comma": _COMMA, "has_period": _DOT}))(
    _preset_query("speaker", "expanded")
)
query("Q5_preset_job_rare_safe", s_preset("speaker_job", _CLEAN_COLS["speaker_job_clean"], {"has_title": _title(W.JOB_TITLES).replace("(t,", "(r,"), "has_comma": _COMMA, "has_slash": _SLASH, "has_ampersand": _AMP}))(
    _preset_query("speaker_job", "rare_safe")
)
query(
    "Q5_preset_party_expanded",
    s_preset(
        "party_affiliation", _PARTY,
        {"has_slash": _SLASH, "has_ampersand": _AMP, "has_comma": _COMMA, "has_parentheses": "regexp_matches(r, '[()]')", "is_major_party": "v IN ('democrat', 'republican')", "is_institutional": "v IN ('journalist', 'activist')"},
    ),
)(_preset_query("party_affiliation", "expanded"))
query("Q5_preset_state_rare_safe", s_preset("state_info", _CLEAN_COLS["state_info_clean"], {"is_us_state": "v IN ('ohio')", "has_us_words": "v = 'usa'"}))(_preset_query("state", "rare_safe"))


_E4_PRESET = f"""WITH {FULL_CLAIMS}, c AS (SELECT id, {s_clean_subject('subject')} AS s FROM full_claims), t AS (SELECT id, s, {s_topics('s')} AS t FROM c),
  x AS (SELECT id, unnest(t) AS topic, generate_subscripts(t, 1) AS pos FROM t), g AS (SELECT topic, count(*) AS n FROM x GROUP BY 1),
  m AS (SELECT id, topic FROM x JOIN g USING (topic) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, length(topic) DESC, pos) = 1),
  p AS (SELECT t.*, CASE WHEN len(t) > 3 THEN 'multi-topic' ELSE coalesce(topic, 'unknown') END AS prim FROM t LEFT JOIN m USING (id)), n AS (SELECT *, count(*) OVER (PARTITION BY prim) AS n FROM p)
  SELECT id, s AS subject_clean, CAST(len(t) AS INTEGER) AS subject_topic_count, CAST(len(t) > 1 AS INTEGER) AS subject_has_multiple_topics, CAST(length(s) AS INTEGER) AS subject_length, {s_words('s')} AS subject_token_count,
    prim AS subject_primary, n AS subject_frequency, CAST(n < 10 AS INTEGER) AS subject_is_rare, CASE WHEN n < 10 THEN 'other' ELSE prim END AS subject_primary_grouped FROM n"""


@query("Q5_preset_subject_rare_safe", _E4_PRESET)
def q5_subject(spark, sf):
    d = Q.prepare_subject(full_claims(spark, sf), Q.preset("subject", "rare_safe"))
    return d.select("id", *[c for c in d.columns if c.startswith("subject_") and c != "subject_topics"])


def _grouped(value: str, raw: str, threshold: int = 5) -> str:
    n = f"count(*) OVER (PARTITION BY {value})"
    return f"{n} AS {raw}_frequency, CAST({n} < {threshold} AS INTEGER) AS {raw}_is_rare, CASE WHEN {n} < {threshold} THEN 'other' ELSE {value} END AS {raw}_grouped"


def _z(x: str) -> str:
    return f"round(CASE WHEN stddev_samp({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () ELSE {x} - avg({x}) OVER () END, 6)"


_ALL_MEANS = ["fe_speaker_avg_statement_len", "fe_subject_avg_statement_len", "fe_speaker_avg_punctuation", "fe_speaker_avg_number_ratio"]
_ALL_SCALED = ["statement_original_char_len", "statement_clean_rare_token_count", "statement_clean_avg_token_freq"]
_ALL_GROUPED = [f"{c}_{k}" for c in ("speaker", "speaker_job", "party_affiliation", "state_info") for k in ("frequency", "is_rare", "grouped")]


@query(
    "Q1_prepare_expanded",
    f"""WITH {FULL_CLAIMS}, c AS (SELECT id, {', '.join(f'{e} AS {c}' for c, e in _CLEAN_COLS.items())}, {s_repair('statement')} AS o FROM full_claims),
      k AS (SELECT id, unnest(regexp_extract_all(statement_clean, '\\S+')) AS w FROM c), f AS (SELECT w, count(*) AS freq FROM k GROUP BY w),
      r AS (SELECT id, count(*) FILTER (freq <= 1) AS rare, avg(freq) AS af FROM k JOIN f USING (w) GROUP BY id),
      t AS (SELECT c.*, coalesce(rare, 0) AS rare, coalesce(af, 0) AS af, coalesce(({s_topics('subject_clean')})[1], 'unknown') AS prim, {s_words('statement_clean')} AS wc,
        {s_count('statement_clean', "[.,!?;:" + chr(34) + "''" + "\\-()\\[\\]{}]")} / greatest(length(statement_clean), 1) AS pd, {s_count('statement_clean', '[0-9]')} / greatest(length(statement_clean), 1) AS dr
        FROM c LEFT JOIN r ON r.id = c.id)
    SELECT id, prim AS subject_primary, count(*) OVER (PARTITION BY prim) AS subject_frequency, CASE WHEN count(*) OVER (PARTITION BY prim) < 10 THEN 'other' ELSE prim END AS subject_primary_grouped,
      {_grouped('speaker_clean', 'speaker')}, {_grouped('speaker_job_clean', 'speaker_job')}, {_grouped('party_affiliation_clean', 'party_affiliation')}, {_grouped('state_info_clean', 'state_info')},
      {_z('length(o)')} AS statement_original_char_len, {_z('rare')} AS statement_clean_rare_token_count, {_z('af')} AS statement_clean_avg_token_freq,
      round(avg(wc) OVER (PARTITION BY speaker_clean), 6) AS fe_speaker_avg_statement_len, round(avg(wc) OVER (PARTITION BY subject_clean), 6) AS fe_subject_avg_statement_len,
      round(avg(pd) OVER (PARTITION BY speaker_clean), 6) AS fe_speaker_avg_punctuation, round(avg(dr) OVER (PARTITION BY speaker_clean), 6) AS fe_speaker_avg_number_ratio,
      state_info_clean || '__' || party_affiliation_clean AS fe_state_party FROM t""",
)
def q1_expanded(spark, sf):
    """Every expanded preset in one call, with rare tokens and scaling."""
    parts = {g: Q.preset(g, "expanded") for g in Q.PRESETS}
    statement = Q.StatementOptions(keep_original=True, add_lexical_features=True, add_rare_token_features=True, scale="standardize")
    d = Q.prepare_keyed(full_claims(spark, sf), Q.PrepareOptions(statement=statement, id_option="hash_bucket", **parts))
    return d.select("id", "subject_primary", "subject_frequency", "subject_primary_grouped", *_ALL_GROUPED, *r6(*_ALL_SCALED, *_ALL_MEANS), "fe_state_party")


@query(
    "Q5_preset_features_expanded",
    f"""WITH {FULL_CLAIMS}, c AS (SELECT id, {', '.join(f'{e} AS {c}' for c, e in _CLEAN_COLS.items())} FROM full_claims),
      w AS (SELECT *, {s_words('statement_clean')} AS wc, {s_count('statement_clean', "[.,!?;:" + chr(34) + "''" + "\\-()\\[\\]{}]")} / greatest(length(statement_clean), 1) AS pd, {s_count('statement_clean', '[0-9]')} / greatest(length(statement_clean), 1) AS dr FROM c)
    SELECT id, speaker_job_clean || '__' || subject_clean AS fe_speaker_job_subject, state_info_clean || '__' || party_affiliation_clean AS fe_state_party,
      speaker_clean || '__' || CASE WHEN wc < 50 THEN 'short' WHEN wc <= 150 THEN 'medium' ELSE 'long' END AS fe_speaker_len_bucket,
      round(avg(wc) OVER (PARTITION BY speaker_clean), 6) AS fe_speaker_avg_statement_len, round(avg(wc) OVER (PARTITION BY subject_clean), 6) AS fe_subject_avg_statement_len,
      round(avg(pd) OVER (PARTITION BY speaker_clean), 6) AS fe_speaker_avg_punctuation, round(avg(dr) OVER (PARTITION BY speaker_clean), 6) AS fe_speaker_avg_number_ratio, {s_count('statement_clean', '[0-9]+')} AS fe_numeral_count FROM w""",
)
def q5_features(spark, sf):
    o = Q.PrepareOptions.from_flat(statement_keep_original=True, id_option="hash_bucket")
    d = Q.add_cross_features(Q.prepare_keyed(full_claims(spark, sf), o), Q.preset("fe", "expanded"))
    means = ["fe_speaker_avg_statement_len", "fe_subject_avg_statement_len", "fe_speaker_avg_punctuation", "fe_speaker_avg_number_ratio"]
    return d.select("id", "fe_speaker_job_subject", "fe_state_party", "fe_speaker_len_bucket", *r6(*means), "fe_numeral_count")


_TRAIN = f"c AS (SELECT id, label, {', '.join(f'{e} AS {c}' for c, e in _CLEAN_COLS.items())}, {s_repair('statement')} AS o FROM full_claims), tr AS (SELECT * FROM c WHERE label IS NOT NULL), te AS (SELECT * FROM c WHERE label IS NULL)"


@query(
    "Q3_fitted_preparation",
    f"""WITH {FULL_CLAIMS}, {_TRAIN}, rows AS (SELECT count(*) AS rows FROM tr),
      f AS (SELECT speaker_clean, count(*) AS n, avg(label) AS rate, avg({s_words('statement_clean')}) AS len FROM tr GROUP BY ALL), al AS (SELECT avg({s_words('statement_clean')}) AS len FROM tr),
      tp AS (SELECT coalesce(({s_topics('subject_clean')})[1], 'unknown') AS prim, count(*) AS n FROM tr GROUP BY ALL),
      k AS (SELECT id, unnest(regexp_extract_all(statement_clean, '\\S+')) AS w FROM c), g AS (SELECT w, count(*) AS freq FROM k JOIN tr USING (id) GROUP BY w),
      r AS (SELECT id, count(*) FILTER (coalesce(freq, 0) <= 1) AS rare, avg(coalesce(freq, 0)) AS af FROM k LEFT JOIN g USING (w) GROUP BY id),
      v AS (SELECT tr.id, length(o) AS chars, coalesce(rare, 0) AS rare FROM tr LEFT JOIN r USING (id)), s AS (SELECT avg(chars) AS ca, stddev_samp(chars) AS cs, avg(rare) AS ra, stddev_samp(rare) AS rs FROM v),
      t AS (SELECT te.*, coalesce(({s_topics('subject_clean')})[1], 'unknown') AS prim, coalesce(rare, 0) AS rare FROM te LEFT JOIN r USING (id))
    SELECT t.id, prim AS subject_primary, coalesce(tp.n, 0) AS subject_frequency, CASE WHEN coalesce(tp.n, 0) < 10 THEN 'other' ELSE prim END AS subject_primary_grouped,
      coalesce(f.n, 0) AS speaker_frequency, round(coalesce(f.n, 0) / rows, 6) AS speaker_frequency_pct, CAST(coalesce(f.n, 0) < 5 AS INTEGER) AS speaker_is_rare, CASE WHEN coalesce(f.n, 0) < 5 THEN 'other' ELSE speaker_clean END AS speaker_grouped,
      round(coalesce(f.rate, 0.5), 6) AS fe_speaker_label_rate, round(coalesce(f.len, al.len), 6) AS fe_speaker_avg_statement_len,
      round((length(o) - ca) / cs, 6) AS statement_original_char_len, round((rare - ra) / rs, 6) AS statement_clean_rare_token_count
    FROM t CROSS JOIN rows CROSS JOIN s CROSS JOIN al LEFT JOIN f USING (speaker_clean) LEFT JOIN tp USING (prim)""",
)
def q3_fitted(spark, sf):
    """Fitted on labelled rows, saved, loaded, applied to the others."""
    d, path = full_claims(spark, sf), scratch_path(spark, "preparation")
    statement = Q.StatementOptions(keep_original=True, add_lexical_features=True, add_rare_token_features=True, scale="standardize")
    fe = Q.FeatureOptions(label_col="label", add_speaker_label_rate=True, add_speaker_avg_statement_len=True)
    subject = Q.SubjectOptions(add_primary=True, add_frequency=True, group_rare=True, add_grouped=True)
    speaker = Q.CategoryOptions(add_frequency=True, add_is_rare=True, add_grouped=True, group_rare=True)
    Q.fit_prepare(d.where("label is not null"), Q.PrepareOptions(statement=statement, fe=fe, subject=subject, speaker=speaker, label_option="drop")).save(path)
    out = Q.FittedPreparation.load(spark, path).transform(d.where("label is null").drop("label"), keep_key=True)
    numbers = ["speaker_frequency_pct", "fe_speaker_label_rate", "fe_speaker_avg_statement_len", "statement_original_char_len", "statement_clean_rare_token_count"]
    return out.select("id", "subject_primary", "subject_frequency", "subject_primary_grouped", "speaker_frequency", "speaker_is_rare", "speaker_grouped", *r6(*numbers))


def _vector_sql(pairs: bool, value: str, tail: str = "") -> str:
    """Terms of test rows over the vocabulary of training rows: in two of them at least, in nine of ten at most."""
    two = " UNION ALL SELECT id, seen, toks[i] || ' ' || toks[i + 1] FROM (SELECT *, unnest(range(1, len(toks))) AS i FROM w)" if pairs else ""
    return f"""WITH {FULL_CLAIMS}, {_TRAIN}, w AS (SELECT id, label IS NOT NULL AS seen, {s_terms('statement_clean')} AS toks FROM c), t AS (SELECT id, seen, unnest(toks) AS term FROM w{two}),
      tf AS (SELECT id, seen, term, count(*) AS tf FROM t GROUP BY ALL), n AS (SELECT count(*) AS n FROM tr),
      v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM tf, n WHERE seen GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.9::DOUBLE * n),
      raw AS (SELECT id, term, {value} AS w FROM tf JOIN v USING (term) WHERE NOT seen){tail}"""


_UNIT = ", l AS (SELECT id, sqrt(sum(w * w)) AS l FROM raw GROUP BY id) SELECT id, term, round(w / l, 6) AS value FROM raw JOIN l USING (id)"


def _vector_query(kind: str, sql: str):
    def run(spark, sf):
        d = full_claims(spark, sf)
        statement = Q.StatementOptions(vectorizer_type=kind, vectorizer_min_df=2, vectorizer_max_df=0.9)
        fitted = Q.fit_prepare(d.where("label is not null"), Q.PrepareOptions(statement=statement))
        return fitted.vectors(d.where("label is null")).withColumn("value", F.round("value", 6))

    query(f"Q1_vectors_{kind}", sql)(run)


_vector_query("tfidf", _vector_sql(False, "tf * idf", _UNIT))
_vector_query("bigram", _vector_sql(True, "CAST(tf AS DOUBLE)") + " SELECT id, term, w AS value FROM raw")
_vector_query("binary", _vector_sql(False, "CAST(1 AS DOUBLE)") + " SELECT id, term, w AS value FROM raw")


def _trained_bundle(spark, sf):
    options = Q.PrepareOptions.from_flat(
        speaker_add_frequency=True, speaker_add_grouped_speaker=True, speaker_group_rare=True, statement_add_lexical_features=True, statement_scale="standardize",
        fe_add_speaker_avg_statement_len=True, label_option="skip", id_option="hash_bucket",
    )
    labelled = full_claims(spark, sf).where("label is not null")
    prepared = Q.fit_prepare(labelled, options)
    # Rate tables, codes and the fit all read the prepared rows.
    train = O.cache_for_fit(prepared.transform(labelled, keep_key=True))
    maps = G.fit_rate_maps(train, {"fe_speaker_rate": ["speaker_grouped", "speaker_clean"], "fe_party_rate": ["party_affiliation_grouped", "party_affiliation_clean"]}, "label")
    train = G.apply_rate_maps(train, maps)
    encoders = {"speaker_grouped": E.ordinal_table(train, "speaker_grouped")}
    train = E.ordinal_apply(train, encoders)
    names = ["statement_original_char_len", "statement_original_word_count", "statement_upper_ratio", "speaker_frequency", "fe_speaker_avg_statement_len", "fe_speaker_rate", "fe_party_rate", "speaker_grouped_code"]
    ready = E.align_schema(train, names, keep=["label"])
    stages = [VectorAssembler(inputCols=names, outputCol="features"), LogisticRegression(labelCol="label", regParam=0.01)]
    model = Pipeline(stages=stages).fit(ready)
    return BN.Bundle(model, names, options.to_dict(), 0.5, maps, 0.5, encoders, prepared)


@query(
    "A6_bundle_roundtrip",
    f"""WITH {FULL_CLAIMS}, {_TRAIN}, n AS (SELECT *, count(*) OVER (PARTITION BY speaker_clean) AS n FROM tr)
    SELECT 'lr' AS name, CASE WHEN n < 5 THEN 'other' ELSE speaker_clean END AS key, round(avg(label), 6) AS rate FROM n GROUP BY ALL""",
)
def a6(spark, sf):
    root = scratch_path(spark, "bundles")
    BN.save_bundle(spark, _trained_bundle(spark, sf), root, "lr")
    loaded = BN.load_bundle(spark, root, "lr")
    parts = loaded.rate_maps["fe_speaker_rate"][1].select(F.lit("lr").alias("name"), F.col("speaker_grouped").alias("key"), F.round("rate", 6).alias("rate"))
    return parts.join(BN.list_bundles(spark, root).select("name"), "name")


@query(
    "Q3_score_batch",
    f"WITH {CLAIMS} SELECT id, true AS is_share, true AS label_follows_score, CASE WHEN id % 7 = 0 THEN true END AS same_in_a_part FROM claims WHERE label IS NULL",
)
def q3(spark, sf):
    """Scores of all unlabelled rows, held against those of a seventh of them scored on their own."""
    root = scratch_path(spark, "bundles")
    BN.save_bundle(spark, _trained_bundle(spark, sf), root, "lr")
    bundle, rows = BN.load_bundle(spark, root, "lr"), full_claims(spark, sf).where("label is null").drop("label")
    part = Q.score_batch(bundle, rows.where("id % 7 = 0")).select("id", F.col("score").alias("alone"))
    scores = Q.score_batch(bundle, rows).join(part, "id", "left")
    follows = F.col("label") == (F.col("score") >= bundle.threshold).cast("int")
    return scores.select("id", F.col("score").between(0, 1).alias("is_share"), follows.alias("label_follows_score"), (F.abs(F.col("score") - F.col("alone")) < 1e-9).alias("same_in_a_part"))
