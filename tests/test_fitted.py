"""A preparation fitted once and applied elsewhere."""

import pytest
from pyspark.sql import functions as F

from claimforge.operators import prepare as Q
from claimforge.sources import tables as A

PEOPLE = ["ann lee", "bob ray", "cy twombly"]


def claim(i, statement, speaker, label=None):
    return (str(i), label, statement, "tax,jobs" if i % 3 else "health", speaker, "Mayor", "Ohio", "democrat")


@pytest.fixture(scope="module")
def train(spark):
    rows = [claim(i, f"the number {i % 4} went up in New York and was good", PEOPLE[i % 2], i % 2) for i in range(24)]
    return spark.createDataFrame(rows, A.CLAIM_SCHEMA)


@pytest.fixture(scope="module")
def others(spark):
    texts = ["went down badly", "New York is good and never bad", "", None, "number 3 went up", "unheard words only"]
    return spark.createDataFrame([claim(100 + i, texts[i % 6], PEOPLE[i % 3]) for i in range(30)], A.CLAIM_SCHEMA)


@pytest.fixture(scope="module")
def resources(spark):
    return {
        "dictionary": spark.createDataFrame([("went", "go"), ("words", "word")], "form string, base string"),
        "entities": spark.createDataFrame([("New York", "GPE")], "phrase string, type string"),
        "sentiment": spark.createDataFrame([("good", 0.7, 0.6), ("bad", -0.7, 0.6)], "word string, polarity double, subjectivity double"),
    }


def options(**more):
    groups = ["speaker", "subject"]
    statement = Q.StatementOptions(
        add_lexical_features=True, add_rare_token_features=True, use_dictionary=True, add_ner_features=True, vectorizer_type="tfidf", scale="standardize", **more
    )
    fe = Q.FeatureOptions(label_col="label", add_speaker_label_rate=True, add_subject_avg_statement_len=True, add_sentiment=True, scale="normalize")
    return Q.PrepareOptions(statement=statement, fe=fe, label_option="drop", **{g: Q.preset(g, "rare_safe") for g in groups})


@pytest.fixture(scope="module")
def fitted(train, resources):
    return Q.fit_prepare(train, options(), resources)


def as_rows(df):
    return {r["id"]: tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()}


def test_a_row_is_the_same_alone_and_in_any_batch(spark, fitted, others, tmp_path):
    fitted.save(str(tmp_path / "p"))
    loaded = Q.FittedPreparation.load(spark, str(tmp_path / "p"))
    assert loaded.options == fitted.options and sorted(loaded.tables) == sorted(fitted.tables)
    whole = as_rows(loaded.transform(others.drop("label"), keep_key=True))
    assert len(whole) == 30
    part = as_rows(loaded.transform(others.where("id % 7 = 0").drop("label"), keep_key=True))
    alone = as_rows(loaded.transform(others.where("id = '108'").drop("label"), keep_key=True))
    assert part == {k: whole[k] for k in part} and alone == {"108": whole["108"]}


def test_training_rows_come_out_as_prepare_gives_them(train, fitted, resources):
    assert as_rows(fitted.transform(train, keep_key=True)) == as_rows(Q.prepare_keyed(train, options(), resources))


def test_unseen_values_and_looked_up_words(fitted, others):
    rows = {r["id"]: r for r in fitted.transform(others.drop("label"), keep_key=True).collect()}
    unseen, seen = rows["102"], rows["100"]
    assert (unseen["speaker_frequency"], unseen["speaker_grouped"], unseen["speaker_is_rare"]) == (0, "other", 1)
    assert (seen["speaker_frequency"], seen["speaker_grouped"]) == (12, "ann lee")
    assert seen["statement_clean"] == "go down badly" and rows["105"]["statement_clean"] == "unheard word only"
    assert rows["101"]["statement_original_GPE"] > rows["100"]["statement_original_GPE"]
    assert rows["101"]["fe_sentiment_polarity"] == pytest.approx(0.0 - 0.7)  # all training rows had 0.7


def test_vectors_know_fitted_terms_only(fitted, others):
    rows = fitted.vectors(others).collect()
    terms = {r["term"] for r in fitted.tables["vocabulary"].collect()}
    assert {r["term"] for r in rows} <= terms and "go" in terms and "unheard" not in terms
    length = {}
    for r in rows:
        length[r["id"]] = length.get(r["id"], 0) + r["value"] ** 2
    assert "103" not in length and all(v == pytest.approx(1) for v in length.values())


def test_refusals(train, others, resources):
    with pytest.raises(ValueError, match="dictionary"):
        Q.prepare(train, options())
    with pytest.raises(ValueError, match="vectorizer_type"):
        Q.prepare(train, Q.PrepareOptions.from_flat(statement_vectorizer_type="odd"))
    plain = Q.fit_prepare(train)
    with pytest.raises(ValueError, match="vectoriser"):
        plain.vectors(others)
    assert plain.tables == {} and plain.transform(others).count() == 30
    lacking = Q.FittedPreparation(Q.PrepareOptions.from_flat(speaker_add_frequency=True), {})
    with pytest.raises(KeyError, match="speaker_frequency"):
        lacking.transform(others)


def test_empty_training_rows(train, others):
    o = Q.PrepareOptions.from_flat(speaker_add_frequency=True, speaker_scale="standardize", statement_vectorizer_type="binary")
    empty = Q.fit_prepare(train.limit(0), o)
    assert {r["speaker_frequency"] for r in empty.transform(others).collect()} <= {0, None}
    assert empty.vectors(others).count() == 0
