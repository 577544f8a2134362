"""Options, presets, errors, files and bundles."""

import warnings
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from claimforge.operators import cleaning as C
from claimforge.operators import encode as E
from claimforge.operators import interactions as I
from claimforge.operators import prepare as Q
from claimforge.operators import topics as TOP
from claimforge.sources import bundles as BN
from claimforge.sources import tables as A

ROWS = [
    ("1", 1, "Say \"no\"\nto taxes", "Health|taxes", "barack-obama", "President", "OH", "democrat"),
    ("2", 0, "All 50 states", None, "ann-lee", None, "Texas", "Activist"),
    ("3", None, None, "a;b,c,d", None, "CEO & founder", None, None),
]


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame(ROWS, A.CLAIM_SCHEMA)


def test_defaults_give_cleaned_columns(claims):
    out = Q.prepare(claims)
    assert set(out.columns) == {
        "label", "statement", "statement_clean", "subject_clean", "speaker_clean", "speaker_job_clean", "party_affiliation_clean", "state_info_clean",
    }
    rows = sorted(out.collect(), key=lambda r: r["statement"] or "")
    assert [r["state_info_clean"] for r in rows] == ["unknown", "texas", "ohio"]
    assert [r["subject_clean"] for r in rows] == ["a,b,c,d", "", "health,taxes"]


def test_flat_options_and_round_trip(claims):
    o = Q.PrepareOptions.from_flat(
        subject_add_primary=True, speaker_job_add_grouped_job=True, speaker_add_title_flag=True, state_add_us_region=True,
        party_affiliation_add_is_institutional=True, label_option="drop", id_option="hash_bucket",
    )
    assert Q.PrepareOptions.from_dict(o.to_dict()) == o
    out = Q.prepare(claims, o)
    assert {"subject_primary", "speaker_job_grouped", "speaker_has_title", "state_info_us_region", "id_bucket"} <= set(out.columns)
    assert "label" not in out.columns and "id" not in out.columns
    assert {r["state_info_us_region"] for r in out.collect()} == {"midwest", "south", "unknown"}
    with pytest.raises(ValueError):
        Q.PrepareOptions.from_flat(subject_nope=True)


@pytest.mark.parametrize("group", sorted(Q.PRESETS))
def test_presets_run(claims, group):
    base = Q.prepare_keyed(claims, Q.PrepareOptions.from_flat(statement_keep_original=True))
    for name in Q.PRESETS[group]:
        o = Q.preset(group, name)
        step = {"subject": Q.prepare_subject, "fe": Q.add_cross_features}.get(group, Q.prepare_category)
        out = step(base if group == "fe" else claims, o)
        assert out.count() == 3
    with pytest.raises(ValueError):
        Q.preset(group, "nope")


@pytest.mark.parametrize(
    "flat,error",
    [
        (dict(label_option="x"), ValueError), (dict(id_option="x"), ValueError), (dict(subject_group_rare=True), ValueError),
        (dict(speaker_group_rare=True), ValueError), (dict(subject_primary_strategy="x"), ValueError), (dict(state_scale="x"), ValueError),
        (dict(speaker_add_speaker_primary_true_rate=True), ValueError), (dict(fe_add_party_true_rate=True), ValueError),
        (dict(subject_source_col="absent"), KeyError), (dict(speaker_add_speaker_primary_true_rate=True, speaker_label_col="absent"), KeyError),
    ],
)
def test_bad_options(claims, flat, error):
    with pytest.raises(error):
        Q.prepare(claims, Q.PrepareOptions.from_flat(**flat))


def test_missing_optional_source_warns(claims):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert I.interaction_key(claims, "absent", "speaker", "x") is claims
    assert len(seen) == 1


def test_primary_topic_strategies(spark):
    df = spark.createDataFrame([(["tax", "jobs", "health"],), (["tax"],), ([],), (["aa", "bb"],)], "t array<string>")
    pick = lambda s, **k: [r["p"] for r in TOP.primary_topic(df, "t", s, out="p", **k).collect()]
    assert sorted(pick("first")) == sorted(["tax", "tax", "unknown", "aa"])
    assert sorted(pick("longest")) == sorted(["health", "tax", "unknown", "aa"])
    assert sorted(pick("most_frequent")) == sorted(["tax", "tax", "unknown", "aa"])
    assert sorted(pick("multi")) == sorted(["multi-topic", "multi-topic", "unknown", "multi-topic"])
    assert sorted(pick("first", max_topics=1)) == sorted(["multi-topic", "tax", "unknown", "multi-topic"])


def test_label_normalization(spark):
    words = spark.createDataFrame([("False",), ("true",), ("odd",), (None,)], "w string")
    assert sorted(r["label"] for r in C.normalize_label(words, "w").collect()) == [0, 1]
    nums = spark.createDataFrame([(2,), (5,), (None,)], "w int")
    assert sorted(r["label"] for r in C.normalize_label(nums, "w").collect()) == [0, 1]


def test_csv_round_trip(claims, spark, tmp_path):
    A.write_csv(claims, str(tmp_path / "c"))
    back = A.read_claims(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.where("id <> '3'").select("id", "statement").collect())) == [("1", "Say \"no\"\nto taxes"), ("2", "All 50 states")]
    with pytest.raises(ValueError):
        A.read_claims(spark, "x", "xml")


def test_vocabulary_too_wide(spark):
    df = spark.range(5).select(F.array(F.col("id").cast("string")).alias("t"))
    with pytest.raises(ValueError):
        TOP.topic_vocabulary(df, "t", 4)
    assert TOP.topic_vocabulary(df, "t", 5) == list("01234")


def test_column_roles_and_alignment(claims):
    roles = E.column_roles(claims.withColumn("g_grouped", F.lit("x")).withColumn("n", F.lit(1)))
    assert roles["categorical"] == ["id", "g_grouped"] and roles["numeric"] == ["n"]
    out = E.align_schema(claims, ["label", "absent"], keep=["id"])
    assert out.columns == ["id", "label", "absent"] and {r["absent"] for r in out.collect()} == {0.0}


def test_missing_bundle_parts(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="model.*settings"):
        BN.load_bundle(spark, str(tmp_path), "none")
    assert BN.list_bundles(spark, str(tmp_path)).count() == 0


def relations(df):
    shown = df._jdf.queryExecution().analyzed().toString()
    return shown.count("LogicalRDD")


def test_plan_grows_with_the_steps(claims):
    """Each category adds a few reads of the fitted base; nothing doubles."""
    groups = ["speaker", "speaker_job", "party_affiliation", "state"]
    sizes = []
    for n in range(1, len(groups) + 1):
        options = Q.PrepareOptions(**{g: Q.preset(g, "expanded") for g in groups[:n]}, fe=Q.preset("fe", "expanded"))
        sizes.append(relations(Q.prepare(claims, options)))
    steps = [b - a for a, b in zip(sizes, sizes[1:], strict=False)]
    assert max(steps) <= 6 and sizes[-1] <= 40


def test_deferred_scaling_equals_scaling_in_each_step(claims):
    options = Q.PrepareOptions(speaker=replace(Q.preset("speaker", "expanded"), scale="standardize"), party_affiliation=replace(Q.preset("party_affiliation", "expanded"), scale="normalize"))
    whole = {r["speaker_clean"]: r for r in Q.prepare(claims, options).collect()}
    alone = {r["speaker_clean"]: r for r in Q.prepare_category(claims, options.speaker).collect()}
    for k, r in alone.items():
        assert whole[k]["speaker_frequency_pct"] == pytest.approx(r["speaker_frequency_pct"]) and whole[k]["speaker_char_len"] == pytest.approx(r["speaker_char_len"])
