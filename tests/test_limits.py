"""Cases the fixture tables do not show: long phrases, hot values, wide vocabularies, odd keys."""

from pyspark.sql import functions as F

from claimforge.operators import cleaning as C
from claimforge.operators import encode as E
from claimforge.operators import profile as M
from claimforge.operators import textstats as S
from claimforge.operators import topics as TOP

SAME_ID = [(1, "a a b"), (1, "c"), (None, "a"), (None, "b zz"), (2, "a a b"), (2, "a a b"), (3, ""), (4, None)]


def test_phrase_of_three_words(spark):
    gazetteer = spark.createDataFrame([("new york city", "GPE"), ("york", "ORG"), ("one two three four", "PERSON")], "phrase string, type string")
    df = spark.createDataFrame([(1, "in new york city now"), (2, "one two three four"), (3, None)], "id int, t string")
    rows = {r["id"]: r for r in S.gazetteer_entity_counts(df, "id", "t", gazetteer).collect()}
    assert (rows[1]["entity_GPE"], rows[1]["entity_ORG"], rows[2]["entity_PERSON"], rows[3]["entity_total_entities"]) == (1, 1, 1, 0)


def test_last_frequency_band_is_open(spark):
    df = spark.range(10_003).select(F.when(F.col("id") < 10_001, "hot").when(F.col("id") == 10_001, "x").otherwise("y").alias("v"))
    assert {r["band"]: r["rows"] for r in M.frequency_buckets(df, "v").collect()} == {"100+": 10_001, "1": 2}


def test_value_named_like_the_margin(spark):
    df = spark.createDataFrame([("All", "x"), ("All", "All"), ("b", "x"), ("b", "x")], "a string, b string")
    rows = M.crosstab(df, "a", "b").collect()
    assert len(rows) == 8 and max(r["row_pct"] for r in rows) == 100.0
    assert sorted(r["n"] for r in rows if r["a"] == "All" and r["b"] == "x") == [1, 3]


def test_more_than_two_thousand_columns(spark):
    df = spark.createDataFrame([(1, [f"t{i:04d}" for i in range(2001)])], "id int, t array<string>")
    assert len(TOP.topic_vocabulary(df, "t")) == 2001
    wide = df.select(F.explode("t").alias("v"))
    assert len(E.one_hot(wide, wide, ["v"])[0].columns) == 2002


def test_rows_of_one_key_keep_their_own_features(spark):
    df = spark.createDataFrame(SAME_ID, "id int, t string").withColumn("tokens", F.split(F.coalesce("t", F.lit("")), " ")).withColumn("tokens", F.filter("tokens", lambda w: w != ""))
    rows = S.rare_token_features(df, "id", "tokens", threshold=1).collect()
    got = sorted(((r["id"], r["t"], r["rare_token_count"]) for r in rows), key=str)
    assert got == sorted([(1, "a a b", 0), (1, "c", 1), (None, "a", 0), (None, "b zz", 1), (2, "a a b", 0), (2, "a a b", 0), (3, "", 0), (4, None, 0)], key=str)
    assert {r["avg_token_freq"] for r in rows if r["t"] == "a a b"} == {(7 * 2 + 4) / 3}
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    assert sorted(r["spelling_err_count"] for r in S.oov_count(df, "id", "tokens", words).collect()) == [0] * 6 + [1, 1]
    lexicon = spark.createDataFrame([("a", 1.0, 0.5)], "word string, polarity double, subjectivity double")
    sentiment = S.lexicon_sentiment(df, "id", "t", lexicon).collect()
    assert len(sentiment) == 8 and {r["fe_sentiment_polarity"] for r in sentiment if r["t"] == "a"} == {1.0}
    bases = spark.createDataFrame([("a", "A")], "form string, base string")
    mapped = sorted(" ".join(r["tokens"]) for r in C.normalize_tokens_by_dictionary(df, "id", "tokens", bases).collect())
    assert mapped == ["", "", "A", "A A b", "A A b", "A A b", "b zz", "c"]


def test_label_ranks(spark):
    df = spark.createDataFrame([(i,) for i in (5, 9, 5, None)], "y int")
    assert sorted(r["label"] for r in C.normalize_label(df, "y").collect()) == [0, 0, 1]


def test_rows_without_a_key_are_spread(spark):
    from claimforge.plans.ordered import hash_rank

    df = spark.range(2000).select(F.lit(None).cast("long").alias("id"), F.col("id").alias("v"), (F.col("id") % 2).alias("g"))
    ranked = hash_rank(df, ["g"], "id", 1)
    assert sorted(r["_rank"] for r in ranked.where("g = 0").collect()) == list(range(1, 1001))
    by_bucket = df.select(F.substring(F.md5(F.concat(F.lit("\x00"), F.xxhash64("v", "g").cast("string"), F.lit("1"))), 1, 4).alias("b")).groupBy("b").count()
    assert by_bucket.agg(F.max("count")).first()[0] < 10
