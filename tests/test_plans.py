"""Plan helpers against brute force, including a key that holds a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.operators import category as CAT
from claimforge.operators import encode as E
from claimforge.operators import splits as K
from claimforge.operators import target as G
from claimforge.plans import lookups
from claimforge.plans.lookups import lookup_join
from claimforge.plans.ordered import exact_quantiles, hash_rank, ordered_buckets, running_sums, sorted_index


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, key 'hot' on a third of them, some null keys."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{rng.randrange(200)}"
        rows.append((i, key, rng.random() ** 3, int(rng.random() < 0.4), i % 5))
    return spark.createDataFrame(rows, "id bigint, key string, score double, label int, fold int").cache()


def test_hash_rank_is_a_ranking(skewed):
    import hashlib

    ranked = hash_rank(skewed, ["label"], "id", 7).collect()
    for y in (0, 1):
        part = sorted((r for r in ranked if r["label"] == y), key=lambda r: r["_rank"])
        assert [r["_rank"] for r in part] == list(range(1, len(part) + 1))
        hashes = [hashlib.md5(f"{r['id']}7".encode()).hexdigest() for r in part]
        assert hashes == sorted(hashes)


def test_running_sums(skewed):
    counts = skewed.groupBy("label", "score").agg(F.count(F.lit(1)).alias("n"))
    got = running_sums(counts, ["label"], "score", {"upto": "n"}).collect()
    for y in (0, 1):
        part = sorted((r for r in got if r["label"] == y), key=lambda r: r["score"])
        assert [r["upto"] for r in part] == list(np.cumsum([r["n"] for r in part]))


def test_running_sums_of_a_heavy_tail(spark):
    values = sorted({round(1.0001**i, 9) for i in range(3000)} | {1e15, -1e9})
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n bigint").repartition(7)
    got = {r["v"]: r["s"] for r in running_sums(df, [], "v", {"s": "n"}).collect()}
    assert [got[v] for v in values] == list(range(1, len(values) + 1))
    down = {r["v"]: r["s"] for r in running_sums(df, [], "v", {"s": "n"}, ascending=False).collect()}
    assert [down[v] for v in values] == list(range(len(values), 0, -1))


def test_buckets_of_a_heavy_tail_are_even_and_the_source_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    # Pareto values, two groups of which one holds a tenth of the rows.
    tail = F.pow(F.lit(1) - (F.col("id") + 0.5) / 400_000, -1.2)
    df = spark.range(400_000).select((F.col("id") % 10 == 0).cast("int").alias("g"), tail.alias("v"), F.lit(1).alias("n"))
    df = df.mapInArrow(seen, df.schema)
    rows = ordered_buckets(df, ["g"], "v").groupBy("_b", "g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    mean = 400_000 / len({r["_b"] for r in rows})
    for g, total in ((0, 360_000), (1, 40_000)):
        part = sorted((r for r in rows if r["g"] == g), key=lambda r: r["_b"])
        assert sum(r["n"] for r in part) == total and max(r["n"] for r in part) < 2 * mean
        assert all(a["hi"] < b["lo"] for a, b in zip(part, part[1:]))
    assert mean == 50_000 and read.value == 400_000


def test_running_sums_of_one_value(spark):
    one = spark.createDataFrame([(0.5, 4)], "v double, n bigint")
    assert running_sums(one, [], "v", {"s": "n"}).first()["s"] == 4


def test_sorted_index(skewed):
    values = CAT.value_counts(skewed, "key")
    got = sorted_index(values, [F.col("n").desc(), F.col("key")], {"run": "n"}).orderBy("_index").collect()
    assert [r["_index"] for r in got] == list(range(len(got)))
    assert [(-r["n"], r["key"]) for r in got] == sorted((-r["n"], r["key"]) for r in got)
    assert [r["run"] for r in got] == list(np.cumsum([r["n"] for r in got]))


def test_exact_quantiles(skewed):
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r["column"], r["q"]): r["value"] for r in exact_quantiles(skewed, ["score", "id"], qs).collect()}
    for c in ("score", "id"):
        data = [r[c] for r in skewed.select(c).collect()]
        assert [got[c, q] for q in qs] == pytest.approx(list(np.quantile(data, qs)))


def test_lookup_join_keeps_every_row(skewed, spark):
    table = spark.createDataFrame([("hot", 1)], "key string, v int")
    out = lookup_join(skewed, table, "key", defaults={"v": 0})
    assert out.count() == 3000 and out.agg(F.sum("v")).first()[0] == 1000


def test_frequency_and_grouping(skewed):
    out = CAT.group_rare(CAT.frequency_encode(skewed, "key"), "key", 9, freq="key_frequency")
    for r in out.groupBy("key").agg(F.max("key_frequency").alias("f"), F.count(F.lit(1)).alias("n"), F.max("key_grouped").alias("g")).collect():
        assert r["f"] == (0 if r["key"] is None else r["n"])
        assert r["g"] == ("other" if r["f"] < 9 else r["key"])


def test_folds_are_balanced_and_stable(skewed):
    a = K.stratified_folds(skewed.drop("fold"), "label", "id").select("id", "label", "fold")
    b = K.stratified_folds(skewed.drop("fold").repartition(13), "label", "id").select("id", "label", "fold")
    assert sorted(a.collect()) == sorted(b.collect())
    for y in (0, 1):
        sizes = [r[0] for r in a.where(F.col("label") == y).groupBy("fold").count().select("count").collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_three_way_split_nests(skewed):
    parts = {r[0]: r[1] for r in K.three_way_split(skewed, "label", "id", 0.2, 0.25).groupBy("part").count().collect()}
    assert sum(parts.values()) == 3000 and abs(parts["holdout"] - 600) <= 2 and abs(parts["validation"] - 600) <= 2


def test_oversampling_balances(skewed):
    out = K.oversample_minority(skewed, "label", "id", minority=1)
    counts = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    majority = skewed.where("label = 0").count()
    assert counts == {0: majority, 1: majority}
    assert out.where("label = 1").select("id").distinct().count() > 500


def direct_rate(rows, key, fold):
    ys = [r["label"] for r in rows if r["key"] == key and r["fold"] != fold]
    return sum(ys) / len(ys) if key is not None and ys else 0.5


def test_oof_rate_matches_direct(skewed):
    rows = skewed.collect()
    got = {r["id"]: r["rate"] for r in G.oof_rate(skewed, "key", "label", "fold", "rate").collect()}
    for r in rows[::7]:
        assert got[r["id"]] == pytest.approx(direct_rate(rows, r["key"], r["fold"]))


def test_own_label_never_leaks(skewed):
    flipped = skewed.withColumn("label", F.when(F.col("id") == 30, 1 - F.col("label")).otherwise(F.col("label")))
    for frame in (G.oof_rate,):
        a, b = (frame(d, "key", "label", "fold", "rate").where("id = 30").first()["rate"] for d in (skewed, flipped))
        assert a == b
    assert G.group_label_rate(skewed, "key", "label", "rate").where("id = 30").first()["rate"] != G.group_label_rate(flipped, "key", "label", "rate").where("id = 30").first()["rate"]


def test_key_of_a_single_fold_falls_back(spark):
    df = spark.createDataFrame([(1, "only", 1, 0), (2, "only", 1, 0), (3, "x", 0, 1)], "id int, key string, label int, fold int")
    got = {r["id"]: r["rate"] for r in G.oof_rate(df, "key", "label", "fold", "rate").collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5}
    train, val = G.fold_rate(df, "key", "label", "fold", 0, "rate")
    assert [r["rate"] for r in val.collect()] == [0.5, 0.5] and train.first()["rate"] == 0.0


def test_smoothed_encoding(skewed):
    rows = skewed.collect()
    m = sum(r["label"] for r in rows) / len(rows)
    tr, te = G.smoothed_oof_encode(skewed, skewed.select("id", "key"), "key", "label", "fold", 20, "te")
    got = {r["id"]: r["te"] for r in tr.collect()}
    for r in rows[::101]:
        ys = [x["label"] for x in rows if x["key"] == r["key"] and x["fold"] != r["fold"]] if r["key"] else []
        assert got[r["id"]] == pytest.approx((sum(ys) + 20 * m) / (len(ys) + 20))
    assert te.where("te is null").count() == 0


def test_rate_needs_label(skewed):
    with pytest.raises(ValueError):
        G.group_label_rate(skewed, "key", None, "rate")


def test_duplicates_keep_the_smallest_key(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "a", "")] + [(i, "hot", "x") for i in range(10, 500)], "id int, t string, u string")
    assert sorted(r["id"] for r in K.drop_duplicate_rows(df, ["t", "u"], "id").collect()) == [1, 2, 10]


def test_ordinal_codes(skewed, spark):
    test = spark.createDataFrame([("hot",), ("new",), (None,)], "key string")
    tr, te = E.ordinal_encode(skewed, test, ["key"])
    known = sorted({r["key"] for r in skewed.select("key").collect()} - {None})
    assert {r["key"]: r["key_code"] for r in tr.select("key", "key_code").distinct().collect()} == {**{k: i for i, k in enumerate(known)}, None: -1}
    assert {r["key"]: r["key_code"] for r in te.collect()} == {"hot": known.index("hot"), "new": -1, None: -1}
    absent = E.ordinal_apply(spark.range(2), {"key": E.ordinal_table(skewed, "key")})
    assert [r["key_code"] for r in absent.collect()] == [-1, -1]


def test_lookup_broadcast_is_left_to_statistics(skewed):
    plan = CAT.frequency_encode(skewed, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


@pytest.mark.parametrize("limit,hinted", [(10**9, True), (10, False)])
def test_settled_lookups_are_measured(skewed, spark, monkeypatch, limit, hinted):
    from claimforge.plans import lookups

    monkeypatch.setattr(lookups, "BROADCAST_BYTES", limit)
    want = sorted(map(tuple, CAT.frequency_encode(skewed, "key").select("id", "key_frequency").collect()))
    spark.conf.set(lookups.SETTLE_CONF, "true")
    try:
        out = CAT.frequency_encode(skewed, "key")
        assert ("strategy=broadcast" in out._jdf.queryExecution().optimizedPlan().toString()) == hinted
        assert sorted(map(tuple, out.select("id", "key_frequency").collect())) == want
    finally:
        spark.conf.unset(lookups.SETTLE_CONF)


def test_hot_keys_of_a_large_table_are_broadcast(spark, monkeypatch):
    from claimforge.operators import vectorize as V

    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookups, "HOT_ROWS", 3)
    text = F.concat(F.lit("the of "), F.concat_ws(" ", *[F.concat(F.lit("word"), (F.col("id") * k % 400).cast("string")) for k in (3, 7, 11)]))
    df = spark.range(2000).select("id", text.alias("t"))
    plain = {(r["id"], r["term"]): r["value"] for r in V.tfidf(df, "id", V.word_terms("t")).collect()}
    spark.conf.set(lookups.SETTLE_CONF, "true")
    try:
        split = V.tfidf(df, "id", V.word_terms("t"))
        got = {(r["id"], r["term"]): r["value"] for r in split.collect()}
        vocab = V.vocabulary(df, "id", V.word_terms("t"))
        shuffled = lookups.split_join(V.term_counts(df, "id", V.word_terms("t")), vocab.select("term", "df"), "term", "df")
        plan = shuffled._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(lookups.SETTLE_CONF)
    assert got == pytest.approx(plain) and len(got) == len(plain)
    assert plan.count("strategy=broadcast") >= 2 and shuffled.where("term = 'the'").count() == 2000
