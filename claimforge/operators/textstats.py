"""Per-row numeric features of text and category columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..functions.scores import softmax
from ..plans.lookups import lookup_join, settle, split_join
from .cleaning import require


def lexical_features(df: DataFrame, original: str, clean: str, source: str = "statement") -> DataFrame:
    require(df, original, clean)
    o, c = X.text(original), X.text(clean)
    return df.withColumns(
        {
            f"{original}_char_len": F.length(o),
            f"{original}_word_count": X.word_count(o),
            f"{source}_upper_ratio": X.per_char(X.chars_in(o, r"\p{Lu}"), o),
            f"{source}_exclamation_count": X.literal_count(o, "!"),
            f"{source}_question_count": X.literal_count(o, "?"),
            f"{clean}_digit_ratio": X.per_char(X.chars_in(c, r"\p{Nd}"), c),
        }
    )


def manual_text_features(df: DataFrame, col: str) -> DataFrame:
    require(df, col)
    x = X.text(col)
    n_words = X.word_count(x)
    letters = F.length(X.sub(x, f"{W.SPACE}+", ""))
    return df.withColumns(
        {
            "length": F.length(x),
            "word_count": n_words,
            "avg_word_length": F.coalesce(F.try_divide(letters.cast("double"), n_words.cast("double")), F.lit(0.0)),
            "exclamation": X.literal_count(x, "!"),
            "question": X.literal_count(x, "?"),
            "uppercase_ratio": X.per_char(X.chars_in(x, r"\p{Lu}"), x),
            "digit_count": X.chars_in(x, r"\p{Nd}"),
            "comma_count": X.literal_count(x, ","),
        }
    )


LEXICONS = {"negation": W.NEGATION_WORDS, "hedge": W.HEDGE_WORDS, "absolutist": W.ABSOLUTIST_WORDS}


def lexicon_counts(df: DataFrame, col: str, lexicons: dict[str, Sequence[str]] | None = None, prefix: str = "fe_") -> DataFrame:
    require(df, col)
    return df.withColumns(
        {f"{prefix}{name}_count": X.lexicon_hits(col, lex) for name, lex in (lexicons or LEXICONS).items()}
    )


def numeral_count(df: DataFrame, col: str, out: str = "fe_numeral_count") -> DataFrame:
    return df.withColumn(out, X.count_of(X.text(col), r"\p{Nd}+"))


def proper_noun_count(df: DataFrame, col: str, out: str = "fe_proper_noun_count") -> DataFrame:
    return df.withColumn(out, X.proper_nouns(col))


def flesch_reading_ease(df: DataFrame, col: str, out: str = "fe_readability") -> DataFrame:
    return df.withColumn(out, X.reading_ease(col))


def length_bucket(df: DataFrame, col: str, bins: tuple[int, int] = (50, 150), out: str = "length_bucket") -> DataFrame:
    return df.withColumn(out, X.length_bucket(X.word_count(X.text(col)), bins))


FLAG_MARKS = {"slash": "/", "ampersand": "&", "comma": ",", "period": "."}


def shape_features(df: DataFrame, raw: str, clean: str, flags: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """Length and token count of the clean value, punctuation flags of the raw one."""
    require(df, raw, clean)
    p, c, r = prefix or raw, X.text(clean), X.text(raw)
    out: dict[str, Column] = {f"{p}_char_len": F.length(c), f"{p}_token_count": X.word_count(c)}
    for name in flags:
        if name == "parentheses":
            out[f"{p}_has_parentheses"] = X.flag(r.rlike("[()]"))
        elif name in FLAG_MARKS:
            out[f"{p}_has_{name}"] = X.flag(r.contains(FLAG_MARKS[name]))
        else:
            raise ValueError(f"unknown flag {name!r}")
    return df.withColumns(out)


def title_flag(df: DataFrame, raw: str, titles: Sequence[str] = W.SPEAKER_TITLES, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{raw}_has_title", X.flag(X.text(raw).rlike("(?i)" + X.whole_words(titles))))


def membership_flag(df: DataFrame, col: str, members: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, X.flag(F.col(col).isin(list(members))))


def us_words_flag(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or f"{col}_has_us_words", X.flag(F.col(col).rlike(X.whole_words(W.US_WORDS))))


def punct_density(c: Column | str) -> Column:
    x = X.text(c)
    return X.per_char(X.chars_in(x, X.class_of(W.DENSITY_PUNCTUATION)), x)


def digit_ratio(c: Column | str) -> Column:
    x = X.text(c)
    return X.per_char(X.chars_in(x, r"\p{Nd}"), x)


def density_features(df: DataFrame, col: str) -> DataFrame:
    return df.withColumns({"punct_density": punct_density(col), "digit_ratio": digit_ratio(col)})


def basic_text_stats(df: DataFrame, col: str) -> DataFrame:
    x = X.text(col)
    integer = rf"(?<![{W.WORD_CHARS}])\p{{Nd}}+(?![{W.WORD_CHARS}])"
    return df.withColumns(
        {
            "word_count": X.word_count(x),
            "punct_count": X.chars_in(x, X.class_of(W.ASCII_PUNCTUATION)),
            "neg_count": X.count_of(F.lower(x), X.whole_words(W.NEGATION_FORMS)),
            "num_count": X.count_of(x, integer),
        }
    )


def row_key(key: str, tokens: Column) -> Column:
    """Tells rows apart by key and tokens, a null key included; rows equal in both have equal features."""
    return F.concat_ws("\x1f", F.coalesce(F.col(key).cast("string"), F.lit("\x00")), F.xxhash64(tokens).cast("string"))


def _flat_tokens(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(_rk, m, token, n): tokens of each distinct row, how often in it, and how many rows are equal to it.

    A row's tokens are counted before anything is shuffled by token.
    """
    rows = df.select(row_key(key, tokens).alias("_rk"), tokens.alias("_t")).groupBy("_rk").agg(F.first("_t").alias("_t"), F.count(F.lit(1)).alias("m"))
    return rows.select("_rk", "m", F.explode("_t").alias("token")).groupBy("_rk", "m", "token").agg(F.count(F.lit(1)).alias("n"))


def _back(df: DataFrame, key: str, tokens: Column, features: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return lookup_join(df.withColumn("_rk", row_key(key, tokens)), features, "_rk", defaults=defaults).drop("_rk")


def lexicon_sentiment(df: DataFrame, key: str, col: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity and subjectivity over tokens found in ``lexicon(word, polarity, subjectivity)``."""
    require(lexicon, "word", "polarity", "subjectivity")
    tokens = F.regexp_extract_all(F.lower(X.text(col)), F.lit("[a-z']+"), F.lit(0))
    hits = _flat_tokens(df, key, tokens).join(lexicon.withColumnRenamed("word", "token"), "token")
    n = F.sum("n")
    means = hits.groupBy("_rk").agg(
        (F.sum(F.col("polarity") * F.col("n")) / n).alias("fe_sentiment_polarity"),
        (F.sum(F.col("subjectivity") * F.col("n")) / n).alias("fe_sentiment_subjectivity"),
    )
    return _back(df, key, tokens, means, {"fe_sentiment_polarity": 0.0, "fe_sentiment_subjectivity": 0.0})


ENTITY_TYPES = ["PERSON", "ORG", "GPE", "DATE", "NUM", "OTHER"]
NUMERIC_ENTITY_LABELS = ["CARDINAL", "MONEY", "PERCENT", "QUANTITY", "NUM"]


def gazetteer_entity_counts(df: DataFrame, key: str, col: str, gazetteer: DataFrame, prefix: str = "entity_") -> DataFrame:
    """Entity counts per type from ``gazetteer(phrase, type)``.

    A phrase is filed under the word of it that fewest texts hold. A text's words fetch the phrases filed under
    them, and only fetched phrases are looked for in the text; rows equal in key and text are searched once.
    """
    require(gazetteer, "phrase", "type")
    words = X.words(X.text(col))
    kind = F.when(F.col("type").isin(NUMERIC_ENTITY_LABELS), "NUM").when(F.col("type").isin(ENTITY_TYPES), F.col("type")).otherwise("OTHER")
    # Phrases are sought as their words joined by one blank; the number tells phrases listed twice apart.
    listed = gazetteer.select(F.col("phrase").alias("_p"), X.words(F.col("phrase")).alias("_w"), kind.alias("kind"))
    listed = listed.where((F.size("_w") > 0) & (F.array_join("_w", " ") == F.col("_p"))).groupBy("_p", "_w", "kind").agg(F.count(F.lit(1)).alias("_times"))
    texts = df.select(row_key(key, words).alias("_rk"), words.alias("_t")).groupBy("_rk").agg(F.first("_t").alias("_t"))
    needed = listed.select(F.explode("_w").alias("word")).distinct()
    held = texts.select(F.explode(F.array_distinct("_t")).alias("word")).join(needed, "word", "left_semi")
    each = listed.select("*", F.explode(F.array_distinct("_w")).alias("word")).join(held.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "word", "left")
    rarest = F.min_by("word", F.struct(F.coalesce("texts", F.lit(0)), F.col("word")))
    index = each.groupBy("_p", "_w", "kind", "_times").agg(rarest.alias("word"))
    index = index.select("word", "_w", "kind", "_times", (F.array_position("_w", F.col("word")) - 1).alias("_at"))
    # Words of the texts stream past the index; only those with a phrase filed under them go on.
    met = texts.select("_rk", F.posexplode("_t").alias("_pos", "word")).join(settle(index, ["word"]), "word")
    one = met.where(F.size("_w") == 1).select("_rk", "kind", F.col("_times").alias("n"))
    start = (F.col("_pos") - F.col("_at") + 1).cast("int")
    more = met.where((F.size("_w") > 1) & (F.col("_pos") >= F.col("_at"))).groupBy("_rk").agg(F.collect_list(F.struct(start.alias("start"), "_w", "kind", "_times")).alias("_c"))
    there = F.filter("_c", lambda c: F.slice("_t", c["start"], F.size(c["_w"])) == c["_w"])
    several = more.join(texts, "_rk").select("_rk", F.explode(there).alias("c")).select("_rk", F.col("c.kind").alias("kind"), F.col("c._times").alias("n"))
    hits = one.unionByName(several)
    counts = hits.groupBy("_rk").agg(
        F.sum("n").alias(f"{prefix}total_entities"),
        *[F.sum(F.when(F.col("kind") == t, F.col("n")).otherwise(0)).alias(f"{prefix}{t}") for t in ENTITY_TYPES],
    )
    names = [f"{prefix}{t}" for t in ["total_entities", *ENTITY_TYPES]]
    return _back(df, key, words, counts, {n: 0 for n in names})


def oov_count(df: DataFrame, key: str, tokens: str, vocabulary: DataFrame | None = None, out: str = "spelling_err_count") -> DataFrame:
    """Tokens missing from ``vocabulary(word)``; with none, tokens that hold no letter."""
    if vocabulary is None:
        return df.withColumn(out, F.size(F.filter(F.col(tokens), lambda t: ~t.rlike(r"\p{L}"))).cast("bigint"))
    require(vocabulary, "word")
    lower = F.transform(F.col(tokens), lambda t: F.lower(t))
    known = vocabulary.select(F.col("word").alias("token")).distinct()
    unknown = _flat_tokens(df, key, lower).join(known, "token", "left_anti").groupBy("_rk").agg(F.sum("n").alias(out))
    return _back(df, key, lower, unknown, {out: 0})


def rare_token_features(
    df: DataFrame, key: str, tokens: str, frequencies: DataFrame | None = None, threshold: int = 1, fit_on: DataFrame | None = None
) -> DataFrame:
    """Tokens at or under the frequency threshold, and mean corpus frequency per row.

    ``fit_on`` holds the same keys and tokens in a frame that is cheaper to read.
    """
    seen = df if fit_on is None else fit_on
    flat = _flat_tokens(seen, key, F.col(tokens))
    freq = frequencies if frequencies is not None else seen.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    # The commonest tokens meet their counts where the rows are; only the others are shuffled by token.
    flat = split_join(flat.select("_rk", "token", "n"), freq.select("token", "freq"), "token", "freq", how="left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    per_row = flat.groupBy("_rk").agg(
        F.sum(F.when(F.col("freq") <= threshold, F.col("n")).otherwise(0)).alias("rare_token_count"),
        (F.sum(F.col("freq") * F.col("n")) / F.sum("n")).alias("avg_token_freq"),
    )
    return _back(df, key, F.col(tokens), per_row, {"rare_token_count": 0, "avg_token_freq": 0.0})


def softmax_score(df: DataFrame, logits: str, cls: int = 1) -> DataFrame:
    """Probability of one class and the winning class of a logits array."""
    x = F.col(logits)
    return df.withColumn("proba", softmax(x)[cls]).withColumn("pred", (F.array_position(x, F.array_max(x)) - 1).cast("int"))
