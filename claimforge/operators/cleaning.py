"""Text and category cleaning on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..plans.ordered import sorted_index
from ..plans.lookups import fixed_table, lookup_join, settle


def require(df: DataFrame, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"missing column(s) {missing}; have {df.columns}")


def clean_statement(df: DataFrame, col: str, out: str | None = None, **options) -> DataFrame:
    require(df, col)
    return df.withColumn(out or f"{col}_clean", X.clean_statement(col, **options))


def repair_statement(df: DataFrame, col: str, out: str | None = None, lower: bool = False, repair: bool = True) -> DataFrame:
    require(df, col)
    return df.withColumn(out or f"{col}_original", X.repair_statement(col, lower, repair))


def pollution_profile(df: DataFrame, col: str, min_tabs: int = 1) -> DataFrame:
    """Spillover counts, ratios and a weighted score; ``min_tabs=3`` is the stricter flag."""
    require(df, col)
    x = X.text(col)
    out = df.select(
        "*",
        F.length(x).alias("statement_length"),
        F.greatest(X.word_count(x), F.lit(1)).alias("word_count"),
        X.literal_count(x, "\t").alias("tab_count"),
        X.chars_in(x, "[\n\r]").alias("newline_count"),
        X.count_of(x, r"https?://|www\.").alias("url_count"),
        X.chars_in(x, "[\"']").alias("quote_count"),
        X.chars_in(x, W.other_than("A-Za-z0-9")).alias("special_char_count"),
    )
    n_words = F.col("word_count")
    out = out.withColumn("special_char_ratio", F.col("special_char_count") / F.greatest("statement_length", F.lit(1)))
    out = out.withColumn("tab_to_word_ratio", F.col("tab_count") / n_words)
    out = out.withColumn("row_spillover_flag", (F.col("tab_count") >= min_tabs) | (F.col("newline_count") > 0))
    return out.withColumn(
        "pollution_score",
        F.col("tab_count") * 25
        + F.col("newline_count") * 25
        + F.col("url_count") * 4
        + F.col("quote_count") * 2
        + F.col("special_char_ratio") * 10
        + F.least(F.col("tab_to_word_ratio"), F.lit(10.0)) * 10
        + F.least(F.col("statement_length") / n_words, F.lit(30.0)),
    )


def tokenize(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    require(df, col)
    return df.withColumn(out, X.words(X.text(col)))


def strip_token_punct(df: DataFrame, tokens: str = "tokens", out: str | None = None) -> DataFrame:
    return df.withColumn(out or tokens, X.strip_token_punct(F.col(tokens)))


def remove_stopwords(
    df: DataFrame, tokens: str, stoplist: Sequence[str], keep_negations: bool = True, out: str | None = None
) -> DataFrame:
    return df.withColumn(out or tokens, X.drop_stopwords(F.col(tokens), stoplist, keep_negations))


def normalize_tokens_by_dictionary(df: DataFrame, key: str, tokens: str, dictionary: DataFrame) -> DataFrame:
    """Replace each token by its base form from ``dictionary(form, base)``, keeping order.

    Stemmers and lemmatisers enter as such a table. Only the forms of a row that are in it
    travel, to meet the row's own list again.
    """
    require(dictionary, "form", "base")
    # Rows are told apart by key and tokens, so that rows sharing a key, or without one, keep their own lists.
    marked = df.withColumn("_rk", F.concat_ws("\x1f", F.coalesce(F.col(key).cast("string"), F.lit("\x00")), F.xxhash64(tokens).cast("string")))
    known = settle(dictionary.groupBy("form").agg(F.min("base").alias("base")).where(F.col("base").isNotNull()), ["form"])
    met = marked.select("_rk", F.explode(F.array_distinct(tokens)).alias("form")).join(known, "form")
    bases = met.groupBy("_rk").agg(F.map_from_entries(F.collect_set(F.struct("form", "base"))).alias("_bases"))
    mapped = F.transform(tokens, lambda t: F.coalesce(F.element_at("_bases", t), t))
    new = F.when(F.col("_bases").isNull(), F.col(tokens)).otherwise(mapped)
    empty = F.array().cast("array<string>")
    return marked.join(bases, "_rk", "left").withColumn(tokens, F.coalesce(new, empty)).drop("_bases", "_rk")


def expand_contractions(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    require(df, col)
    return df.withColumn(out or col, X.expand_contractions(col))


def _fold_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    # Compatibility decomposition has no built-in expression; Arrow batches keep it cheap.
    for s in batches:
        yield s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def ascii_fold(c: Column) -> Column:
    """NFKD, then drop what is not ASCII. Pure ASCII values are not sent to Python."""
    to_ascii = F.pandas_udf(_fold_batches, "string")
    return F.coalesce(to_ascii(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalize_unicode_text(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    require(df, col)
    x = X.sub(X.text(col), "[\r\n\t]+", " ")
    x = X.expand_contractions(X.number_abbreviation(x))
    # A column of its own: the fold mentions it twice, and it is too costly to compute twice.
    folded = ascii_fold(F.col("_spelled"))
    return df.withColumn("_spelled", x).withColumn(out or f"{col}_normalized", F.lower(X.drop_domains(folded))).drop("_spelled")


def typed_number_tokens(df: DataFrame, col: str, out: str = "tokens", min_len: int = 2) -> DataFrame:
    require(df, col)
    return df.withColumn(out, X.alphabetic_tokens(X.typed_numbers(col), min_len))


def light_clean(df: DataFrame, col: str, variant: str, out: str | None = None) -> DataFrame:
    require(df, col)
    return df.withColumn(out or f"{col}_clean", X.light_clean(col, variant))


_CATEGORY_CLEANERS = {
    "subject": X.clean_subject,
    "speaker": X.clean_speaker,
    "job": X.clean_job,
    "party": X.clean_party,
    "state": X.clean_state,
}


def clean_category(df: DataFrame, col: str, kind: str, out: str | None = None, **options) -> DataFrame:
    """Clean one category column the way its ``kind`` prescribes."""
    require(df, col)
    if kind not in _CATEGORY_CLEANERS:
        raise ValueError(f"kind must be one of {sorted(_CATEGORY_CLEANERS)}")
    return df.withColumn(out or f"{col}_clean", _CATEGORY_CLEANERS[kind](col, **options))


def clean_state(df: DataFrame, col: str, out: str | None = None, drop: bool = False) -> DataFrame:
    require(df, col)
    return df.drop(col) if drop else clean_category(df, col, "state", out)


def normalize_by_lookup(
    df: DataFrame, col: str, lookup: DataFrame, code: str, name: str, out: str | None = None, fixed: bool = False
) -> DataFrame:
    """Codes become names; values without an entry stay."""
    require(df, col)
    table = lookup.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    joined = lookup_join(df, table, col, "_code", fixed=fixed)
    return joined.withColumn(out or col, F.coalesce("_name", F.col(col))).drop("_name")


def map_region(
    df: DataFrame, col: str, lookup: DataFrame, name: str, region: str, out: str, default: str = "unknown", fixed: bool = False
) -> DataFrame:
    require(df, col)
    table = lookup.select(F.col(name).alias("_n"), F.col(region).alias(out))
    return lookup_join(df, table, col, "_n", {out: default}, fixed)


def state_table(spark) -> DataFrame:
    return fixed_table(spark, W.US_STATES, "name string, code string, region string")


def canonicalize_alias(
    df: DataFrame, col: str, aliases: DataFrame | None = None, contains_rules: Sequence[tuple[str, str]] = (),
    out: str | None = None, empty: str = "unknown",
) -> DataFrame:
    """Exact alias first, then the first matching substring rule, else unchanged."""
    require(df, col)
    x = F.col(col)
    rest = F.when(F.lit(False), x)
    for needle, label in contains_rules:
        rest = rest.when(x.contains(needle), F.lit(label))
    rest = rest.when(x == "", F.lit(empty)).otherwise(x)
    table = aliases if aliases is not None else party_alias_table(df.sparkSession)
    table = table.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c"))
    return lookup_join(df, table, col, "_a", fixed=aliases is None).withColumn(out or col, F.coalesce("_c", rest)).drop("_c")


def party_alias_table(spark) -> DataFrame:
    return fixed_table(spark, W.PARTY_ALIASES, "alias string, canonical string")


def fill_category(df: DataFrame, cols: Sequence[str], missing_value: str = "missing", empty_too: bool = False) -> DataFrame:
    require(df, *cols)

    def filled(c: str) -> Column:
        x = F.lower(X.strip(F.coalesce(F.col(c).cast("string"), F.lit(missing_value))))
        return X.or_unknown(x, missing_value) if empty_too else x

    return df.withColumns({c: filled(c) for c in cols})


def missing_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    require(df, *cols)
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in cols})


def normalize_label(df: DataFrame, col: str, label_map: Sequence[tuple[str, int]] | None = None, out: str = "label") -> DataFrame:
    """Integer classes 0/1; rows without a valid label go, other class pairs map by rank."""
    require(df, col)
    if dict(df.dtypes)[col] == "string":
        table = fixed_table(df.sparkSession, list(label_map or W.LABEL_WORDS), "_w string, _y int")
        keyed = df.withColumn("_word", F.lower(X.strip(F.col(col))))
        valid = lookup_join(keyed, table, "_word", "_w", fixed=True).drop("_word")
    else:
        valid = df.withColumn("_y", F.col(col).try_cast("int"))
    valid = valid.where(F.col("_y").isNotNull())
    # Places among the sorted distinct classes: 0 and 1 stay, any other pair maps by rank, and a wide column is no list.
    ranks = sorted_index(valid.select("_y").distinct(), [F.col("_y").asc()]).select("_y", F.col("_index").cast("int").alias("_rank"))
    return lookup_join(valid, ranks, "_y").withColumn(out, F.col("_rank")).drop("_y", "_rank")


def label_option(df: DataFrame, option: str = "skip", col: str = "label") -> DataFrame:
    choice = str(option).strip().lower()
    if choice == "skip":
        return df
    if choice == "drop":
        require(df, col)
        return df.drop(col)
    raise ValueError("option must be 'drop' or 'skip'")


def id_bucket(df: DataFrame, col: str = "id", n: int = 100, out: str = "id_bucket", drop_source: bool = True) -> DataFrame:
    require(df, col)
    bucketed = df.withColumn(out, X.md5_mod(col, n))
    if drop_source:
        return bucketed.drop(col)
    value = X.strip(F.col(col).cast("string"))
    return bucketed.withColumn(col, F.when(value != "", value))


def id_option(df: DataFrame, option: str = "drop", col: str = "id", **bucket_options) -> DataFrame:
    choice = str(option).strip().lower()
    if choice == "drop":
        require(df, col)
        return df.drop(col)
    if choice == "hash_bucket":
        return id_bucket(df, col, **bucket_options)
    raise ValueError("option must be 'drop' or 'hash_bucket'")


def id_option_pair(train: DataFrame, test: DataFrame, option: str = "drop", **options) -> tuple[DataFrame, DataFrame]:
    return id_option(train, option, **options), id_option(test, option, **options)


def first_of_delimited(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    require(df, col)
    return df.withColumn(out or f"{col}_primary", X.primary_of_list(col))


def coerce_numeric(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    require(df, *cols)
    return df.withColumns({c: F.coalesce(F.col(c).try_cast(to), F.lit(0).cast(to)) for c in cols})


def separator_clean(df: DataFrame, col: str, separators: str, out: str | None = None) -> DataFrame:
    require(df, col)
    return df.withColumn(out or f"{col}_clean", X.separator_clean(col, separators))


def enriched_text(df: DataFrame, template: str, cols: dict[str, str], out: str = "text_enriched") -> DataFrame:
    """One string from context columns and the claim.

    ``cols`` maps the roles ``statement subject speaker job state party`` to columns.
    """
    require(df, *cols.values())

    def raw(role: str) -> Column:
        return F.col(cols[role]).cast("string")

    def filled(role: str, missing: str = "unknown", strip: bool = True) -> Column:
        x = F.lower(F.coalesce(raw(role), F.lit(missing)))
        return X.strip(x) if strip else x

    def join(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    if template == "piped":
        def clean(role: str) -> Column:
            return X.or_unknown(X.strip(F.lower(X.text(raw(role)))))

        topic = X.strip(F.split(clean("subject"), ",", 2).getItem(0))
        built = join("speaker: ", clean("speaker"), " | party: ", clean("party"), " | subject: ", topic, " | ", X.text(raw("statement")))
    elif template == "prefixed":
        roles = [("speaker", "Speaker"), ("party", "Party"), ("job", "Job"), ("state", "State"), ("subject", "Topic")]
        parts = [
            F.when(X.strip(raw(r)) != "", F.concat(F.lit(f"{p}: "), raw(r))) for r, p in roles if r in cols
        ]
        built = join(F.concat_ws(" | ", *parts), " [SEP] Claim: ", X.text(raw("statement")))
    elif template == "labelled":
        roles = [("statement", "statement"), ("subject", "subject"), ("speaker", "speaker"), ("job", "job"), ("state", "state"), ("party", "party")]
        built = F.concat_ws(" ", *[join(f"{p}: ", filled(r)) for r, p in roles if r in cols])
    elif template == "plain":
        built = F.concat_ws(" ", *[X.text(raw(r)) for r in ("statement", "subject", "speaker", "job", "state", "party") if r in cols])
    elif template == "said":
        said = X.sub(F.lower(X.text(raw("statement"))), W.other_than("a-z0-9-") + "+", "")
        head = [F.coalesce(raw(r), F.lit("unknown")) for r in ("speaker", "party", "subject")]
        built = join("speaker ", head[0], " party ", head[1], " subject ", head[2], " said ", said)
    elif template == "sentences":
        roles = [("subject", "Subject"), ("speaker", "Speaker"), ("job", "Job"), ("state", "State"), ("party", "Party")]
        built = F.concat_ws(". ", X.text(raw("statement")), *[join(f"{p}: ", X.text(raw(r))) for r, p in roles if r in cols])
    elif template == "separated":
        built = join(
            "speaker: ", filled("speaker", "none", False), " (", filled("party", "none", False), ") topic: ",
            filled("subject", "none", False), " </s> statement: ", filled("statement", "none", False),
        )
    elif template == "statement_last":
        built = join("Speaker: ", X.text(raw("speaker")), ". Party: ", X.text(raw("party")), ". Statement: ", X.text(raw("statement")))
    else:
        raise ValueError(f"unknown template {template!r}")
    return df.withColumn(out, built)
