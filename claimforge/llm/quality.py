"""Quality rules: base counts of a text, and its divergence from what its language looks like.

Each text has a histogram of character classes and one of its language's commonest words (with "any other
word" as a bin). The references are the median shares over all texts of the language. The
Jensen-Shannon distance between a text and its reference decides, once the text is long enough for its
histogram to mean something; below the guards the distance is not used.

Languages without a list here get the commonest words of their own texts, once they have ``LANGUAGE_TEXTS``
long ones and more than one in ``LANGUAGE_SHARE`` of all long texts without a list.

Only built-in expressions run: arrays are bound once inside lambdas, a text's work stays in its row, and
the references are one partial aggregate with a row for each language list.

Defined cases: a null or empty text has no words and fails the base; a text whose language is null or has no
list is read as the one whose common words it holds most of, and its word distance is null and not used if these
are less than ``LIKELY_SHARE`` of its words; repeated rows and null keys are kept; an empty table
gives an empty result; other columns are kept as they are, and the operator's own columns replace any of
the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind
from ..session import cut
from .common import SPACE, written

#: The commonest words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "des", "im", "ein"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "was", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "que", "est", "dans"],
}
#: The classes of characters; the rest (mostly lower-case letters) is the last class.
UPPER = "A-ZÀ-ÖØ-Þ"
DIGITS = "0-9"
BLANKS = "\\x20\\x09-\\x0D"
POINTS = ".,;:!?'\"()\\-"
SYMBOLS = "#*$%&|<>"
LIST_WORDS = 12
LANGUAGE_TEXTS, LANGUAGE_SHARE, WORD_CHARS = 20, 10_000, 64
LIKELY_SHARE = 0.1
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Guards: characters and words a text must have before its distances count; a reference takes longer ones.
CLASS_GUARD = 200
WORD_GUARD = 50
REFERENCE_WORDS = 100
#: A text is far off by its classes alone, by its words alone (if long), or by less of both together.
CLASS_LIMIT = 0.25
WORD_LIMIT = 0.27
LONG_WORDS = 200
BOTH_LIMITS = (0.15, 0.22)


def _count_of(text: Column, characters: str) -> Column:
    """How many characters of a class: what is left without the runs of others."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the array (windows compared by 64-bit hash)."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        hashes = F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))

    def twice(s: Column) -> Column:
        """Positions of the windows whose neighbour in hash order is equal."""

        def same(i: Column, x: Column) -> Column:
            return F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(bind(bind(placed, twice), covered))

    return bind(bind(words, windows), count)


def fit_lists(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``_lang, _own``: the commonest words of each language that ``COMMON_WORDS`` lacks; under ``LANGUAGE_SHARE`` rows."""
    others = df.where(F.col(lang).isNotNull() & ~F.col(lang).isin(list(COMMON_WORDS)))
    texts = others.select(F.col(lang).alias("_lang"), words_of(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_w"))
    texts = texts.where(F.size("_w") >= REFERENCE_WORDS)
    sizes = texts.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).scalar()
    enough = sizes.where((F.col("_n") >= LANGUAGE_TEXTS) & (F.col("_n") * LANGUAGE_SHARE > total))
    words = texts.select("_lang", F.explode("_w").alias("_word")).where(F.length("_word") <= WORD_CHARS)
    counts = words.groupBy("_lang", "_word").agg(F.count(F.lit(1)).alias("_c"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("_c"), "_word"))
    best = counts.withColumn("_place", first).where(F.col("_place") <= LIST_WORDS)
    lists = best.groupBy("_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_word"))), lambda x: x["_word"]).alias("_own"))
    return cut(lists.where(F.size("_own") == LIST_WORDS).join(enough, "_lang", "left_semi"))


def _histograms(df: DataFrame, text: str, lang: str, own: DataFrame) -> DataFrame:
    """Add ``_t`` (text), ``_w`` (words), ``_list`` (language list), ``_fits`` (if the text is of it), ``_classes`` and
    ``_common`` (counts), and ``_own``, the list of ``own`` for the text's language."""
    lists = F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    # Fewer than LANGUAGE_SHARE lists of LIST_WORDS words of WORD_CHARS at most.
    df = df.join(F.broadcast(own), F.col(lang) == F.col("_lang"), "left").drop("_lang")
    out = df.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn("_w", words_of(F.col("_t")))

    def hits(words: list[str]) -> Column:
        return F.size(F.filter("_w", lambda w: w.isin(words)))

    likeliest = F.array_max(F.array(*[F.struct(hits(v).alias("n"), F.lit(k).alias("k")) for k, v in COMMON_WORDS.items()]))
    given = F.col(lang).isin(list(COMMON_WORDS)) | F.col("_own").isNotNull()
    unknown = F.struct(F.lit(None).cast("int").alias("n"), F.col(lang).cast("string").alias("k"))
    out = out.withColumn("_likely", F.when(given, unknown).otherwise(likeliest))
    fits = F.col("_likely")["n"].isNull() | (F.col("_likely")["n"] >= LIKELY_SHARE * F.size("_w"))
    out = out.withColumns({"_list": F.col("_likely")["k"], "_fits": fits}).drop("_likely")
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    found = F.when(F.col("_own").isNull(), F.filter("_w", lambda w: w.isin(every))).otherwise(F.filter("_w", lambda w: F.array_contains("_own", w)))
    common = bind(found, lambda f: F.transform(F.coalesce("_own", F.try_element_at(lists, F.col("_list"))), lambda t: (F.size(f) - F.size(F.array_remove(f, t))).cast("bigint")))
    classes = [_count_of(F.col("_t"), c).cast("bigint") for c in (UPPER, DIGITS, BLANKS, POINTS, SYMBOLS)]
    return out.withColumns({"_classes": F.array(*classes), "_common": common, "_chars": F.length("_t"), "n_words": F.size("_w").cast("bigint")})


def _measured(df: DataFrame, text: str, lang: str, own: DataFrame) -> DataFrame:
    """The histograms and the base counts of every row."""
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return _histograms(df, text, lang, own).withColumns({
        "word_chars": F.col("_chars").cast("bigint") - F.col("_classes")[2],
        "n_symbols": F.col("_classes")[4],
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col("_w")),
    }).drop("_t", "_w")


def _shares(counts: Column, total: Column) -> Column:
    """Counts and what is left of the total, as shares."""
    left = F.aggregate(counts, total.cast("bigint"), lambda a, c: a - c)
    return F.transform(F.concat(counts, F.array(left)), lambda c: c / F.greatest(total, F.lit(1)))


def fit_references(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``_list, _own, _class_ref, _word_ref``: the median share of every class and word, one row for each language list
    (``_own``, if it is learnt).

    Medians over texts past the guards: a reference stays that of ordinary text while most texts are ordinary.
    """
    return _references(_histograms(df, text, lang, fit_lists(df, text, lang)))


def _references(h: DataFrame) -> DataFrame:
    h = h.where(F.col("_fits") & (F.col("_chars") >= CLASS_GUARD) & (F.col("n_words") >= REFERENCE_WORDS))
    h = h.select("_list", "_own", _shares(F.col("_classes"), F.col("_chars")).alias("_c"), _shares(F.col("_common"), F.col("n_words")).alias("_s"))

    def medians(name: str, n: int) -> list[Column]:
        return [F.percentile_approx(F.col(name)[i], 0.5, 1000).alias(f"{name}{i}") for i in range(n)]

    def scaled(name: str, n: int) -> Column:
        every = [F.col(f"{name}{i}") for i in range(n)]
        return F.array(*[c / sum(every[1:], every[0]) for c in every])

    n_classes, n_words = 6, LIST_WORDS + 1
    found = h.groupBy("_list").agg(F.first("_own", ignorenulls=True).alias("_own"), *medians("_c", n_classes), *medians("_s", n_words))
    return found.select("_list", "_own", scaled("_c", n_classes).alias("_class_ref"), scaled("_s", n_words).alias("_word_ref"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares; 0 to 1."""

    def term(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (part(a) + part(b)) / 2

    total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def judge_quality(df: DataFrame, references: DataFrame | None = None, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """Add base counts, ``base_failed``, ``class_distance``, ``word_distance`` and ``kept`` to every row.

    ``references`` come from :func:`fit_references`, by default over ``df`` itself. Without ``keep_text`` the
    measures are written once, so that fitting and judging read the texts a single time.
    """
    learnt = references is None
    own = fit_lists(df, text, lang) if learnt else references.where("_own is not null").select(F.col("_list").alias("_lang"), "_own")
    h = _measured(df, text, lang, own)
    if not keep_text:
        h = written(h.drop(text), "quality")[0]
    if learnt:
        references = _references(h if not keep_text else _histograms(df, text, lang, own))
    # One row for each language list: the fixed ones and those of ``own``.
    h = h.drop("_own").join(F.broadcast(references.drop("_own")), "_list", "left")
    h = h.withColumns({
        "class_distance": F.when(F.col("_chars") >= CLASS_GUARD, js_distance(_shares(F.col("_classes"), F.col("_chars")), F.col("_class_ref"))),
        "word_distance": F.when(F.col("_fits") & (F.col("n_words") >= WORD_GUARD), js_distance(_shares(F.col("_common"), F.col("n_words")), F.col("_word_ref"))),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    by_class, by_word = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (by_class > CLASS_LIMIT) | ((by_word > WORD_LIMIT) & (F.col("n_words") >= LONG_WORDS)) | ((by_class > BOTH_LIMITS[0]) & (by_word > BOTH_LIMITS[1]))
    return h.withColumn("kept", ~F.col("base_failed") & ~far).drop("_list", "_fits", "_chars", "_classes", "_common", "_class_ref", "_word_ref")
