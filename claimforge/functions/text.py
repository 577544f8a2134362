"""Text expressions. Every function takes and returns a ``Column``.

Whitespace is Unicode whitespace and word edges are written as look-arounds over
letters, numbers and ``_``: Java's plain ``\\s``, ``\\w`` and ``\\b`` mean less.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

TAG = r"<[^>]+>"
URL = rf"https?://{W.NOT_SPACE}+|www\.{W.NOT_SPACE}+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def sub(c: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(c, pattern, repl)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def chars_in(c: Column, char_class: str) -> Column:
    """Number of characters of a class, as what removing them takes away.

    Counting matches would build every match as a string first.
    """
    return F.length(c) - F.length(sub(c, char_class + "+", ""))


def literal_count(c: Column, ch: str) -> Column:
    """Occurrences of one character."""
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(W.SPACES))


def squeeze(c: Column) -> Column:
    """Whitespace runs become one blank, ends are trimmed."""
    return F.trim(sub(c, rf"{W.SPACE}+", " "))


def words(c: Column) -> Column:
    """Whitespace-separated tokens without empties."""
    return F.filter(F.split(c, rf"{W.SPACE}+"), lambda t: t != "")


def word_count(c: Column) -> Column:
    """Whitespace-separated words: the blanks of the squeezed text, plus one unless it is empty."""
    x = squeeze(c)
    return literal_count(x, " ") + F.when(x == "", 0).otherwise(1)


def per_char(n: Column, c: Column) -> Column:
    """``n`` divided by the text length, at least one."""
    return n / F.greatest(F.length(c), F.lit(1))


def whole_words(forms: Iterable[str]) -> str:
    """Pattern for any of ``forms`` standing as a whole word."""
    alts = "|".join(re.escape(f) for f in forms)
    return rf"(?<![{W.WORD_CHARS}])(?:{alts})(?![{W.WORD_CHARS}])"


# --- cleaning ---------------------------------------------------------------


def ascii_marks(c: Column) -> Column:
    """Curly quotes and long dashes to ASCII."""
    return F.translate(c, "“”‘’–—", "\"\"''--")


def clean_statement(
    c: Column | str,
    lower: bool = True,
    remove_html: bool = True,
    remove_urls: bool = True,
    replace_numbers: bool = False,
    number_token: str = "num",
    legacy: bool = False,
) -> Column:
    """Statement cleaning; ``legacy`` keeps the lower-case-only filter whatever ``lower`` says."""
    x = ascii_marks(text(c))
    if lower:
        x = F.lower(x)
    if remove_html:
        x = sub(x, TAG, " ")
    if remove_urls:
        x = sub(x, URL, " ")
    if replace_numbers:
        digits = rf"(?<![{W.WORD_CHARS}])\p{{Nd}}+[\p{{Nd}},.:/-]*(?:(?<=[{W.WORD_CHARS}])(?![{W.WORD_CHARS}])|(?<![{W.WORD_CHARS}])(?=[{W.WORD_CHARS}]))"
        x = sub(x, digits, f" {number_token} ")
    upper = "" if lower or legacy else "A-Z"
    return squeeze(sub(x, W.other_than(rf"a-z{upper}0-9'?!.,%\-") + "+", " "))


def repair_statement(c: Column | str, lower: bool = False, repair: bool = True) -> Column:
    """First non-blank tab/line segment, outer quotes off, whitespace squeezed."""
    x = text(c)
    if repair:
        x = F.regexp_extract(x, rf"[^\t\r\n]*{W.NOT_SPACE}[^\t\r\n]*", 0)
    x = F.btrim(F.btrim(strip(x), F.lit('"')), F.lit("'"))
    x = squeeze(x)
    return F.lower(x) if lower else x


def _base_category(c: Column | str) -> Column:
    x = F.lower(strip(text(c)))
    return sub(sub(x, TAG, " "), URL, " ")


def clean_subject(c: Column | str, normalize_separators: bool = True) -> Column:
    x = _base_category(c)
    if normalize_separators:
        x = sub(x, r"[|/;]+", ",")
    return squeeze(sub(x, W.other_than("a-z0-9,&-") + "+", " "))


def or_unknown(c: Column, label: str = "unknown") -> Column:
    return F.when(c == "", F.lit(label)).otherwise(c)


def clean_speaker(c: Column | str, normalize_separators: bool = True) -> Column:
    x = _base_category(c)
    if normalize_separators:
        x = sub(x, r"[|/_;,-]+", " ")
    return or_unknown(squeeze(sub(x, W.other_than("a-z0-9'.") + "+", " ")))


def clean_job(c: Column | str, normalize_separators: bool = True) -> Column:
    x = _base_category(c)
    if normalize_separators:
        x = sub(x, r"[|/;,&]+", " ")
    return or_unknown(squeeze(sub(x, W.other_than("a-z0-9'.-") + "+", " ")))


def clean_party(c: Column | str) -> Column:
    return or_unknown(squeeze(_base_category(c)))


def clean_state(c: Column | str) -> Column:
    return or_unknown(squeeze(sub(F.lower(strip(text(c))), TAG, " ")))


def plain_category(c: Column | str) -> Column:
    """Cleaning switched off: trim and lower only."""
    return or_unknown(F.lower(strip(text(c))))


def separator_clean(c: Column | str, separators: str) -> Column:
    """Lower-case, listed separator characters become blanks."""
    return squeeze(F.translate(F.lower(text(c)), separators, " " * len(separators)))


def light_clean(c: Column | str, variant: str) -> Column:
    """Four short cleaners: ``numbers``, ``social``, ``brackets``, ``annotations``."""
    x = text(c)
    if variant == "numbers":
        return F.trim(sub(sub(F.lower(x), r"\p{Nd}+", " number "), "[^a-zA-Z]+", " "))
    if variant == "social":
        x = sub(F.lower(x), rf"http{W.NOT_SPACE}+|www{W.NOT_SPACE}+", "")
        x = sub(x, rf"[@#][{W.WORD_CHARS}]+", "")
        return squeeze(sub(x, r"[!-/:-@\[-`{-~\p{Nd}]+", ""))
    if variant == "brackets":
        x = sub(F.lower(x), r"\[[^\n]*?\]", "")
        return squeeze(sub(x, W.other_than("a-z0-9-") + "+", ""))
    if variant == "annotations":
        return strip(sub(strip(x), r"\([^\n]*?\)", ""))
    raise ValueError("variant must be 'numbers', 'social', 'brackets' or 'annotations'")


# --- contractions and number words ------------------------------------------


def _ending_rules(table: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Merge a (form, expansion) table into one pattern per new ending.

    ``don't``, ``didn't`` and ``can't`` all end up as ``... not``; one pass serves them.
    """
    endings: dict[str, dict[str, list[str]]] = {}
    for form, expansion in table:
        n = 0
        while n < min(len(form), len(expansion)) and form[n] == expansion[n]:
            n += 1
        endings.setdefault(expansion[n:], {}).setdefault(form[n:], []).append(form[:n])
    rules = []
    for ending, stems in endings.items():
        alts = "|".join(f"({'|'.join(s)}){re.escape(old)}" for old, s in stems.items())
        kept = "".join(f"${i + 1}" for i in range(len(stems)))
        rules.append((rf"(?<![{W.WORD_CHARS}])(?:{alts})(?![{W.WORD_CHARS}])", kept + ending))
    return rules


def expand_contractions(c: Column | str) -> Column:
    """Contractions with and without apostrophe, name fixes, then possessive ``'s``."""
    x = F.translate(F.lower(text(c)), "’", "'")
    table = W.CONTRACTIONS + W.BARE_CONTRACTIONS
    expanded = x
    for pattern, repl in _ending_rules(table) + _ending_rules(W.NAME_FIXES):
        expanded = sub(expanded, pattern, repl)
    # Most texts hold none of the forms: one scan spares them every pass.
    has_form = x.rlike(whole_words(form for form, _ in table + W.NAME_FIXES))
    y = F.when(has_form, expanded).otherwise(x)
    possessive = sub(y, rf"(?<![{W.WORD_CHARS}])([a-z]+)'s(?![{W.WORD_CHARS}])", "$1")
    return F.when(y.contains("'s"), possessive).otherwise(y)


def number_abbreviation(c: Column) -> Column:
    """``No. 5`` becomes ``number 5``."""
    return sub(c, rf"(?i)(?<![{W.WORD_CHARS}])No\.{W.SPACE}*(\p{{Nd}}+)", "number $1")


def drop_domains(c: Column) -> Column:
    """Remove tokens that look like ``name.com``."""
    return sub(c, rf"(?<!{W.NOT_SPACE}){W.NOT_SPACE}+\.(?:edu|com|gov|net){W.NOT_SPACE}*", "")


def typed_numbers(c: Column | str) -> Column:
    """Digits become ``fraction``, ``ordinal`` or ``number``; only letters and apostrophes stay."""
    x = sub(text(c), r"\p{Nd}+/\p{Nd}+(?:st|nd|rd|th)?", " fraction ")
    x = sub(x, r"\p{Nd}+(?:st|nd|rd|th)", " ordinal ")
    x = sub(x, r"\p{Nd}+(?:[.,]\p{Nd}+)*", " number ")
    return sub(x, "[^a-zA-Z']", " ")


# --- tokens -----------------------------------------------------------------


def strip_token_punct(tokens: Column) -> Column:
    bare = F.transform(tokens, lambda t: F.translate(t, W.ASCII_PUNCTUATION, ""))
    return F.filter(bare, lambda t: t != "")


def drop_stopwords(tokens: Column, stoplist: Sequence[str], keep_negations: bool = True) -> Column:
    stops = sorted(set(stoplist) - set(W.KEPT_NEGATIONS)) if keep_negations else sorted(set(stoplist))
    if not stops:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(stops))


def alphabetic_tokens(c: Column, min_len: int = 2) -> Column:
    return F.filter(words(c), lambda t: t.rlike(r"^\p{L}+$") & (F.length(t) >= min_len))


def vector_terms(c: Column | str) -> Column:
    """Lower-case runs of two or more word characters, the usual vectoriser tokens."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(rf"[{W.WORD_CHARS}]{{2,}}"), F.lit(0))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` mentions it.

    Lambdas re-evaluate what they capture for every element; a lambda variable does not.
    """
    return F.transform(F.array(value), use)[0]


def ngrams(tokens: Column, n_min: int, n_max: int) -> Column:
    """All word n-grams of ``n_min``..``n_max`` tokens joined by a blank."""
    if (n_min, n_max) == (1, 1):
        return tokens
    none = F.array().cast("array<string>")

    def of_size(t: Column, n: int) -> Column:
        if n == 1:
            return t
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))).otherwise(none)

    return bind(tokens, lambda t: F.concat(*[of_size(t, n) for n in range(n_min, n_max + 1)]))


def char_ngrams(c: Column | str, n_min: int, n_max: int, word_boundary: bool = True) -> Column:
    """Character n-grams inside blank-padded words, or across the squeezed text."""
    x = squeeze(F.lower(text(c)))
    if not word_boundary:
        x = sub(F.lower(text(c)), rf"{W.SPACE}{{2,}}", " ")
        return _spans(F.array(x), n_min, n_max, pad=False)
    return _spans(words(x), n_min, n_max, pad=True)


def _spans(units: Column, n_min: int, n_max: int, pad: bool) -> Column:
    padded = F.transform(units, lambda w: F.concat(F.lit(" "), w, F.lit(" "))) if pad else units
    none = F.array().cast("array<string>")

    def of_size(w: Column, n: int) -> Column:
        last = F.length(w) - (n - 1)
        starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)))
        grams = F.when(last >= 1, F.transform(starts, lambda i: F.substring(w, i, F.lit(n))))
        # A padded word shorter than the smallest size still yields itself once.
        return grams.otherwise(F.array(w) if pad and n == n_min else none)

    def spans(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in range(n_min, n_max + 1)])

    return F.flatten(F.transform(padded, spans))


# --- counts -----------------------------------------------------------------


def lexicon_hits(c: Column | str, lexicon: Sequence[str]) -> Column:
    """Tokens ``[a-z']+`` of the lower-cased text that equal a lexicon word."""
    alts = "|".join(re.escape(w) for w in lexicon)
    return count_of(F.lower(text(c)), rf"(?<![a-z'])(?:{alts})(?![a-z'])")


def class_of(chars: str) -> str:
    """Regex class matching exactly the given characters."""
    return "[" + "".join("\\" + ch if not ch.isalnum() else ch for ch in chars) + "]"


def proper_nouns(c: Column | str) -> Column:
    """Capitalised alphabetic words that do not open a sentence."""
    return count_of(squeeze(text(c)), r"(?<![.!?]) \p{Lu}\p{L}*(?= |$)")


def reading_ease(c: Column | str) -> Column:
    """Flesch reading ease; syllables are vowel groups, a closing silent ``e`` does not count."""
    x = strip(text(c))
    n_words = word_count(x)
    n_sentences = count_of(x, "[.!?]+") + 1
    letters = sub(F.lower(x), W.other_than("a-z") + "+", "")
    consonants = "[b-df-hj-np-tv-z]*+"
    # One syllable per vowel group, minus a closing "e"; words that would be left with none get one back.
    groups = count_of(letters, "[aeiou]+")
    closing_e = count_of(letters, "e(?![a-z])")
    one_at_least = count_of(letters, rf"(?<![a-z])(?=[a-z]){consonants}(?:[aeiou]*e)?(?![a-z])")
    syllables = groups - closing_e + one_at_least
    score = F.lit(206.835) - 1.015 * (n_words / n_sentences) - 84.6 * (syllables / n_words)
    return F.when(n_words == 0, F.lit(0.0)).otherwise(score)


def length_bucket(n: Column, bins: tuple[int, int] = (50, 150)) -> Column:
    low, high = bins
    return F.when(n < low, "short").when(n <= high, "medium").otherwise("long")


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


# --- identifiers ------------------------------------------------------------


def md5_mod(c: Column | str, n: int) -> Column:
    """``md5(trimmed value)`` as a 128-bit integer modulo ``n``; blank or null stays null."""
    if n <= 0:
        raise ValueError("n must be greater than 0")
    if n > 2**31 - 1:
        raise ValueError("n must fit in an int")
    value = strip(col(c).cast("string"))
    digest = F.md5(F.when(value != "", value))
    acc: Column | None = None
    for start in (1, 9, 17, 25):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        acc = chunk % n if acc is None else (acc * ((2**32) % n) + chunk) % n
    return acc.cast("int")


def primary_of_list(c: Column | str, empty: str = "unknown") -> Column:
    """Text before the first comma."""
    head = strip(F.split(text(c), ",", 2).getItem(0))
    return or_unknown(head, empty)
