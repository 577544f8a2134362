"""Hand-made rows for the text expressions."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import text as X
from claimforge.functions import words as W
from claimforge.operators import cleaning as C
from claimforge.operators import textstats as S



def test_clean_statement(column):
    got = column(["", None, "?!", "“Quoted” – it’s", "<b>bold</b> http://x.y z", "Élève façade", "a b"], X.clean_statement("t"))
    assert got == ["", "", "?!", "quoted - it's", "bold z", "l ve fa ade", "a b"]


def test_clean_statement_numbers_and_case(column):
    assert column(["It cost 1,200.50 in 2010"], X.clean_statement("t", replace_numbers=True)) == ["it cost num in num"]
    assert column(["It cost 1,200"], X.clean_statement("t", replace_numbers=True, number_token="<NUM>", legacy=True)) == ["it cost"]
    assert column(["Keep CAPS"], X.clean_statement("t", lower=False)) == ["Keep CAPS"]
    assert column(["Keep CAPS"], X.clean_statement("t", lower=False, legacy=True)) == ["eep"]


def test_repair_statement(column):
    texts = ["", None, "first\tsecond\nthird", "  \t\nlate start", '"quoted"', "'\"both\"'", "a  b  c", "\n\n"]
    assert column(texts, X.repair_statement("t")) == ["", "", "first", "late start", "quoted", '"both"', "a b c", ""]
    assert column(["a\tb"], X.repair_statement("t", repair=False)) == ["a b"]


def test_category_cleaners(column):
    assert column(["Health|Care;Jobs", None, "A & B"], X.clean_subject("t")) == ["health,care,jobs", "", "a & b"]
    assert column(["barack-obama", "", "O'Neil, Jr."], X.clean_speaker("t")) == ["barack obama", "unknown", "o'neil jr."]
    assert column(["U.S. Rep/Sen & more", None], X.clean_job("t")) == ["u.s. rep sen more", "unknown"]
    assert column(["  State-Official ", None], X.clean_party("t")) == ["state-official", "unknown"]
    assert column(["<i>Ohio</i> ", ""], X.clean_state("t")) == ["ohio", "unknown"]


def test_contractions(column):
    texts = ["Can't stop, won't stop.", "dont weve Obamas", "the dog's bone; it’s", "cantaloupe", "écant", "They're who'd"]
    want = ["can not stop, will not stop.", "do not we have obama", "the dog bone; it is", "cantaloupe", "écant", "they are who would"]
    assert column(texts, X.expand_contractions("t")) == want


def test_every_contraction_form(column):
    from claimforge.functions import words as W

    table = W.CONTRACTIONS + W.BARE_CONTRACTIONS + W.NAME_FIXES
    assert column([f"x {f} y" for f, _ in table], X.expand_contractions("t")) == [f"x {e} y" for _, e in table]


def test_typed_numbers(column):
    assert column(["1/2 of 3rd 1,200.5"], X.squeeze(X.typed_numbers("t"))) == ["fraction of ordinal number"]


def test_unicode_normalization(spark):
    df = spark.createDataFrame([("No. 5\tÉlève ﬁx www.site.com/x can't",)], "t string")
    assert C.normalize_unicode_text(df, "t").first()["t_normalized"] == "number 5 eleve fix  can not"


def test_counts(column):
    assert column(["a bb  ccc", "", "  ", "x"], X.word_count(X.text("t"))) == [3, 0, 0, 1]
    assert column(["I can't go", "cannot never", None], X.lexicon_hits("t", S.LEXICONS["negation"])) == [0, 2, 0]
    assert column(["Dr. Smith met Gov. Jones. He left with Ann", "one Two"], X.proper_nouns("t")) == [1, 1]
    assert column(["w " * 49, "w " * 50, "w " * 150, "w " * 151], X.length_bucket(X.word_count(F.col("t")))) == ["short", "medium", "medium", "long"]


def syllables(word):
    import re

    word = re.sub("[^a-z]", "", word.lower())
    if not word:
        return 0
    n = len(re.findall("[aeiou]+", word))
    return max(1, n - 1 if word.endswith("e") and n > 1 else n)


def test_reading_ease(column):
    texts = ["The cake is made. We ate it!", "rhythm e the see create", "", "12 % -", "Élève don't bee-keeper"]
    for text, got in zip(texts, column(texts, X.reading_ease("t"))):
        import re

        n, pieces = len(text.split()), len(re.split("[.!?]+", text.strip()))
        want = 0.0 if not n else 206.835 - 1.015 * n / pieces - 84.6 * sum(map(syllables, text.split())) / n
        assert got == pytest.approx(want)


def test_md5_mod(column):
    import hashlib

    ids = [f"id{i}" for i in range(50)] + ["  padded "]
    want = [int(hashlib.md5(i.strip().encode()).hexdigest(), 16) % 97 for i in ids]
    assert column(ids, X.md5_mod("t", 97)) == want
    assert column(["", None], X.md5_mod("t", 5)) == [None, None]
    with pytest.raises(ValueError):
        X.md5_mod("t", 0)


def test_char_ngrams(column):
    assert column(["ab"], X.char_ngrams("t", 3, 5)) == [[" ab", "ab ", " ab "]]
    assert column(["a"], X.char_ngrams("t", 4, 5)) == [[" a "]]
    assert column(["abcd"], X.char_ngrams("t", 3, 3, word_boundary=False)) == [["abc", "bcd"]]


def test_ngrams(column):
    assert column(["a b c", "a"], X.ngrams(X.words(F.col("t")), 1, 3)) == [["a", "b", "c", "a b", "b c", "a b c"], ["a"]]


def test_enriched_text_skips_empty(spark):
    df = spark.createDataFrame([("claim", None, "ann", "")], "s string, j string, p string, q string")
    cols = {"statement": "s", "job": "j", "speaker": "p", "party": "q"}
    assert C.enriched_text(df, "prefixed", cols).first()["text_enriched"] == "Speaker: ann [SEP] Claim: claim"
    with pytest.raises(ValueError):
        C.enriched_text(df, "nope", cols)


def test_shape_and_title_flags(spark):
    df = spark.createDataFrame([("Dr. A/B (x)", "dr. a b x"), ("drastic", "drastic")], "r string, c string")
    out = S.title_flag(S.shape_features(df, "r", "c", ["slash", "parentheses", "comma"], "p"), "r").collect()
    assert [tuple(r)[2:] for r in out] == [(9, 4, 1, 1, 0, 1), (7, 1, 0, 0, 0, 0)]


def test_trimmed_whitespace_is_all_whitespace(spark):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(f"{chr(c)} {chr(c)}a{chr(c)}b c{chr(c)} d{chr(c)}\n",) for c in points], "t string")
    t = F.col("t")
    same = X.strip(t) == F.regexp_replace(t, f"^{W.SPACE}+|{W.SPACE}+$", "")
    numbers = F.regexp_replace(F.regexp_replace(F.lower(t), r"\p{Nd}+", " number "), W.other_than("a-zA-Z") + "+", " ")
    social = F.regexp_replace(F.translate(F.regexp_replace(F.lower(t), f"[@#][{W.WORD_CHARS}]+", ""), W.ASCII_PUNCTUATION, ""), r"\p{Nd}+", "")
    old = [F.trim(F.regexp_replace(c, f"{W.SPACE}+", " ")) for c in (numbers, social)]
    light = [X.light_clean("t", v) == o for v, o in zip(("numbers", "social"), old, strict=True)]
    assert df.where(~(same & light[0] & light[1])).count() == 0
    assert "regexp_replace" not in str(X.strip(t))
