"""Operators against brute force on small inputs, and the defined odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from claimforge.llm import decontaminate, id_files, packing, quality, range_coder, repeats, sanitise, toxicity, url_rules
from claimforge.llm.components import connected_components
from claimforge.llm.jaccard_join import one_of_each, similar_documents
from claimforge.llm.repeats import without_repeats
from claimforge.llm.token_counts import Counter as TokenCounter
from claimforge.llm.token_counts import token_counts, whole_tokens
from claimforge.llm.tokens import WordEncoder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length string, piece string, n string, spans string"


def odd_rows():
    long_text = "alpha beta gamma delta " * 4000 + "end"
    plain = "One more text with a few words in it and nothing else to see here"
    rows = [(None, None), (None, ""), (None, plain), (3, plain), (3, plain), (3, "another text under the same id"), (4, long_text), (5, "  \n\t "), (6, "İé 中文 \U0001f600")]
    return [(i, t, None, None, None, "x", "y", "z", "w") for i, t in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


# --- packing ---------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_without_gaps(seed):
    r = random.Random(seed)
    cap = r.choice([8, 30, 100])
    counts = {n: r.randint(0, 40) for n in range(1, cap + 1)}
    runs = packing.plan_best_fit(counts, cap)
    used, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in runs:
        ranks[length].extend(range(rank, rank + n))
        for k in range(n):
            used[first + k].append((offset, length))
    assert all(sorted(ranks[n]) == list(range(c)) for n, c in counts.items())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= cap
    total = sum(n * c for n, c in counts.items())
    assert len(used) <= -(-total // cap) * 11 / 9 + 1


def packed(df):
    pieces = packing.token_pieces(df, WORD_BPE, capacity=64)
    return packing.best_fit_pack(pieces.drop("ids"), order=["doc_id", "piece", "start"], capacity=64).collect()


def test_packing_of_odd_rows(odd, empty, library):
    rows = packed(odd)
    want = Counter()
    for i, t, *_ in odd_rows():
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        want.update((i, k, min(64, n - 64 * k)) for k in range(-(-n // 64)))
    assert Counter((r["doc_id"], r["piece"], r["length"]) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        ends = [o + n for o, n in sorted(places)]
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert packed(empty) == []


def test_encoder_equals_library(library):
    encoder, r = WordEncoder(WORD_BPE), random.Random(1)
    letters = "aAbB éÉİıſ'’s.,!?-12\t\n\xa0 ́\x1c\x85ßΣς中ªµ​ﬁ"
    texts = [None] + ["".join(r.choice(letters) if r.random() < 0.97 else "<|endoftext|>" for _ in range(r.randint(0, 25))) for _ in range(3000)]
    ids, starts = encoder.encode(pa.array(texts, pa.string()))
    for t, a, z in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:z].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


# --- id files --------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 7, 128, 129, 500, 8191, 8193, 30_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 1000, n), np.zeros(n, np.int64), np.resize(rng.integers(0, 1000, 50), n)):
        block = range_coder.encode_block(ids.astype("<u4"), 1000)
        assert (range_coder.decode_block(block) == ids).all()


def test_coder_learns_and_notices_damage():
    rng = np.random.default_rng(0)
    follows, ids = rng.permutation(1000), rng.integers(0, 1000, 200_000)
    for at in np.flatnonzero(rng.random(len(ids)) < 0.9)[1:]:
        ids[at] = follows[ids[at - 1]]
    ids = ids.astype("<u4")
    block = range_coder.encode_block(ids, 1000)
    assert 8 * len(block) / len(ids) < 6  # ten bits each without a model
    for at in (30, len(block) // 2, len(block) - 1):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode_block(bytes(broken))
    with pytest.raises(ValueError):
        range_coder.encode_block(np.array([1000]), 1000)


def test_coder_beats_counting_single_ids():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    ids = WordEncoder(WORD_BPE).encode(texts)[0]
    counts = np.bincount(ids)
    shares = counts[counts > 0] / len(ids)
    blocks = [range_coder.encode_block(ids[i : i + range_coder.BLOCK_IDS], 49_408) for i in range(0, len(ids), range_coder.BLOCK_IDS)]
    assert 8 * sum(map(len, blocks)) / len(ids) < -(shares * np.log2(shares)).sum()


@pytest.mark.parametrize("block_ids", [id_files.BLOCK_IDS, 500])
def test_id_files_of_odd_rows(odd, empty, library, block_ids):
    got = sorted((r for r in id_files.round_trip(odd, WORD_BPE, 49_408, block_ids=block_ids).collect()), key=lambda r: r["start"])
    want = Counter()
    for i, t, *_ in odd_rows():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in odd_rows()), key=lambda x: (x is not None, x))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert id_files.round_trip(empty, WORD_BPE, 49_408).collect() == []


def test_joined_crc():
    data = random.Random(0).randbytes(1000)
    for cuts in ((0, 1000), (0, 1, 999, 1000), (0, 0, 400, 1000)):
        pieces = [data[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        assert id_files.joined_crc([(zlib.crc32(p), len(p)) for p in pieces]) == zlib.crc32(data)


# --- token counts ----------------------------------------------------------


def test_counts_equal_library():
    counter, r = TokenCounter(BYTE_BPE, whole_tokens(BYTE_BPE)), random.Random(2)
    letters = "aAbB thé ÉİsS'’sllve.,!?-12½²\t\n\xa0\x1c\x85ßΣ中<​ﬁ_ͱ"
    texts = ["".join(r.choice(letters) if r.random() < 0.97 else r.choice(["<|endoftext|>", " the", "'re", "   "]) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1 " for c in range(0x250)]
    for t, n in zip(texts, counter.count(pa.array(texts)), strict=True):
        assert n == len(counter.library.encode(t, add_special_tokens=False).ids), repr(t)


def test_counts_of_odd_rows(odd, empty):
    rows = token_counts(odd, BYTE_BPE).collect()
    assert len(rows) == len(odd_rows())
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((t or "").encode()) for _, t, *_ in odd_rows())
    assert {r["n_tokens"] for r in rows if r["n_bytes"] == 0} == {0} and any(r["over_limit"] for r in rows)
    assert token_counts(empty, BYTE_BPE).collect() == []


# --- URL rules -------------------------------------------------------------


def test_url_rules(spark):
    rules = [url_rules.site_rule("com", "/", "allow"), url_rules.site_rule("a.com", "/en/", "block"), url_rules.site_rule("net", "/es", "block")]
    urls = ["http://A.com/en/x", "http://xa.com/en/x", "https://b.a.com/en/", "https://a.com/EN/", "http://x.net/espana?q", "http://x.net", "no scheme", None, "http://casino.org/x",
            "http://mycasinos2.org/", "http://a.com", "http://u.com/?casino", "http://b.com/en/://a.com/en/"]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)] + [(None, urls[0], 1, 2), (0, urls[0], 1, 2)], "page_id long, url string, rule int, host int")
    got = {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(df, url_rules.rule_table(spark, rules + url_rules.word_rules())).collect()}
    assert got[0] == got[None] == ("a.com", "/en/x", "a.com/en/", "block")
    assert got[1] == ("xa.com", "/en/x", "com/", "allow") and got[2][2] == "a.com/en/" and got[3] == ("a.com", "/EN/", "com/", "allow")
    assert got[4] == ("x.net", "/espana", "net/es", "block") and got[5] == ("x.net", "", None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("casino.org", "/x", None, "block") and got[9][3] == "allow"
    assert got[10] == ("a.com", "", None, "allow") and got[11][2:] == ("com/", "allow") and got[12] == ("b.com", "/en/://a.com/en/", "com/", "allow")
    many = url_rules.judge_urls(df, url_rules.rule_table(spark, rules), broadcast_rules=1)
    assert {r["page_id"]: r["rule"] for r in many.collect()} == {k: v[2] for k, v in got.items()}
    assert url_rules.judge_urls(df.limit(0), url_rules.rule_table(spark, rules)).collect() == []


def test_url_words_in_any_case(spark):
    rules = [url_rules.site_rule("net", "/Es/", "allow"), *url_rules.word_rules(), (None, "^Lotto^", "block", 0)]
    urls = ["http://x.org/CASINO/", "http://x.org/a/Poker", "http://x.org/MyPoker/", "http://x.net/Es/CASINO", "http://x.net/es/", "http://x.net/es/Spam", "http://x.org/po\u212aer/", "http://x.org/LOTTO?q", "http://x.org/CAS\u0130NO"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for limit in (url_rules.BROADCAST_RULES, 1):
        rows = url_rules.judge_urls(df, url_rules.rule_table(spark, rules), broadcast_rules=limit).collect()
        got = {r["page_id"]: (r["path"], r["rule"], r["verdict"]) for r in rows}
        assert [got[i][2] for i in range(9)] == ["block", "block", "allow", "allow", "allow", "block", "block", "block", "block"]
        assert got[0] == ("/CASINO/", None, "block") and got[3] == ("/Es/CASINO", "net/Es/", "allow") and got[4][1] is None


# --- similarity join -------------------------------------------------------


def brute_components(rows, n=5, percent=75):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed", range(2))
def test_join_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    bases = [[r.choice("abcdefgh") for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(240):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("abcdefgh")
        rows.append((i, " ".join(w[: r.randint(1, 40)] if r.random() < 0.3 else w)))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a b"), (304, "A B"), (305, "a b c")]
    got = {x["_id"]: (x["n_shingles"], x["component"]["_id"]) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_join_of_odd_rows(odd, empty):
    rows = similar_documents(odd).collect()
    assert len(rows) == len(odd_rows())
    assert {x["component"]["_id"] for x in rows if x["_id"] == 3} == {None, 3}  # the null id comes first
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(i, t) for i, t, *_ in odd_rows()} - {(3, odd_rows()[3][1])})
    assert similar_documents(empty).collect() == [] and one_of_each(empty).collect() == []


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 100 if 100 <= k < 140 else 0 for k in {x for p in pairs for x in p}}


# --- repeats ---------------------------------------------------------------


def brute_kept(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        cover = bytearray(len(w))
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                cover[k : k + window] = b"\1" * window
            seen.add(x)
        out.append((i, len(w), sum(cover), " ".join(a for a, c in zip(w, cover, strict=True) if not c)))
    return out


@pytest.mark.parametrize(("window", "seed", "hot"), [(4, 2, 10_000), (4, 2, 40), (8, 2, 40), (6, 3, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, window, seed, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # all, some and no hashes are broadcast
    r = random.Random(window)
    rows = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 60)))) for i in range(50)]
    got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, seed=seed)
    assert sorted(map(tuple, got.collect())) == brute_kept(rows, window)


def test_repeats_of_odd_rows(odd, empty):
    rows = without_repeats(odd).collect()
    assert len(rows) == len(odd_rows())
    long_one = next(r for r in rows if r["doc_id"] == 4)
    assert long_one["n_words"] == 16_001 and long_one["kept_text"].endswith(" end") and long_one["n_removed"] > 15_900
    assert without_repeats(empty).collect() == []


# --- quality ---------------------------------------------------------------


def test_quality_of_a_language_without_a_list(spark):
    r = random.Random(1)
    italian = "di che e il la non per una sono con del gli".split()

    def text(common, share=0.35, n=400):
        return " ".join(r.choice(common) if r.random() < share else "".join(r.choice("aeiolnrstc") for _ in range(r.randint(4, 9))) for _ in range(n))

    rows = [(text(quality.COMMON_WORDS["en"]), "en") for _ in range(30)] + [(text(italian), "it") for _ in range(30)]
    rows += [(text(italian, 0.0), "it"), (text(italian), None), (text(italian), "xx"), (text(quality.COMMON_WORDS["en"]), None)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, text string, lang string")
    counts = Counter(w for t, k in rows if k == "it" for w in t.split())
    assert [(x["_lang"], x["_own"]) for x in quality.fit_lists(df).collect()] == [("it", sorted(counts, key=lambda w: (-counts[w], w))[:12])]
    for judged in (quality.judge_quality(df), quality.judge_quality(df, keep_text=False), quality.judge_quality(df, quality.fit_references(df))):
        got = {x["doc_id"]: x for x in judged.collect()}
        assert [got[i]["kept"] for i in range(64)] == [True] * 60 + [False] + [True] * 3
        assert [got[i]["word_distance"] is None for i in range(59, 64)] == [False, False, True, True, False]
        assert "_own" not in judged.columns and "_fits" not in judged.columns


def test_quality_counts_and_verdicts(spark, odd, empty):
    r = random.Random(0)
    common = quality.COMMON_WORDS["en"]
    word = lambda: r.choice(common) if r.random() < 0.35 else "".join(r.choice("etaoinshr") for _ in range(r.randint(3, 9)))
    good = [" ".join(word() for _ in range(r.randint(120, 300))) + "." for _ in range(60)]
    junk = [" ".join(w + "###" for w in t.split()) for t in good[:5]] + [t.upper().replace(" ", "!! ") for t in good[5:10]]
    loops = ["same three words " * 60, "line one here\nline one here\nother line\n\n" + good[0]]
    texts = good + junk + loops
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = {x["doc_id"]: x for x in quality.judge_quality(df).collect()}
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        three = list(zip(w, w[1:], w[2:], strict=False))
        seen, cover = Counter(three), set()
        for k, x in enumerate(three):
            if seen[x] > 1:
                cover |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        got = rows[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))
    assert [rows[i]["kept"] for i in range(60)] == [True] * 60
    assert not any(rows[i]["kept"] for i in range(60, 71))
    judged = quality.judge_quality(odd)
    assert judged.count() == len(odd_rows()) and judged.where("kept").count() == 0
    assert quality.judge_quality(empty).collect() == []


# --- personal data ---------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, t):
            digits = [int(c) for c in m.group() if c.isdigit()]
            back = digits[::-1]
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and sum(back[::2] + [x * 2 - 9 * (x > 4) for x in back[1::2]]) % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(a, k, z) for a, _, k, z in sorted(out)]


def test_base_spans_equal_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice("ab.@-+ 0123456789()%_") for _ in range(r.randint(0, 40)))
        assert sanitise.base_spans(t) == brute_spans(t), repr(t)
    for digits in ("4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1112"):
        assert sanitise.base_spans(f"x {digits} y") == brute_spans(f"x {digits} y")
    assert sanitise.base_spans("a" * 200_000 + " " + "1" * 200_000) == []


def test_terms_that_disclose(spark, odd, empty):
    rows = [(i, f"the plain text number{i} of thing{i} with an agent and more") for i in range(80)]
    rows += [(i, f"the file{i} of zorblax agent and bob@x.org stuff{i}") for i in range(80, 85)]
    rows += [(i, "one copied text of ann@x.org only") for i in range(90, 99)] + [(99, "zorblax alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in sanitise.all_spans(df).collect()}
    assert [k for k, _ in spans[80]] == ["email", "term"] and spans[99] == [] and spans[0] == []
    assert [k for k, _ in spans[90]] == ["email"]  # copies are one observation
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(df).collect()}
    assert clean[80] == "the file80 of [TERM] agent and [EMAIL] stuff80" and clean[0] == rows[0][1]
    assert sanitise.sanitise(odd).columns == odd.columns and sanitise.sanitise(odd).count() == len(odd_rows())
    assert sanitise.all_spans(empty).collect() == [] and sanitise.sanitise(empty).collect() == []


# --- toxicity --------------------------------------------------------------


def edits(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours between two words."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_one_edit():
    r = random.Random(4)
    lexicon = {"".join(r.choice("abc") for _ in range(r.randint(1, 6))): r.random() + 0.1 for _ in range(40)}
    root = toxicity.trie(lexicon)
    for _ in range(1500):
        word = "".join(r.choice("abc") for _ in range(r.randint(1, 6)))
        want = max([w for t, w in lexicon.items() if edits(word, t) == 1], default=0.0)
        if word in lexicon:
            continue
        assert toxicity.within_one_edit(root, word) == want, word


def test_context_separates_quotation():
    matcher = toxicity.Matcher({"scoundrel": 3.0, "vile*": 2.0})
    plain, quoted, said = (matcher.features(t) for t in ("you scoundrel go", 'they read "the scoundrel left" here', "she said scoundrel once"))
    assert plain[0] > 0 and quoted[0] == said[0] == 0 and quoted[3] > 0 and said[3] > 0
    assert matcher.match("scoundrell") == (toxicity.FUZZY, 3.0) and matcher.match("vileness") == (toxicity.STEM, 2.0) and matcher.match("other") is None


def test_scores_hold_on_unseen_rows(spark, odd, empty):
    r = random.Random(5)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(3, 9)))
    rows, labels = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["scoundrel", "villain", "villian"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, known.where("doc_id < 300"))
    scores = {x["doc_id"]: x["score"] for x in model.scores(df).collect()}
    assert min(scores[i] for i in range(300, 400, 4)) > max(scores[i] for i in range(300, 400) if i % 4)
    assert all(0 <= s["score"] <= 1 for s in model.scores(odd).collect()) and model.scores(odd).count() == len(odd_rows())
    assert model.scores(empty).collect() == []
    assert all(x["score"] < 1e-6 for x in toxicity.fit(df, known.where("toxic = 0")).scores(odd).collect())


# --- decontamination -------------------------------------------------------


def test_leaks_are_found_and_clean_texts_left(spark, odd, empty):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(1500)]
    word = lambda: r.choice(vocabulary[:30]) if r.random() < 0.4 else r.choice(vocabulary)
    items = [(k, " ".join(word() for _ in range(r.randint(15, 40)))) for k in range(40)]
    docs = [(i, " ".join(word() for _ in range(r.randint(20, 200)))) for i in range(300)]
    want = set()
    for i in range(0, 60, 2):
        k = r.randrange(40)
        passage = items[k][1].split()
        if i % 4:
            passage = [w if r.random() < 0.85 else word() for w in passage]  # reworded in places
        text = docs[i][1].split()
        at = r.randrange(len(text))
        docs[i] = (i, " ".join(text[:at] + [w.capitalize() + "," for w in passage] + text[at:]))
        want.add((i, k))
    benchmark = spark.createDataFrame([(*x, "extra") for x in items] + [(77, None, ""), (78, "", "")], "item_id long, text string, doc_id string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    assert decontaminate.find_leaks(odd, benchmark).collect() == [] and decontaminate.find_leaks(empty, benchmark).collect() == []
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).collect() == []


def planted_leaks(seed, lengths, n_items, n_docs, reworded=0.5):
    """Items, documents that hold one each word for word or in nearly the same words, and those pairs."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(6000)]
    word = lambda: r.choice(vocabulary[:30]) if r.random() < 0.4 else r.choice(vocabulary)
    items = [(k, " ".join(word() for _ in range(r.choice(lengths)))) for k in range(n_items)]
    docs, want = [], set()
    for i in range(n_docs):
        k = r.randrange(n_items)
        passage = items[k][1].split()
        if r.random() < reworded:
            passage = [w if r.random() < 0.85 else word() for w in passage]
        text = [word() for _ in range(r.randint(20, 200))]
        at = r.randrange(len(text))
        docs.append((i, " ".join(text[:at] + passage + text[at:])))
        want.add((i, k))
    return items, docs, want


def leaks_of(spark, items, docs):
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string"))
    return {(x["doc_id"], x["item_id"]) for x in found.collect()}


def brute_leaks(items, docs):
    """All pairs of at least the least plain TF-IDF cosine over some passage and the least LCS over the whole text."""
    terms = sorted({w for _, t in items for w in t.split()})
    number = {w: k for k, w in enumerate(terms)}
    texts = [np.array([number.get(w, -1) for w in t.split()]) for _, t in docs]
    counts = np.bincount(np.concatenate([x[x >= 0] for x in texts]), minlength=len(terms))
    total = sum(-(-len(x) // decontaminate.STRIDE) for x in texts)
    idf = np.where(counts > decontaminate.COMMON_SHARE * total, 0.0, np.log((total + 1) / (counts + 1)))
    vector = lambda w: np.bincount(w[w >= 0], minlength=len(terms)) * idf
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    words = [np.array([number[w] for w in t.split()]) for _, t in items]
    listed, out = unit(np.stack([vector(w) for w in words])), set()
    for (i, _), x in zip(docs, texts, strict=True):
        close = (unit(np.stack([vector(x[a : a + 48]) for a in range(0, len(x), decontaminate.STRIDE)])) @ listed.T).max(axis=0) >= decontaminate.MIN_COSINE
        out |= {(i, items[k][0]) for k in np.flatnonzero(close) if decontaminate.common_subsequence(words[k], x) >= decontaminate.LCS_COPY * len(words[k])}
    return out


def test_thousand_items_keep_recall(spark):
    items, docs, want = planted_leaks(8, [20, 38], 1000, 600)
    got, brute = leaks_of(spark, items, docs), brute_leaks(items, docs)
    assert len(got & want) >= 0.9 * len(want) and len(got & brute) >= 0.9 * len(brute)
    assert len(brute & want) >= 0.9 * len(want)


def test_long_items_are_found(spark):
    items, docs, want = planted_leaks(9, [30, 400, 600, 900], 60, 120)
    got = leaks_of(spark, items, docs)
    long_ones = {(i, k) for i, k in want if len(items[k][1].split()) >= 400}
    assert len(got & want) >= 0.9 * len(want) and len(got & long_ones) >= 0.9 * len(long_ones) and got <= want


def test_widespread_leak_is_found(spark):
    r = random.Random(10)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(3000)]
    word = lambda: r.choice(vocabulary[:30]) if r.random() < 0.4 else r.choice(vocabulary)
    items = [(k, " ".join(word() for _ in range(r.choice([20, 38])))) for k in range(30)]
    items.append((30, " ".join(r.choice(vocabulary[:30]) for _ in range(30))))  # of frequent words only
    docs, want = [], set()
    for i in range(600):
        text = [word() for _ in range(r.randint(20, 120))]
        k = 0 if i % 3 == 0 else 30 if i % 50 == 1 else None  # one item in a third of the rows
        if k is not None:
            at = r.randrange(len(text))
            text[at:at] = items[k][1].split()
            want.add((i, k))
        docs.append((i, " ".join(text)))
    got = leaks_of(spark, items, docs)
    for k in {k for _, k in want}:
        assert len({x for x in got & want if x[1] == k}) >= 0.9 * len({x for x in want if x[1] == k}), k
    everywhere = [(i, items[3][1]) for i in range(50)]
    assert leaks_of(spark, items, everywhere) >= {(i, 3) for i in range(50)}


def test_space_is_fitted_on_every_document(spark, monkeypatch):
    seen, fit = [], decontaminate.latent_space

    def watched(rows, *rest):
        seen.append(rows.count())
        return fit(rows, *rest)

    monkeypatch.setattr(decontaminate, "latent_space", watched)
    items, docs, want = planted_leaks(11, [20, 38], 20, 1300)
    assert len(leaks_of(spark, items, docs) & want) >= 0.9 * len(want)
    assert seen == [len(docs) + len(items)]


def test_space_holds_what_the_best_one_holds(spark):
    r, n_terms = np.random.default_rng(12), 200
    texts = [np.where(r.random(n) < 0.3, -1, r.zipf(1.4, n) % n_terms) for n in [0, 1, 16, 17, 90, *r.integers(1, 200, 300)]]
    idf, weight = np.where(r.random(n_terms) < 0.1, 0.0, 1 + r.random(n_terms)), 1 + r.random(len(texts))
    kind, rows = decontaminate.number_type(n_terms), []
    for words, w in zip(texts, weight, strict=True):
        strides = max(-(-len(words) // 16), 1)
        for at in range(max(strides - 2, 1)):
            part = words[at * 16 : at * 16 + 48]
            row = np.bincount(part[part >= 0], minlength=n_terms) * idf
            rows.append(w * row / max(np.linalg.norm(np.sqrt(np.bincount(part[part >= 0], minlength=n_terms)) * idf), 1e-4))
    df = spark.createDataFrame([(bytearray(x.astype(kind).tobytes()), float(w)) for x, w in zip(texts, weight, strict=True)], "_words binary, weight double")
    space = decontaminate.latent_space(df.repartition(5), n_terms, idf, 20)
    best = np.linalg.svd(np.stack(rows), compute_uv=False)[:20]
    assert space.shape == (n_terms, 20) and np.allclose(space.T @ space, np.eye(20), atol=1e-6)
    held = np.linalg.norm(np.stack(rows) @ space, axis=0)
    assert np.allclose(held[:5], best[:5], rtol=1e-3) and (held**2).sum() >= 0.99 * (best**2).sum()


def test_common_subsequence():
    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.randrange(4) for _ in range(r.randint(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a), np.array(b)) == best[-1][-1]


def test_digest_of_kept_words(spark):
    df = spark.createDataFrame([(1, "a  b\tc")], "doc_id long, text string")
    row = without_repeats(df).select(F.sha2("kept_text", 256)).first()
    assert row[0] == hashlib.sha256(b"a b c").hexdigest()


def test_models_in_turn_keep_their_own_scores(spark, monkeypatch):
    """Workers outlive models; a model that takes another's place in memory must not take its lexicon."""
    import builtins

    from claimforge.llm import toxicity as T

    monkeypatch.setattr(T, "id", lambda x: 7, raising=False)
    df = spark.createDataFrame([(1, "a foolish thing"), (2, "a barbaric thing")], "doc_id long, text string")

    def scores(word):
        model = T.ToxicityModel({word: 3.0}, [], 0.0)
        return {r["doc_id"]: tuple(r["features"]) for r in model.with_features(df, "text").collect()}

    first, second, third = scores("foolish"), scores("barbaric"), scores("foolish")
    assert first == third != second and builtins.id is not T.__dict__.get("id")


def test_components_after_more_links(spark):
    from claimforge.llm.components import connected_components, merged_components

    first = [(1, 2), (2, 3), (10, 11), (20, 21)]
    more = [(3, 10), (30, 31), (31, 1), (20, 21), (40, 41)]
    schema = "a long, b long"
    labels = connected_components(spark.createDataFrame(first, schema))
    got = {r["node"]: r["component"] for r in merged_components(labels, spark.createDataFrame(more, schema)).collect()}
    want = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(first + more, schema)).collect()}
    assert got == want
    assert merged_components(labels, spark.createDataFrame([], schema)) is labels


def test_encoder_does_not_encode_a_run_of_letters_twice(library, monkeypatch):
    from claimforge.llm import tokens

    monkeypatch.setattr(tokens, "KNOWN_RUNS", 32)
    encoder, r = WordEncoder(WORD_BPE), random.Random(2)
    asked, runs = [], encoder.runs
    monkeypatch.setattr(encoder, "runs", lambda letters: asked.extend(letters.to_pylist()) or runs(letters))
    words = ["".join(r.choice("abcdeéßı") for _ in range(1 + k % 6)) for k in range(60)]
    first = [" ".join(r.choices(words[:30], k=40)) for _ in range(3)]
    second = first + [" ".join(r.choices(words, k=40)) + odd for odd in (" don't, stop. x1", "\xa0<|endoftext|>", "")]
    for texts in (first, second, second):
        ids, starts = encoder.encode(pa.array(texts, pa.string()))
        for t, a, z in zip(texts, starts[:-1], starts[1:], strict=True):
            assert ids[a:z].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    kept = encoder.known.to_pylist()
    assert len(kept) == 32 and len(encoder.known_ids) == encoder.known_sizes.sum()
    assert all(asked.count(w) == 1 for w in kept)


def test_pairs_of_a_large_group_are_ruled_out_before_they_are_checked(spark, monkeypatch):
    from claimforge.llm import jaccard_join

    r, asked = random.Random(3), []
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in r.sample(range(150), r.randint(3, 6)):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    got = {x["_id"]: (x["n_shingles"], x["component"]["_id"]) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert sum(asked) < 6_000  # of 44,850


def test_bounds_of_pairs_hold_for_similar_sets(spark):
    from claimforge.llm import jaccard_join

    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        n = int(rng.integers(1, 60)) if k % 4 else int(rng.integers(60, 3000))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        kept = a[rng.random(len(a)) < rng.uniform(0.75, 1)]
        b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, int(rng.integers(0, len(a) // 6 + 1)), dtype=np.uint64)]))
        both = np.intersect1d(a, b)
        if not len(both) or 100 * len(both) < 75 * (len(a) + len(b) - len(both)):
            continue
        for j, s in enumerate(both[:6]):  # in the order of the hashes, like sets of equal counts
            rows.append((k, j + 1, int(np.searchsorted(a, s)), len(a), int(np.searchsorted(b, s)), len(b), *jaccard_join.parities(a).tolist(), *jaccard_join.parities(b).tolist()))
    words = [f"{p}{e} long" for e in "12" for p in jaccard_join.PARITIES]
    df = spark.createDataFrame(rows, ", ".join(["k int, place int, at1 int, n1 int, at2 int, n2 int", *words]))
    level = jaccard_join._level(F.col("at1"), F.col("n1"), F.col("at2"), F.col("n2"), 75)
    good = jaccard_join._similar_size(F.col("n1"), F.col("n2"), 75) & (level <= F.col("place")) & jaccard_join._similar_parities("1", "2", 75)
    assert len(rows) > 400 and df.where(~good).count() == 0


def test_long_lists_get_more_hubs_before_all_their_pairs(spark, monkeypatch):
    from claimforge.llm import jaccard_join

    r, asked = random.Random(8), []
    rows = []
    for i in range(500):
        w = [f"w{k}" for k in range(150)]
        for at in r.sample(range(150), r.randint(3, 5) if i else 0):
            w[at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    verified = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *a: asked.append(pairs.count()) or verified(pairs, *a))
    got = {x["_id"]: (x["n_shingles"], x["component"]["_id"]) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert asked[-1] < 500  # all pairs that are left


def test_join_writes_few_tables_and_checks_pairs_once(spark, monkeypatch):
    """Each step that is written or cut is a query of its own, whose plan and tasks the driver holds."""
    from claimforge.llm import components, jaccard_join

    steps = []
    for module in (components, jaccard_join):
        for name in {"cut", "written"} & set(vars(module)):
            run = getattr(module, name)
            monkeypatch.setattr(module, name, lambda *a, run=run: steps.append(run.__name__) or run(*a))
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[: 10 + i], f"x{i}", *base[11 + i :]])) for i in range(12)] + [(20, "a b c"), (21, None)]
    got = {x["_id"]: (x["n_shingles"], x["component"]["_id"]) for x in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
    assert len(steps) <= 22  # 29 when lists and checked pairs were written too
