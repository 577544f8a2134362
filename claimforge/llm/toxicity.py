"""Toxicity scores from a learnt lexicon, matched through misspellings and weighed by context.

The lexicon is learnt from labelled texts: words, and stems (word beginnings), that occur far more often
in toxic ones. A text's words meet it in three ways: as a lexicon word, by the longest lexicon stem, or
within one edit, found by running the word's Levenshtein automaton and the lexicon trie in step: the
automaton's states are (letters read, edits made), and a trie branch is left as soon as no state is alive.
Every hit looks at a window of words around it: quotation marks on both sides or a reporting verb before
it make it a quotation, other hits close by make it abuse. A logistic model weighs the sums.

The lexicon and the model are fitted on a bounded sample of labelled rows (``FIT_ROWS``); every row is scored.

Defined cases: null and empty texts have no hits and get the model's score for that; a null key and
repeated rows are kept; without labels of both classes the score is the share of toxic labels (0 without
any); an empty table gives an empty result; columns other than key and text are not read for the score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import slices

FIT_ROWS = 8000
MAX_TERMS = 3000
MIN_TOXIC_TEXTS = 5
MIN_WEIGHT = 1.5
MIN_EVIDENCE = 12.0
COUNT_CAP = 5
STEM_LENGTHS = range(4, 9)
FUZZY_LENGTH = 5
WINDOW = 6
CLOSE = 40
MEMO_LIMIT = 400_000
END = ""
EXACT, STEM, FUZZY = 0, 1, 2

TOKENS = re.compile(r"[^\W\d_]+|[\"“”„«»]")
#: Marks of quotation, and words that report another's speech.
MARKS = frozenset("\"“”„«»")
REPORTING = frozenset("said says wrote writes quoted quote called calls sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())


def _terms(word: str) -> list[str]:
    """The word and its stems; a stem ends in ``*``."""
    return [word, *(word[:n] + "*" for n in STEM_LENGTHS if n < len(word))]


def term_counts(sample: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """``term, toxic, clean, toxic_texts, clean_texts``: occurrences, at most ``COUNT_CAP`` a text, and texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter(), Counter()]
        texts = [Counter(), Counter()]
        for batch in slices(batches, text):
            for t, y in zip(batch.column(text).to_pylist(), batch.column(label).to_pylist(), strict=True):
                words = [w for w in TOKENS.findall((t or "").lower()) if len(w) > 2]
                found = Counter(x for w in words for x in _terms(w))
                n[y].update({k: min(v, COUNT_CAP) for k, v in found.items()})
                texts[y].update(found.keys())
                n[y]["*"] += len(words)
                texts[y]["*"] += 1
        terms = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([c[x] for x in terms], pa.int64()) for c in (n[1], n[0], texts[1], texts[0]))],
            ["term", "toxic", "clean", "toxic_texts", "clean_texts"],
        )

    parts = sample.select(text, label).mapInArrow(count, "term string, toxic bigint, clean bigint, toxic_texts bigint, clean_texts bigint")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "toxic_texts", "clean_texts")])


def learn_lexicon(sample: DataFrame, text: str = "text", label: str = "label") -> dict[str, float]:
    """Up to ``MAX_TERMS`` terms with their weights, the log ratio of their rates in toxic and clean texts."""
    counts = cut(term_counts(sample, text, label))
    total = counts.where("term = '*'").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return {}
    rate = lambda n, words: (F.col(n) + 0.5) / (words + 1.0)
    weight = F.log(rate("toxic", total["toxic"]) / rate("clean", total["clean"]))
    good = counts.where("term <> '*'").withColumn("weight", weight).where(
        (F.col("toxic_texts") >= MIN_TOXIC_TEXTS) & (F.col("weight") >= MIN_WEIGHT) & (F.col("toxic") * F.col("weight") >= MIN_EVIDENCE)
    )
    rows = good.orderBy((F.col("toxic") * F.col("weight")).desc(), "term").limit(MAX_TERMS).collect()
    return {r["term"]: r["weight"] for r in rows}


def trie(terms: dict[str, float]) -> dict:
    root: dict = {}
    for term, weight in terms.items():
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[END] = weight
    return root


def _follow(node: dict | None, word: str, at: int) -> float:
    """The rest of the word without further edits."""
    while node is not None and at < len(word):
        node = node.get(word[at])
        at += 1
    return node.get(END, 0.0) if node else 0.0


def within_one_edit(root: dict, word: str) -> float:
    """The largest weight of a trie word one insertion, deletion, substitution or swap from ``word``; 0 if none.

    States are (letters read, edits made). The state without edits walks the trie along the word; at each node
    every edit is tried and left at once unless the letter it needs next is there.
    """
    node, best, n = root, 0.0, len(word)
    for at in range(n + 1):
        here = word[at] if at < n else END
        after = word[at + 1] if at + 1 < n else END
        for c, child in node.items():
            if c == END:
                continue
            if here in child:  # a letter is missing
                best = max(best, _follow(child, word, at))
            if at < n and c != here:
                if after in child:  # another letter stands here
                    best = max(best, _follow(child, word, at + 1))
                if c == after and here in child:  # two letters are swapped
                    best = max(best, _follow(child[here], word, at + 2))
        if at == n:
            break
        if after in node:  # a letter is too many
            best = max(best, _follow(node, word, at + 1))
        if here not in node:
            break
        node = node[here]
    return best


class Matcher:
    """Hits and features of texts for one lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.words = trie({k: v for k, v in lexicon.items() if not k.endswith("*")})
        self.stems = trie({k[:-1]: v for k, v in lexicon.items() if k.endswith("*")})
        lengths = {len(k) for k in lexicon if not k.endswith("*")}
        self.fuzzy_lengths = {n + d for n in lengths for d in (-1, 0, 1) if n + d >= FUZZY_LENGTH}
        self.memo: dict[str, tuple[int, float] | None] = {}

    def match(self, word: str) -> tuple[int, float] | None:
        weight = _follow(self.words, word, 0)
        if weight:
            return EXACT, weight
        node, stem = self.stems, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                break
            stem = node.get(END, stem)
        if stem:
            return STEM, stem
        if len(word) in self.fuzzy_lengths:
            weight = within_one_edit(self.words, word)
            if weight:
                return FUZZY, weight
        return None

    def features(self, text: str | None) -> list[float]:
        tokens = TOKENS.findall(text.lower()) if text else []
        memo = self.memo
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        kinds = set(tokens)
        for w in kinds:
            if w not in memo:
                memo[w] = self.match(w)
        hits = [(i, *hit) for i, hit in enumerate(map(memo.__getitem__, tokens)) if hit]
        may_quote = not MARKS.isdisjoint(kinds) or not REPORTING.isdisjoint(kinds)
        sums, quoted = [0.0, 0.0, 0.0], 0.0
        for i, kind, weight in hits:
            if not may_quote:
                sums[kind] += weight
                continue
            before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
            is_quote = (not MARKS.isdisjoint(before) and not MARKS.isdisjoint(after)) or not REPORTING.isdisjoint(before)
            if is_quote:
                quoted += weight
            else:
                sums[kind] += weight
        total, close, first = sum(sums), 0.0, 0
        running = 0.0
        for i, _, weight in hits:  # the heaviest stretch of CLOSE tokens
            running += weight
            while i - hits[first][0] >= CLOSE:
                running -= hits[first][2]
                first += 1
            close = max(close, running)
        n = len(tokens)
        distinct = len({tokens[i] for i, _, _ in hits})
        values = [*sums, quoted, close, distinct, 100 * total / (n + 20), 100 * sums[STEM] / (n + 20)]
        return [*(math.log1p(v) for v in values), math.log1p(n) / 10]


_MATCHERS: dict[str, Matcher] = {}


def matcher_for(name: str, lexicon) -> Matcher:
    """One matcher per worker and lexicon (a broadcast)."""
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matcher(lexicon.value)
    return _MATCHERS[name]


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], weights: list[float], bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def scores(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``key, score`` of every row."""
        out = self.with_features(df.select(key, text), text)
        logit = F.aggregate(
            F.zip_with("features", F.array(*map(F.lit, self.weights)) if self.weights else F.array().cast("array<double>"), lambda x, w: x * w),
            F.lit(float(self.bias)), lambda a, x: a + F.coalesce(x, F.lit(0.0)),
        )
        return out.select(key, (1 / (1 + F.exp(-logit))).alias("score"))

    def with_features(self, df: DataFrame, text: str) -> DataFrame:
        """The rows without their text, with ``features``."""
        spark = df.sparkSession
        # At most MAX_TERMS terms.
        lexicon = spark.sparkContext.broadcast(self.lexicon)
        name = uuid.uuid4().hex  # workers outlive models, so a name is never used again
        kept = [c for c in df.columns if c != text]
        schema = df.select(*kept).schema

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = matcher_for(name, lexicon)
            for batch in slices(batches, text):
                found = pa.array([matcher.features(t) for t in batch.column(text).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "features"])

        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        return df.select(*kept, text).mapInArrow(look, f"{ddl}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> ToxicityModel:
    """Lexicon and model from at most ``rows`` labelled rows, picked by a hash of the key.

    ``labels`` holds only the rows that may be learnt from.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, rows / max(n, 1))
    picked = known.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).limit(rows)
    # The picked labels are at most ``rows``.
    sample = cut(docs.select(key, text).join(F.broadcast(picked), key).select(text, "label"))
    toxic, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < toxic < total:
        rate = min(max(toxic / total if total else 0.0, 1e-9), 1 - 1e-9)
        return ToxicityModel({}, [], math.log(rate / (1 - rate)))
    model = ToxicityModel(learn_lexicon(sample, text, "label"), [], 0.0)
    seen = cut(model.with_features(sample, text)).select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    fitted = LogisticRegression(regParam=0.001, maxIter=60).fit(seen)
    return ToxicityModel(model.lexicon, [float(w) for w in np.asarray(fitted.coefficients)], float(fitted.intercept))
