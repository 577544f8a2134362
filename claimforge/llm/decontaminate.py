"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages of words and benchmark items as passages too. Terms are the
words of the benchmark; their weights come from counts over all passages of the corpus. A randomised SVD
of the TF-IDF matrix (all items and all whole passages of all documents) gives a latent space:
each round multiplies by the matrix and its transpose inside the tasks, and only the sum, terms by
directions, comes back to be orthonormalised. Every passage of every document is then projected, compared
with all passages of all items by cosine, and close pairs are checked on the words themselves: the longest
common subsequence of the whole item and the surrounding text, and the item's answer, or its rarest words
where it has none.

The benchmark is searched in blocks of ``BLOCK_PASSAGES`` passages of items (or one item of more), so what
is broadcast has a bound: their words, and ``RANK`` numbers for each. All documents are read once for every block and
written as numbers of its terms, which the counts, the rounds and the search read. Cosines are
divided by the share of an item's length that the space holds, so that a copy scores what plain TF-IDF
gives it; items of which the space holds too little wait for a later block with a space of its own.

Defined cases: null and empty texts and items hold nothing and match nothing; a null key is kept in a
match; rows of one key are told apart by their text only in the search, so a match names the key; items
without a word are never matched; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import drop_written, slices, written

BLOCK_PASSAGES = 256
RANK, EXTRA, ROUNDS = 128, 16, 2
STRIDE, STRIDES = 16, 3
#: Words from one passage of an item to the next.
ITEM_HOP = STRIDE * STRIDES // 2
#: Words found more often than in this share of strides say nothing about a passage, unless it is made of them.
COMMON_SHARE = 0.03
#: Share of its squared weight that every passage of an item keeps when common words are left out.
KEPT_WEIGHT = 0.5
MIN_COSINE = 0.35
#: An item of which the space holds a smaller share of its length waits for the next block.
CAPTURED = 0.5
#: The items' share of all squared weight in the decomposition, so that the space is the benchmark's first.
ITEM_SHARE = 0.9
#: A pair is a leak by its words alone, or by fewer of them with nearly all of its answer.
LCS_COPY, ANSWER_COPY = 0.6, 0.5
LCS_PARAPHRASE, ANSWER_PARAPHRASE = 0.45, 0.8
#: Rarest words that stand for an answer, for each passage length of distinct words.
ANSWER_WORDS = 6
#: Texts are read so many bytes at a time, and worked on so many words at a time.
SEARCH_BYTES, SEARCH_WORDS = 4_000_000, 500_000
#: Groups added up at a time, so that their sums stay in the processor's cache, and words of a term added up at once.
GROUPS, RUN = 512, 16
#: Partial products for each core of a round, and rows of a product that are added up together.
PARTS_PER_CORE, PRODUCT_ROWS = 3, 64


def word_lists(texts: pa.Array) -> pa.ListArray:
    """Lower-case runs of letters and digits of each text; a null text has none."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    return pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(lower, "[^\\pL\\pN]+", " ")))


def indexed(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term number of every word (-1: not a term), and where each text starts."""
    lists = word_lists(texts)
    flat = lists.flatten()
    index = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return index.astype(np.int64), offsets - offsets[0]


def strides_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stride number of every word, first stride of each text (one more at the end), and text of each stride."""
    sizes = np.diff(starts)
    counts = np.maximum(-(-sizes // STRIDE), 1)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(starts[-1]) - starts[text] if len(text) else np.zeros(0, np.int64)
    return firsts[text] + inside // STRIDE, firsts, np.repeat(np.arange(len(sizes)), counts)


def number_type(n_terms: int) -> np.dtype:
    """Type of the term numbers in a table of words."""
    return np.dtype("<i2" if n_terms < 1 << 15 else "<i4")


def packed(index: np.ndarray, starts: np.ndarray, kind: np.dtype) -> pa.Array:
    """The term numbers of each text as one value."""
    ends = pa.py_buffer((starts * kind.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, ends, pa.py_buffer(index.astype(kind))])


def unpacked(words: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` was given."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) // kind.itemsize
    numbers = np.frombuffer(words.buffers()[2] or b"", kind)[ends[0] : ends[-1]] if len(words) else np.zeros(0, kind)
    return numbers.astype(np.int64), ends - ends[0] if len(words) else np.zeros(1, np.int64)


def numbered(docs: DataFrame, terms: list[str], key: str, text: str) -> tuple[DataFrame, str]:
    """``_key`` and ``_words``, the term numbers of each text (-1: not a term), written once; and where."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(terms), number_type(len(terms))
    source = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value, pa.string())
        for batch in slices(batches, "_text", SEARCH_BYTES):
            words = packed(*indexed(batch.column("_text"), names), kind)
            yield pa.RecordBatch.from_arrays([batch.column("_key"), words], ["_key", "_words"])

    return written(source.mapInArrow(number, f"_key {source.schema['_key'].dataType.simpleString()}, _words binary"), "words")


def stride_counts(rows: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """How often each term stands in the corpus, and how many strides there are."""
    kind = number_type(n_terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(n_terms + 1, np.int64), 0
        for batch in slices(batches, "_words", SEARCH_WORDS * kind.itemsize):
            index, starts = unpacked(batch.column("_words"), kind)
            seen += np.bincount(index[index >= 0], minlength=n_terms + 1)
            total += int(np.maximum(-(-np.diff(starts) // STRIDE), 1).sum())
        seen[-1] = total
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["term", "n"])

    found = rows.select("_words").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    out = np.zeros(n_terms + 1, np.int64)
    for term, n in found:
        out[term] = n
    return out[:-1], int(out[-1])


def group_sums(rows: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of ``vectors[rows]`` over runs of ``sizes`` rows: groups of like size side by side, one row of each at a time."""
    out = np.zeros((len(sizes), vectors.shape[1]), np.float32)
    firsts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
    taken = np.empty((GROUPS, vectors.shape[1]), np.float32)
    for at in range(0, int(np.count_nonzero(sizes)), GROUPS):
        groups = order[at : at + GROUPS]
        first, size = firsts[groups], sizes[groups]
        total = np.zeros((len(groups), vectors.shape[1]), np.float32)
        for r in range(int(size[0])):
            n = int(np.searchsorted(-size, -r))
            np.take(vectors, rows[first[:n] + r], axis=0, out=taken[:n], mode="clip")
            total[:n] += taken[:n]
        out[groups] = total
    return out


def stride_sums(index: np.ndarray, stride: np.ndarray, n_strides: int, vectors: np.ndarray, useful: np.ndarray) -> np.ndarray:
    """Sum of the word vectors in every stride."""
    keep = index >= 0
    keep[keep] = useful[index[keep]]
    return group_sums(index[keep], np.bincount(stride[keep], minlength=n_strides), vectors)


def term_sums(index: np.ndarray, stride: np.ndarray, n_terms: int, vectors: np.ndarray) -> np.ndarray:
    """Sum of the vectors of the strides in which each term stands."""
    order = np.argsort(index.astype(number_type(n_terms)), kind="stable")
    sizes = np.bincount(index, minlength=n_terms)
    runs = -(-sizes // RUN)  # a term's words are added up RUN at a time, and then their sums
    firsts = np.cumsum(runs) - runs
    within = np.full(int(runs.sum()), RUN, np.int64)
    has = runs > 0
    within[(firsts + runs - 1)[has]] = (sizes - (runs - 1) * RUN)[has]
    out = np.zeros((n_terms, vectors.shape[1]))
    if len(within):
        out[has] = np.add.reduceat(group_sums(stride[order], within, vectors), firsts[has], axis=0)
    return out


def passages(sums: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Each stride with the next ones of the same text."""
    out = sums.copy()
    for k in range(1, min(STRIDES, len(sums))):
        out[:-k] += sums[k:]
    # The last strides of a text have met the next text's: they are added up again.
    for k in range(STRIDES - 1):
        rows = firsts[1:] - 1 - k
        rows = rows[rows >= firsts[:-1]]
        out[rows] = reduce(np.add, [sums[rows + j] for j in range(k + 1)])
    return out


def lengths_of(index: np.ndarray, stride: np.ndarray, firsts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF length of each passage, terms outside the latent space included (square root of summed squares)."""
    known = index >= 0
    squares = np.bincount(stride[known], weights=idf[index[known]] ** 2, minlength=int(firsts[-1]))
    return np.sqrt(np.maximum(passages(squares, firsts), 1e-9))


def latent_space(rows: DataFrame, n_terms: int, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """``terms x rank``: right singular directions of the TF-IDF matrix of the rows' passages.

    ``rows`` has the ``_words`` of texts and their ``weight``. Partial products, one ``terms x directions`` matrix for a task,
    are added up a few rows of the matrix together.
    """
    context = rows.sparkSession.sparkContext
    width, kind = min(rank + EXTRA, n_terms), number_type(n_terms)
    rows = rows.select("_words", "weight").coalesce(PARTS_PER_CORE * context.defaultParallelism)
    shared = context.broadcast(idf.astype(np.float32))

    def product(basis: np.ndarray, gram: bool) -> np.ndarray:
        """``A'A basis``, or ``(A basis)'(A basis)``, summed over the tasks."""
        sent = context.broadcast(basis.astype(np.float32))

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, q = shared.value, sent.value
            useful, vectors = weights > 0, q * weights[:, None]
            total = np.zeros((q.shape[1] if gram else n_terms, q.shape[1]))
            for batch in slices(batches, "_words", SEARCH_WORDS * kind.itemsize):
                index, starts = unpacked(batch.column("_words"), kind)
                stride, firsts, owner = strides_of(starts)
                weight = batch.column("weight").to_numpy(zero_copy_only=False)[owner]
                # Only whole passages count, or the one there is: a text's last few words are no passage of their own.
                weight = weight * (np.arange(len(owner)) <= np.maximum(firsts[owner + 1] - STRIDES, firsts[owner]))
                scale = (weight / lengths_of(index, stride, firsts, weights)).astype(np.float32)[:, None]
                scaled = passages(stride_sums(index, stride, len(owner), vectors, useful), firsts)
                scaled *= scale
                if gram:
                    total += scaled.T @ scaled
                    continue
                # A word belongs to the passage that starts at its stride and to those just before.
                scaled *= scale
                back = np.ascontiguousarray(passages(scaled[::-1], len(owner) - firsts[::-1])[::-1])
                known = index >= 0
                total += term_sums(index[known], stride[known], n_terms, back)
            if not gram:
                total *= weights[:, None]
            cuts = range(0, len(total), PRODUCT_ROWS)
            parts = [total[k : k + PRODUCT_ROWS].astype("<f8").tobytes() for k in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.int64()), pa.array(parts, pa.binary())], ["at", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, part in zip(batch.column("at").to_pylist(), batch.column("part"), strict=True):
                    sums[at] = sums.get(at, 0.0) + np.frombuffer(part.as_buffer(), "<f8")
            parts = [x.tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(parts, pa.binary())], ["at", "part"])

        schema = "at bigint, part binary"
        found = rows.mapInArrow(multiply, schema).repartition("at").mapInArrow(add, schema).collect()
        return np.concatenate([np.frombuffer(x["part"], "<f8") for x in sorted(found, key=lambda x: x["at"])]).reshape(-1, basis.shape[1])

    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((n_terms, width)))[0]
    for _ in range(ROUNDS):
        basis = np.linalg.qr(product(basis, False))[0]
    values, turn = np.linalg.eigh(product(basis, True))
    return basis @ turn[:, ::-1][:, : min(rank, width)]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two word sequences, one bit for each word of ``a``."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        hit = where.get(w)
        if hit:
            kept = row & hit
            row = (row + kept | row - kept) & full
    return len(a) - row.bit_count()


def item_passages(words: np.ndarray) -> list[np.ndarray]:
    """An item's words in overlapping passages as long as those of the documents; a short item is one."""
    n = max(0, -(-(len(words) - STRIDE * STRIDES) // ITEM_HOP))
    return [words[k * ITEM_HOP : k * ITEM_HOP + STRIDE * STRIDES] for k in range(n + 1)]


def term_weights(counts: np.ndarray, total: int, parts: list[np.ndarray]) -> np.ndarray:
    """Weight of each term by its count in the corpus; common ones have none, unless an item's passage needs them.

    An item that is copied often makes its own words common. Its rarest words are therefore kept, and weigh
    as much as a word at the limit, until half of the passage's weight is there.
    """
    idf = np.log((total + 1) / (np.minimum(counts, total) + 1))
    common = counts > COMMON_SHARE * total
    least = math.log((total + 1) / (COMMON_SHARE * total + 1))
    full = np.maximum(idf, least if total else 1.0) ** 2
    wanted = np.zeros(len(idf), bool)
    for words in parts:
        weights = idf[words] ** 2
        if weights[~common[words]].sum() > KEPT_WEIGHT * weights.sum():
            continue
        order = words[np.argsort(counts[words], kind="stable")]
        upto = np.cumsum(full[order])
        wanted[order[: int(np.searchsorted(upto, KEPT_WEIGHT * upto[-1])) + 1]] = True
    return np.where(wanted, np.sqrt(full), np.where(common, 0.0, np.maximum(idf, 0.0)))


def held(parts: list[np.ndarray], vectors: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each part's words summed in the latent space, and the share of their TF-IDF length that the space holds."""
    sums = np.stack([vectors[w].sum(axis=0) for w in parts])
    full = np.zeros(len(parts))
    for k, w in enumerate(parts):
        which, n = np.unique(w, return_counts=True)
        full[k] = np.sqrt(((n * idf[which]) ** 2).sum())
    return sums, np.clip(np.linalg.norm(sums, axis=1) / np.maximum(full, 1e-9), 1e-3, 1.0).astype(np.float32)


class Searcher:
    """Items in the latent space, and the checks on words."""

    def __init__(self, terms: list[str], vectors: np.ndarray, idf: np.ndarray, items: list[tuple[int, str, str | None]]):
        names = pa.array(terms, pa.string())
        self.vectors, self.useful, self.idf = vectors.astype(np.float32), idf > 0, idf
        index, starts = indexed(pa.array([t for _, t, _ in items], pa.string()), names)
        answers, answer_starts = indexed(pa.array([a for *_, a in items], pa.string()), names)
        self.ids = [i for i, *_ in items]
        self.words = [index[a:z] for a, z in zip(starts[:-1], starts[1:], strict=True)]
        self.answers = []
        for k, words in enumerate(self.words):
            own = np.unique(answers[answer_starts[k] : answer_starts[k + 1]])
            own = own[own >= 0]
            rare = np.unique(words)
            rare = rare[np.argsort(-idf[rare], kind="stable")][: max(ANSWER_WORDS, ANSWER_WORDS * len(rare) // (STRIDE * STRIDES))]
            self.answers.append(own if len(own) else rare)
        parts = [item_passages(w) for w in self.words]
        self.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        sums, captured = held([x for p in parts for x in p], self.vectors, idf)
        self.parts = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True) * captured[:, None], 1e-6)

    def search(self, index: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, float, float, float, int, int]]:
        """``(text, item, cosine, lcs, answer, first word, last word)`` of every leak; the best place of each pair."""
        stride, firsts, owner = strides_of(starts)
        found = passages(stride_sums(index, stride, len(owner), self.vectors, self.useful), firsts)
        found /= lengths_of(index, stride, firsts, self.idf).astype(np.float32)[:, None]
        cosine = found @ self.parts.T
        at, part = np.nonzero(cosine >= MIN_COSINE)
        item, value = self.owner[part], cosine[at, part]
        order = np.lexsort((at, item, owner[at]))
        # Where the surroundings of close passages meet, they are read once.
        places: list[list] = []
        for s, k, c in zip(at[order].tolist(), item[order].tolist(), value[order].tolist(), strict=True):
            t = int(owner[s])
            first = int(starts[t]) + (s - int(firsts[t])) * STRIDE
            margin = len(self.words[k]) + STRIDE
            a, z = max(int(starts[t]), first - margin), min(int(starts[t + 1]), first + STRIDE * STRIDES + margin)
            if places and places[-1][:2] == [t, k] and a <= places[-1][3]:
                places[-1][3:] = [max(places[-1][3], z), max(places[-1][4], c)]
            else:
                places.append([t, k, a, z, c])
        best: dict[tuple[int, int], tuple] = {}
        for t, k, a, z, c in places:
            words = self.words[k]
            if common_subsequence(words, index[a:z]) < LCS_PARAPHRASE * len(words):
                continue
            # The same over stretches little longer than the item, so that words strewn about do not add up.
            length, hop = len(words) * 5 // 4 + 4, max(1, len(words) // 8)
            for x in range(a, max(a + 1, z - length + hop), hop):
                y = min(z, x + length)
                lcs = common_subsequence(words, index[x:y]) / len(words)
                if lcs < LCS_PARAPHRASE:
                    continue
                answer = float(np.isin(self.answers[k], index[x:y]).mean())
                if (lcs >= LCS_COPY and answer >= ANSWER_COPY) or answer >= ANSWER_PARAPHRASE:
                    row = (lcs, answer, c, x - int(starts[t]), y - int(starts[t]))
                    best[t, k] = max(best.get((t, k), row), row)
        return [(t, self.ids[k], c, lcs, answer, a, z) for (t, k), (lcs, answer, c, a, z) in sorted(best.items())]


_SEARCHERS: dict[str, Searcher] = {}


def searcher_for(name: str, shared) -> Searcher:
    """One searcher per worker and block of items (a broadcast)."""
    if name not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[name] = Searcher(*shared.value)
    return _SEARCHERS[name]


def _search_block(docs: DataFrame, items: list[tuple[int, str, str | None]], name: str, key: str, text: str) -> tuple[DataFrame, list]:
    """The leaks of the items that the block's space holds well, and the other items; at least ``RANK`` passages are searched."""
    spark = docs.sparkSession
    lists = word_lists(pa.array([t for _, t, _ in items] + [a for *_, a in items], pa.string()))
    terms = sorted(set(lists.flatten().to_pylist()) - {""})
    kind = number_type(len(terms))
    words, path = numbered(docs, terms, key, text)
    counts, total = stride_counts(words, len(terms))
    index, starts = indexed(pa.array([t for _, t, _ in items], pa.string()), pa.array(terms, pa.string()))
    parts = [item_passages(index[a:z]) for a, z in zip(starts[:-1], starts[1:], strict=True)]
    idf = term_weights(counts, total, [x for p in parts for x in p])
    weight = math.sqrt(ITEM_SHARE / (1 - ITEM_SHARE) * max(1.0, total / len(items)))
    listed = spark.createDataFrame([(bytearray(x.as_buffer()), weight) for x in packed(index, starts, kind)], "_words binary, weight double")
    vectors = latent_space(words.select("_words", F.lit(1.0).alias("weight")).unionByName(listed), len(terms), idf) * idf[:, None]
    sizes = np.array([len(p) for p in parts])
    shares = held([x for p in parts for x in p], vectors.astype(np.float32), idf)[1]
    captured = np.minimum.reduceat(shares, np.cumsum(sizes) - sizes)
    order = np.argsort(-captured, kind="stable")
    ahead = np.cumsum(sizes[order]) - sizes[order]
    late = {int(k) for k, n in zip(order, ahead, strict=True) if n >= RANK and captured[k] < CAPTURED}
    left, items = [x for k, x in enumerate(items) if k in late], [x for k, x in enumerate(items) if k not in late]
    shared = spark.sparkContext.broadcast((terms, vectors.astype(np.float32), idf, items))
    names = [key, "item_id", "cosine", "lcs", "answer", "first_word", "end_word"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = searcher_for(name, shared)
        for batch in slices(batches, "_words", SEARCH_WORDS * kind.itemsize):
            hits = searcher.search(*unpacked(batch.column("_words"), kind))
            columns = list(zip(*hits, strict=True)) or [()] * 7
            numbers = [pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), *[pa.float64()] * 3, *[pa.int64()] * 2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(columns[0], pa.int64())), *numbers], names)

    found = written(words.mapInArrow(search, leak_schema(docs, key)), "leaks")[0]
    drop_written(spark, path)
    return found, left


def leak_schema(docs: DataFrame, key: str) -> str:
    kind = docs.schema[key].dataType.simpleString()
    return f"`{key}` {kind}, item_id bigint, cosine double, lcs double, answer double, first_word bigint, end_word bigint"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None
) -> DataFrame:
    """``key, item_id, cosine, lcs, answer, first_word, end_word``: a row for every document and item it leaks."""
    answers = F.col(answer) if answer else F.lit(None)
    listed = benchmark.select(F.col(item).cast("bigint").alias("i"), F.col(item_text).alias("t"), answers.cast("string").alias("a"))
    listed = cut(listed.where(F.col("t").rlike("[\\p{L}\\p{N}]")).repartitionByRange(F.col("i"), F.col("t")).sortWithinPartitions("i", "t"))
    name = uuid.uuid4().hex  # workers outlive a search, so a name is never used again
    rows, out, waiting, n = ((r["i"], r["t"], r["a"]) for r in listed.toLocalIterator()), None, [], 0
    while True:
        # Items left over come first; the row that would make the block too large waits with them.
        block, size, over, earlier = [], 0, [], iter(waiting)
        for row in chain(earlier, rows):
            n_passages = len(item_passages(word_lists(pa.array([row[1]], pa.string())).flatten()))
            if block and size + n_passages > BLOCK_PASSAGES:
                over.append(row)
                break
            block.append(row)
            size += n_passages
        if not block:
            break
        found, left = _search_block(docs, block, f"{name}-{n}", key, text)
        waiting = [*left, *over, *earlier]
        out, n = found if out is None else out.unionByName(found), n + 1
    if out is None:
        return docs.sparkSession.createDataFrame([], leak_schema(docs, key))
    return out
