"""Text vectorisation in long form: rows of ``(key, term, value)``.

The long form never widens with the vocabulary. Texts are dealt by key before they are taken
apart, so terms are counted and rows scaled where they are made; only sums by term move.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lookups import bounded, dealt, split_join
from ..plans.packed import PIECES, few, packed, pieces, stored, summed, unpacked
from .cleaning import require

#: Buckets up to so many have their weights sent to every task; texts are counted about so many terms at a time.
DENSE_BUCKETS, COUNTED_TERMS = 2**21, 1_000_000


def word_terms(col: str, ngram: tuple[int, int] = (1, 1)) -> Column:
    return X.ngrams(X.vector_terms(col), *ngram)


def char_terms(col: str, ngram: tuple[int, int] = (3, 5), word_boundary: bool = True) -> Column:
    return X.char_ngrams(col, *ngram, word_boundary)


def term_counts(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """``(key, term, tf)``."""
    require(df, key)
    return dealt(df, key).select(key, F.explode(terms).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def count_ngrams(df: DataFrame, key: str, col: str, ngram: tuple[int, int] = (1, 2)) -> DataFrame:
    return term_counts(df, key, word_terms(col, ngram))


def binary_bow(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(word_terms(col))).alias("term")).withColumn("value", F.lit(1))


def vocabulary(
    df: DataFrame, key: str, terms: Column, min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None
) -> DataFrame:
    """``(term, df, cf, idf)``; whole numbers bound documents, fractions their share.

    ``max_features`` keeps the terms with the highest corpus count, ties by term.
    """
    return _vocabulary(term_counts(df, key, terms), df, min_df, max_df, max_features)


def _vocabulary(tf: DataFrame, df: DataFrame, min_df, max_df, max_features) -> DataFrame:
    rows = df.agg(F.count(F.lit(1))).scalar()
    low = F.lit(min_df) if isinstance(min_df, int) else rows * float(min_df)
    high = F.lit(max_df) if isinstance(max_df, int) else rows * float(max_df)
    terms = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    kept = terms.where((F.col("df") >= low) & (F.col("df") <= high))
    if max_features is not None:
        kept = kept.orderBy(F.desc("cf"), "term").limit(max_features)
    kept = kept.withColumn("idf", F.log((1 + rows) / (1 + F.col("df"))) + 1)
    return kept if max_features is None else bounded(kept, max_features)


def weigh(tf: DataFrame, key: str, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """``tf * idf`` with rows scaled to length one; terms outside the vocabulary go.

    A vocabulary too large to broadcast is met in two parts, so that terms of nearly every text fill no task.
    Row norms use a window over one text's distinct terms, which its own row bounds.
    """
    local = (F.log("tf") + 1) if sublinear else F.col("tf").cast("double")
    raw = split_join(tf, vocab.select("term", "idf", "df"), "term", "df", lambda cold: dealt(cold, key)).select(key, "term", (local * F.col("idf")).alias("_w"))
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("_w") / norm).alias("value"))


def tfidf(
    df: DataFrame, key: str, terms: Column, min_df: int | float = 1, max_df: int | float = 1.0,
    max_features: int | None = None, sublinear: bool = False,
) -> DataFrame:
    """Smoothed TF-IDF ``ln((1+n)/(1+df))+1`` with L2-normalised rows."""
    tf = term_counts(df, key, terms)
    return weigh(tf, key, _vocabulary(tf, df, min_df, max_df, max_features), sublinear)


def transform_with_vocabulary(df: DataFrame, key: str, terms: Column, vocab: DataFrame, sublinear: bool = False) -> DataFrame:
    """Apply a fitted vocabulary to other rows."""
    return weigh(term_counts(df, key, terms), key, vocab, sublinear)


def hashing_tfidf(df: DataFrame, terms: Column, n_features: int = 2**18, out: str = "features") -> DataFrame:
    """Hashed counts reweighted by IDF, as one sparse vector per row."""
    counted = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=n_features).transform(df.withColumn("_terms", terms))
    return IDF(inputCol="_tf", outputCol=out).fit(counted).transform(counted).drop("_terms", "_tf")


def hashed_counts(df: DataFrame, key: str, terms: Column, n_features: int = 2**20) -> DataFrame:
    """``(key, term, tf)`` where a term is its bucket: the first eight digits of its md5, modulo ``n_features``.

    Every engine with md5 finds the same buckets; there is no vocabulary to fit or keep.
    """
    if not 0 < n_features <= 2**32:
        raise ValueError("n_features must be between 1 and 2**32")
    bucket = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("bigint") % n_features
    found = dealt(df, key).select(key, F.explode(terms).alias("term")).select(key, bucket.alias("term"))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def bucket_numbers(terms: pa.Array, n_features: int) -> np.ndarray:
    """The buckets of ``hashed_counts``, worked out once for each distinct term."""
    coded, empty = terms.dictionary_encode(), md5()

    def digest(term: bytes) -> bytes:
        filled = empty.copy()  # a copy costs less than a new one
        filled.update(term)
        return filled.digest()[:4]

    digests = b"".join(map(digest, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)))
    return (np.frombuffer(digests, ">u4").astype(np.int64) % n_features)[coded.indices.to_numpy(zero_copy_only=False)]


def packed_counts(df: DataFrame, key: str, terms: Column, n_features: int) -> DataFrame:
    """``_key, _rows, _gaps, _tf``: a row for each key with its number of texts, buckets in order (as gaps) and their counts; written once."""
    texts = dealt(df, key)
    # Texts of one key come one after the other; the first of them is marked.
    texts = texts.withColumn("_first", F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1)
    texts = texts.select(F.col(key).alias("_key"), "_first", terms.alias("_terms"))

    def rows(keys: pa.Array, texts: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        starts = np.searchsorted(cells, np.arange(len(keys) + 1) * n_features)
        gaps = np.diff(cells, prepend=0)
        inner = starts[:-1][starts[:-1] < starts[1:]]
        gaps[inner] = cells[inner] % n_features
        return pa.RecordBatch.from_arrays([keys, pa.array(texts), packed(gaps.astype("<u4"), starts), packed(counts.astype("<u4"), starts)], ["_key", "_rows", "_gaps", "_tf"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # the last key, which may go on
        for batch in (part for whole in batches for part in term_slices(whole)):
            lists = batch.column("_terms")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat, text = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
            if flat.null_count:
                there = pc.is_valid(flat)
                flat, text = flat.filter(there), text[there.to_numpy(zero_copy_only=False)]
            first = batch.column("_first").to_numpy(zero_copy_only=False).astype(bool)
            group = np.cumsum(first) - first[0]
            keys = batch.column("_key").take(pa.array(np.flatnonzero(np.diff(group, prepend=-1))))
            texts, cells = np.bincount(group), group[text] * n_features + bucket_numbers(flat, n_features)
            if left is not None and not first[0]:
                _, more, before, counts = left
                texts[0] += more
                every = np.concatenate([before, cells])
                cells, at = np.unique(every, return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate([counts, np.ones(len(every) - len(before))]), minlength=len(cells)).astype(np.int64)
            else:
                if left is not None:
                    yield rows(left[0], np.array([left[1]]), *left[2:])
                cells, counts = np.unique(cells, return_counts=True)
            last = len(keys) - 1
            at = int(np.searchsorted(cells, last * n_features))
            if last:
                yield rows(keys[:last], texts[:last], cells[:at], counts[:at])
            left = keys[last:], int(texts[last]), cells[at:] - last * n_features, counts[at:]
        if left is not None:
            yield rows(left[0], np.array([left[1]]), *left[2:])

    return stored(texts.mapInArrow(count, f"_key {df.schema[key].dataType.simpleString()}, _rows bigint, _gaps binary, _tf binary"), "counts")[0]


def term_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows, about ``COUNTED_TERMS`` terms at a time, or one row of more."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("_terms")), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // COUNTED_TERMS
    at = 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(group, group[at], "right")))
        yield batch.slice(at, end - at)
        at = end


def bucket_lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every entry of the rows of ``packed_counts``, and where each row starts."""
    gaps, starts = unpacked(batch.column("_gaps"), "<u4")
    upto = np.concatenate([[0], np.cumsum(gaps, dtype=np.int64)])
    return upto[1:] - np.repeat(upto[starts[:-1]], np.diff(starts)), starts


def hashed_weights(df: DataFrame, key: str, terms: Column, n_features: int = 2**20) -> DataFrame:
    """Hashed counts with smoothed idf and rows of unit length, in long form.

    Up to ``DENSE_BUCKETS`` buckets, texts are taken apart once and kept as packed counts, a row for each key.
    """
    require(df, key)
    if not 0 < n_features <= DENSE_BUCKETS:
        tf = hashed_counts(df, key, terms, n_features)
        return weigh(tf, key, _vocabulary(tf, df, 1, 1.0, None))
    kept = packed_counts(df, key, terms, n_features)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_features + 1, np.int64)
        for batch in batches:
            seen += np.bincount(bucket_lists(batch)[0], minlength=n_features + 1)
            seen[-1] += pc.sum(batch.column("_rows")).as_py() or 0
        yield pieces(seen, "<i8")

    seen = summed(few(kept).mapInArrow(count, PIECES), n_features + 1, "<i8")
    shared = df.sparkSession.sparkContext.broadcast(np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1)

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in entry_slices(whole)):
            buckets, starts = bucket_lists(batch)
            value = unpacked(batch.column("_tf"), "<u4")[0] * shared.value[buckets]
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            value /= np.sqrt(np.bincount(row, weights=value * value, minlength=batch.num_rows))[row]
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(row)), pa.array(buckets), pa.array(value)], [key, "term", "value"])

    return kept.mapInArrow(scale, f"`{key}` {df.schema[key].dataType.simpleString()}, term bigint, value double")


def entry_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows of ``packed_counts``, about ``COUNTED_TERMS`` entries at a time, or one row of more."""
    group = np.cumsum(pc.binary_length(batch.column("_tf")).to_numpy(zero_copy_only=False)) // (4 * COUNTED_TERMS)
    at = 0
    while at < len(group):
        end = max(at + 1, int(np.searchsorted(group, group[at], "right")))
        yield batch.slice(at, end - at)
        at = end


def assemble_blocks(blocks: dict[str, DataFrame], key: str) -> DataFrame:
    """Long blocks side by side: terms carry their block's name."""
    out: DataFrame | None = None
    for name, block in blocks.items():
        named = block.select(key, F.concat(F.lit(f"{name}:"), F.col("term")).alias("term"), F.col("value").cast("double"))
        out = named if out is None else out.unionByName(named)
    if out is None:
        raise ValueError("no blocks given")
    return out


def assemble_columns(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Numeric and vector columns into one vector column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def tfidf_vectors(train: DataFrame, test: DataFrame, terms: Column, max_features: int, min_df: float = 1.0, out: str = "features"):
    """The same weights as sparse vector columns, for models; returns (train, test, vocabulary list)."""
    tr, te = train.withColumn("_terms", terms), test.withColumn("_terms", terms)
    counter = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_features, minDF=min_df).fit(tr)
    idf = IDF(inputCol="_tf").fit(counter.transform(tr)).idf
    # The library's weight is ln((n+1)/(df+1)); the expected one adds 1.
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol="_tf", outputCol="_w")
    unit = Normalizer(inputCol="_w", outputCol=out)
    parts = [unit.transform(scaled.transform(counter.transform(d))).drop("_terms", "_tf", "_w") for d in (tr, te)]
    return parts[0], parts[1], counter.vocabulary


def truncated_svd(rows: DataFrame, features: str, ks: Sequence[int]) -> DataFrame:
    """Explained variance share of an uncentred SVD for several ranks."""
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    spark = rows.sparkSession
    # The solver passes over the rows once per iteration.
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(features), features).persist()
    matrix = RowMatrix(vectors)
    summary = matrix.computeColumnSummaryStatistics()
    n = matrix.numRows()
    svd = matrix.computeSVD(max(ks), computeU=False)
    # Projection i has second moment s_i^2/n and mean (column means . v_i); left vectors are not needed.
    means = svd.V.toArray().T @ summary.mean()
    variances = svd.s.toArray() ** 2 / n - means**2
    total = float(summary.variance().sum() * (n - 1) / n)
    vectors.unpersist()
    rows_out = [(int(k), float(variances[:k].sum() / total)) for k in ks]
    return spark.createDataFrame(rows_out, "k int, explained double")


def hash_encoder(dim: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Stand-in encoder: signed hashed bag of words, length one."""

    def load():
        import zlib

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for r, t in enumerate(texts):
                for w in t.split():
                    h = zlib.crc32(w.encode("utf-8"))
                    out[r, h % dim] += 1.0 if (h >> 16) & 1 else -1.0
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.maximum(norms, 1e-12)

        return encode

    return load


def embed_text(df: DataFrame, col: str, load_encoder: Callable | None = None, out: str = "embedding") -> DataFrame:
    """Text to dense vectors in Arrow batches; the encoder loads once per worker task."""
    require(df, col)
    loader = load_encoder or hash_encoder()

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for s in batches:
            yield pd.Series(list(model(s.tolist())), dtype=object)

    return df.withColumn(out, encode(X.text(col)))


def embeddings_join(df: DataFrame, key: str, vectors: DataFrame, vector_key: str, vector_col: str) -> DataFrame:
    """Attach vectors computed elsewhere."""
    table = vectors.select(F.col(vector_key).alias(key), vector_col)
    return df.join(table, key, "left")


def select_k_best_chi2(features: DataFrame, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Top ``k`` terms by chi-square of their class sums against label-share expectation."""
    joined = features.join(labels.select(key, label), key)
    observed = joined.groupBy("term", label).agg(F.sum("value").alias("o"))
    n = labels.agg(F.count(F.lit(1)).cast("double")).scalar()
    shares = labels.groupBy(label).agg((F.count(F.lit(1)) / n).alias("p"))
    classes = shares.agg(F.collect_list(F.struct(F.col(label).alias("_y"), "p"))).scalar()
    # Every (term, class) pair counts, also those never observed.
    expected = observed.groupBy("term").agg(F.sum("o").alias("total")).where(F.col("total") > 0)
    expected = expected.select("term", "total", F.inline(classes)).withColumnRenamed("_y", label)
    pairs = expected.join(observed, ["term", label], "left")
    e = F.col("p") * F.col("total")
    gap = F.coalesce("o", F.lit(0.0)) - e
    return pairs.groupBy("term").agg(F.sum(gap * gap / e).alias("chi2")).orderBy(F.desc("chi2"), "term").limit(k)
