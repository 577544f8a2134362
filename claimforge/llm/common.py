"""Small helpers the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, scratch_path, shuffles_dropped

__all__ = ["drop_written", "shuffles_dropped"]

#: Word separators of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"
BATCH_BYTES = 12_000_000


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only key and text, as ``_id`` and ``_text``, with ``_row``, a hash of both.

    (``_id``, ``_row``) tells rows of one id apart; rows equal in both are one document recorded twice
    and get the same result. A null id is a value of its own.
    """
    picked = df.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    return picked.withColumn("_row", F.xxhash64("_id", F.coalesce("_text", F.lit("\x00"))))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, or one row if that is longer."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes) // limit
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(group, group[first], "right")))
            yield batch.slice(first, end - first)
            first = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of ``WORD`` of all texts, and where each text starts among them; nulls have none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), upto[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]


def word_hashes(words: pa.Array, key: str = "first-hash-key-0") -> np.ndarray:
    """A 64-bit hash of each word, worked out once for each distinct word."""
    from pandas.util import hash_array

    coded = words.dictionary_encode()
    if not len(words):
        return np.zeros(0, np.uint64)
    each = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), hash_key=key, categorize=False)
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a fixed finaliser of multiplications and shifts)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def list_column(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    """Lists cut out of ``values`` at ``ends`` (0 first)."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table written to the shared folder, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path
