"""Removal of passages that stand earlier in the corpus, by level-wise doubling.

Windows are counted at a short length first, and only those repeated there are extended to twice the
length, and so on to the wanted one, or until no candidate survives:

1. At the seed length one window in every stretch is enough: each wanted window keeps the smallest hash of
   the seed windows in it (its anchor), so equal windows keep equal anchors. About a sixth of the windows
   is counted. An anchor seen once cannot lie in a repeated window.
2. Windows of twice the length whose own anchor survived (later: that contain a survivor) are counted, by 96
   bits of hash.
3. At the wanted length a window is marked unless it is its first occurrence; marked windows are cut out.

Counts combine before the shuffle. Occurrences return to them in two parts: hashes with more than
one in ``HOT`` of the repeated rows, fewer than ``HOT`` by arithmetic, are broadcast, so their occurrences stay
where they are; only rows of the others are shuffled. A passage shared by a third of the corpus is no hot task. Texts move twice.

Defined cases: null and empty texts have no words; the order is key (null first), then a hash of the text
for rows of one key, then place; rows equal in key and text are one document recorded twice and get the
same result; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import sorted_index
from ..session import cut
from .common import drop_written, list_column, mixed, row_keys, shuffles_dropped, slices, split_words, word_hashes, written

WINDOW, SEED = 20, 10
#: A window's place in the corpus is one number: its document's place in key order, then its first word.
PLACE_BITS = 28
#: A hash with more than one in ``HOT`` of the repeated rows is broadcast; there are fewer than ``HOT`` such hashes.
HOT = 10_000
BASE = np.uint64(0x9E3779B97F4A7C15)
KEYS = ("first-hash-key-0", "second-hash-key1")


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Hash of two adjoining windows, the right one ``width`` words long."""
    with np.errstate(over="ignore"):
        return left * np.uint64(pow(int(BASE), width, 1 << 64)) + right


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window at every word; the last ``length - 1`` are meaningless."""
    if length == 1:
        return words
    half = window_hashes(words, length // 2)
    right = np.concatenate([half[length // 2 :], np.zeros(min(len(half), length // 2), np.uint64)])
    two = _joined(half, right, length // 2)
    if length % 2 == 0:
        return two
    last = np.concatenate([words[length - 1 :], np.zeros(min(len(words), length - 1), np.uint64)])
    return _joined(two, last, 1)


def _sliding(values: np.ndarray, width: int, pick, back: bool = False) -> np.ndarray:
    """``pick`` over ``width`` values from (or, ``back``, up to) each place; beyond the ends nothing is picked."""
    out, done = values, 1

    def shifted(x: np.ndarray, by: int) -> np.ndarray:
        by = min(by, len(x))
        edge = np.full(by, np.uint64(0) if pick is np.maximum else np.uint64(2**64 - 1))
        return np.concatenate([edge, x[: len(x) - by]]) if back else np.concatenate([x[by:], edge])

    while done < width:
        step = min(done, width - done)
        out = pick(out, shifted(out, step))
        done += step
    return out


def _places(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every word in its text, and words from it to the text's end."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    every = np.arange(starts[-1])
    return every - starts[text], starts[text + 1] - every


def anchors(texts: pa.Array, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places of the anchors, and where each text's anchors end (0 first)."""
    words, starts = split_words(texts)
    place, left = _places(starts)
    hashes = mixed(window_hashes(word_hashes(words), seed))
    width = window - seed + 1
    least = _sliding(hashes, width, np.minimum)
    least[left < window] = 0  # no window starts here
    is_anchor = _sliding(least, width, np.maximum, back=True) == hashes
    # A window reaching back into the text before cannot count: its start has too few words left.
    upto = np.concatenate([[0], np.cumsum(is_anchor)])
    return hashes[is_anchor], place[is_anchor], upto[starts]


def find_anchors(keyed: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``_id, _row, doc, anchors``: hash and place of each anchor; ``doc`` numbers the rows of one written result."""
    kind = keyed.schema["_id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "_text"):
            hashes, places, ends = anchors(batch.column("_text"), window, seed)
            pairs = pa.StructArray.from_arrays([pa.array(hashes.view(np.int64)), pa.array(places.astype(np.int32))], ["h", "p"])
            number = pa.array(first + np.arange(batch.num_rows))
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), number, list_column(pairs, ends)], ["_id", "_row", "doc", "anchors"])

    return keyed.mapInArrow(find, f"_id {kind}, _row bigint, doc bigint, anchors array<struct<h:bigint,p:int>>")


def repeated_rows(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are in ``counts`` (with their number ``n``), and its other columns.

    Keys with more than one in ``HOT`` of these rows are broadcast; only rows of other keys are shuffled.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT > total
    hot, rest = F.broadcast(counts.where(is_hot)), counts.where(~is_hot)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys)).drop("n")


def candidates(words: np.ndarray, alive: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Which windows of ``length`` may be repeated, by the survivors of half the length in them.

    With ``seed`` (half the length) survivors are anchors, and a window's own one, its least seed hash, must be
    among them; 0 takes any survivor.
    """
    half = length // 2
    inside = _sliding(alive.astype(np.uint64), half + 1, np.maximum) == 1
    if not seed:
        return inside
    hashes = mixed(window_hashes(words, seed))
    kept = np.where(alive, hashes, np.uint64(2**64 - 1))
    return inside & (_sliding(kept, half + 1, np.minimum) == _sliding(hashes, half + 1, np.minimum))


def extended(keyed: DataFrame, survivors: DataFrame, length: int, seed: int = 0) -> DataFrame:
    """``at, h1, h2``: place and hashes of the windows of ``length`` that may be repeated by their survivors.

    ``survivors`` has ``_id, _row, _index, places``; ``seed`` is given where they are anchors.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words, starts = split_words(batch.column("_text"))
            place, left = _places(starts)
            if len(place) and place.max() >> PLACE_BITS:
                raise ValueError("a document has more words than a place can count")
            lists = batch.column("places")
            text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            alive = np.zeros(len(words), bool)
            alive[starts[text] + lists.flatten().to_numpy(zero_copy_only=False)] = True
            each = word_hashes(words, KEYS[0])
            at = np.flatnonzero(candidates(each, alive, length, seed) & (left >= length))
            row = np.searchsorted(starts, at, "right") - 1
            first, second = (mixed(window_hashes(w, length))[at] for w in (each, word_hashes(words, KEYS[1])))
            order = batch.column("_index").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array((order << PLACE_BITS) + place[at]), pa.array(first.view(np.int64)), pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32))], ["at", "h1", "h2"]
            )

    right = survivors.withColumnsRenamed({"_id": "_right_id", "_row": "_right_row"})
    joined = keyed.join(right, F.col("_id").eqNullSafe(F.col("_right_id")) & (F.col("_row") == F.col("_right_row")))
    return joined.select("_index", "_text", "places").mapInArrow(extend, "at bigint, h1 bigint, h2 int")


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``_id, _row, places``: starts of the windows of ``window`` words that also start earlier in the corpus.

    ``window`` is ``seed`` doubled once or more.
    """
    if window < 2 * seed or window % seed or (window // seed) & (window // seed - 1):
        raise ValueError("the window must be the seed doubled")
    spark, keyed = docs.sparkSession, row_keys(docs, key, text)
    order = sorted_index(keyed.select("_id", "_row").distinct(), [F.col("_id").asc_nulls_first(), F.col("_row")])
    with shuffles_dropped(spark):
        found, path = written(find_anchors(keyed, window, seed), "anchors")
        rows = found.select("doc", F.inline("anchors"))
        twice = cut(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        by_doc = repeated_rows(rows, twice, ["h"]).groupBy("doc").agg(F.collect_set("p").alias("places"))
        # A document recorded twice has two numbers and the same places.
        by_row = by_doc.join(found.select("_id", "_row", "doc"), "doc").dropDuplicates(["_id", "_row"])
        names = order.select(F.col("_id").alias("_order_id"), F.col("_row").alias("_order_row"), "_index")
        same = F.col("_id").eqNullSafe(F.col("_order_id")) & (F.col("_row") == F.col("_order_row"))
        survivors = cut(by_row.join(names, same).select("_id", "_row", "_index", "places"))
        drop_written(spark, path)
        length = 2 * seed
        while True:
            windows, path = written(extended(keyed, survivors, length, seed if length == 2 * seed else 0), "windows")
            first = cut(windows.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
            again = repeated_rows(windows, first, ["h1", "h2"])
            last = length == window
            again = again.where("at != first") if last else again
            places = again.select(F.shiftright("at", PLACE_BITS).alias("_index"), F.col("at").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("p"))
            survivors = cut(places.groupBy("_index").agg(F.collect_set("p").alias("places")).join(order, "_index").select("_id", "_row", "_index", "places"))
            drop_written(spark, path)
            if last or not survivors.limit(1).count():
                return survivors
            length *= 2


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``key, n_words, n_removed, kept_text`` of every row: its words outside repeated windows, joined by blanks."""
    places = repeated_windows(docs, key, text, window, seed).drop("_index").withColumnsRenamed({"_id": "_right_id", "_row": "_right_row"})
    keyed = row_keys(docs, key, text)
    kind = keyed.schema["_id"].dataType.simpleString()
    joined = keyed.join(places, F.col("_id").eqNullSafe(F.col("_right_id")) & (F.col("_row") == F.col("_right_row")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in slices(batches, "_text"):
            words, starts = split_words(batch.column("_text"))
            lists = batch.column("places")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = np.repeat(starts[:-1], sizes) + lists.flatten().to_numpy(zero_copy_only=False)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            keep = np.cumsum(cover[:-1]) == 0
            upto = np.concatenate([[0], np.cumsum(keep)])[starts]
            kept = pc.binary_join(list_column(words.filter(pa.array(keep)), upto), " ")
            n = np.diff(starts)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n), pa.array(n - np.diff(upto)), kept], [key, "n_words", "n_removed", "kept_text"])

    return joined.select("_id", "_text", "places").mapInArrow(remove, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_text string")
