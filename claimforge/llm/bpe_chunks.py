"""Byte-pair ids of whole texts, and back, with content-defined chunks that documents share.

A rolling hash over the bytes of a text cuts it into chunks, at the same places wherever the same passage
stands. What lies between a chunk's first and last white space, its core, is encoded once: cores that save
most, counted over all documents, ahead of the job (one bounded table, broadcast), the others once per worker
while its bounded table holds them. The rest of a text are the joins between cores. Each is re-encoded by the
library together with words of the cores at both sides, and its ids are taken once those words come out exactly
as they stand in the cores' ids; until then the join takes in twice as many words, at last the whole text.

Defined cases: a null text counts as empty (no ids, empty decoded text); null keys and repeated rows are kept,
one result a row; an empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_column, slices
from .tokens import word_encoder

#: Bytes the rolling hash sees, its factor, and the bits that must be zero at a cut (chunks of 1 KB on average).
WINDOW, FACTOR, CUT_BITS = 32, 0x9E3779B97F4A7C15, 10
LEAST_CHUNK, LONGEST_CHUNK = 256, 4096
#: The table of cores encoded ahead: at most so many, of LONGEST_CHUNK bytes at most. It decides cost, never results.
SHARED_CORES = 4096
#: Ids a worker keeps for cores seen again; beyond it the table starts anew.
WORKER_IDS = 4_000_000
#: Bytes of text cut and coded at once; at its peak a byte costs some 50 of a worker's memory. It decides cost, never results.
PART_BYTES = 3_000_000
#: Words of each core a join is first checked against, and beyond which its whole text is encoded.
FIRST_WORDS, MOST_WORDS = 1, 64

_BYTE_VALUES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the polynomial hash of the ``WINDOW`` bytes that end there, by doubling spans."""
    h, span = _BYTE_VALUES[data], 1
    while span < WINDOW:
        h[span:] += h[:-span] * np.uint64(pow(FACTOR, span, 1 << 64))
        span *= 2
    return h


def chunk_ends(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the chunks of all texts end; ``starts`` are the texts' first bytes, with the data's end last."""
    found = np.flatnonzero(rolling_hash(data) >> np.uint64(64 - CUT_BITS) == 0) + 1
    text = np.searchsorted(starts, found, "right") - 1
    inside = found - starts[text] >= WINDOW
    cuts, last = [], 0
    for at, first in zip(found[inside].tolist(), starts[text[inside]].tolist(), strict=True):
        if at - max(last, first) >= LEAST_CHUNK:
            cuts.append(at)
            last = at
    ends = np.union1d(starts, np.array(cuts, np.int64))
    wide = np.flatnonzero(np.diff(ends) > LONGEST_CHUNK)
    more = [np.arange(ends[i] + LONGEST_CHUNK, ends[i + 1], LONGEST_CHUNK) for i in wide]
    return np.union1d(ends, np.concatenate(more)) if more else ends


@dataclass
class Cut:
    """A batch cut into pieces: every text is join, core, join, ... , join (joins may be empty)."""

    data: np.ndarray
    starts: np.ndarray
    white: np.ndarray  # places of white space
    core_first: np.ndarray  # first and end byte of each core
    core_end: np.ndarray
    first_white: np.ndarray  # index in ``white`` of the white space just before and just after each core
    last_white: np.ndarray
    text: np.ndarray  # text of each core

    def strings(self, first: np.ndarray, end: np.ndarray) -> pa.Array:
        """The byte ranges as strings; they start and end at white space or a text's bounds, so are whole characters."""
        offsets = np.concatenate([[0], np.cumsum(end - first)])
        taken = np.repeat(first - offsets[:-1], end - first) + np.arange(offsets[-1])
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[taken]))


def cut_texts(texts: pa.Array) -> Cut:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    starts = offsets - offsets[0]
    ends = chunk_ends(data, starts)
    white = np.flatnonzero(_WHITE[data])
    before, after = np.searchsorted(white, ends[:-1]), np.searchsorted(white, ends[1:]) - 1
    whole = np.flatnonzero(after > before)
    # Two white spaces in a row leave an empty core, which is part of a join.
    whole = whole[white[after[whole]] > white[before[whole]] + 1] if len(white) else whole
    before, after = before[whole], after[whole]
    first, end = (white[before] + 1, white[after]) if len(white) else (before, after)
    return Cut(data, starts, white, first, end, before, after, np.searchsorted(starts, first, "right") - 1)


class ChunkCoder:
    """``encode(texts)`` as the library does it for one vocabulary file; ``shared`` are cores encoded ahead."""

    def __init__(self, path: str, shared: dict[str, np.ndarray]):
        self.words = word_encoder(path)
        self.library = self.words.library
        self.shared = shared
        self.known: dict[str, np.ndarray] = {}
        self.kept = 0

    def cores(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of distinct cores; those of earlier batches or of the shared table are not encoded again."""
        new = [t for t in texts if t not in self.shared and t not in self.known]
        if self.kept > WORKER_IDS:
            new, self.known, self.kept = [t for t in texts if t not in self.shared], {}, 0
        ids, ends = self.words.encode(pa.array(new, pa.string()))
        for t, first, end in zip(new, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            self.known[t] = ids[first:end].copy()
        self.kept += len(ids)
        return [self.shared[t] if t in self.shared else self.known[t] for t in texts]

    def joins(self, cut: Cut, of_core: np.ndarray, cores: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of every join in order of the texts, and the texts in which some join never came to agree."""
        n_texts, n_cores = len(cut.starts) - 1, len(cut.core_first)
        text = np.concatenate([np.arange(n_texts), cut.text])
        place = np.concatenate([cut.starts[:-1], cut.core_end])
        order = np.lexsort((place, text))
        left = np.concatenate([np.full(n_texts, -1), np.arange(n_cores)])[order]  # core before the join, or -1
        text = text[order]
        right = np.append(left[1:], -1)  # core after it: the one before the text's next join
        first = np.concatenate([cut.starts[:-1], cut.core_end])[order]
        end = np.where(right >= 0, cut.core_first[right] if n_cores else 0, cut.starts[text + 1])
        found: list[np.ndarray | None] = [None] * len(text)
        open_, words = np.arange(len(text)), FIRST_WORDS
        while len(open_) and words <= MOST_WORDS:
            l, r = left[open_], right[open_]
            at, to = first[open_].copy(), end[open_].copy()
            has = l >= 0
            back = np.maximum(cut.last_white[l[has]] - words, cut.first_white[l[has]])
            at[has] = cut.white[back] + 1
            has = r >= 0
            ahead = np.minimum(cut.first_white[r[has]] + words, cut.last_white[r[has]])
            to[has] = cut.white[ahead]
            windows = cut.strings(at, to).dictionary_encode()
            # Characters before the join and up to its end: bytes that start one.
            upto = np.concatenate([[0], np.cumsum((cut.data & 0xC0) != 0x80)])
            n_left = (upto[first[open_]] - upto[at]).tolist()
            n_mid = (upto[end[open_]] - upto[at]).tolist()
            coded = self.library.encode_batch(windows.dictionary.to_pylist(), add_special_tokens=False)
            coded = [(np.array(e.ids, "<u4"), np.array(e.offsets, np.int64).reshape(-1, 2)) for e in coded]
            still = []
            for k, w, a, b in zip(open_.tolist(), windows.indices.to_pylist(), n_left, n_mid, strict=True):
                ids, spans = coded[w]
                n_before, n_after = int((spans[:, 1] <= a).sum()), int((spans[:, 0] >= b).sum())
                mid = slice(n_before, len(ids) - n_after)
                before = cores[of_core[left[k]]] if left[k] >= 0 else ids[:0]
                after = cores[of_core[right[k]]] if right[k] >= 0 else ids[:0]
                same = np.array_equal(ids[:n_before], before[len(before) - n_before :]) and np.array_equal(ids[mid.stop :], after[:n_after])
                if same and n_before <= len(before) and (spans[mid, 0] >= a).all() and (spans[mid, 1] <= b).all():
                    found[k] = ids[mid]
                else:
                    still.append(k)
            open_, words = np.array(still, np.int64), 2 * words
        empty = np.zeros(0, "<u4")
        return [empty if f is None else f for f in found], np.unique(text[open_])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts in it (one entry more than texts)."""
        cut = cut_texts(texts)
        coded = cut.strings(cut.core_first, cut.core_end).dictionary_encode()
        of_core = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        cores = self.cores(coded.dictionary.to_pylist())
        joins, whole = self.joins(cut, of_core, cores)
        n_texts = len(texts)
        # Joins and cores take turns in a text: its cores so far say where its next join stands.
        ends = np.zeros(n_texts + 1, np.int64)
        parts, sizes, at_join, at_core = [], np.zeros(n_texts, np.int64), 0, 0
        n_in = np.bincount(cut.text, minlength=n_texts).tolist()
        encoded = dict(zip(whole.tolist(), self.library.encode_batch([texts[i].as_py() for i in whole.tolist()], add_special_tokens=False), strict=True))
        for i, n in enumerate(n_in):
            if i in encoded:
                mine = [np.array(encoded[i].ids, "<u4")]
            else:
                mine = [joins[at_join]]
                for k in range(n):
                    mine += (cores[of_core[at_core + k]], joins[at_join + k + 1])
            parts += mine
            sizes[i] = sum(map(len, mine))
            at_join += n + 1
            at_core += n
        ends[1:] = np.cumsum(sizes)
        return np.concatenate([*parts, np.zeros(0, "<u4")]), ends


def shared_cores(df: DataFrame, text: str) -> list[str]:
    """The ``SHARED_CORES`` cores that repeat most bytes over all texts; ties by hash.

    Counts are combined in each batch before they are shuffled by hash; only the chosen cores, which the
    parameter and the longest chunk bound, come back as text.
    """
    spark = df.sparkSession

    def batch_cores(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
        cut = cut_texts(pc.fill_null(batch.column(0), ""))
        counts = pc.value_counts(cut.strings(cut.core_first, cut.core_end))
        return counts.field("values"), counts.field("counts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", PART_BYTES):
            values, counts = batch_cores(batch)
            yield pa.RecordBatch.from_arrays([core_hash(values), counts, pc.binary_length(values).cast(pa.int64())], ["hash", "n", "bytes"])

    seen = df.select(F.col(text).cast("string").alias("_text"))
    counted = seen.mapInArrow(count, "hash bigint, n bigint, bytes bigint").groupBy("hash").agg(F.sum("n").alias("n"), F.max("bytes").alias("bytes"))
    saved = (F.col("n") - 1) * F.col("bytes")
    chosen = counted.where("n > 1").orderBy(saved.desc(), "hash").limit(SHARED_CORES).select("hash").collect()
    wanted = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in chosen], np.int64)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in slices(batches, "_text", PART_BYTES):
            values, _ = batch_cores(batch)
            hashes = core_hash(values)
            new = [i for i in np.flatnonzero(np.isin(hashes.to_numpy(), wanted.value)).tolist() if hashes[i].as_py() not in sent]
            sent.update(hashes[i].as_py() for i in new)
            yield pa.RecordBatch.from_arrays([hashes.take(pa.array(new, pa.int64())), values.take(pa.array(new, pa.int64()))], ["hash", "core"])

    if not chosen:
        return []
    # One text a hash; should two cores share one, the other is encoded where it stands.
    texts = seen.mapInArrow(fetch, "hash bigint, core string").groupBy("hash").agg(F.min("core").alias("core"))
    return [r[0] for r in texts.select("core").collect()]


def core_hash(values: pa.Array) -> pa.Array:
    from pandas.util import hash_array

    if not len(values):
        return pa.array([], pa.int64())
    return pa.array(hash_array(np.array(values.to_pylist(), object), categorize=False).view(np.int64))


_CODERS: dict[str, ChunkCoder] = {}


def coder_for(path: str, name: str, shared) -> ChunkCoder:
    """One coder per worker, vocabulary and shared table; ``name`` is new for every table."""
    if name not in _CODERS:
        _CODERS.clear()  # a worker that goes on to another job keeps no old table
        _CODERS[name] = ChunkCoder(path, shared.value)
    return _CODERS[name]


def coded_parts(coder: ChunkCoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_key, ids, decoded`` of rows ``_key, _text``, ``PART_BYTES`` at a time."""
    for batch in slices(batches, "_text", PART_BYTES):
        ids, ends = coder.encode(pc.fill_null(batch.column(1), ""))
        decoded = [coder.library.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        lists = list_column(pa.array(ids.astype(np.int32)), ends)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.string())], ["_key", "ids", "decoded"])


def encode_and_decode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` (array of int) and ``decoded``, the library's decoding of just these ids, of each row."""
    import uuid

    spark = df.sparkSession
    ahead = shared_cores(df, text)
    ids, ends = word_encoder(path).encode(pa.array(ahead, pa.string()))
    shared = spark.sparkContext.broadcast({t: ids[a:b].copy() for t, a, b in zip(ahead, ends[:-1].tolist(), ends[1:].tolist(), strict=True)})
    name = uuid.uuid4().hex
    source = df.select(df[key].alias("_key"), df[text].cast("string").alias("_text"))
    kind = source.schema["_key"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from coded_parts(coder_for(path, name, shared), batches)

    return source.mapInArrow(code, f"_key {kind}, ids array<int>, decoded string").withColumnRenamed("_key", key)
