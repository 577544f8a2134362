"""Best-fit packing of documents into fixed-length sequences, planned on counts of lengths.

Best fit decides by length alone, so the plan is made on the histogram of piece lengths, which has at
most ``capacity`` entries whatever the corpus. It comes out as runs of equal slots: "pieces of length L
with ranks a..b take offset o in sequences s..t". A piece then finds its slot by its rank within its
length. Ranks need no global sort: pieces are checkpointed, counted by (partition, length), and ranked
inside those small groups.

Defined cases: a null or empty text is its end id alone; a null id is kept; rows equal in all columns
are packed once each; an empty table gives an empty result; input columns other than key and text are
not read, so their names cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import slices
from .tokens import word_encoder

CAPACITY = 2048
END_ID = 0


def token_pieces(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of each document's ids: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit).

    Only documents longer than ``capacity``, end id included, are cut; their last piece may be shorter.
    """
    source = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in slices(batches, "text"):
            ids, starts = encoder.encode(batch.column("text"))
            ids = np.insert(ids, starts[1:], np.uint32(end_id))
            firsts = starts + np.arange(len(starts))
            sizes = np.diff(firsts)
            n_pieces = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(sizes[row] - start, capacity)
            offsets = pa.array(np.append(4 * (firsts[row] + start), 4 * firsts[-1]).astype(np.int32))
            raw = pa.Array.from_buffers(pa.binary(), len(row), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), raw],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return source.mapInArrow(cut_up, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit over ``{length: pieces}``, longest first.

    Returns runs ``(length, first_rank, pieces, first_sequence, offset)``. Open sequences with the same
    room are kept as ranges, so the work and the plan follow the number of lengths, not of pieces.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []
    runs, sequences = [], 0
    for length in sorted((c for c in counts if counts[c]), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit sequences of {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            free = rooms[at] if at < len(rooms) else capacity
            each = free // length
            if at < len(rooms):
                first, have = room[free].pop()
                if not room[free]:
                    rooms.pop(at)
            else:
                first, have = sequences, -(-left // each)
                sequences += have
            full, over = divmod(min(left, have * each), each)
            for k in range(each):
                n = full + (k < over)
                if n:
                    runs.append((length, rank, n, first, capacity - free + k * length))
                    rank, left = rank + n, left - n
            for begin, n, rest in (
                (first, full, free - each * length),
                (first + full, int(over > 0), free - over * length),
                (first + full + (over > 0), have - full - (over > 0), free),
            ):
                if n and rest:
                    if not room[rest]:
                        insort(rooms, rest)
                    room[rest].append((begin, n))
    return runs


def ranked(pieces: DataFrame, length: str, order: list[str]) -> DataFrame:
    """Add ``_rank``, 0-based within equal ``length``; ``pieces`` must be checkpointed.

    A partition of a checkpoint is a file, so its number is the same for every read. No group is larger
    than one partition's pieces of one length.
    """
    placed = pieces.withColumn("_part", F.spark_partition_id())
    sizes = placed.groupBy("_part", length).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(length).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", length, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", length).orderBy(*order)
    rows = placed.withColumn("_at", F.row_number().over(inside) - 1)
    return rows.join(offsets, ["_part", length]).withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def best_fit_pack(pieces: DataFrame, length: str = "length", order: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a ``sequence_id`` and an ``offset``; all its columns are kept.

    ``order`` must tell all but equal rows apart. Lengths run from 1 to ``capacity``. The driver sees the
    histogram (at most ``capacity`` rows) and the plan made from it, nothing per document.
    """
    kept = cut(pieces)
    counts = {r[0]: r[1] for r in kept.groupBy(length).agg(F.count(F.lit(1))).collect()}
    runs = sorted(plan_best_fit(counts, capacity)) or [(0, 0, 0, 0, 0)]
    table = kept.sparkSession.sparkContext.broadcast(np.array(runs, np.int64))
    source = ranked(kept, length, order or [c for c in kept.columns if c != length])
    out = source.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def take_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = table.value
        shift = int(runs[:, 1].max()) + 1
        keys = runs[:, 0] * shift + runs[:, 1]
        for batch in batches:
            sizes = batch.column(length).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column("_rank").to_numpy(zero_copy_only=False)
            # The last run of this length whose first rank is not above the piece's.
            at = np.searchsorted(keys, sizes * shift + np.minimum(ranks, shift - 1), "right") - 1
            sequence = pa.array(runs[at, 3] + ranks - runs[at, 1])
            columns = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, sequence, pa.array(runs[at, 4])], names=out.names)

    return source.mapInArrow(take_slots, out)
