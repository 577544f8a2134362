"""Token ids of a corpus in one binary form, written and read by every executor.

A table of blocks holds the ids in ascending key order. Each block is coded by ``range_coder`` on its own,
with checksums, beside the keys and lengths of its documents, so any block can be read alone and a
damaged one is noticed. The files are written through Spark's committer, so a lost executor leaves no
half file, and reach any storage Spark reaches.

Defined cases: a null or empty text is its end id alone; null keys come first; rows of one key are
ordered by a hash of their text, and equal rows follow each other; a document longer than a block spans
several; an empty table gives an empty result. Columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import slices
from .range_coder import BLOCK_IDS, decode_block, encode_block
from .tokens import word_encoder

END_ID = 1
#: Texts encoded at a time; more of them share more words.
ENCODE_BYTES = 16_000_000
CRC_POLYNOMIAL = 0xEDB88320


def write_ids(df: DataFrame, path: str, tokenizer: str, alphabet: int, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, end it with ``end_id``, and write blocks in key order under ``path``.

    Columns: ``part, block`` (order of blocks), ``first`` (ids of the part before the block), ``n_ids``,
    ``keys, sizes`` (documents in the block and their ids there), ``piece`` (number of this block within a
    document that spans several, else null), ``payload``.
    """
    source = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text")]
    placed = source.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = source.schema["_key"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        made = {"block": 0, "first": 0}

        def block(keys: list, sizes: list[int], runs: list[np.ndarray], piece: int | None) -> pa.RecordBatch:
            ids = np.concatenate(runs)
            row = [part, made["block"], made["first"], len(ids), keys, sizes, piece, encode_block(ids, alphabet)]
            made["block"] += 1
            made["first"] += len(ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        names = ["part", "block", "first", "n_ids", "keys", "sizes", "piece", "payload"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.int64(), pa.binary()]
        keys, sizes, runs, held = [], [], [], 0
        for batch in slices(batches, "_text", ENCODE_BYTES):
            types[4] = pa.list_(batch.schema.field("_key").type)
            ids, starts = encoder.encode(batch.column("_text"))
            ids = np.insert(ids, starts[1:], np.uint32(end_id))
            firsts = (starts + np.arange(len(starts))).tolist()
            for k, a, z in zip(batch.column("_key").to_pylist(), firsts[:-1], firsts[1:], strict=True):
                if held and held + z - a > block_ids:
                    yield block(keys, sizes, runs, None)
                    keys, sizes, runs, held = [], [], [], 0
                if z - a > block_ids:
                    for piece, at in enumerate(range(a, z, block_ids)):
                        yield block([k], [min(block_ids, z - at)], [ids[at : min(at + block_ids, z)]], piece)
                    continue
                keys.append(k)
                sizes.append(z - a)
                runs.append(ids[a:z])
                held += z - a
            runs = [np.concatenate(runs)] if runs else []  # lets go of the batch's ids
        if held:
            yield block(keys, sizes, runs, None)

    placed.mapInArrow(
        code, f"part int, block bigint, first bigint, n_ids bigint, keys array<{kind}>, sizes array<bigint>, piece bigint, payload binary"
    ).write.parquet(path)


def read_pieces(blocks: DataFrame) -> DataFrame:
    """Ids of each document or piece: ``part, block, at, key, start, piece, ids``; ``start`` counts within the part.

    ``blocks`` are rows of the table of blocks, all or some.
    """
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "block", "at", "key", "start", "piece", "ids"]
        for batch in batches:
            for i in range(batch.num_rows):
                one = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = decode_block(one["payload"].as_py())
                sizes = np.array(one["sizes"].as_py(), np.int64)
                ends = np.cumsum(sizes)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("a block's documents do not add up to its ids")
                n = len(sizes)
                offsets = pa.array(np.append([0], 4 * ends).astype(np.int32))
                raw = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                same = [pa.array([one[c].as_py()] * n, t) for c, t in (("part", pa.int32()), ("block", pa.int64()), ("piece", pa.int64()))]
                starts = pa.array(one["first"].as_py() + ends - sizes)
                yield pa.RecordBatch.from_arrays([same[0], same[1], pa.array(np.arange(n)), one["keys"].values, starts, same[2], raw], names)

    return blocks.mapInArrow(decode, f"part int, block bigint, at bigint, key {kind}, start bigint, piece bigint, ids binary")


def _times_x(value: int, bits: int) -> int:
    """``value * x^bits`` modulo the CRC polynomial, both in reflected form."""
    power, factor = 1 << 31, 1 << 30  # x^0 and x^1
    while bits:
        if bits & 1:
            power = _multiply(power, factor)
        factor = _multiply(factor, factor)
        bits >>= 1
    return _multiply(value, power)


def _multiply(a: int, b: int) -> int:
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of pieces laid end to end, from ``(crc, bytes)`` of each."""
    crc = zlib.crc32(b"")
    for piece, size in pieces:
        crc = _times_x(crc, 8 * size) ^ piece
    return crc


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``key, start, n_tokens, ids_crc32``, with ``start`` over the whole corpus.

    Offsets of the parts come from one row per written part. The checksums of a document that spans blocks
    are joined by arithmetic, so its ids need not meet again.
    """
    blocks = spark.read.parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    combine = F.udf(lambda pieces: joined_crc([(p["crc"], 4 * p["n"]) for p in pieces]), "bigint")

    def digests(some: DataFrame) -> DataFrame:
        n, crc = (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
        return read_pieces(some).select("part", "block", "key", "start", "piece", n, crc)

    names = ["part", "key", "start", "n_tokens", "ids_crc32"]
    # Only a document longer than a block comes in pieces, each a block of its own.
    pieces = (
        digests(blocks.where("piece is not null"))
        .groupBy("part", (F.col("block") - F.col("piece")).alias("_first"))
        .agg(
            F.first("key").alias("key"), F.min("start").alias("start"), F.sum("n_tokens").alias("_n"),
            F.array_sort(F.collect_list(F.struct("piece", F.col("ids_crc32").alias("crc"), F.col("n_tokens").alias("n")))).alias("_pieces"),
        )
        .select("part", "key", "start", F.col("_n").alias("n_tokens"), combine("_pieces").alias("ids_crc32"))
    )
    rows = digests(blocks.where("piece is null")).select(*names).unionByName(pieces)
    # One row per written part: as many as a shuffle has partitions.
    rows = rows.join(F.broadcast(parts), "part")
    return rows.select("key", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer: str, alphabet: int, key: str = "doc_id", text: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Write to a fresh table of the shared folder and return its documents' digests."""
    spark = df.sparkSession
    path = scratch_path(spark, "ids")
    write_ids(df, path, tokenizer, alphabet, key, text, end_id, block_ids)
    return document_digests(spark, path).withColumnRenamed("key", key)
