"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes. With all sets in one global order,
two sets similar enough share at least L shingles of their L-prefixes, the first ``n - ceil(t n) + L``.
L = 1 is the usual prefix filter. Each document takes the L of least estimated cost: a longer prefix is
read in more posting lists, but only documents sharing as many shingles are verified. A pair must share
the smaller of its two L within the prefixes of that L, so no pair is lost, whatever is estimated.

The order and the costs come from a sketch of shingle counts over all documents: rare first, then by hash.
Equal sets are one class from the start, so copies cost one row. Posting lists are first joined to their
smallest member and the pairs that meet often enough verified; that links a group of near copies with as
many pairs as it has members. Long lists that stay open get several hubs at once, as long as that links many of
their members, for what is left of a list costs its square. Then shingles that still meet different components give
all pairs across components, so links inside a component are the only ones not looked at, and components are
exact. Those pairs are narrowed by bounds that no similar pair breaks: the places of what they share, given both sizes
(``_level``), and the parities of both sets, which differ in no more bits than the sets in shingles
(``_similar_parities``); where the parities tell too little, by the number of matches.

Defined cases: null and empty texts have no shingle and are linked with nothing; texts of fewer words than
a shingle are one shingle, the whole; rows equal in key and text are one document recorded twice; the
smallest key of a component names it (null first); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import sorted_index
from ..session import cut
from .common import drop_written, list_column, mixed, row_keys, shuffles_dropped, slices, split_words, word_hashes, written
from .components import connected_components, merged_components
from .repeats import window_hashes

WORDS, PERCENT = 5, 75
SKETCH_CELLS, SKETCH_ROWS = 1 << 20, 64
MAX_MATCHES = 6
HUBS = 6
#: A list is long if it has so many pairs across components a member; the share of long lists' pairs that a round of
#: new hubs must settle to be followed by another.
LONG_LIST, SETTLED = 32, 0.5
#: Words of 64 bits of a set's parities: whether an odd number of its shingles falls in each of so many cells.
PARITY_WORDS = 16
PARITIES = [f"parity{k}" for k in range(PARITY_WORDS)]
#: Sets that differ in more shingles than this turn about half of all bits, like any others.
PARITIES_TELL = 16 * PARITY_WORDS
#: Cost of verifying one candidate, in posting-list entries read.
VERIFY_COST = 20.0
#: Other documents expected to hold a shingle of which the sketch says nothing.
CHANCE = 0.05


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, starts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    each = word_hashes(words)
    hashes = mixed(window_hashes(each, n))
    spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
    for a, z in spans:
        hashes[a : max(a, z - n + 1)].sort()
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    first[starts[starts < len(hashes)]] = True
    out = []
    for a, z in spans:
        if z - a >= n:
            out.append(hashes[a : z - n + 1][first[a : z - n + 1]])
        elif z > a:
            out.append(mixed(window_hashes(each[a:z], z - a)[:1] ^ np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def summarise(keyed: DataFrame, n: int) -> DataFrame:
    """Rows of documents (``_id, _row, n, s1, s2``: size and two hashes of the set) and of sketch parts (``part, counts``)."""
    kind = keyed.schema["_id"].dataType.simpleString()
    names = ["_id", "_row", "n", "s1", "s2", "part", "counts"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, id_type = np.zeros(SKETCH_CELLS, np.int64), None
        for batch in slices(batches, "_text"):
            id_type = batch.schema.field("_id").type
            sets = shingle_sets(batch.column("_text"), n)
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            sketch += np.bincount((every % np.uint64(SKETCH_CELLS)).astype(np.int64), minlength=SKETCH_CELLS)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])

            def total(h: np.ndarray, ends: np.ndarray = ends) -> pa.Array:
                upto = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
                return _signed(upto[ends[1:]] - upto[ends[:-1]])

            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_row"), pa.array(np.diff(ends)), total(every), total(mixed(every ^ np.uint64(0x5BD1E995))),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names,
            )
        if id_type is not None:
            parts = [p.astype("<i4").tobytes() for p in np.split(sketch, SKETCH_ROWS)]
            none = [pa.nulls(SKETCH_ROWS, t) for t in (id_type, *[pa.int64()] * 4)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(parts, pa.binary())], names)

    return keyed.mapInArrow(look, f"_id {kind}, _row bigint, n bigint, s1 bigint, s2 bigint, part int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The sketch summed over the tasks; ``SKETCH_CELLS`` numbers, whatever the corpus."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                found = np.frombuffer(counts, "<i4").astype("<i8")
                total[part] = total[part] + found if part in total else found
        yield pd.DataFrame({"part": list(total), "counts": [t.tobytes() for t in total.values()]})

    out = np.zeros((SKETCH_ROWS, SKETCH_CELLS // SKETCH_ROWS), np.int64)
    for part, counts in parts.repartition("part").mapInPandas(add, "part int, counts binary").collect():
        out[part] = np.frombuffer(counts, "<i8")
    return out.reshape(-1)


def least_overlap(n: int, percent: int) -> int:
    """Shingles a set of ``n`` shares at least with any set similar enough."""
    return -(-percent * n // 100)


def parities(s: np.ndarray) -> np.ndarray:
    """``PARITY_WORDS`` words for a set of shingle hashes; those of two sets differ in at most as many bits as the sets in shingles."""
    return parity_rows([s])[0]


def parity_rows(sets: list[np.ndarray], at_once: int = 1000) -> np.ndarray:
    """``parities`` of each set, a row each."""
    cells, out = 64 * PARITY_WORDS, [np.zeros((0, PARITY_WORDS), np.int64)]
    for k in range(0, len(sets), at_once):
        some = sets[k : k + at_once]
        row = np.repeat(np.arange(len(some)), [len(s) for s in some]) * cells
        cell = ((np.concatenate(some) >> np.uint64(32)) % np.uint64(cells)).astype(np.int64)
        odd = np.bincount(row + cell, minlength=cells * len(some)).astype(np.uint8) & 1
        out.append(np.packbits(odd).view(np.int64).reshape(-1, PARITY_WORDS))
    return np.concatenate(out)


def choose_matches(others: np.ndarray, base: int, most: int) -> int:
    """L of least cost; ``others`` estimates, along the prefix, how many other documents hold each shingle."""
    read = np.cumsum(others)
    levels = np.arange(1, most + 1)
    at = read[np.minimum(base + levels - 1, len(read) - 1)]
    # Documents met in L lists or more are at most (entries read) / L.
    return int(np.argmin(at + VERIFY_COST * at / levels)) + 1


def prefixes(keyed: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """``_id, _row, n, matches, prefix`` and ``PARITIES``: the shingles of each document's prefix in the global order."""
    kind = keyed.schema["_id"].dataType.simpleString()
    usual = float(np.median(sketch))
    shared = keyed.sparkSession.sparkContext.broadcast(sketch)

    def cut_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches, "_text"):
            sets = shingle_sets(batch.column("_text"), n)
            sizes, matches, parts = [], [], []
            for s in sets:
                seen = counts[(s % np.uint64(SKETCH_CELLS)).astype(np.int64)]
                order = np.argsort(seen, kind="stable")  # equal counts stay in the order of the hashes
                need = least_overlap(len(s), percent)
                base, most = len(s) - need, min(MAX_MATCHES, need)
                if most:
                    reach = order[: base + most]
                    level = choose_matches(np.maximum(seen[reach] - usual, CHANCE), base, most)
                else:
                    level = 0
                sizes.append(len(s))
                matches.append(level)
                parts.append(s[order[: base + level]])
            ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            lists = list_column(_signed(np.concatenate([*parts, np.zeros(0, np.uint64)])), ends)
            words = [pa.array(w) for w in parity_rows(sets).T.copy()]
            found = [batch.column("_id"), batch.column("_row"), pa.array(sizes, pa.int32()), pa.array(matches, pa.int32()), lists, *words]
            yield pa.RecordBatch.from_arrays(found, ["_id", "_row", "n", "matches", "prefix", *PARITIES])

    words = "".join(f", {name} bigint" for name in PARITIES)
    return keyed.mapInArrow(cut_prefix, f"_id {kind}, _row bigint, n int, matches int, prefix array<bigint>{words}")


def whole_sets(keyed: DataFrame, n: int) -> DataFrame:
    """``doc, shingles`` of rows that have ``_index``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            sets = shingle_sets(batch.column("_text"), n)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            lists = list_column(_signed(np.concatenate([*sets, np.zeros(0, np.uint64)])), ends)
            yield pa.RecordBatch.from_arrays([batch.column("_index"), lists], ["doc", "shingles"])

    return keyed.select("_index", "_text").mapInArrow(find, "doc bigint, shingles array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar enough."""
    one = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("both", both)
    return joined.where(100 * F.col("both") >= percent * (F.size("left") + F.size("right") - F.col("both"))).select("a", "b")


def _similar_size(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _overlap(n1: Column, n2: Column, percent: int) -> Column:
    """Shingles that sets of these sizes share at least if they are similar enough."""
    return F.ceil(percent * (n1 + n2) / (100 + percent))


def _may_differ(n1: Column, n2: Column, percent: int) -> Column:
    """Shingles that are in one set alone, at most, if sets of these sizes are similar enough."""
    return n1 + n2 - 2 * _overlap(n1, n2, percent)


def _similar_parities(one: str, two: str, percent: int) -> Column:
    """Whether the parities leave it possible that two sets are similar enough; ``one`` and ``two`` end the columns' names.

    Each shingle in one set alone turns one bit, so the sets differ in as many shingles as bits, or more.
    """
    differ = reduce(Column.__add__, [F.bit_count(F.col(p + one).bitwiseXOR(F.col(p + two))) for p in PARITIES])
    return differ <= _may_differ(F.col(f"n{one}"), F.col(f"n{two}"), percent)


def _level(at1: Column, n1: Column, at2: Column, n2: Column, percent: int) -> Column:
    """The smallest L for which places ``at1`` and ``at2`` lie in the L-prefixes that a pair of sizes ``n1`` and ``n2`` needs.

    Sets of these sizes that are similar enough share ``o`` shingles or more; behind the first L - 1 of them
    there are still ``o - L + 1``, so the first L are among the first ``n - o + L`` of either set.
    """
    overlap = _overlap(n1, n2, percent)
    return F.greatest(F.lit(1), at1 - n1 + overlap + 1, at2 - n2 + overlap + 1)


def _numbered(rows: DataFrame, order: DataFrame) -> DataFrame:
    """The rows whose key is in ``order``, with its ``_index``."""
    right = order.select(F.col("_id").alias("_order_id"), F.col("_row").alias("_order_row"), "_index")
    joined = rows.join(right, F.col("_id").eqNullSafe(F.col("_order_id")) & (F.col("_row") == F.col("_order_row")))
    return joined.drop("_order_id", "_order_row")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``_id, _row, n_shingles, component`` of every row; ``component`` is the smallest ``(_id, _row)`` reachable by links."""
    spark, keyed = docs.sparkSession, row_keys(docs, key, text)
    doc = F.struct("_id", "_row")
    with shuffles_dropped(spark):
        found, _ = written(summarise(keyed, n), "sets")
        rows = found.where("part is null").select("_id", "_row", "n", "s1", "s2")
        sketch = _sketch(found.where("part is not null").select("part", "counts"))
        # Rows of equal sets are one class, named by its smallest row and known by its place in key order.
        classes = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(doc).alias("chosen")).select("n", "s1", "s2", "chosen._id", "chosen._row")
        order = cut(sorted_index(classes, [F.col("_id").asc_nulls_first(), F.col("_row")]))
        cuts, cuts_path = written(_numbered(prefixes(keyed, sketch, n, percent), order).select("_index", "n", "matches", "prefix", *PARITIES), "prefixes")
        listed = cuts.select(F.col("_index").alias("doc"), "n", "matches", F.posexplode("prefix").alias("at", "shingle"))
        twice = cuts.select(F.explode("prefix").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1").select("shingle")
        lists, lists_path = written(listed.join(twice.hint("shuffle_hash"), "shingle"), "lists")
        bits = cut(cuts.select(F.col("_index").alias("doc"), *PARITIES).distinct())
        drop_written(spark, cuts_path)

        def linked(pairs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
            """Components, on top of ``labels``, after the similar ones among ``pairs``; only the documents in them are read again."""
            pairs = cut(pairs.select("a", "b"))
            both = pairs.select(F.explode(F.array("a", "b")).alias("_index")).distinct().join(order, "_index")
            sets, path = written(whole_sets(_numbered(keyed, both), n), "shingles")
            similar = verified(pairs, sets, percent)
            merged = connected_components(similar) if labels is None else merged_components(labels, similar)
            drop_written(spark, path)
            return merged

        def stars(members: DataFrame) -> DataFrame:
            """Pairs of list members with the hub of their list that meet often enough."""
            hub = F.min(F.struct(F.xxhash64("doc", F.lit(0)).alias("h"), "doc", "n", "matches")).alias("hub")
            hubs = members.groupBy("shingle").agg(hub)
            pairs = members.join(hubs, "shingle").where((F.col("doc") != F.col("hub.doc")) & _similar_size(F.col("n"), F.col("hub.n"), percent))
            ends = F.least("doc", "hub.doc").alias("a"), F.greatest("doc", "hub.doc").alias("b")
            met = pairs.groupBy(*ends).agg(F.count(F.lit(1)).alias("met"), F.min(F.least("matches", "hub.matches")).alias("need"))
            return met.where("met >= need")

        def placed_in(rows: DataFrame, labels: DataFrame) -> DataFrame:
            joined = rows.drop("group").join(labels, rows["doc"] == labels["node"], "left")
            return joined.withColumn("group", F.coalesce("component", "doc")).drop("node", "component")

        def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
            """Members of lists that meet different components."""
            placed = placed_in(rows, labels)
            several = placed.groupBy("shingle").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high").select("shingle")
            return placed.join(several, "shingle")

        # Every list member against one member as hub.
        labels = linked(stars(lists))
        open_lists, open_path = written(still_open(lists, labels).join(bits, "doc"), "open")

        def meeting(members: DataFrame, others: DataFrame, apart: Column) -> DataFrame:
            """Pairs of ``members`` and ``others`` that share enough to be checked; ``apart`` says which groups are paired."""
            one, two = [rows.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in open_lists.columns if c != "shingle"]) for k, rows in ((1, members), (2, others))]
            n1, n2 = F.col("n1"), F.col("n2")
            # Where the parities tell similar sets from others, the first shingle they share is enough.
            least = F.when(_may_differ(n1, n2, percent) <= PARITIES_TELL, 1).otherwise(F.least("matches1", "matches2"))
            level = _level(F.col("at1"), n1, F.col("at2"), n2, percent)
            similar = _similar_size(n1, n2, percent) & (level <= least) & _similar_parities("1", "2", percent)
            across = one.join(two, "shingle").where(apart & similar)
            shared = across.groupBy(F.least("doc1", "doc2").alias("a"), F.greatest("doc1", "doc2").alias("b")).agg(
                F.min(least).alias("need"), *[F.sum((level <= k).cast("int")).alias(f"within{k}") for k in range(1, MAX_MATCHES + 1)]
            )
            # The first of what a pair shares lies in the prefixes of L = 1, the first two in those of L = 2, and so on.
            enough = [(F.col("need") < k) | (F.col(f"within{k}") >= k) for k in range(1, MAX_MATCHES + 1)]
            return shared.where(reduce(Column.__and__, enough))

        def long_lists(rows: DataFrame, labels: DataFrame) -> DataFrame:
            """Rows of long lists under these labels, each with its part of the list's ``pairs`` across components."""
            placed = placed_in(rows.drop("pairs"), labels)
            held = placed.groupBy("shingle", "group").agg(F.count(F.lit(1)).alias("held")).groupBy("shingle")
            each = (F.sum("held") - F.sum(F.col("held") * F.col("held")) / F.sum("held")) / 2
            return cut(placed.join(held.agg(each.alias("pairs")).where(F.col("pairs") >= LONG_LIST), "shingle"))

        def more_hubs(members: DataFrame, turn: int) -> DataFrame:
            """Pairs with new hubs of their list, of which one stands in most long lists, that share enough to be checked."""
            central = members.groupBy("doc").agg(F.count(F.lit(1)).alias("stands"))
            drawn = [F.min(F.struct(F.xxhash64("doc", F.lit(HUBS * turn + t)).alias("h"), "doc"))["doc"] for t in range(HUBS - 1)]
            drawn.append(F.max(F.struct("stands", F.xxhash64("doc", F.lit(turn)).alias("h"), "doc"))["doc"])
            hubs = members.join(central, "doc").groupBy("shingle").agg(F.array_distinct(F.array(*drawn)).alias("hubs")).select("shingle", F.explode("hubs").alias("doc"))
            return meeting(members, members.join(hubs, ["shingle", "doc"]), F.col("group1") != F.col("group2"))

        # Long lists take new hubs while that settles many of their pairs.
        counts = open_lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > 2 * LONG_LIST)
        waiting, turn = long_lists(open_lists.join(counts.select("shingle"), "shingle"), labels), 1
        left = waiting.agg(F.sum("pairs")).first()[0] or 0
        while left:
            merged = linked(more_hubs(waiting, turn), labels)
            if merged is labels:
                break
            labels, waiting, turn, before = merged, long_lists(waiting, merged), turn + 1, left
            left = waiting.agg(F.sum("pairs")).first()[0] or 0
            if left > (1 - SETTLED) * before:
                break
        # What still meets different components: all pairs across them that share enough.
        still, still_path = written(still_open(open_lists, labels), "still") if turn > 1 else (open_lists, open_path)
        labels = linked(meeting(still, still, F.col("group1") < F.col("group2")), labels)
        for path in {open_path, still_path, lists_path}:
            drop_written(spark, path)
        names = order.select(F.col("_index").alias("component"), F.struct("_id", "_row").alias("name"))
        labelled = order.join(labels, order["_index"] == labels["node"], "left").select("n", "s1", "s2", F.coalesce("component", "_index").alias("component"))
        named = cut(labelled.join(names, "component").select(F.col("n").alias("_n"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), "name"))
    same = (F.col("n") == F.col("_n")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2"))
    return rows.join(named, same, "left").select("_id", "_row", F.col("n").alias("n_shingles"), F.coalesce("name", doc).alias("component"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that name their component, each once; documents without a shingle stay."""
    found = similar_documents(docs, key, text, n, percent)
    keepers = found.where(F.struct("_id", "_row").eqNullSafe(F.col("component"))).select("_id", "_row").distinct()
    right = keepers.withColumnsRenamed({"_id": "_keep_id", "_row": "_keep_row"})
    keyed = docs.withColumn("_row", F.xxhash64(key, F.coalesce(F.col(text), F.lit("\x00"))))
    kept = keyed.join(right, F.col(key).eqNullSafe(F.col("_keep_id")) & (F.col("_row") == F.col("_keep_row")), "left_semi")
    # Of rows equal in key and text the one with the smallest other columns stays.
    return kept.groupBy(key, "_row").agg(F.min(F.struct(*docs.columns)).alias("_kept")).select("_kept.*")
