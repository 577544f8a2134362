"""Prefix trie of conversations as a burst trie.

A conversation's turns become 128-bit turn ids, and its suffix beyond the trie's heads lies in the container of
the head it hangs from. A container of more than ``limit`` suffixes bursts: the next turn id of each suffix
makes a new, deeper container. Containers left are dealt to shards, sorted, and swept once into nodes, a shard
holding one container at a time and at most ``window`` turns of each suffix; what is still shared beyond the
window is swept as containers of its own in the next round. From where a conversation is alone, its nodes are
its turns and never meet others. Totals of subtrees reach heads by adding each container's totals to all heads
above it, so no task sees more than a container.

Positions come from one global sort, so a conversation of any length is spread; ids of conversations that end
at one head are joined in runs by many tasks before one digest reads the runs in order.

Defined cases: rows without a conversation id belong to no conversation and are left out; null role or text
count as empty; turns are ordered by number, null first, then by role and turn id; repeated rows are turns of
their own; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import sorted_index
from .common import drop_written, written

LIMIT, WINDOW, FAMILY, HEAD_TURNS = 512, 256, 100, 6
#: Turn ids a burst takes at once: one first, then several a round.
FIRST_LEVELS, MORE_LEVELS = 1, 8
IDS_A_RUN = 65_536
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NO_END = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, pos, turn_id, size``: every turn with its place in its conversation and its text's code points."""
    said, by = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    turn_id = F.md5(F.concat(F.char_length(by).cast("string"), F.lit(":"), by, said))
    rows = df.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).alias("turn"), by.alias("role"), turn_id.alias("turn_id"), F.char_length(said).cast("bigint").alias("size"))
    rows = rows.where(F.col("conv").isNotNull()).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_id"), F.col("row")]
    placed = sorted_index(rows, order)
    firsts = placed.groupBy("conv").agg(F.min("_index").alias("first"))
    return placed.join(firsts, "conv").select("conv", (F.col("_index") - F.col("first")).alias("pos"), "turn_id", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation took over the head of its family's first one.

    The head is the first crc32(id) mod ``HEAD_TURNS`` turns; a family has ``FAMILY`` ids (each side of zero).
    """
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD_TURNS))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumn("head", head)
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    bases = convs.where("conv = base").select("base", F.col("own").alias("base_own"))
    taken = F.least("head", F.coalesce("base_own", F.lit(0)))
    convs = convs.join(bases, "base", "left").select("conv", "base", "head", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("length"))
    own = turns.join(convs, "conv").where("pos >= head").select("conv", (F.col("taken") + F.col("pos") - F.col("head")).alias("pos"), "turn_id", "size")
    first = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEAD_TURNS)).select(F.col("conv").alias("base"), "pos", "turn_id", "size")
    taken_over = first.join(convs.select("conv", "base", "head"), "base").where("pos < head").select("conv", "pos", "turn_id", "size")
    return own.unionByName(taken_over), convs.select("conv", "length")


@dataclass
class Node:
    """A node while its subtree is swept; ``rows`` are indices of what hangs from it and waits for its id."""

    depth: int
    size: int
    conv: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    beyond: bool = False
    members: list[tuple[int, int]] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    tails: list[int] = field(default_factory=list)

    def take(self, conv: int, n: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


@dataclass
class Sweep:
    """Sorts the suffixes of one container and sweeps them into nodes."""

    window: int
    #: (kind, conv, depth, parent, n, children, leaves, saved, ends, open, length, tail); kinds below.
    out: list[list] = field(default_factory=list)

    NODE, ALONE, REOPEN = 0, 1, 2

    def close(self, stack: list[Node], floor: int) -> None:
        node = stack.pop()
        above = stack[-1] if stack else None
        if node.depth == floor + self.window and any(length > node.depth for _, length in node.members):
            # Shared beyond the window: its members make a container of the next round.
            for conv, length in node.members:
                self.out.append([self.REOPEN, conv, node.depth, node.conv, None, None, None, None, None, None, length, []])
                above.tails.append(len(self.out) - 1)
            above.children += 1
            above.beyond = True
        else:
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * node.size
            ends = ",".join(str(c) for c in sorted(c for c, length in node.members if length == node.depth))
            self.out.append([self.NODE, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, hashlib.sha256(ends.encode()).hexdigest(), node.beyond, None, None])
            for i in node.rows:
                self.out[i][3] = node.conv
            for i in node.tails:
                self.out[i][11].append(node.conv)  # from the window's end upwards
            if above:
                above.rows.append(len(self.out) - 1)
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
                above.beyond |= node.beyond
                above.tails += node.tails
        if above:
            above.take(node.conv, node.n)

    def container(self, floor: int, parent: int, size: int, members: list[tuple[list[str], int, int, list[int]]]) -> list[list]:
        """``members``: turn ids from depth ``floor`` on, conversation, length, sizes of these turns."""
        self.out = []
        members.sort(key=itemgetter(0, 1))
        stack, shared = [Node(floor, size)], 0
        for i, (ids, conv, length, sizes) in enumerate(members):
            following = 0
            if i + 1 < len(members):
                for a, b in zip(ids, members[i + 1][0]):
                    if a != b:
                        break
                    following += 1
            while stack[-1].depth > floor + shared:
                self.close(stack, floor)
            for d in range(shared, following):
                stack.append(Node(floor + d + 1, sizes[d]))
            node = stack[-1]
            node.take(conv, 1)
            if length == node.depth or node.depth == floor + self.window:
                node.members.append((conv, length))
            else:
                self.out.append([self.ALONE, conv, node.depth + 1, None, None, None, None, None, None, None, length, None])
                node.rows.append(len(self.out) - 1)
                node.children += 1
                node.leaves += 1
            shared = following
        while stack:
            self.close(stack, floor)
        self.out[-1][3] = parent  # the container's top comes last
        return self.out


SWEPT = "kind int, conv bigint, depth bigint, parent bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string, open boolean, length bigint, tail array<bigint>"
_SWEPT_TYPES = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]


def sweep_shards(rows: DataFrame, window: int) -> DataFrame:
    """Sweep every container of ``box, conv, length, floor, parent, pos, turn_id, size``."""
    shards = rows.repartition("box").sortWithinPartitions("box", "conv", "pos")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, box, floor, parent, top, members, done = Sweep(window), None, 0, 0, 0, [], []
        names = SWEPT.replace(" array<bigint>", " x").replace(",", "").split()[::2]

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SWEPT_TYPES, strict=True)], names)

        for batch in batches:
            d = batch.to_pydict()
            for b, conv, length, f, p, pos, turn, size in zip(d["box"], d["conv"], d["length"], d["floor"], d["parent"], d["pos"], d["turn_id"], d["size"], strict=True):
                if b != box:
                    if members:
                        done += sweep.container(floor, parent, top, members)
                    if len(done) > 20_000:
                        yield packed()
                        done = []
                    box, floor, parent, members = b, f, p, []
                if pos == f - 1:  # the turn that names the container's top comes first of a member
                    members.append(([], conv, length, []))
                    top = size
                else:
                    members[-1][0].append(turn)
                    members[-1][3].append(size)
        if members:
            done += sweep.container(floor, parent, top, members)
        yield packed()

    return shards.mapInArrow(tasks, SWEPT)


def digests(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of all ``member`` ids of each node, however many one node has."""
    order = ["conv_id", "depth", "member"]
    sorted_ids = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "first": ids[0], "ids": ",".join(map(str, ids))}], schema)

        for batch in batches:
            for conv, depth, member in zip(*[batch.column(c).to_pylist() for c in order], strict=True):
                if ids and (node != (conv, depth) or len(ids) == IDS_A_RUN):
                    yield row()
                    ids = []
                node = (conv, depth)
                ids.append(member)
        if ids:
            yield row()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, found = None, None, []
        for batch in batches:
            for conv, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")], strict=True):
                if node != (conv, depth):
                    if node:
                        found.append((*node, digest.hexdigest()))
                    node, digest = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if node:
            found.append((*node, digest.hexdigest()))
        columns = list(zip(*found)) or [[], [], []]
        types = [pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "depth", "ends_sha256"])

    joined = sorted_ids.mapInArrow(runs, "conv_id bigint, depth bigint, first bigint, ids string")
    ordered = joined.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
    return ordered.mapInArrow(chained, "conv_id bigint, depth bigint, ends_sha256 string")


class BurstTrie:
    """Builds the trie of ``turns`` (``conv, pos, turn_id, size``) and ``convs`` (``conv, length``)."""

    def __init__(self, turns: DataFrame, convs: DataFrame, limit: int, window: int, more_levels: int):
        self.turns, self.convs = turns, convs
        self.limit, self.window, self.more_levels = limit, window, more_levels
        self.paths: list[str] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        found, path = written(df, name)
        self.paths.append(path)
        return found

    def burst_round(self, open_: DataFrame, floor: int, levels: int) -> tuple[DataFrame, DataFrame]:
        """Steps of every open conversation through ``levels`` more turn ids, and counts of all keys met.

        ``open_``: ``conv, length, key, path``, all at depth ``floor``; a path holds the ids of the heads passed.
        """
        ahead = self.turns.where((F.col("pos") >= floor) & (F.col("pos") < floor + levels))
        ahead = ahead.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "size"))).alias("ahead"))  # at most `levels`

        def key(j: Column) -> Column:
            return F.when(j == 0, F.col("key")).otherwise(F.md5(F.concat(F.col("key"), F.array_join(F.slice("ahead.turn_id", 1, j), ""))))

        # Places 1 to n; a conversation without further turns has none.
        places = F.filter(F.sequence(F.lit(1), F.lit(levels)), lambda j: j <= F.size("ahead"))
        steps = F.transform(places, lambda j: F.struct((F.lit(floor) + j).cast("bigint").alias("depth"), key(j).alias("key"), key(j - 1).alias("above"), F.get("ahead.size", j - 1).alias("size")))
        rows = open_.select("conv", "key").join(ahead, "conv").select("conv", F.inline(steps))
        rows = self.keep(rows, "steps")
        counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("head"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.first("size").alias("size"))
        counts = self.keep(counts, "counts")
        heads = counts.where(F.col("n") > self.limit).select("key", "head")
        passed = rows.join(heads, "key", "left")
        per_conv = passed.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "key", "head"))).alias("steps"))  # at most `levels`
        return open_.join(per_conv, "conv", "left"), counts

    def burst(self) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
        """Containers (``conv, length, box, floor, path``), ends at heads, heads, and children counts."""
        root = F.md5(F.lit("root"))
        total = self.convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("head"))
        first = total.select(root.alias("key"), "n", "head", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("string").alias("above"), F.lit(0).cast("bigint").alias("size"))
        lowest = total.select(F.array("head").alias("path"))
        open_ = self.convs.join(F.broadcast(lowest)).select("conv", "length", root.alias("key"), "path")  # one row
        heads, children, boxed, ended, floor, levels = [first], [], [], [], 0, FIRST_LEVELS
        while True:
            stepped, counts = self.burst_round(open_, floor, levels)
            children.append(counts.groupBy("above").agg(F.count(F.lit(1)).alias("n_children")))
            heads.append(counts.where(F.col("n") > self.limit).select("key", "n", "head", "depth", "above", "size"))
            steps = F.coalesce("steps", F.array().cast("array<struct<depth:bigint,key:string,head:bigint>>"))
            taken = F.filter(steps, lambda s: s["head"].isNotNull())
            left = F.filter(steps, lambda s: s["head"].isNull())
            state = stepped.select("conv", "length", F.col("key").alias("old"), F.concat("path", F.transform(taken, lambda s: s["head"])).alias("path"), F.get(left, F.lit(0)).alias("out"), F.element_at(F.concat(F.array(F.col("key")), F.transform(taken, lambda s: s["key"])), -1).alias("last"))
            state = self.keep(state, "state")
            boxed.append(state.where("out is not null").select("conv", "length", F.col("out.key").alias("box"), F.col("out.depth").alias("floor"), "path"))
            ended.append(state.where("out is null and length = size(path) - 1").select("conv", "path"))
            open_ = state.where("out is null and length > size(path) - 1").select("conv", "length", F.col("last").alias("key"), "path")
            floor, levels = floor + levels, self.more_levels
            if open_.isEmpty():
                break
        union = DataFrame.unionByName
        return reduce(union, boxed), reduce(union, ended), reduce(union, heads), reduce(union, children)

    def sweep_round(self, boxed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows swept from containers of two and more, conversations alone in theirs, and totals for the paths."""
        alone_in = boxed.groupBy("box").agg(F.count(F.lit(1)).alias("n"))
        sized = self.keep(boxed.join(alone_in, "box"), "boxed")
        parent = F.element_at("path", -1).alias("parent")
        alone = sized.where("n = 1").select("conv", F.col("floor").alias("depth"), parent, "length")
        many = sized.where("n > 1").select("box", "conv", "length", "floor", parent)
        near = (F.col("pos") >= F.col("floor") - 1) & (F.col("pos") < F.col("floor") + self.window)
        swept = self.keep(sweep_shards(many.join(self.turns, "conv").where(near), self.window), "swept")
        tops = swept.where(F.col("kind") == Sweep.NODE).join(sized.where("n > 1").select("conv", F.col("floor").alias("depth"), "path"), ["conv", "depth"])
        totals = tops.select("path", "leaves", "saved").unionByName(sized.where("n = 1").select("path", F.lit(1).cast("bigint").alias("leaves"), F.lit(0).cast("bigint").alias("saved")))
        again = swept.where(F.col("kind") == Sweep.REOPEN).join(sized.select("conv", "box", "path"), "conv")
        tail = F.reverse("tail")
        box = F.md5(F.concat("box", F.lit("/"), F.col("depth").cast("string"), F.lit("/"), F.col("parent").cast("string")))
        again = again.select("conv", "length", box.alias("box"), F.col("depth").alias("floor"), F.concat("path", tail).alias("path"))
        return swept, alone, totals, again

    def chains(self, alone: DataFrame) -> DataFrame:
        """The nodes of each conversation from where it is alone: one of its turns each."""
        depth = F.col("pos") + 1
        rows = alone.join(self.turns, "conv").where(depth >= F.col("depth"))
        last = depth == F.col("length")
        parent = F.when(depth == F.col("depth"), F.col("parent")).otherwise(F.col("conv"))
        one, ends = F.lit(1).cast("bigint"), F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(NO_END))
        return rows.select(
            F.col("conv").alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"),
            one.alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), ends.alias("ends_sha256"),
        )

    def nodes(self) -> DataFrame:
        boxed, ended, heads, children = self.burst()
        ended = self.keep(ended, "ended")
        paths = boxed.select("conv", "path").unionByName(ended)
        swept, alone, totals = [], [], []
        while True:
            s, a, t, boxed = self.sweep_round(boxed)
            swept.append(s)
            alone.append(a)
            totals.append(t)
            if s.where(F.col("kind") == Sweep.REOPEN).isEmpty():
                break
        union = DataFrame.unionByName
        swept, alone, totals = reduce(union, swept), reduce(union, alone), reduce(union, totals)
        single = swept.where(F.col("kind") == Sweep.ALONE).select("conv", "depth", "parent", "length")
        chains = self.chains(alone.unionByName(single))
        inner = swept.where(F.col("kind") == Sweep.NODE).select(
            F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"), "open",
        )
        # Heads: what they add themselves goes to themselves and all above, like the totals of containers.
        heads = heads.join(children.withColumnRenamed("above", "key"), "key", "left").fillna(0, ["n_children"])
        mine = paths.withColumnRenamed("conv", "head")
        heads = heads.join(mine, "head").withColumn("path", F.slice("path", 1, (F.col("depth") + 1).cast("int")))
        heads = self.keep(heads, "heads")
        own = heads.select("path", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved"))
        # Containers under one head share its path: added up before paths are opened.
        summed = totals.unionByName(own).groupBy("path").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        down = summed.select("leaves", "saved", F.posexplode("path").alias("depth", "conv_id"))
        down = down.groupBy("conv_id", F.col("depth").cast("bigint").alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        at = ended.select(F.element_at("path", -1).alias("conv_id"), (F.size("path") - 1).cast("bigint").alias("depth"), F.col("conv").alias("member"))
        zero, above = F.lit(0).cast("bigint"), F.get("path", (F.col("depth") - 1).cast("int"))
        top = heads.select(
            F.col("head").alias("conv_id"), "depth", F.when(F.col("depth") > 0, above).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", zero.alias("n_leaves"), zero.alias("saved_tokens"),
        )
        top = top.join(digests(at), ["conv_id", "depth"], "left").fillna(NO_END, ["ends_sha256"])
        names = [c.split()[0] for c in NODE.split(", ")]
        part = top.select(*names).unionByName(inner.where("open").select(*names))
        part = part.join(down, ["conv_id", "depth"], "left").fillna(0, ["more_leaves", "more_saved"])
        part = part.withColumn("n_leaves", F.col("n_leaves") + F.col("more_leaves")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("more_saved"))
        return part.select(*names).unionByName(inner.where("not open").select(*names)).unionByName(chains.select(*names))


def conversation_trie(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int = LIMIT, window: int = WINDOW, more_levels: int = MORE_LEVELS
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, as ``NODE`` names them."""
    spark = df.sparkSession
    turns, at_turns = written(numbered_turns(df, conv, turn, role, text), "turns")
    long, convs = rebuilt(turns)
    (long, at_long), (convs, at_convs) = written(long, "rebuilt"), written(convs, "lengths")
    if convs.isEmpty():
        nodes = spark.createDataFrame([], NODE)
        trie = None
    else:
        trie = BurstTrie(long, convs, limit, window, more_levels)
        nodes = written(trie.nodes(), "nodes")[0]
    for path in [at_turns, at_long, at_convs, *(trie.paths if trie else [])]:
        drop_written(spark, path)
    return nodes
