"""The trie of all conversations' turns: ternary search trees over range shards, merged along their boundaries.

Turns, as pairs of role and text, get numbers from a dictionary, and a conversation is its array of numbers, cut into
blocks of BLOCK turns: a block goes with the fingerprint of what is before it. Equal blocks are counted first and sorted
by range, so a shard holds a contiguous range. A shard's blocks go, the middle one first, into a ternary search tree:
within a level of the trie, turns form a balanced binary tree. Nodes are then walked from the last made to the first, so
children add their members, leaves and savings to their parents. Nodes on the way to a shard's first and last block may
go on in a neighbour: they stay open, and are merged when the part, and then the table, is complete. There are at most
two open nodes per level, part and prefix. Blocks behind others are done before them, and give their sums to the node
that they go on from; rounds grow with the longest conversation's turns / BLOCK, so nearly always there is one.

Results that are defined: rows with a null conv_id belong to no conversation; turns with equal numbers go by role, then
text; equal rows are turns of their own; a negative conv_id's remainder has its sign; other columns play no part. No
conversations give no nodes.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, text_of
from lodestone.ordering import in_order
from lodestone.skew import join_split

BLOCK = 1 << 14
#: Turns in one search tree.
SHARD = 1 << 17
#: Fixed values of the planted first turns: conversations share those of the first of their hundred, up to five of them.
HUNDRED, HEADS = 100, 6

NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
KEYS = "f string, key string, parent_key string, chars long, open boolean"


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, id, chars) of all turns, (conv, n)): places within conversations, and numbers from the dictionary."""
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    placed = materialize(in_order(rows, "conv", "turn", "role", "text").select("conv", "place", key.alias("key"), F.length("text").cast("long").alias("chars")), "turns")
    convs = materialize(placed.groupBy("conv").agg(F.min("place").alias("first"), F.count("*").alias("n")), "conversations")
    dictionary = materialize(in_order(placed.select("key").distinct(), "key", place="id"), "dictionary")
    rows = join_split(materialize(join_split(placed, dictionary, "key"), "turns"), convs.select("conv", "first"), "conv")
    return materialize(rows.select("conv", (F.col("place") - F.col("first")).alias("pos"), "id", "chars"), "turns"), convs.select("conv", "n")


def rebuilt(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns() after the first h turns of each conversation are those of the first conversation of its hundred."""
    base, h = F.col("conv") - F.col("conv") % HUNDRED, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    plan = convs.select("conv", "n", base.alias("base"), h.alias("h")).join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    plan = materialize(plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))), "plan")
    heads = rows.where((F.col("conv") % HUNDRED == 0) & (F.col("pos") < HEADS - 1)).withColumnRenamed("conv", "base")
    heads = heads.join(plan.select("base", "conv", "h"), "base").where("pos < h").select("conv", "pos", "id", "chars")
    own = join_split(rows, plan.select("conv", "h", "k"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id", "chars")
    return heads.unionByName(own), plan.select("conv", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def sequences(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Different blocks of turns: b (which block), f (what is before it), next (what is before the one behind it), ids, chars, n (members), low (least conv), ends (SHA-256 of
    the conversations that end in it, or null). The last block of a conversation is shorter than `block`, and may be empty."""
    end = convs.select("conv", F.col("n").alias("pos"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("chars"))
    at = F.floor(F.col("pos") / block).cast("int").alias("b")
    blocks = rows.unionByName(end).groupBy("conv", at).agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id", "chars")))).alias("t"), F.bool_or(F.col("id").isNull()).alias("last"))
    blocks = blocks.select("conv", "b", "last", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["chars"]).alias("chars"))
    # Hashes of numbered blocks add up, so a prefix needs no array of its own; sums of this size do not overflow.
    upto = W.partitionBy("conv").orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    sums = [F.sum(F.xxhash64(F.lit(i), "b", "ids").cast("decimal(38,0)")).over(upto).cast("string") for i in range(2)]
    blocks = blocks.withColumn("next", F.concat_ws("_", *sums))
    blocks = blocks.withColumn("f", F.coalesce(F.lag("next").over(W.partitionBy("conv").orderBy("b")), F.lit("")))
    skey = F.sha2(F.concat_ws(",", "b", "f", F.col("ids").cast("array<string>")).cast("binary"), 256)
    blocks = materialize(blocks.withColumn("skey", skey), "blocks")
    same = blocks.groupBy("skey").agg(*[F.first(c).alias(c) for c in ("b", "f", "next", "ids", "chars")], F.count("*").alias("n"), F.min("conv").alias("low"))
    return materialize(same.join(ends(blocks.where("last")), "skey", "left").drop("skey"), "sequences")


def ends(rows: DataFrame) -> DataFrame:
    """(skey, ends): the SHA-256 of the numbers conv of each skey, in order with commas. Numbers come in pieces of up to 65536, one after the other."""
    piece = F.shiftright("conv", 16).alias("piece")
    pieces = rows.groupBy("skey", piece).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("s"))

    def run(batches):
        key, digest = None, None
        for batch in batches:
            done = []
            for k, s in zip(batch.column("skey").to_pylist(), batch.column("s").to_pylist(), strict=True):
                if k == key:
                    digest.update(b"," + s.encode())
                    continue
                if key is not None:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(s.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], names=["skey", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["skey", "ends"])

    return pieces.repartition("skey").sortWithinPartitions("skey", "piece").select("skey", "s").mapInArrow(run, "skey string, ends string")


class Node:
    """What is known of a node: n members, the least one, and the sums of its closed children."""

    __slots__ = ("depth", "chars", "n", "low", "kids", "leaves", "saved", "ends", "parent", "key")

    def __init__(self, depth, chars, parent, key=None):
        self.depth, self.chars, self.parent, self.key = depth, chars, parent, key
        self.n, self.low, self.kids, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None

    def count(self, n: int, low: int) -> None:
        self.n += n
        self.low = low if self.low is None else min(self.low, low)

    def add(self, kids: int, leaves: int, saved: int, ends: str | None) -> None:
        self.kids, self.leaves, self.saved, self.ends = self.kids + kids, self.leaves + leaves, self.saved + saved, self.ends or ends

    def close(self) -> None:
        self.leaves = self.leaves if self.kids else 1
        self.saved += (self.n - 1) * self.chars


class TernaryTree:
    """A trie whose children of a node are a binary search tree by turn id: lower, equal (the node's own children) and higher."""

    def __init__(self):
        self.ids, self.lower, self.higher, self.equal = [None], [0], [0], [0]
        self.nodes = [Node(0, 0, None)]

    def child(self, at: int, turn: int, chars: int) -> int:
        """The child of node `at` for the turn, made where there is none."""
        ids, links, k = self.ids, self.equal, at
        while links[k]:
            k = links[k]
            if ids[k] == turn:
                return k
            links = self.lower if turn < ids[k] else self.higher
        new = links[k] = len(ids)
        ids.append(turn)
        for more in (self.lower, self.higher, self.equal):
            more.append(0)
        self.nodes.append(Node(self.nodes[at].depth + 1, chars, self.nodes[at]))
        return new

    def insert(self, row: tuple) -> None:
        ids, chars, n, low, end, kids, leaves, saved = row
        at = 0
        self.nodes[0].count(n, low)
        for turn, size in zip(ids, chars, strict=True):
            at = self.child(at, turn, size)
            self.nodes[at].count(n, low)
        self.nodes[at].add(kids, leaves, saved, end)

    def way(self, ids: list[int], f: str) -> list[Node]:
        """The nodes of a sequence, from the root on; each gets the key under which other shards know it."""
        digest, at, out = hashlib.blake2b(f.encode(), digest_size=16), 0, [self.nodes[0]]
        self.nodes[0].key = f"0 {digest.hexdigest()}"
        for depth, turn in enumerate(ids):
            at = self.child(at, turn, 0)
            digest.update(turn.to_bytes(8, "little", signed=True))
            self.nodes[at].key = f"{depth + 1} {digest.hexdigest()}"
            out.append(self.nodes[at])
        return out


def balanced(rows: list[tuple]) -> TernaryTree:
    """The tree of sorted rows, the middle one first, then those of both halves."""
    tree, todo = TernaryTree(), deque([(0, len(rows))])
    while todo:
        a, b = todo.popleft()
        if a < b:
            mid = (a + b) // 2
            tree.insert(rows[mid])
            todo += [(a, mid), (mid + 1, b)]
    return tree


def closed(nodes: list[Node], open_: set, f: str) -> list[tuple]:
    """Rows of the nodes that are not open, children before parents; each adds what it has to its parent. A parent that is open is named by its key."""
    out = []
    for x in nodes:
        if x.key is not None and x.key in open_:
            continue
        x.close()
        p = x.parent
        known = p is None or p.key is None or p.key not in open_
        out.append((x.depth, x.low, p.low if p and known else None, x.n, x.kids, x.leaves, x.saved, x.ends, f, x.key, None if known else p.key, x.chars, False))
        if p is not None:
            p.add(1, x.leaves, x.saved, None)
    return out


def _merged(known: dict[str, Node], x: Node) -> None:
    """Adds an open node to those of the same key."""
    mine = known.setdefault(x.key, x)
    if mine is not x:
        mine.count(x.n, x.low)
        mine.add(x.kids, x.leaves, x.saved, x.ends)
    if x.parent is not None:
        mine.parent = known[x.parent.key]


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 4 + [pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


NAMES = [c.split()[0] for c in f"{NODE}, {KEYS}".split(", ")]


def shard_nodes(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """Nodes of each part of the sorted rows (f, ids, chars, n, low, ends, kids, leaves, saved): closed ones, and open ones (`open`) with their partial sums."""
    dealt = rows.select("f", "ids", "chars", "n", "low", "ends", "kids", "leaves", "saved").repartitionByRange("f", "ids").sortWithinPartitions("f", "ids")

    def part(f, groups):
        """The shards of one prefix."""
        known, first, last = {}, None, None
        for group in groups:
            tree = balanced(group)
            ways = [tree.way(group[0][0], f), tree.way(group[-1][0], f)]
            first, last = first or {x.key for x in ways[0]}, {x.key for x in ways[1]}
            open_ = {x.key for way in ways for x in way}
            yield closed(tree.nodes[::-1], open_, f)
            for x in sorted({id(x): x for way in ways for x in way}.values(), key=lambda x: x.depth):
                _merged(known, x)
        open_ = first | last
        yield closed(sorted(known.values(), key=lambda x: -x.depth), open_, f)
        yield [(x.depth, x.low, None, x.n, x.kids, x.leaves, x.saved, x.ends, f, x.key, x.parent.key if x.parent else None, x.chars, True) for k, x in known.items() if k in open_]

    def run(batches):
        def groups():
            """(f, rows of one shard)."""
            f, group, size = None, [], 0
            for batch in batches:
                for now, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if group and (now != f or size >= shard):
                        yield f, group
                        group, size = [], 0
                    f, size = now, size + len(row[0]) + 1
                    group.append(tuple(row))
            if group:
                yield f, group

        for f, same in itertools.groupby(groups(), key=lambda x: x[0]):
            for out in part(f, (g for _, g in same)):
                if out:
                    yield _rows(out, NAMES)

    return dealt.mapInArrow(run, f"{NODE}, {KEYS}")


def merged_nodes(open_: DataFrame) -> DataFrame:
    """The open nodes of all parts, merged by key and closed. A prefix has at most two per level and part."""

    def run(batches):
        def close(f, rows):
            known: dict[str, Node] = {}
            for r in sorted(rows, key=lambda r: r["depth"]):
                x = Node(r["depth"], r["chars"], known[r["parent_key"]] if r["parent_key"] is not None else None, r["key"])
                x.count(r["n_convs"], r["conv_id"])
                x.add(r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"])
                _merged(known, x)
            return closed(sorted(known.values(), key=lambda x: -x.depth), set(), f)

        f, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["f"] != f and rows:
                    yield _rows(close(f, rows), NAMES)
                    rows = []
                f = r["f"]
                rows.append(r)
        if rows:
            yield _rows(close(f, rows), NAMES)

    return open_.repartition("f").sortWithinPartitions("f").mapInArrow(run, f"{NODE}, {KEYS}")


def level(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """All nodes of one block number: NODE, and f."""
    found = materialize(shard_nodes(rows, shard), "nodes")
    tops = materialize(merged_nodes(found.where("open")), "nodes")
    names = [c.split()[0] for c in NODE.split(", ")]
    done = found.where("NOT open")
    lows = done.unionByName(tops).where("key IS NOT NULL").select(F.concat("f", F.lit(" "), "key").alias("up"), F.col("conv_id").alias("up_conv"))
    hanging = materialize(done.where("parent_key IS NOT NULL").withColumn("up", F.concat("f", F.lit(" "), "parent_key")), "nodes")
    hanging = join_split(hanging, lows, "up").withColumn("parent_conv_id", F.col("up_conv"))
    return done.where("parent_key IS NULL").unionByName(tops).select(*names, "f").unionByName(hanging.select(*names, "f"))


def prefix_trie(conversations: DataFrame, block: int = BLOCK, shard: int = SHARD, rebuild: bool = True) -> DataFrame:
    """One row per node: NODE. conversations: conv_id, turn, role, text. rebuild: whether the first turns of each hundred are planted first."""
    rows, convs = turns(conversations)
    if rebuild:
        rows, convs = rebuilt(rows, convs)
    blocks = sequences(rows, convs, block)
    zero = F.lit(0).cast("long")
    out, below = None, None
    for b in range(blocks.agg(F.max("b")).first()[0] or 0, -1, -1):
        now = blocks.where(F.col("b") == b)
        now = now.select("*", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved")) if below is None else _with_below(now, below)
        nodes = materialize(level(now, shard), "level")
        here = nodes.where("depth > 0" if b else "true").withColumn("depth", F.col("depth") + b * block).drop("f")
        out = here if out is None else out.unionByName(here)
        below = nodes.where("depth = 0").select(F.col("f").alias("at"), F.col("n_children").alias("kids"), F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(0).alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("ends").alias("end"))
    return out


def _with_below(rows: DataFrame, below: DataFrame) -> DataFrame:
    """rows with the sums of the blocks that go on from them."""
    zero = F.lit(0).cast("long")
    rows = rows.join(below.withColumnRenamed("at", "next"), "next", "left")
    return rows.withColumns({"ends": F.coalesce("ends", "end"), **{c: F.coalesce(c, zero) for c in ("kids", "leaves", "saved")}})
