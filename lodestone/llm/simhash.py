"""SimHash near-duplicates: Burkhard-Keller trees over shards of fingerprints.

A fingerprint has one bit per bit position of the shingles' hashes: set where more than half of the hashes have it. Two
fingerprints link when at most `radius` bits differ. With the 64 bits in radius + d blocks, linked fingerprints agree
in at least d blocks, so each different fingerprint goes to one shard for every choice of d blocks, named by its bits
there: a pair that links meets in some shard, and shards of unrelated texts stay small. In a shard, the fingerprints
form a tree whose edges carry the Hamming distance to the parent; a search enters only edges within the radius, and
skips subtrees whose nodes already belong to its own component. A shard sends on one edge per linked fingerprint, to
the least one of its component, so groups of copies never become pairs.

A tree over all fingerprints would have to be broadcast and grows with the corpus; shards are therefore dealt out by
key. Shards beyond SHARD_ROWS are cut into slices, and every pair of slices is a task of its own.

Null and empty texts, and texts without a word, have fingerprint zero. A repeated id is allowed: rows keep their own
fingerprints. Null ids never become a component's id unless it has no other.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_row, materialize, unused
from lodestone.llm.components import connected_components
from lodestone.skew import join_split

BITS, RADIUS, SEED = 64, 4, 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A shard with more fingerprints is cut into slices of about this many.
SHARD_ROWS = 4096
#: Unrelated fingerprints that a shard is to hold on average at most.
SHARD_MEAN = 8


def fingerprint(text: str | None, size: int = 4) -> int:
    # bytes.split() takes exactly the white space of the contract.
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    # Bits are counted in bounded pieces, so the longest text needs no more memory than its words.
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        piece = np.array(hashes[i : i + 65536], dtype="<u8")
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fp", size: int = 4) -> DataFrame:
    """df's columns but for the text, and the fingerprint as a signed 64-bit number."""
    keep = [f for f in df.schema.fields if f.name not in (text, out)]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias(unused(df, "_text")))

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in batch.columns[-1]), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps)], names=[*batch.schema.names[:-1], out])

    return rows.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.LongType())]))


class BkTree:
    """A Burkhard-Keller tree under the Hamming distance that also keeps the components of its links."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.mixed: list[bool] = []
        self.parent: list[int] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _node(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        self.mixed.append(False)
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def link(self, value: int, radius: int) -> int:
        """A new node, joined with everything in the tree within the radius."""
        me = self._node(value)
        values, children, mixed, find = self.values, self.children, self.mixed, self.find
        todo = [0] if me else []
        while todo:
            v = todo.pop()
            d = (values[v] ^ value).bit_count()
            if d <= radius:
                a, b = find(v), find(me)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            below = children[v]
            if below and (mixed[v] or find(v) != find(me)):
                todo += [c for e, c in below.items() if d - radius <= e <= d + radius]
        return me

    def hang(self, value: int, me: int) -> None:
        """Puts a linked node into the tree; its ancestors note if their subtree is no longer of one component."""
        if me == 0:
            return
        v, mine = 0, self.find(me)
        while True:
            if self.find(v) != mine:
                self.mixed[v] = True
            d = (self.values[v] ^ value).bit_count()
            if d not in self.children[v]:
                self.children[v][d] = me
                return
            v = self.children[v][d]


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges (fingerprint, least fingerprint of its component in this shard)."""
    tree = BkTree()
    for v in values:
        tree.hang(v, tree.link(v, radius))
    groups: dict[int, list[int]] = {}
    for i in range(len(values)):
        groups.setdefault(tree.find(i), []).append(values[i])
    return [(v, least) for g in groups.values() if len(g) > 1 for least in [min(g)] for v in g if v != least]


def masks(blocks: int, shared: int) -> list[int]:
    """For each choice of `shared` of the blocks: the mask of their bits, as a signed number."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    whole = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in range(blocks)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in itertools.combinations(whole, shared)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The least number of blocks, of radius + 2 or more, for which n evenly spread fingerprints give small shards."""
    blocks = radius + 2
    while n > SHARD_MEAN * 2 ** (BITS * (blocks - radius) / blocks) and blocks < 16:
        blocks += 1
    return blocks


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): edges between different fingerprints whose components are those of all links. fps: different values in `fp`."""
    blocks = blocks_for(fps.count(), radius)
    choices = masks(blocks, blocks - radius)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(choices)])).alias("s")).select("fp", "s.*")
    # Shards with one fingerprint have no link; large ones are sliced.
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    n_slices = F.ceil(F.col("n") / shard_rows).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("of")).cast("int")
    placed = keyed.join(sizes.select("choice", "key", n_slices.alias("of")), ["choice", "key"]).withColumn("slice", mine)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    placed = placed.select("choice", "key", F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"), "fp")
    shard = ["choice", "key", "lo", "hi"]
    dealt = placed.repartition(*shard).sortWithinPartitions(*shard)

    def run(batches):
        left = None  # the last shard of a batch may go on in the next one
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                cols = [np.asarray(batch.column(i)) for i in range(5)]
                cols = [np.concatenate([a, b]) for a, b in zip(left, cols, strict=True)] if left else cols
            else:
                cols = left
            if not cols or not len(cols[0]):
                continue
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            done = len(at) if batch is None else len(at) - 1
            bounds = np.append(at, len(cols[0]))
            out = []
            for i in np.flatnonzero(np.diff(bounds)[:done] > 1):
                s, e = bounds[i], bounds[i + 1]
                out += shard_links(cols[4][s:e].view(np.uint64).tolist(), radius)
            left = None if batch is None else [c[bounds[done] :] for c in cols]
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = 4) -> DataFrame:
    """One row per row of df: id, fp (signed) and component_id, the least id that links reach, its own included."""
    prints = materialize(with_fingerprint(df.select(F.col(id_col), F.col(text)), text, "fp", size), "fingerprints")
    return with_component(prints, id_col, radius)


def with_component(prints: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    least = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    return _named(prints, least, materialize(fingerprint_links(least.select("fp"), radius), "links"))


def named(prints: DataFrame, id_col: str, edges: DataFrame) -> DataFrame:
    """prints with component_id, for given edges (a, b) between fingerprints."""
    return _named(prints, materialize(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints"), edges)


def _named(prints: DataFrame, least: DataFrame, edges: DataFrame) -> DataFrame:
    labels = connected_components(edges).withColumnRenamed("node", "fp")
    linked = materialize(labels.join(least, "fp"), "labels")
    named = join_split(linked, linked.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("fp", "component_id")
    component = materialize(least.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "labels")
    return join_split(prints, component, "fp").select(*prints.columns, "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, size: int = 4) -> DataFrame:
    """The rows of df, one of each component: the one with the least id (and hash of its text, where ids repeat)."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    prints = materialize(with_fingerprint(df.select(F.col(text), key.alias("_key")), text, "fp", size), "fingerprints")
    keys = with_component(prints, "_key", radius).select(F.col("component_id").alias("_key")).distinct()
    return df.select(as_row(df).alias("row"), key.alias("_key")).join(keys, "_key", "left_semi").dropDuplicates(["_key"]).select("row.*")
