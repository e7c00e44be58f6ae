"""Near copies by the Jaccard similarity of word shingles, besides those of equal or close SimHash fingerprints.

Two texts link when their sets of five-word shingles have a Jaccard similarity of 0.8 or more, or when their fingerprints
link (simhash.py). Candidates share a band of a MinHash signature: with 32 bands of 4, a pair at 0.8 is missed with
probability (1 - 0.8^4)^32 < 5e-8, a more similar one less often. Pairs whose texts already belong to one component are
not compared. With sizes a and b and d elements in one set only, the similarity is 0.8 or more just if 9 d <= a + b, so

1. in each bucket of a band, bitmaps of the sets are compared: the bits in which they differ are no more than d, so a
   bound that fails settles the pair. What is left connects texts to clusters; a bucket sends on a spanning forest;
2. in each cluster, the sets themselves are compared, each text being there once, and a pair only if no link that was
   found connects it already.

No text is joined to a pair. Buckets and clusters that are large are cut into slices, and each pair of slices is a task
of bounded size. A text is known by its MD5, an element of a set by its 64-bit hash.
Words are those of the fingerprints; a text of up to five words is one shingle, one without a word has none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import simhash
from lodestone.llm.common import as_row, likely, materialize, unused
from lodestone.llm.components import connected_components
from lodestone.skew import join_split

SIZE, LEAST, BANDS, ROWS = 5, 0.8, 32, 4
_RNG = np.random.default_rng(simhash.SEED)
FACTORS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
#: A slice has about so many texts and bytes at most.
SLICE_ROWS, SLICE_BYTES = 1024, 1 << 25


def shingles(text: str | None, size: int = SIZE) -> set[bytes]:
    words = (text or "").encode("utf-8", "replace").translate(simhash.LOWER).split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def hashes(text: str | None, size: int = SIZE) -> np.ndarray:
    """The different shingles' hashes, sorted."""
    found = shingles(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, simhash.SEED) for s in found), np.uint64, len(found)))


def bands(found: np.ndarray) -> list[int]:
    """One signed hash per band of the MinHash signature; none for a text without a word."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[i : i + 1024, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), i)).view(np.int64)) for i, r in enumerate(rows)]


def bitmap(found: np.ndarray) -> np.ndarray:
    """Which of the lowest bits of the hashes occur: 8 to 16 places for each element, 1024 at least, as 64-bit words."""
    places = max(1024, 1 << (8 * len(found) - 1).bit_length())
    bits = np.zeros(places, np.uint8)
    bits[(found & np.uint64(places - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def fold(words: np.ndarray) -> np.ndarray:
    """Bitmaps (in the last axis) of half as many places."""
    half = words.shape[-1] // 2
    return words[..., :half] | words[..., half:]


def with_prints(df: DataFrame, text: str, size: int = 4) -> DataFrame:
    """df's columns but for the text, the fingerprint fp and the bands."""
    keep = [f for f in df.schema.fields if f.name != text]
    rows = df.select(*[F.col(f"`{f.name}`") for f in keep], F.col(text).alias(unused(df, "_text")))

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.columns[-1]]
            fps = np.fromiter((simhash.fingerprint(t, size) for t in texts), np.uint64, len(texts)).view(np.int64)
            found = [bands(hashes(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps), pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "fp", "bands"])

    return rows.mapInArrow(run, T.StructType([*keep, T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))


def with_sets(texts: DataFrame) -> DataFrame:
    """(h, bitmap, hashes) for texts (h, text)."""

    def run(batches):
        for batch in batches:
            found = [hashes(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([len(x) for x in found], pa.int64()), pa.array([bitmap(x).tobytes() for x in found], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary())], names=["h", "n", "bitmap", "hashes"])

    return texts.select("h", "text").mapInArrow(run, "h binary, n long, bitmap binary, hashes binary")


class Unions:
    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def join(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def possible(labels: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j < i of other labels that the bitmaps do not tell to be unlike i)."""
    places = np.array([len(m) for m in maps])
    blocks = {}
    for p in np.unique(places):
        rows = np.flatnonzero(places == p)
        blocks[p] = rows, np.stack([maps[r] for r in rows])
    halves = {p: fold(m) for p, (_, m) in blocks.items()}
    for i, mine in enumerate(maps):
        p, out = len(mine), []
        # Similar sets have at most one doubling of places between them.
        for q, one, other in ((p, mine, None), (2 * p, mine, halves.get(2 * p)), (p // 2, None, None)):
            if q not in blocks:
                continue
            rows, whole = blocks[q]
            rows = rows[: np.searchsorted(rows, i)]
            rows_ok = np.flatnonzero((labels[rows] != labels[i]) & (5 * np.minimum(sizes[rows], sizes[i]) >= 4 * np.maximum(sizes[rows], sizes[i])))
            if not len(rows_ok):
                continue
            one = fold(mine) if one is None else one
            differ = np.bitwise_count((whole if other is None else other)[rows_ok] ^ one).sum(axis=1, dtype=np.int64)
            rows = rows[rows_ok]
            out.append(rows[9 * differ <= sizes[rows] + sizes[i]])
        if out:
            yield i, np.concatenate(out)


def forest(labels: np.ndarray, sizes: np.ndarray, data: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the possible pairs. data: bitmaps."""
    known = Unions()
    return [(i, int(j)) for i, found in possible(labels, sizes, [np.frombuffer(x, "<u8") for x in data]) for j in found if known.join(i, int(j))]


def similar_pairs(labels: np.ndarray, sizes: np.ndarray, data: list[bytes]) -> list[tuple[int, int]]:
    """Similar pairs that connect labels as all similar pairs do. data: hashes."""
    known, sets = Unions(), [np.frombuffer(x, "<u8") for x in data]
    out = []
    for i, found in possible(labels, sizes, [bitmap(s) for s in sets]):
        for j in map(int, found):
            a, b = int(labels[i]), int(labels[j])
            if known.find(a) == known.find(b):
                continue
            total = len(sets[i]) + len(sets[j])
            if 9 * (total - 2 * len(np.intersect1d(sets[i], sets[j], assume_unique=True))) <= total:
                known.join(a, b)
                out.append((i, j))
    return out


def in_groups(rows: DataFrame, key: str, data: str, name: str, find: Callable) -> DataFrame:
    """(a, b): what find puts out for the rows (key, name, label, n, data) of each key, as names. Large groups go in pairs of slices."""
    size = rows.groupBy(key).agg(F.count("*").alias("rows"), F.sum(F.octet_length(data)).alias("bytes"))
    of: Column = F.greatest(F.ceil(F.col("rows") / SLICE_ROWS), F.ceil(F.col("bytes") / SLICE_BYTES)).cast("int")
    rows = join_split(rows, size.select(key, of.alias("of")), key)
    mine = F.pmod(F.xxhash64(name), F.col("of")).cast("int")
    placed = rows.withColumn("slice", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    placed = placed.select(key, F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"), name, "label", "n", data)
    shard = [key, "lo", "hi"]
    kind = rows.schema[name].dataType

    def run(batches):
        now, group = None, []
        for batch in batches:
            for *at, who, label, n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    if len(group) > 1:
                        yield from pairs(group)
                    now, group = at, []
                group.append((who, label, n, x))
        if len(group) > 1:
            yield from pairs(group)

    def pairs(group):
        who, label, n, x = zip(*group, strict=True)
        if len(set(label)) > 1 and (found := find(np.array(label), np.array(n), x)):
            side = [pa.array([who[p[i]] for p in found]) for i in range(2)]
            yield pa.RecordBatch.from_arrays(side, names=["a", "b"])

    return placed.repartition(*shard).sortWithinPartitions(*shard).mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def similarity_links(keyed: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): fingerprints of similar texts that connect what edges leave apart. keyed: key, h, fp; texts: h, text."""
    labels = materialize(connected_components(edges).withColumnRenamed("node", "fp"), "labels")
    rows = join_split(keyed, labels, "fp", "left").select("key", "h", "fp", F.coalesce("label", "fp").alias("label"))
    rows = materialize(rows, "buckets")
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rows = materialize(join_split(rows, mixed.withColumn("mixed", F.lit(1)), "key").drop("mixed"), "buckets")
    wanted = materialize(rows.select("h").distinct(), "wanted")
    sets = materialize(with_sets(likely(texts, wanted, ["h"]).groupBy("h").agg(F.first("text").alias("text")).join(wanted, "h", "left_semi")), "sets")
    possible_ = in_groups(materialize(rows.join(sets.select("h", "n", "bitmap"), "h"), "buckets"), "key", "bitmap", "h", forest)
    clusters = connected_components(materialize(possible_.distinct(), "possible"))
    who = rows.select("h", "fp", "label").dropDuplicates(["h"])
    members = clusters.select(F.col("node").alias("h"), F.col("label").alias("cluster")).join(who, "h").join(sets.select("h", "n", "hashes"), "h")
    return in_groups(materialize(members, "clusters"), "cluster", "hashes", "fp", similar_pairs)


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df, one of each component: the one with the least id (and hash of its text, where ids repeat)."""
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("hash"))
    prints = materialize(with_prints(df.select(F.col(text), key.alias("_key")), text), "fingerprints")
    edges = materialize(simhash.fingerprint_links(prints.select("fp").distinct()), "links")
    sets = prints.select(F.col("_key.hash").alias("h"), "fp", "bands").dropDuplicates(["h"])
    keyed = materialize(sets.select("h", "fp", F.explode("bands").alias("key")), "bands")
    more = materialize(similarity_links(keyed, edges, df.select(digest.alias("h"), F.col(text).alias("text"))), "links")
    keys = simhash.named(prints.drop("bands"), "_key", edges.unionByName(more)).select(F.col("component_id").alias("_key")).distinct()
    rows = df.select(as_row(df).alias("row"), key.alias("_key")).join(keys, "_key", "left_semi")
    return rows.dropDuplicates(["_key"]).select("row.*")
