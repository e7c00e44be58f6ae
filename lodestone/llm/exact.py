"""Exact duplicates: composable polynomial fingerprints, and a comparison of the texts in chunks where these are equal.

A text is normalised (runs of white space become one space) and read as bytes. A chunk's fingerprint is its value as a
polynomial at two points, modulo a prime each; that of two chunks together is first * point^length + second, so chunks
may be hashed anywhere in any order. Texts over HUGE bytes are cut once into a table of chunks, which are hashed in
parallel and combined; shorter ones are hashed where they are.

Texts with equal length and fingerprint are candidates. Their chunks are dealt out by fingerprint, sorted by place and
compared as they stream by: texts stay together as long as their chunks are equal, so no more than one chunk of each is
held, and texts that only share the fingerprint part. A fingerprint of more than GROUP rows is cut into slices that all
get the text of its least row; rows that differ from it (a shared fingerprint of different texts) go on to another round
with other points.

Results that are defined: a null text is empty; a null id is larger than any other; of rows that are equal in id and
text, one is kept. Columns besides id and text are left out. No rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import SPACE, materialize, text_of
from lodestone.skew import join_split

CHUNK, HUGE, GROUP = 1 << 16, 1 << 20, 256
#: At most so many fingerprints are of more rows than a task compares at once, and are broadcast.
MOST_SPLIT = 65536
#: A fixed-size set of hashed fingerprints tells most single texts from candidates before they are shuffled.
BUCKETS = 1 << 20
#: Two primes below 2^31, so that products and sums of a chunk stay below 2^63.
PRIMES = (2**31 - 1, 2**31 - 19)


def points(salt: int) -> tuple[int, ...]:
    """The two points of a round."""
    digest = hashlib.sha256(f"point {salt}".encode()).digest()
    return tuple(int.from_bytes(digest[8 * i : 8 * i + 8], "little") % (p - 3) + 2 for i, p in enumerate(PRIMES))


class Fingerprint:
    """Fingerprints of byte strings as (length, value, value)."""

    def __init__(self, salt: int = 0, primes: tuple[int, ...] = PRIMES, size: int = CHUNK):
        self.size = size
        self.primes, self.points = primes, [x % p for x, p in zip(points(salt), primes, strict=True)]
        self.powers = []
        for x, p in zip(self.points, primes, strict=True):
            row = np.ones(size, np.int64)
            n = 1
            while n < size:  # doubles the part that is done
                row[n : 2 * n] = row[: size - n][:n] * pow(x, n, p) % p
                n *= 2
            self.powers.append(row[::-1].copy())

    def chunk(self, data: bytes) -> tuple[int, ...]:
        values = np.frombuffer(data, np.uint8).astype(np.int64) + 1
        return (len(data), *(int(np.dot(values, row[self.size - len(data) :]) % p) for row, p in zip(self.powers, self.primes, strict=True)))

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        return (a[0] + b[0], *((h * pow(x, b[0], p) + k) % p for h, k, x, p in zip(a[1:], b[1:], self.points, self.primes, strict=True)))

    def whole(self, data: bytes) -> tuple[int, ...]:
        out = (0, 0, 0)
        for i in range(0, len(data), self.size):
            out = self.join(out, self.chunk(data[i : i + self.size]))
        return out


def normal(data: bytes | None) -> bytes:
    """Runs of white space as one space. bytes.split() takes exactly the white space of the contract."""
    data = data or b""
    words = data.split()
    if not words:
        return b" " if data else b""
    edge = lambda at: b" " if data[at : at + 1 or None].isspace() else b""
    return edge(0) + b" ".join(words) + edge(-1)


def _texts(batch, at: int):
    return (normal(x.as_py()) for x in batch.column(at).cast(pa.binary()))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


FP = ["n_bytes", "h1", "h2"]
PRINT = [T.StructField(n, T.LongType()) for n in FP]
SHA = T.StructField("sha", T.BinaryType())


def with_prints(df: DataFrame, print_: Fingerprint) -> DataFrame:
    """(id, data, n_bytes, h1, h2) for each row of df (id, text): the normalised text and its fingerprint."""

    def run(batches):
        for batch in batches:
            texts = list(_texts(batch, 1))
            if texts:
                found = zip(*map(print_.whole, texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), *(pa.array(c, pa.int64()) for c in found)], names=["id", "data", *FP])

    return df.mapInArrow(run, T.StructType([df.schema["id"], T.StructField("data", T.BinaryType()), *PRINT]))


def cut(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """(id, sha, copy, i, piece): the chunks of each text of df (id, text), normalised; copy tells rows apart that are equal in id and text."""
    schema = T.StructType([df.schema["id"], SHA, T.StructField("copy", T.StringType()), T.StructField("i", T.LongType()), T.StructField("piece", T.BinaryType())])

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for j, t in enumerate(_texts(batch, 1)):
                sha, row = hashlib.sha256(t).digest(), row + 1
                for i in range(0, max(len(t), 1), size):
                    columns = [[sha], [f"{part}.{row}"], [i // size], [t[i : i + size]]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(j, 1), *map(pa.array, columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def combined(pieces: DataFrame, print_: Fingerprint) -> DataFrame:
    """(id, sha, n_bytes, h1, h2) for each text of pieces: every chunk is hashed by itself, wherever it is."""

    def run(batches):
        for batch in batches:
            found = [print_.chunk(x.as_py()) for x in batch.column("piece")]
            if found:
                n, h1, h2 = zip(*found, strict=True)
                shifts = [[pow(x, k, p) for k in n] for x, p in zip(print_.points, print_.primes, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, pa.int64()) for c in (n, h1, h2, *shifts))], names=[*batch.schema.names[:4], *FP, "s1", "s2"])

    schema = T.StructType([*pieces.schema.fields[:4], *PRINT, T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType())])
    # A text of 2 GB, the largest that a row can hold, has 32768 chunks.
    rows = pieces.mapInArrow(run, schema).groupBy("id", "sha", "copy").agg(F.array_sort(F.collect_list(F.struct("i", *FP, "s1", "s2"))).alias("c"))
    start = F.lit(0).cast("long")
    fold = lambda h, s, p: F.aggregate("c", start, lambda a, x: (a * x[s] + x[h]) % F.lit(p)).alias(h)
    return rows.select("id", "sha", F.aggregate("c", start, lambda a, x: a + x["n_bytes"]).alias("n_bytes"), fold("h1", "s1", print_.primes[0]), fold("h2", "s2", print_.primes[1]))


def placed(rows: DataFrame, spread: DataFrame) -> DataFrame:
    """rows (FP, id, sha, i, piece) with split, slice and least: those of a fingerprint with many rows go to its slices, its least row to all."""
    least = (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("sha") == F.col("least.sha"))).alias("least")
    slices = F.when(F.col("of").isNull(), F.array(F.lit(0))).when(F.col("is_least"), F.sequence(F.lit(0), F.col("of") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", "sha"), "of").cast("int")))
    rows = rows.join(F.broadcast(spread), FP, "left").withColumn("is_least", F.coalesce(least, F.lit(False)))
    return rows.select(*FP, F.explode(slices).alias("slice"), "i", F.col("of").isNotNull().alias("split"), F.col("is_least").alias("least"), "id", "sha", "piece")


def _order(row_id, sha) -> tuple:
    return (row_id is None, 0 if row_id is None else row_id, sha)


def _settled(key: tuple, split: bool, state: dict, rows: dict):
    """The rows of one slice: (FP, split, id, sha, keep_id, group_size, kept, apart). state: (id, sha) to class; rows: (id, sha) to (rows, least)."""
    classes: dict = {}
    for k, c in state.items():
        classes.setdefault(c, []).append(k)
    for members in classes.values():
        best = min(members, key=lambda k: _order(*k))
        main = not split or any(rows[k][1] for k in members)
        size = None if split else sum(rows[k][0] for k in members)
        for k in members:
            n, least = rows[k]
            for j in range(n if not (least and key[3]) else 0):  # the first slice reports the row that all have
                yield (*key[:3], split, *k, best[0] if main else None, size, main and k == best and j == 0, not main)


def compared(pieces: DataFrame) -> DataFrame:
    """placed() rows, compared: FP, split, id, sha, keep_id, group_size, kept, apart, a row for each text that shares its fingerprint.

    A fingerprint with one slice is settled here: each set of equal texts is a group. With several, the rows that equal the least one get
    it as keep_id, and their number is left to be counted; the others are apart.
    """
    kind = pieces.schema["id"].dataType
    flag = lambda name: T.StructField(name, T.BooleanType())
    out = T.StructType([*PRINT, flag("split"), T.StructField("id", kind), SHA, T.StructField("keep_id", kind), T.StructField("group_size", T.LongType()), flag("kept"), flag("apart")])
    dealt = pieces.repartition(*FP, "slice").sortWithinPartitions(*FP, "slice", "i")

    def run(batches):
        key, split, place, state, rows, seen, moved, todo, schema = None, False, None, {}, {}, {}, set(), [], None

        def settled():
            return _settled(key, split, state, rows) if split or sum(n for n, _ in rows.values()) > 1 else ()

        for batch in batches:
            id_type = batch.schema.field("id").type
            schema = pa.schema([*((c, pa.int64()) for c in FP), ("split", pa.bool_()), ("id", id_type), ("sha", pa.binary()), ("keep_id", id_type), ("group_size", pa.int64()), ("kept", pa.bool_()), ("apart", pa.bool_())])
            for *now, i, cut_up, least, row_id, sha, piece in zip(*(batch.column(c).to_pylist() for c in range(9)), batch.column(9), strict=True):
                if tuple(now) != key:
                    if key is not None:
                        todo += settled()
                    key, split, place, state, rows = tuple(now), cut_up, None, {}, {}
                if i != place:
                    place, seen, moved = i, {}, set()
                me = (row_id, sha)
                if i == 0:
                    n, was = rows.get(me, (0, False))
                    rows[me] = (n + 1, was or least)
                if me not in moved:  # rows equal in id and text move once
                    moved.add(me)
                    state[me] = seen.setdefault((state.get(me), piece.as_py()), len(seen))
                if len(todo) >= 4096:
                    yield _batch(todo, schema)
                    todo = []
        if key is not None:
            todo += settled()
        if todo:
            yield _batch(todo, schema)

    return dealt.mapInArrow(run, out)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", huge: int = HUGE, group: int = GROUP, chunk: int = CHUNK, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, sha (SHA-256 of the normalised text): groups of equal texts, of which the least id stays."""
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    out, left, salt = [], None, 0
    while left is None or not left.isEmpty():
        print_ = Fingerprint(salt, primes, chunk)
        if left is not None:  # texts that shared a large fingerprint with others get another one
            digest = F.unhex(F.sha2(F.regexp_replace(text_of("text"), SPACE, " ").cast("binary"), 256))
            keys = left.select(F.col("id").alias("_id"), F.col("sha").alias("_sha")).distinct()
            docs = materialize(docs.join(keys, F.col("id").eqNullSafe(F.col("_id")) & (digest == F.col("_sha")), "left_semi"), "apart")
        large = F.coalesce(F.octet_length("text"), F.lit(0)) > huge
        short = with_prints(docs.where(~large), print_)
        digest = F.unhex(F.sha2("data", 256)).alias("sha")
        pieces = materialize(cut(docs.where(large), chunk), "chunks")
        huge_prints = materialize(combined(pieces, print_), "fingerprints")
        prints = short.select("id", digest, *FP).unionByName(huge_prints)
        groups = materialize(prints.groupBy(*FP).agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("least")), "groups")
        alone = groups.where("n = 1").select("least.id", F.col("least.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "least.sha")

        most = max(group, (groups.agg(F.sum("n")).first()[0] or 0) // MOST_SPLIT)
        spread = materialize(groups.where(F.col("n") > most).select(*FP, "least", F.ceil(F.col("n") / most).cast("int").alias("of")), "spread")
        bucket = F.pmod(F.xxhash64(*FP), F.lit(BUCKETS)).alias("bucket")
        shared = F.broadcast(groups.where("n > 1").select(bucket).distinct())
        rows = short.withColumn("bucket", bucket).join(shared, "bucket", "left_semi").select(*FP, "id", digest, "data")
        places = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_bytes") / chunk) - 1, F.lit(0)).cast("int"))
        rows = rows.select(*FP, "id", "sha", F.explode(places).alias("i"), "data")
        rows = rows.select(*FP, "id", "sha", F.col("i").cast("long").alias("i"), F.expr(f"substring(data, i * {chunk} + 1, {chunk})").alias("piece"))
        rows = rows.unionByName(join_split(pieces.drop("copy"), huge_prints.select("sha", *FP).distinct(), "sha"))
        found = materialize(compared(placed(rows, spread)), "compared")

        whole = found.where("NOT split").select("id", "keep_id", "group_size", "kept", "sha")
        split = found.where("split AND NOT apart")
        sizes = F.broadcast(split.groupBy(*FP).agg(F.count("*").alias("size")))  # a row for each of at most MOST_SPLIT fingerprints
        out += [alone, whole, split.join(sizes, FP).select("id", "keep_id", F.col("size").alias("group_size"), "kept", "sha")]
        left, salt = found.where("apart"), salt + 1
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.withColumnRenamed("id", id_col)
