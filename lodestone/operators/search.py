"""Vector store: a table of vectors, exact top-k search for one query and for many."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from lodestone.config import Settings
from lodestone.functions.vectors import cosine_similarity
from lodestone.operators.graph import GraphError, _add
from lodestone.scratch import written

#: Queries that one pass over the vectors answers: the part that goes to every executor.
QUERY_BLOCK = 2048
#: Queries and vectors that a task compares at once: what it holds besides its best.
TILE = (256, 4096)
#: Parts of the range of scores by codes, of which one holds the end of a short list.
BINS = 512


def add_vectors(store: DataFrame, new: DataFrame) -> DataFrame:
    if not new.where(F.size("vector") < 1).isEmpty():
        raise GraphError("an empty vector")
    return _add(store, new, "vector")


def remove_vector(store: DataFrame, vector_id: str) -> DataFrame:
    if store.where(F.col("id") == vector_id).isEmpty():
        raise GraphError(f"no vector {vector_id}")
    return store.where(F.col("id") != vector_id)


def vector_of(store: DataFrame, vector_id: str) -> DataFrame:
    """The row with the id, or none."""
    return store.where(F.col("id") == vector_id)


def search(store: DataFrame, query: list[float], k: int | None = None) -> DataFrame:
    """store's rows with score, the k best; equal scores in order of insertion. Vectors of another length are an error."""
    k = Settings().top_k if k is None else k
    if k < 0:
        raise ValueError("k is negative")
    literal = F.array(*[F.lit(float(x)) for x in query])
    scored = store.withColumn("score", cosine_similarity(F.col("vector"), literal))
    return scored.orderBy(F.desc("score"), "ord").limit(k)


def retrieve(store: DataFrame, text: str, embed_fn: Callable[[str], list[float]], k: int | None = None) -> DataFrame:
    """Embeds the text once, on the driver."""
    return search(store, embed_fn(text), k)


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _blocks(queries: DataFrame, id_col: str, vector: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    n = -(-queries.count() // size)
    for b in range(n):
        rows = queries.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == b).select(id_col, F.col(vector).cast("array<double>").alias("v")).collect()
        if rows:
            yield [r[0] for r in rows], _unit(np.array([r["v"] for r in rows], np.float64))


def _tiles(n_queries: int, rows: int) -> Iterator[tuple[slice, slice]]:
    for a in range(0, rows, TILE[1]):
        for q in range(0, n_queries, TILE[0]):
            yield slice(q, min(q + TILE[0], n_queries)), slice(a, min(a + TILE[1], rows))


class _Best:
    """The k best (query, id, score) of each query so far; least id first among scores that are equal when rounded."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.cut, self.held = k, np.full(n_queries, -np.inf), {}

    def take(self, queries: slice, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows for the queries of a tile; at: places in the tile."""
        old = self.held.get(queries.start)
        if old is not None:
            at, ids, scores = np.concatenate([old[0], at]), np.concatenate([old[1], ids]), np.concatenate([old[2], scores])
        rounded = np.round(scores, 12)
        order = np.lexsort((ids, -rounded, at))
        place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        order = order[place < self.k]
        self.held[queries.start] = at[order], ids[order], scores[order]
        last = order[place[place < self.k] == self.k - 1]
        self.cut[queries.start + at[last]] = np.nan_to_num(rounded[last], nan=-np.inf)

    def take_all(self, queries: slice, scores: np.ndarray, ids: np.ndarray) -> None:
        """A score of every query of a tile with every id. Only what may be among the best is sorted."""
        rounded = np.round(scores, 12)
        rounded[np.isnan(rounded)] = -np.inf
        cut, n = self.cut[queries], scores.shape[1]
        if 0 < self.k < n:
            cut = np.maximum(cut, np.partition(rounded, n - self.k, axis=1)[:, n - self.k])
        at, column = np.nonzero(rounded >= cut[:, None])
        self.take(queries, at, ids[column], scores[at, column])

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of queries, ids, scores), a tile at a time."""
        for start, (at, ids, scores) in self.held.items():
            yield start + at, ids, scores


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def batch_search(store: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows of store for each query, itself included; ties to the lower id.

    Queries go out in blocks. A task multiplies its vectors with a block, a tile at a time, and sends on its own k best of each query only:
    it holds these and one tile, whatever the number of vectors.
    """
    pick = store.select(id_col, F.col(vector).cast("array<double>").alias("v"))
    kind = store.schema[id_col].dataType.simpleString()
    arrow = to_arrow_type(store.schema[id_col].dataType)
    out = None
    for ids, matrix in _blocks(queries, id_col, vector, block):
        given = store.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches, given=given):
            query_ids, q = given.value
            best = _Best(len(q), k)
            for batch in batches:
                if not batch.num_rows:
                    continue
                found, unit = np.asarray(batch.column(0)), _unit(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
                for some, part in _tiles(len(q), len(unit)):
                    best.take_all(some, q[some] @ unit[part].T, found[part])
            names = np.array(query_ids)
            for at, found, scores in best.rows():
                yield pa.RecordBatch.from_arrays([pa.array(names[at], arrow), pa.array(found, arrow), pa.array(scores)], names=["query_id", "id", "score"])

        part = pick.mapInArrow(run, f"query_id {kind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return store.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, score double, rank int")
    return _ranked(out, k)


@dataclass(frozen=True)
class CellIndex:
    """An inverted file: the centres of cells, and every vector under the cell of its nearest centre."""

    centres: np.ndarray
    rows: DataFrame


def _nearest(vectors: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(_unit(vectors) @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)


def build_index(store: DataFrame, cells: int = 64, sample_rows: int = 20_000, rounds: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> CellIndex:
    """Centres are fitted by spherical k-means on at most sample_rows vectors, those of the least hashes; every vector is filed."""
    rows = store.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    data = _unit(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), -1))
    centres = data[: min(cells, len(data))]
    for _ in range(rounds):
        mine = _nearest(data, centres, 1)[:, 0] if len(data) else np.zeros(0, np.int32)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, data)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return CellIndex(centres, _filed(rows, centres, 1))


def _filed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    given = rows.sparkSession.sparkContext.broadcast(centres)  # cells times dimensions

    def run(batches):
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            found = _nearest(v, given.value, probes) if batch.num_rows else np.zeros((0, probes), np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["id", "v", "cells"])

    return rows.mapInArrow(run, rows.select("id", "v", F.lit(None).cast("array<int>").alias("cells")).schema).select("id", "v", F.explode("cells").alias("cell"))


def index_search(index: CellIndex, queries: DataFrame, k: int = 10, probes: int = 44, salts: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k best of the `probes` cells nearest to each query. The vectors of a cell are dealt over `salts`
    tasks, and the queries that ask for it go to all of them; a task keeps its own k best per query.

    The recall depends on the data: vectors without clusters need many probes. At the default, 44 of 64 cells, it is above 0.9 on
    evenly spread vectors of 64 dimensions; on clustered ones a few probes reach that."""
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = _filed(asked, index.centres, probes).select(F.col("id").alias("query_id"), F.col("v").alias("q"), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    filed = index.rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    schema = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", filed.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        a, b = (np.concatenate([np.asarray(c.flatten()) for c in t.column(c).chunks]).reshape(t.num_rows, -1) for t, c in ((left, "v"), (right, "q")))
        ids, query_ids, out = np.array(left.column("id")), np.array(right.column("query_id")), []
        unit = _unit(a)
        for s in range(0, len(b), 512):
            some = _unit(b[s : s + 512])
            best = _Best(len(some), k)
            for part, cols in _tiles(len(some), len(unit)):
                best.take_all(part, some[part] @ unit[cols].T, ids[cols])
            out += [(query_ids[s + at], found, scores) for at, found, scores in best.rows()]
        return pa.table([pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    found = filed.groupBy("cell", "salt").cogroup(asked.groupBy("cell", "salt")).applyInArrow(run, schema)
    return _ranked(found, k)


@dataclass(frozen=True)
class CodeIndex:
    """Product quantization: for each part of the dimensions its centres, and every vector with a byte per part, the number of the nearest centre."""

    centres: list[np.ndarray]
    rows: DataFrame


def _parts(vectors: np.ndarray, n: int) -> list[np.ndarray]:
    return np.array_split(vectors, n, axis=1)


def _closest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * part @ centres.T, axis=1)


def build_codes(store: DataFrame, parts: int = 16, centres: int = 256, sample_rows: int = 20_000, rounds: int = 8, id_col: str = "vec_id", vector: str = "embedding") -> CodeIndex:
    """Centres are fitted by k-means on at most sample_rows vectors, those of the least hashes; every vector is coded, by its direction."""
    rows = store.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    data = _unit(np.array([r["v"] for r in sample], np.float64).reshape(len(sample), -1))
    books = []
    for part in _parts(data, min(parts, max(data.shape[1], 1))):
        book = part[: min(centres, 256, len(part))].copy()
        for _ in range(rounds if len(book) else 0):
            mine = _closest(part, book)
            sums, sizes = np.zeros_like(book), np.bincount(mine, minlength=len(book))[:, None]
            np.add.at(sums, mine, part)
            book = np.where(sizes > 0, sums / np.maximum(sizes, 1), book)
        books.append(book)
    given = rows.sparkSession.sparkContext.broadcast(books)  # 256 times dimensions

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = _unit(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
                codes = np.stack([_closest(p, b) for p, b in zip(_parts(v, len(given.value)), given.value, strict=True)], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "code"])

    return CodeIndex(books, rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType())])))


def code_search(index: CodeIndex, queries: DataFrame, k: int = 10, share: float = 0.05, id_col: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of a short list, by the exact cosine; ties to the lower id.

    The short list of a query are the vectors of the best scores by codes, `share` of all (k at least): a task looks up the products of the query's
    parts with all centres and adds one per part. A first pass counts these scores by bins, which tells the bin in which each short list ends. The second pass ranks
    the vectors in better bins where they are, and sends on its k best of each query and what is in the last bin. So about `share` of the exact distances are computed,
    and no short list is held or moved. The recall depends on the data and the share.
    """
    rows = written(index.rows, "codes")
    n_short = max(k, int(np.ceil(share * rows.count())))
    kind = rows.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(rows.schema["id"].dataType)
    out = None
    for ids, matrix in _blocks(queries, id_col, vector, block):
        tables = [q @ b.T for q, b in zip(_parts(matrix, len(index.centres)), index.centres, strict=True)]
        low, high = (sum((getattr(t, f)(axis=1) for t in tables), np.zeros(len(ids)))[:, None] for f in ("min", "max"))
        given = rows.sparkSession.sparkContext.broadcast((ids, matrix, tables, low, BINS / np.maximum(high - low, 1e-300)))

        def tiles(batches, given=given):
            """(queries, batch's vectors, rows, scores by codes, their bins)"""
            query_ids, _, tables, low, scale = given.value
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for some, part in _tiles(len(query_ids), len(codes)):
                        guess = sum(t[some][:, codes[part, i]] for i, t in enumerate(tables))
                        yield some, batch, part, guess, np.clip((guess - low[some]) * scale[some], 0, BINS - 1).astype(np.int64)

        def count(batches, given=given, tiles=tiles):
            counts = np.zeros((len(given.value[0]), BINS), np.int64)
            for some, _, _, _, bins in tiles(batches):
                m = len(bins)
                counts[some] += np.bincount((np.arange(m)[:, None] * BINS + bins).ravel(), minlength=m * BINS).reshape(m, BINS)
            at, bins = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bins), pa.array(counts[at, bins])], names=["at", "bin", "n"])

        # The bin in which the short list of each query ends, and how many are in better ones.
        sizes = rows.select("code").mapInArrow(count, "at long, bin long, n long").groupBy("at", "bin").agg(F.sum("n").alias("n"))
        better = F.coalesce(F.sum("n").over(W.partitionBy("at").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ends = sizes.withColumn("better", better).where(F.col("better") < n_short).groupBy("at").agg(F.min("bin").alias("bin"), F.max("better").alias("better")).collect()  # a row per query of the block
        last, rest = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for r in ends:
            last[r["at"]], rest[r["at"]] = r["bin"], n_short - r["better"]
        limits = rows.sparkSession.sparkContext.broadcast((last, rest))

        def run(batches, given=given, limits=limits, tiles=tiles):
            query_ids, q, *_ = given.value
            (last, rest), names = limits.value, np.array(query_ids)
            best = _Best(len(query_ids), k)
            for some, batch, part, guess, bins in tiles(batches):
                at, column = np.nonzero(bins >= last[some, None])
                unit, found = _unit(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)[part]), np.asarray(batch.column("id"))[part]
                score = np.concatenate([np.einsum("ij,ij->i", q[some][at[i : i + TILE[1]]], unit[column[i : i + TILE[1]]]) for i in range(0, max(len(at), 1), TILE[1])])
                bin_, guess = bins[at, column], guess[at, column]
                sure = bin_ > last[some][at]
                best.take(some, at[sure], found[column[sure]], score[sure])
                edge = ~sure
                if edge.any():
                    who = some.start + at[edge]
                    yield pa.RecordBatch.from_arrays([pa.array(names[who], arrow), pa.array(found[column[edge]], arrow), pa.array(score[edge]), pa.array(guess[edge]), pa.array(rest[who])], names=["query_id", "id", "score", "guess", "rest"])
            for at, found, scores in best.rows():
                nothing = pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names[at], arrow), pa.array(found, arrow), pa.array(scores), *nothing], names=["query_id", "id", "score", "guess", "rest"])

        part = rows.mapInArrow(run, f"query_id {kind}, id {kind}, score double, guess double, rest long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, score double, rank int")
    # In the last bin the best by codes are still in the short list, ties by the id.
    place = F.row_number().over(W.partitionBy("query_id", F.col("rest").isNull()).orderBy(F.desc("guess"), "id"))
    short = out.withColumn("place", place).where("rest IS NULL OR place <= rest")
    return _ranked(short.select("query_id", "id", "score"), k)
