"""From documents to a graph: normalize, chunk, extract, resolve, build."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_text
from lodestone.operators.building import build_graph, numbered
from lodestone.operators.chunking import chunk_by_size
from lodestone.operators.extraction import extract
from lodestone.ordering import in_order
from lodestone.schemas import Graph
from lodestone.scratch import is_written, written
from lodestone.sources.snapshots import load_graph, save_graph


def ingest(documents: DataFrame, llm: Callable[[str], str], chunker: Callable[[DataFrame], DataFrame] = chunk_by_size, on_error: str = "raise") -> tuple[DataFrame, Graph]:
    """(chunks with their extractions, graph). documents: id, content. Answers are written once: no chunk is asked for twice."""
    texts = documents.select("id", normalize_text(F.coalesce("content", F.lit(""))).alias("content"))
    found = written(extract(chunker(texts), llm, on_error=on_error), "extractions")
    graph, _ = build_graph(found.withColumnRenamed("id", "chunk_id"), ("document_id", "chunk_index", "chunk_id"))
    return found, graph


#: The states of a document on its way, in order, and the one of those that did not arrive.
STATES = ("CREATED", "PROCESSING", "CHUNKING", "EXTRACTING", "RESOLVING", "BUILDING_GRAPH", "EMBEDDING", "COMPLETED")
FAILED = "FAILED"


def _log(documents: DataFrame, state: str, path: str) -> None:
    place = STATES.index(state) if state in STATES else len(STATES)
    rows = documents.select(F.col("id").cast("string").alias("document_id"), F.lit(state).alias("state"), F.lit(place).alias("place"), F.current_timestamp().alias("at"))
    rows.write.mode("append").parquet(f"{path}/states")


def states(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, state): the last state of each document; failure is last."""
    return spark.read.parquet(f"{path}/states").groupBy("document_id").agg(F.max(F.struct("at", "place", "state")).getField("state").alias("state"))


def process(documents: DataFrame, llm: Callable[[str], str], embed: Callable[[Column], Column], path: str, chunker: Callable[[DataFrame], DataFrame] = chunk_by_size) -> Graph:
    """From documents (id, content) to chunks, vectors and a saved graph under path, with the state of every document on the way.

    path must be new. A stage is one job over all documents, so they share its state, and its result is a table under path. When a stage fails, all documents are
    FAILED and the error goes on; resume() goes on from the tables that are whole. A document also fails if none of its chunks has a usable
    answer though it has chunks; it has its chunks and vectors all the same. `ord` numbers rows in the order of insertion: entities by their first mention,
    relationships by their first statement, evidence and vectors by chunk. embed: a column function over texts.
    """
    documents.select("id", "content").write.parquet(f"{path}/documents")
    _log(documents.sparkSession.read.parquet(f"{path}/documents"), STATES[0], path)
    return resume(documents.sparkSession, path, llm, embed, chunker)


def resume(spark: SparkSession, path: str, llm: Callable[[str], str], embed: Callable[[Column], Column], chunker: Callable[[DataFrame], DataFrame] = chunk_by_size) -> Graph:
    """Goes on with what process() began at path. Chunks that have their answers are not asked for again."""
    documents = spark.read.parquet(f"{path}/documents")

    def stage(state: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if not is_written(spark, f"{path}/{name}"):
            _log(documents, state, path)
            make().write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    try:
        _log(documents, STATES[1], path)
        texts = documents.select("id", normalize_text(F.coalesce("content", F.lit(""))).alias("content"))
        chunks = stage("CHUNKING", "chunks", lambda: chunker(texts))
        found = stage("EXTRACTING", "extractions", lambda: extract(chunks, llm, on_error="skip"))
        if not is_written(spark, f"{path}/graph/manifest"):
            _log(documents, "RESOLVING", path)
            graph, _ = build_graph(found.withColumnRenamed("id", "chunk_id"), ("document_id", "chunk_index", "chunk_id"))
            _log(documents, "BUILDING_GRAPH", path)
            save_graph(Graph(*(numbered(t) for t in (graph.entities, graph.relationships, graph.evidence))), f"{path}/graph")
        rows = in_order(chunks.select("document_id", "chunk_index", "id", "text"), "document_id", "chunk_index", "id", place="ord")
        stage("EMBEDDING", "vectors", lambda: rows.select(F.concat(F.lit("vec_"), "id").alias("id"), F.col("id").alias("chunk_id"), embed(F.col("text")).alias("vector"), "ord"))
        unanswered = found.groupBy("document_id").agg(F.count("entities").alias("n")).where("n = 0").select(F.col("document_id").alias("id"))
        _log(documents.join(unanswered, "id", "left_semi"), FAILED, path)
        _log(documents.join(unanswered, "id", "left_anti"), "COMPLETED", path)
        return load_graph(spark, f"{path}/graph")
    except Exception:
        _log(documents, FAILED, path)
        raise
