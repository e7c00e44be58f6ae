"""From extractions to a graph: entities by resolution, one relationship per ends and type, all evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.resolution import ranked_mentions, resolve_into, resolve_stream
from lodestone.ordering import in_order
from lodestone.schemas import Graph, make_id
from lodestone.scratch import written


EDGE_KEY = ["source_entity_id", "target_entity_id", "relationship_type"]


def _said(extractions: DataFrame, mentions: DataFrame, order: list[str]) -> DataFrame:
    """The extracted relationships whose ends are entities of their answer: relationship_id, EDGE_KEY, chunk_id, pos, evidence, confidence, seq.

    An answer and its mentions meet as one row each, and ends are looked up inside it.
    """
    # A name with two types in one answer means the later one, so the last mentions come first.
    ends = mentions.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "entity_id")), asc=False).alias("_m"))
    ends = ends.select("chunk_id", F.col("_m.name").alias("_names"), F.col("_m.entity_id").alias("_ids"))
    told = extractions.where(F.size("relationships") > 0).select("chunk_id", *[c for c in order if c != "chunk_id"], "relationships").join(ends, "chunk_id")
    told = told.select("chunk_id", *[c for c in order if c != "chunk_id"], "_names", "_ids", F.posexplode("relationships").alias("pos", "r"))
    at = lambda end: F.array_position("_names", F.col(f"r.{end}"))
    end = lambda name: F.get("_ids", (at(name) - 1).cast("int")).alias(f"{name}_entity_id")
    said = told.where((at("source") > 0) & (at("target") > 0)).select("chunk_id", "pos", end("source"), end("target"), "r.relationship_type", "r.evidence", "r.confidence", F.struct(*order, "pos").alias("seq"))
    return said.withColumn("relationship_id", make_id("rel", *[F.col(k) for k in EDGE_KEY]))


def _edges(said: DataFrame) -> DataFrame:
    """One relationship per key of said (with relationship_id), with the first one's confidence."""
    return said.groupBy("relationship_id", *EDGE_KEY).agg(F.min(F.struct("seq", "confidence")).alias("f")).select(F.col("relationship_id").alias("id"), *EDGE_KEY, "f.confidence", F.col("f.seq").alias("ord"))


def _evidence_id() -> Column:
    return make_id("evidence", F.col("chunk_id"), F.col("pos"))


def _evidence(said: DataFrame) -> DataFrame:
    return said.select(_evidence_id().alias("id"), "relationship_id", "chunk_id", F.col("evidence").alias("text"), "confidence", F.col("seq").alias("ord"))


def build_graph(extractions: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> tuple[Graph, DataFrame]:
    """The graph of all extractions, and the resolved mentions. extractions: chunk_id, entities, relationships (null: rejected).

    order: the columns that say which chunk comes first. The first mention's confidence stays; every extracted
    relationship is one evidence row; a relationship between two names of one entity is a loop; ends that are no entity
    of the answer drop the relationship. `ord` of a table is a struct of the order columns and places.
    """
    order = list(order)
    mentions, entities = resolve_stream(ranked_mentions(extractions, order))
    said = written(_said(extractions, mentions, order), "said", packed=True)
    return Graph(entities, _edges(said), _evidence(said)), mentions


def numbered(new: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """new with its ord, whatever its type, as numbers in that order, after those of old."""
    last = None if old is None else old.agg(F.max("ord")).first()[0]
    return in_order(new, "ord", packed=True).withColumn("ord", F.col("place") + (0 if last is None else last + 1)).drop("place")


def extension(graph: Graph, extractions: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> tuple[Graph, DataFrame]:
    """What the extractions of further chunks make of the graph: all entities, but only the relationships and the evidence that are new; and the resolved mentions.

    `ord` is a number in all tables of the graph; new rows follow the old ones. Of the graph's relationships and evidence no more than ids moves.
    """
    order = list(order)
    mentions, entities = resolve_into(graph.entities, ranked_mentions(extractions, order))
    said, have = _said(extractions, mentions, order), graph.relationships
    # A relationship made here has its id from its ends and type. For others, the first one with these is looked up.
    odd = written(have.where(F.col("id") != make_id("rel", *[F.col(k) for k in EDGE_KEY])).select(*EDGE_KEY).distinct(), "odd")
    if not odd.isEmpty():
        first = have.join(odd, EDGE_KEY, "left_semi").groupBy(*EDGE_KEY).agg(F.min(F.struct("ord", "id")).getField("id").alias("_id"))
        said = said.join(first, EDGE_KEY, "left").withColumn("relationship_id", F.coalesce("_id", "relationship_id")).drop("_id")
    said = written(said, "said", packed=True)
    edges = numbered(_edges(said).join(have.select("id"), "id", "left_anti"), have)
    # Only a chunk that has evidence already can have it again.
    seen = written(said.select("chunk_id").distinct().join(graph.evidence.select("chunk_id").distinct(), "chunk_id", "left_semi"), "seen")
    fresh = said
    if not seen.isEmpty():
        old = graph.evidence.join(seen, "chunk_id", "left_semi").select(F.col("id").alias("_id"))
        fresh = said.withColumn("_id", _evidence_id()).join(old, "_id", "left_anti").drop("_id")
    last = graph.evidence.agg(F.max("ord")).first()[0]
    fresh = in_order(fresh.drop(*EDGE_KEY), "seq", packed=True).withColumn("seq", F.col("place") + (0 if last is None else last + 1))
    return Graph(entities, edges, _evidence(fresh)), mentions


def extend_graph(graph: Graph, extractions: DataFrame, order: tuple[str, ...] = ("chunk_id",)) -> tuple[Graph, DataFrame]:
    """The graph after the extractions of further chunks, and their resolved mentions. `ord` is a number in all tables of the graph.

    Mentions resolve to the graph's entities or, in their order, among themselves. A relationship that the graph has between the same ends
    (of several, the first) gets the new evidence and keeps its confidence. Evidence has its id from chunk and place, so a chunk that comes again adds nothing.
    """
    new, mentions = extension(graph, extractions, order)
    more = lambda old, rows: old.withColumn("ord", F.col("ord").cast("long")).unionByName(rows, allowMissingColumns=True)
    return Graph(written(new.entities, "graph", packed=True), more(graph.relationships, new.relationships), more(graph.evidence, new.evidence)), mentions


def dedup_edges(edges: DataFrame, seq: str = "seq") -> DataFrame:
    """One edge per source, target and type, with the first one's confidence and the number of mentions."""
    return edges.groupBy(*EDGE_KEY).agg(F.min(F.struct(seq, "confidence")).getField("confidence").alias("confidence"), F.count("*").alias("mentions"))
