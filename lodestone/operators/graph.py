"""Changes and point queries of a property graph held in three tables. Nothing here deduplicates edges; unknown ids and values out of range are errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.schemas import ENTITY_TYPES, RELATIONSHIP_TYPES, Graph


class GraphError(ValueError):
    """A change that breaks a rule of the graph."""


def _refuse(rows: DataFrame, what: str) -> None:
    # Counted first, in all tasks at once: take() begins with one task, and mostly there is nothing to find.
    if rows.agg(F.count("*").alias("n")).first()["n"]:
        raise GraphError(f"{what}: {', '.join(str(r['id']) for r in rows.select('id').take(5))}")


def _in_range(ids: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The ids that may be among the keys of new: not before the first and not after the last. Others go no further than the scan, not even into a grouping."""
    return ids.where(F.col("id").between(new.agg(F.min(key).alias("least")).scalar(), new.agg(F.max(key).alias("last")).scalar()))


def _add(old: DataFrame, new: DataFrame, what: str) -> DataFrame:
    _refuse(new.groupBy("id").count().where("count > 1"), f"repeated {what}")
    _refuse(new.join(_in_range(old.select("id"), new, "id"), "id", "left_semi"), f"{what} exists")
    return old.unionByName(new, allowMissingColumns=True)


def _needs(new: DataFrame, key: str, other: DataFrame, what: str) -> None:
    _refuse(new.join(_in_range(other.select("id"), new, key).withColumnRenamed("id", key), key, "left_anti"), what)


def _checked(new: DataFrame, condition: Column, what: str) -> DataFrame:
    _refuse(new.where(~F.coalesce(condition, F.lit(False))), what)
    return new


def _known(rows: DataFrame, row_id: str, what: str) -> None:
    if not rows.where(F.col("id") == row_id).take(1):
        raise GraphError(f"no {what} {row_id}")


def add_entities(graph: Graph, new: DataFrame) -> Graph:
    _checked(new, F.col("entity_type").isin(*ENTITY_TYPES), "entity type is unknown")
    return Graph(_add(graph.entities, new, "entity"), graph.relationships, graph.evidence)


def add_relationships(graph: Graph, new: DataFrame) -> Graph:
    for key in ("source_entity_id", "target_entity_id"):
        _needs(new, key, graph.entities, f"{key} is missing")
    _checked(new, F.col("relationship_type").isin(*RELATIONSHIP_TYPES), "relationship type is unknown")
    _checked(new, F.col("confidence").between(0, 1), "confidence is not between 0 and 1")
    return Graph(graph.entities, _add(graph.relationships, new, "relationship"), graph.evidence)


def add_evidence(graph: Graph, new: DataFrame) -> Graph:
    _needs(new, "relationship_id", graph.relationships, "relationship is missing")
    _checked(new, F.col("confidence").between(0, 1), "confidence is not between 0 and 1")
    return Graph(graph.entities, graph.relationships, _add(graph.evidence, new, "evidence"))


def _orphans_out(graph: Graph, entities: DataFrame, kept: DataFrame) -> Graph:
    # Merged, whatever Spark takes the size of all kept ids to be: a packed file is many times as large in memory.
    evidence = graph.evidence.join(kept.select(F.col("id").alias("relationship_id")).hint("merge"), "relationship_id", "left_semi")
    return Graph(entities, kept, evidence.select(graph.evidence.columns))


def remove_entity(graph: Graph, entity_id: str) -> Graph:
    """Without the entity, the relationships that touch it, and their evidence."""
    _known(graph.entities, entity_id, "entity")
    kept = graph.relationships.where((F.col("source_entity_id") != entity_id) & (F.col("target_entity_id") != entity_id))
    return _orphans_out(graph, graph.entities.where(F.col("id") != entity_id), kept)


def remove_relationship(graph: Graph, relationship_id: str) -> Graph:
    _known(graph.relationships, relationship_id, "relationship")
    return _orphans_out(graph, graph.entities, graph.relationships.where(F.col("id") != relationship_id))


def entity(graph: Graph, entity_id: str) -> DataFrame:
    return graph.entities.where(F.col("id") == entity_id)


def relationship(graph: Graph, relationship_id: str) -> DataFrame:
    return graph.relationships.where(F.col("id") == relationship_id)


def evidence_of(graph: Graph, relationship_id: str) -> DataFrame:
    _known(graph.relationships, relationship_id, "relationship")
    return graph.evidence.where(F.col("relationship_id") == relationship_id).orderBy("ord")


def outgoing(graph: Graph, entity_id: str) -> DataFrame:
    _known(graph.entities, entity_id, "entity")
    return graph.relationships.where(F.col("source_entity_id") == entity_id)


def incoming(graph: Graph, entity_id: str) -> DataFrame:
    _known(graph.entities, entity_id, "entity")
    return graph.relationships.where(F.col("target_entity_id") == entity_id)


def neighbors(graph: Graph, entity_id: str, relationship_type: str | None = None) -> DataFrame:
    """The different entities at the other end of an edge, in either direction; a loop makes an entity its own neighbor."""
    _known(graph.entities, entity_id, "entity")
    edges = graph.relationships if relationship_type is None else graph.relationships.where(F.col("relationship_type") == relationship_type)
    ends = edges.where(F.col("source_entity_id") == entity_id).select(F.col("target_entity_id").alias("id")).unionByName(
        edges.where(F.col("target_entity_id") == entity_id).select(F.col("source_entity_id").alias("id"))
    )
    return graph.entities.join(ends, "id", "left_semi")
