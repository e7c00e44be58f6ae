"""Table schemas, controlled vocabularies and ids."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENTS = "id string, title string, content string, metadata string, created_at timestamp"
CHUNKS = "id string, document_id string, text string, chunk_index int, start_offset int, end_offset int, metadata string"
ENTITIES = "id string, canonical_name string, entity_type string, aliases array<string>, description string, metadata string, ord bigint"
RELATIONSHIPS = "id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, metadata string, ord bigint"
EVIDENCE = "id string, relationship_id string, chunk_id string, text string, confidence double, ord bigint"
VECTORS = "id string, chunk_id string, vector array<double>, metadata string, ord bigint"
EXTRACTION = (
    "entities array<struct<name:string,entity_type:string>>, relationships array<struct<source:string,target:string,"
    "relationship_type:string,evidence:string,confidence:double>>"
)

# The closed vocabularies. Anything else is rejected where data comes in.
ENTITY_TYPES = ("Person", "Company", "Organization", "Product", "Technology", "Framework", "ProgrammingLanguage", "Database", "Project", "Concept", "Location")
RELATIONSHIP_TYPES = ("USES", "BUILDS", "CREATED", "WORKS_FOR", "DEPENDS_ON", "WRITTEN_IN", "IMPLEMENTS", "PROVIDES", "PART_OF", "RELATED_TO", "LOCATED_IN")
BLOCK_TYPES = ("heading", "paragraph", "list", "code_block", "quote")


@dataclass(frozen=True)
class Graph:
    """Entities, relationships and evidence. `ord` is the order of insertion; it decides ties."""

    entities: DataFrame
    relationships: DataFrame
    evidence: DataFrame


@dataclass(frozen=True)
class Subgraph:
    entities: DataFrame
    relationships: DataFrame


def make_id(prefix: str, *natural_key: Column) -> Column:
    """A deterministic id: the prefix and 64 bits of a hash of the natural key."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in natural_key]).cast("binary"), 256), 1, 16))


#: Groups of keys, by their hashes, that tell which rows may lack something: a list of them never grows beyond this.
BUCKETS = 1 << 20


def _lacking(df: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """The rows of df (key, id) whose key is no id of other. Different keys meet the ids; of the rows, only those move whose bucket lacks a key.

    The ids are merged: Spark takes them for as small as their packed file, and would send all of them to every task by way of the driver.
    """
    bucket = lambda: F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_bucket")
    missing = df.select(key).distinct().join(other.select(F.col("id").alias(key)).hint("merge"), key, "left_anti")
    rows = df.select(key, "id", bucket()).join(F.broadcast(missing.select(bucket()).distinct()), "_bucket", "left_semi")
    return rows.join(missing.select(F.col(key).alias("_key")).hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, "id")


def problems(graph: Graph) -> DataFrame:
    """(problem, id) for every broken rule: repeated ids, missing ends, unknown types, values out of range."""
    e, r, v = graph.entities, graph.relationships, graph.evidence
    # Ids whose hashes are alone are not moved.
    alike = lambda df: df.withColumn("_h", F.xxhash64("id")).join(df.groupBy(F.xxhash64("id").alias("_h")).count().where("count > 1").select("_h"), "_h", "left_semi")
    repeated = lambda df, what: alike(df.select("id")).groupBy("id").count().where("count > 1").select(F.lit(f"repeated {what}").alias("problem"), "id")
    lacking = lambda df, key, other, what: _lacking(df, key, other).select(F.lit(what).alias("problem"), "id")
    bad = lambda df, condition, what: df.where(~F.coalesce(condition, F.lit(False))).select(F.lit(what).alias("problem"), "id")
    parts = [
        repeated(e, "entity"), repeated(r, "relationship"), repeated(v, "evidence"),
        lacking(r, "source_entity_id", e, "missing source"), lacking(r, "target_entity_id", e, "missing target"), lacking(v, "relationship_id", r, "missing relationship"),
        bad(e, F.col("entity_type").isin(*ENTITY_TYPES), "entity type"), bad(r, F.col("relationship_type").isin(*RELATIONSHIP_TYPES), "relationship type"),
        bad(r, F.col("confidence").between(0, 1), "relationship confidence"), bad(v, F.col("confidence").between(0, 1), "evidence confidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
