"""A property graph over the order tables: places, customers, suppliers and parts, with one evidence row per order line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.schemas import Graph, make_id


def _node(df: DataFrame, kind: str, key: str, name: str, entity_type: str, rank: int) -> DataFrame:
    return df.select(
        F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("id"), F.col(name).alias("canonical_name"), F.lit(entity_type).alias("entity_type"),
        F.array().cast("array<string>").alias("aliases"), (F.lit(rank) * 10**12 + F.col(key)).cast("long").alias("ord"),
    )


def _edge(df: DataFrame, a: str, akey: str, b: str, bkey: str, kind: str, rank: int) -> DataFrame:
    end = lambda x, k: F.concat(F.lit(f"{x}_"), F.col(k).cast("string"))
    return df.select(
        F.concat_ws("|", end(a, akey), F.lit(kind), end(b, bkey)).alias("id"), end(a, akey).alias("source_entity_id"), end(b, bkey).alias("target_entity_id"),
        F.lit(kind).alias("relationship_type"), F.lit(1.0).alias("confidence"), (F.lit(rank) * 10**12 + F.col(akey)).cast("long").alias("ord"),
    )


def _ends() -> list[Column]:
    """The ends and the type of a supply, from the keys of an order line."""
    return [F.concat(F.lit("supplier_"), F.col("l_suppkey")).alias("source_entity_id"), F.concat(F.lit("part_"), F.col("l_partkey")).alias("target_entity_id"), F.lit("PROVIDES").alias("relationship_type")]


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention of `supplier PROVIDES part` per order line; the discount stands in for doubt."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    return line.select(
        *_ends(), "l_suppkey", "l_partkey", F.round(1 - F.col("l_discount"), 4).alias("confidence"),
        F.concat(F.lit("order_"), F.col("l_orderkey")).alias("chunk_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        make_id("evidence", *[F.col(c) for c in line.columns]).alias("evidence_id"),
    )


def property_graph(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation, customer, supplier = read("nation"), read("customer"), read("supplier")
    nodes = [
        _node(read("region"), "region", "r_regionkey", "r_name", "Location", 1), _node(nation, "nation", "n_nationkey", "n_name", "Location", 2),
        _node(customer, "customer", "c_custkey", "c_name", "Company", 3), _node(supplier, "supplier", "s_suppkey", "s_name", "Company", 4),
        _node(read("part"), "part", "p_partkey", "p_name", "Product", 5),
    ]
    lines = supply_lines(spark, sf_dir)
    key = ["source_entity_id", "target_entity_id", "relationship_type"]
    # Grouped by the numbers that the ends are made of: what is shuffled is half as wide.
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(F.min(F.struct("seq", "confidence")).alias("first"))
    supply = pairs.select(*_ends(), F.col("first.confidence").alias("confidence"), (F.lit(4 * 10**12) + F.col("first.seq")).alias("ord"))
    name = F.concat_ws("|", "source_entity_id", "relationship_type", "target_entity_id")
    edges = [
        _edge(nation, "nation", "n_nationkey", "region", "n_regionkey", "PART_OF", 1), _edge(customer, "customer", "c_custkey", "nation", "c_nationkey", "LOCATED_IN", 2),
        _edge(supplier, "supplier", "s_suppkey", "nation", "s_nationkey", "LOCATED_IN", 3), supply.select(name.alias("id"), *key, "confidence", "ord"),
    ]
    proof = lines.select(F.col("evidence_id").alias("id"), name.alias("relationship_id"), "chunk_id", F.concat_ws(" ", "source_entity_id", "target_entity_id").alias("text"), "confidence", F.col("seq").alias("ord"))
    return Graph(reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges), proof)
