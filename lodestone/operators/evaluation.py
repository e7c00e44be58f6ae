"""Measures of extraction and retrieval against a gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of different rows by keys."""
    both = found.select(*keys).distinct().withColumn("f", F.lit(1)).join(gold.select(*keys).distinct().withColumn("g", F.lit(1)), keys, "full_outer")
    n = both.agg(*[F.count(F.when(c, 1)).alias(a) for a, c in (("tp", F.expr("f = 1 AND g = 1")), ("fp", F.expr("g IS NULL")), ("fn", F.expr("f IS NULL")))])
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    n = n.withColumn("precision", part(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", part(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def retrieval_at_k(ranked: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", item: str = "id") -> DataFrame:
    """Per query: recall and precision among the first k, and the reciprocal rank of the first relevant item. ranked has rank from 1."""
    wanted = relevant.select(query, item).distinct()
    hits = ranked.join(wanted, [query, item]).groupBy(query).agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"))
    total = wanted.groupBy(query).agg(F.count("*").alias("n"))
    return _at_k(total, hits, k, query)


def _at_k(total: DataFrame, hits: DataFrame, k: int, query: str) -> DataFrame:
    rows = total.join(hits, query, "left")
    got = F.coalesce("hits", F.lit(0))
    return rows.select(query, (got / F.col("n")).alias("recall"), (got / F.lit(k)).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_at_k_by_class(ranked: DataFrame, asked: DataFrame, items: DataFrame, k: int, kind: str, query: str = "query_id", item: str = "id") -> DataFrame:
    """As retrieval_at_k, where the relevant items of a query are all of its own kind. asked: query, kind; items: item, kind. Relevant pairs are
    counted from the sizes of kinds, never made."""
    have = items.where(F.col(kind).isNotNull()).select(item, kind).distinct()
    wanted = asked.select(query, kind).distinct()
    total = wanted.join(have.groupBy(kind).agg(F.count("*").alias("n")), kind).groupBy(query).agg(F.sum("n").alias("n"))
    met = ranked.join(have, item).join(wanted, [query, kind])
    hits = met.groupBy(query).agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"))
    return _at_k(total, hits, k, query)


def merge_quality(found: DataFrame, gold: DataFrame, mention: str = "mention", entity: str = "entity") -> DataFrame:
    """One row: correct, incorrect and missed merges, that is pairs of mentions put together rightly, wrongly, or not. Pairs are counted
    from the sizes of clusters, never made. found, gold: one row per mention with the cluster it is in."""
    both = found.select(mention, F.col(entity).alias("_f")).join(gold.select(mention, F.col(entity).alias("_g")), mention)
    pairs = lambda *by: both.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("n"))
    parts = [pairs(*by).select(F.lit(what).alias("what"), "n") for what, by in (("both", ("_f", "_g")), ("found", ("_f",)), ("gold", ("_g",)))]
    n = lambda what: F.sum(F.when(F.col("what") == what, F.col("n")))
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.agg(n("both").alias("correct"), (n("found") - n("both")).alias("incorrect"), (n("gold") - n("both")).alias("missed"))
