"""Places in a total order, without one task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import written


#: Bits of a row's number inside its task, in what monotonically_increasing_id gives.
WITHIN = 33


def in_order(rows: DataFrame, *keys: str, place: str = "place", packed: bool = False) -> DataFrame:
    """rows with their place (long, from 0) in the order of the keys: a range sort, in whose tasks rows are numbered, and counts per task."""
    parts = written(rows.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()), "sorted", packed)
    part = F.shiftright("_at", WITHIN).cast("int")
    sizes = sorted((r["_part"], r["count"]) for r in parts.groupBy(part.alias("_part")).count().collect())  # a row per task of the sort
    firsts = [(part, end - n) for (part, n), end in zip(sizes, accumulate(n for _, n in sizes), strict=True)] or [(0, 0)]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(firsts, "_part int, _first long"))
    within = F.col("_at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    return parts.withColumn("_part", part).join(offsets, "_part").withColumn(place, F.col("_first") + within).drop("_part", "_first", "_at")
