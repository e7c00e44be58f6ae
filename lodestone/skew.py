"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import written

#: A key with more than one in so many rows is hot, so there are at most as many hot keys as this.
HOT_SHARE = 1000


def hot_keys(rows: DataFrame, on: list[str] | str, share: int = HOT_SHARE) -> DataFrame | None:
    """The keys of rows that are hot: at most `share` of them, whatever the size of rows; None where there is none."""
    on = [on] if isinstance(on, str) else list(on)
    counts = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)).groupBy(*on).agg(F.count("*").alias("_n"))
    hot = written(counts.where(F.col("_n") > max(rows.count() // share, 1)).select(*on), "hot")
    return None if hot.isEmpty() else hot


def join_split(rows: DataFrame, side: DataFrame, on: list[str] | str, how: str = "inner", share: int = HOT_SHARE, **known: DataFrame | None) -> DataFrame:
    """rows.join(side, on, how) for how inner or left; side has at most one row per key.

    Rows of hot keys stay where they are and meet the side's few rows for these keys, which are broadcast (at most `share`);
    all others are shuffled. rows is read several times, so it should be a written table or a plain scan. Where the same rows are
    joined again and again, hot=hot_keys(rows, on) finds the hot keys once.
    """
    on = [on] if isinstance(on, str) else list(on)
    hot = known["hot"] if "hot" in known else hot_keys(rows, on, share)
    if hot is None:
        return rows.join(side, on, how)
    few = side.join(F.broadcast(hot), on, "left_semi")
    at_home = rows.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how)
    return at_home.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(side, on, how))
