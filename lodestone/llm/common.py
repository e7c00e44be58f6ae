"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.scratch import written

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def as_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """df's columns as one struct: whatever their names, none meets an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (columns or df.columns)])


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


#: Hashed keys that a prefilter tells apart: its size never grows beyond this, and a full one lets all rows through.
LIKELY = 1 << 20


def likely(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose key may be in wanted, to be joined with it after: most others go before they are shuffled. Broadcasts at most LIKELY numbers."""
    bucket = lambda df: F.pmod(F.xxhash64(*[df[c] for c in on]), F.lit(LIKELY))
    name = unused(rows, "_bucket")
    return rows.withColumn(name, bucket(rows)).join(F.broadcast(wanted.select(bucket(wanted).alias(name)).distinct()), name, "left_semi").drop(name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a result that is used more than once, and go on from the written table: lost executors redo no lineage."""
    return written(df, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
