"""Vector functions on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Zero for a zero vector; an error where lengths differ."""
    value = F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))
    return F.when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths").cast("double")).otherwise(value)


def mean_pool(vectors: Column) -> Column:
    """The mean of array<array<double>>, by position."""
    n = F.size(vectors)
    places = F.sequence(F.lit(0), F.size(F.get(vectors, F.lit(0))) - 1)
    return F.transform(places, lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.get(v, i)) / n)


def bag_of_words(vocabulary: list[str]) -> Callable[[Column], Column]:
    """An embedding that counts each vocabulary word in the lower-cased text, without leaving the JVM."""

    def embed(text: Column) -> Column:
        low = F.lower(text)
        count = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("double")
        return F.array(*[count(w) for w in vocabulary])

    return embed


def embed_with(fn: Callable[[str], list[float]]) -> Callable[[Column], Column]:
    """A Python embedding as a column function on array<string>: one call per different text and batch."""

    @F.pandas_udf("array<array<double>>")
    def embed_all(texts: pd.Series) -> pd.Series:
        known: dict[str, list[float]] = {}

        def one(t: str) -> list[float]:
            if t not in known:
                known[t] = [float(x) for x in fn(t)]
            return known[t]

        return texts.map(lambda row: [one(t) for t in row], na_action="ignore")

    return embed_all
