"""Folds over arrays that put out elements, in time that stays near linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of an inner fold. Appending copies what was put out, so a fold that puts out n elements costs BLOCK * n + (n / BLOCK) ** 2 copies.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], out_type: str) -> Column:
    """struct<state, out>: step(state, item) gives struct<state, out>, a new state and an array of elements to put out."""
    none = F.array().cast(f"array<{out_type}>")
    start = lambda s: F.struct(s.alias("state"), none.alias("out"))
    grown = lambda a, r: F.struct(r["state"].alias("state"), F.concat(a["out"], r["out"]).alias("out"))
    within = lambda block, s: F.aggregate(block, start(s), lambda a, x: let(step(a["state"], x), lambda r: grown(a, r)))
    blocks = F.transform(F.sequence(F.lit(1), F.size(items), F.lit(BLOCK)), lambda i: F.slice(items, i, BLOCK))
    outer = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
    append = lambda a, r: F.struct(r["state"].alias("state"), F.concat(a["out"], F.array(r["out"])).alias("out"))
    whole = F.aggregate(blocks, outer, lambda a, b: let(within(b, a["state"]), lambda r: append(a, r)), lambda a: F.struct(a["state"].alias("state"), F.flatten(a["out"]).alias("out")))
    return F.when(F.size(items) > 0, whole).otherwise(start(state))
