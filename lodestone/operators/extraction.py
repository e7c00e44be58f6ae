"""Extraction: a language model answers for each chunk; answers are parsed, checked and, once, asked for again.

Parsing is strict where Spark's own JSON reader is lenient: text that is no JSON, a missing or wrong field, an unknown
type or a value out of range rejects the chunk's whole answer.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.functions.text import prompt_around, strip
from lodestone.schemas import ENTITY_TYPES, EXTRACTION, RELATIONSHIP_TYPES


def _text(value) -> str:
    if not isinstance(value, str):
        raise ValueError("a string is expected")
    return value


def _confidence(value) -> float:
    number = float(value) if isinstance(value, (int, float, str)) else float("nan")
    if not 0.0 <= number <= 1.0:
        raise ValueError("a number from 0 to 1 is expected")
    return number


def _member(value, allowed) -> str:
    if value not in allowed:
        raise ValueError("not in the vocabulary")
    return value


def parse_answer(raw: str | None) -> dict | None:
    """The answer's entities and relationships, or None where a field is missing or of a wrong type."""
    try:
        data = json.loads(raw)
        entities, relationships = data.get("entities", []), data.get("relationships", [])
        return {
            "entities": [{"name": _text(e["name"]), "entity_type": _member(e["entity_type"], ENTITY_TYPES)} for e in entities],
            "relationships": [
                {k: _text(r[k]) for k in ("source", "target", "evidence")}
                | {"relationship_type": _member(r["relationship_type"], RELATIONSHIP_TYPES), "confidence": _confidence(r["confidence"])}
                for r in relationships
            ],
        }
    except (ValueError, TypeError, KeyError, AttributeError):
        return None


def errors_of(entities: Column, relationships: Column) -> Column:
    """array<string>: ends that are no entity of the answer, and empty evidence; per relationship in this order."""
    names = F.transform(entities, lambda e: e["name"])

    def of(r: Column) -> Column:
        missing = lambda end: F.when(~F.array_contains(names, r[end]), F.concat(F.lit(f"{end} is no entity: "), r[end]))
        blank = F.when(F.length(strip(r["evidence"])) == 0, F.concat_ws(" ", F.lit("no evidence:"), r["source"], r["target"]))
        return F.filter(F.array(missing("source"), missing("target"), blank), lambda x: x.isNotNull())

    return F.flatten(F.transform(relationships, of))


def is_valid(answer: dict) -> bool:
    names = {e["name"] for e in answer["entities"]}
    return all(r["source"] in names and r["target"] in names and r["evidence"].strip() for r in answer["relationships"])


def _parse_frame(df: DataFrame, answers: Callable[[pa.RecordBatch], list[tuple[dict | None, int]]], drop: tuple[str, ...] = ()) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *T._parse_datatype_string(EXTRACTION).fields, T.StructField("attempts", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            found = answers(batch)
            columns = [pa.array([a and a[k] for a, _ in found], arrow.field(k).type) for k in ("entities", "relationships")]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *columns, pa.array([n for _, n in found], pa.int32())], schema=arrow)

    return df.mapInArrow(run, schema)


def parse_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with entities, relationships (null where the answer is rejected) and the errors of well-formed answers."""
    parsed = _parse_frame(df, lambda batch: [(parse_answer(x.as_py()), 1) for x in batch.column(raw)]).drop("attempts")
    found = parsed.withColumn("errors", errors_of(F.col("entities"), F.col("relationships")))
    ok = F.coalesce(F.size("errors") == 0, F.lit(False))
    return found.withColumns({k: F.when(ok, F.col(k)) for k in ("entities", "relationships")})


def extract(chunks: DataFrame, llm: Callable[[str], str], text: str = "text", on_error: str = "raise", drop: tuple[str, ...] = ()) -> DataFrame:
    """chunks with entities, relationships and attempts: a rejected answer is asked for once more, then left null.

    An exception of llm itself ends the job, unless on_error is "skip". drop: columns that the result is without, such as the text; they do not come back from Python.
    The text goes to Python once, as it is; prompts are made there, the second one only where it is asked for.
    """
    around = [prompt_around(), prompt_around(strict=True)]

    def one(chunk: str | None) -> tuple[dict | None, int]:
        for n, (before, after) in enumerate(around, 1):
            try:
                raw = llm(None if chunk is None else before + chunk + after)
            except Exception:
                if on_error == "skip":
                    return None, n
                raise
            answer = parse_answer(raw)
            if answer is not None and is_valid(answer):
                return answer, n
        return None, 2

    return _parse_frame(chunks, lambda batch: [one(t) for t in batch.column(text).to_pylist()], drop)
