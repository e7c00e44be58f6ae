"""Chunking: paragraphs are joined while a flag per boundary and the chunk's size allow it.

All three strategies are one fold over a document's paragraphs inside its row: no shuffle, and documents never meet.
The fold runs in blocks of paragraphs, so a document of very many stays cheap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.arrays import let, scan
from lodestone.functions.text import FULL, candidate_entities, paragraphs
from lodestone.functions.vectors import dot, norm
from lodestone.schemas import make_id

THRESHOLD = 0.75
#: First words of a paragraph that speak of what the one before said.
POINTS_BACK = r"^(?:This|These|That|Those|It|Its|They|Their|Such)\b"


def _fold(paras: Column, flags: Column, most: int) -> Column:
    """array<struct<start, end>>; flags[i] says whether paragraph i may join the one before."""
    span = "struct<start:int,end:int>"
    items = F.zip_with(paras, flags, lambda p, m: F.struct(p["start"].alias("start"), p["end"].alias("end"), m.alias("joins")))
    none = F.array().cast(f"array<{span}>")

    def step(now: Column, p: Column) -> Column:
        joins = now.isNotNull() & p["joins"] & (p["end"] - now["start"] <= most)
        start = F.when(joins, now["start"]).otherwise(p["start"])
        closed = F.when(joins | now.isNull(), none).otherwise(F.array(now))
        return F.struct(F.struct(start.alias("start"), p["end"].alias("end")).alias("state"), closed.alias("out"))

    found = let(items, lambda x: scan(x, F.lit(None).cast(span), step, span))
    return let(found, lambda f: F.when(f["state"].isNull(), f["out"]).otherwise(F.concat(f["out"], F.array(f["state"]))))


def _chunks(df: DataFrame, flags: Column, most: int | None, id_col: str, text: str) -> DataFrame:
    """df has _p (paragraphs)."""
    spans = df.select(F.col(id_col).alias("document_id"), F.col(text).alias("_t"), F.posexplode(_fold(F.col("_p"), flags, most or Settings().chunk_size)).alias("chunk_index", "_s"))
    body = F.substring(F.col("_t"), F.col("_s.start") + 1, F.col("_s.end") - F.col("_s.start"))
    return spans.select(
        make_id("chunk", F.col("document_id"), F.col("chunk_index")).alias("id"), "document_id", body.alias("text"), "chunk_index",
        F.col("_s.start").alias("start_offset"), F.col("_s.end").alias("end_offset"),
    )


def _with_paragraphs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return df.select(id_col, text, paragraphs(F.coalesce(F.col(text), F.lit(""))).alias("_p"))


def chunk_by_size(df: DataFrame, most: int | None = None, id_col: str = "id", text: str = "content") -> DataFrame:
    df = _with_paragraphs(df, id_col, text)
    return _chunks(df, F.transform("_p", lambda p: F.lit(True)), most, id_col, text)


def _similar(df: DataFrame, embed: Callable[[Column], Column], per_text: bool, threshold: float) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    texts = F.transform("_p", lambda p: p["text"])
    df = df.withColumn("_v", F.transform(texts, embed) if per_text else embed(texts)).withColumn("_n", F.transform("_v", norm))

    def similar(p: Column, i: Column) -> Column:
        at = lambda c, j: F.get(c, F.greatest(j, F.lit(0)))
        # One norm after the other: as the SQL rounds, which decides ties with the threshold, and no product can overflow.
        value = F.coalesce(F.try_divide(F.try_divide(dot(at("_v", i - 1), at("_v", i)), at("_n", i)), at("_n", i - 1)), F.lit(0.0))
        return (i > 0) & (value >= threshold)

    return df, similar


def chunk_by_similarity(df: DataFrame, embed: Callable[[Column], Column], most: int | None = None, threshold: float = THRESHOLD, id_col: str = "id", text: str = "content", per_text: bool = True) -> DataFrame:
    """Joins a paragraph to the one before where their embeddings agree. per_text: embed takes a text, else an array of texts."""
    df, similar = _similar(_with_paragraphs(df, id_col, text), embed, per_text, threshold)
    return _chunks(df, F.transform("_p", similar), most, id_col, text)


def chunk_by_entities(df: DataFrame, embed: Callable[[Column], Column], most: int | None = None, threshold: float = THRESHOLD, id_col: str = "id", text: str = "content", per_text: bool = True, closed: bool = True) -> DataFrame:
    """Joins a paragraph to the one before where the embeddings agree or both hold a candidate entity."""
    df, similar = _similar(_with_paragraphs(df, id_col, text), embed, per_text, threshold)
    df = df.withColumn("_c", F.transform("_p", lambda p: candidate_entities(p["text"], closed)))
    shared = lambda i: (i > 0) & F.arrays_overlap(F.coalesce(F.get("_c", i - 1), F.get("_c", i)), F.get("_c", i))
    return _chunks(df, F.transform("_p", lambda p, i: similar(p, i) | shared(i)), most, id_col, text)


def chunk_by_relations(df: DataFrame, embed: Callable[[Column], Column], most: int | None = None, threshold: float = THRESHOLD, id_col: str = "id", text: str = "content", per_text: bool = True, closed: bool = True) -> DataFrame:
    """Joins a paragraph to the one before also where it goes on with a name that the one before has anywhere, or with a word
    that points back: chains of statements about one thing stay together."""
    df, similar = _similar(_with_paragraphs(df, id_col, text), embed, per_text, threshold)
    df = df.withColumn("_c", F.transform("_p", lambda p: candidate_entities(p["text"], closed)))

    def linked(p: Column, i: Column) -> Column:
        names = F.coalesce(F.get("_c", F.greatest(i - 1, F.lit(0))), F.array().cast("array<string>"))
        return (i > 0) & (F.exists(names, lambda n: F.contains(p["text"], n)) | p["text"].rlike(POINTS_BACK))

    return _chunks(df, F.transform("_p", lambda p, i: similar(p, i) | linked(p, i)), most, id_col, text)


def chunk_problems(chunks: DataFrame, least: int = 20, most: int | None = None) -> DataFrame:
    """(id, problem) of chunks that are empty, shorter than `least` or longer than `most` characters, or that end inside a sentence.

    A chunk of a single paragraph is as long as the paragraph: it may be reported as oversized and is right nonetheless.
    """
    length = F.length("text")
    found = F.array_compact(F.array(
        F.when(~F.col("text").rlike(FULL), F.lit("empty")).when(length < least, F.lit("small")), F.when(length > (most or Settings().chunk_size), F.lit("oversized")),
        F.when(F.col("text").rlike(r"(?U)[\p{L}\p{N},;:]\s*\z"), F.lit("broken sentence")),
    ))
    return chunks.select("id", F.explode(found).alias("problem"))
