"""Text functions on columns. Java needs (?U) for Unicode classes, and (?d) for line ends that are line feeds only."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.arrays import let, scan
from lodestone.schemas import ENTITY_TYPES, RELATIONSHIP_TYPES

#: White space as Unicode has it, and the four separators that Java leaves out.
EDGES = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
FULL = r"(?U)[^\s\x1c-\x1f]"

# The forms of blocks and of candidate names.
FENCE = r"(?s)```[^\n]*\n(.*?)\n```"
UNDERLINE_1 = r"^={3,}$"
UNDERLINE_2 = r"^-{3,}$"
HEADING = r"(?Us)^(#{1,6})\s+(.+)$"
LIST_ITEM = r"(?U)^\s*(?:[-*+]|\d+[.)])\s+"
QUOTE = r"(?U)^\s*>"
# Possessive: each turn of a group that may give back takes frames of the stack, and a text may be one run of names.
NAME = r"[A-Z][\p{L}\p{Nl}\p{No}]*+"
CAPITALIZED = rf"(?U)(?:^|[^\p{{L}}\p{{N}}_])({NAME}(?![\p{{Nd}}_])(?:\s++{NAME}(?![\p{{Nd}}_]))*+)"
CAPITALIZED_OPEN = rf"(?:^|[^\p{{L}}\p{{N}}_])({NAME}(?:[\t\n\f\r ]++{NAME})*+)"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """nfc(text); a text of ASCII characters alone is composed already and stays in the JVM."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, text).otherwise(nfc(F.when(~plain, text)))


def with_name_key(rows: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """rows with name_key(name); those with an ASCII name do not pass through Python at all, so rows is read twice."""
    plain = F.length(name) == F.octet_length(name)
    return rows.where(plain).withColumn(key, _letters(F.lower(name))).unionByName(rows.where(~F.coalesce(plain, F.lit(False))).withColumn(key, name_key(F.col(name))))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def normalize_text(text: Column) -> Column:
    """Composed characters, line feeds, single blanks, no blanks at line ends, at most one blank line, no white space around."""
    out = F.regexp_replace(composed(text), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    out = F.regexp_replace(out, r"(?md)[ \t]+$", "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """array<struct<start, end, text>>: parts between blank lines that hold more than white space; code-point offsets."""

    def step(at: Column, part: Column) -> Column:
        lead = F.length(part) - F.length(F.regexp_replace(part, r"\A\n+", ""))
        body = F.regexp_replace(part, r"\A\n+|\n+\z", "")
        found = F.struct((at + lead).alias("start"), (at + lead + F.length(body)).alias("end"), body.alias("text"))
        none = F.array().cast("array<struct<start:int,end:int,text:string>>")
        return F.struct((at + F.length(part) + 2).alias("state"), F.when(part.rlike(FULL), F.array(found)).otherwise(none).alias("out"))

    return let(F.split(text, "\n\n"), lambda parts: scan(parts, F.lit(0), step, "struct<start:int,end:int,text:string>")["out"])


def _block(kind: str, text: Column, level: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("block_type"), text.alias("text"), (F.lit(None) if level is None else level).cast("int").alias("level"))


def classify_segment(segment: Column) -> Column:
    """The block of a text without blank lines: underlined heading, marked heading, list, quote, paragraph, in this order."""
    lines = F.split(segment, "\n")
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    return (
        F.when((F.size(lines) == 2) & second.rlike(UNDERLINE_1), _block("heading", first, F.lit(1)))
        .when((F.size(lines) == 2) & second.rlike(UNDERLINE_2), _block("heading", first, F.lit(2)))
        .when((F.size(lines) == 1) & segment.rlike(HEADING), _block("heading", F.regexp_extract(segment, HEADING, 2), F.length(F.regexp_extract(segment, HEADING, 1))))
        .when(F.forall(lines, lambda x: x.rlike(LIST_ITEM)), _block("list", segment))
        .when(F.forall(lines, lambda x: x.rlike(QUOTE)), _block("quote", segment))
        .otherwise(_block("paragraph", segment))
    )


def structure(text: Column) -> Column:
    """array<struct<block_type, text, level>>: fenced code, and the classified segments between."""

    def segments(region: Column) -> Column:
        full = F.filter(F.split(region, "\n\n"), lambda s: s.rlike(FULL))
        return F.transform(full, lambda s: classify_segment(F.regexp_replace(s, r"\A\n+|\n+\z", "")))

    code = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    return F.flatten(F.zip_with(F.split(text, FENCE), code, lambda r, c: F.concat(segments(r), F.when(c.isNotNull(), F.array(_block("code_block", c))).otherwise(F.array().cast("array<struct<block_type:string,text:string,level:int>>")))))


def candidate_entities(text: Column, closed: bool = True) -> Column:
    """Different runs of capitalized words, in order of appearance. closed: a word that a digit or underscore follows is none;
    else its letters are, as engines without a look ahead have it, and only ASCII white space stands between words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALIZED if closed else CAPITALIZED_OPEN), F.lit(1)))


def light_key(name: Column) -> Column:
    return F.lower(composed(name))


def name_key(name: Column) -> Column:
    """Lower-cased ASCII letters and digits; names without any share the empty key."""
    return _letters(light_key(name))


def _letters(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-z0-9]+", "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def jaccard_tokens(a: Column, b: Column) -> Column:
    tokens = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def quoted(text: Column) -> Column:
    """text as a regular expression that matches it alone."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}\s_])", r"\\$1")


def prompt_around(strict: bool = False) -> tuple[str, str]:
    """What stands before and after the chunk in extraction_prompt."""
    ask = (
        "List the entities in the text and the relationships that it states between them.\n"
        f"Entity types: {', '.join(ENTITY_TYPES)}\nRelationship types: {', '.join(RELATIONSHIP_TYPES)}\n"
        "Use no other types. Give each relationship the sentence that states it as evidence, and a confidence from 0.0 to 1.0.\n"
        'Answer with JSON only: {"entities": [{"name": "", "entity_type": ""}], "relationships": [{"source": "", "target": "", '
        '"relationship_type": "", "evidence": "", "confidence": 0.0}]}\n\nText:\n'
    )
    return ask, "\n\nThe last answer could not be used. Answer with the JSON object alone, without fences or remarks." if strict else ""


def extraction_prompt(chunk: Column, strict: bool = False) -> Column:
    """What the language model is asked for a chunk."""
    before, after = prompt_around(strict)
    return F.concat(F.lit(before), chunk, F.lit(after))
