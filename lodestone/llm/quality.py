"""Quality rules as a short-circuit cascade (built-in functions only).

Every rule is one boolean SQL expression over the text and its counts. On a small sample the cascade measures what a rule costs and
how many rows it rejects, and asks the rules in the order of rejections per second. The rules stand in one CASE
expression: a row that one rule rejects never evaluates the later ones. The order changes the run time and the name of
the rule that is reported, never which rows are kept.

A null text is an empty one; it has no words and is rejected by the default rules. Rows with equal ids are judged
one by one; extra columns pass through, and an empty table gives an empty result.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACE, as_row, text_of, words_of

WINDOW = 8
SYMBOLS = r"[^#*$%&|<>]+"


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = _lines(text)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeat_words(df: DataFrame, text: str, out: str, prefix: str = "_q_") -> DataFrame:
    """Adds the number of words that lie in 8-word windows found twice or more in the text.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts with an equal pair of windows sort them:
    equal neighbours in the sorted array give the windows' positions, and gaps between positions give the words.
    """
    p = prefix
    df = df.withColumn(p + "w", F.transform(words_of(text_of(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn(
        p + "h",
        F.when(
            F.size(p + "w") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(p + "w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(p + "w", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn(
        p + "s",
        F.when(
            F.size(F.array_distinct(p + "h")) < F.size(p + "h"),
            F.sort_array(F.transform(p + "h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    same = lambda e, other: F.coalesce(other.getField("h") == e.getField("h"), F.lit(False))
    df = df.withColumn(
        p + "p",
        F.when(
            F.col(p + "s").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(p + "s", lambda e, j: same(e, F.get(p + "s", j - 1)) | same(e, F.get(p + "s", j + 1))),
                    lambda e: e.getField("i"),
                )
            ),
        ),
    )
    gap = lambda x, k: F.coalesce(F.least(F.get(p + "p", k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
    df = df.withColumn(
        out,
        F.when(F.col(p + "p").isNull(), F.lit(0)).otherwise(F.aggregate(F.transform(p + "p", gap), F.lit(0), lambda a, x: a + x)).cast("long"),
    )
    return df.drop(p + "w", p + "h", p + "s", p + "p")


@dataclass(frozen=True)
class Rule:
    """reject: whether the text is bad, from its Measures."""

    name: str
    reject: callable


@dataclass(frozen=True)
class Measures:
    """What rules ask of a text: columns where they are there already, expressions over the text elsewhere."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_lines: Column
    n_dup_lines: Column


def measures(text: Column, **known: Column) -> Measures:
    return Measures(text, **{f.__name__: known.get(f.__name__, f(text)) for f in (n_words, word_chars, n_symbols, n_lines, n_dup_lines)})


def _caps(m: Measures) -> Column:
    text = m.text
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return upper * 2 > F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))


def _mean_length(m: Measures) -> Column:
    return (m.word_chars < 2 * m.n_words) | (m.word_chars > 20 * m.n_words)


#: The share of symbols, repeated lines, capitals and lines cut short that published web filters reject, on the lenient side.
DEFAULT_RULES = (
    Rule("few_words", lambda m: m.n_words < 20),
    Rule("symbols", lambda m: m.n_symbols * 10 > m.n_words * 3),
    Rule("dup_lines", lambda m: m.n_dup_lines * 10 > m.n_lines * 3),
    Rule("word_length", _mean_length),
    Rule("capitals", _caps),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-12)


def estimate(df: DataFrame, rules=DEFAULT_RULES, text: str = "text", sample_rows: int = 256, sample_bytes: int = 100_000, seconds: float = 0.25) -> list[Estimate]:
    """Cost (seconds a text) and selectivity of each rule on a sample: at most sample_rows texts of at most sample_bytes each, picked by their hashes.

    A rule is timed over copies of the sample, as many as it takes for a pass without any rule to be small beside it: twice as many
    each time, until the rule needs `seconds`, 64 at most. What the empty pass takes is subtracted, so scheduling is no cost.
    """
    spark = df.sparkSession
    whole = df.select(text_of(text).alias("t")).where(F.octet_length("t") <= sample_bytes)
    share = max(1, df.count() // (4 * sample_rows))
    rows = whole.where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0).take(sample_rows) or whole.take(sample_rows)
    if not rows:
        return [Estimate(r, 1.0, 0.0) for r in rules]
    # One partition: what is timed is the rule, not the scheduling.
    sample = spark.createDataFrame(rows, "t string").coalesce(1).persist()
    sample.count()
    copied = lambda n: sample.select("t", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"))

    def timed(condition: Column, n: int) -> tuple[float, int]:
        job = copied(n).where(condition)
        if n == 1:
            job.count()  # compiles
        began = time.perf_counter()
        found = job.count()
        return time.perf_counter() - began, found

    found = []
    for rule in rules:
        # The copy's number keeps the rule from being taken out of the pass over the copies.
        reject, n = rule.reject(measures(F.concat(F.col("t"), F.substring(F.col("copy").cast("string"), 1, 0)))), 1
        took, rejected = timed(reject, n)
        share = rejected / len(rows)
        while took < seconds and n < 64:
            n *= 2
            took = timed(reject, n)[0]
        found.append(Estimate(rule, max(took - timed(F.col("copy") < 0, n)[0], 1e-6) / (n * len(rows)), share))
    sample.unpersist()
    return found


def order_rules(estimates: list[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.worth, e.seconds))]


def cascade(text: Column, rules, **known: Column) -> Column:
    """The name of the first rule that rejects the text, or null. known: measures that are columns already."""
    asked = measures(text, **known)
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        out = F.when(rule.reject(asked), F.lit(rule.name)).otherwise(out)
    return out


def apply_rules(df: DataFrame, rules=DEFAULT_RULES, text: str = "text", out: str = "rejected_by", sample_rows: int = 256) -> DataFrame:
    """df with the name of a rule that rejects the row, null for rows that are kept."""
    ordered = order_rules(estimate(df, rules, text, sample_rows))
    return df.withColumn(out, cascade(text_of(text), ordered))


def quality_report(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules=DEFAULT_RULES) -> DataFrame:
    """One row per document: the counts that the base verdict needs, the base verdict, and what the cascade keeps.

    Rows that the base verdict rejects skip the cascade.
    """
    ordered = order_rules(estimate(df, rules, text))
    t = F.col("_t")
    out = with_repeat_words(df.select(F.col(id_col).alias(id_col), text_of(text).alias("_t")), "_t", "n_repeat_words")
    out = out.withColumns(
        {"n_words": n_words(t), "word_chars": word_chars(t), "n_symbols": n_symbols(t), "n_dup_lines": n_dup_lines(t)}
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(t, ordered, **{n: F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines")})))
    return out.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept")
    )


def keep_good(df: DataFrame, text: str = "text", rules=DEFAULT_RULES) -> DataFrame:
    """The rows that neither the rules nor the share of repeated windows reject, with the columns they came with."""
    rows = df.select(as_row(df).alias("row"), text_of(text).alias("t"))
    out = apply_rules(rows, rules, "t", "rejected").where(F.col("rejected").isNull())
    # A value that is not deterministic stays where it is: the filter's push-down would copy the steps into each other.
    out = with_repeat_words(out, "t", "repeated").withColumn("repeated", F.col("repeated") + F.least(F.spark_partition_id(), F.lit(0)))
    return out.where(100 * F.col("repeated") <= 30 * n_words(F.col("t"))).select("row.*")
