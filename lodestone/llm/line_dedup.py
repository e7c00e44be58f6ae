"""Line deduplication by winnowing over line hashes (built-in functions only).

A document is its sequence of lines; lines without a word are left where they are and take no part. From each line, the
shortest run of lines with at least `gram_words` words is a gram. Every stretch of lines with at least `min_words`
words holds the grams of a window; the window's least gram hash is a fingerprint. Two equal stretches of `min_words`
words hold equal windows, so they share a fingerprint: none is missed.

Each place of a fingerprint that occurs more than once sends on the least stretches of `min_words` words through it: those
that begin at a line and those that end at one. Equal stretches meet by their hashes with the first of them, in the order of
id and line; it does not matter with which earlier place a passage agrees. The later stretches' lines are deleted, and every line of a
repeated run is in such a stretch within the run. A deleted line always has an equal one earlier, so the first copy of everything stays.

Defined results: a null text stays null and has no lines; ids may repeat, rows are then ordered by a hash of their
text; rows with equal id and text are one document, each gets the same result; null ids come first. Extra columns pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestone.llm.common import as_row, materialize, words_of

MIN_WORDS, GRAM_WORDS = 50, 25
KEY = ("_d_id", "_d_hash")
#: A stretch with more places than one in so many fingerprints is hot.
HOT_SHARE = 1000


def _keys(id_col: str, text: str) -> dict[str, Column]:
    return {"_d_id": F.col(id_col), "_d_hash": F.xxhash64(text)}


def line_table(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document and line with a word: the key, pos, h (hash), n (words)."""
    lines = F.transform(
        F.split(F.col(text), "\n"), lambda line, i: F.struct(i.alias("pos"), F.xxhash64(F.btrim(line, F.lit(" \t\r"))).alias("h"), F.size(words_of(line)).alias("n"))
    )
    packed = df.where(F.col(text).isNotNull()).select(*[c.alias(k) for k, c in _keys(id_col, text).items()], F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    # One row per document, though rows repeat; from here on a document's lines stay in one partition.
    return packed.groupBy(*KEY).agg(F.first("lines").alias("lines")).select(*KEY, F.inline("lines"))


def fingerprints(lines: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """The chosen grams: g, the key, pos, near (line numbers around), and the stretches through pos as array<struct<h, first, last>>.

    `at` counts the words before a line and `upto` those to its end, so a frame over their values is a stretch of so many words.
    """
    # A line counts for at most min_words words: that decides no threshold, and bounds the frames after a long line.
    lines = lines.withColumn("n", F.least("n", F.lit(min_words)))
    doc = W.partitionBy(*KEY)
    order = doc.orderBy("pos")
    rows = lines.withColumn("at", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    rows = rows.withColumn("upto", F.col("at") + F.col("n"))
    by_words, by_ends = doc.orderBy("at"), doc.orderBy("upto")
    ahead = lambda words: by_words.rangeBetween(0, words)
    begun, ended = ahead(min_words - 1), by_ends.rangeBetween(1 - min_words, 0)
    rows = rows.withColumns({
        "gram": F.collect_list("h").over(ahead(gram_words - 1)),
        "gram_n": F.sum("n").over(ahead(gram_words - 1)),
        "left": F.sum("n").over(by_words.rangeBetween(0, W.unboundedFollowing)),
        "begun": F.struct(F.xxhash64(F.collect_list("h").over(begun)).alias("h"), F.col("pos").alias("first"), F.max("pos").over(begun).alias("last")),
        "ended": F.struct(F.xxhash64(F.collect_list("h").over(ended)).alias("h"), F.min("pos").over(ended).alias("first"), F.col("pos").alias("last")),
    })
    through = F.collect_list(F.when(F.col("left") >= min_words, F.col("begun"))).over(by_words.rangeBetween(1 - min_words, 0))
    through = F.array_union(through, F.collect_list(F.when(F.col("upto") >= min_words, F.col("ended"))).over(by_ends.rangeBetween(0, min_words - 1)))
    rows = rows.withColumns({"stretches": through, "near": F.collect_list("pos").over(by_words.rangeBetween(-2 * min_words, 2 * min_words))})
    rows = rows.withColumn("g", F.when(F.col("gram_n") >= gram_words, F.xxhash64("gram")))
    least = F.min(F.when(F.col("g").isNotNull(), F.struct("g", (-F.col("at")).alias("back")))).over(ahead(min_words - gram_words))
    rows = rows.withColumn("chosen", F.when(F.col("left") >= min_words, -least.getField("back")))
    wanted = F.collect_set("chosen").over(by_words.rangeBetween(-(min_words - gram_words), 0))
    rows = rows.withColumn("wanted", F.array_contains(wanted, F.col("at")))
    return rows.where("wanted").select("g", *KEY, "pos", "near", "stretches")


def repeated_runs(prints: DataFrame) -> DataFrame:
    """One row per later stretch: the key, and the stretch's line numbers as run."""
    copied = prints.groupBy("g").agg(F.count("*").alias("copies")).where("copies > 1").select("g")
    rows = prints.join(copied, "g", "left_semi").select(*KEY, "near", F.inline("stretches"))
    rows = rows.select("h", F.struct(*KEY, "first").alias("mine"), F.filter("near", lambda x: (x >= F.col("first")) & (x <= F.col("last"))).alias("run"))
    # Neighbouring fingerprints send the same stretch: two places differ.
    first = rows.groupBy("h").agg(F.min("mine").alias("source"), F.max("mine").alias("end"), F.count("*").alias("n")).where(F.col("source") < F.col("end")).select("h", "source", "n")
    # A place sends at most two stretches per line of min_words words, so hot stretches number 2 * MIN_WORDS * HOT_SHARE at most: they are
    # broadcast, and their rows are dealt out by another key than the stretch.
    most = prints.count() // HOT_SHARE
    hot = F.broadcast(first.where(F.col("n") > most).select("h", F.col("source").alias("hot_source")))
    calm = first.where(F.col("n") <= most).select(F.col("h").alias("k"), "source")
    rows = rows.join(hot, "h", "left").withColumn("k", F.when(F.col("hot_source").isNull(), F.col("h")).otherwise(F.xxhash64("mine", "h")))
    source = F.coalesce("hot_source", "source")
    return rows.join(calm, "k", "left").where(F.col("mine") > source).select("mine.*", "run").drop("first")


def removals(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """The key and the line numbers to delete, for each document that has any."""
    prints = materialize(fingerprints(line_table(df, id_col, text), min_words, gram_words), "fingerprints")
    gone = F.array_sort(F.array_distinct(F.flatten(F.collect_set("run"))))
    return repeated_runs(prints).groupBy(*KEY).agg(gone.alias("removed"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, removed: str = "removed_lines") -> DataFrame:
    """df with the lines of later repeated runs deleted from its text, and their numbers (from 0) as a new column."""
    gone = removals(df, id_col, text, min_words, gram_words)
    columns = [c for c in df.columns if c != removed]
    keyed = df.select(as_row(df, columns).alias("row"), *[c.alias(k) for k, c in _keys(id_col, text).items()]).alias("d")
    same = F.col("d._d_id").eqNullSafe(F.col("r._d_id")) & (F.col("d._d_hash") == F.col("r._d_hash"))
    out = keyed.join(gone.alias("r"), same, "left").select("row", F.coalesce("r.removed", F.array().cast("array<int>")).alias("_d_removed"))
    whole = F.col("row").getField(text)
    lines = F.split(whole, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_d_removed")
    # Line numbers first and lines after, so that the split text is not made again for each line.
    out = out.withColumn("_d_lines", F.when(F.size("_d_removed") > 0, lines)).withColumn("_d_kept", F.when(F.size("_d_removed") > 0, kept))
    cleaned = F.array_join(F.transform("_d_kept", lambda i: F.coalesce(F.get("_d_lines", i), F.lit(""))), "\n")
    out = out.withColumn("_d_text", F.when(F.size("_d_removed") > 0, cleaned).otherwise(whole))
    return out.select(*[F.col("_d_text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns], F.col("_d_removed").alias(removed))
