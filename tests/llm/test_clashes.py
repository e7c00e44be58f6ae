"""Columns of a user with the names that operators use inside stay what they are, in every operator that passes columns through."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, fst_tokens, ppm, quality, queries, secrets, shingles, simhash, urls

NAMES = ("_key", "_text", "_u_key", "row", "_q_w", "t", "repeated", "rejected", "_ids", "_u_salt", "_id", "fp")
TEXT = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, TEXT if i else None, "http://spam-farm.org/x" if i else None) for i in range(2)]
    return spark.createDataFrame(rows, "doc_id long, text string, url string").select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])


PASSING = {
    "keep_one": simhash.keep_one, "keep_one_shingles": shingles.keep_one, "filter_urls": lambda d: urls.filter_urls(d, urls.RULES + urls.PATTERNS), "keep_good": quality.keep_good,
    "apply_rules": quality.apply_rules, "with_fingerprint": lambda d: simhash.with_fingerprint(d, out="print"),
    "clean_rows": lambda d: decontaminate.clean_rows(d, d.limit(0).withColumnRenamed("doc_id", "item_id")),
    "tokens": lambda d: fst_tokens.with_token_counts(d, queries.vocabulary("byte_bpe_50k.json")), "round_trip": lambda d: bpe.round_trip(d, queries.vocabulary("byte_bpe_50k.tiktoken")),
    "with_ids": lambda d: bpe.with_ids(d, queries.vocabulary("byte_bpe_50k.tiktoken")),
}


@pytest.mark.parametrize("name", sorted(PASSING))
def test_names_pass_through(df, name):
    rows = PASSING[name](df).collect()
    assert rows and all(r[n] == f"mine {n}" for r in rows for n in NAMES)


#: Names that operators with results of their own use inside or give to their results.
INSIDE = ("_id", "_key", "_text", "_rare", "_grams", "word", "gram", "times", "c", "p", "n", "key", "done", "token", "spans", "score", "start", "end", "item_id", "edits", "n_hex", "held_out")
OWN = {
    "score": ppm.score, "score_by_joins": lambda d: ppm.score(d, hot=0, hot_grams=0), "secret_report": secrets.secret_report,
    "contaminated": lambda d: decontaminate.contaminated(d, d.where("doc_id = 1").select(d.doc_id.alias("item_id"), "text", d.gram.alias("doc_id"))),
}


@pytest.mark.parametrize("name", sorted(OWN))
def test_names_do_not_matter(spark, name):
    """Null, empty, repeated and very long texts, with the user's columns named like the operator's, give what they give without these columns."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(0, None), (1, TEXT), (2, TEXT + " token = abcdefghijkl"), (2, ""), (3, "deadbeefdeadbeefdeadbeef"), (4, long), (None, "zz")]
    plain = spark.createDataFrame(rows, "doc_id long, text string").withColumn("gram", F.lit("mine"))
    named = plain.select("*", *[F.lit("mine").alias(n) for n in INSIDE if n != "gram"])
    result = lambda d: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in OWN[name](d).collect())
    got = result(named)
    assert got and got == result(plain)
    assert OWN[name](named.limit(0)).collect() == []
