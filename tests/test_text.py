import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.vectors import cosine_similarity, mean_pool
from tests.corpus import TEXT

DIRTY = [
    "", " ", "a", None, "a  b\t\tc \r\nd\r\re   \n\n\n\nf ", "é x  ", " a  \n b\u0085", "\x1c a \x1f", "  　x\n \n \n y", "a\n\n\n\nb\n", "Sebastían", "x" * 3000,
]


def clean(t):
    t = unicodedata.normalize("NFC", t).replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"[ \t]{2,}", " ", t)
    t = re.sub(r"(?m)[ \t]+$", "", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def column(spark, values, f, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(f(F.col("t"))).collect()]


def test_normalize(spark):
    assert column(spark, DIRTY, tx.normalize_text) == [None if t is None else clean(t) for t in DIRTY]
    once = [clean(t) for t in DIRTY if t]
    assert column(spark, once, tx.normalize_text) == once


def test_paragraphs(spark):
    texts = [TEXT, "", "\n\n", "a\n\n\nb", "\na\n\n \n\nb\n", "é\n\n\n\nz"]
    for t, got in zip(texts, column(spark, texts, tx.paragraphs)):
        assert all(t[p["start"] : p["end"]] == p["text"] for p in got)
        assert [p["text"] for p in got] == [s.strip("\n") for s in t.split("\n\n") if s.strip()]


@pytest.mark.parametrize(("text", "want"), [
    ("# One\n\ntext\nmore", [("heading", "One", 1), ("paragraph", "text\nmore", None)]),
    ("Title\n===\n\nSub\n---\n\n---", [("heading", "Title", 1), ("heading", "Sub", 2), ("paragraph", "---", None)]),
    ("- item\n---", [("heading", "- item", 2)]),
    ("- a\n* b\n2) c\n\n> q\n> r\n\nintro\n- a", [("list", "- a\n* b\n2) c", None), ("quote", "> q\n> r", None), ("paragraph", "intro\n- a", None)]),
    ("x\n\n```py\na = 1\n\nb\n```\n\n####### no", [("paragraph", "x", None), ("code_block", "a = 1\n\nb", None), ("paragraph", "####### no", None)]),
    ("", []), ("T\n==", [("paragraph", "T\n==", None)]), ("###### six", [("heading", "six", 6)]), ("```\n```", [("paragraph", "```\n```", None)]),
])
def test_structure(spark, text, want):
    assert [tuple(b) for b in column(spark, [text], tx.structure)[0]] == want


def test_names(spark):
    assert column(spark, ["Sebastián Ramírez created FastAPI and GPT5. The End The End"], tx.candidate_entities)[0] == ["Sebastián Ramírez", "FastAPI", "The End The End"]
    assert column(spark, ["Sebastián", "C++", "C#", "c", "東京", "GPT-5 Turbo"], tx.name_key) == ["sebastin", "c", "c", "c", "", "gpt5turbo"]


def test_runs_of_names_of_any_length(spark):
    """Five times as many names as a stack of 1 MB holds; before, the task's JVM ended."""
    text = "Xaver " * 20000
    df = spark.createDataFrame([(1, text)], "id int, t string")
    for closed in (True, False):
        assert df.select(tx.candidate_entities(F.col("t"), closed)).first()[0] == [text.strip()]


def test_names_before_digits_and_marks(spark):
    texts = ["The AKIAAGG4PCT and A_b", "Jose\u0301 Cruz", "One\u000bTwo\u00a0Three", "Area\u00b2 \u2164I Xy\u216b", "\u0301Ab 4Cd _Ef \U0001d400Gh", "A1 B2 C", "", "Ab,Cd"]
    pattern = re.compile(r"\b[A-Z][^\W\d_]*(?:\s+[A-Z][^\W\d_]*)*\b")
    assert column(spark, texts, tx.candidate_entities) == [list(dict.fromkeys(pattern.findall(t))) for t in texts]
    loose = re.compile(r"(?<!\w)[A-Z][^\W\d_]*(?:[\t\n\f\r ]+[A-Z][^\W\d_]*)*")
    assert column(spark, texts, lambda c: tx.candidate_entities(c, closed=False)) == [list(dict.fromkeys(loose.findall(t))) for t in texts]
    import duckdb

    from lodestone.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INTEGER, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    got = column(spark, texts, lambda c: tx.candidate_entities(c, closed=False))
    assert sorted(con.execute(ORACLE_SQL["candidate_entities"]).fetchall()) == sorted((i, name) for i, names in enumerate(got) for name in names)


def test_the_query_takes_the_names_of_its_sql(spark, tmp_path):
    import duckdb

    from lodestone.queries import ORACLE_SQL, QUERIES

    spark.createDataFrame([(1, "The AKIAAGG4PCT and Some_thing"), (2, "GPT5 Turbo"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["candidate_entities"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE_SQL["candidate_entities"]).fetchall()) and (2, "GPT") in got


def test_similarity(spark):
    rows = spark.createDataFrame([("Pydantic", "Pydnatic"), ("GPT-5", "GPT5"), ("GPT-5", "OpenAI GPT-5"), ("", ""), ("a", ""), ("é", "e")], "a string, b string")
    got = [tuple(round(x, 4) for x in r) for r in rows.select(tx.levenshtein_similarity(F.col("a"), F.col("b")), tx.jaccard_tokens(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.75, 0.0), (0.8, 0.0), (0.4167, 0.5), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 4) for r in rows.select(cosine_similarity(F.col("a"), F.col("b"))).collect()] == [0.7071, 0.0]
    assert spark.range(1).select(mean_pool(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))))).first()[0] == [2.0, 3.0]
    with pytest.raises(Exception, match="different lengths"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(cosine_similarity(F.col("a"), F.col("b"))).collect()


def test_prompt(spark):
    ask, again = (column(spark, ["Some chunk."], lambda c, s=s: tx.extraction_prompt(c, s))[0] for s in (False, True))
    assert all(x in ask for x in ("Some chunk.", "ProgrammingLanguage", "WORKS_FOR", "confidence")) and again.startswith(ask) and len(again) > len(ask)
