import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.functions.vectors import bag_of_words, embed_with
from lodestone.operators import chunking
from tests.corpus import TEXT, WORDS, embed


def spans(df):
    return [(r.start_offset, r.end_offset) for r in df.orderBy("document_id", "chunk_index").collect()]


def doc(spark, text):
    return spark.createDataFrame([("d", text)], "id string, content string")


@pytest.mark.parametrize(("most", "n"), [(1000, 1), (60, 4), (100, 3)])
def test_by_size(spark, most, n):
    rows = chunking.chunk_by_size(doc(spark, TEXT), most).collect()
    assert len(rows) == n and all(TEXT[r.start_offset : r.end_offset] == r.text for r in rows)


@pytest.mark.parametrize(("threshold", "most", "n"), [(0.75, 1000, 4), (0.0, 1000, 1), (0.35, 1000, 3), (0.4, 30, 4)])
def test_by_similarity(spark, threshold, most, n):
    assert len(spans(chunking.chunk_by_similarity(doc(spark, TEXT), bag_of_words(WORDS), most, threshold))) == n
    assert len(spans(chunking.chunk_by_similarity(doc(spark, TEXT), embed_with(embed), most, threshold, per_text=False))) == n


@pytest.mark.parametrize(("text", "most", "n"), [(TEXT, 1000, 1), (TEXT, 30, 4), ("FastAPI uses Pydantic.\n\nPydantic provides validation.", 1000, 1), ("One thing here.\n\nanother matter.", 1000, 2)])
def test_by_entities(spark, text, most, n):
    turn = embed_with(lambda t: [1.0, 0.0] if t.startswith(("FastAPI", "One")) else [0.0, 1.0])
    assert len(spans(chunking.chunk_by_entities(doc(spark, text), turn, most, per_text=False))) == n


def test_no_content(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " \n\n\n")], "id string, content string")
    assert chunking.chunk_by_size(df).collect() == [] and chunking.chunk_by_similarity(df, bag_of_words(WORDS)).collect() == []


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["ab", "c" * 30, "é" * 12, "x y"]), max_size=8), min_size=1, max_size=12), st.integers(5, 90))
def test_fold(spark, documents, most):
    texts = ["\n\n".join(d) for d in documents]
    want = []
    for i, parts in enumerate(documents):
        at, start, end = 0, None, None
        for p in parts:
            if start is not None and at + len(p) - start <= most:
                end = at + len(p)
            else:
                want += [(i, start, end)] * (start is not None)
                start, end = at, at + len(p)
            at += len(p) + 2
        want += [(i, start, end)] * (start is not None)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    assert sorted((r.document_id, r.start_offset, r.end_offset) for r in chunking.chunk_by_size(df, most).collect()) == want


def test_ties_with_the_threshold(spark):
    """Cosines of exactly 0.75 whose rounding depends on the order of the divisions: the SQL divides by one norm after the other."""
    text = "left\n\nright"
    rows = [chunk(doc(spark, text), embed_with(lambda t: [1.0, 2.0, 5.0, 1.0, 3.0] if t == "left" else [0.0, 1.0, 1.0, 2.0, 2.0]), 1000, per_text=False) for chunk in (chunking.chunk_by_similarity, chunking.chunk_by_entities, chunking.chunk_by_relations)]
    assert [spans(r) for r in rows] == [[(0, 11)]] * 3


def test_a_paragraph_of_names_of_any_length(spark):
    text = "Xaver " * 20000 + "\n\nsome other matter."
    for chunk in (chunking.chunk_by_entities, chunking.chunk_by_relations):
        for closed in (True, False):
            assert spans(chunk(doc(spark, text), bag_of_words(WORDS), 1000, closed=closed)) == [(0, 120000), (120002, 120020)]


def test_names_before_digits(spark):
    """Open names are those of the queries' SQL: the letters of a word with a digit in it are a name."""
    turn = embed_with(lambda t: [1.0, 0.0] if t.startswith("GPT4") else [0.0, 1.0])
    for chunk in (chunking.chunk_by_entities, chunking.chunk_by_relations):
        for closed, n in ((True, 2), (False, 1)):
            assert len(spans(chunk(doc(spark, "GPT4 is one.\n\nand GPT5 another."), turn, 1000, per_text=False, closed=closed))) == n
