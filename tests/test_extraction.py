import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extraction as x
from lodestone.plans.ingest import ingest
from lodestone.sources.clients import ChatClient, ClientError, EmbeddingClient
from lodestone.streaming.chunks import write_chunks
from tests.corpus import LINKS, NODES, PARAGRAPHS, TEXT


def answer(**change):
    rel = {"source": "a", "target": "b", "relationship_type": "USES", "evidence": "a uses b", "confidence": 0.5} | change
    return json.dumps({"entities": [{"name": "a", "entity_type": "Concept"}, {"name": "b", "entity_type": "Project", "extra": 1}], "relationships": [rel]})


@pytest.mark.parametrize(("raw", "ok"), [
    (answer(), True), ("{}", True), (answer(confidence="0.9"), True), (answer(confidence=True), True), ("[]", False), ("no", False), (None, False), ("null", False),
    (answer(confidence=1.2), False), (answer(confidence=None), False), (answer(relationship_type="USED_FOR"), False), (answer(source=3), False),
    ('{"entities": [{"name": 1, "entity_type": "Concept"}]}', False), ('{"entities": [{"name": "a"}]}', False), ('{"entities": 5}', False), (answer(relationship_type=["USES"]), False),
])
def test_parse(raw, ok):
    assert (x.parse_answer(raw) is not None) == ok


def test_errors(spark):
    raws = [answer(), answer(source="z"), answer(target="z", evidence="  "), "broken", "{}"]
    rows = x.parse_answers(spark.createDataFrame(list(enumerate(raws)), "i int, raw string")).orderBy("i").collect()
    assert [None if r.errors is None else len(r.errors) for r in rows] == [0, 1, 2, None, 0]
    assert [r.entities is not None for r in rows] == [True, False, False, False, True]


def test_retry(spark):
    def llm(prompt):
        if "first time" in prompt and "could not be used" not in prompt:
            return "oops"
        if "never" in prompt:
            return answer(source="z")
        if "fails" in prompt:
            raise RuntimeError("no network")
        return answer()

    df = spark.createDataFrame([("good",), ("first time bad",), ("never good",)], "text string")
    rows = {r.text: r for r in x.extract(df, llm).collect()}
    assert [(rows[t].attempts, rows[t].entities is not None) for t in ("good", "first time bad", "never good")] == [(1, True), (2, True), (2, False)]
    bad = spark.createDataFrame([("fails",)], "text string")
    assert x.extract(bad, llm, on_error="skip").first().entities is None
    with pytest.raises(Exception, match="no network"):
        x.extract(bad, llm).collect()


def reader(prompt):
    """What the corpus says, for each of its paragraphs."""
    k = next(i for i, p in enumerate(PARAGRAPHS) if p in prompt.partition("Text:")[2])
    rels = [r for r in LINKS if r[4] == k]
    named = {n for r in rels for n in r[:2]}
    return json.dumps({
        "entities": [{"name": n, "entity_type": t} for n, t, _ in NODES if n in named],
        "relationships": [{"source": a, "target": b, "relationship_type": t, "evidence": PARAGRAPHS[k], "confidence": c} for a, b, t, c, _ in rels],
    })


def test_ingest(spark):
    df = spark.createDataFrame([("doc", TEXT.replace("\n", "\r\n")), ("none", None)], "id string, content string")
    from lodestone.operators.chunking import chunk_by_size

    chunks, graph = ingest(df, reader, lambda d: chunk_by_size(d, 60))
    assert (chunks.count(), graph.entities.count(), graph.relationships.count(), graph.evidence.count()) == (4, 7, 6, 6)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", TEXT), ("b", "x\n\ny")], "id string, content string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("document_id").agg(F.count("*")).count() == 2


def test_clients():
    sent = []

    def post(status, text):
        return lambda url, headers, body, seconds: sent.append((url, headers, body, seconds)) or (status, text)

    assert ChatClient("k", "m", post(200, '{"choices": [{"message": {"content": "hi"}}]}')).complete("p") == "hi"
    assert sent[0][1] == {"Authorization": "Bearer k"} and sent[0][2]["messages"] == [{"role": "user", "content": "p"}] and sent[0][3] == 60
    assert EmbeddingClient("k", "m", post(200, "[1, 2.5]")).embed("t") == [1.0, 2.5] and sent[1][3] == 30 and "models/m" in sent[1][0]
    assert EmbeddingClient("k", "m", post(200, "[[1, 2], [3, 4]]")).embed("t") == [2.0, 3.0]
    for wrong in (lambda: ChatClient(None), lambda: EmbeddingClient(None), lambda: ChatClient("k", "m", post(500, "")).complete(""), lambda: ChatClient("k", "m", post(200, "{}")).complete(""), lambda: EmbeddingClient("k", "m", post(200, "{}")).embed(""), lambda: EmbeddingClient("k", "m", post(200, "x")).embed("")):
        with pytest.raises(ClientError):
            wrong()
