import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, retrieval, search
from lodestone.operators.graph import GraphError
from lodestone.schemas import EVIDENCE, VECTORS, Graph, Subgraph
from tests.corpus import PARAGRAPHS, embed, graph, ids

QUESTION = "What does FastAPI use for data validation?"


def store(spark):
    return spark.createDataFrame([(f"v{i}", f"c{i}", embed(p), None, i) for i, p in enumerate(PARAGRAPHS)], VECTORS)


def test_store(spark):
    s = store(spark)
    got = search.retrieve(s, QUESTION, embed, 4).collect()
    assert [(r.chunk_id, round(r.score, 4)) for r in got] == [("c1", 0.6325), ("c3", 0.4082), ("c0", 0.3536), ("c2", 0.3536)]
    assert search.search(s, embed(QUESTION), 0).collect() == [] and search.search(s, embed(QUESTION), 99).count() == 4 and search.search(s.limit(0), [1.0], 3).collect() == []
    assert search.remove_vector(s, "v1").count() == 3 and search.add_vectors(s, s.withColumn("id", F.concat("id", F.lit("x")))).count() == 8
    for wrong in (lambda: search.remove_vector(s, "none"), lambda: search.add_vectors(s, s.limit(1)), lambda: search.search(s, [1.0], -1)):
        with pytest.raises((GraphError, ValueError)):
            wrong()
    with pytest.raises(Exception, match="different lengths"):
        search.search(s, [1.0], 3).collect()


def test_batch(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 6))
    v[3] = v[90] = v[10]
    v[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for block in (7, 1000):
        got = search.batch_search(rows, rows.where("vec_id % 5 = 0"), 4, block=block).collect()
        for q in range(0, 150, 5):
            want = sorted(range(150), key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:4]
            assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert search.batch_search(rows, rows.limit(0)).collect() == []


def test_mentions(spark):
    x = graph(spark)
    for question, want in ((QUESTION, {"FastAPI"}), ("is the api fast?", {"API"}), ("fast api and PYTHON", {"FastAPI", "Python", "API"}), ("sebastián ramírez", {"Sebastián Ramírez"}), ("nothing", set()), ("fastapis", set())):
        assert ids(retrieval.mentioned_entities(x, question)) == want
    odd = x.entities.limit(1).withColumn("canonical_name", F.lit("C++")).withColumn("aliases", F.array(F.lit(""), F.lit("a.b")))
    y = Graph(odd, x.relationships, x.evidence)
    assert ids(retrieval.mentioned_entities(y, "use c++ now")) == set() and ids(retrieval.mentioned_entities(y, "an a.b here")) == {"FastAPI"} and ids(retrieval.mentioned_entities(y, "an axb here")) == set()


def test_hybrid(spark):
    x = graph(spark)
    found = retrieval.retrieve_hybrid(x, store(spark), QUESTION, embed, depth=1, k=4)
    assert ids(found.subgraph.relationships) == {f"r{i}" for i in range(6)}
    rows = retrieval.rank(x, found).collect()
    assert [(r.relationship_id, round(r.final_score, 4)) for r in rows] == [("r1", 0.841), ("r2", 0.839), ("r3", 0.7354), ("r4", 0.7333), ("r5", 0.7333), ("r0", 0.7314)]
    none = retrieval.retrieve_hybrid(x, store(spark), "nothing", embed, k=2)
    assert [r.relationship_id for r in retrieval.rank(x, none).collect()] == [None, None]
    typed = retrieval.retrieve_graph(x, QUESTION, 1, "USES")
    assert ids(typed.entities) == {"FastAPI", "Pydantic", "Starlette"}
    chunks = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(PARAGRAPHS)], "id string, text string")
    lines = retrieval.context(x, retrieval.rank(x, found), chunks, QUESTION, 2).collect()
    assert [r.section for r in lines] == ["QUESTION", "GRAPH FACTS", "GRAPH FACTS", "SOURCE", "PROVENANCE"] and lines[1].line == "FastAPI --USES--> Pydantic"


def test_by_types(spark):
    x = graph(spark)
    got = lambda found: (ids(found.entities), sorted(r.id for r in found.relationships.collect()))
    assert got(retrieval.retrieve_by_entity_type(x, "Technology")) == ({"FastAPI", "Pydantic", "Starlette"}, ["r1", "r2"])
    assert got(retrieval.retrieve_by_entity_type(x, ("Person", "Concept"))) == ({"Sebastián Ramírez", "API", "Microservices"}, [])
    assert got(retrieval.retrieve_by_entity_type(x, ["Person", "Concept"], around=True)) == ({"Sebastián Ramírez", "API", "Microservices", "FastAPI"}, ["r3", "r4", "r5"])
    assert got(retrieval.retrieve_by_entity_type(x, "Technology", around=True)) == (ids(x.entities), [f"r{i}" for i in range(6)])
    assert got(retrieval.retrieve_by_relationship_type(x, "USES")) == ({"FastAPI", "Pydantic", "Starlette"}, ["r1", "r2"])
    assert got(retrieval.retrieve_by_relationship_type(x, ["USES", "WRITTEN_IN"], 0.94)) == ({"FastAPI", "Pydantic", "Python"}, ["r0", "r1"])
    for nothing in (retrieval.retrieve_by_entity_type(x, "Event"), retrieval.retrieve_by_entity_type(x, [], around=True), retrieval.retrieve_by_relationship_type(x, "PART_OF")):
        assert got(nothing) == (set(), [])
    assert got(retrieval.retrieve_relationships(x, "who uses Pydantic and Starlette?")) == ({"FastAPI", "Pydantic", "Starlette"}, ["r1", "r2"])
    assert got(retrieval.retrieve_relationships(x, "Pydantic, FastAPI", ("USES", "CREATED"), 0.94)) == ({"FastAPI", "Pydantic", "Sebastián Ramírez"}, ["r1", "r3"])
    assert got(retrieval.retrieve_relationships(x, "Python", "USES")) == ({"Python"}, []) and got(retrieval.retrieve_relationships(x, "nothing")) == (set(), [])
    # A loop is one edge, from whichever end it is met.
    loop = Graph(x.entities, x.relationships.unionByName(x.relationships.limit(1).withColumns({"id": F.lit("l"), "target_entity_id": F.col("source_entity_id")})), x.evidence)
    assert got(retrieval.retrieve_by_entity_type(loop, "Technology", around=True))[1].count("l") == got(retrieval.retrieve_relationships(loop, "FastAPI"))[1].count("l") == 1


def test_rank_edge_cases(spark):
    x = graph(spark)
    proof = [("a", "r0", "c0", "t1", 0.5, 0), ("b", "r0", "c0", "t2", 0.5, 1), ("c", "r1", "c1", "t3", 0.5, 2), ("d", "r1", "c2", "t4", 0.5, 3)]
    x = Graph(x.entities, x.relationships, spark.createDataFrame(proof, EVIDENCE))
    hits = spark.createDataFrame([("c0", 0.9), ("c0", -0.2), ("c9", 0.3), ("c9", 0.1)], "chunk_id string, score double")
    rows = {(r.relationship_id, r.chunk_id): r for r in retrieval.rank(x, retrieval.Hybrid(Subgraph(x.entities, x.relationships.where("id in ('r0', 'r1', 'r2')")), hits)).collect()}
    assert set(rows) == {("r0", "c0"), ("r1", None), ("r2", None), (None, "c9")}
    assert rows["r0", "c0"].text == "" and rows["r0", "c0"].vector_score == -0.2 and rows[None, "c9"].vector_score == 0.1
    assert round(rows[None, "c9"].final_score, 6) == 0.04


def test_measures(spark):
    found = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "k string")
    gold = spark.createDataFrame([("b",), ("c",), ("d",)], "k string")
    r = evaluation.precision_recall(found, gold, ["k"]).first()
    assert (r.tp, r.fp, r.fn, round(r.f1, 4)) == (2, 1, 1, 0.6667)
    assert evaluation.precision_recall(found.limit(0), gold.limit(0), ["k"]).first().f1 == 0.0
    ranked = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "query_id int, id string, rank int")
    relevant = spark.createDataFrame([(1, "y"), (1, "w"), (2, "q")], "query_id int, id string")
    got = {r.query_id: (r.recall, r.precision, r.reciprocal_rank) for r in evaluation.retrieval_at_k(ranked, relevant, 2).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0)}
