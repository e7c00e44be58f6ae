"""Paths, communities, doubtful facts, contexts, merges, chunk checks, the cell index, and long documents."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.functions import text as tx
from lodestone.functions.vectors import bag_of_words
from lodestone.operators import chunking, evaluation, retrieval, search, traversal, trust
from lodestone.operators import graph as g
from lodestone.plans import ingest
from lodestone.schemas import EVIDENCE, RELATIONSHIPS
from lodestone.sources import snapshots
from tests.corpus import PARAGRAPHS, graph, simple_graph
from tests.test_graph import dfs


def test_a_path_of_many_hops(spark):
    x = simple_graph(spark, 71, [(i, i + 1, "USES", 1.0) for i in range(70)])
    assert [r.id for r in traversal.find_path(x, "0", "70").orderBy("hop").collect()] == [str(i) for i in range(71)]


def test_depth_first_order_of_a_tree(spark):
    rng = random.Random(2)
    edges = [(i, rng.randrange(i), "USES", 1.0) if rng.random() < 0.5 else (rng.randrange(i), i, "USES", 1.0) for i in range(1, 40)]
    edges += [edges[4], (7, 7, "USES", 1.0)]  # repeated edges and loops close no circle
    x = simple_graph(spark, 40, edges)
    for most in (None, 3):
        assert [r.id for r in traversal.dfs_visit(x, "0", most, max_entities=1).orderBy("place").collect()] == dfs(edges, 0, most)


def cheapest(edges, n, start):
    cost = {start: 0.0}
    for _ in range(n):
        for a, b, _, c in edges:
            for x, y in ((a, b), (b, a)):
                if x in cost:
                    cost[y] = min(cost.get(y, math.inf), cost[x] - math.log(c))
    return cost


@pytest.mark.parametrize("seed", range(2))
def test_weighted_path(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(9), rng.randrange(9), "USES", rng.choice([0.1, 0.5, 0.9, 0.99])) for _ in range(14)]
    x, want = simple_graph(spark, 9, edges), cheapest(edges, 9, 0)
    rows = traversal.weighted_path(x, "0", "8").orderBy("hop").collect()
    if 8 not in want:
        assert rows == []
        return
    assert rows[0].id == "0" and rows[-1].id == "8" and math.isclose(rows[-1].cost, want[8], abs_tol=1e-9)
    steps = {frozenset((str(a), str(b))) for a, b, _, _ in edges}
    assert all(frozenset((p.id, q.id)) in steps for p, q in zip(rows, rows[1:]))
    with pytest.raises(g.GraphError):
        traversal.weighted_path(x, "0", "99")


def test_communities(spark):
    pairs = [(i, j) for base in (0, 4) for i in range(base, base + 4) for j in range(i + 1, base + 4)] + [(3, 4)]
    x = simple_graph(spark, 9, [(a, b, "USES", 1.0) for a, b in pairs])
    found = {int(r.id): r.community for r in traversal.communities(x).collect()}
    assert len({found[i] for i in range(4)}) == 1 and len({found[i] for i in range(4, 8)}) == 1 and found[8] == "8" and found[0] != found[7]


def test_unknown_ids_and_wrong_values(spark):
    x = graph(spark)
    for ask in (lambda: g.outgoing(x, "?"), lambda: g.incoming(x, "?"), lambda: g.neighbors(x, "?"), lambda: g.evidence_of(x, "?")):
        with pytest.raises(g.GraphError):
            ask()
    edge = lambda kind, c: spark.createDataFrame([("new", "FastAPI", "Python", kind, c, None, 99)], RELATIONSHIPS)
    for wrong in (edge("USES", 7.0), edge("USES", None), edge("LIKES", 0.5)):
        with pytest.raises(g.GraphError):
            g.add_relationships(x, wrong)
    assert g.add_relationships(x, edge("USES", 0.5)).relationships.count() == 7
    with pytest.raises(g.GraphError):
        g.add_evidence(x, spark.createDataFrame([("new", "r0", "c", "t", -0.1, 9)], EVIDENCE))
    with pytest.raises(g.GraphError):
        g.add_entities(x, x.entities.limit(1).withColumn("id", F.lit("new")).withColumn("entity_type", F.lit("Event")))


def test_doubtful_facts(spark):
    edges = simple_graph(spark, 3, [(0, 1, "USES", 0.9), (0, 1, "NOT_USES", 0.4), (1, 0, "NOT_USES", 0.4), (1, 2, "USES", 0.5)]).relationships
    assert [tuple(r) for r in trust.contradictions(edges).collect()] == [("0", "1", "USES", "e0", "e1", 0.9, 0.4)]
    dated = spark.createDataFrame([(1, None, None), (2, 5, 9), (3, 9, None), (4, None, 9), (5, 10, 11)], "id int, valid_from int, valid_until int")
    assert sorted(r.id for r in trust.valid_at(dated, F.lit(9)).collect()) == [1, 3]
    proof = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.5), ("s", "a", 1.0), ("t", "c", 0.2)], "relationship_id string, chunk_id string, confidence double")
    got = {r.relationship_id: (round(r.confidence, 6), r.n) for r in trust.combined_confidence(proof).collect()}
    assert got == {"r": (0.75, 2), "s": (1.0, 1), "t": (0.2, 1)}
    rel = spark.createDataFrame([("a", 0.5)], "chunk_id string, reliability double")
    assert {r.relationship_id: round(r.confidence, 6) for r in trust.combined_confidence(proof, rel).collect()} == {"r": 0.625, "s": 0.5, "t": 0.2}
    assert {r.chunk_id: (r.n, r.reliability) for r in trust.source_reliability(proof).collect()} == {"a": (2, 0.5), "b": (1, 2 / 3), "c": (1, 1 / 3)}


def test_context_prompt_and_citations(spark):
    x = graph(spark)
    chunks = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(PARAGRAPHS)], "id string, text string")
    found = retrieval.Hybrid(traversal.bfs_subgraph(x, "Pydantic", 1), spark.createDataFrame([], "chunk_id string, score double"))
    lines = retrieval.context(x, retrieval.rank(x, found), chunks, "What does FastAPI use for validation?")
    text = retrieval.context_text(lines).first()["context"]
    assert text == (
        "QUESTION:\nWhat does FastAPI use for validation?\n\nGRAPH FACTS:\nFastAPI --USES--> Pydantic\n\n"
        f"SOURCE:\n[c1] {PARAGRAPHS[1]}\n\nPROVENANCE:\nc1"
    )
    asked = []
    rows = retrieval.generate(retrieval.context_text(lines), lambda prompt: "Pydantic [c1], says [c9] and [c1]." if text in prompt else "no").collect()
    assert rows[0].answer.startswith("Pydantic") and rows[0].citations == ["c1"] and rows[0].unsupported == ["c9"] and not asked


def test_merge_quality(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), rng.randrange(5)) for i in range(40)]
    df = spark.createDataFrame(rows, "mention int, f int, g int")
    got = evaluation.merge_quality(df.withColumnRenamed("f", "entity"), df.withColumnRenamed("g", "entity")).first()
    pairs = Counter((a[1] == b[1], a[2] == b[2]) for i, a in enumerate(rows) for b in rows[:i])
    assert tuple(got) == (pairs[True, True], pairs[True, False], pairs[False, True])
    empty = df.limit(0)
    assert tuple(evaluation.merge_quality(empty.withColumnRenamed("f", "entity"), empty.withColumnRenamed("g", "entity")).first()) == (0, 0, 0)


def test_chunks_by_relations_and_their_problems(spark):
    paras = ["FastAPI uses Pydantic.", "With Pydantic comes validation.", "This happens before the handler runs.", "Cooking is fun."]
    df = spark.createDataFrame([("d", "\n\n".join(paras))], "id string, content string")
    embed = bag_of_words(["zzz"])
    got = [r.text for r in chunking.chunk_by_relations(df, embed, 800).orderBy("chunk_index").collect()]
    assert got == ["\n\n".join(paras[:3]), paras[3]]
    chunks = spark.createDataFrame([("a", " \n"), ("b", "Short."), ("c", "x" * 30 + "."), ("d", "It ends in the middle of a"), ("e", "y" * 900 + ".")], "id string, text string")
    found = Counter((r.id, r.problem) for r in chunking.chunk_problems(chunks, most=800).collect())
    assert found == Counter([("a", "empty"), ("b", "small"), ("d", "broken sentence"), ("e", "oversized")])


def test_very_many_paragraphs(spark):
    text = "\n\n".join(f"Paragraph number {i}." for i in range(60_000))
    df = spark.createDataFrame([("d", text)], "id string, content string")
    began = time.perf_counter()
    spans = chunking.chunk_by_size(df, 800).select("start_offset", "end_offset", "text").orderBy("start_offset").collect()
    assert time.perf_counter() - began < 60
    assert "\n\n".join(r.text for r in spans) == text and all(r.end_offset - r.start_offset <= 800 for r in spans)
    assert df.select(F.size(tx.paragraphs(F.col("content")))).first()[0] == 60_000


def test_index_finds_what_it_probes(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(c, 0.3) for c in ((9, 0, 0), (0, 9, 0), (0, 0, 9))[i % 3]]) for i in range(300)] + [(300, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    exact = {(r.query_id, r.id, r["rank"]) for r in search.batch_search(df, asked, 5).collect()}
    index = search.build_index(df, cells=6)
    assert index.rows.count() == 301
    every = {(r.query_id, r.id, r["rank"]) for r in search.index_search(index, asked, 5, probes=6).collect()}
    assert every == exact
    some = {(r.query_id, r.id, r["rank"]) for r in search.index_search(index, asked, 5, probes=2).collect()}
    near = {x for x in exact if x[0] < 300}  # the zero vector is near to nothing
    assert len(some & near) >= 0.9 * len(near)
    store = df.withColumn("id", F.col("vec_id").cast("string"))
    assert search.vector_of(store, "7").count() == 1 and search.vector_of(store, "x").isEmpty()


def test_scratch_tables_go(spark):
    df = scratch.written(spark.range(3))
    assert df.count() == 3 and scratch.clean(spark) >= 1 and scratch.clean(spark) == 0


def test_ascii_texts_need_no_composition(spark):
    df = spark.createDataFrame([("abc",), ("é",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.composed(F.col("t"))).collect()] == ["abc", "é", None, ""]


def test_process_with_states(spark, tmp_path):
    def llm(prompt):
        text = prompt.partition("Text:\n")[2]
        if "FastAPI uses" not in text:
            return "no"
        return '{"entities": [{"name": "FastAPI", "entity_type": "Technology"}, {"name": "Pydantic", "entity_type": "Technology"}], "relationships": [{"source": "FastAPI", "target": "Pydantic", "relationship_type": "USES", "evidence": "FastAPI uses Pydantic", "confidence": 0.9}]}'

    docs = spark.createDataFrame([("a", "\n\n".join(PARAGRAPHS)), ("b", "Nothing here."), ("c", "")], "id string, content string")
    path = str(tmp_path / "out")
    made = ingest.process(docs, llm, bag_of_words(["fastapi", "uses"]), path)
    assert {r.document_id: r.state for r in ingest.states(spark, path).collect()} == {"a": "COMPLETED", "b": "FAILED", "c": "COMPLETED"}
    assert made.relationships.count() == 1 and made.entities.count() == 2 and spark.read.parquet(f"{path}/vectors").count() == spark.read.parquet(f"{path}/chunks").count() == 2
    logged = {r.state for r in spark.read.parquet(f"{path}/states").collect()}
    assert logged == {*ingest.STATES, ingest.FAILED}


def test_process_keeps_order_and_goes_on_after_a_failure(spark, tmp_path):
    asked = tmp_path / "asked"

    def llm(prompt):
        name = prompt.partition("Text:\n")[2].split()[0]
        with open(asked, "a") as f:
            f.write(f"{name}\n")
        return f'{{"entities": [{{"name": "{name}", "entity_type": "Concept"}}, {{"name": "Common", "entity_type": "Concept"}}], "relationships": [{{"source": "{name}", "target": "Common", "relationship_type": "USES", "evidence": "said", "confidence": 0.5}}]}}'

    names = [f"{n}{i}" for i, n in enumerate(("Delta", "Beta", "Alpha", "Gamma") * 2)]
    docs = spark.createDataFrame([(f"d{i}", f"{n} uses the common thing.") for i, n in enumerate(names)], "id string, content string").repartition(4)
    path = str(tmp_path / "out")
    with pytest.raises(Exception):  # noqa: B017
        ingest.process(docs, llm, lambda text: F.raise_error(F.lit("no vectors")).cast("array<double>"), path)
    assert {r.state for r in ingest.states(spark, path).collect()} == {ingest.FAILED}
    made = ingest.resume(spark, path, llm, bag_of_words(["uses"]))
    assert {r.state for r in ingest.states(spark, path).collect()} == {"COMPLETED"}
    assert sorted(asked.read_text().split()) == sorted(names)
    assert [r.canonical_name for r in made.entities.orderBy("ord").collect()] == [names[0], "Common", *names[1:]]
    ids = {r.id: r.canonical_name for r in made.entities.collect()}
    assert [ids[r.source_entity_id] for r in made.relationships.orderBy("ord").collect()] == names
    chunks = {r.id: r.document_id for r in spark.read.parquet(f"{path}/chunks").collect()}
    assert [chunks[r.chunk_id] for r in made.evidence.orderBy("ord").collect()] == [chunks[r.chunk_id] for r in spark.read.parquet(f"{path}/vectors").orderBy("ord").collect()] == sorted(chunks.values())
    # Ties go by the order of insertion, so a path over the common entity is the one before saving.
    assert [ids[r.id] for r in traversal.find_path(made, *[next(i for i, n in ids.items() if n == names[k]) for k in (5, 2)]).orderBy("hop").collect()] == [names[5], "Common", names[2]]


def test_versions_and_changes(spark, tmp_path):
    x, path = graph(spark), str(tmp_path / "g")
    first = snapshots.save_graph(x, path)
    second = snapshots.save_graph(g.remove_entity(x, "API"), path)
    assert [r.version for r in snapshots.versions(spark, path).collect()] == [first, second]
    found = {(r.kind, r.id, r.change) for r in snapshots.changes(spark, path, first, second).collect()}
    assert found == {("entities", "API", "removed"), ("relationships", "r4", "removed"), ("evidence", "v4", "removed")}
    assert Counter(r.kind for r in snapshots.to_json(x).collect()) == {"entity": 7, "relationship": 6, "evidence": 6}
