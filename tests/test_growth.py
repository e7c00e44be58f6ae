"""What the rounds of graph queries and the batches of searches hold, write and move."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import search, traversal, trust
from lodestone.schemas import EXTRACTION
from lodestone.sources import snapshots
from tests.corpus import graph, simple_graph


def recorded(monkeypatch, module):
    """The (name, columns, rows) of what module writes from now on."""
    found, plain = [], module.written

    def written(df, name="step"):
        out = plain(df, name)
        found.append((name, out.dtypes, out.count()))
        return out

    monkeypatch.setattr(module, "written", written)
    return found


def test_a_round_of_communities_writes_a_row_of_numbers_per_entity(spark, monkeypatch):
    rng = random.Random(3)
    x = simple_graph(spark, 12, [(rng.randrange(12), rng.randrange(12), "USES", 1.0) for _ in range(60)])
    found = recorded(monkeypatch, traversal)
    assert traversal.communities(x).count() == 12
    rounds = [f for f in found if f[0] in ("votes", "communities") and "before" in dict(f[1])]
    assert rounds and all(n == 12 and {t for _, t in kinds} == {"bigint"} for _, kinds, n in rounds)
    assert not [f for f in found if f[0] == "votes"]


def test_the_best_of_tiles_are_those_of_the_whole(monkeypatch):
    monkeypatch.setattr(search, "TILE", (3, 5))
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 4, (7, 41)) / 8.0  # many ties
    scores[2, 5] = np.nan
    ids = rng.permutation(41)
    best = search._Best(7, 6)
    for some, part in search._tiles(7, 41):
        assert some.stop - some.start <= 3 and part.stop - part.start <= 5
        best.take_all(some, scores[some, part], ids[part])
    got = sorted((q, -s, i) for at, found, values in best.rows() for q, i, s in zip(at.tolist(), found.tolist(), values.tolist(), strict=True))
    want = [row for q in range(7) for row in sorted((q, -s, i) for s, i in zip(scores[q].tolist(), ids.tolist(), strict=True) if s == s)[:6]]
    assert got == want


def test_a_short_list_is_not_moved(spark):
    """The short list by codes is that of the definition, with ties, and only what is in its last bin leaves a task besides the best."""
    rng = np.random.default_rng(2)
    data = rng.normal(size=(300, 8))
    data[200:260] = data[7]  # equal codes
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    index = search.build_codes(rows, parts=4, centres=8)
    asked = rows.where("vec_id % 25 = 7")
    found = search.code_search(index, asked, 5, share=0.3)
    assert "rest" in found._jdf.queryExecution().analyzed().toString()
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    codes = {r["id"]: np.frombuffer(bytes(r["code"]), np.uint8) for r in index.rows.collect()}
    want = set()
    for q in range(7, 300, 25):
        tables = [p @ b.T for p, b in zip(np.array_split(unit[q], 4), index.centres, strict=True)]
        guess = [sum(t[c] for t, c in zip(tables, codes[i], strict=True)) for i in range(300)]
        short = sorted(range(300), key=lambda i: (-guess[i], i))[:90]
        want |= {(q, i) for i in sorted(short, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:5]}
    assert {(r["query_id"], r["id"]) for r in found.collect()} == want


def test_relevant_pairs_of_a_kind_are_counted_not_made(spark):
    from lodestone.operators import evaluation

    items = spark.range(400).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("kind"))
    asked = items.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    ranked = asked.select("query_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank")).withColumn("id", (F.col("query_id") * 3 + F.col("rank") * 11) % 400)
    pairs = asked.join(items, "kind").select("query_id", "id")
    want = evaluation.retrieval_at_k(ranked, pairs, 4).collect()
    assert sorted(evaluation.retrieval_at_k_by_class(ranked, asked, items, 4, "kind").collect()) == sorted(want)


def test_facts_of_one_source_move_in_no_round(spark, monkeypatch):
    rows = [(f"c{i}", f"r{i}", 0.5) for i in range(30)] + [("c1", "both", 0.9), ("c2", "both", 0.4), ("c3", "odd", None)]
    found = recorded(monkeypatch, trust)
    facts, sources, _ = trust.propagated(spark.createDataFrame(rows, "chunk_id string, relationship_id string, confidence double"), rounds=3)
    assert facts.count() == 32 and sources.count() == 30
    assert {n for name, _, n in found if name in ("facts", "shared")} == {2, 3}


def test_only_groups_that_differ_are_compared_row_by_row(spark, monkeypatch, tmp_path):
    x, path = graph(spark), str(tmp_path / "g")
    first = snapshots.save_graph(x, path)
    later = x.entities.where("id <> 'API'").withColumn("canonical_name", F.when(F.col("id") == "Python", "Py").otherwise(F.col("canonical_name")))
    found = recorded(monkeypatch, snapshots)
    second = snapshots.save_graph(type(x)(later, x.relationships, x.evidence.where("id <> 'v0'")), path)
    rows = snapshots.changes(spark, path, first, second)
    assert {tuple(r) for r in rows.collect()} == {("entities", "API", "removed"), ("entities", "Python", "changed"), ("evidence", "v0", "removed")}
    assert [n for name, _, n in found if name == "differ"] == [2, 0, 1]


def test_a_text_goes_to_the_model_once_and_does_not_come_back(spark):
    from lodestone.functions.text import prompt_around
    from lodestone.operators import extraction

    chunks = spark.createDataFrame([("a", "Some text."), ("b", None)], "chunk_id string, text string")
    answers = extraction.extract(chunks, lambda prompt: "{}" if prompt == prompt_around()[0] + "Some text." else "no", drop=("text",))
    assert "concat" not in answers._jdf.queryExecution().optimizedPlan().toString()
    assert answers.columns == ["chunk_id", "entities", "relationships", "attempts"]
    assert {(r.chunk_id, r.entities is None, r.attempts) for r in answers.collect()} == {("a", False, 1), ("b", True, 2)}


def test_a_batch_writes_what_is_new(spark, tmp_path):
    from lodestone.streaming.building import merge_batch

    def said(i):
        entities = [{"name": n, "entity_type": "Concept"} for n in ("Hub", f"Leaf {i}")]
        return f"c{i}", entities, [{"source": "Hub", "target": f"Leaf {i}", "relationship_type": "USES", "evidence": "x", "confidence": 0.5}]

    df = spark.createDataFrame([said(i) for i in range(6)], f"chunk_id string, {EXTRACTION}")
    path, merge = str(tmp_path / "g"), merge_batch(str(tmp_path / "g"))
    for first, last in (("c0", "c2"), ("c2", "c5"), ("c2", "c5")):
        merge(df.where(f"chunk_id BETWEEN '{first}' AND '{last}'"), 0)
    sizes = [spark.read.parquet(f"{path}/versions/{r['version']}/evidence").count() for r in snapshots.versions(spark, path).collect()]
    assert sizes == [3, 3, 0]
    whole = snapshots.load_graph(spark, path)
    assert [r["ord"] for r in whole.evidence.orderBy("ord").collect()] == list(range(6)) and whole.relationships.count() == 6 and whole.entities.count() == 7


def test_an_open_interval_is_in_no_bucket_after_the_last_beginning(spark):
    rows = spark.range(40).selectExpr("id", "CAST(9000 + id AS INT) AS a", "CAST(2932896 AS INT) AS b", "11 AS level")
    assert trust._placed(rows, 30).count() == 40


def test_only_rare_words_of_questions_move(spark, monkeypatch):
    from lodestone.operators import retrieval

    monkeypatch.setattr(retrieval, "HOT_TOKENS", 100)
    x = simple_graph(spark, 300, [])
    asked = spark.range(200).selectExpr("id AS question_id", "concat('Who is N', id, ' in the wide world?') AS text")
    found = recorded(monkeypatch, retrieval)
    assert {tuple(r) for r in retrieval.mentions_of(x, asked).collect()} == {(i, str(i)) for i in range(200)}
    assert [n for name, _, n in found if name == "looked_up"] == [200]
    assert [n for name, _, n in found if name in ("near", "composed", "mentions")] == [0, 0]


def test_ids_out_of_range_are_not_grouped_by_checks_of_changes(spark, monkeypatch):
    from lodestone.operators import graph as g

    x, seen, plain = graph(spark), {}, g._refuse
    monkeypatch.setattr(g, "_refuse", lambda rows, what: (seen.update({what: rows._jdf.queryExecution().optimizedPlan().toString().split("\n")}), plain(rows, what)))
    rest = [c for c in x.relationships.columns if c != "id"]
    grouped = type(x)(x.entities, x.relationships.groupBy("id").agg(*[F.min(c).alias(c) for c in rest]), x.evidence)
    first = x.relationships.where("id = 'r1'").withColumn("id", F.lit("s1"))
    proof = x.evidence.where("id = 'v1'").withColumns({"id": F.lit("w1"), "relationship_id": F.lit("s1")})
    assert g.add_evidence(g.add_relationships(grouped, first), proof).evidence.count() == x.evidence.count() + 1
    for what in ("relationship exists", "relationship is missing"):
        at = lambda *signs: next(i for i, line in enumerate(seen[what]) if all(s in line for s in signs))  # noqa: E731, B023
        assert at("Aggregate [id") < at("Filter", "scalar-subquery")


def test_names_and_their_keys_are_not_sent_to_all_tasks(spark, monkeypatch):
    """Spark takes a table of keys for as small as that of the names, and a written one for as small as its file."""
    from lodestone.operators import resolution

    plans, plain = {}, resolution.written
    monkeypatch.setattr(resolution, "written", lambda df, name="step", packed=False: plans.update({(name, len(plans)): df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name, packed))
    names = spark.sql("SELECT id AS seq, 'Person' AS type, concat('A rather long name of ', id DIV 2, IF(id % 2 = 0, 'x', 'y')) AS name FROM range(8)")
    found, entities = resolution.resolve_stream(names)
    rows = found.join(entities.select(F.col("id").alias("entity_id"), "ord"), "entity_id")
    assert {(r["seq"], r["ord"], r["matched_via"]) for r in rows.collect()} == {(0, 0, "new"), (3, 3, "new")} | {(i, 3 if i in (5, 7) else 0, "similarity") for i in (1, 2, 4, 5, 6, 7)}
    assert {"similar", "founders", "owners", "resolved"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans.items() if "BroadcastExchange" in plan]


def test_ids_are_not_sent_to_all_tasks(spark, tmp_path):
    """Checks of a loaded graph, and evidence without its relationships: Spark takes the ids for as small as their packed file."""
    import re

    from lodestone.operators.graph import remove_entity
    from lodestone.schemas import problems

    path = str(tmp_path / "g")
    snapshots.save_graph(graph(spark), path)
    x = snapshots.load_graph(spark, path)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (problems(x), remove_entity(x, "API").evidence)]
    assert not [p for p in plans if re.search(r"BroadcastHashJoin \[(source_entity_id|target_entity_id|relationship_id)", p)]


def test_rows_that_lack_something(spark):
    from lodestone.schemas import problems

    x = graph(spark)
    ends = F.when(F.col("id") == "r1", F.lit("nobody")).when(F.col("id") == "r2", F.lit(None))
    broken = type(x)(x.entities, x.relationships.where("id <> 'r3'").withColumn("source_entity_id", F.coalesce(ends, F.when(F.col("id") != "r2", F.col("source_entity_id")))), x.evidence)
    lost = {r["id"] for r in x.evidence.where("relationship_id = 'r3'").collect()}
    assert {tuple(r) for r in problems(broken).collect()} == {("missing source", "r1"), ("missing source", "r2")} | {("missing relationship", i) for i in lost}
