import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph as g
from lodestone.operators import traversal as t
from lodestone.schemas import problems
from lodestone.sources.snapshots import load_graph, save_graph, to_json
from tests.corpus import graph, ids, simple_graph


def test_point_queries(spark):
    x = graph(spark)
    assert g.outgoing(x, "FastAPI").count() == 5 and g.incoming(x, "FastAPI").count() == 1
    assert len(ids(g.neighbors(x, "FastAPI"))) == 6 and ids(g.neighbors(x, "FastAPI", "USES")) == {"Pydantic", "Starlette"}
    assert [r.id for r in g.evidence_of(x, "r1").collect()] == ["v1"] and g.entity(x, "none").count() == 0 and g.relationship(x, "r0").count() == 1
    assert problems(x).count() == 0


def test_changes(spark):
    x = graph(spark)
    without = g.remove_entity(x, "FastAPI")
    assert (without.entities.count(), without.relationships.count(), without.evidence.count()) == (6, 0, 0)
    less = g.remove_relationship(x, "r1")
    assert less.relationships.count() == 5 and "v1" not in ids(less.evidence)
    for change in (lambda: g.remove_entity(x, "no"), lambda: g.remove_relationship(x, "no"), lambda: g.add_entities(x, x.entities.limit(1)), lambda: g.add_relationships(without, x.relationships), lambda: g.add_evidence(less, x.evidence.where("id = 'v1'"))):
        with pytest.raises(g.GraphError):
            change()
    again = g.add_evidence(less, x.evidence.where("id = 'v2'").withColumn("id", F.lit("new")))
    assert again.evidence.count() == 6
    double = g.add_relationships(x, x.relationships.where("id = 'r1'").withColumn("id", F.lit("twin")))
    assert double.relationships.count() == 7
    broken = x.relationships.withColumn("relationship_type", F.lit("USED_FOR")).withColumn("confidence", F.lit(1.5))
    assert problems(type(x)(x.entities, broken, x.evidence)).count() == 12


def test_changes_at_the_ends_of_the_range_of_ids(spark):
    x = graph(spark)
    like = lambda rows, i, n: rows.limit(1).withColumn(i, F.explode(F.array(*[F.lit(v).cast("string") for v in n])))
    for taken in (["r0"], ["r5"], ["a", "r3", "z"], ["r5", "z"], ["a", "r0"]):
        with pytest.raises(g.GraphError, match="relationship exists: r"):
            g.add_relationships(x, like(x.relationships, "id", taken))
    assert g.add_relationships(x, like(x.relationships, "id", ["a", "r33", "z"])).relationships.count() == 9
    with pytest.raises(g.GraphError, match="repeated relationship: z"):
        g.add_relationships(x, like(x.relationships, "id", ["z", "z"]))
    for end in ("source_entity_id", "target_entity_id"):
        for missing in (["API", "A"], ["Zed", "API"], ["API", "B", "Python"], [None, "API"], [None]):
            with pytest.raises(g.GraphError, match=f"{end} is missing"):
                g.add_relationships(x, like(x.relationships, end, missing).withColumn("id", F.expr("uuid()")))
    assert g.add_evidence(x, x.evidence.withColumn("id", F.concat("id", F.lit("x")))).evidence.count() == 12
    assert g.add_entities(x, x.entities.limit(0)).entities.count() == 7 and g.add_evidence(x, x.evidence.limit(0)).evidence.count() == 6


def test_snapshot(spark, tmp_path):
    x, path = graph(spark), str(tmp_path / "s")
    first = save_graph(x, path)
    save_graph(g.remove_entity(load_graph(spark, path), "FastAPI"), path)
    assert load_graph(spark, path).entities.count() == 6 and load_graph(spark, path, first).entities.count() == 7
    back = load_graph(spark, path, first)
    assert sorted(map(str, back.entities.collect())) == sorted(map(str, x.entities.collect()))
    assert to_json(back).count() == 19


def around(edges, kind=None, least=None):
    out = {}
    for i, (a, b, ty, c) in enumerate(edges):
        if (kind is None or ty == kind) and (least is None or c >= least):
            out.setdefault(a, []).append((0, i, b))
            out.setdefault(b, []).append((1, i, a))
    return {n: sorted(x) for n, x in out.items()}


def bfs(edges, starts, depth, kind=None, least=None):
    near, dist, queue, met = around(edges, kind, least), dict.fromkeys(starts, 0), deque(starts), set()
    while queue:
        n = queue.popleft()
        if dist[n] >= depth:
            continue
        for _, i, o in near.get(n, []):
            met.add(f"e{i}")
            if o not in dist:
                dist[o] = dist[n] + 1
                queue.append(o)
    return {str(n) for n in dist}, met


def path(edges, a, b):
    near, came, queue = around(edges), {a: None}, deque([a])
    while queue:
        n = queue.popleft()
        if n == b:
            out = []
            while n is not None:
                out.append(str(n))
                n = came[n]
            return out[::-1]
        for _, _, o in near.get(n, []):
            if o not in came:
                came[o] = n
                queue.append(o)
    return []


def dfs(edges, start, most):
    near, out, stack = around(edges), [], [(start, 0)]
    while stack:
        n, d = stack.pop()
        if str(n) in out:
            continue
        out.append(str(n))
        if most is None or d < most:
            stack += [(o, d + 1) for _, _, o in near.get(n, []) if str(o) not in out]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_traversal_against_a_queue(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(3, 12)
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice(["USES", "BUILDS"]), rng.choice([0.2, 0.5, 0.9])) for _ in range(rng.randrange(2, 18))]
    x = simple_graph(spark, n, edges)
    for depth, kind, least in ((0, None, None), (1, None, None), (2, "USES", None), (3, None, 0.5)):
        got = t.bfs_subgraph(x, "0", depth, kind, least)
        assert (ids(got.entities), ids(got.relationships)) == bfs(edges, [0], depth, kind, least)
    got = t.bfs_subgraph(x, x.entities.where("id in ('0', '1', '2')"), 2)
    assert (ids(got.entities), ids(got.relationships)) == bfs(edges, [0, 1, 2], 2)
    assert [r.id for r in t.find_path(x, "0", str(n - 1)).orderBy("hop").collect()] == path(edges, 0, n - 1)
    for most in (None, 2):
        assert [r.id for r in t.dfs_visit(x, "0", most).orderBy("place").collect()] == dfs(edges, 0, most)
    label = {r.id: r.component for r in t.components(x).collect()}
    assert all(label[i] == min(bfs(edges, [int(i)], n)[0]) for i in label)


def test_traversal_edges(spark):
    triangle = simple_graph(spark, 4, [(0, 1, "USES", 1.0), (0, 2, "USES", 1.0), (1, 2, "USES", 1.0)])
    assert ids(t.bfs_subgraph(triangle, "0", 1).relationships) == {"e0", "e1"}
    assert t.find_path(triangle, "0", "3").collect() == [] and [r.id for r in t.find_path(triangle, "0", "0").collect()] == ["0"]
    for wrong in (lambda: t.find_path(triangle, "0", "9"), lambda: t.bfs_subgraph(triangle, "9", 1), lambda: t.dfs_visit(triangle, "9"), lambda: t.dfs_visit(triangle, "0", max_entities=1)):
        with pytest.raises(g.GraphError):
            wrong()
    assert {r.id: r.degree for r in t.degree_centrality(triangle).collect()} == {"0": 2, "1": 2, "2": 2, "3": 0}


def test_paths_make_the_edges_once(spark):
    x, made = simple_graph(spark, 6, [(i, i + 1, "USES", 0.5) for i in range(5)]), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    x = type(x)(x.entities, x.relationships.mapInArrow(count, x.relationships.schema), x.evidence)
    for find in (t.find_path, t.weighted_path):
        before = made.value
        assert [r.id for r in find(x, "0", "5").orderBy("hop").collect()] == list("012345")
        assert made.value - before == 5
