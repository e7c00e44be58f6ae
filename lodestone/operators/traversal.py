"""Traversal along edges in either direction, level by level: a level joins its frontier with the edges that touch it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.connected import connected_components
from lodestone.operators.graph import GraphError
from lodestone.ordering import in_order
from lodestone.schemas import Graph, Subgraph
from lodestone.scratch import written
from lodestone.skew import hot_keys, join_split


def passing(relationships: DataFrame, relationship_type: str | None = None, min_confidence: float | None = None) -> DataFrame:
    if relationship_type is not None:
        relationships = relationships.where(F.col("relationship_type") == relationship_type)
    if min_confidence is not None:
        relationships = relationships.where(F.col("confidence") >= min_confidence)
    return relationships


def adjacency(relationships: DataFrame) -> DataFrame:
    """Each edge from both of its ends: node, other, dir (0 out, 1 in), ord."""
    side = lambda a, b, d: relationships.select(F.col(a).alias("node"), F.col(b).alias("other"), F.lit(d).alias("dir"), "ord")
    return side("source_entity_id", "target_entity_id", 0).unionByName(side("target_entity_id", "source_entity_id", 1))


def touching(relationships: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end in nodes (`node`). Semi-joins move down to the edges' source, before any aggregation that makes them."""
    by = lambda k: relationships.join(nodes.select(F.col("node").alias(k)), k, "left_semi").select(relationships.columns)
    return by("source_entity_id").unionByName(by("target_entity_id"))


def levels(starts: DataFrame, relationships: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame | None]:
    """((node, dist) within `depth` hops of the nearest start, the edges met on the way, some of them twice). depth None: as far as edges go.

    Each level reads the edges that touch its frontier and writes these and the new frontier; nothing else is copied.
    """
    seen = frontier = written(starts.select("node").distinct().withColumn("dist", F.lit(0)), "bfs")
    met, level = None, 0
    while depth is None or level < depth:
        level += 1
        edges = written(touching(relationships, frontier.select("node")), "bfs")
        met = edges if met is None else met.unionByName(edges)
        ends = edges.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("node")).distinct()
        frontier = written(ends.join(seen, "node", "left_anti").withColumn("dist", F.lit(level)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen, met


def distances(starts: DataFrame, relationships: DataFrame, depth: int | None) -> DataFrame:
    """(node, dist) for nodes within `depth` hops of the nearest start; starts has `node`."""
    return levels(starts, relationships, depth)[0]


def bfs_subgraph(graph: Graph, starts: DataFrame | str, depth: int, relationship_type: str | None = None, min_confidence: float | None = None) -> Subgraph:
    """Entities within depth hops of any start, and the edges met on the way.

    An edge is met when one of its ends is expanded, that is at most depth - 1 hops away: edges between two entities at the last hop
    are left out. starts: an entity id, or a table with `id`.
    """
    if isinstance(starts, str):
        starts = graph.entities.where(F.col("id") == starts).select("id")
        if starts.isEmpty():
            raise GraphError("the start is no entity")
    edges = passing(graph.relationships, relationship_type, min_confidence)
    reached, met = levels(starts.select(F.col("id").alias("node")), edges, depth)
    met = edges.limit(0) if met is None else met.dropDuplicates(["id"])
    return Subgraph(graph.entities.join(reached.select(F.col("node").alias("id")), "id", "left_semi"), met)


def find_path(graph: Graph, source: str, target: str) -> DataFrame:
    """(hop, id): a path of the fewest hops, or no rows where no path of any length exists. Ties go to the path whose edges were
    inserted first, out-edges before in-edges, hop by hop.

    The levels are found first, by nodes alone. Then only the nodes from which the target is reached in time get paths: arrays of
    (direction, order), which sort as the queue of a breadth-first search does. The edges are made once.
    """
    known = {r["id"] for r in graph.entities.where(F.col("id").isin(source, target)).select("id").collect()}
    if known != {source, target}:
        raise GraphError("an end is no entity")
    spark = graph.entities.sparkSession
    sides = adjacency(written(graph.relationships.select("source_entity_id", "target_entity_id", "ord"), "path"))
    frontiers = [written(spark.createDataFrame([(source,)], "node string"), "path")]
    while frontiers[-1].where(F.col("node") == target).isEmpty():
        ends = sides.join(frontiers[-1], "node").select(F.col("other").alias("node")).distinct()
        # Edges lead both ways, so a level's neighbours are in it, the one before or the next one.
        for nodes in frontiers[-2:]:
            ends = ends.join(nodes, "node", "left_anti")
        frontiers.append(written(ends, "path"))
        if frontiers[-1].isEmpty():
            return spark.createDataFrame([], "hop int, id string")
    on_way = [frontiers[-1].where(F.col("node") == target)]
    for nodes in frontiers[-2:0:-1]:
        before = sides.join(on_way[-1], "node").select(F.col("other").alias("node")).distinct()
        on_way.append(written(nodes.join(before, "node", "left_semi"), "path"))
    paths = spark.createDataFrame([(source, [source])], "node string, path array<string>").withColumn("key", F.array().cast("array<struct<dir:int,ord:bigint>>"))
    for nodes in reversed(on_way if len(frontiers) > 1 else []):
        step = sides.join(nodes.select(F.col("node").alias("other")), "other", "left_semi").join(paths, "node")
        step = step.select(F.col("other").alias("node"), "path", F.concat("key", F.array(F.struct("dir", "ord"))).alias("key"))
        best = step.groupBy("node").agg(F.min(F.struct("key", "path")).alias("b"))
        paths = written(best.select("node", F.concat("b.path", F.array("node")).alias("path"), "b.key"), "path")
    return paths.select(F.posexplode("path").alias("hop", "id"))


def dfs_visit(graph: Graph, start: str, max_depth: int | None = None, max_entities: int = 100_000) -> DataFrame:
    """(place, id): the order in which a stack visits: last edges first, an entity marked when it is taken from the stack.

    Where the part in reach is a tree, an entity's place follows from the edges on its way from the start: levels are joined, and one
    range sort gives the order, whatever the size. With a circle in reach the order is sequential by nature, so one task walks that part,
    which must not exceed max_entities; larger parts are an error, not cut.
    """
    spark = graph.entities.sparkSession
    if graph.entities.where(F.col("id") == start).isEmpty():
        raise GraphError("the start is no entity")
    kind = "array<struct<dir:int,ord:bigint>>"
    frontier = written(spark.createDataFrame([(start, None)], "node string, parent string").withColumn("key", F.array().cast(kind)), "dfs")
    seen, level, tree = frontier.select("node", "key"), 0, True
    while tree and (max_depth is None or level < max_depth):
        level += 1
        edges = adjacency(touching(graph.relationships, frontier)).join(frontier, "node").where("NOT other <=> parent AND other <> node")
        met = written(edges.groupBy("other", "node", "key").agg(F.max(F.struct("dir", "ord")).alias("e")), "dfs")
        # Two ways to an entity, or one back to an entity seen before, close a circle.
        tree = met.groupBy("other").count().where("count > 1").isEmpty() and met.join(seen.select(F.col("node").alias("other")), "other", "left_semi").isEmpty()
        last_first = F.struct((-F.col("e.dir")).cast("int").alias("dir"), (-F.col("e.ord")).alias("ord"))
        frontier = met.select(F.col("other").alias("node"), F.col("node").alias("parent"), F.concat("key", F.array(last_first)).cast(kind).alias("key"))
        if met.isEmpty():
            break
        seen = seen.unionByName(frontier.select("node", "key"))
    if tree:
        return in_order(seen, "key").select(F.col("place").cast("int").alias("place"), F.col("node").alias("id"))

    within = written(distances(graph.entities.where(F.col("id") == start).select(F.col("id").alias("node")), graph.relationships, max_depth), "dfs")
    if within.count() > max_entities:
        raise GraphError(f"more than {max_entities} entities in reach, with a circle among them")
    lists = adjacency(touching(graph.relationships, within).distinct()).join(within.select("node"), "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("dir", "ord", "other"))).alias("next"))

    def walk(batches):
        import pyarrow as pa

        after = {n.as_py(): [e["other"] for e in edges.as_py()] for b in batches for n, edges in zip(b.column(0), b.column(1), strict=True)}
        order, marked, stack = [], set(), [(start, 0)]
        while stack:
            node, depth = stack.pop()
            if node in marked:
                continue
            marked.add(node)
            order.append(node)
            if max_depth is None or depth < max_depth:
                stack += [(n, depth + 1) for n in after.get(node, []) if n not in marked]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(order)), pa.int32()), pa.array(order, pa.string())], names=["place", "id"])

    return lists.coalesce(1).mapInArrow(walk, "place int, id string")


def components(graph: Graph) -> DataFrame:
    """(id, component): the least entity id that edges reach. Numbers in the order of the ids stand for entities. Rounds grow with the logarithm of the longest way; hubs' edges stay where they are."""
    places = _places(graph)
    labels = connected_components(_between(graph.relationships, places)).withColumnRenamed("node", "place")
    found = written(places.join(labels, "place", "left").select("id", F.coalesce("label", "place").alias("place")), "components")
    return join_split(found, places.select("place", F.col("id").alias("component")), "place").select("id", "component")


def weighted_path(graph: Graph, source: str, target: str, cost: Column | None = None) -> DataFrame:
    """(hop, id, cost): a path of the least total cost, or no rows; cost: a column over relationships, none below zero, by default
    small for confident edges (-ln of the confidence, so the path is the most credible one).

    Each round relaxes the edges of entities that became cheaper, and ends when none does; costs at or above the target's are not followed.
    """
    known = {r["id"] for r in graph.entities.where(F.col("id").isin(source, target)).select("id").collect()}
    if known != {source, target}:
        raise GraphError("an end is no entity")
    spark = graph.entities.sparkSession
    priced = graph.relationships.withColumn("_cost", cost if cost is not None else -F.ln(F.greatest("confidence", F.lit(1e-9))))
    priced = written(priced.select("source_entity_id", "target_entity_id", "_cost"), "path")
    side = lambda edges, a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("other"), F.col("_cost").alias("step"))
    best = frontier = written(spark.createDataFrame([(source, 0.0, [source], [0.0])], "node string, cost double, path array<string>, costs array<double>"), "path")
    while not frontier.isEmpty():
        total = (F.col("cost") + F.col("step")).alias("cost")
        both = side(priced, "source_entity_id", "target_entity_id").unionByName(side(priced, "target_entity_id", "source_entity_id"))
        tried = both.join(frontier, "node").select(F.col("other").alias("node"), total, F.concat("path", F.array("other")).alias("path"), F.concat("costs", F.array(total)).alias("costs"))
        goal = best.where(F.col("node") == target).select("cost").first()
        if goal:
            tried = tried.where(F.col("cost") < goal[0])
        tried = tried.groupBy("node").agg(F.min(F.struct("cost", "path", "costs")).alias("b")).select("node", "b.*")
        old = best.select("node", F.col("cost").alias("_old"))
        frontier = written(tried.join(old, "node", "left").where("_old IS NULL OR cost < _old").drop("_old"), "path")
        best = written(best.join(frontier, "node", "left_anti").unionByName(frontier), "path")
    return best.where(F.col("node") == target).select(F.posexplode(F.arrays_zip("path", "costs")).alias("hop", "s")).select("hop", F.col("s.path").alias("id"), F.col("s.costs").alias("cost"))


def _places(graph: Graph) -> DataFrame:
    """(id, place): the entities numbered in the order of their ids, so that numbers compare as ids do."""
    return written(in_order(graph.entities.select("id"), "id").select("id", "place"), "places")


def _between(relationships: DataFrame, places: DataFrame) -> DataFrame:
    """(a, b): the places of the ends of each edge whose ends are entities. Ends with very many edges are not moved."""
    ends = written(relationships.select("source_entity_id", "target_entity_id"), "ends")
    side = lambda end, out: places.select(F.col("id").alias(end), F.col("place").alias(out))
    half = written(join_split(ends, side("target_entity_id", "b"), "target_entity_id").select("source_entity_id", "b"), "ends")
    return written(join_split(half, side("source_entity_id", "a"), "source_entity_id").select("a", "b"), "ends")


def communities(graph: Graph) -> DataFrame:
    """(id, community): label propagation. In each round every entity takes the label that most of its edge ends have, the least of several;
    it keeps its own if that is among them. With weights that are the same both ways, labels settle or alternate between two in the
    end; rounds go on until then, and of two that alternate the lesser one is the entity's. The votes of a hub are counted where its edges are.

    Numbers in the order of the ids stand for entities and labels. An entity's own label is a vote that counts nothing, so a round is
    one join and two sums, and all that it writes is a row per entity: its labels now, one and two rounds ago."""
    places = _places(graph)
    pairs = _between(graph.relationships, places).where("a <> b")
    edges = written(pairs.select(F.col("a").alias("node"), F.col("b").alias("id")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("id"))).groupBy("node", "id").agg(F.count("*").alias("n")), "communities")
    many, most = places.count(), edges.agg(F.sum("n")).first()[0] or 0
    # One number compares as (most votes, own label first, least label) does.
    kind = "bigint" if (most + 1) * 2 * many < 2**63 else "decimal(38,0)"
    number = lambda c: c.cast(kind)
    score = (number(F.lit(most) - F.col("n")) * 2 + number(F.when(F.col("own").isNull(), 1).otherwise(0))) * number(F.lit(many)) + number(F.col("community"))
    nothing, hot = F.lit(None).cast("bigint"), hot_keys(edges, "id")
    own = lambda labels: labels.select(F.col("id").alias("node"), "community", F.lit(0).cast("bigint").alias("n"), F.col("community").alias("own"), "last")
    # Too many labels to be broadcast: hashed, so that a round does not sort the edges.
    side = lambda labels: labels.hint("shuffle_hash") if many > 1_000_000 else labels
    # At first all labels differ, so each edge is a vote by itself.
    labels, first = places.select(F.col("place").alias("id"), F.col("place").alias("community"), nothing.alias("last")), True
    while True:
        if first:
            votes = edges.select("node", F.col("id").alias("community"), "n", nothing.alias("own"), nothing.alias("last")).unionByName(own(labels))
        else:
            told = join_split(edges, side(labels.select("id", "community")), "id", hot=hot).select("node", "community", "n", nothing.alias("own"), nothing.alias("last"))
            votes = told.unionByName(own(labels)).groupBy("node", "community").agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.max("last").alias("last"))
        best = votes.groupBy("node").agg(F.min(score).alias("best"), F.max("own").alias("last"), F.max("last").alias("before"))
        labels, first = written(best.select(F.col("node").alias("id"), (F.col("best") % number(F.lit(max(many, 1)))).cast("bigint").alias("community"), "last", "before"), "communities"), False
        if labels.where("NOT community <=> before").isEmpty():
            break
    least = labels.select("id", F.least("community", "last").alias("community"))
    named = least.join(places.select(F.col("place").alias("id"), F.col("id").alias("_name")), "id").select(F.col("_name").alias("id"), "community")
    return join_split(written(named, "communities"), places.select(F.col("place").alias("community"), F.col("id").alias("_name")), "community").select("id", F.col("_name").alias("community"))


def degree_centrality(graph: Graph) -> DataFrame:
    """(id, degree): edge ends at each entity; loops count twice."""
    ends = adjacency(graph.relationships).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("degree"))
    return graph.entities.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def page_rank(graph: Graph, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(id, rank): the chance to be at an entity, going along outgoing edges or, with 1 - damping, anywhere; from an entity without edges
    one goes anywhere. Several edges between two entities count as often. Ranks sum up to 1.

    Shares of a target are summed where they are made, and an entity with very many edges meets its rank without moving them.
    """
    places = _places(graph)
    n = places.count()
    if not n:
        return places.select("id", F.lit(0.0).alias("rank"))
    edges = _between(graph.relationships, places)
    nodes = written(places.select(F.col("place").alias("a")).join(edges.groupBy("a").agg(F.count("*").alias("out")), "a", "left"), "rank")
    # A round moves a list of targets with each entity, in parts: more of them for an entity with very many edges.
    hot, part = hot_keys(edges, "a"), F.xxhash64("b")
    if hot is not None:
        edges = edges.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "a", "left")
    parts = F.lit(8) if hot is None else F.when(F.col("hot"), 4096).otherwise(8)
    number = "int" if n < 2**31 else "bigint"
    lists = written(edges.groupBy("a", F.pmod(part, parts).alias("part")).agg(F.sort_array(F.collect_list(F.col("b").cast(number))).alias("targets")).select("a", "targets"), "rank")
    ranks, hot = nodes.withColumn("rank", F.lit(1.0 / n)), hot_keys(lists, "a")
    for _ in range(rounds):
        idle = ranks.where("out IS NULL").agg(F.sum("rank")).first()[0] or 0.0
        share = join_split(lists, ranks.where("out IS NOT NULL").select("a", (F.col("rank") / F.col("out")).alias("share")), "a", hot=hot)
        came = share.select(F.explode("targets").alias("a"), "share").groupBy("a").agg(F.sum("share").alias("came"))
        base = (1.0 - damping) / n + damping * idle / n
        ranks = written(nodes.join(came.withColumn("a", F.col("a").cast("bigint")), "a", "left").select("a", "out", (F.lit(base) + damping * F.coalesce("came", F.lit(0.0))).alias("rank")), "rank")
    return places.join(ranks.select(F.col("a").alias("place"), "rank"), "place").select("id", "rank")


def harmonic_centrality(graph: Graph, depth: int = 6, bits: int = 12) -> DataFrame:
    """(id, closeness): the sum over the other entities within `depth` hops of one over their distance, by sketches of the balls around each entity.

    A round joins each entity's sketch of fixed size with its neighbours', so the work per round is that of one pass over the edges; counts are off by about
    1.04 / 2 ** (bits / 2), relatively. Hubs send on one merged sketch per task.
    """
    edges = written(adjacency(graph.relationships).where("node <> other").select("node", F.col("other").alias("id")).distinct(), "balls")
    balls = written(graph.entities.select("id").groupBy("id").agg(F.hll_sketch_agg("id", bits).alias("ball")), "balls")
    known, hot = balls.select("id", F.lit(1.0).alias("size"), F.lit(0.0).alias("closeness")), hot_keys(edges, "id")
    for hop in range(1, depth + 1):
        sent = join_split(edges, balls, "id", hot=hot).select(F.col("node").alias("id"), "ball").unionByName(balls)
        balls = written(sent.groupBy("id").agg(F.hll_union_agg("ball").alias("ball")), "balls")
        sizes = balls.select("id", F.hll_sketch_estimate("ball").cast("double").alias("now"))
        grown = known.join(sizes, "id")
        known = written(grown.select("id", F.greatest("now", "size").alias("size"), (F.col("closeness") + F.greatest(F.col("now") - F.col("size"), F.lit(0.0)) / hop).alias("closeness")), "balls")
    return known.select("id", "closeness")
