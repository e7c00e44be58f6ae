"""Retrieval for a question: the graph around the entities it mentions, the nearest chunks, and both ranked together."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Collection
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions.text import light_key, quoted
from lodestone.operators.search import retrieve
from lodestone.operators.traversal import bfs_subgraph, passing, touching
from lodestone.schemas import Graph, Subgraph
from lodestone.scratch import written
from lodestone.skew import join_split

#: Weights of graph, vector and confidence in the final score.
WEIGHTS = (0.4, 0.4, 0.2)


@dataclass(frozen=True)
class Hybrid:
    subgraph: Subgraph
    hits: DataFrame


def mentioned_entities(graph: Graph, question: str) -> DataFrame:
    """Entities whose name or an alias stands in the question as whole words. Empty names never do."""
    asked = F.lit(unicodedata.normalize("NFC", question).lower())
    names = F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n != "")
    found = graph.entities.select("id", F.explode(names).alias("name")).select("id", light_key(F.col("name")).alias("key"))
    found = found.where(asked.contains(F.col("key")) & F.regexp_like(asked, F.concat(F.lit(r"(?U)\b"), quoted(F.col("key")), F.lit(r"\b"))))
    return graph.entities.join(found.select("id"), "id", "left_semi")


#: Runs of letters, digits and underscores, and single other characters.
TOKEN = r"(?U)\w+|\W"

#: A token with more than one in so many words of all questions is hot, so there are at most as many hot tokens as this.
HOT_TOKENS = 10_000


def _word(text: Column) -> Column:
    return text.rlike(r"(?U)\w")


def _whole() -> Column:
    """Whether key stands in asked as whole words. Mostly the two letters around its first place tell; else a pattern does, which is made anew for each pair."""
    at = F.position("key", "asked")
    before = (at > 1) & _word(F.substring("asked", at - 1, F.lit(1)))
    edges = (before != F.col("opens")) & (_word(F.substring("asked", at + F.length("key"), F.lit(1))) != F.col("closes"))
    return F.contains("asked", "key") & F.when(edges, True).otherwise(F.regexp_like("asked", F.concat(F.lit(r"(?U)\b"), quoted(F.col("key")), F.lit(r"\b"))))


def _light(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """id_col and asked, the light_key of the text; ASCII texts do not pass through Python. rows is read once, texts that are null are left out."""
    plain = F.length(text) == F.octet_length(text)
    raw = written(rows.select(id_col, F.when(plain, F.lower(text)).otherwise(F.col(text)).alias("asked"), plain.alias("plain")), "questions")
    # The files' own ranges of `plain` say where there is none of a kind.
    other = written(raw.where("plain = false").select(id_col, light_key(F.col("asked")).alias("asked")), "composed")
    return raw.where("plain = true").select(id_col, "asked").unionByName(other)


def mentions_of(graph: Graph, questions: DataFrame, id_col: str = "question_id", text: str = "text") -> DataFrame:
    """(id_col, entity_id): for each of many questions the entities that mentioned_entities() finds in it, once each.

    A name stands in a question as whole words only if all its tokens do, so each different name is looked up by the one of its tokens that the
    fewest names have, and the pairs that meet are checked. Hot tokens of the questions that look up no name are dropped where they are; those that do
    meet their few names apart, so a question moves once for each of its rare tokens only.
    """
    names = F.filter(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: n != "")
    owned = written(graph.entities.select(F.col("id").alias("entity_id"), F.explode(names).alias("name")).select("entity_id", light_key(F.col("name")).alias("key")).distinct(), "names")
    # A name of one entity brings its id along.
    keys = written(owned.groupBy("key").agg(F.count("*").alias("n"), F.min("entity_id").alias("one")).select("key", F.when(F.col("n") == 1, F.col("one")).alias("entity_id")), "keys")
    # Other characters are tokens only where a name has nothing else.
    words = keys.where(~_word(F.col("key"))).isEmpty()
    tokens = lambda c: F.split(c, r"(?U)\W+") if words else F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    keyed = written(keys.select("key", F.explode(F.array_distinct(tokens(F.col("key")))).alias("token")).where("token <> ''"), "tokens")
    rarest = join_split(keyed, keyed.groupBy("token").agg(F.count("*").alias("n")), "token").groupBy("key").agg(F.min(F.struct("n", "token")).alias("t"))
    named = keys.join(rarest, "key").select("t.token", "key", "entity_id", _word(F.substring("key", 1, 1)).alias("opens"), _word(F.substring("key", -1, 1)).alias("closes"))
    named = written(named, "named")
    asked = _light(questions, id_col, text)
    counts = written(asked.select(F.explode(tokens(F.col("asked"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "counts")
    hot = written(counts.where(F.col("n") > (counts.agg(F.sum("n")).first()[0] or 0) // HOT_TOKENS).select("token"), "hot")
    near = written(named.join(F.broadcast(hot), "token", "left_semi"), "near")
    kind = hot.join(near.select("token", F.lit(True).alias("named")).distinct(), "token", "left").select("token", F.coalesce("named", F.lit(False)).alias("named"))
    rows = asked.select(id_col, "asked", F.explode(F.array_distinct(tokens(F.col("asked")))).alias("token")).join(F.broadcast(kind), "token", "left")
    rows = written(rows.where(F.coalesce("named", F.lit(True))).select(id_col, "asked", "token", F.col("named").isNotNull().alias("hot")), "looked_up")
    met = rows.where("NOT hot").join(named, "token").unionByName(rows.where("hot").join(near, "token").select(id_col, "asked", "token", "hot", *named.columns[1:]))
    hits = met.where(_whole()).select(id_col, "key", "entity_id")
    if keys.where("entity_id IS NULL").isEmpty():
        return hits.select(id_col, "entity_id").distinct()
    found = written(hits, "mentions")
    several = found.where("entity_id IS NULL").select(id_col, "key").join(owned, "key").select(id_col, "entity_id")
    return found.where("entity_id IS NOT NULL").select(id_col, "entity_id").unionByName(several).distinct()


def retrieve_graph(graph: Graph, question: str, depth: int | None = None, relationship_type: str | None = None) -> Subgraph:
    """One search from all mentioned entities: the union of the balls around them."""
    return bfs_subgraph(graph, mentioned_entities(graph, question), Settings().max_graph_depth if depth is None else depth, relationship_type)


def _of_types(column: str, types: str | Collection[str]) -> Column:
    return F.col(column).isin([types] if isinstance(types, str) else list(types))


def retrieve_relationships(graph: Graph, question: str, relationship_type: str | Collection[str] | None = None, min_confidence: float | None = None) -> Subgraph:
    """The edges at entities that the question mentions, each once, of one of the types and confident enough if asked; and their ends, with the mentioned entities."""
    named = written(mentioned_entities(graph, question).select(F.col("id").alias("node")), "named")
    edges = graph.relationships if relationship_type is None else graph.relationships.where(_of_types("relationship_type", relationship_type))
    met = touching(passing(edges, None, min_confidence), named).dropDuplicates(["id"])
    return Subgraph(graph.entities.join(_ends(met).unionByName(named.withColumnRenamed("node", "id")), "id", "left_semi"), met)


def retrieve_by_entity_type(graph: Graph, entity_type: str | Collection[str], around: bool = False) -> Subgraph:
    """The entities of one of the types, and the edges that have both ends among them; around: any edge with one end there, and the entities at its other end.

    A type that no entity has gives nothing. Both ends are semi-joins, which Spark splits where an entity has very many edges; types of few entities are broadcast by their size.
    """
    own = graph.entities.where(_of_types("entity_type", entity_type))
    side = lambda edges, end, how="left_semi": edges.join(own.select(F.col("id").alias(end)), end, how).select(edges.columns)
    out = side(graph.relationships, "source_entity_id")
    if not around:
        return Subgraph(own, side(out, "target_entity_id"))
    met = out.unionByName(side(side(graph.relationships, "target_entity_id"), "source_entity_id", "left_anti"))
    return Subgraph(graph.entities.join(_ends(met).unionByName(own.select("id")), "id", "left_semi"), met)


def retrieve_by_relationship_type(graph: Graph, relationship_type: str | Collection[str], min_confidence: float | None = None) -> Subgraph:
    """The edges of one of the types, confident enough if asked, and the entities at their ends."""
    met = passing(graph.relationships.where(_of_types("relationship_type", relationship_type)), None, min_confidence)
    return Subgraph(graph.entities.join(_ends(met), "id", "left_semi"), met)


def _ends(edges: DataFrame) -> DataFrame:
    """`id` of each end once: grouped where the edges are before anything moves, so that a hub is one row a task."""
    return edges.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("id")).distinct()


def retrieve_hybrid(graph: Graph, vectors: DataFrame, question: str, embed_fn: Callable[[str], list[float]], depth: int | None = None, k: int | None = None, relationship_type: str | None = None) -> Hybrid:
    """Both ways; the type restricts the graph only."""
    return Hybrid(retrieve_graph(graph, question, depth, relationship_type), retrieve(vectors, question, embed_fn, k))


def rank(graph: Graph, found: Hybrid, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """relationship_id, chunk_id, text, graph_score, vector_score, confidence, final_score, best first.

    A relationship has its chunk if all its evidence is from one, and its text if it has one row of evidence. A hit
    scores every relationship of its chunk, or else is a row of its own; of two hits for a chunk the lower score holds.
    """
    proof = graph.evidence.join(found.subgraph.relationships.select(F.col("id").alias("relationship_id")), "relationship_id", "left_semi")
    proof = proof.groupBy("relationship_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high"), F.first("text").alias("t"))
    edges = found.subgraph.relationships.select(F.col("id").alias("relationship_id"), "confidence", "ord").join(proof, "relationship_id", "left")
    edges = edges.select("relationship_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("chunk_id"), F.when(F.col("n") == 1, F.col("t")).otherwise("").alias("text"), F.lit(1.0).alias("graph_score"), F.col("confidence"), "ord")
    hits = found.hits.groupBy("chunk_id").agg(F.min("score").alias("vector_score"))
    rows = edges.join(hits, "chunk_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    rows = rows.select("relationship_id", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), zero("graph_score"), zero("vector_score"), zero("confidence"), "ord")
    g, v, c = weights
    rows = rows.withColumn("final_score", g * F.col("graph_score") + v * F.col("vector_score") + c * F.col("confidence"))
    return rows.orderBy(F.desc("final_score"), F.col("ord").asc_nulls_last(), "chunk_id").drop("ord")


def context(graph: Graph, ranked: DataFrame, chunks: DataFrame, question: str, limit: int = 10) -> DataFrame:
    """(place, section, line): the question, the facts of the best relationships, the chunks they stand on, and where these are from."""
    name = lambda k, out: graph.entities.select(F.col("id").alias(k), F.col("canonical_name").alias(out))
    best = ranked.orderBy(F.desc("final_score"), "relationship_id", "chunk_id").limit(limit)
    facts = best.where("relationship_id is not null").join(graph.relationships.withColumnRenamed("id", "relationship_id").drop("confidence", "ord"), "relationship_id")
    facts = facts.join(name("source_entity_id", "s"), "source_entity_id").join(name("target_entity_id", "t"), "target_entity_id")
    lines = facts.select(F.lit(1).alias("place"), F.lit("GRAPH FACTS").alias("section"), F.concat("s", F.lit(" --"), "relationship_type", F.lit("--> "), "t").alias("line"))
    sources = best.select(F.col("chunk_id").alias("id")).distinct().join(chunks, "id")
    lines = lines.unionByName(sources.select(F.lit(2).alias("place"), F.lit("SOURCE").alias("section"), F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("text")).alias("line")))
    lines = lines.unionByName(sources.select(F.lit(3).alias("place"), F.lit("PROVENANCE").alias("section"), F.col("id").alias("line")))
    asked = ranked.sparkSession.createDataFrame([(0, "QUESTION", question)], "place int, section string, line string")
    return asked.unionByName(lines).orderBy("place", "line")


def context_text(lines: DataFrame) -> DataFrame:
    """One row, `context`: the sections of context() under their names. At most a few lines for each of its `limit` rows."""
    sections = lines.groupBy("place", "section").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("place", F.concat("section", F.lit(":\n"), "body").alias("part"))))
    return sections.agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "\n\n").alias("context"))


def rag_prompt(context: Column) -> Column:
    """What the language model is asked: an answer from the context alone, with its sources."""
    rules = (
        "Answer the question from the context below and from nothing else. Add no fact and no relationship that it does not state.\n"
        "If it does not hold enough, say so. Name the sources of each statement in brackets, as in [chunk_1].\n\n"
    )
    return F.concat(F.lit(rules), context)


def with_citations(answers: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """answers with citations: the different bracketed ids in the answer that the context has as a source, and unsupported: those that it has not."""
    cited = F.array_distinct(F.regexp_extract_all(F.col(answer), F.lit(r"\[([^\[\]\s]+)\]"), F.lit(1)))
    known = F.regexp_extract_all(F.col(context), F.lit(r"(?m)^\[([^\[\]\s]+)\] "), F.lit(1))
    return answers.withColumns({"citations": F.array_intersect(cited, known), "unsupported": F.array_except(cited, known)})


def generate(contexts: DataFrame, llm: Callable[[str], str], context: str = "context") -> DataFrame:
    """contexts with the model's answer to each, its citations, and bracketed ids that are no source."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(llm, na_action="ignore")

    return with_citations(contexts.withColumn("answer", ask(rag_prompt(F.col(context)))), "answer", context)
