"""Conflicting, dated and doubtful facts: nothing is overwritten, each statement keeps its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import written
from lodestone.skew import hot_keys, join_split

#: The type of a relationship that denies another one.
DENIES = "NOT_"


def contradictions(relationships: DataFrame) -> DataFrame:
    """(source_entity_id, target_entity_id, relationship_type, stated_id, denied_id, stated_confidence, denied_confidence): relationships
    that stand beside their denial, between the same ends. A denial has its type after NOT_."""
    key = ["source_entity_id", "target_entity_id", "relationship_type"]
    denied = F.col("relationship_type").startswith(DENIES)
    side = lambda rows, what: rows.select(*key, F.col("id").alias(f"{what}_id"), F.col("confidence").alias(f"{what}_confidence"))
    stated = side(relationships.where(~denied), "stated")
    against = side(relationships.where(denied).withColumn("relationship_type", F.expr(f"substring(relationship_type, {len(DENIES) + 1})")), "denied")
    return stated.join(against, key).select(*key, "stated_id", "denied_id", "stated_confidence", "denied_confidence")


#: Buckets that one interval may be in before the length of a bucket is doubled.
MOST_BUCKETS = 64


def _placed(rows: DataFrame, days: int) -> DataFrame:
    """rows (a, b, level) with each level `at` and `bucket` in which they may meet others. An overlap begins where one of its rows does, so no bucket after the last beginning counts."""
    found = {r["level"]: r["a"] for r in rows.groupBy("level").agg(F.max("a").alias("a")).collect()}  # 16 at most: days are below 2 ** 22
    levels, latest = sorted(found), max(found.values(), default=0)
    # A row meets rows of its own and of each higher level in the buckets of that level.
    at = F.explode(F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: n >= F.col("level"))) if levels else F.lit(0)
    size = F.lit(days) * F.pow(F.lit(2), F.col("at")).cast("long")
    return rows.withColumn("at", at).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor(F.least(F.col("b") - 1, F.lit(latest)) / size))))


def overlaps(rows: DataFrame, key: list[str], id_col: str = "id", since: str = "valid_from", until: str = "valid_until", days: int = 90, side: Column | None = None) -> DataFrame:
    """(key, first_id, second_id, overlap_from, overlap_until): pairs of rows with equal keys that hold at a time together, from `since` on and before
    `until` (dates; null is open on that side). side: a boolean column; only pairs whose first row has it false and whose second one true.

    Time is cut into buckets of `days`; a row goes to each bucket that it touches, and a pair is found in the one in which its overlap begins. So a
    key with many rows is dealt out over its time. Longer intervals go in longer buckets: a level doubles them, and rows of
    different levels meet at the longer one's.
    """
    lo, hi = F.coalesce(F.col(since), F.lit("0001-01-01").cast("date")), F.coalesce(F.col(until), F.lit("9999-12-31").cast("date"))
    day = lambda d: F.datediff(d, F.lit("1970-01-01").cast("date"))
    rows = rows.select(*key, F.col(id_col).alias("id"), (F.lit(None) if side is None else side).cast("boolean").alias("side"), day(lo).alias("a"), day(hi).alias("b")).where("a < b")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("b") - F.col("a")) / F.lit(float(days * MOST_BUCKETS))))).cast("int")
    rows = rows.withColumn("level", level)
    placed = _placed(rows, days)
    x, y = (placed.alias("x"), placed.alias("y")) if side is None else (placed.where("NOT side").alias("x"), placed.where("side").alias("y"))
    begin, end = F.greatest("x.a", "y.a"), F.least("x.b", "y.b")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in key] + [F.col("x.at") == F.col("y.at"), F.col("x.bucket") == F.col("y.bucket")]
    met = x.join(y, same).where((F.col("x.id") < F.col("y.id") if side is None else F.lit(True)) & (F.greatest("x.level", "y.level") == F.col("x.at")) & (begin < end))
    met = met.where(F.floor(begin / (F.lit(days) * F.pow(F.lit(2), F.col("x.at")).cast("long"))) == F.col("x.bucket"))
    date = lambda n: F.date_add(F.lit("1970-01-01").cast("date"), n.cast("int"))
    return met.select(*[F.col(f"x.{c}").alias(c) for c in key], F.col("x.id").alias("first_id"), F.col("y.id").alias("second_id"), date(begin).alias("overlap_from"), date(end).alias("overlap_until"))


def contradictions_in_time(relationships: DataFrame, since: str = "valid_from", until: str = "valid_until", days: int = 90) -> DataFrame:
    """(source_entity_id, target_entity_id, stated_type, stated_id, denied_id, overlap_from, overlap_until): statements and denials between the same ends that hold at the same time."""
    kind = F.expr(f"IF(startswith(relationship_type, '{DENIES}'), substring(relationship_type, {len(DENIES) + 1}), relationship_type)")
    denied = F.col("relationship_type").startswith(DENIES)
    found = overlaps(relationships.withColumn("stated_type", kind), ["source_entity_id", "target_entity_id", "stated_type"], "id", since, until, days, denied)
    return found.withColumnsRenamed({"first_id": "stated_id", "second_id": "denied_id"})


def valid_at(relationships: DataFrame, when: Column, since: str = "valid_from", until: str = "valid_until") -> DataFrame:
    """The relationships that hold at the time: from `since` on and before `until`; null is open on that side."""
    return relationships.where((F.col(since).isNull() | (F.col(since) <= when)) & (F.col(until).isNull() | (F.col(until) > when)))


def combined_confidence(evidence: DataFrame, reliability: DataFrame | None = None, source: str = "chunk_id") -> DataFrame:
    """(relationship_id, confidence, n): the chance that at least one piece of evidence is right, where each is with its confidence times
    its source's reliability (source, reliability; unknown sources: 1)."""
    rows = evidence.select("relationship_id", "confidence", source)
    if reliability is not None:
        rows = rows.join(reliability.select(source, "reliability"), source, "left")
        rows = rows.withColumn("confidence", F.col("confidence") * F.coalesce("reliability", F.lit(1.0)))
    wrong = F.ln(F.greatest(1.0 - F.col("confidence"), F.lit(1e-300)))
    return rows.groupBy("relationship_id").agg((1.0 - F.exp(F.sum(wrong))).alias("confidence"), F.count("*").alias("n"))


def source_reliability(evidence: DataFrame, source: str = "chunk_id") -> DataFrame:
    """(source, n, reliability): of the relationships that a source states, the share that another source states as well, with one
    success and one failure added."""
    said = evidence.select(source, "relationship_id").distinct()
    shared = said.groupBy("relationship_id").agg(F.count("*").alias("sources"))
    rows = said.join(shared, "relationship_id").groupBy(source).agg(F.count("*").alias("n"), F.count(F.when(F.col("sources") > 1, 1)).alias("confirmed"))
    return rows.select(source, "n", ((F.col("confirmed") + 1.0) / (F.col("n") + 2.0)).alias("reliability"))


def propagated(evidence: DataFrame, source: str = "chunk_id", rounds: int | None = None, change: float = 1e-6, start: float = 0.8, damping: float = 0.5) -> tuple[DataFrame, DataFrame, int]:
    """((relationship_id, confidence), (source, reliability), rounds): facts and sources that support each other over any number of steps.

    A fact's confidence is the chance that one of its sources is right, each with its reliability times its own confidence; a source's reliability is the mean confidence
    of its facts, mixed with the start value by `damping`. Rounds go on until no reliability changes by more than `change`, or for a given number of them.
    Both sides are aggregations with partial results, so a source or a fact with very many statements is no hot key; a round's reliabilities are joined to the statements
    with hot sources where they are. A fact that one source states moves in no round: its source knows the sum of its statements.
    """
    said = written(evidence.groupBy(source, "relationship_id").agg(F.max("confidence").alias("c")), "said")
    # One statement c of a source r is c * r; more, and values that are no chance, go the general way.
    chance = F.coalesce((F.max("c") <= 1) & (F.count("c") == F.count("*")), F.lit(False)) if start <= 1 else F.lit(False)
    several = written(said.groupBy("relationship_id").agg(F.count("*").alias("n"), chance.alias("chance")).where("n > 1 OR NOT chance").select("relationship_id"), "several")
    lone, shared = said.join(several, "relationship_id", "left_anti"), written(said.join(several, "relationship_id", "left_semi"), "shared")
    stated = lone.select(source, "c").unionByName(shared.select(source, F.lit(0.0).alias("c")))
    trust = written(stated.groupBy(source).agg(F.sum("c").alias("lone"), F.count("*").alias("n")).withColumn("reliability", F.lit(float(start))), "trust")
    done, by_source, by_fact = 0, hot_keys(shared, source), hot_keys(shared, "relationship_id")
    while True:
        wrong = F.ln(F.greatest(1.0 - F.col("c") * F.col("reliability"), F.lit(1e-300)))
        facts = written(join_split(shared, trust.select(source, "reliability"), source, hot=by_source).groupBy("relationship_id").agg((1.0 - F.exp(F.sum(wrong))).alias("confidence")), "facts")
        if done == rounds:
            break
        came = join_split(shared, facts, "relationship_id", hot=by_fact).groupBy(source).agg(F.sum("confidence").alias("came"))
        mean = (F.col("reliability") * F.col("lone") + F.coalesce("came", F.lit(0.0))) / F.col("n")
        after = trust.join(came, source, "left").select(source, "lone", "n", (F.lit(damping * start) + (1.0 - damping) * mean).alias("reliability"), F.col("reliability").alias("old"))
        trust, done = written(after, "trust"), done + 1
        if rounds is None:
            most = trust.agg(F.max(F.abs(F.col("reliability") - F.col("old")))).first()[0]
            if most is None or most <= change:
                rounds = done  # once more for the facts
    alone = lone.join(trust.select(source, "reliability"), source).select("relationship_id", (F.col("c") * F.col("reliability")).alias("confidence"))
    return facts.unionByName(alone), trust.select(source, "reliability"), done
