"""Entity resolution without a sequential pass.

Within a type, a normalized name has one owner, so only the first mention of each (type, key) must be resolved; all
others follow by an equi-join. First mentions resolve to an earlier entity when their names agree in at least 95 % of
the longer one's characters. For names under 20 characters that means equal names, so only longer ones are compared,
and of these only names that share one of the rarest pieces of the first (similar_pairs).
Which of the similar names found an entity is decided in rounds: a name whose earlier similar names are all decided
joins the best that founded one, or founds its own.
Tables of names and keys are merged ("merge" hints): Spark sizes them by their packed files, or as before an explode, and
would send many times as much to every task by way of the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import levenshtein_similarity, name_key, with_name_key
from lodestone.ordering import in_order
from lodestone.schemas import make_id
from lodestone.scratch import written
from lodestone.skew import join_split

#: Similarity from which names are one, and the edits it allows: one for each so many characters of the longer name.
SIMILAR, PER_EDIT = 0.95, 20
#: Letters of a piece: long ones tell very many names apart, short ones fit where names differ in a few letters only. (Edits + 1) * the longest fit into any name.
PIECES = (8, 3)
#: Slots of the table that tells rare pieces.
SLOTS = 1 << 16


def most_edits(length: int) -> int:
    """The edits that a name may be away from one it is similar to."""
    return (length + length // PER_EDIT + 1) // PER_EDIT


def _grams(name: str, letters: int) -> list[str]:
    return [name[i : i + letters] for i in range(len(name) - letters + 1)]


def _slot(gram: str) -> int:
    return xxhash.xxh32_intdigest(gram.encode()) % SLOTS


def gram_counts(long: DataFrame) -> np.ndarray:
    """How often the grams of each of SLOTS slots stand in the names: an upper bound of each gram's number, of fixed size."""

    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            slots = [_slot(g) for name in batch.column("name").to_pylist() for letters in PIECES for g in _grams(name, letters)]
            counts += np.bincount(np.array(slots, np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    for r in long.select("name").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def rare_pieces(name: str, counts: np.ndarray) -> list[tuple[int, int]]:
    """(place, letters) of disjoint grams, one more than edits allowed, with the least total number."""
    k, size = most_edits(len(name)) + 1, len(name)
    costs = [(letters, counts[[_slot(g) for g in _grams(name, letters)]].tolist()) for letters in PIECES]
    # best[j][i]: the least total of j grams from place i on, and the first one's letters (less than zero, so that ties go to longer ones) and place.
    best = [[(0, 0, -1)] * (size + 1)]
    for _ in range(k):
        row, rest = [(1 << 62, 0, -1)] * (size + 1), best[-1]
        for i in range(size - min(PIECES), -1, -1):
            now = row[i + 1]
            for letters, cost in costs:
                if i + letters <= size:
                    total = cost[i] + rest[i + letters][0]
                    if total < now[0] or total == now[0] and -letters < now[1]:
                        now = (total, -letters, i)
            row[i] = now
        best.append(row)
    out, i = [], 0
    for j in range(k, 0, -1):
        _, letters, at = best[j][i]
        out.append((at, -letters))
        i = at - letters
    return out


def similar_pairs(names: DataFrame, asking: Column | None = None) -> DataFrame:
    """(later, earlier, score): pairs of one type with score >= 0.95. names: rid, type, name, seq; asking: which names may be the later one (all).

    d edits leave one of d + 1 disjoint pieces of a name whole, and move it by d places at most. So each name looks for its rarest pieces
    in the other names' grams, on one side of a pair; what many names have in common is not looked for if there is anything else.
    Numbers stand for the names and hashes for pieces and places until names have met; every pair is then compared by its names.
    """
    asks = F.lit(True) if asking is None else asking
    long = names.where(F.length("name") >= PER_EDIT - 1).select("rid", "type", "name", "seq", asks.alias("asks"))
    long = written(long.withColumn("nid", F.monotonically_increasing_id()), "long")
    counts = gram_counts(long)

    def run(batches):
        for batch in batches:
            out = []
            for row, name in enumerate(batch.column("name").to_pylist()):
                d = most_edits(len(name))
                out += [(row, name[p : p + letters], at, letters) for p, letters in rare_pieces(name, counts) for at in range(max(p - d, 0), p + d + 1)]
            if out:
                rows, piece, at, letters = zip(*out, strict=True)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column("nid").take(rows), batch.column("type").take(rows), pa.array(piece), pa.array(at, pa.int32()), pa.array(letters, pa.int32())], names=["nid", "type", "piece", "at", "letters"])

    key = lambda piece, at: F.xxhash64("type", piece, at)
    a = long.select("nid", "type", "name").mapInArrow(run, T.StructType([long.schema["nid"], long.schema["type"], T.StructField("piece", T.StringType()), T.StructField("at", T.IntegerType()), T.StructField("letters", T.IntegerType())]))
    a = written(a.select(F.col("nid").alias("earlier"), key("piece", "at").alias("key"), "letters"), "pieces")
    used = [r["letters"] for r in a.select("letters").distinct().collect()]  # as many as PIECES
    grams = lambda n: F.transform(F.sequence(F.lit(0), F.length("name") - n), lambda i: key(F.substr("name", i + 1, F.lit(n)), i))
    keys = F.concat(*[grams(n) for n in used]) if used else F.array().cast("array<bigint>")
    b = long.where("asks").select(F.col("nid").alias("later"), F.explode(keys).alias("key"))
    met = a.select("key", "earlier").hint("merge").join(b.hint("merge"), "key").where("earlier <> later").select("later", "earlier").distinct()
    side = lambda what: long.select(F.col("nid").alias(what), F.struct("rid", "type", "name", "seq").alias(what[0])).hint("merge")
    met = met.join(side("later"), "later").join(side("earlier"), "earlier").where("e.type = l.type AND e.seq < l.seq")
    x, y = F.col("e.name"), F.col("l.name")
    longest = F.greatest(F.length(x), F.length(y))
    near = (F.abs(F.length(x) - F.length(y)) * PER_EDIT <= longest) & (F.levenshtein(x, y) * PER_EDIT <= longest)
    pairs = met.where(near).select(F.col("l.rid").alias("later"), F.col("e.rid").alias("earlier"), levenshtein_similarity(x, y).alias("score"))
    return pairs.dropDuplicates(["later", "earlier"])


def found_entities(firsts: DataFrame) -> DataFrame:
    """(rid, founder) for first mentions: rid, type, name, seq. A founder's own rid stands for itself; names with seq.new = 0 always found."""
    alone = firsts.select("rid", F.col("rid").alias("founder"))
    if firsts.where((F.length("name") >= PER_EDIT - 1) & (F.col("seq.new") == 1)).isEmpty():
        return alone
    pairs = written(similar_pairs(firsts, F.col("seq.new") == 1), "similar")
    if pairs.isEmpty():
        return alone
    involved = pairs.select(F.col("later").alias("rid")).unionByName(pairs.select(F.col("earlier").alias("rid"))).distinct()
    decided = written(involved.join(pairs.select(F.col("later").alias("rid")).hint("merge"), "rid", "left_anti").select("rid", F.col("rid").alias("founder")), "founders")
    order = firsts.select(F.col("rid").alias("earlier"), F.col("seq").alias("earlier_seq"))
    ranked = written(pairs.hint("merge").join(order.hint("merge"), "earlier"), "similar")
    while True:
        open_ = ranked.join(decided.select(F.col("rid").alias("later")).hint("merge"), "later", "left_anti")
        state = open_.join(decided.select(F.col("rid").alias("earlier"), "founder").hint("merge"), "earlier", "left")
        choice = F.min(F.when(F.col("founder") == F.col("earlier"), F.struct((-F.col("score")).alias("s"), "earlier_seq", "earlier")))
        ready = state.groupBy("later").agg(F.count(F.when(F.col("founder").isNull(), 1)).alias("waits"), choice.alias("best")).where("waits = 0")
        ready = written(ready.select(F.col("later").alias("rid"), F.coalesce("best.earlier", "later").alias("founder")), "founders")
        if ready.isEmpty():
            break
        decided = decided.unionByName(ready)
    return firsts.select("rid").join(decided.hint("merge"), "rid", "left").select("rid", F.coalesce("founder", "rid").alias("founder"))


def _owners(entities: DataFrame) -> DataFrame:
    """(type, key, o): who owns a name key among the entities, the first of them: o has ord, id, via (exact or alias)."""
    spellings = F.concat(F.array(F.struct(F.col("canonical_name").alias("name"), F.lit("exact").alias("via"))), F.transform("aliases", lambda a: F.struct(a.alias("name"), F.lit("alias").alias("via"))))
    names = entities.select("id", F.col("entity_type").alias("type"), "ord", F.explode(spellings).alias("n"))
    owners = names.select("type", name_key(F.col("n.name")).alias("key"), F.struct("ord", F.when(F.col("n.via") == "exact", 0).otherwise(1).alias("rank"), "id", F.col("n.via").alias("via")).alias("o"))
    return owners.groupBy("type", "key").agg(F.min("o").alias("o"))


def _resolved(mentions: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(the mentions with entity_id, matched_via, canonical_name; new entities: id, canonical_name, entity_type, ord), after the known entities."""
    keyed = written(with_name_key(mentions), "mentions", packed=True)
    firsts = keyed.groupBy("type", "key").agg(F.min(F.struct("seq", "name")).alias("f"))
    firsts = firsts.select(make_id("entity", F.col("type"), F.col("key")).alias("rid"), "type", "key", "f.name", "f.seq")
    # Known entities come before all mentions.
    place = lambda new, ord_, seq: F.struct(F.lit(new).alias("new"), ord_.cast("long").alias("ord"), seq.alias("seq"))
    nothing = F.lit(None).cast(keyed.schema["seq"].dataType)
    own = None
    if known is not None:
        own = written(_owners(known), "owners")
        firsts = firsts.join(own.select("type", "key").hint("merge"), ["type", "key"], "left_anti")
    firsts = written(firsts, "firsts")
    names = firsts.select("rid", "type", "name", place(1, F.lit(None), F.col("seq")).alias("seq"))
    if known is not None:
        names = written(names.unionByName(known.select(F.col("id").alias("rid"), F.col("entity_type").alias("type"), F.col("canonical_name").alias("name"), place(0, F.col("ord"), nothing).alias("seq"))), "names")
    founders = found_entities(names)
    canonical = names.select(F.col("rid").alias("founder"), F.col("name").alias("canonical_name"))
    owner = firsts.hint("merge").join(founders.hint("merge"), "rid").join(canonical.hint("merge"), "founder").select("type", "key", F.col("seq").alias("first_seq"), F.col("founder").alias("entity_id"), "canonical_name", (F.col("founder") == F.col("rid")).alias("own"))
    if known is not None:
        told = own.hint("merge").join(known.select(F.col("id").alias("entity_id"), "canonical_name").hint("merge"), F.col("o.id") == F.col("entity_id"))
        owner = owner.unionByName(told.select("type", "key", nothing.alias("first_seq"), "entity_id", "canonical_name", (F.col("o.via") == "exact").alias("own")))
    owner = written(owner, "owners")
    joined = join_split(keyed, owner.hint("merge"), ["type", "key"])
    first = F.coalesce(F.col("seq") == F.col("first_seq"), F.lit(False))
    via = F.when(first & F.col("own"), "new").when(first, "similarity").when(F.col("own"), "exact").otherwise("alias")
    found = written(joined.withColumn("matched_via", via).drop("first_seq", "own", "key"), "resolved", packed=True)
    new = owner.where("own AND first_seq IS NOT NULL").select(F.col("entity_id").alias("id"), "canonical_name", F.col("type").alias("entity_type"), F.col("first_seq").alias("ord"))
    return found, new


def _spellings(found: DataFrame) -> DataFrame:
    """(id, spelled): the different names by which an entity was mentioned besides its own, in the order of their first mention."""
    rows = found.where(F.col("name") != F.col("canonical_name")).groupBy("entity_id", "name").agg(F.min("seq").alias("seq"))
    rows = rows.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("a"))
    return rows.select("id", F.transform("a", lambda x: x["name"]).alias("spelled"))


NO_NAMES = "CAST(array() AS array<string>)"


def resolve_stream(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resolves all mentions of a corpus in the order of seq, starting from no entity. mentions: name, type, seq (unique), and more.

    Returns the mentions with entity_id and matched_via (new, similarity, exact, alias), and the entities they make.
    """
    found, new = _resolved(mentions, None)
    entities = new.join(_spellings(found).hint("merge"), "id", "left").select("id", "canonical_name", "entity_type", F.coalesce("spelled", F.expr(NO_NAMES)).alias("aliases"), "ord")
    return found.drop("canonical_name"), entities


def resolve_into(known: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As resolve_stream, with known entities (ord: a number) before all mentions: the mentions resolved, and the known and new entities.

    Of several known entities with a key, the first is it. Known entities get the new spellings after their aliases; new ones are numbered
    after the known ones.
    """
    found, new = _resolved(mentions, known)
    spelled = written(_spellings(found), "spellings")
    last = known.agg(F.max("ord")).first()[0]
    numbered = in_order(new, "ord", packed=True).withColumn("ord", F.col("place") + (0 if last is None else last + 1)).drop("place")
    kept = [c for c in known.columns if c in ("description", "metadata")]
    old = known.join(spelled.hint("merge"), "id", "left").select("id", "canonical_name", "entity_type", F.concat("aliases", F.array_except(F.coalesce("spelled", F.expr(NO_NAMES)), "aliases")).alias("aliases"), F.col("ord").cast("long").alias("ord"), *kept)
    made = numbered.join(spelled.hint("merge"), "id", "left").select("id", "canonical_name", "entity_type", F.coalesce("spelled", F.expr(NO_NAMES)).alias("aliases"), "ord")
    return found.drop("canonical_name"), old.unionByName(made, allowMissingColumns=True)


def resolve_against(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """mentions (mid, name, type) with entity_id and matched_via against a graph's entities, each on its own.

    The earliest entity with the key as its name or an alias wins; else the most similar canonical name of 95 % or more; else new, with no id.
    """
    owners = _owners(entities)
    asked = mentions.withColumn("key", name_key(F.col("name"))).join(owners.hint("merge"), ["type", "key"], "left")
    rest = asked.where("o is null").select("type", "name").distinct().select(F.to_json(F.struct("type", "name")).alias("rid"), "type", "name", F.lit(2**62).alias("seq"))
    known = entities.select(F.concat(F.lit("e"), "id").alias("rid"), F.col("entity_type").alias("type"), F.col("canonical_name").alias("name"), F.col("ord").cast("long").alias("seq"))
    pairs = similar_pairs(written(known.unionByName(rest), "names"), F.col("seq") == 2**62)
    order = entities.select(F.concat(F.lit("e"), "id").alias("earlier"), "ord", "id")
    best = pairs.join(order.hint("merge"), "earlier").groupBy("later").agg(F.min(F.struct((-F.col("score")).alias("s"), "ord", "id")).alias("b"))
    best = rest.join(best.select(F.col("later").alias("rid"), F.col("b.id").alias("near")), "rid").select("type", "name", "near")
    out = asked.join(best, ["type", "name"], "left")
    via = F.when(F.col("o").isNotNull(), F.col("o.via")).when(F.col("near").isNotNull(), "similarity").otherwise("new")
    return out.select(*[c for c in mentions.columns], F.coalesce("o.id", "near").alias("entity_id"), via.alias("matched_via"), (via == "new").alias("is_new"))


def ranked_mentions(extractions: DataFrame, order: list[str]) -> DataFrame:
    """One row per extracted entity with seq, its place in the corpus: a struct of the chunk's `order` columns and the place in the answer."""
    chunks = extractions.where(F.col("entities").isNotNull())
    return chunks.select("chunk_id", *[c for c in order if c != "chunk_id"], F.posexplode("entities").alias("pos", "e")).select(
        "chunk_id", "pos", F.col("e.name").alias("name"), F.col("e.entity_type").alias("type"), F.struct(*order, "pos").alias("seq")
    )


