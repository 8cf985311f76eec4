"""Name-plus-qualifier queries against the local index.

An entity is known under a name with a set S of qualifier tokens. A query with tokens Q is
answered by an entity only if S is contained in Q, so a specific entity is never served to a
coarser query. All queries are answered at once. Entities of one name and set form a class, and so do
queries of one name and set of tokens; the containment is tested between classes, which give counts and
the single entity where there is one. Lists of entities are made only where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import confidence, establishing_qualifiers, match_name
from keyloom.plans.store import CANDIDATES, Snapshot, cardinality
from keyloom.plans.workspace import stored

QUERY = "query_id long, name string, qualifiers array<string>, street string, city string, region string, country string"


def prepared(queries: DataFrame) -> DataFrame:
    """query_id, name_norm, q: the name's key and the sorted tokens of all facets."""
    c = F.col
    return queries.select("query_id", match_name(c("name")).alias("name_norm"), establishing_qualifiers(c("qualifiers"), c("city"), c("region"), c("country"), c("street")).alias("q"))


def name_entities(name_index: DataFrame) -> DataFrame:
    """name_norm, canonical_id, s: the sorted non-empty qualifiers of each name and entity."""
    return name_index.groupBy("name_norm", "canonical_id").agg(F.array_sort(F.collect_set(F.when(F.col("qualifier") != "", F.col("qualifier")))).alias("s"))


def entity_classes(name_index: DataFrame) -> DataFrame:
    """name_norm, s, n, one: how many entities have this name with this set, and the one with the smallest id."""
    return name_entities(name_index).groupBy("name_norm", "s").agg(F.count(F.lit(1)).alias("n"), F.min("canonical_id").alias("one"))


def _inside() -> Column:
    return (F.size("q") == 0) | (F.size(F.array_except("s", "q")) == 0)


def matched(query_classes: DataFrame, classes: DataFrame) -> DataFrame:
    """``query_classes`` (name_norm, q) plus within, near (numbers of entities) and one: the smallest of those within.

    Within: the entity's set is contained in the query's tokens (any set for a bare query); near: a token is shared.
    """
    met = query_classes.join(classes, "name_norm").groupBy("name_norm", "q").agg(
        F.sum(F.when(_inside(), F.col("n"))).alias("within"), F.min(F.when(_inside(), F.col("one"))).alias("one"), F.sum(F.when(F.arrays_overlap("s", "q"), F.col("n"))).alias("near")
    )
    out = query_classes.join(met, ["name_norm", "q"], "left")
    return out.select("name_norm", "q", F.coalesce("within", F.lit(0)).alias("within"), F.coalesce("near", F.lit(0)).alias("near"), "one")


def _lists(query_classes: DataFrame, name_index: DataFrame, entity: DataFrame, wanted: Column) -> DataFrame:
    """name_norm, q, listed: the entities (canonical_id, e) of the classes that are wanted, for each class of queries."""
    own = name_entities(name_index).join(entity, "canonical_id").groupBy("name_norm", "s").agg(F.collect_set("e").alias("es"))
    met = query_classes.join(own, "name_norm").filter(wanted)
    return met.groupBy("name_norm", "q").agg(F.array_sort(F.flatten(F.collect_list("es"))).alias("listed"))


def find_by_name(queries: DataFrame, name_index: DataFrame) -> DataFrame:
    """query_id, canonical_ids (sorted): all for a bare query, else those whose set is contained in it."""
    p = prepared(queries)
    ids = name_index.select("canonical_id").distinct().withColumn("e", F.col("canonical_id"))
    own = _lists(p.select("name_norm", "q").distinct(), name_index, ids, _inside())
    out = p.join(own, ["name_norm", "q"], "left")
    return out.select("query_id", F.coalesce("listed", F.array().cast("array<string>")).alias("canonical_ids"))


def count_by_name(queries: DataFrame, name_index: DataFrame) -> DataFrame:
    """query_id, n: how many entities :func:`find_by_name` lists."""
    p = prepared(queries)
    own = matched(p.select("name_norm", "q").distinct(), entity_classes(name_index)).select("name_norm", "q", "within")
    return p.join(own, ["name_norm", "q"], "left").select("query_id", F.coalesce("within", F.lit(0)).alias("n"))


def resolve_names(queries: DataFrame, s: Snapshot, *, listed: bool = True) -> DataFrame:
    """query_id, canonical_id, status, reason, confidence, n_candidates, candidates, hint for every query.

    In this order: no name: a miss. Names remembered as ambiguous for exactly these tokens: those
    candidates. Entities whose set is contained in the query (all for a bare query); where there is
    none, entities that share a token, if there are two or more. One: a hit; more: ambiguous;
    none: the entity remembered as unique for exactly these tokens, if it lives; else a miss.
    Without ``listed`` there is no column candidates, only their number: a list repeats for each of its queries.
    """
    p = prepared(queries)
    memory = cardinality(s.name_cardinality, s.entities).select("name_norm", F.col("qualifier_set").alias("qs"), F.col("candidates").alias("held"), F.col("status").alias("remembered"), F.col("canonical_id").alias("unique_id"))
    living = s.name_index.join(s.entities.select("canonical_id"), "canonical_id", "left_semi")
    classes = p.filter("name_norm <> ''").select("name_norm", "q").distinct()
    found = stored(matched(classes, entity_classes(living)), "matched")
    own = p.withColumn("qs", F.array_join("q", "\n")).join(memory, ["name_norm", "qs"], "left").join(found, ["name_norm", "q"], "left")
    blank, plural = F.col("name_norm") == "", F.coalesce(F.col("remembered") == "ambiguous", F.lit(False))
    near = (F.col("within") == 0) & (F.col("near") >= 2)
    n = F.when(blank, 0).when(plural, F.coalesce(F.size("held"), F.lit(0))).when(F.col("within") > 1, F.col("within")).when(near, F.col("near")).otherwise(0)
    hit = F.when(blank | plural, F.lit(None)).when(F.col("within") == 1, F.col("one")).when((F.col("within") == 0) & ~near, F.col("unique_id"))
    own = own.withColumn("canonical_id", hit).withColumn("n_candidates", n.cast("long")).withColumn("plural", plural)
    reason = F.when(F.col("canonical_id").isNotNull(), "local_name_match").when(~blank & (F.col("plural") | (F.col("n_candidates") > 1)), "ambiguous_among_n").otherwise("needs_stronger_identifier")
    candidates = []
    if listed:
        entity = s.entities.select("canonical_id", F.struct("canonical_id", "anchor", "name").alias("e"))
        several = found.filter("within > 1 or (within = 0 and near >= 2)")
        lists = _lists(several, living, entity, F.when(F.col("within") > 0, _inside()).otherwise(F.arrays_overlap("s", "q")))
        own = own.join(lists, ["name_norm", "q"], "left")
        none = F.array().cast(CANDIDATES)
        candidates = [F.when(F.col("n_candidates") == 0, none).when(F.col("plural"), F.coalesce("held", none)).otherwise(F.coalesce("listed", none)).alias("candidates")]
    return own.select(
        "query_id",
        "canonical_id",
        F.when(F.col("canonical_id").isNotNull(), "hit").otherwise("unresolved").alias("status"),
        reason.alias("reason"),
        confidence(reason).alias("confidence"),
        "n_candidates",
        *candidates,
        F.when(reason == "needs_stronger_identifier", "add a city, an address or an identifier").alias("hint"),
    )
