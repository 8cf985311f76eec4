"""Completion from hubs: a bounded breadth-first search, one join per hop for all seeds."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import confidence
from keyloom.operators.resolve import Clusters, resolve_exact
from keyloom.plans.store import Snapshot, find, members
from keyloom.plans.workspace import stored
from keyloom.sources import hubs as H
from keyloom.sources.records import Batch, from_ids

HOPS, FAN = 3, 64
UPGRADED = ["exact_strong_key", "synthetic_strong_key", "new_public_anchor"]


def settled(c: Clusters) -> Clusters:
    return Clusters(*(stored(t, "snapshot") for t in (c.entities, c.nodes, c.phone_edges, c.outcomes)))


def complete(batch: Batch, table: DataFrame, s: Snapshot, *, hops: int = HOPS) -> tuple[Clusters, DataFrame]:
    """(clusters, outcomes) after committing ``batch`` and completing its entities from the hub table.

    At most ``hops`` times, every member of a seed's cluster is sent to the hubs of its kind,
    each (hub, key) once and not to hubs whose kind of answer the cluster has; what comes back is
    committed. It ends when a hop adds no edge. Seeds are found again through a key of theirs
    after each hop, since a commit may merge them into another entity.
    """
    spark = batch.ids.sparkSession
    batch = replace(batch, ids=stored(batch.ids, "batch"))  # normalized once, and so are the signatures of the answers
    batch = replace(batch, records=stored(batch.records, "batch-records"))
    table = stored(table, "answers")
    now = settled(resolve_exact(batch, s.clusters))
    seeds = now.outcomes
    at = batch.ids.filter("strong").groupBy("seq").agg(F.min_by("key", "pos").alias("key"))
    dispatch = F.broadcast(spark.createDataFrame([(k, h, i) for i, (k, h) in enumerate(H.DISPATCH)], "kind string, hub string, place int"))
    gate = F.broadcast(spark.createDataFrame([(h, k) for h, ks in H.SUPERFLUOUS.items() for k in ks], "hub string, has string"))
    visited = spark.createDataFrame([], "hub string, kind string, value string")
    edges = seeds.select("seq", "new_edges")
    for hop in range(hops):
        snap = Snapshot(now.entities, now.nodes, now.phone_edges, s.name_index, s.name_cardinality, s.resolutions)
        own = find(at, snap).filter("canonical_id is not null").select("seq", "canonical_id")
        one = own.groupBy("canonical_id").agg(F.min("seq").alias("seq"))
        each = members(snap).join(one, "canonical_id").select("seq", "canonical_id", F.explode("members").alias("m")).select("seq", "canonical_id", "m.kind", "m.value")
        has = each.select("canonical_id", F.col("kind").alias("has")).distinct()
        wanted = each.join(dispatch, "kind").join(visited, ["hub", "kind", "value"], "left_anti")
        blocked = has.join(gate, "has").select("canonical_id", "hub").distinct()
        asked = stored(wanted, "asked")
        visited = visited.unionByName(asked.select("hub", "kind", "value"))
        asked = H.numbered_requests(asked.join(blocked, ["canonical_id", "hub"], "left_anti"), "seq", ["kind", "value", "place"])
        fan = max(FAN, (asked.agg(F.max("n")).first()[0] or 0) + 1)  # no cluster's requests reach into the next one's
        asked = asked.withColumn("rid", F.col("seq") * fan + F.col("n"))
        got = stored(H.harvested(asked.select("rid", "hub", "kind", "value"), table), "harvest")
        if got.isEmpty():
            break
        ids = got.select(F.col("rid").alias("seq"), F.posexplode("ids").alias("pos", "i")).select("seq", "pos", "i.kind", "i.value")
        source = F.create_map(*[F.lit(x) for kv in H.SOURCE.items() for x in kv])[F.col("hub")]
        said = got.select(F.col("rid").alias("seq"), "entity_type", "name", F.size("ids").cast("long").alias("harvested"), source.alias("source"))
        now = settled(resolve_exact(from_ids(ids, said), Clusters(now.entities, now.nodes, now.phone_edges, now.outcomes)))
        added = now.outcomes.join(asked.select(F.col("rid").alias("seq"), F.col("seq").alias("seed")), "seq").select(F.col("seed").alias("seq"), "new_edges")
        edges = edges.unionByName(added)
        if (added.agg(F.sum("new_edges")).first()[0] or 0) == 0:
            break
    total = edges.groupBy("seq").agg(F.sum("new_edges").alias("all_edges"))
    final = find(at, Snapshot(now.entities, now.nodes, now.phone_edges, s.name_index, s.name_cardinality, s.resolutions)).select("seq", F.col("canonical_id").alias("now_id"))
    out = seeds.join(total, "seq").join(final, "seq", "left").join(now.entities.select(F.col("canonical_id").alias("now_id"), F.col("anchor").alias("a"), F.col("entity_type").alias("t"), F.col("name").alias("n")), "now_id", "left")
    reason = F.when((F.col("all_edges") > F.col("new_edges")) & F.col("reason").isin(UPGRADED), "hub_crosswalk").otherwise(F.col("reason"))
    out = out.select(
        "seq", F.coalesce("now_id", "canonical_id").alias("canonical_id"), F.coalesce("a", "anchor").alias("anchor"), F.coalesce("t", "entity_type").alias("entity_type"), F.coalesce("n", "name").alias("name"),
        "status", reason.alias("reason"), "matched_via", F.col("all_edges").alias("new_edges"), "harvested", "candidates", confidence(reason).alias("confidence"),
    )
    return now, stored(out, "outcomes")


def resolve_by_name(queries: DataFrame, table: DataFrame, s: Snapshot) -> tuple[Snapshot, DataFrame]:
    """(snapshot, outcomes) of name queries: the local index first, hubs only for what it cannot answer.

    Several places for a name are remembered and refused; one place (and a placekey, given a
    street) is completed, indexed under the name and remembered as unique.
    """
    from keyloom.operators.names import prepared, resolve_names
    from keyloom.plans import store as S

    local = stored(resolve_names(queries, s), "local")
    open_ = queries.join(local.filter("reason = 'needs_stronger_identifier'").select("query_id"), "query_id", "left_semi").join(prepared(queries).filter("name_norm <> ''").select("query_id", "name_norm", "q"), "query_id")
    places = H.answered(H.search_requests(open_), table).select("query_id", H.found_places(F.col("response")).alias("places"))
    keys = H.answered(H.placekey_requests(open_), table).select("query_id", H.found_placekey(F.col("response")).alias("placekey"))
    own = stored(open_.join(places, "query_id", "left").join(keys, "query_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>"))), "open")
    many = own.filter("size(places) > 1")
    known = many.select("query_id", F.posexplode("places").alias("pos", "place")).withColumn("key", F.concat(F.lit("google_place_id:"), "place"))
    known = find(known, s).join(s.entities.select("canonical_id", "anchor", "name"), "canonical_id", "left")
    listed = known.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical_id", F.lit("")).alias("canonical_id"), F.coalesce("anchor", "key").alias("anchor"), "name"))).alias("l"))
    plural = many.join(listed, "query_id").select("query_id", "name_norm", "q", F.transform("l", lambda x: F.struct(x["canonical_id"].alias("canonical_id"), x["anchor"].alias("anchor"), x["name"].alias("name"))).alias("candidates"))
    memory = S.record_cardinality(s.name_cardinality, plural.select(F.col("query_id").alias("seq"), "name_norm", F.col("q").alias("qualifiers"), "candidates", F.lit(None).cast("string").alias("canonical_id")))
    pair = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("value")))
    single = own.filter("size(places) <= 1").select("query_id", F.array_compact(F.array(pair("placekey", F.col("placekey")), pair("google_place_id", F.try_element_at("places", F.lit(1))))).alias("ids"), "name_norm", "q", "name").filter("size(ids) > 0")
    ids = single.select(F.col("query_id").alias("seq"), F.posexplode("ids").alias("pos", "i")).select("seq", "pos", "i.kind", "i.value")
    null = F.lit(None).cast("string")
    said = single.select(F.col("query_id").alias("seq"), null.alias("entity_type"), null.alias("name"), F.size("ids").cast("long").alias("harvested"), F.lit("input").alias("source"))
    clusters, done = complete(from_ids(ids, said), table, s)
    done = done.join(single.select(F.col("query_id").alias("seq"), "ids", "name_norm", "q", F.col("name").alias("asked")), "seq").filter("canonical_id is not null")
    reason = F.when(F.exists("ids", lambda i: i["kind"] == "placekey"), "placekey_address").otherwise("place_unique_match")
    done = stored(done.withColumn("reason", reason).withColumn("confidence", confidence(reason)), "named")
    told = done.groupBy("canonical_id").agg(F.min_by("asked", "seq").alias("name")).withColumn("entity_type", null)
    entities = S.enrich(clusters.entities, told.select("canonical_id", "entity_type", "name"))
    from keyloom.functions.scalars import match_name

    alias = entities.join(done.select("canonical_id", "q"), "canonical_id").select(match_name(F.col("name")).alias("name_norm"), F.col("q").alias("qualifiers"), "canonical_id", F.lit("name_query").alias("source"))
    names = S.index_names(s.name_index, done.select("name_norm", F.col("q").alias("qualifiers"), "canonical_id", F.lit("name_query").alias("source")).unionByName(alias))
    unique = done.filter(F.exists("ids", lambda i: i["kind"] == "google_place_id"))
    memory = S.record_cardinality(memory, unique.select("seq", "name_norm", F.col("q").alias("qualifiers"), F.lit(None).cast(S.CANDIDATES).alias("candidates"), "canonical_id"))
    none = F.array().cast(S.CANDIDATES)
    by_hub = done.select(F.col("seq").alias("query_id"), F.col("canonical_id").alias("c"), F.lit("hit").alias("st"), F.col("reason").alias("r"), none.alias("k")).unionByName(
        plural.select("query_id", null.alias("c"), F.lit("unresolved").alias("st"), F.lit("ambiguous_among_n").alias("r"), F.col("candidates").alias("k"))
    )
    out = local.join(by_hub, "query_id", "left").select("query_id", F.coalesce("c", "canonical_id").alias("canonical_id"), F.coalesce("st", "status").alias("status"), F.coalesce("r", "reason").alias("reason"), F.coalesce("k", "candidates").alias("candidates"))
    out = out.withColumn("confidence", confidence(F.col("reason")))
    return replace(s, entities=entities, nodes=clusters.nodes, phone_edges=clusters.phone_edges, name_index=names, name_cardinality=memory), out
