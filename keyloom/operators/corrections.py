"""Corrections by hand: link, merge and split, as small relations against a snapshot."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import kinds as K
from keyloom.functions.scalars import canonical_id
from keyloom.operators.resolve import anchor
from keyloom.plans.store import Snapshot, attach, find, reanchored, repointed

MOST_SUFFIXES = 100


class Refused(ValueError):
    """A correction that a guard does not allow."""


def strong_keys(keys: DataFrame, column: str = "key") -> DataFrame:
    """``keys`` plus valid: is it the key of a strong kind? Values are taken as they are."""
    kind = K.kind_of(F.col(column))
    return keys.withColumn("valid", F.coalesce(K.known(kind) & K.strong(kind) & F.col(column).contains(":") & (K.value_of(F.col(column)) != ""), F.lit(False)))


def same_kind_conflicts(members: DataFrame) -> DataFrame:
    """``members``: grp, side, key. The groups where two sides name different values of one identity kind."""
    kind = K.kind_of(F.col("key"))
    own = members.filter(K.grain(kind) == K.IDENTITY).select("grp", "side", kind.alias("kind"), "key").distinct()
    many = own.groupBy("grp", "kind").agg(F.count_distinct("side").alias("sides"), F.count_distinct("key").alias("keys"))
    return many.filter("sides > 1 and keys > 1").select("grp").distinct()


def link_outcomes(pairs: DataFrame, s: Snapshot) -> DataFrame:
    """``pairs`` (a, b) plus cid_a, cid_b, outcome: what linking each pair would do.

    invalid, self, created, attached, already_linked, merged, or conflict where sides differ in
    the value of an identity kind.
    """
    own = pairs.withColumn("grp", F.xxhash64("a", "b"))
    at = find(own.withColumnRenamed("a", "key"), s).withColumnRenamed("key", "a").withColumnRenamed("canonical_id", "cid_a")
    at = find(at.withColumnRenamed("b", "key"), s).withColumnRenamed("key", "b").withColumnRenamed("canonical_id", "cid_b")
    side = lambda k: at.select("grp", F.lit(k).alias("side"), F.col(k).alias("key"), F.col(f"cid_{k}").alias("canonical_id"))
    sides = side("a").unionByName(side("b"))
    held = sides.join(s.nodes.select("canonical_id", F.col("key").alias("k")), "canonical_id", "left").select("grp", "side", F.coalesce("k", "key").alias("key")).unionByName(sides.select("grp", "side", "key"))
    conflict = same_kind_conflicts(held).withColumn("conflict", F.lit(True))
    checked = strong_keys(strong_keys(at, "a").withColumnRenamed("valid", "va"), "b").join(conflict, "grp", "left")
    outcome = (
        F.when(~F.col("va") | ~F.col("valid"), "invalid")
        .when(F.col("a") == F.col("b"), "self")
        .when(F.col("cid_a") == F.col("cid_b"), "already_linked")
        .when(F.col("conflict"), "conflict")
        .when(F.col("cid_a").isNull() & F.col("cid_b").isNull(), "created")
        .when(F.col("cid_a").isNull() | F.col("cid_b").isNull(), "attached")
        .otherwise("merged")
    )
    return checked.select(*pairs.columns, "cid_a", "cid_b", outcome.alias("outcome"))


def winners(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """``groups``: grp, canonical_id. grp, winner: the best anchor's entity, then the smallest id."""
    own = groups.join(entities, "canonical_id")
    return own.groupBy("grp").agg(F.min_by("canonical_id", F.struct(K.rank(K.kind_of(F.col("anchor"))), F.col("canonical_id"))).alias("winner"))


def merge(s: Snapshot, ids: list[str], *, force: bool = False) -> tuple[Snapshot, str]:
    """One entity out of several. Refuses unknown ids and, without ``force``, conflicting identities."""
    spark = s.nodes.sparkSession
    order = {c: i for i, c in reversed(list(enumerate(ids)))}
    groups = spark.createDataFrame([(1, c, i) for c, i in order.items()], "grp int, canonical_id string, place int")
    missing = [r[0] for r in groups.join(s.entities, "canonical_id", "left_anti").select("canonical_id").collect()]
    if missing or not ids:
        raise Refused(f"no such entity: {', '.join(missing) or '-'}")
    if len(order) == 1:
        return s, ids[0]
    if not force and not same_kind_conflicts(s.nodes.join(groups, "canonical_id").select("grp", F.col("canonical_id").alias("side"), "key")).isEmpty():
        raise Refused("the entities differ in an identity; use force")
    winner = winners(groups, s.entities).first()["winner"]
    moves = groups.filter(F.col("canonical_id") != winner).select(F.col("canonical_id").alias("loser"), F.lit(winner).alias("winner"))
    own = s.entities.join(groups, "canonical_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col("canonical_id") != winner), F.col("place"))).alias(c)
    told = own.agg(first("entity_type"), first("name")).withColumn("canonical_id", F.lit(winner))
    filled = s.entities.join(told.select("canonical_id", F.col("entity_type").alias("t"), F.col("name").alias("n")), "canonical_id", "left").select("canonical_id", "anchor", F.coalesce("entity_type", "t").alias("entity_type"), F.coalesce("name", "n").alias("name"))
    return reanchored(repointed(replace(s, entities=filled), moves), spark.createDataFrame([(winner,)], "canonical_id string")), winner


def _free_id(s: Snapshot, base: str) -> str:
    """``base``, or with the first suffix that no entity has: ids are 32-bit hashes, and may be a stranger's."""
    names = [base, *(f"{base}_{i}" for i in range(1, MOST_SUFFIXES + 1))]
    taken = {r[0] for r in s.entities.filter(F.col("canonical_id").isin(names)).select("canonical_id").collect()}
    new = next((n for n in names if n not in taken), None)
    if new is None:
        raise Refused("no free id for the new entity")
    return new


def link(s: Snapshot, a: str, b: str, *, force: bool = False) -> tuple[Snapshot, str, str]:
    """(snapshot, canonical id, outcome) after saying that two strong keys name one thing."""
    spark = s.nodes.sparkSession
    r = link_outcomes(spark.createDataFrame([(a, b)], "a string, b string"), s).first()
    if r["outcome"] in ("invalid", "self"):
        raise Refused(f"cannot link {a} and {b}: {r['outcome']}")
    if r["outcome"] == "conflict" and not force:
        raise Refused("the sides differ in an identity; use force")
    ca, cb = r["cid_a"], r["cid_b"]
    if ca is not None and ca == cb:
        return s, ca, "already_linked"
    if ca is not None and cb is not None:
        out, winner = merge(s, [ca, cb], force=True)
        return out, winner, "merged"
    new = spark.createDataFrame([(k,) for k in (a, b)], "key string")
    if ca is None and cb is None:
        made = new.agg(anchor().alias("anchor")).select(canonical_id(F.col("anchor")).alias("canonical_id"), "anchor", F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("name"))
        cid, outcome = _free_id(s, made.first()["canonical_id"]), "created"
        s = replace(s, entities=s.entities.unionByName(made.withColumn("canonical_id", F.lit(cid))))
        add = new
    else:
        cid, outcome, add = ca or cb, "attached", new.filter(F.col("key") == (a if ca is None else b))
    s = replace(s, nodes=attach(s.nodes, add.select("key", F.lit(cid).alias("canonical_id"), F.lit("link").alias("source"))))
    return reanchored(s, spark.createDataFrame([(cid,)], "canonical_id string")), cid, outcome


def split(s: Snapshot, keys: list[str]) -> tuple[Snapshot, str]:
    """Moves strong keys of one entity to a new one, which gets no name and no type.

    The entity keeps at least one strong key; its name rows go, since they may describe either.
    """
    spark = s.nodes.sparkSession
    wanted = spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "key string")
    rows = find(strong_keys(wanted), s).collect()
    if not rows or any(not r["valid"] or r["canonical_id"] is None for r in rows):
        raise Refused("every key must be a strong key of the crosswalk")
    owners = {r["canonical_id"] for r in rows}
    if len(owners) > 1:
        raise Refused("the keys belong to different entities")
    old = owners.pop()
    if s.nodes.filter(F.col("canonical_id") == old).count() <= len(rows):
        raise Refused("the entity must keep a strong key")
    made = wanted.agg(anchor().alias("anchor")).select("anchor", canonical_id(F.col("anchor")).alias("base")).first()
    new = _free_id(s, made["base"])
    moved = s.nodes.join(wanted.withColumn("__moved", F.lit(True)), "key", "left").select("key", F.when(F.col("__moved"), new).otherwise(F.col("canonical_id")).alias("canonical_id"), "source")
    null = F.lit(None).cast("string")
    entities = s.entities.unionByName(spark.createDataFrame([(new, made["anchor"])], "canonical_id string, anchor string").select("canonical_id", "anchor", null.alias("entity_type"), null.alias("name")))
    out = replace(s, nodes=moved, entities=entities, name_index=s.name_index.filter(F.col("canonical_id") != old), name_cardinality=s.name_cardinality.filter(F.col("canonical_id").isNull() | (F.col("canonical_id") != old)))
    return reanchored(out, spark.createDataFrame([(old,), (new,)], "canonical_id string")), new
