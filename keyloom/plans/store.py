"""The crosswalk as versioned snapshots, with lookups, upserts and corrections as joins.

A snapshot is six tables. A new version is written beside the old one and becomes current when
its number is put into the pointer, so readers see all of a change or none of it. Missing
columns of older versions are read as null.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, fields, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.functions import kinds as K
from keyloom.operators.resolve import ENTITIES, NODES, PHONES, Clusters, anchor

NAMES = "name_norm string, qualifier string, canonical_id string, source string"
CANDIDATES = "array<struct<canonical_id: string, anchor: string, name: string>>"
CARDINALITY = f"name_norm string, qualifier_set string, candidates {CANDIDATES}, status string, canonical_id string"
RESOLUTIONS = "seq long, status_tag string, reason_tag string, matched_via string, confidence double, input_desc string"


@dataclass
class Snapshot:
    entities: DataFrame
    nodes: DataFrame
    phone_edges: DataFrame
    name_index: DataFrame
    name_cardinality: DataFrame
    resolutions: DataFrame

    @property
    def clusters(self) -> Clusters:
        return Clusters(self.entities, self.nodes, self.phone_edges, self.resolutions)

    def with_clusters(self, c: Clusters) -> Snapshot:
        return replace(self, entities=c.entities, nodes=c.nodes, phone_edges=c.phone_edges)


SCHEMAS = {"entities": ENTITIES, "nodes": NODES, "phone_edges": PHONES, "name_index": NAMES, "name_cardinality": CARDINALITY, "resolutions": RESOLUTIONS}


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(**{k: spark.createDataFrame([], s) for k, s in SCHEMAS.items()})


class Conflict(RuntimeError):
    """Another writer published on top of the same version."""


class SnapshotStore:
    """Snapshots below ``path`` (any Hadoop file system).

    Each version is a folder with a name of its own; the marker ``current-N`` says which one is version N, and which
    batch of each stream it ends with. A marker is created only if it does not exist, so of two writers that
    build on one version the second gets a :class:`Conflict`, and neither touches the other's files. A marker
    without content belongs to a writer that has not ended; readers go on with the version before it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._base: int | None = None

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))

    def _marker(self, version: int) -> dict | None:
        stream = self._fs.open(self._path(f"{self.path}/current-{version}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _current(self) -> tuple[int, dict]:
        for v in reversed(self._numbers()):
            if marker := self._marker(v):
                return v, marker
        return 0, {"folder": None, "batches": {}}

    def version(self) -> int:
        """The current version; 0 before the first."""
        return self._current()[0]

    def last_batch(self, stream: str) -> int:
        """The last batch of a stream that the current version holds; -1 before the first."""
        return self._current()[1]["batches"].get(stream, -1)

    def read(self) -> Snapshot:
        """The current version; a later :meth:`publish` builds on it."""
        self._base, marker = self._current()
        if not self._base:
            return empty(self.spark)
        out = {}
        for name, ddl in SCHEMAS.items():
            want = self.spark.createDataFrame([], ddl)
            got = self.spark.read.parquet(f"{self.path}/{marker['folder']}/{name}")
            out[name] = want.unionByName(got, allowMissingColumns=True).select(*want.columns)
        return Snapshot(**out)

    def publish(self, snapshot: Snapshot, *, stream: str | None = None, batch: int | None = None) -> int:
        """Writes the version after the one last read (or the current one) and makes it current.

        With ``stream`` and ``batch`` the version records that it holds this batch.
        """
        base, marker = self._current()
        if self._base is not None and self._base != base:
            raise Conflict(f"version {base} was published after version {self._base} had been read")
        v, folder = base + 1, f"version-{uuid.uuid4().hex}"
        for f in fields(Snapshot):
            getattr(snapshot, f.name).write.parquet(f"{self.path}/{folder}/{f.name}")
        batches = marker["batches"] | ({stream: batch} if stream is not None else {})
        try:
            out = self._fs.create(self._path(f"{self.path}/current-{v}"), False)
        except Py4JJavaError as e:
            raise Conflict(f"version {v} was published by someone else") from e
        try:
            out.write(bytearray(json.dumps({"folder": folder, "batches": batches}).encode()))
        finally:
            out.close()
        self._base = v
        return v


# ---- lookups ------------------------------------------------------------------------------------


def find(keys: DataFrame, s: Snapshot) -> DataFrame:
    """``keys`` (with a column key) plus canonical_id, null where the key is unknown."""
    return keys.join(s.nodes.select("key", "canonical_id"), "key", "left")


def find_many(lists: DataFrame, s: Snapshot, *, keys: str = "keys") -> DataFrame:
    """``lists`` plus found: the canonical ids in the order of the keys, null for misses."""
    each = lists.select(F.col(keys).alias("__keys")).distinct().select("__keys", F.posexplode("__keys").alias("pos", "key"))
    found = find(each, s).groupBy("__keys").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical_id"))).alias("f"))
    return lists.join(found, F.col(keys) == F.col("__keys"), "left").select(*lists.columns, F.coalesce(F.transform("f", lambda x: x["canonical_id"]), F.array().cast("array<string>")).alias("found"))


def find_phone(phones: DataFrame, s: Snapshot) -> DataFrame:
    """``phones`` (phone_key) plus canonical_ids, sorted."""
    own = s.phone_edges.groupBy("phone_key").agg(F.array_sort(F.collect_set("canonical_id")).alias("canonical_ids"))
    return phones.join(own, "phone_key", "left").withColumn("canonical_ids", F.coalesce("canonical_ids", F.array().cast("array<string>")))


def get_entity(ids: DataFrame, s: Snapshot) -> DataFrame:
    return ids.join(s.entities, "canonical_id", "left")


def member_rows(s: Snapshot) -> DataFrame:
    """canonical_id, key, source: strong keys and phones."""
    return s.nodes.select("canonical_id", "key", "source").unionByName(s.phone_edges.select("canonical_id", F.col("phone_key").alias("key"), "source"))


def member_sources(s: Snapshot) -> DataFrame:
    return member_rows(s).groupBy("canonical_id").agg(F.array_sort(F.collect_set(F.struct("key", "source"))).alias("sources"))


def members(s: Snapshot) -> DataFrame:
    """canonical_id, members: distinct (kind, value) in order; keys of unknown kinds are left out."""
    key = F.col("key")
    own = member_rows(s).filter(K.known(K.kind_of(key)))
    return own.groupBy("canonical_id").agg(F.array_sort(F.collect_set(F.struct(K.kind_of(key).alias("kind"), K.value_of(key).alias("value")))).alias("members"))


def strong_key_count(s: Snapshot) -> DataFrame:
    return s.nodes.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("strong_keys"))


def load_entities(ids: DataFrame, s: Snapshot) -> tuple[DataFrame, DataFrame]:
    """(full clusters for the known ids, the unknown ids)."""
    full = ids.join(s.entities, "canonical_id").join(members(s), "canonical_id", "left").join(member_sources(s), "canonical_id", "left")
    full = full.withColumn("status", F.lit("hit")).withColumn("reason", F.lit("direct_lookup")).withColumn("confidence", F.lit(1.0))
    return full, ids.join(s.entities.select("canonical_id"), "canonical_id", "left_anti")


# ---- writes -------------------------------------------------------------------------------------


def attach(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (key, canonical_id, source); where ``new`` has a seq, its last row per key counts.

    The new owner wins, and a new source wins if there is one.
    """
    if "seq" in new.columns:
        new = new.groupBy("key").agg(F.max_by("canonical_id", "seq").alias("canonical_id"), F.max_by("source", F.when(F.col("source").isNotNull(), F.col("seq"))).alias("source"))
    a, b = nodes.alias("a"), new.alias("b")
    return a.join(b, F.col("a.key") == F.col("b.key"), "full").select(
        F.coalesce("b.key", "a.key").alias("key"), F.coalesce("b.canonical_id", "a.canonical_id").alias("canonical_id"), F.coalesce("b.source", "a.source").alias("source")
    )


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` plus the rows of ``new`` whose key is not there yet; first of equal new ones by seq or content."""
    order = ["seq"] if "seq" in new.columns else [c for c in new.columns if c not in key] or key
    first = new.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__n = 1").select(*old.columns)
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def set_anchors(entities: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` has canonical_id and anchor."""
    return entities.join(new.select("canonical_id", F.col("anchor").alias("__a")), "canonical_id", "left").withColumn("anchor", F.coalesce("__a", "anchor")).drop("__a")


def enrich(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Fills null types and names from ``new`` (canonical_id, entity_type, name); never overwrites."""
    own = new.select("canonical_id", F.col("entity_type").alias("__t"), F.col("name").alias("__n"))
    return entities.join(own, "canonical_id", "left").select("canonical_id", "anchor", F.coalesce("entity_type", "__t").alias("entity_type"), F.coalesce("name", "__n").alias("name"))


def index_names(name_index: DataFrame, new: DataFrame) -> DataFrame:
    """``new``: name_norm, qualifiers (array), canonical_id, source. One row for the bare name and one for each qualifier."""
    rows = new.filter(F.coalesce(F.col("name_norm"), F.lit("")) != "").select(
        "name_norm", F.explode(F.concat(F.array(F.lit("")), F.coalesce("qualifiers", F.array().cast("array<string>")))).alias("qualifier"), "canonical_id", "source"
    )
    return insert_or_ignore(name_index, rows, ["name_norm", "qualifier", "canonical_id"])


def record_cardinality(memory: DataFrame, log: DataFrame) -> DataFrame:
    """Last writer wins. ``log``: seq, name_norm, qualifiers, candidates (null for a unique one), canonical_id."""
    rows = log.select("seq", "name_norm", F.array_join("qualifiers", "\n").alias("qualifier_set"), "candidates", "canonical_id")
    last = rows.groupBy("name_norm", "qualifier_set").agg(F.max_by(F.struct("candidates", "canonical_id"), "seq").alias("r"))
    unique = F.col("r.candidates").isNull()
    new = last.select(
        "name_norm", "qualifier_set", F.coalesce("r.candidates", F.array().cast(CANDIDATES)).alias("candidates"), F.when(unique, "unique").otherwise("ambiguous").alias("status"), F.when(unique, F.col("r.canonical_id")).alias("canonical_id")
    )
    return memory.join(new.select("name_norm", "qualifier_set"), ["name_norm", "qualifier_set"], "left_anti").unionByName(new)


def cardinality(memory: DataFrame, entities: DataFrame) -> DataFrame:
    """The memory as it may be read: no status means ambiguous, and a unique row needs a living entity."""
    live = entities.select("canonical_id", F.lit(True).alias("__live"))
    own = memory.withColumn("status", F.coalesce("status", F.lit("ambiguous"))).join(live, "canonical_id", "left")
    return own.filter("status <> 'unique' or __live").drop("__live")


def log_resolutions(resolutions: DataFrame, outcomes: DataFrame, description: Column) -> DataFrame:
    """Appends outcomes (seq, status, reason, matched_via, confidence) of user requests."""
    new = outcomes.select(
        "seq", F.col("status").alias("status_tag"), F.col("reason").alias("reason_tag"), F.array_join("matched_via", ",").alias("matched_via"), F.col("confidence").cast("double").alias("confidence"), description.alias("input_desc")
    )
    return resolutions.unionByName(new)


def repointed(s: Snapshot, moves: DataFrame) -> Snapshot:
    """All tables after merges. ``moves``: loser, winner; winners are no losers.

    Candidates remembered for ambiguous names follow too, so none names an entity that is gone.
    """
    m = moves.select(F.col("loser").alias("__l"), F.col("winner").alias("__w"))

    def to(df: DataFrame) -> DataFrame:
        return df.join(m, F.col("canonical_id") == F.col("__l"), "left").withColumn("canonical_id", F.coalesce("__w", "canonical_id")).drop("__l", "__w")

    def once(df: DataFrame, key: list[str]) -> DataFrame:
        rest = [c for c in df.columns if c not in key]
        return df.groupBy(*key).agg(*[F.min(c).alias(c) for c in rest]).select(*df.columns) if rest else df.distinct()

    own = s.name_cardinality
    each = own.select("name_norm", "qualifier_set", F.posexplode("candidates").alias("pos", "c")).select("name_norm", "qualifier_set", "pos", F.col("c.canonical_id").alias("canonical_id"))
    kept = to(each).join(s.entities.select("canonical_id", "anchor", "name"), "canonical_id", "left").groupBy("name_norm", "qualifier_set", "canonical_id", "anchor", "name").agg(F.min("pos").alias("pos"))
    lists = kept.groupBy("name_norm", "qualifier_set").agg(F.array_sort(F.collect_list(F.struct("pos", "canonical_id", "anchor", "name"))).alias("l"))
    lists = lists.select("name_norm", "qualifier_set", F.transform("l", lambda x: F.struct(x["canonical_id"].alias("canonical_id"), x["anchor"].alias("anchor"), x["name"].alias("name"))).alias("__c"))
    memory = to(own).join(lists, ["name_norm", "qualifier_set"], "left").withColumn("candidates", F.coalesce("__c", "candidates")).select(*own.columns)
    return Snapshot(
        s.entities.join(m.select(F.col("__l").alias("canonical_id")), "canonical_id", "left_anti"),
        to(s.nodes).select(*s.nodes.columns),
        once(to(s.phone_edges).select(*s.phone_edges.columns), ["phone_key", "canonical_id"]),
        once(to(s.name_index).select(*s.name_index.columns), ["name_norm", "qualifier", "canonical_id"]),
        memory,
        s.resolutions,
    )


def reanchored(s: Snapshot, ids: DataFrame | None = None) -> Snapshot:
    """Anchors computed anew from the strong keys, for all or some entities; without keys they stay."""
    nodes = s.nodes if ids is None else s.nodes.join(ids, "canonical_id", "left_semi")
    return replace(s, entities=set_anchors(s.entities, nodes.groupBy("canonical_id").agg(anchor().alias("anchor"))))


def violations(s: Snapshot) -> DataFrame:
    """What breaks the invariants: keys with two owners, owners that do not exist, anchors that are not owned."""
    twice = s.nodes.groupBy("key").count().filter("count > 1").select(F.lit("key with two owners").alias("what"), F.col("key").alias("which"))
    orphan = member_rows(s).join(s.entities, "canonical_id", "left_anti").select(F.lit("owner does not exist").alias("what"), F.col("key").alias("which"))
    named = s.entities.join(s.nodes.select("canonical_id", F.col("key").alias("anchor")), ["canonical_id", "anchor"], "left_anti").select(F.lit("anchor not owned").alias("what"), F.col("canonical_id").alias("which"))
    return twice.unionByName(orphan).unionByName(named)


def with_columns(spark: SparkSession, df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with the columns of a schema, in its order; missing ones are null."""
    want = StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
