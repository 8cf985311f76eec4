"""Records to entities, for whole tables at once.

Two modes:

* ``set``: order-free as far as identity goes. Entities are the connected components of records
  and identity keys; a domain belongs to its first claimant; phones only corroborate. Pure joins
  and aggregations.
* ``exact``: the result of committing the records one after another in the order of ``seq``,
  on top of an earlier snapshot. Records interact only through strong keys, so each
  component of records, strong keys and earlier clusters is folded by itself, in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions import kinds as K
from keyloom.functions.scalars import canonical_id, confidence
from keyloom.operators.components import connected_components
from keyloom.plans.workspace import arrow_map, stored
from keyloom.sources.records import Batch

ENTITIES = "canonical_id string, anchor string, entity_type string, name string"
NODES = "key string, canonical_id string, source string"
PHONES = "phone_key string, canonical_id string, source string"


def anchor(key: str = "key") -> Column:
    """Aggregate: the best key of a cluster. Identity before affiliation, then rank, then the key itself."""
    kind = K.kind_of(F.col(key))
    return F.min_by(key, F.struct(F.when(K.grain(kind) == K.IDENTITY, 0).otherwise(1), K.rank(kind), F.col(key)))


def distinct_ids(entities: DataFrame, cluster: str, anchor_col: str = "anchor") -> DataFrame:
    """``entities`` with canonical_id; ids that two anchors share get _1, _2, ... in the order of the anchors.

    Ids have 32 bits, so large tables do have collisions; silently joining the clusters would be wrong.
    """
    own = entities.withColumn("__id", canonical_id(F.col(anchor_col)))
    n = F.row_number().over(Window.partitionBy("__id").orderBy(anchor_col, cluster)) - 1
    return own.withColumn("canonical_id", F.when(n == 0, F.col("__id")).otherwise(F.concat_ws("_", "__id", n))).drop("__id")


@dataclass
class Clusters:
    entities: DataFrame
    nodes: DataFrame
    phone_edges: DataFrame
    outcomes: DataFrame


def resolve_set(batch: Batch) -> Clusters:
    """Set mode. ``outcomes`` has seq, canonical_id, status, reason for every record.

    Records without a strong key are unresolved: by the number of entities that share their
    phones they are needs_stronger_identifier, phone_only or ambiguous_among_n.
    """
    ids = stored(batch.ids, "ids")
    identity = ids.filter(F.col("grain") == K.IDENTITY)
    least = identity.groupBy("seq").agg(F.min("key").alias("least"))
    labels = connected_components(identity.join(least, "seq").select("key", "least"), "key", "least")
    identity_cluster = least.join(labels, F.col("least") == F.col("node"), "left").select("seq", F.coalesce("component", "least").alias("cluster"))
    # domains: the first claimant owns; where that has no identity, its domains are a cluster of their own
    affiliated = ids.filter(F.col("grain") == K.AFFILIATION).join(identity_cluster, "seq", "left")
    owners = affiliated.groupBy("key").agg(F.min_by(F.struct("seq", "cluster"), F.struct("seq", "pos")).alias("o")).select("key", F.col("o.seq").alias("owner_seq"), F.col("o.cluster").alias("owner"))
    brands = affiliated.filter("cluster is null").join(owners.filter("owner is null"), "key")
    brand_least = brands.groupBy("seq").agg(F.min("key").alias("least"))
    brand_labels = connected_components(brands.join(brand_least, "seq").select("key", "least"), "key", "least")
    brand_of = brand_least.join(brand_labels, F.col("least") == F.col("node"), "left").select("seq", F.coalesce("component", "least").alias("cluster"))
    owned = owners.join(brand_labels, F.col("key") == F.col("node"), "left").select("key", F.coalesce("owner", "component", "key").alias("cluster"))
    # a record without identity keys belongs to its brand, else to the owner of its first domain
    first_owner = affiliated.filter("cluster is null").select("seq", "pos", "key").join(owned, "key").groupBy("seq").agg(F.min_by("cluster", "pos").alias("other"))
    loose = first_owner.join(brand_of, "seq", "left").select("seq", F.coalesce("cluster", "other").alias("cluster"))
    record_cluster = stored(identity_cluster.unionByName(loose), "record-clusters")
    keys = identity.select("seq", "key").join(record_cluster, "seq").select("key", "cluster").distinct().unionByName(owned)
    names = batch.records.join(record_cluster, "seq").groupBy("cluster").agg(
        F.min_by("entity_type", F.when(F.col("entity_type").isNotNull(), F.col("seq"))).alias("entity_type"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name")
    )
    sources = identity.unionByName(ids.filter(F.col("grain") == K.AFFILIATION)).join(batch.records.select("seq", "source"), "seq").groupBy("key").agg(F.min_by("source", "seq").alias("source"))
    entities = stored(distinct_ids(keys.groupBy("cluster").agg(anchor().alias("anchor")), "cluster").join(names, "cluster", "left"), "entities")
    cid = entities.select("cluster", "canonical_id")
    phones = ids.filter("not strong").join(record_cluster, "seq").join(cid, "cluster").join(batch.records.select("seq", "source"), "seq")
    edges = stored(phones.groupBy(F.col("key").alias("phone_key"), "canonical_id").agg(F.min_by("source", "seq").alias("source")), "phones")
    return Clusters(
        entities.select("canonical_id", "anchor", "entity_type", "name"),
        keys.join(cid, "cluster").join(sources, "key", "left").select("key", "canonical_id", "source"),
        edges,
        _set_outcomes(batch, ids, record_cluster.join(entities, "cluster").select("seq", "cluster", "canonical_id", "anchor"), edges),
    )


def _set_outcomes(batch: Batch, ids: DataFrame, placed: DataFrame, edges: DataFrame) -> DataFrame:
    first = placed.groupBy("canonical_id").agg(F.min("seq").alias("first"))
    own = placed.join(first, "canonical_id")
    reason = F.when(F.col("seq") > F.col("first"), "exact_strong_key").when(K.rank(K.kind_of(F.col("anchor"))) < K.UNRANKED, "new_public_anchor").otherwise("synthetic_strong_key")
    hit = own.select("seq", "canonical_id", F.when(F.col("seq") > F.col("first"), "hit").otherwise("new").alias("status"), reason.alias("reason"))
    loose = batch.records.select("seq").join(placed.select("seq"), "seq", "left_anti")
    found = loose.join(ids.filter("not strong").select("seq", "key"), "seq", "left").join(edges.select(F.col("phone_key").alias("key"), F.col("canonical_id").alias("candidate")), "key", "left")
    refused = found.groupBy("seq").agg(F.count_distinct("candidate").alias("n")).select("seq", F.lit(None).cast("string").alias("canonical_id"), F.lit("unresolved").alias("status"), refusal(F.col("n")).alias("reason"))
    every = hit.unionByName(refused)
    return every.withColumn("confidence", confidence(F.col("reason")))


def refusal(candidates: Column) -> Column:
    """The reason of a record without a strong key, by its number of candidates."""
    return F.when(candidates == 0, "needs_stronger_identifier").when(candidates == 1, "phone_only").otherwise("ambiguous_among_n")


# ---- exact mode -------------------------------------------------------------------------------

_OUT = (
    "tag string, seq long, key string, canonical_id string, anchor string, entity_type string, name string, source string, "
    "status string, reason string, matched_via array<string>, new_edges long, until long, harvested long, component string"
)
_ARROW = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
_CARRIED = "array<struct<key: string, before: boolean>>"
ROWS = 20_000  # of one batch that a fold gives
BEFORE = -(1 << 62)  # the "seq" of what an earlier snapshot holds
OPEN = (1 << 62)


@dataclass
class _Entity:
    anchor: str
    entity_type: str | None
    name: str | None
    keys: dict[str, str | None] = field(default_factory=dict)
    phones: dict[str, tuple[str | None, int]] = field(default_factory=dict)
    since: int = BEFORE
    best: tuple[int, int, str] | None = None  # of its keys in the order of anchors; None: not known


class Fold:
    """One component, committed record by record. ``grain`` and ``rank`` look a key's kind up."""

    def __init__(self, grain: dict[str, str], rank: dict[str, int]):
        self.grain, self.rank = grain, rank
        self.owner: dict[str, str] = {}
        self.entities: dict[str, _Entity] = {}
        self.rows: list[tuple] = []

    def _kind(self, key: str) -> str:
        return key.split(":", 1)[0]

    def _is(self, key: str, grain: str) -> bool:
        return self.grain.get(self._kind(key)) == grain

    def _order(self, key: str) -> tuple[int, int, str]:
        kind = self._kind(key)
        return (0 if self._is(key, K.IDENTITY) else 1, K.LOCAL_RANK if kind == "local" else self.rank.get(kind, K.UNRANKED), key)

    def _names_others(self, a: str, b: str) -> bool:
        """Both have identity keys and none in common."""
        x, y = ({k for k in self.entities[c].keys if self._is(k, K.IDENTITY)} for c in (a, b))
        return bool(x) and bool(y) and not x & y

    def _best(self, cids: list[str]) -> str:
        def place(c: str) -> tuple[int, str]:
            kind = self._kind(self.entities[c].anchor)
            return (K.LOCAL_RANK if kind == "local" else self.rank.get(kind, K.UNRANKED), c)

        return min(cids, key=place)

    def _version(self, cid: str, until: int) -> None:
        e = self.entities[cid]
        if e.since != until:
            self.rows.append(("version", e.since, None, cid, e.anchor, e.entity_type, e.name, None, None, None, None, None, until, None))
        e.since = until

    def _merge(self, into: str, gone: str, seq: int) -> None:
        self._version(gone, seq)
        lost, kept = self.entities.pop(gone), self.entities[into]
        for k, s in lost.keys.items():
            self.owner[k] = into
            kept.keys[k] = s
        kept.best = None
        for p, (s, since) in lost.phones.items():
            if since != seq:
                self.rows.append(("phone", since, p, gone, None, None, None, s, None, None, None, None, seq, None))
            kept.phones.setdefault(p, (s, seq))
        self.rows.append(("merge", seq, None, gone, into, None, None, None, None, None, None, None, None, None))

    def restore(self, cid: str, anchor: str, entity_type: str | None, name: str | None) -> None:
        self.entities[cid] = _Entity(anchor, entity_type, name)

    def restore_key(self, key: str, cid: str, source: str | None) -> None:
        self.owner[key] = cid
        self.entities[cid].keys[key] = source
        self.entities[cid].best = None

    def restore_phone(self, phone: str, cid: str, source: str | None) -> None:
        self.entities[cid].phones[phone] = (source, BEFORE)

    def commit(self, seq: int, source: str | None, entity_type: str | None, name: str | None, strong: list[str], phones: list[tuple[str, bool]], mint, harvested: int | None = None) -> None:
        """``phones``: (key, did any entity have it before this record?)."""
        ident = [k for k in strong if self._is(k, K.IDENTITY)]
        affil = [k for k in strong if not self._is(k, K.IDENTITY)]
        hits = list(dict.fromkeys(self.owner[k] for k in ident if k in self.owner))
        around = list(dict.fromkeys(self.owner[k] for k in affil if k in self.owner))
        status = "hit"
        if hits:
            cid = self._best(hits)
            for c in hits:
                if c != cid:
                    self._merge(cid, c, seq)
        elif around and not ident:
            cid = self._best(around)
        else:
            anchor = min(strong, key=self._order)
            cid, status, around = mint(anchor, self.entities), "new", []
            self.entities[cid] = _Entity(anchor, entity_type, name, since=seq)
        for c in around:
            if c != cid and c in self.entities and not self._names_others(cid, c):
                self._merge(cid, c, seq)
        e, via, new = self.entities[cid], [], 0
        for k in strong:
            owner = self.owner.get(k)
            if owner == cid:
                via.append(self._kind(k))
            elif owner is not None and self._is(k, K.AFFILIATION):
                via.append("domain (shared affiliation; distinct entity)")
            else:
                if owner is not None:
                    del self.entities[owner].keys[k]
                    self.entities[owner].best = None
                self.owner[k] = cid
                e.keys[k] = source
                new += 1
                if e.best is not None:
                    e.best = min(e.best, self._order(k))
        for p, before in phones:
            if p in e.phones:
                via.append("phone (corroborating)")
            else:
                e.phones[p] = (source, seq)
                new += 1
                if before:
                    via.append("phone (corroborating)")
        if e.best is None and e.keys:
            e.best = min(self._order(k) for k in e.keys)
        after = (e.best[2] if e.best is not None else e.anchor, e.entity_type if e.entity_type is not None else entity_type, e.name if e.name is not None else name)
        if after != (e.anchor, e.entity_type, e.name):
            self._version(cid, seq)
            e.anchor, e.entity_type, e.name = after
        if status == "hit":
            reason = "exact_strong_key"
        else:
            reason = "new_public_anchor" if any(self.rank.get(self._kind(k), K.UNRANKED) < K.UNRANKED for k in e.keys) else "synthetic_strong_key"
        self.rows.append(("outcome", seq, None, cid, e.anchor, e.entity_type, e.name, None, status, reason, list(dict.fromkeys(via)), new, None, harvested))

    def taken(self) -> list[tuple]:
        """The rows since the last call."""
        out, self.rows = self.rows, []
        return out

    def result(self) -> Iterator[tuple]:
        """The rows not yet taken, then what there is at the end."""
        yield from self.taken()
        for cid, e in self.entities.items():
            yield "entity", None, None, cid, e.anchor, e.entity_type, e.name, None, None, None, None, None, None, None
            yield "version", e.since, None, cid, e.anchor, e.entity_type, e.name, None, None, None, None, None, OPEN, None
            for k, s in e.keys.items():
                yield "node", None, k, cid, None, None, None, s, None, None, None, None, None, None
            for p, (s, since) in e.phones.items():
                yield "phone", since, p, cid, None, None, None, s, None, None, None, None, OPEN, None


def _mint(anchor: str, taken: dict) -> str:
    h = 2166136261
    for b in anchor.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    cid, n = f"cx_{h:08x}", 0
    while (cid if not n else f"{cid}_{n}") in taken:
        n += 1
    return cid if not n else f"{cid}_{n}"


def _apart(folded: DataFrame, earlier: DataFrame | None, least: DataFrame | None = None) -> DataFrame:
    """Ids that two components minted alike get _c1, _c2, ... in the order of their ``least`` keys (component, least); ids of the earlier snapshot stay."""
    ids = folded.filter("tag <> 'component' and canonical_id is not null").select("component", "canonical_id", F.lit(1).alias("fresh"))
    if earlier is not None:
        ids = ids.unionByName(earlier.select("component", "canonical_id", F.lit(0).alias("fresh")))
    each = ids.groupBy("canonical_id", "component").agg(F.min("fresh").alias("fresh"))
    many = each.groupBy("canonical_id").agg(F.collect_list(F.struct("fresh", "component")).alias("c")).filter("size(c) > 1").select("canonical_id", F.explode("c").alias("c")).select("canonical_id", "c.fresh", "c.component")
    many = stored(many, "alike")
    if many.isEmpty():
        return folded
    many = many.join(least, "component", "left") if least is not None else many.withColumn("least", F.col("component"))
    n = F.row_number().over(Window.partitionBy("canonical_id").orderBy("fresh", "least", "component")) - 1
    renamed = many.withColumn("n", n).filter("n > 0").select("component", "canonical_id", F.concat(F.col("canonical_id"), F.lit("_c"), F.col("n").cast("string")).alias("renamed"))
    return folded.join(stored(renamed, "renamed"), ["component", "canonical_id"], "left").withColumn("canonical_id", F.coalesce("renamed", "canonical_id")).drop("renamed")


def _folds(grain: dict[str, str], rank: dict[str, int]):
    """Folds the components of a task one after another; the rows of one come together, by step and seq."""
    names, kinds = zip(*(c.split(" ") for c in _OUT.split(", ")), strict=True)
    schema = pa.schema([(n, _ARROW[k]) for n, k in zip(names, kinds, strict=True)])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        fold, current, least, held = Fold(grain, rank), None, None, []

        def ended():
            if current is not None:
                yield from (r + (current,) for r in fold.result())
                yield ("component", None, least) + (None,) * 11 + (current,)

        for batch in batches:
            for component, step, seq, keys, phones, source, entity_type, name, harvested, cid, anchor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if component != current:
                    for r in ended():
                        held.append(r)
                        if len(held) >= ROWS:
                            yield packed(held)
                            held = []
                    fold, current, least = Fold(grain, rank), component, None
                for k in keys or ():
                    least = k if least is None or k < least else least
                if step == 0:
                    fold.restore(cid, anchor, entity_type, name)
                elif step == 1:
                    fold.restore_key(keys[0], cid, source)
                elif step == 2:
                    fold.restore_phone(phones[0]["key"], cid, source)
                else:
                    fold.commit(seq, source, entity_type, name, keys, [(p["key"], p["before"]) for p in phones or ()], _mint, harvested)
                    held += [r + (current,) for r in fold.taken()]
                    if len(held) >= ROWS:
                        yield packed(held)
                        held = []
        for r in ended():
            held.append(r)
            if len(held) >= ROWS:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _counted(loose: DataFrame, phones: DataFrame, spans: DataFrame, buckets: int) -> DataFrame:
    """seq, n: how many entities the phones of each record in ``loose`` led to when it arrived.

    ``spans``: phone_key, canonical_id, anchor, name, since, until. For a record with one phone n is what began before it less what
    ended before it, a running sum dealt over ranges of time; several phones may lead to one entity, so there the
    entities themselves are met and counted.
    """
    asked = loose.select("seq").join(phones.select("seq", "key").distinct(), "seq")
    several = asked.groupBy("seq").agg(F.count(F.lit(1)).alias("k"), F.min("key").alias("key"))
    one = several.filter("k = 1").select("seq", "key")
    own = spans.select(F.col("phone_key").alias("key"), "canonical_id", "anchor", "name", "since", "until").distinct()
    none = F.lit(None).cast("long")
    # an entity counts from after since to until; a record asks before what begins or has ended by its own seq
    events = own.select("key", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("step")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("key", "e.at", "e.step", none.alias("seq"))
    events = stored(events.unionByName(one.select("key", F.col("seq").alias("at"), F.lit(0).alias("step"), "seq")), "spans")
    bounds = sorted(set(events.filter(f"at > {BEFORE} and at < {OPEN}").approxQuantile("at", [i / buckets for i in range(1, buckets)], 0.005))) if buckets > 1 else []
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col("at") > F.lit(b)).cast("int")
    dealt = events.withColumn("bucket", bucket)
    until_it = Window.partitionBy("key", "bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("step").over(until_it), F.lit(0))).filter("seq is not null").select("key", "bucket", "seq", "inside")
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("key", "bucket").agg(F.sum("step").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    single = inside.join(sums, ["key", "bucket"]).select("seq", (F.col("inside") + F.col("before")).cast("long").alias("n"))
    met = asked.join(several.filter("k > 1").select("seq"), "seq").join(own, "key").filter("since < seq and until >= seq")
    return single.unionByName(met.select("seq", "canonical_id", "anchor", "name").distinct().groupBy("seq").agg(F.count(F.lit(1)).alias("n")))


def resolve_exact(batch: Batch, snapshot: Clusters | None = None, *, listed: bool = True) -> Clusters:
    """Exact mode: as if each record were committed in the order of ``seq``.

    ``outcomes`` has seq, canonical_id, anchor, entity_type, name, status, reason, matched_via,
    new_edges, harvested, candidates (canonical_id, anchor, name) and confidence for every
    record; without ``listed`` n_candidates in place of candidates, which are then counted and never listed where a record has
    one phone (lists grow with the records times the entities of a phone). Ids that collide get a suffix; a component is one task, so a
    component that holds most of a table is better served by set mode.
    """
    spark = batch.ids.sparkSession
    null = lambda t: F.lit(None).cast(t)
    ids = stored(batch.ids, "ids")
    strong = ids.filter("strong")

    # keys that only one record or earlier cluster has connect nothing: components are those of the others
    held = strong.select("seq", null("string").alias("canonical_id"), "key")
    if snapshot:
        held = held.unionByName(snapshot.nodes.select(null("long").alias("seq"), "canonical_id", "key"))
    shared = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    met = stored(held.join(shared, "key").groupBy("seq", "canonical_id").agg(F.min("key").alias("least"), F.collect_set("key").alias("keys")), "met")
    labels = stored(connected_components(met.filter("size(keys) > 1").select("least", F.explode("keys").alias("key")), "key", "least"), "labels")
    label = lambda df, by: df.join(met.filter(f"{by} is not null").select(by, "least"), by, "left").join(labels, F.col("least") == F.col("node"), "left").withColumn("component", F.coalesce("component", "least", "first")).drop("least", "node", "first")

    phones = ids.filter("not strong").join(strong.select("seq").distinct(), "seq", "left_semi").select("seq", "pos", "key")
    # an earlier phone edge of any entity: in the snapshot, or from an earlier record with a strong key
    known = phones.groupBy("key").agg(F.min("seq").alias("from"))
    if snapshot:
        known = known.join(snapshot.phone_edges.select(F.col("phone_key").alias("key")).distinct().withColumn("known", F.lit(True)), "key", "left").withColumn("from", F.when(F.col("known"), BEFORE).otherwise(F.col("from"))).drop("known")
    phones = phones.join(known, "key").groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key", (F.col("seq") > F.col("from")).alias("before")))), lambda p: F.struct(p["key"].alias("key"), p["before"].alias("before"))).alias("phones"))
    own = strong.groupBy("seq").agg(F.min("key").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda k: k["key"]).alias("keys"))
    meta = batch.records.select("seq", "source", "entity_type", "name", "harvested")
    rows = label(own.join(meta, "seq").join(phones, "seq", "left"), "seq").select("component", F.lit(3).alias("step"), "seq", "keys", "phones", "source", "entity_type", "name", "harvested", null("string").alias("canonical_id"), null("string").alias("anchor"))
    cluster_of = None
    if snapshot:
        rows = stored(rows, "records")
        touched = rows.select("component").distinct()
        cluster_of = stored(label(snapshot.nodes.groupBy("canonical_id").agg(F.min("key").alias("first")), "canonical_id").select("canonical_id", "component"), "earlier")
        live = cluster_of.join(touched, "component", "left_semi")
        now = lambda df, step, **c: df.join(live, "canonical_id").select(
            "component", F.lit(step).alias("step"), F.lit(BEFORE).alias("seq"), c.get("keys", null("array<string>")).alias("keys"), c.get("phones", null(_CARRIED)).alias("phones"), c.get("source", null("string")).alias("source"),
            c.get("t", null("string")).alias("entity_type"), c.get("n", null("string")).alias("name"), null("long").alias("harvested"), "canonical_id", c.get("a", null("string")).alias("anchor"),
        )
        rows = rows.unionByName(now(snapshot.entities, 0, t=F.col("entity_type"), n=F.col("name"), a=F.col("anchor")))
        rows = rows.unionByName(now(snapshot.nodes, 1, keys=F.array("key"), source=F.col("source")))
        rows = rows.unionByName(now(snapshot.phone_edges, 2, phones=F.array(F.struct(F.col("phone_key").alias("key"), null("boolean").alias("before"))).cast(_CARRIED), source=F.col("source")))

    grain = {k.tag: k.grain for k in K.KINDS.values()}
    rank = {k.tag: K.UNRANKED if k.rank is None else k.rank for k in K.KINDS.values()}
    # a number of partitions of our own: small rows of many components cost Python time, so they are not to be put into one task
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component").sortWithinPartitions("component", "step", "seq")
    folded = stored(arrow_map(dealt, _folds(grain, rank), _OUT), "folded")
    folded = _apart(folded, cluster_of, folded.filter("tag = 'component'").select("component", F.col("key").alias("least")))

    entities = folded.filter("tag = 'entity'").select("canonical_id", "anchor", "entity_type", "name")
    nodes = folded.filter("tag = 'node'").select("key", "canonical_id", "source")
    spans = folded.filter("tag = 'phone'").select(F.col("key").alias("phone_key"), "canonical_id", "source", F.col("seq").alias("since"), "until")
    versions = folded.filter("tag = 'version'").select("canonical_id", "anchor", "name", F.col("seq").alias("since"), "until")
    if snapshot:
        rest = cluster_of.join(touched, "component", "left_anti").select("canonical_id")
        keep = lambda df: df.join(rest, "canonical_id", "left_semi")
        entities = entities.unionByName(keep(snapshot.entities).select("canonical_id", "anchor", "entity_type", "name"))
        nodes = nodes.unionByName(keep(snapshot.nodes).select("key", "canonical_id", "source"))
        spans = spans.unionByName(keep(snapshot.phone_edges).select("phone_key", "canonical_id", "source", F.lit(BEFORE).alias("since"), F.lit(OPEN).alias("until")))
        versions = versions.unionByName(keep(snapshot.entities).select("canonical_id", "anchor", "name", F.lit(BEFORE).alias("since"), F.lit(OPEN).alias("until")))

    # records without a strong key: the entities that their phones led to when they arrived
    loose = batch.records.join(strong.select("seq").distinct(), "seq", "left_anti").select("seq", "entity_type", "name", "harvested")
    weak = ids.filter("not strong").select("seq", "key")
    none = F.array().cast("array<struct<canonical_id: string, anchor: string, name: string>>")
    v = versions.select(F.col("canonical_id").alias("c"), "anchor", "name", F.col("since").alias("from"), F.col("until").alias("to"))
    if listed:
        found = loose.join(weak, "seq").join(spans, (F.col("key") == F.col("phone_key")) & (F.col("since") < F.col("seq")) & (F.col("until") >= F.col("seq"))).select("seq", "canonical_id").distinct()
        found = found.join(v, (F.col("canonical_id") == F.col("c")) & (F.col("from") < F.col("seq")) & (F.col("to") >= F.col("seq"))).groupBy("seq").agg(F.sort_array(F.collect_set(F.struct("canonical_id", "anchor", "name"))).alias("candidates"))
        tell, n = F.coalesce("candidates", none).alias("candidates"), F.size(F.coalesce("candidates", none))
        empty = none.alias("candidates")
    else:
        both = spans.join(v, (F.col("canonical_id") == F.col("c")) & (F.col("from") < F.col("until")) & (F.col("since") < F.col("to")))
        both = both.select("phone_key", "canonical_id", "anchor", "name", F.greatest("since", "from").alias("since"), F.least("until", "to").alias("until"))
        found = _counted(loose, weak, both, 16).select("seq", F.col("n").alias("n_candidates"))
        n = F.coalesce("n_candidates", F.lit(0).cast("long"))
        tell, empty = n.alias("n_candidates"), F.lit(0).cast("long").alias("n_candidates")
    refused = loose.join(found, "seq", "left").select(
        "seq", null("string").alias("canonical_id"), F.lit("").alias("anchor"), "entity_type", "name", F.lit("unresolved").alias("status"), refusal(n).alias("reason"),
        F.array().cast("array<string>").alias("matched_via"), F.lit(0).cast("long").alias("new_edges"), "harvested", tell,
    )
    done = folded.filter("tag = 'outcome'").select("seq", "canonical_id", "anchor", "entity_type", "name", "status", "reason", "matched_via", "new_edges", "harvested", empty)
    outcomes = done.unionByName(refused).withColumn("confidence", confidence(F.col("reason")))
    return Clusters(entities, nodes, spans.filter(F.col("until") == OPEN).select("phone_key", "canonical_id", "source"), outcomes)
