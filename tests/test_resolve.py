"""Resolution against a plain fold that commits one record after another over dictionaries."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.functions import kinds as K
from keyloom.operators.components import connected_components
from keyloom.operators.resolve import resolve_exact, resolve_set
from keyloom.plans import store
from keyloom.sources.records import from_ids

IDENTITY = {k.tag for k in K.KINDS.values() if k.grain == K.IDENTITY}


def order(key):
    kind = key.split(":")[0]
    k = K.KINDS[kind]
    return (k.grain != K.IDENTITY, K.UNRANKED if k.rank is None else k.rank, key)


def fnv(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return f"cx_{h:08x}"


def plain(stream, owner=None, anchors=None):
    """stream: lists of keys. Final owners, anchors and the outcome of each record."""
    owner, anchors, phones, out = dict(owner or {}), dict(anchors or {}), {}, []
    ident = lambda c: {k for k, o in owner.items() if o == c and k.split(":")[0] in IDENTITY}
    rank = lambda c: (order(anchors[c])[1], c)

    def merge(w, x):
        for k in [k for k, o in owner.items() if o == x]:
            owner[k] = w
        for p in phones.values():
            if x in p:
                p.discard(x)
                p.add(w)
        del anchors[x]

    for keys in stream:
        strong = [k for k in keys if not k.startswith("phone:")]
        tel = [k for k in keys if k.startswith("phone:")]
        if not strong:
            n = len(set().union(*[phones.get(p, set()) for p in tel])) if tel else 0
            out.append(("unresolved", ["needs_stronger_identifier", "phone_only"][n] if n < 2 else "ambiguous_among_n", 0))
            continue
        mine = [k for k in strong if k.split(":")[0] in IDENTITY]
        hits = list(dict.fromkeys(owner[k] for k in mine if k in owner))
        near = list(dict.fromkeys(owner[k] for k in strong if k not in mine and k in owner))
        status = "hit"
        if hits:
            w = min(hits, key=rank)
            for x in hits:
                if x != w:
                    merge(w, x)
        elif near and not mine:
            w = min(near, key=rank)
        else:
            a = min(strong, key=order)
            w, status, near = fnv(a), "new", []
            anchors[w] = a
        for x in near:
            if x != w and x in anchors and not (ident(w) and ident(x)):
                merge(w, x)
        new = 0
        for k in strong:
            if k not in owner:
                owner[k] = w
                new += 1
        for p in tel:
            if w not in phones.setdefault(p, set()):
                phones[p].add(w)
                new += 1
        anchors[w] = min((k for k, o in owner.items() if o == w), key=order, default=anchors[w])
        out.append((status, "exact_strong_key" if status == "hit" else "new_public_anchor" if any(order(k)[1] < 200 for k, o in owner.items() if o == w) else "synthetic_strong_key", new))
    return owner, anchors, out


def batch(spark, stream, start=0):
    rows = [(start + i, j, k.split(":")[0], k.split(":", 1)[1]) for i, keys in enumerate(stream) for j, k in enumerate(keys)]
    ids = spark.createDataFrame(rows, "seq long, pos int, kind string, value string")
    said = spark.createDataFrame([(start + i, None, None, len(keys), "input") for i, keys in enumerate(stream)], "seq long, entity_type string, name string, harvested long, source string")
    return from_ids(ids, said)


POOL = [f"wikidata:Q{i}" for i in range(1, 5)] + [f"imdb:tt{i}" for i in range(1, 4)] + [f"google_place_id:p{i}" for i in range(3)] + [f"domain:d{i}.com" for i in range(4)] + ["phone:+12025550100", "phone:+12025550101"]
STREAMS = st.lists(st.lists(st.sampled_from(POOL), min_size=1, max_size=4, unique=True), min_size=1, max_size=14)

SCENARIOS = [
    [["domain:a.com", "wikidata:Q1"], ["google_place_id:p", "wikidata:Q1"]],
    [["domain:d.com", "google_place_id:p1"], ["domain:d.com", "google_place_id:p2"]],
    [["imdb:tt1", "domain:a.com"], ["imdb:tt2", "domain:b.com"], ["domain:a.com", "domain:b.com"]],
    [["domain:d.com", "phone:+12025550100"], ["google_place_id:p", "domain:d.com"]],
    [["wikidata:Q1"], ["wikidata:Q1", "domain:d.com"]],
    [["domain:a.com", "phone:+12025550100"], ["domain:b.com", "phone:+12025550100"], ["phone:+12025550100"], ["phone:+12025550109"]],
    [["wikidata:Q1"], ["google_place_id:p"], ["wikidata:Q1", "google_place_id:p"]],
    [["domain:d.com"], ["google_place_id:p"], ["google_place_id:p", "domain:d.com"]],
    [["domain:d.com"], ["google_place_id:p", "domain:e.com"], ["domain:d.com", "domain:e.com"]],
]


def compare(spark, stream):
    owner, anchors, out = plain(stream)
    got = resolve_exact(batch(spark, stream))
    assert {r.key: r.canonical_id for r in got.nodes.collect()} == owner
    assert {r.canonical_id: r.anchor for r in got.entities.collect()} == anchors
    assert [(r.status, r.reason, r.new_edges) for r in got.outcomes.orderBy("seq").collect()] == out
    return got


def test_scenarios(spark):
    """All scenarios as one stream, each with its own values."""
    stream = []
    for n, s in enumerate(SCENARIOS):
        for keys in s:
            stream.append([k if k.startswith("phone:") else k.replace(":Q", f":Q{n}9").replace(":tt", f":tt{n}9").replace(":p", f":p{n}x").replace("domain:", f"domain:s{n}") for k in keys])
    got = compare(spark, stream)
    assert store.violations(store.empty(spark).with_clusters(got)).isEmpty()


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(STREAMS)
def test_any_stream(spark, stream):
    compare(spark, stream)


def test_two_batches_equal_one(spark):
    random.seed(11)
    stream = [random.sample([k for k in POOL if not k.startswith("phone")], random.randint(1, 3)) for _ in range(30)]
    owner, anchors, out = plain(stream)
    first = resolve_exact(batch(spark, stream[:14]))
    second = resolve_exact(batch(spark, stream[14:], 14), first)
    assert {r.key: r.canonical_id for r in second.nodes.collect()} == owner
    assert {r.canonical_id: r.anchor for r in second.entities.collect()} == anchors
    assert [(r.status, r.reason, r.new_edges) for r in second.outcomes.orderBy("seq").collect()] == out[14:]


def test_set_mode_has_the_same_identity_partition(spark):
    random.seed(12)
    stream = [random.sample(POOL, random.randint(1, 3)) for _ in range(30)]
    owner, _, _ = plain(stream)
    got = {r.key: r.canonical_id for r in resolve_set(batch(spark, stream)).nodes.collect()}
    parts = lambda d: {frozenset(k for k in d if d[k] == c and k.split(":")[0] in IDENTITY) for c in d.values()} - {frozenset()}
    assert set(got) == set(owner)
    assert parts(got) == parts(owner)


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "a string, b string")).isEmpty()


def test_empty_batch(spark):
    got = resolve_exact(from_ids(spark.createDataFrame([], "seq long, pos int, kind string, value string")))
    assert got.nodes.isEmpty() and got.entities.isEmpty() and got.outcomes.isEmpty()


def test_colliding_ids_stay_apart(spark):
    from keyloom.operators.resolve import _apart

    rows = [("k1", "cx_1", "entity"), ("k2", "cx_1", "entity"), ("k2", "cx_1", "node"), ("k3", "cx_2", "entity")]
    folded = spark.createDataFrame(rows, "component string, canonical_id string, tag string")
    got = _apart(folded, spark.createDataFrame([("k2", "cx_1")], "component string, canonical_id string"))
    assert {(r.component, r.tag): r.canonical_id for r in got.collect()} == {("k1", "entity"): "cx_1_c1", ("k2", "entity"): "cx_1", ("k2", "node"): "cx_1", ("k3", "entity"): "cx_2"}
