"""The verbs over a store, corrections, names, pages, completion and streams."""

import json

import pytest
from pyspark.sql import functions as F

from keyloom.engine import Crosswalk
from keyloom.operators import corrections, names
from keyloom.operators.complete import resolve_by_name
from keyloom.plans import stats, store
from keyloom.sources import hubs, pages, records
from keyloom.streaming.commits import commit_stream, windowed_miss_rate

SEEDS = [
    {"type": "Restaurant", "name": "Blue", "ids": [{"domain": "https://blue.com"}, {"google_place_id": "P1"}, {"phone": "(202) 555-0100"}]},
    {"type": "Restaurant", "name": "Blue Two", "ids": [{"domain": "blue.com"}, {"google_place_id": "P2"}]},
    {"type": "Movie", "name": "M", "ids": [{"imdb": "tt0133093"}, {"wikidata": "Q83495"}]},
]


def seeds(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r) if isinstance(r, dict) else r) for i, r in enumerate(rows)], "seq long, json string")


def test_verbs(spark, tmp_path):
    x = Crosswalk(spark, str(tmp_path / "x"))
    out, rejects = x.ingest(seeds(spark, [*SEEDS, "{", {"ids": []}, {"ids": [{"nope": "1"}]}]))
    assert [r.status for r in out.orderBy("seq").collect()] == ["new"] * 3
    assert [r.reject_reason for r in rejects.orderBy("seq").collect()] == ["invalid_json", "invalid_input", "unknown_kind"]
    got = x.resolve(spark.createDataFrame([(1, 0, "imdb", "TT0133093"), (2, 0, "domain", "blue.com"), (3, 0, "phone", "202-555-0100")], "seq long, pos int, kind string, value string")).orderBy("seq").collect()
    assert [(r.status, r.reason) for r in got] == [("hit", "exact_strong_key"), ("hit", "exact_strong_key"), ("unresolved", "phone_only")]
    assert got[0].anchor == "wikidata:Q83495" and got[1].anchor == "google_place_id:P1"
    report, reasons = x.stats()
    r = report.first()
    assert (r.total, r.exact, r.miss, r.miss_rate_2, r.entities, r.edges) == (3, 2, 1, 0.33, 3, 6)
    assert [tuple(q) for q in reasons.collect()] == [("exact_strong_key", 2), ("phone_only", 1)]
    full, missing = x.entity(spark.createDataFrame([(got[0].canonical_id,), ("cx_none",)], "canonical_id string"))
    assert full.first().confidence == 1.0 and missing.first().canonical_id == "cx_none"
    with pytest.raises(corrections.Refused):
        x.link("google_place_id:P1", "google_place_id:P2")
    cid, outcome = x.link("google_place_id:P1", "yelp:blue")
    assert outcome == "attached" and x.link("google_place_id:P1", "yelp:blue")[1] == "already_linked"
    with pytest.raises(corrections.Refused):
        x.merge([cid, got[2].canonical_id or "cx_missing"])
    new = x.split(["yelp:blue"])
    s = x.store.read()
    assert {r.key for r in s.nodes.filter(F.col("canonical_id") == new).collect()} == {"yelp:blue"}
    assert store.violations(s).isEmpty() and x.store.version() == 4
    both = [r.canonical_id for r in s.entities.filter(F.col("name").like("Blue%")).collect()]
    with pytest.raises(corrections.Refused):
        x.merge(both)
    assert x.merge(both, force=True) in both


def test_seed_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(SEEDS[0]))
    (tmp_path / "a.json").write_text(json.dumps(SEEDS[2]))
    (tmp_path / "c.txt").write_text("no")
    got = records.seed_files(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a.json", "b.json"]


def test_upserts_keep_sources(spark):
    nodes = spark.createDataFrame([("a", "c1", "hub"), ("b", "c1", None)], store.NODES)
    new = spark.createDataFrame([("a", "c2", None), ("c", "c3", "x")], store.NODES)
    assert {tuple(r) for r in store.attach(nodes, new).collect()} == {("a", "c2", "hub"), ("b", "c1", None), ("c", "c3", "x")}
    old = spark.createDataFrame([("c1", "a", None, "n")], store.ENTITIES)
    told = spark.createDataFrame([("c1", "t", "other")], "canonical_id string, entity_type string, name string")
    assert tuple(store.enrich(old, told).first()) == ("c1", "a", "t", "n")


def queries(spark, *rows):
    return spark.createDataFrame([(i, n, q, None, None, None, None) for i, (n, q) in enumerate(rows)], names.QUERY)


def test_name_specificity(spark):
    s = store.empty(spark)
    s.entities = spark.createDataFrame([("c1", "a", None, "Nova"), ("c2", "b", None, "Nova"), ("c3", "d", None, "Solo")], store.ENTITIES)
    s.name_index = store.index_names(s.name_index, spark.createDataFrame([("nova", ["1 main st", "sf"], "c1", "x"), ("nova", ["2 oak st", "sf"], "c2", "x"), ("solo", ["9 elm", "la"], "c3", "x")], "name_norm string, qualifiers array<string>, canonical_id string, source string"))
    out = names.resolve_names(queries(spark, ("Nova!", ["SF"]), ("nova", ["sf", "1 Main St", "x"]), ("solo", ["la"]), ("solo", []), ("  ", ["la"]), (None, None)), s).orderBy("query_id").collect()
    assert [(r.canonical_id, r.reason, len(r.candidates)) for r in out] == [
        (None, "ambiguous_among_n", 2), ("c1", "local_name_match", 0), (None, "needs_stronger_identifier", 0), ("c3", "local_name_match", 0), (None, "needs_stronger_identifier", 0), (None, "needs_stronger_identifier", 0),
    ]
    log = spark.createDataFrame([(1, "solo", ["la"], None, "c3"), (2, "nova", ["sf", "1 main st", "x"], None, "gone")], f"seq long, name_norm string, qualifiers array<string>, candidates {store.CANDIDATES}, canonical_id string")
    s.name_cardinality = store.record_cardinality(s.name_cardinality, log)
    assert names.resolve_names(queries(spark, ("solo", ["la"])), s).first().canonical_id == "c3"
    flip = spark.createDataFrame([(3, "solo", ["la"], [("c1", "a", "n"), ("c2", "b", "n")], None)], log.schema)
    s.name_cardinality = store.record_cardinality(s.name_cardinality, flip)
    r = names.resolve_names(queries(spark, ("solo", ["la"])), s).first()
    assert (r.canonical_id, r.reason, len(r.candidates)) == (None, "ambiguous_among_n", 2)


def test_harvest(spark):
    html = """<html><head><script type="application/ld+json">[{"@type":"Restaurant","name":"B","telephone":"202-555-0100","%s":["https://www.yelp.com/biz/B-one?x","https://twitter.com/b"]}]</script>
      <script type='application/ld+json'>  </script><link href="https://other.example.co.uk/x" rel="canonical"></head></html>""" % pages.LINKS
    rows = spark.createDataFrame([(1, "b.com", html), (2, "c.com", "<p>"), (3, "d.com", None)], "i int, domain string, html string")
    got = {r.i: ([tuple(p) for p in r.ids], r.entity_type, r.name) for r in pages.harvested(rows).collect()}
    assert got[1] == ([("domain", "b.com"), ("phone", "+12025550100"), ("yelp", "b-one"), ("domain", "example.co.uk")], "Restaurant", "B")
    assert got[2] == ([("domain", "c.com")], None, None) and got[3][0] == [("domain", "d.com")]


def test_names_from_hubs(spark):
    def row(method, url, response):
        return (method, url, json.dumps(response))

    q = queries(spark, ("One", ["x"]), ("Many", []), ("None", []))
    urls = {r.query_id: r.url for r in hubs.search_requests(q).collect()}
    table = hubs.responses(
        spark.createDataFrame(
            [row("POST", urls[0], {"places": [{"id": "P9"}]}), row("POST", urls[1], {"places": [{"id": "P1"}, {"id": "P2"}]}), row("POST", urls[2], {}), row("GET", "https://places.googleapis.com/v1/places/P9", {"websiteUri": "https://one.com", "nationalPhoneNumber": "202 555 0100"})],
            "method string, url string, response string",
        )
    )
    s, out = resolve_by_name(q, table, store.empty(spark))
    got = {r.query_id: (r.reason, len(r.candidates)) for r in out.collect()}
    assert got == {0: ("place_unique_match", 0), 1: ("ambiguous_among_n", 2), 2: ("needs_stronger_identifier", 0)}
    assert {r.key: r.source for r in s.nodes.collect()} == {"google_place_id:P9": "input", "domain:one.com": "google_places"}
    again = {r.query_id: r.reason for r in names.resolve_names(q, s).collect()}
    assert again[0] == "local_name_match" and again[1] == "ambiguous_among_n"


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seeds(spark, SEEDS).write.json(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema("seq long, json string").option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    q = commit_stream(stream, s, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert s.read().entities.count() == 3
    log = spark.createDataFrame([("2024-01-01 00:00:00", "phone_only"), ("2024-01-01 05:00:00", "exact_strong_key"), ("2024-01-02 00:00:00", "odd")], "ts string, reason_tag string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.total, r.miss) for r in windowed_miss_rate(log).orderBy("window_start").collect()] == [(2, 1), (1, 1)]
    assert stats.totals(log.limit(0)).first().miss_rate == 0.0


def test_response_files(spark, tmp_path):
    for name, value in (("a", 1), ("b", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"method": "GET", "url": "https://h.org/x?key=s&q=1", "response": {"v": value}}))
    table = hubs.response_files(spark, str(tmp_path))
    asked = spark.createDataFrame([("GET", "http://h.org/x/?q=1"), ("GET", "http://h.org/x?q=2"), ("GET", "http://h.org/y")], "method string, url string")
    assert {r.url: r.response for r in hubs.answered(asked, table).collect()} == {"http://h.org/x/?q=1": '{"v":2}', "http://h.org/x?q=2": '{"v":2}', "http://h.org/y": None}


def test_requests():
    from keyloom.sources.requests import BadRequest, identifier, selected

    assert identifier({"id": "imdb:tt1", "domain": "x"}) == ("imdb", "tt1")
    assert identifier({"wikidata": "Q1", "domain": "a.com"}) == ("domain", "a.com") and identifier({"place_id": "P"}) == ("google_place_id", "P")
    for bad in ({}, {"id": "nope"}, {"id": "zz:1"}):
        with pytest.raises(BadRequest):
            identifier(bad)
    assert selected({"name": "x", "city": "y"}) == "name"
    for bad in ({}, {"imdb": "1", "name": "x"}, {"imdb": "1", "city": "y"}, {"name": " "}):
        with pytest.raises(BadRequest):
            selected(bad)
