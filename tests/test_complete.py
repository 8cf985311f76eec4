import json

from pyspark.sql import functions as F

from keyloom.operators.complete import complete
from keyloom.plans import store
from keyloom.sources import hubs as H
from keyloom.sources.records import from_ids


def test_more_requests_than_places(spark):
    rows = [(1, i, "imdb", f"tt{1000000 + i}") for i in range(40)] + [(2, 0, "imdb", "tt2000000")]
    ids = spark.createDataFrame(rows, "seq long, pos int, kind string, value string")
    asked = ids.select(H.request_url(F.lit("wikidata"), F.col("kind"), F.col("value")).alias("url"), F.lit("GET").alias("method"), "value").collect()
    answer = lambda v: json.dumps({"results": {"bindings": [{"item": {"value": f"http://www.wikidata.org/entity/Q{v[2:]}"}, "imdb": {"value": v}}]}})
    table = H.responses(spark.createDataFrame([(r.method, r.url, answer(r.value)) for r in asked], "method string, url string, response string"))
    out = {r.seq: r for r in complete(from_ids(ids), table, store.empty(spark), hops=1)[1].collect()}
    assert out[1].canonical_id != out[2].canonical_id
    assert (out[1].new_edges, out[2].new_edges) == (80, 2)
