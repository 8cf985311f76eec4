"""Hub answers as tables: request signatures, lookups and parsers.

A hub is reached through a table of responses, never from inside a query: (method,
request_sig, path_sig, response). Live fetching is a job that fills such a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.scalars import path_signature, request_signature, text_query

# Endpoints, which hubs a kind is sent to, what makes a hub superfluous, and the
# source that its edges get.
WIKIDATA = "https://query.wikidata.org/sparql"
TMDB = "https://api.themoviedb.org/3"
PLACES = "https://places.googleapis.com"
PLACEKEY = "https://api.placekey.io/v1/placekey"
DISPATCH = [("imdb", "wikidata"), ("imdb", "tmdb"), ("wikidata", "wikidata"), ("wikidata", "tmdb"), ("tmdb", "tmdb"), ("google_place_id", "place_details")]
SUPERFLUOUS = {"wikidata": ["tmdb"], "tmdb": ["wikidata"], "place_details": ["domain", "phone"]}
SOURCE = {"wikidata": "wikidata", "tmdb": "tmdb", "place_details": "google_places"}

RESPONSES = "method string, request_sig string, path_sig string, response string"


def responses(df: DataFrame, *, order: str | None = None) -> DataFrame:
    """(method, url, response text) as a response table; the last of equal requests by ``order`` counts, else the greatest text."""
    sig = df.select("method", request_signature(F.col("method"), F.col("url")).alias("request_sig"), path_signature(F.col("method"), F.col("url")).alias("path_sig"), "response", F.col(order).alias("o") if order else F.col("response").alias("o"))
    return sig.groupBy("method", "request_sig", "path_sig").agg(F.max_by("response", F.struct("o", "response")).alias("response"))


def response_files(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of {"method", "url", "response"} files, in the order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    text = F.decode("content", "UTF-8")
    own = files.select("path", *[F.get_json_object(text, f"$.{k}").alias(k) for k in ("method", "url", "response")])
    return responses(own.withColumn("method", F.coalesce("method", F.lit("GET"))), order="path")


def answered(requests: DataFrame, table: DataFrame) -> DataFrame:
    """``requests`` (method, url, ...) plus response: of the same request, else of the same path, else null."""
    exact = table.groupBy("request_sig").agg(F.min_by("response", "path_sig").alias("__exact"))
    path = table.groupBy(F.col("path_sig").alias("__path_sig")).agg(F.min_by("response", "request_sig").alias("__path"))
    own = requests.withColumn("request_sig", request_signature(F.col("method"), F.col("url"))).withColumn("__p", path_signature(F.col("method"), F.col("url")))
    own = own.join(exact, "request_sig", "left").join(path, F.col("__p") == F.col("__path_sig"), "left")
    return own.select(*requests.columns, F.coalesce("__exact", "__path").alias("response"))


def wikidata_query(kind: Column, value: Column) -> Column:
    """The request URL for an identifier; NULL for kinds that it cannot select by."""
    select = (
        F.when(kind == "imdb", F.format_string('?item wdt:P345 "%s".', value)).when(kind == "wikidata", F.format_string("BIND(wd:%s AS ?item)", value)).when(kind == "domain", F.format_string('?item wdt:P856 ?site. FILTER(CONTAINS(STR(?site), "%s"))', value))
    )
    body = F.concat(F.lit("SELECT ?item ?imdb ?website ?phone ?tmdb WHERE { "), select, F.lit(" OPTIONAL{?item wdt:P345 ?imdb} OPTIONAL{?item wdt:P856 ?website} OPTIONAL{?item wdt:P1329 ?phone} OPTIONAL{?item wdt:P4947 ?tmdb} } LIMIT 10"))
    return F.concat(F.lit(f"{WIKIDATA}?format=json&query="), F.url_encode(body))


def request_url(hub: Column, kind: Column, value: Column) -> Column:
    """The first request of a hub for an identifier."""
    return (
        F.when(hub == "wikidata", wikidata_query(kind, value))
        .when((hub == "tmdb") & (kind == "imdb"), F.concat(F.lit(f"{TMDB}/find/"), value, F.lit("?external_source=imdb_id")))
        .when((hub == "tmdb") & (kind == "tmdb"), F.concat(F.lit(f"{TMDB}/movie/"), value, F.lit("/external_ids")))
        .when(hub == "place_details", F.concat(F.lit(f"{PLACES}/v1/places/"), value))
    )


_PAIRS = "array<struct<kind: string, value: string>>"
_CELL = "struct<value: string>"
_BINDINGS = f"struct<results: struct<bindings: array<struct<item: {_CELL}, imdb: {_CELL}, website: {_CELL}, phone: {_CELL}, tmdb: {_CELL}>>>>"


def _pair(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _given(pairs: Column) -> Column:
    return F.filter(pairs.cast(_PAIRS), lambda p: p["value"].isNotNull())


def wikidata_ids(response: Column) -> Column:
    """Raw (kind, value) pairs in order; NULL where the bindings are missing."""
    rows = F.from_json(response, _BINDINGS)["results"]["bindings"]
    of = lambda b: F.array(_pair("wikidata", b["item"]["value"]), _pair("imdb", b["imdb"]["value"]), _pair("domain", b["website"]["value"]), _pair("phone", b["phone"]["value"]), _pair("tmdb", b["tmdb"]["value"]))
    return _given(F.array_distinct(F.flatten(F.transform(rows, of))))


def tmdb_movie(response: Column) -> Column:
    """(first, id, title): the first movie found as text, if any; ids may be numbers or strings."""
    return F.struct(F.get_json_object(response, "$.movie_results[0]").alias("first"), F.get_json_object(response, "$.movie_results[0].id").alias("id"), F.get_json_object(response, "$.movie_results[0].title").alias("title"))


def tmdb_ids(response: Column) -> Column:
    return _given(F.array(_pair("imdb", F.get_json_object(response, "$.imdb_id")), _pair("wikidata", F.get_json_object(response, "$.wikidata_id"))))


def place_ids(response: Column) -> Column:
    site, phone = F.get_json_object(response, "$.websiteUri"), F.coalesce(F.get_json_object(response, "$.internationalPhoneNumber"), F.get_json_object(response, "$.nationalPhoneNumber"))
    return _given(F.array(_pair("domain", site), _pair("phone", phone)))


def place_name(response: Column) -> Column:
    return F.get_json_object(response, "$.displayName.text")


def found_places(response: Column) -> Column:
    """All place ids of a text search, in order."""
    places = F.from_json(response, "struct<places: array<struct<id: string>>>")["places"]
    return F.filter(F.coalesce(F.transform(places, lambda p: p["id"]), F.array().cast("array<string>")), lambda i: i.isNotNull())


def found_placekey(response: Column) -> Column:
    return F.get_json_object(response, "$.placekey")


def search_requests(queries: DataFrame) -> DataFrame:
    """The text search of each name query: query_id, method, url."""
    q = text_query(*(F.col(c) for c in ("name", "street", "city", "region", "country", "qualifiers")))
    return queries.select("query_id", F.lit("POST").alias("method"), F.concat(F.lit(f"{PLACES}/v1/places:searchText?textQuery="), F.url_encode(q)).alias("url"))


def placekey_requests(queries: DataFrame) -> DataFrame:
    """The address lookup of each name query that has a street: query_id, method, url, body."""
    given = lambda c: F.when(F.length(F.trim(F.col(c))) > 0, F.col(c))
    body = F.to_json(F.struct(F.struct(given("name").alias("location_name"), given("street").alias("street_address"), given("city").alias("city"), given("region").alias("region"), given("country").alias("iso_country_code")).alias("query")))
    return queries.filter(given("street").isNotNull()).select("query_id", F.lit("POST").alias("method"), F.concat(F.lit(f"{PLACEKEY}?query_id="), F.col("query_id").cast("string")).alias("url"), body.alias("body"))


def harvested(wanted: DataFrame, table: DataFrame) -> DataFrame:
    """``wanted``: rid, hub, kind, value. rid, hub, name, ids (raw pairs, the input last) where a hub answered.

    A hub that has no answer, or one that cannot be read, adds nothing; so does a film whose links are not answered.
    """
    first = answered(wanted.withColumn("method", F.lit("GET")).withColumn("url", request_url(F.col("hub"), F.col("kind"), F.col("value"))).filter("url is not null"), table)
    # the movie database answers an imdb id with its own id, which a second request turns into links
    found = first.withColumn("movie", F.when((F.col("hub") == "tmdb") & (F.col("kind") == "imdb"), tmdb_movie(F.col("response"))))
    chained = found.withColumn("url", F.concat(F.lit(f"{TMDB}/movie/"), F.col("movie.id"), F.lit("/external_ids"))).drop("response")
    second = answered(chained, table).select("rid", "hub", F.col("response").alias("second"))
    own = found.join(second, ["rid", "hub"], "left")
    hub, none = F.col("hub"), F.array().cast(_PAIRS)
    ids = (
        F.when(hub == "wikidata", wikidata_ids(F.col("response")))
        .when((hub == "tmdb") & (F.col("kind") == "imdb"), F.when(F.col("movie.id").isNull(), none).when(F.col("second").isNotNull(), F.concat(_given(F.array(_pair("tmdb", F.col("movie.id")))), tmdb_ids(F.col("second")))))
        .when(hub == "tmdb", tmdb_ids(F.col("response")))
        .when(hub == "place_details", place_ids(F.col("response")))
    )
    name = F.when(hub == "place_details", place_name(F.col("response"))).when(hub == "tmdb", F.col("movie.title"))
    entity_type = F.when((hub == "tmdb") & F.col("movie.first").isNotNull(), "Movie")
    out = own.filter("response is not null").withColumn("ids", ids).filter("ids is not null")
    return out.select("rid", "hub", name.alias("name"), entity_type.alias("entity_type"), F.array_distinct(F.concat("ids", F.array(F.struct("kind", "value")))).alias("ids"))


def numbered_requests(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` plus n: 0, 1, ... within each key."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
