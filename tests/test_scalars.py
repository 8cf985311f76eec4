import pytest
from pyspark.sql import functions as F

from keyloom.functions import kinds as K
from keyloom.functions import normalizers as N
from keyloom.functions import scalars as S

CASES = {
    "domain": [
        ("https://www.BlueBottle.com/menu?x=1", "bluebottle.com"), ("shop.example.co.uk", "example.co.uk"), ("//a.b.example.com/x", "example.com"), ("http://user:p@host.example.org:80/x", "example.org"),
        ("1.2.3.4", None), ("http://[::1]/", None), ("co.uk", None), ("localhost", None), ("a..b.com", None), ("exa mple.com", None), ("  ", None), (None, None), ("example.com:8080", "example.com:8080"),
    ],
    "phone": [
        ("(202) 555-0100", "+12025550100"), ("+1 202-555-0100 ext. 7", "+12025550100"), ("0044 20 7946 0958", "+442079460958"), ("+44 20 7946 0958", "+442079460958"), ("1-800-FLOWERS", "+18003569377"),
        ("123", None), ("4111 1111 1111 1111", None), ("(102) 555-0100", None), ("", None), (None, None),
    ],
    "imdb": [("tt0133093", "tt0133093"), ("TT0133093", "tt0133093"), ("https://www.imdb.com/title/tt0133093/?ref=x", "tt0133093"), ("nm01", None), ("ttx/tt1", None), ("tt", None)],
    "wikidata": [("Q83495", "Q83495"), ("q7", "Q7"), ("https://www.wikidata.org/wiki/Q83495", "Q83495"), ("Q0", None), ("Q", None), ("P1", None)],
    "tmdb": [("603", "603"), ("007", "7"), ("https://www.themoviedb.org/movie/335984-blade-runner-2049", "335984"), ("https://www.themoviedb.org/tv/1399?x", "1399"), ("https://www.themoviedb.org/person/1", None), ("0", None), ("a1", None)],
    "yelp": [("https://www.yelp.com/biz/Blue-Bottle?osq=1", "blue-bottle"), ("Slug ", "slug"), ("https://www.yelp.com/user", None), ("https://www.yelp.com/biz/", None)],
    "placekey": [("@5vg-7gq-TVZ", "@5vg-7gq-tvz"), ("223-227@5vg-7gq-tvz", "223-227@5vg-7gq-tvz"), ("223@", None), ("a--b@c", None), ("abc", None)],
    "google_place_id": [(" ChIJx ", "ChIJx"), ("  ", None)],
}


@pytest.mark.parametrize("kind", CASES)
def test_normalizers(spark, kind):
    df = spark.createDataFrame([(kind, raw, want) for raw, want in CASES[kind]], "kind string, raw string, want string")
    for r in df.withColumn("got", K.normalized(F.col("kind"), F.col("raw"))).collect():
        assert r.got == r.want, r


def test_name_key(spark):
    rows = [("  Blue  Bottle Café! ", "blue bottle café"), ("San Francisco", "san francisco"), ("--", ""), ("O'Neil's (Bar)", "o'neil's bar"), ("", "")]
    for r in spark.createDataFrame(rows, "raw string, want string").withColumn("got", N.name_key(F.col("raw"))).collect():
        assert r.got == r.want, r


def test_canonical_id_and_rounding(spark):
    r = spark.range(1).select(S.canonical_id(F.lit("wikidata:Q4926426")).alias("a"), S.round2(F.lit(0.125)).alias("b"), S.fnv1a32(F.lit("")).alias("c"), S.canonical_id(F.lit("é")).alias("d")).first()
    h = 2166136261
    for b in "é".encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert (r.a, r.b, r.c, r.d) == ("cx_780d70d9", 0.13, 2166136261, f"cx_{h:08x}")


def test_signatures(spark):
    url = F.lit("https://api.x.org/a/b/?z=1&api_key=s&a=&key=t")
    r = spark.range(1).select(S.request_signature(F.lit("GET"), url).alias("a"), S.path_signature(F.lit("GET"), url).alias("b")).first()
    assert (r.a, r.b) == ("GET api.x.org/a/b?a&z=1", "GET api.x.org/a/b")


def test_social_filter_is_plain_containment(spark):
    rows = [("https://www.netflix.com/title/1", None), ("https://www.facebook.com/x", None), ("https://www.imdb.com/name/nm1", "domain:imdb.com"), ("https://www.imdb.com/title/tt1/", "imdb:tt1"), ("nothing", None)]
    for r in spark.createDataFrame(rows, "u string, want string").withColumn("i", K.url_identifier(F.col("u"))).select("u", "want", F.when(F.col("i").isNotNull(), F.concat_ws(":", "i.kind", "i.value")).alias("got")).collect():
        assert r.got == r.want, r


def test_new_kind(spark):
    try:
        K.register_kind(K.Kind("isbn", True, 5, K.IDENTITY, lambda c: F.when(c.rlike("^[0-9]{13}$"), c)))
        assert spark.range(1).select(K.normalized(F.lit("isbn"), F.lit("9780000000000")).alias("x")).first().x == "9780000000000"
    finally:
        del K.KINDS["isbn"]
