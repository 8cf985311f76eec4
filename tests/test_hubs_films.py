import json

from keyloom.sources import hubs as H


def test_films_without_links_add_nothing(spark):
    find = lambda film, answer: ("GET", f"{H.TMDB}/find/{film}?external_source=imdb_id", json.dumps(answer))
    table = H.responses(
        spark.createDataFrame(
            [
                find("tt1", {"movie_results": [{"id": 5, "title": "Five"}]}),
                find("tt2", {"movie_results": [{"id": 6}]}),
                find("tt3", {"movie_results": []}),
                find("tt4", {"movie_results": [{"title": "No id"}]}),
                ("GET", f"{H.TMDB}/movie/6/external_ids", json.dumps({"imdb_id": "tt2", "wikidata_id": "Q6"})),
            ],
            "method string, url string, response string",
        )
    )
    wanted = spark.createDataFrame([(i, "tmdb", "imdb", f"tt{i}") for i in range(1, 6)], "rid long, hub string, kind string, value string")
    got = {r.rid: (r.name, r.entity_type, [tuple(i) for i in r.ids]) for r in H.harvested(wanted, table).collect()}
    assert got == {
        2: (None, "Movie", [("tmdb", "6"), ("imdb", "tt2"), ("wikidata", "Q6")]),
        3: (None, None, [("imdb", "tt3")]),
        4: ("No id", "Movie", [("imdb", "tt4")]),
    }
