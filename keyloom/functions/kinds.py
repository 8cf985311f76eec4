"""The registry of identifier kinds. A new kind is one entry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import normalizers as N

IDENTITY, AFFILIATION, WEAK = "identity", "affiliation", "weak"
LOCAL_RANK, UNRANKED = 100, 200


@dataclass(frozen=True)
class Kind:
    """``rank`` orders anchors (lower is better, None: never public); ``page`` picks the kind's value from a page URL."""

    tag: str
    strong: bool
    rank: int | None
    grain: str
    normalize: Callable[[Column], Column]
    page: Callable[[Column], Column] | None = None


def _on(site: str) -> Callable[[Column], Column]:
    return lambda url: F.when(N.ascii_lower(url).contains(site), url)


# The kinds, in the order in which page URLs and shorthand parameters are tried.
KINDS: dict[str, Kind] = {
    k.tag: k
    for k in [
        Kind("placekey", True, 1, IDENTITY, N.placekey),
        Kind("domain", True, 2, AFFILIATION, N.domain),
        Kind("google_place_id", True, 3, IDENTITY, N.place_id),
        Kind("imdb", True, None, IDENTITY, N.imdb, _on("imdb.com")),
        Kind("phone", False, None, WEAK, N.phone),
        Kind("wikidata", True, 0, IDENTITY, N.qid, _on("wikidata.org")),
        Kind("tmdb", True, None, IDENTITY, N.tmdb, _on("themoviedb.org")),
        Kind("yelp", True, 4, IDENTITY, N.yelp, _on("yelp.com/biz/")),
    ]
}


def register_kind(kind: Kind) -> None:
    """Adds or replaces a kind for everything planned from now on."""
    KINDS[kind.tag] = kind


def kinds_table(spark: SparkSession) -> DataFrame:
    """kind, strong, rank, grain: a few rows, joined by broadcast."""
    rows = [(k.tag, k.strong, UNRANKED if k.rank is None else k.rank, k.grain) for k in KINDS.values()]
    return F.broadcast(spark.createDataFrame(rows, "kind string, strong boolean, rank int, grain string"))


def normalized(kind: Column, raw: Column) -> Column:
    """The canonical value of ``raw`` as the kind says; NULL for unknown kinds and bad values."""
    out = None
    for k in KINDS.values():
        out = F.when(kind == k.tag, k.normalize(raw)) if out is None else out.when(kind == k.tag, k.normalize(raw))
    return out


def _of(kind: Column, value: Callable[[Kind], object], default) -> Column:
    out = None
    for k in KINDS.values():
        v = F.lit(value(k))
        out = F.when(kind == k.tag, v) if out is None else out.when(kind == k.tag, v)
    return out.otherwise(F.lit(default))


def kind_of(key: Column) -> Column:
    """The kind of ``kind:value``: what stands before the first colon."""
    return F.substring_index(key, ":", 1)


def value_of(key: Column) -> Column:
    return F.split(key, ":", 2)[1]


def known(kind: Column) -> Column:
    return kind.isin(list(KINDS))


def strong(kind: Column) -> Column:
    return _of(kind, lambda k: k.strong, False)


def grain(kind: Column) -> Column:
    return _of(kind, lambda k: k.grain, WEAK)


def rank(kind: Column) -> Column:
    """Anchor rank of a key's kind: the registry's, 100 for local keys, else 200."""
    return F.when(kind == "local", F.lit(LOCAL_RANK)).otherwise(_of(kind, lambda k: UNRANKED if k.rank is None else k.rank, UNRANKED))


def url_identifier(url: Column) -> Column:
    """(kind, value) that a page names with a URL; NULL for social pages and anything else.

    Social hosts are recognised by plain containment. Kinds are tried in order; a kind whose
    normalizer refuses gives way to the next; other http(s) URLs name their domain.
    """
    low = N.ascii_lower(url)
    # Hosts whose pages identify nothing.
    social = ["facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "linkedin.com", "tiktok.com", "pinterest.com"]
    skip = F.lit(False)
    for s in social:
        skip = skip | low.contains(s)

    def pair(tag: str, value: Column) -> Column:
        return N.once(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(tag).alias("kind"), v.alias("value"))))

    found = [pair(k.tag, k.normalize(k.page(url))) for k in KINDS.values() if k.page is not None]
    found.append(F.when(low.startswith("http://") | low.startswith("https://"), pair("domain", N.domain(url))))
    return F.when(~skip, F.coalesce(*found))
