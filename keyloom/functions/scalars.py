"""Ids, confidence, rounding, request signatures and name-query parts, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.normalizers import name_key, trimmed

# The score of each reason of a resolution.
SCORES = {
    "direct_lookup": 1.0,
    "exact_strong_key": 0.95,
    "hub_crosswalk": 0.90,
    "placekey_address": 0.85,
    "place_unique_match": 0.80,
    "new_public_anchor": 0.60,
    "local_name_match": 0.60,
    "synthetic_strong_key": 0.55,
    "placekey_city_only": 0.40,
    "phone_only": 0.30,
    "ambiguous_among_n": 0.25,
    "needs_stronger_identifier": 0.15,
}
EXACT_REASONS = ["direct_lookup", "exact_strong_key", "new_public_anchor", "synthetic_strong_key"]
HUB_REASONS = ["hub_crosswalk", "placekey_address", "placekey_city_only", "place_unique_match", "local_name_match"]
SECRETS = ["key", "api_key", "apikey"]


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, as a long."""
    b = F.encode(text, "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.when(F.octet_length(b) == 0, start).otherwise(F.aggregate(codes, start, lambda h, x: (h.bitwiseXOR(x) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))))


def canonical_id(anchor: Column) -> Column:
    return F.concat(F.lit("cx_"), F.lpad(F.lower(F.hex(fnv1a32(anchor))), 8, "0"))


def confidence(reason: Column) -> Column:
    out = None
    for r, s in SCORES.items():
        out = F.when(reason == r, F.lit(s)) if out is None else out.when(reason == r, F.lit(s))
    return out


def round2(x: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(x.cast("double") * 100) / 100


def outcome_class(reason: Column) -> Column:
    """exact, hub or miss: every reason that is neither of the first two is a miss."""
    return F.when(reason.isin(EXACT_REASONS), "exact").when(reason.isin(HUB_REASONS), "hub").otherwise("miss")


def _base(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.split(url, r"\?", 2)[0], r"^.*?://", ""), r"/+$", "")


def path_signature(method: Column, url: Column) -> Column:
    """``METHOD host/path``."""
    return F.concat_ws(" ", method, _base(url))


def request_signature(method: Column, url: Column) -> Column:
    """``METHOD host/path?parameters``: sorted, without secrets; scheme and last slash dropped."""
    query = F.coalesce(F.try_element_at(F.split(url, r"\?", 2), F.lit(2)), F.lit(""))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.split(p, "=", 2)[0].alias("k"), F.coalesce(F.try_element_at(F.split(p, "=", 2), F.lit(2)), F.lit("")).alias("v")))
    kept = F.sort_array(F.filter(pairs, lambda p: ~p["k"].isin(SECRETS)))
    text = F.array_join(F.transform(kept, lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"]))), "&")
    return F.concat(path_signature(method, url), F.when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text)))


def text_query(name: Column, street: Column, city: Column, region: Column, country: Column, qualifiers: Column) -> Column:
    return F.array_join(F.concat(F.array_compact(F.array(name, street, city, region, country)), F.coalesce(qualifiers, F.array().cast("array<string>"))), ", ")


def match_name(name: Column) -> Column:
    return F.coalesce(name_key(name), F.lit(""))


def establishing_qualifiers(qualifiers: Column, city: Column, region: Column, country: Column, street: Column) -> Column:
    """All facets of a name query as one sorted set of tokens."""
    every = F.concat(F.coalesce(qualifiers, F.array().cast("array<string>")), F.array(city, region, country, street))
    keys = F.filter(F.transform(F.array_compact(every), name_key), lambda k: k != "")
    return F.array_sort(F.array_distinct(keys))


def has_street(street: Column) -> Column:
    return F.coalesce(F.length(trimmed(street)) > 0, F.lit(False))


def input_description(kind: Column, value: Column) -> Column:
    """What a log may say of an input: ids as they are, but never phones, names or records."""
    return F.when(kind.isin("phone", "name", "record"), kind).otherwise(F.concat_ws(":", kind, value))
