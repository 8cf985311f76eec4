"""Web pages to records: JSON-LD blocks, Open Graph fallbacks, canonical link.

Regular expressions and VARIANT paths only; no parser runs outside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import kinds as K
from keyloom.functions import normalizers as N

_IDS = "array<struct<kind: string, value: string>>"
DEPTH = 3  # nested arrays and @graphs that are followed

#: Fixed value: the public JSON-LD property for other pages about the same thing.
LINKS = "sameAs"


def _attribute(html: Column, tag: str, name: str, value: str, wanted: str) -> Column:
    """The ``wanted`` attribute of the first ``tag`` whose ``name`` is ``value``, in any attribute order."""
    quoted = r"""\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))
    first = F.try_element_at(F.filter(tags, lambda t: t.rlike(rf"""(?is)\b{name}\s*=\s*["']?{value}["'\s>/]""") & t.rlike(rf"(?is)\b{wanted}{quoted}")), F.lit(1))
    value = lambda tag: F.concat(*[F.regexp_extract(tag, rf"(?is)\b{wanted}{quoted}", k) for k in (1, 2)])  # noqa: E731  one of the two is empty
    return unescaped_html(N.once(first, value))


def unescaped_html(x: Column) -> Column:
    """The common character references."""
    # References that pages use in attributes.
    for ref, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = F.replace(x, F.lit(ref), F.lit(char))
    return x


def _objects(blocks: Column) -> Column:
    """All objects of JSON-LD values in reading order: what an @graph holds comes before its owner."""
    as_list = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    level = blocks
    for _ in range(DEPTH):
        level = F.flatten(F.transform(level, lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), as_list(v)).otherwise(F.concat(F.coalesce(as_list(F.try_variant_get(v, "$['@graph']", "variant")), F.array().cast("array<variant>")), F.array(v)))))
    return F.filter(level, lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def _text(v: Column, path: str) -> Column:
    """The value at a path if it is a string."""
    got = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.try_variant_get(v, path, "string"))


def harvested(pages: DataFrame, *, page_domain: str = "domain", html: str = "html") -> DataFrame:
    """``pages`` plus entity_type, name and ids: ordered, distinct (kind, value), the page's own domain first."""
    page = F.coalesce(F.col(html), F.lit(""))
    scripts = F.regexp_extract_all(page, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), F.lit(1))
    own = pages.withColumn("__blocks", F.filter(F.transform(scripts, lambda s: F.try_parse_json(s)), lambda v: v.isNotNull()))
    own = own.withColumn("__objects", _objects(F.col("__blocks")))
    first = lambda path: F.try_element_at(F.filter(F.transform("__objects", lambda v: _text(v, path)), lambda t: t.isNotNull()), F.lit(1))
    pair = lambda tag, value: F.struct(F.lit(tag).alias("kind"), value.alias("value"))
    one = lambda x: N.once(x, lambda v: F.when(v["value"].isNotNull(), F.array(v)).otherwise(F.array().cast(_IDS)))

    def same_as(v: Column) -> Column:
        got = F.try_variant_get(v, f"$.{LINKS}", "variant")
        urls = F.when(F.schema_of_variant(got) == "STRING", F.array(F.try_variant_get(v, f"$.{LINKS}", "string"))).otherwise(F.filter(F.try_variant_get(v, f"$.{LINKS}", "array<string>"), lambda u: u.isNotNull()))
        return F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), K.url_identifier), lambda i: i.isNotNull()).cast(_IDS)

    def of(v: Column) -> Column:
        return F.concat(one(pair("phone", N.phone(_text(v, "$.telephone")))), one(pair("domain", N.domain(_text(v, "$.url")))), same_as(v))

    canonical = N.domain(_attribute(page, "link", "rel", "canonical", "href"))
    ids = F.concat(one(pair("domain", N.domain(F.col(page_domain)))), F.flatten(F.transform("__objects", of)), one(pair("domain", canonical)))
    return own.select(
        *pages.columns,
        F.coalesce(first("$['@type']"), _attribute(page, "meta", "property", "og:type", "content")).alias("entity_type"),
        F.coalesce(first("$.name"), _attribute(page, "meta", "property", "og:title", "content")).alias("name"),
        F.array_distinct(ids).alias("ids"),
    )
