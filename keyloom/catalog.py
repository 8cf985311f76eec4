"""Registered queries over the provided tables, and the SQL that gives the same rows.

The tables carry no web identifiers, so the inputs are rendered from their keys: order n stands for
the film tt(n+1), customer n for the item Q(n+1), nations for shared domains and phones. Keys
are counted from 0 and Q0 is no item, hence the + 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import kinds as K
from keyloom.functions import normalizers as N
from keyloom.functions import scalars as S
from keyloom.operators import corrections, names
from keyloom.operators.complete import complete, resolve_by_name
from keyloom.operators.components import connected_components
from keyloom.operators.resolve import anchor, resolve_exact, resolve_set
from keyloom.plans import documents, stats, store
from keyloom.plans.workspace import shared_dir
from keyloom.sources import hubs, pages, records
from keyloom.streaming.commits import sessions, windowed_miss_rate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores: a small file is one task, whatever is computed from its rows."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(n: Column, *values: Column) -> Column:
    """The value whose place is n modulo their number."""
    out = F.when(n % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(n % len(values) == i, v)
    return out


# ---- normalizers ----------------------------------------------------------------------------


@registered("SELECT page_id, array_to_string(list_slice(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.'), -2, -1), '.') AS domain FROM pages")
def normalize_domain(spark, d):
    return table(spark, d, "pages").select("page_id", N.domain(F.col("url")).alias("domain"))


_PHONE = r"\+?[0-9][0-9 ()-]{8,18}[0-9]"


@registered(rf"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}')) AS raw FROM documents),
 t AS (SELECT doc_id, raw, regexp_replace(raw, '^00', '+') AS t FROM r),
 g AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS digits FROM t),
 a AS (SELECT *, regexp_extract(digits, '^1?([2-9][0-9][0-9][2-9][0-9][0-9][0-9][0-9][0-9][0-9])$', 1) AS us FROM g)
SELECT doc_id, raw, CASE WHEN NOT starts_with(t, '+') AND us <> '' THEN '+1' || us
  WHEN starts_with(t, '+') AND starts_with(digits, '1') AND length(digits) = 11 AND us <> '' THEN '+1' || us
  WHEN starts_with(t, '+') AND NOT starts_with(digits, '1') AND regexp_matches(digits, '^[2-9][0-9]{{7,14}}$') THEN '+' || digits END AS phone, count(*) AS n
FROM a GROUP BY ALL
""")
def normalize_phone(spark, d):
    raw = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_PHONE), F.lit(0))).alias("raw"))
    return raw.groupBy("doc_id", "raw", N.phone(F.col("raw")).alias("phone")).agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT c_custkey AS id, CASE WHEN (c_custkey + 1) % 4 = 3 THEN NULL ELSE 'Q' || (c_custkey + 1) END AS value FROM customer")
def normalize_qid(spark, d):
    n = F.col("c_custkey") + 1
    raw = _pick(n, _text("Q", n), _text("http://www.wikidata.org/entity/Q", n), _text("  q", n, " "), _text("P", n))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), N.qid(raw).alias("value"))


@registered("SELECT o_orderkey AS id, CASE WHEN (o_orderkey + 1) % 4 = 3 THEN NULL ELSE 'tt' || lpad((o_orderkey + 1)::VARCHAR, 7, '0') END AS value FROM orders")
def normalize_imdb(spark, d):
    n = F.col("o_orderkey") + 1
    seven = F.lpad(n.cast("string"), 7, "0")
    raw = _pick(n, _text("tt", seven), _text("https://www.imdb.com/title/tt", seven, "/?ref=x"), _text("TT", seven), _text("nm", seven))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), N.imdb(raw).alias("value"))


@registered("SELECT p_partkey AS id, CASE WHEN (p_partkey + 1) % 4 = 3 THEN NULL ELSE (p_partkey + 1)::VARCHAR END AS value FROM part")
def normalize_tmdb(spark, d):
    n = F.col("p_partkey") + 1
    raw = _pick(n, _text(n), _text("https://www.themoviedb.org/movie/", n, "-blade-2049?x"), _text("00", n), _text("https://www.themoviedb.org/person/", n))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), N.tmdb(raw).alias("value"))


@registered("SELECT p_partkey AS id, CASE WHEN (p_partkey + 1) % 3 = 2 THEN NULL ELSE 'part-' || (p_partkey + 1) END AS value FROM part")
def normalize_yelp(spark, d):
    n = F.col("p_partkey") + 1
    raw = _pick(n, _text("https://www.yelp.com/biz/Part-", n, "/?osq=x#y"), _text(" PART-", n), _text("https://www.yelp.com/user_details?id=", n))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), N.yelp(raw).alias("value"))


@registered("SELECT s_suppkey AS id, CASE (s_suppkey + 1) % 3 WHEN 0 THEN '@5vg-' || (s_suppkey + 1) || '-tvz' WHEN 1 THEN 'zzw-222@5vg-' || (s_suppkey + 1) END AS value FROM supplier")
def normalize_placekey(spark, d):
    n = F.col("s_suppkey") + 1
    raw = _pick(n, _text("@5vg-", n, "-Tvz "), _text("ZZW-222@5vg-", n), _text("zzw--2@5vg-", n))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), N.placekey(raw).alias("value"))


@registered("SELECT p_partkey AS id, 'ChIJ' || p_partkey || '_Ab' AS value FROM part")
def normalize_place_id(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), N.place_id(_text("  ChIJ", F.col("p_partkey"), "_Ab\t")).alias("value"))


_NAME_SQL = r"lower(array_to_string(list_filter(list_transform(string_split_regex(trim({0}), '\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}]+$', '')), lambda w: w <> ''), ' '))"


@registered(f"SELECT p_partkey AS id, {_NAME_SQL.format("'«' || p_name || '» -- ' || p_brand || '! '")} AS name_norm FROM part")
def name_key(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), N.name_key(_text("«", F.col("p_name"), "» -- ", F.col("p_brand"), "! ")).alias("name_norm"))


# ---- scalars --------------------------------------------------------------------------------


def _cid_sql(key: str) -> str:
    return f"'cx_' || format('{{:08x}}', list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split({key}, ''), lambda c: ord(c)::UBIGINT)), lambda h, b: (xor(h, b) * 16777619::UBIGINT) & 4294967295::UBIGINT))"


@registered(f"SELECT c_custkey AS id, {_cid_sql("('wikidata:Q' || (c_custkey + 1))")} AS canonical_id FROM customer")
def canonical_id(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), S.canonical_id(_text("wikidata:Q", F.col("c_custkey") + 1)).alias("canonical_id"))


@registered(r"""
WITH p AS (SELECT page_id, regexp_replace(string_split(url, '?')[1], '^.*?://', '') AS b, coalesce(regexp_extract(url, '\?(.*)$', 1), '') AS q FROM pages),
 k AS (SELECT page_id, regexp_replace(b, '/+$', '') AS base, list_sort(list_filter(string_split('api_key=s&' || q, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(key|api_key|apikey)(=|$)'))) AS ps FROM p)
SELECT page_id, 'GET ' || base AS path_sig, 'GET ' || base || CASE WHEN len(ps) = 0 THEN '' ELSE '?' || array_to_string(ps, '&') END AS request_sig FROM k
""")
def request_signature(spark, d):
    url = F.when(F.col("url").contains("?"), F.regexp_replace("url", r"\?", "?api_key=s&")).otherwise(F.concat("url", F.lit("?api_key=s")))
    return table(spark, d, "pages").select("page_id", S.path_signature(F.lit("GET"), url).alias("path_sig"), S.request_signature(F.lit("GET"), url).alias("request_sig"))


_REASONS = list(S.SCORES)
_REASON_SQL = f"[{', '.join(repr(r) for r in _REASONS)}]"
_SCORE_SQL = f"[{', '.join(map(str, S.SCORES.values()))}]"


def _reason(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in _REASONS]), (n % len(_REASONS) + 1).cast("int"))


@registered(f"SELECT event_id, ({_REASON_SQL})[event_id % 12 + 1] AS reason, ({_SCORE_SQL})[event_id % 12 + 1]::DOUBLE AS confidence, round(value * 100)::DOUBLE / 100 AS rounded FROM events")
def confidence_rounding(spark, d):
    r = _reason(F.col("event_id"))
    return table(spark, d, "events").select("event_id", r.alias("reason"), S.confidence(r).alias("confidence"), S.round2(F.col("value")).alias("rounded"))


@registered(r"""
WITH p AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_size FROM part)
SELECT id, p_name || ', ' || p_type || ', ' || p_brand || ', size ' || p_size AS text_query, array_to_string(list_sort(list_distinct([lower(regexp_replace(p_brand, '^[^\p{L}\p{N}]+', '')), 'size ' || p_size, lower(p_type)])), '|') AS tokens, p_size > 25 AS has_street FROM p
""")
def name_query_parts(spark, d):
    p = table(spark, d, "part")
    null = F.lit(None).cast("string")
    quals = F.array(F.col("p_brand"), _text("size ", F.col("p_size")))
    street = F.when(F.col("p_size") > 25, F.lit(" x ")).otherwise(F.lit("  "))
    return p.select(
        F.col("p_partkey").alias("id"), S.text_query(F.col("p_name"), null, F.col("p_type"), null, null, quals).alias("text_query"),
        F.array_join(S.establishing_qualifiers(quals, F.col("p_type"), null, null, F.lit("!")), "|").alias("tokens"), S.has_street(street).alias("has_street"),
    )


# ---- records --------------------------------------------------------------------------------


def _order_json(d: str, spark: SparkSession) -> DataFrame:
    n = F.col("o_orderkey")
    good = _text('{"type":"Movie","name":"Order ', n, '","ids":[{"imdb":"tt', F.lpad((n + 1).cast("string"), 7, "0"), '"},{"wikidata":"https://www.wikidata.org/wiki/Q', F.col("o_custkey") + 1, '"}]}')
    bad = _pick(n, good, good, good, _text('{"ids":[{"myspace":"', n, '"}]}'), _text('{"ids":[{"imdb":"nm', n, '"}]}'), _text('{"ids":[{"imdb":"tt1","tmdb":"', n, '"}]}'), _text('{"ids": [', n), F.lit('{"name":"x"}'))
    return table(spark, d, "orders").select(n.alias("seq"), bad.alias("json"))


@registered("""
SELECT o_orderkey AS seq, 0 AS pos, 'imdb:tt' || lpad((o_orderkey + 1)::VARCHAR, 7, '0') AS key, 'identity' AS grain, 200 AS rank FROM orders WHERE o_orderkey % 8 < 3
UNION ALL SELECT o_orderkey, 1, 'wikidata:Q' || (o_custkey + 1), 'identity', 0 FROM orders WHERE o_orderkey % 8 < 3
""")
def ids_explode(spark, d):
    return records.parse(_order_json(d, spark)).ids.select("seq", "pos", "key", "grain", "rank")


@registered("SELECT o_orderkey AS seq, (['unknown_kind', 'invalid_value', 'element_without_one_entry', 'invalid_json', 'invalid_input'])[o_orderkey % 8 - 2] AS reject_reason FROM orders WHERE o_orderkey % 8 >= 3")
def parse_rejects(spark, d):
    return records.parse(_order_json(d, spark), need_ids=True).rejects.select("seq", "reject_reason")


def _ids(df: DataFrame, seq: Column, *pairs: tuple[str, Column]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in pairs])
    return df.select(seq.cast("long").alias("seq"), F.posexplode(rows).alias("pos", "i")).select("seq", "pos", F.col("i.kind").alias("kind"), F.col("i.value").alias("value"))


_LATE = 1 << 40


def _customer_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    phone = _text("+1 (2", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), ") 555-0100")
    return _ids(table(spark, d, "customer"), c, ("domain", _text("https://www.nation", F.col("c_nationkey"), ".com/")), ("wikidata", _text("Q", c + 1)), ("tmdb", _text(c + 1)), ("phone", phone))


def _order_ids(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    return _ids(table(spark, d, "orders"), n + _LATE, ("imdb", _text("tt", F.lpad((n + 1).cast("string"), 7, "0"))), ("wikidata", _text("Q", F.col("o_custkey") + 1)))


def crosswalk_batch(spark: SparkSession, d: str, *, loose: bool = False) -> records.Batch:
    """Customers (domain of the nation, item, film number, phone of the nation), then their orders; with ``loose``, suppliers by phone alone."""
    ids = _customer_ids(spark, d).unionByName(_order_ids(spark, d))
    s, nation = F.col("s_suppkey"), F.lpad((F.col("s_nationkey") + F.col("s_suppkey") % 3 * 20).cast("string"), 2, "0")
    if loose:
        ids = ids.unionByName(_ids(table(spark, d, "supplier"), s + 2 * _LATE, ("phone", _text("(2", nation, ") 555-0100"))))
    null = F.lit(None).cast("string")
    told = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("seq"), F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"), F.lit(4).cast("long").alias("harvested"), F.lit("customer").alias("source"))
    told = told.unionByName(table(spark, d, "orders").select((F.col("o_orderkey") + _LATE).alias("seq"), F.lit("Order").alias("entity_type"), null.alias("name"), F.lit(2).cast("long").alias("harvested"), F.lit("order").alias("source")))
    if loose:
        told = told.unionByName(table(spark, d, "supplier").select((s + 2 * _LATE).alias("seq"), null.alias("entity_type"), F.col("s_name").alias("name"), F.lit(1).cast("long").alias("harvested"), F.lit("supplier").alias("source")))
    return records.from_ids(ids, told)


@registered("SELECT 'wikidata:Q' || (c_custkey + 1) AS key, least('wikidata:Q' || (c_custkey + 1), 'tmdb:' || (c_custkey + 1), min('imdb:tt' || lpad((o_orderkey + 1)::VARCHAR, 7, '0'))) AS component, count(o_orderkey) + 2 AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def identity_components(spark, d):
    ids = crosswalk_batch(spark, d).ids.filter(F.col("grain") == K.IDENTITY)
    least = ids.groupBy("seq").agg(F.min("key").alias("least"))
    parts = connected_components(ids.join(least, "seq").select("key", "least"), "key", "least")
    return parts.groupBy("component").agg(F.min(F.when(F.col("node").startswith("wikidata:"), F.col("node"))).alias("key"), F.count(F.lit(1)).alias("n"))


@registered("SELECT o_custkey AS id, 'wikidata:Q' || (o_custkey + 1) AS anchor FROM orders GROUP BY o_custkey")
def anchor_selection(spark, d):
    o = table(spark, d, "orders")
    keys = o.select("o_custkey", F.explode(F.array(_text("imdb:tt", F.lpad((F.col("o_orderkey") + 1).cast("string"), 7, "0")), _text("domain:n", F.col("o_custkey"), ".com"), _text("yelp:b", F.col("o_custkey")), _text("wikidata:Q", F.col("o_custkey") + 1))).alias("key"))
    return keys.groupBy(F.col("o_custkey").alias("id")).agg(anchor().alias("anchor"))


_SET_SQL = f"""
WITH a AS (SELECT c_custkey, c_nationkey, c_name, c_mktsegment, 'wikidata:Q' || (c_custkey + 1) AS anchor FROM customer),
 i AS (SELECT *, {_cid_sql('anchor')} AS base FROM a),
 e AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '_' || (row_number() OVER w - 1) END AS canonical_id FROM i WINDOW w AS (PARTITION BY base ORDER BY anchor)),
 f AS (SELECT c_nationkey, min(c_custkey) AS first FROM customer GROUP BY ALL),
 n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL)
"""


@registered(f"{_SET_SQL} SELECT canonical_id, anchor, c_mktsegment AS entity_type, c_name AS name, 2 + (c_custkey = first)::BIGINT + coalesce(n, 0) AS n_keys, 1::BIGINT AS n_phones FROM e JOIN f USING (c_nationkey) LEFT JOIN n ON o_custkey = c_custkey")
def _resolve_set(spark, d):
    c = resolve_set(crosswalk_batch(spark, d))
    keys = c.nodes.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_keys"))
    phones = c.phone_edges.groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n_phones"))
    return c.entities.join(keys, "canonical_id", "left").join(phones, "canonical_id", "left")


QUERIES["resolve_set"], ORACLE_SQL["resolve_set"] = QUERIES.pop("_resolve_set"), ORACLE_SQL.pop("_resolve_set")  # the function of that name is the operator


@registered(f"{_SET_SQL} SELECT 'domain:nation' || c_nationkey || '.com' AS key, canonical_id, 'customer' AS source FROM e JOIN f USING (c_nationkey) WHERE c_custkey = first")
def domain_first_owner(spark, d):
    return resolve_set(crosswalk_batch(spark, d)).nodes.filter(F.col("key").startswith("domain:"))


_OUT_SQL = f"""{_SET_SQL},
 p AS (SELECT c_nationkey, count(*) AS entities FROM customer GROUP BY ALL)
SELECT c_custkey AS seq, canonical_id, 'new' AS status, 'new_public_anchor' AS reason, 0.6::DOUBLE AS confidence FROM e
UNION ALL SELECT o_orderkey + {_LATE}, canonical_id, 'hit', 'exact_strong_key', 0.95 FROM orders JOIN e ON o_custkey = c_custkey
UNION ALL SELECT s_suppkey + {2 * _LATE}, NULL, 'unresolved', CASE WHEN entities IS NULL THEN 'needs_stronger_identifier' WHEN entities = 1 THEN 'phone_only' ELSE 'ambiguous_among_n' END, CASE WHEN entities IS NULL THEN 0.15 WHEN entities = 1 THEN 0.3 ELSE 0.25 END
 FROM supplier LEFT JOIN p ON c_nationkey = s_nationkey + s_suppkey % 3 * 20
"""


@registered(_OUT_SQL)
def phone_only_refusal(spark, d):
    return resolve_set(crosswalk_batch(spark, d, loose=True)).outcomes.select("seq", "canonical_id", "status", "reason", "confidence")


@registered(f"""{_SET_SQL},
 p AS (SELECT c_nationkey, count(*) AS entities FROM customer GROUP BY ALL)
SELECT c_custkey AS seq, anchor, 'new' AS status, 'new_public_anchor' AS reason, CASE WHEN c_custkey = first THEN '' ELSE 'domain (shared affiliation; distinct entity)|phone (corroborating)' END AS matched_via, 3 + (c_custkey = first)::BIGINT AS new_edges, 0::BIGINT AS n_candidates FROM e JOIN f USING (c_nationkey)
UNION ALL SELECT o_orderkey + {_LATE}, anchor, 'hit', 'exact_strong_key', 'wikidata', 1, 0 FROM orders JOIN e ON o_custkey = c_custkey
UNION ALL SELECT s_suppkey + {2 * _LATE}, '', 'unresolved', CASE WHEN entities IS NULL THEN 'needs_stronger_identifier' WHEN entities = 1 THEN 'phone_only' ELSE 'ambiguous_among_n' END, '', 0, coalesce(entities, 0)
 FROM supplier LEFT JOIN p ON c_nationkey = s_nationkey + s_suppkey % 3 * 20
""")
def exact_fold(spark, d):
    out = resolve_exact(crosswalk_batch(spark, d, loose=True), listed=False).outcomes
    return out.select("seq", "anchor", "status", "reason", F.array_join("matched_via", "|").alias("matched_via"), "new_edges", "n_candidates")


@registered(f"""{_SET_SQL}
SELECT c_custkey AS seq, 'new' AS status, 0.6::DOUBLE AS confidence, anchor, c_name AS name, 'customer' AS source, 4::BIGINT AS harvested FROM e
UNION ALL SELECT o_orderkey + {_LATE}, 'hit', 0.95, anchor, c_name, 'customer', 2 FROM orders JOIN e ON o_custkey = c_custkey
""")
def wire_document(spark, d):
    c = resolve_exact(crosswalk_batch(spark, d))
    out = documents.wire_documents(c.outcomes, store.empty(spark).with_clusters(c), "resolve")
    j = lambda path, kind="string": F.get_json_object("document", path).cast(kind)
    source = F.from_json(F.get_json_object("document", "$.provenance"), "map<string,string>")[j("$.anchor")]
    return out.select("seq", j("$.status").alias("status"), j("$.confidence", "double").alias("confidence"), j("$.anchor").alias("anchor"), j("$.name").alias("name"), source.alias("source"), j("$.harvested", "long").alias("harvested"))


# ---- store ----------------------------------------------------------------------------------


def _snapshot(spark: SparkSession, d: str) -> store.Snapshot:
    """Customers as entities c<key>; their orders, items and nation's phone as keys."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    s = store.empty(spark)
    s.entities = c.select(_text("c", F.col("c_custkey")).alias("canonical_id"), _text("wikidata:Q", F.col("c_custkey") + 1).alias("anchor"), F.col("c_mktsegment").alias("entity_type"), F.col("c_name").alias("name"))
    own = c.select(_text("wikidata:Q", F.col("c_custkey") + 1).alias("key"), _text("c", F.col("c_custkey")).alias("canonical_id"), F.lit("hub").alias("source"))
    s.nodes = own.unionByName(o.select(_text("tmdb:", F.col("o_orderkey") + 1).alias("key"), _text("c", F.col("o_custkey")).alias("canonical_id"), F.lit("input").alias("source")))
    s.phone_edges = c.select(_text("phone:+1", F.col("c_nationkey") + 2000000000).alias("phone_key"), _text("c", F.col("c_custkey")).alias("canonical_id"), F.lit(None).cast("string").alias("source"))
    return s


@registered("SELECT l_orderkey AS id, l_linenumber AS line, 'c' || o_custkey || '|' || coalesce('c' || c_custkey, '-') AS found, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = l_partkey GROUP BY ALL")
def find_many(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(_text("tmdb:", F.col("l_orderkey") + 1), _text("wikidata:Q", F.col("l_partkey") + 1)).alias("keys"))
    found = store.find_many(own, _snapshot(spark, d))
    return found.groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.array_join("found", "|", "-").alias("found")).agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT 'phone:+1' || (n_nationkey + 2000000000) AS phone_key, coalesce(string_agg('c' || c_custkey, '|' ORDER BY 'c' || c_custkey), '') AS owners FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def find_phone(spark, d):
    phones = table(spark, d, "nation").select(_text("phone:+1", F.col("n_nationkey") + 2000000000).alias("phone_key"))
    return store.find_phone(phones, _snapshot(spark, d)).select("phone_key", F.array_join("canonical_ids", "|").alias("owners"))


_MEMBERS_SQL = """
WITH k AS (SELECT 'wikidata:Q' || (c_custkey + 1) AS key, 'c' || c_custkey AS canonical_id, 'hub' AS source FROM customer
 UNION ALL SELECT 'tmdb:' || (o_orderkey + 1), 'c' || o_custkey, 'input' FROM orders
 UNION ALL SELECT 'phone:+1' || (c_nationkey + 2000000000), 'c' || c_custkey, NULL FROM customer)
"""


@registered(f"{_MEMBERS_SQL} SELECT canonical_id, string_agg(key || '=' || coalesce(source, ''), '|' ORDER BY key) AS sources FROM k GROUP BY ALL")
def member_sources(spark, d):
    own = store.member_sources(_snapshot(spark, d))
    return own.select("canonical_id", F.array_join(F.transform("sources", lambda s: F.concat(s["key"], F.lit("="), F.coalesce(s["source"], F.lit("")))), "|").alias("sources"))


@registered(f"{_MEMBERS_SQL} SELECT canonical_id, string_agg(key, '|' ORDER BY split_part(key, ':', 1), substr(key, strpos(key, ':') + 1)) AS members FROM k GROUP BY ALL")
def members(spark, d):
    own = store.members(_snapshot(spark, d))
    return own.select("canonical_id", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["kind"], m["value"])), "|").alias("members"))


@registered(f"{_MEMBERS_SQL} SELECT 'c' || c_custkey AS canonical_id, c_name AS name, 'direct_lookup' AS reason, 1.0::DOUBLE AS confidence, (SELECT count(*) FROM k WHERE k.canonical_id = 'c' || c_custkey) AS n FROM customer UNION ALL SELECT 'x' || s_suppkey, NULL, NULL, NULL, NULL FROM supplier")
def load_entity(spark, d):
    ids = table(spark, d, "customer").select(_text("c", F.col("c_custkey")).alias("canonical_id")).unionByName(table(spark, d, "supplier").select(_text("x", F.col("s_suppkey")).alias("canonical_id")))
    full, missing = store.load_entities(ids, _snapshot(spark, d))
    null = F.lit(None)
    return full.select("canonical_id", "name", "reason", "confidence", F.size("members").cast("long").alias("n")).unionByName(
        missing.select("canonical_id", null.cast("string").alias("name"), null.cast("string").alias("reason"), null.cast("double").alias("confidence"), null.cast("long").alias("n"))
    )


@registered("SELECT 'c' || c_custkey AS canonical_id, 1 + count(o_orderkey) AS strong_keys FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def strong_key_count(spark, d):
    return store.strong_key_count(_snapshot(spark, d))


@registered("""
WITH n AS (SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS last, max(o_orderkey) FILTER (o_orderkey % 3 <> 0) AS told FROM orders GROUP BY ALL)
SELECT 'wikidata:Q' || (c_custkey + 1) AS key, coalesce('n' || last, 'c' || c_custkey) AS canonical_id, coalesce('o' || told, 'hub') AS source FROM customer LEFT JOIN n ON o_custkey = c_custkey
""")
def upsert_nodes(spark, d):
    old = _snapshot(spark, d).nodes.filter(F.col("key").startswith("wikidata:"))
    n = F.col("o_orderkey")
    log = table(spark, d, "orders").select(n.alias("seq"), _text("wikidata:Q", F.col("o_custkey") + 1).alias("key"), _text("n", n).alias("canonical_id"), F.when(n % 3 != 0, _text("o", n)).alias("source"))
    return store.attach(old, log)


@registered("SELECT 'phone:+1' || (c_nationkey + 2000000000) AS phone_key, 'c' || c_custkey AS canonical_id, NULL::VARCHAR AS source FROM customer UNION ALL SELECT 'phone:+19', 'c' || o_custkey, 'o' || min(o_orderkey) FROM orders GROUP BY o_custkey")
def insert_phones(spark, d):
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("phone:+19").alias("phone_key"), _text("c", F.col("o_custkey")).alias("canonical_id"), _text("o", F.col("o_orderkey")).alias("source"))
    s = _snapshot(spark, d)
    again = s.phone_edges.select(F.lit(0).cast("long").alias("seq"), "phone_key", "canonical_id", F.lit("again").alias("source"))
    return store.insert_or_ignore(s.phone_edges, new.unionByName(again), ["phone_key", "canonical_id"])


@registered("""
WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 10 < 3 THEN c_custkey - c_custkey % 10 ELSE c_custkey END AS w FROM customer)
SELECT 'c' || w AS canonical_id, count(DISTINCT m.c_custkey) + count(o_orderkey) AS keys, count(DISTINCT c.c_nationkey) AS phones FROM m JOIN customer c USING (c_custkey) LEFT JOIN orders ON o_custkey = m.c_custkey GROUP BY w
""")
def merge_repoint(spark, d):
    c = F.col("c_custkey")
    moves = table(spark, d, "customer").filter((c % 10 > 0) & (c % 10 < 3)).select(_text("c", c).alias("loser"), _text("c", c - c % 10).alias("winner"))
    s = store.repointed(_snapshot(spark, d), moves)
    n = lambda df, name: df.groupBy("canonical_id").agg(F.count(F.lit(1)).alias(name))
    return s.entities.select("canonical_id").join(n(s.nodes, "keys"), "canonical_id", "left").join(n(s.phone_edges, "phones"), "canonical_id", "left")


@registered("SELECT NULL::VARCHAR AS what, NULL::VARCHAR AS which WHERE false")
def invariants(spark, d):
    c = resolve_exact(crosswalk_batch(spark, d))
    s = store.empty(spark)
    return store.violations(s.with_clusters(c))


@registered("""
SELECT 'key with two owners' AS what, 'wikidata:Q' || (s_suppkey + 1) AS which FROM supplier JOIN customer ON c_custkey = s_suppkey
UNION ALL SELECT 'owner does not exist', 'yelp:n' || n_nationkey FROM nation UNION ALL SELECT 'anchor not owned', 'r' || r_regionkey FROM region
""")
def planted_violations(spark, d):
    s, null = _snapshot(spark, d), F.lit(None).cast("string")
    sup, nation, region = F.col("s_suppkey"), F.col("n_nationkey"), F.col("r_regionkey")
    own = table(spark, d, "customer").select(_text("c", F.col("c_custkey")).alias("canonical_id"))
    twice = table(spark, d, "supplier").select(_text("wikidata:Q", sup + 1).alias("key"), _text("c", sup + 1).alias("canonical_id"), null.alias("source")).join(own, "canonical_id", "left_semi").select("key", "canonical_id", "source")
    orphans = table(spark, d, "nation").select(_text("yelp:n", nation).alias("key"), _text("gone", nation).alias("canonical_id"), null.alias("source"))
    s.nodes = s.nodes.unionByName(twice).unionByName(orphans)
    s.entities = s.entities.unionByName(table(spark, d, "region").select(_text("r", region).alias("canonical_id"), _text("domain:r", region, ".com").alias("anchor"), null.alias("entity_type"), null.alias("name")))
    return store.violations(s)


@registered("SELECT 'c' || c_custkey AS canonical_id, 'wikidata:Q' || (c_custkey + 1) AS anchor, c_name AS name FROM customer UNION ALL SELECT 'x' || s_suppkey, NULL, NULL FROM supplier")
def get_entity(spark, d):
    ids = table(spark, d, "customer").select(_text("c", F.col("c_custkey")).alias("canonical_id")).unionByName(table(spark, d, "supplier").select(_text("x", F.col("s_suppkey")).alias("canonical_id")))
    return store.get_entity(ids, _snapshot(spark, d)).select("canonical_id", "anchor", "name")


@registered("""
WITH n AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey ELSE 'n' || o_orderkey % 500 END AS id, o_orderkey FROM orders)
SELECT 'c' || c_custkey AS canonical_id, 'wikidata:Q' || (c_custkey + 1) AS anchor, c_name AS name FROM customer
UNION ALL SELECT id, 'tmdb:' || (min(o_orderkey) + 1), 'o' || min(o_orderkey) FROM n WHERE id NOT IN (SELECT 'c' || c_custkey FROM customer) GROUP BY id
""")
def create_entities(spark, d):
    n = F.col("o_orderkey")
    cid = F.when(n % 2 == 0, _text("c", F.col("o_custkey"))).otherwise(_text("n", n % 500))
    new = table(spark, d, "orders").select(n.alias("seq"), cid.alias("canonical_id"), _text("tmdb:", n + 1).alias("anchor"), F.lit(None).cast("string").alias("entity_type"), _text("o", n).alias("name"))
    return store.insert_or_ignore(_snapshot(spark, d).entities, new, ["canonical_id"]).select("canonical_id", "anchor", "name")


@registered("SELECT 'c' || c_custkey AS canonical_id, CASE WHEN c_custkey % 3 = 0 THEN 'imdb:tt' || c_custkey ELSE 'wikidata:Q' || (c_custkey + 1) END AS anchor FROM customer")
def set_anchors(spark, d):
    c = F.col("c_custkey")
    new = table(spark, d, "customer").filter(c % 3 == 0).select(_text("c", c).alias("canonical_id"), _text("imdb:tt", c).alias("anchor"))
    return store.set_anchors(_snapshot(spark, d).entities, new).select("canonical_id", "anchor")


@registered("SELECT 'c' || c_custkey AS canonical_id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'told' END ELSE c_mktsegment END AS entity_type, c_name AS name FROM customer")
def enrich_entities(spark, d):
    c, s = F.col("c_custkey"), _snapshot(spark, d)
    some = s.entities.withColumn("entity_type", F.when(F.substring("canonical_id", 2, 20).cast("long") % 2 != 0, F.col("entity_type")))
    told = table(spark, d, "customer").filter(c % 3 == 0).select(_text("c", c).alias("canonical_id"), F.lit("told").alias("entity_type"), F.lit("other").alias("name"))
    return store.enrich(some, told).select("canonical_id", "entity_type", "name")


@registered("""
SELECT o_orderkey AS seq, 'hit' AS status_tag, 'exact_strong_key' AS reason_tag, 'imdb,tmdb' AS matched_via, 0.95::DOUBLE AS confidence,
 CASE o_orderkey % 4 WHEN 0 THEN 'imdb:tt' || o_orderkey WHEN 1 THEN 'phone' WHEN 2 THEN 'name' ELSE 'record' END AS input_desc FROM orders
""")
def log_resolutions(spark, d):
    n = F.col("o_orderkey")
    out = table(spark, d, "orders").select(n.alias("seq"), F.lit("hit").alias("status"), F.lit("exact_strong_key").alias("reason"), F.array(F.lit("imdb"), F.lit("tmdb")).alias("matched_via"), S.confidence(F.lit("exact_strong_key")).alias("confidence"))
    said = S.input_description(_pick(F.col("seq"), F.lit("imdb"), F.lit("phone"), F.lit("name"), F.lit("record")), _text("tt", F.col("seq")))
    return store.log_resolutions(_snapshot(spark, d).resolutions, out, said)


@registered("""
SELECT 'c' || c_custkey AS canonical_id, CASE WHEN c_custkey % 4 <> 0 THEN 'wikidata:Q' || (c_custkey + 1) ELSE coalesce(min('tmdb:' || (o_orderkey + 1)), 'none') END AS anchor
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def reanchor(spark, d):
    s = _snapshot(spark, d)
    s.entities = s.entities.withColumn("anchor", F.lit("none"))
    s.nodes = s.nodes.filter(~F.col("key").startswith("wikidata:") | (F.substring("canonical_id", 2, 20).cast("long") % 4 != 0))
    return store.reanchored(s).entities.select("canonical_id", "anchor")


@registered("""
SELECT count(*) AS total, (SELECT count(*) FROM customer) AS entities, (SELECT count(*) FROM customer) * 2 + (SELECT count(*) FROM orders) AS edges FROM events
""")
def graph_size(spark, d):
    s = _snapshot(spark, d)
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("miss").alias("status_tag"), _reason(F.col("event_id")).alias("reason_tag"))
    s.resolutions = store.with_columns(spark, log, store.RESOLUTIONS)
    return stats.report(s).select("total", "entities", "edges")


# ---- corrections ----------------------------------------------------------------------------


@registered("""
SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'already_linked' WHEN 1 THEN CASE WHEN c.c_custkey IS NULL THEN 'conflict' WHEN c.c_custkey = o_custkey THEN 'self' ELSE 'conflict' END
 WHEN 2 THEN 'attached' WHEN 3 THEN 'created' WHEN 4 THEN 'invalid' ELSE 'self' END AS outcome
FROM orders LEFT JOIN customer c ON c.c_custkey = o_orderkey
""")
def link_outcome(spark, d):
    n = F.col("o_orderkey")
    mine, other = _text("wikidata:Q", F.col("o_custkey") + 1), _text("wikidata:Q", n + 1)
    b = _pick(n, _text("tmdb:", n + 1), other, _text("yelp:new-", n), _text("yelp:new-", n), _text("phone:+1", n), mine)
    a = F.when(n % 6 == 3, _text("imdb:tt", n)).otherwise(mine)
    pairs = table(spark, d, "orders").select(n.alias("id"), a.alias("a"), b.alias("b"))
    return corrections.link_outcomes(pairs, _snapshot(spark, d)).select("id", "outcome")


@registered("SELECT c_custkey AS grp FROM customer WHERE c_custkey % 4 = 1")
def conflict_guard(spark, d):
    c = F.col("c_custkey")
    key = _pick(c, _text("imdb:tt1"), _text("wikidata:Q1"), _text("domain:a.com"), _text("wikidata:Q7"))
    other = _pick(c, _text("wikidata:Q1"), _text("wikidata:Q2"), _text("domain:b.com"), _text("wikidata:Q7"))
    rows = table(spark, d, "customer")
    sides = rows.select(c.alias("grp"), F.lit("a").alias("side"), key.alias("key")).unionByName(rows.select(c.alias("grp"), F.lit("b").alias("side"), other.alias("key")))
    return corrections.same_kind_conflicts(sides)


@registered("""
WITH g AS (SELECT o_custkey // 3 AS grp, o_custkey FROM orders GROUP BY ALL)
SELECT grp, arg_min('c' || o_custkey, CASE o_custkey % 3 WHEN 0 THEN 200 WHEN 1 THEN 2 ELSE 3 END) AS winner FROM g GROUP BY grp
""")
def merge_winner(spark, d):
    k = F.col("o_custkey")
    own = table(spark, d, "orders").select(k).distinct()
    groups = own.select(F.floor(k / 3).alias("grp"), _text("c", k).alias("canonical_id"))
    entities = own.select(_text("c", k).alias("canonical_id"), _pick(k, _text("imdb:tt", k), _text("domain:d", k, ".com"), _text("google_place_id:p", k)).alias("anchor"))
    return corrections.winners(groups, entities)


_NODES_SQL = "SELECT 'wikidata:Q' || (c_custkey + 1) AS key, 'c' || c_custkey AS canonical_id, 'hub' AS source FROM customer UNION ALL SELECT 'tmdb:' || (o_orderkey + 1), 'c' || o_custkey, 'input' FROM orders"


@registered(f"""
WITH n AS ({_NODES_SQL}) SELECT key, CASE canonical_id WHEN 'c3' THEN 'c2' ELSE canonical_id END AS canonical_id, source FROM n UNION ALL SELECT 'yelp:new', 'c0', 'link'
UNION ALL SELECT k, {_cid_sql("('yelp:other')")}, 'link' FROM (SELECT unnest(['imdb:tt77', 'yelp:other']) AS k)
""")
def link_states(spark, d):
    s, cid, outcome = corrections.link(_snapshot(spark, d), "wikidata:Q1", "yelp:new")
    assert (cid, outcome) == ("c0", "attached")
    s, _, outcome = corrections.link(s, "yelp:other", "imdb:tt77")
    assert outcome == "created"
    s, cid, outcome = corrections.link(s, "wikidata:Q4", "wikidata:Q3", force=True)
    assert (cid, outcome) == ("c2", "merged")
    return s.nodes


@registered(f"WITH n AS ({_NODES_SQL}) SELECT key, CASE key WHEN 'tmdb:1' THEN {_cid_sql("('tmdb:1')")} ELSE canonical_id END AS canonical_id, source FROM n")
def split_state(spark, d):
    return corrections.split(_snapshot(spark, d), ["tmdb:1"])[0].nodes


@registered("""
WITH e AS (SELECT CASE WHEN c_custkey < 3 THEN 0 ELSE c_custkey END AS w, c_custkey, c_name, c_mktsegment FROM customer)
SELECT 'c' || w AS canonical_id, 'wikidata:Q' || (w + 1) AS anchor, arg_min(c_name, c_custkey) FILTER (w > 0 OR c_custkey = 1) AS name, arg_min(c_mktsegment, c_custkey) FILTER (w > 0 OR c_custkey = 1) AS entity_type,
 count(*) + sum((SELECT count(*) FROM orders WHERE o_custkey = c_custkey))::BIGINT AS keys FROM e GROUP BY w
""")
def merge_state(spark, d):
    s = _snapshot(spark, d)
    bare = F.col("canonical_id") == "c0"
    s.entities = s.entities.withColumns({c: F.when(~bare, F.col(c)) for c in ("name", "entity_type")})
    out, winner = corrections.merge(s, ["c0", "c1", "c2"], force=True)
    assert winner == "c0"
    return out.entities.join(store.strong_key_count(out).withColumnRenamed("strong_keys", "keys"), "canonical_id")


# ---- names ----------------------------------------------------------------------------------


def _named(spark: SparkSession, d: str) -> store.Snapshot:
    """Parts under the first word of their type, with brand and size as qualifiers."""
    p = table(spark, d, "part")
    s = store.empty(spark)
    cid = _text("p", F.col("p_partkey"))
    s.entities = p.select(cid.alias("canonical_id"), _text("tmdb:", F.col("p_partkey") + 1).alias("anchor"), F.lit("Part").alias("entity_type"), F.col("p_name").alias("name"))
    quals = F.when(F.col("p_partkey") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(N.name_key(F.col("p_brand")), _text("size ", F.col("p_size"))))
    s.name_index = store.index_names(s.name_index, p.select(N.name_key(F.col("p_type")).alias("name_norm"), quals.alias("qualifiers"), cid.alias("canonical_id"), F.lit("x").alias("source")))
    return s


def _name_queries(spark: SparkSession, d: str) -> DataFrame:
    """For each part a query for its type: bare, by brand, by brand and size, or by more than that."""
    k, null = F.col("p_partkey"), F.lit(None).cast("string")
    size = _text("Size ", F.col("p_size"))
    quals = _pick(k, F.array().cast("array<string>"), F.array("p_brand"), F.array(F.col("p_brand"), size), F.array(F.col("p_brand"), size, F.lit("red!")), F.array(F.lit("nowhere")))
    name = F.when(k % 11 == 5, F.lit(" !! ")).otherwise(F.upper("p_type"))
    return table(spark, d, "part").select(k.cast("long").alias("query_id"), name.alias("name"), quals.alias("qualifiers"), null.alias("street"), null.alias("city"), null.alias("region"), null.alias("country"))


_NAMED_SQL = r"""
WITH e AS (SELECT p_partkey AS k, lower(p_type) AS name, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE [lower(p_brand), 'size ' || p_size] END AS s FROM part),
 q AS (SELECT p_partkey AS query_id, CASE WHEN p_partkey % 11 = 5 THEN '' ELSE lower(p_type) END AS name,
   CASE p_partkey % 5 WHEN 0 THEN [] WHEN 1 THEN [lower(p_brand)] WHEN 2 THEN [lower(p_brand), 'size ' || p_size] WHEN 3 THEN [lower(p_brand), 'size ' || p_size, 'red'] ELSE ['nowhere'] END AS q FROM part),
 m AS (SELECT query_id, count(*) FILTER (len(q) = 0 OR list_has_all(q, s)) AS inside, min('p' || k) FILTER (len(q) = 0 OR list_has_all(q, s)) AS one, count(*) FILTER (list_has_any(q, s)) AS near FROM q JOIN e USING (name) GROUP BY ALL)
"""


@registered(f"""{_NAMED_SQL}
SELECT query_id, CASE WHEN inside = 1 THEN one END AS canonical_id, CASE WHEN inside = 1 THEN 'local_name_match' WHEN inside > 1 OR near >= 2 THEN 'ambiguous_among_n' ELSE 'needs_stronger_identifier' END AS reason,
 (CASE WHEN inside > 1 THEN inside WHEN inside = 0 AND near >= 2 THEN near ELSE 0 END)::BIGINT AS n_candidates FROM q LEFT JOIN m USING (query_id)
""")
def name_local_match(spark, d):
    return names.resolve_names(_name_queries(spark, d), _named(spark, d), listed=False).select("query_id", "canonical_id", "reason", "n_candidates")


@registered(f"{_NAMED_SQL} SELECT query_id, coalesce(inside, 0)::BIGINT AS n FROM q LEFT JOIN m USING (query_id)")
def find_by_name(spark, d):
    return names.count_by_name(_name_queries(spark, d), _named(spark, d).name_index)


@registered("""
WITH l AS (SELECT user_id, arg_max(event_id, event_id) AS last FROM events GROUP BY ALL), w AS (SELECT l.user_id, last, event_type = 'purchase' AS u FROM l JOIN events ON event_id = last)
SELECT 'user ' || user_id AS name_norm, CASE WHEN u THEN 'unique' ELSE 'ambiguous' END AS status, CASE WHEN u THEN 'c' || (last % 2000) END AS canonical_id, CASE WHEN u THEN '' ELSE 'c' || last END AS candidates
FROM w WHERE NOT u OR last % 2000 < (SELECT count(*) FROM customer)
""")
def name_cardinality(spark, d):
    e = F.col("event_id")
    unique = F.col("event_type") == "purchase"
    listed = F.when(~unique, F.array(F.struct(_text("c", e).alias("canonical_id"), F.lit("a").alias("anchor"), F.lit(None).cast("string").alias("name"))))
    log = table(spark, d, "events").select(e.alias("seq"), _text("user ", F.col("user_id")).alias("name_norm"), F.array(F.lit("x")).alias("qualifiers"), listed.alias("candidates"), _text("c", e % 2000).alias("canonical_id"))
    s = _snapshot(spark, d)
    memory = store.cardinality(store.record_cardinality(s.name_cardinality, log), s.entities)
    return memory.select("name_norm", "status", "canonical_id", F.array_join(F.transform("candidates", lambda c: c["canonical_id"]), "|").alias("candidates"))


# ---- pages and hubs -------------------------------------------------------------------------


@registered("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'article' ELSE 'Movie' END AS entity_type, CASE WHEN page_id % 3 = 0 THEN 'T & ' || page_id ELSE 'Film ' || page_id END AS name,
 'domain:' || array_to_string(list_slice(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.'), -2, -1), '.') || CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN '|phone:+12025550100|imdb:tt' || (page_id + 1) || '|wikidata:Q' || (page_id + 1) || '|domain:other.co.uk' ELSE '|domain:site' || page_id || '.org' END || '|domain:canon.net' AS ids
FROM pages
""")
def harvest_page(spark, d):
    n = F.col("page_id")
    one = _text('{"@type":"Movie","name":"Film ', n, '","telephone":"(202) 555-0100","', pages.LINKS, '":["https://www.imdb.com/title/tt', n + 1, '/","https://www.facebook.com/x","https://www.wikidata.org/wiki/Q', n + 1, '","https://a.other.co.uk/x"]}')
    graph = _text('{"@graph":[{"@type":"Movie","name":"Film ', n, '","url":"https://site', n, '.org/a","', pages.LINKS, '":"https://twitter.com/y"}],"@type":"Page","name":"no"}')
    block = F.when(n % 3 == 0, F.lit("{bad json")).when(n % 3 == 1, one).otherwise(graph)
    head = F.concat(F.lit("<head><script type='application/ld+json'>"), block, F.lit("</script><meta content='article' property='og:type'><meta property=\"og:title\" content=\"T &amp; "), n.cast("string"), F.lit('"><link rel="canonical" href="https://www.canon.net/p">'))
    own = table(spark, d, "pages").select("page_id", F.col("url").alias("domain"), F.replace(F.col("html"), F.lit("<head>"), head).alias("html"))
    out = pages.harvested(own)
    return out.select("page_id", "entity_type", "name", F.array_join(F.transform("ids", lambda i: F.concat_ws(":", i["kind"], i["value"])), "|").alias("ids"))


def _hub_table(spark: SparkSession, d: str) -> DataFrame:
    """Answers for every customer: the item's film id, number and site; the film's links."""
    c = _spread(table(spark, d, "customer").select("c_custkey"))
    n = F.col("c_custkey") + 1
    film = F.concat(F.lit("tt"), F.lpad(n.cast("string"), 7, "0"))
    wiki = c.select(F.lit("GET").alias("method"), hubs.wikidata_query(F.lit("imdb"), film).alias("url"), _text('{"results":{"bindings":[{"item":{"value":"http://www.wikidata.org/entity/Q', n, '"},"website":{"value":"https://film', n, '.com/"},"imdb":{"value":"', film, '"}}]}}').alias("response"))
    found = c.select(F.lit("GET").alias("method"), _text(f"{hubs.TMDB}/find/", film, "?external_source=imdb_id&api_key=k").alias("url"), _text('{"movie_results":[{"id":', n, ',"title":"Film ', n, '"}]}').alias("response"))
    links = c.select(F.lit("GET").alias("method"), _text(f"{hubs.TMDB}/movie/", n, "/external_ids").alias("url"), _text('{"imdb_id":"', film, '","wikidata_id":"Q', n, '"}').alias("response"))
    return hubs.responses(wiki.unionByName(found).unionByName(links))


@registered("SELECT c_custkey AS seq, 'wikidata:Q' || (c_custkey + 1) AS anchor, 'hub_crosswalk' AS reason, 0.9::DOUBLE AS confidence, 4::BIGINT AS new_edges, 'Film ' || (c_custkey + 1) AS name FROM customer")
def hub_complete(spark, d):
    ids = _ids(_spread(table(spark, d, "customer").select("c_custkey")), F.col("c_custkey"), ("imdb", _text("tt", F.lpad((F.col("c_custkey") + 1).cast("string"), 7, "0"))))
    out = complete(records.from_ids(ids), _hub_table(spark, d), store.empty(spark))[1]
    return out.select("seq", "anchor", "reason", "confidence", "new_edges", "name")


@registered("""
SELECT c_custkey AS id, 'wikidata:Q' || (c_custkey + 1) || '|imdb:tt' || lpad((c_custkey + 1)::VARCHAR, 7, '0') || '|domain:https://film' || (c_custkey + 1) || '.com/' AS wikidata, (c_custkey + 1)::VARCHAR AS movie FROM customer
""")
def hub_lookup(spark, d):
    c, table_ = table(spark, d, "customer"), _hub_table(spark, d)
    film = F.concat(F.lit("tt"), F.lpad((F.col("c_custkey") + 1).cast("string"), 7, "0"))
    ask = lambda url: hubs.answered(c.select(F.col("c_custkey").alias("id"), F.lit("GET").alias("method"), url.alias("url")), table_)
    wiki = ask(hubs.wikidata_query(F.lit("imdb"), film)).select("id", F.array_join(F.transform(hubs.wikidata_ids(F.col("response")), lambda i: F.concat_ws(":", i["kind"], F.regexp_replace(i["value"], "^http://www.wikidata.org/entity/", ""))), "|").alias("wikidata"))
    movie = ask(_text(f"{hubs.TMDB}/find/", film, "?other=1")).select("id", hubs.tmdb_movie(F.col("response"))["id"].alias("movie"))
    return wiki.join(movie, "id")


@registered("""
SELECT c_custkey AS id, 'domain=https://p' || c_custkey || '.com|phone=' || CASE WHEN c_custkey % 2 = 0 THEN '+1 202 555 0100' ELSE '(202) 555-0100' END AS details, 'Place ' || c_custkey AS name,
 CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'P' || c_custkey ELSE 'P' || c_custkey || '|R' || c_custkey END AS places, CASE WHEN c_custkey % 2 = 0 THEN 'pk-' || c_custkey END AS placekey FROM customer
""")
def hub_parsers(spark, d):
    n = F.col("c_custkey")
    phone = F.when(n % 2 == 0, F.lit('"internationalPhoneNumber":"+1 202 555 0100","nationalPhoneNumber":"0"')).otherwise(F.lit('"nationalPhoneNumber":"(202) 555-0100"'))
    details = F.concat(_text('{"id":"P', n, '","displayName":{"text":"Place ', n, '","languageCode":"en"},"websiteUri":"https://p', n, '.com",'), phone, F.lit("}"))
    pairs = F.array_join(F.transform(hubs.place_ids(details), lambda i: F.concat_ws("=", i["kind"], i["value"])), "|")
    key = F.when(n % 2 == 0, _text('{"placekey":"pk-', n, '"}')).otherwise(F.lit('{"query_id":"1"}'))
    return table(spark, d, "customer").select(n.alias("id"), pairs.alias("details"), hubs.place_name(details).alias("name"), F.array_join(hubs.found_places(_places(n)), "|").alias("places"), hubs.found_placekey(key).alias("placekey"))


def _places(n: Column) -> Column:
    """A text search's answer: no place, one or two."""
    return _pick(n, F.lit("{}"), _text('{"places":[{"id":"P', n, '"}]}'), _text('{"places":[{"id":"P', n, '"},{"id":"R', n, '"}]}'))


@registered("""
SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'needs_stronger_identifier' WHEN 1 THEN 'place_unique_match' ELSE 'ambiguous_among_n' END AS reason,
 CASE c_custkey % 3 WHEN 2 THEN 'google_place_id:P' || c_custkey || '|google_place_id:R' || c_custkey ELSE '' END AS candidates FROM customer
""")
def hub_names(spark, d):
    null = F.lit(None).cast("string")
    n = F.col("c_custkey")
    asked = table(spark, d, "customer").select(n.alias("query_id"), F.col("c_name").alias("name"), F.array(F.lit("town")).alias("qualifiers"), *[null.alias(c) for c in ("street", "city", "region", "country")])
    answers = hubs.responses(hubs.search_requests(asked).select("method", "url", _places(F.col("query_id")).alias("response")))
    out = resolve_by_name(asked, answers, store.empty(spark))[1]
    return out.select("query_id", "reason", F.array_join(F.transform("candidates", lambda c: c["anchor"]), "|").alias("candidates"))


@registered("SELECT count(*) + 1 AS records, count(*) AS \"new\", 0::BIGINT AS hit, 0::BIGINT AS unresolved, 1::BIGINT AS rejected FROM nation")
def seed_folder(spark, d):
    """One file for each nation, and one that is no JSON, read back in the order of their paths."""
    n = F.col("n_nationkey")
    own = table(spark, d, "nation").select(F.concat(F.lit("nation="), n.cast("string")).alias("file"), _text('{"name":"', F.col("n_name"), '","ids":[{"wikidata":"Q', n + 1, '"}]}').alias("json"))
    folder = f"{shared_dir(spark)}/seeds-{uuid.uuid4().hex}"
    rows = own.unionByName(spark.createDataFrame([("z", "{no json")], own.schema))
    rows.repartition(64, "file").write.partitionBy("file").text(folder)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)):
        for f in fs.listStatus(part.getPath()) if part.isDirectory() else []:
            fs.rename(f.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part.getPath().getName().replace('=', '-')}.json"))
    batch = records.parse(records.seed_files(spark, folder).withColumn("json", F.rtrim(F.regexp_replace("json", "\n", ""))))
    return records.ingest_summary(resolve_exact(batch).outcomes, batch.rejects)


# ---- statistics -----------------------------------------------------------------------------

_LOG_SQL = f"WITH l AS (SELECT event_id, user_id, ts, ({_REASON_SQL})[(event_id * 7 + user_id) % 12 + 1] AS r FROM events)"
_MISS_SQL = "r NOT IN ('direct_lookup', 'exact_strong_key', 'new_public_anchor', 'synthetic_strong_key', 'hub_crosswalk', 'placekey_address', 'placekey_city_only', 'place_unique_match', 'local_name_match')"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "ts", _reason(F.col("event_id") * 7 + F.col("user_id")).alias("reason_tag"))


@registered(f"{_LOG_SQL} SELECT r AS reason_tag, count(*) AS n FROM l GROUP BY ALL")
def reason_histogram(spark, d):
    return stats.ordered(stats.by_reason(_log(spark, d)))


@registered(f"""{_LOG_SQL}, t AS (SELECT count(*) AS total, count(*) FILTER (r IN ('direct_lookup', 'exact_strong_key', 'new_public_anchor', 'synthetic_strong_key')) AS exact, count(*) FILTER ({_MISS_SQL}) AS miss FROM l)
SELECT total, exact, total - exact - miss AS hub, miss, miss / total AS miss_rate, round(miss / total * 100) / 100 AS miss_rate_2 FROM t""")
def miss_rate(spark, d):
    return stats.totals(_log(spark, d))


@registered(f"{_LOG_SQL} SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS total, count(*) FILTER ({_MISS_SQL}) AS miss, count(*) FILTER ({_MISS_SQL}) / count(*) AS miss_rate FROM l GROUP BY 1")
def miss_rate_daily(spark, d):
    return windowed_miss_rate(_log(spark, d)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@registered("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts)::TIMESTAMP AS session_start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS session_end, count(*) AS n FROM g GROUP BY user_id, k
""")
def request_sessions(spark, d):
    out = sessions(_log(spark, d), "user_id")
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))
