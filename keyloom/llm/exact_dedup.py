"""Exact dedup by skew-safe combining; DataFrame functions only.

Rows are grouped by the whole normalised text, never by a digest alone. The digest comes
first in every key so that the long comparison happens only between texts that agree on it:

1. local: Spark's partial aggregation leaves one row per (digest, salt, text) and task;
2. salted: those rows merge per (digest, salt, text), so a text with a third of all rows is
   merged by as many tasks as there are salts;
3. global: at most ``salts`` winners of each text meet per (digest, text).

The winners go back the same way: one row for every (digest, salt) in use, so that no join
key has more than one salt's share of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.grouping import free_name, salt, salt_mask, salts_of
from keyloom.plans.workspace import small, stored

MOST_BROADCAST = 1_000_000  # ids
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty. All-ASCII texts take the fast path."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _combined(rows: DataFrame) -> DataFrame:
    """One row per (digest, norm): its largest doc_id, its size, the salts in use."""
    salted = rows.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), salt_mask("salt").alias("mask"))


def _given_back(rows: DataFrame, winners: DataFrame, keys: list[str], salts: int) -> DataFrame:
    spread = winners.withColumn("salt", F.explode(salts_of("mask", salts))).drop("mask")
    return rows.join(spread, [*keys, "salt"])


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest.

    ``keep_id`` is the largest id among the rows whose normalised text is equal. Null and empty
    texts are equal to each other. A row repeated with its id counts each time; one of the
    repeats is kept. Rows with a null id are never the kept ones unless the whole group has
    null ids. An empty input gives no rows. Other columns of ``docs`` are ignored, whatever
    their names. Two texts with one digest stay apart: such digests are joined with their texts.
    """
    if not 1 <= salts <= 64:
        raise ValueError("salts must be from 1 to 64: they are kept as bits of a long")
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), salt("doc_id", salts=salts).alias("salt"))
    winners = stored(_combined(rows).drop("norm"), "exact")
    clashing = winners.groupBy("digest").count().filter("count > 1").select("digest")
    narrow = rows.drop("norm")
    if clashing.isEmpty():
        joined = _given_back(narrow, winners, ["digest"], salts)
    else:
        apart = rows.join(clashing, "digest", "left_semi")
        joined = _given_back(narrow.join(clashing, "digest", "left_anti"), winners.join(clashing, "digest", "left_anti"), ["digest"], salts).unionByName(
            _given_back(apart, _combined(apart), ["digest", "norm"], salts).drop("norm")
        )
    repeat = F.row_number().over(Window.partitionBy("digest", "salt", "doc_id", "keep_id").orderBy("group_size"))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (repeat == 1)).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Of equal texts (null counts as empty) the row with the largest id stays; of rows that repeat both id and text, one does,
    any of them if other columns differ. Ids may repeat with other texts: each row is judged by its own text. A null id
    stays only where a whole group has null ids. An empty table stays empty.
    """
    groups = exact_groups(docs, id_col=id_col, text_col=text_col, salts=salts)
    ids = docs.select(F.col(id_col).alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        # an id is a row: only those that go are looked up, and texts are not moved again where these are few
        own = free_name(docs, "id")
        gone = stored(groups.filter(~F.col("kept")).select(F.col("doc_id").alias(own)), "gone")
        return docs.join(small(gone, MOST_BROADCAST), F.col(id_col) == F.col(own), "left_anti")
    own, digest, number = (free_name(docs, x) for x in ("id", "digest", "number"))
    kept = stored(groups.filter("kept").select(F.col("doc_id").alias(own), F.col("digest").alias(f"{digest}_kept")).distinct(), "kept")
    rows = docs.withColumn(digest, sha256(normalised(F.col(text_col))))
    met = rows.join(kept, F.col(id_col).eqNullSafe(F.col(own)) & (F.col(digest) == F.col(f"{digest}_kept")))
    same = Window.partitionBy(own, digest, normalised(F.col(text_col))).orderBy(F.lit(0))
    return met.withColumn(number, F.row_number().over(same)).filter(F.col(number) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: every row of documents with the row that stays for its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
