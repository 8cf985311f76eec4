"""Grouping and numbering that no hot key can turn into a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (stem + "_" * i for i in range(len(taken) + 1)) if name.lower() not in taken)


def salt(*cols: str | Column, salts: int = 64) -> Column:
    """A stable salt from 0 to ``salts - 1``; recomputing a lost partition gives the same one."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salt_mask(salt_col: str) -> Column:
    """Aggregate: the salts seen in a group, as the bits of one long (at most 64 salts)."""
    return F.bit_or(F.expr(f"shiftleft(1L, {salt_col})"))


def salts_of(mask: str, salts: int = 64) -> Column:
    """The salts that :func:`salt_mask` noted, as an array."""
    return F.expr(f"filter(sequence(0, {salts - 1}), s -> (shiftrightunsigned({mask}, s) & 1L) = 1L)")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, *, buckets: int, bucket: Column | None = None) -> DataFrame:
    """``df`` plus ``name``: a dense number from 0 within each ``keys``, in a stable order.

    Rows are dealt into ``buckets`` hash buckets of ``order``; numbers are given inside each
    (keys, bucket) and moved by the sizes of the buckets before it. A key that holds a third
    of all rows is so numbered by ``buckets`` tasks; only the table of bucket sizes (keys x
    buckets rows) is ordered by key alone. Rows equal in ``keys`` and ``order`` get distinct
    numbers. Null keys form a group of their own. With ``bucket``, a number that never falls along
    ``order``, rows are dealt by it, and the numbers follow ``order`` over all buckets.
    """
    b, at, n, start = "__bucket", "__at", "__n", "__start"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int") if bucket is None else bucket)
    sizes = dealt.groupBy(*keys, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn(start, F.coalesce(F.sum(n).over(before), F.lit(0))).drop(n)
    inside = Window.partitionBy(*keys, b).orderBy(*order)
    rows = dealt.withColumn(at, F.row_number().over(inside) - 1)
    named = starts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(b).alias("__kb"), start)
    same = F.col(b) == F.col("__kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return (
        rows.join(named, same)
        .withColumn(name, (F.col(at) + F.col(start)).cast("long"))
        .select(*df.columns, name)
    )
