"""The miss-rate report over the log of resolutions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.scalars import outcome_class, round2
from keyloom.plans.store import Snapshot


def by_reason(log: DataFrame, reason: str = "reason_tag") -> DataFrame:
    return log.groupBy(F.col(reason).alias("reason_tag")).agg(F.count(F.lit(1)).alias("n"))


def ordered(reasons: DataFrame) -> DataFrame:
    """Most frequent first, then by name."""
    return reasons.orderBy(F.desc("n"), "reason_tag")


def totals(log: DataFrame, reason: str = "reason_tag") -> DataFrame:
    """One row: total, exact, hub, miss, miss_rate (0 for an empty log), miss_rate_2 (as displayed)."""
    own = by_reason(log, reason).withColumn("class", outcome_class(F.col("reason_tag")))
    n = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("n"))), F.lit(0)).alias(c)
    out = own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), n("exact"), n("hub"), n("miss"))
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.col("miss") / F.col("total"))
    return out.withColumn("miss_rate", rate).withColumn("miss_rate_2", round2(rate))


def report(s: Snapshot) -> DataFrame:
    """``totals`` plus the entities and edges of the snapshot."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    edges = s.nodes.select(F.lit(1).alias("e")).unionAll(s.phone_edges.select(F.lit(1).alias("e")))
    return totals(s.resolutions).crossJoin(count(s.entities, "entities")).crossJoin(count(edges, "edges"))  # one row each
