"""The crosswalk's verbs over a store of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.scalars import input_description
from keyloom.operators import corrections
from keyloom.operators.complete import complete, resolve_by_name, settled
from keyloom.operators.names import resolve_names
from keyloom.operators.resolve import Clusters, resolve_exact
from keyloom.plans import stats
from keyloom.plans.store import SnapshotStore, load_entities, log_resolutions
from keyloom.sources.records import Batch, from_ids, parse, seed_files


class Crosswalk:
    """One crosswalk below ``path``; every call that changes it publishes a new version."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, SnapshotStore(spark, path)

    def _commit(self, batch: Batch) -> Clusters:
        s = self.store.read()
        out = settled(resolve_exact(batch, s.clusters))
        self.store.publish(s.with_clusters(out))
        return out

    def ingest(self, records: DataFrame, *, need_ids: bool = True) -> tuple[DataFrame, DataFrame]:
        """(outcomes, rejects) of a table (seq, json). Not logged."""
        batch = parse(records, need_ids=need_ids)
        return self._commit(batch).outcomes, batch.rejects

    def ingest_folder(self, folder: str) -> tuple[DataFrame, DataFrame]:
        return self.ingest(seed_files(self.spark, folder), need_ids=False)

    def resolve(self, ids: DataFrame, *, hub_table: DataFrame | None = None) -> DataFrame:
        """Outcomes of (seq, pos, kind, value); logged. With a hub table, entities are completed from it."""
        batch = from_ids(ids)
        s = self.store.read()
        if hub_table is None:
            now = settled(resolve_exact(batch, s.clusters))
            out = now.outcomes
        else:
            now, out = complete(batch, hub_table, s)
        first = ids.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("kind", "value"), "pos").alias("i"))
        told = out.join(first.select("seq", input_description(F.when(F.col("n") > 1, "record").otherwise(F.col("i.kind")), F.col("i.value")).alias("d")), "seq", "left")
        s = s.with_clusters(now)
        s.resolutions = log_resolutions(s.resolutions, told, F.col("d"))
        self.store.publish(s)
        return out

    def resolve_names(self, queries: DataFrame, *, hub_table: DataFrame | None = None) -> DataFrame:
        """Outcomes of name queries; logged. Hubs are asked only for what the index cannot answer."""
        s = self.store.read()
        if hub_table is None:
            out = resolve_names(queries, s)
        else:
            s, out = resolve_by_name(queries, hub_table, s)
        log = out.select(F.col("query_id").alias("seq"), "status", "reason", F.array().cast("array<string>").alias("matched_via"), "confidence")
        s.resolutions = log_resolutions(s.resolutions, log, F.lit("name"))
        self.store.publish(s)
        return out

    def entity(self, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(clusters, unknown ids) for a column canonical_id. Not logged."""
        return load_entities(ids, self.store.read())

    def link(self, a: str, b: str, *, force: bool = False) -> tuple[str, str]:
        s, cid, outcome = corrections.link(self.store.read(), a, b, force=force)
        if outcome != "already_linked":
            self.store.publish(s)
        return cid, outcome

    def merge(self, ids: list[str], *, force: bool = False) -> str:
        s, cid = corrections.merge(self.store.read(), ids, force=force)
        self.store.publish(s)
        return cid

    def split(self, keys: list[str]) -> str:
        s, cid = corrections.split(self.store.read(), keys)
        self.store.publish(s)
        return cid

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """(one-row report, reasons in order)."""
        s = self.store.read()
        return stats.report(s), stats.ordered(stats.by_reason(s.resolutions))
