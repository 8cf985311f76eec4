import random

from pyspark.sql import functions as F

from keyloom.operators.resolve import resolve_exact
from keyloom.plans import store
from keyloom.sources.records import from_ids


def batch(spark, rows):
    ids = spark.createDataFrame(rows, "seq long, pos int, kind string, value string")
    told = ids.groupBy("seq").agg(F.count(F.lit(1)).alias("harvested")).select("seq", F.lit(None).cast("string").alias("entity_type"), F.concat(F.lit("n"), F.col("seq").cast("string")).alias("name"), "harvested", F.lit("input").alias("source"))
    return from_ids(ids, told)


def some(first, n, seed):
    """Records with few items, sites and phones, so that many merge; every third has phones only."""
    r, rows = random.Random(seed), []
    for seq in range(first, first + n):
        ids = [("phone", f"+1 202 555 01{r.randrange(6):02d}") for _ in range(r.choice([1, 1, 2]))]
        if seq % 3:
            ids += [("wikidata", f"Q{r.randrange(1, 12)}")] + [("imdb", f"tt{r.randrange(1, 30):07d}")] * r.randrange(2) + [("domain", f"https://s{r.randrange(4)}.com/")] * r.randrange(2)
        rows += [(seq, i, *x) for i, x in enumerate(ids)]
    return rows


def test_counts_are_those_of_the_lists(spark):
    earlier = resolve_exact(batch(spark, some(0, 40, 1)))
    before = store.empty(spark).with_clusters(earlier).clusters
    now = batch(spark, some(100, 120, 2))
    want = {r.seq: (r.status, r.reason, r.anchor, len(r.candidates)) for r in resolve_exact(now, before).outcomes.collect()}
    got = {r.seq: (r.status, r.reason, r.anchor, r.n_candidates) for r in resolve_exact(now, before, listed=False).outcomes.collect()}
    assert got == want
    assert len({n for *_, n in want.values()}) > 2


def test_small_components_share_no_task(spark):
    n = 400
    out = resolve_exact(batch(spark, [(i, 0, "imdb", f"tt{i + 1:07d}") for i in range(n)]))
    assert len([f for f in out.nodes.select(F.input_file_name().alias("f")).distinct().collect()]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert out.outcomes.filter("status = 'new'").count() == n
