from pyspark.sql import functions as F

from keyloom.llm import ngram_jaccard_join as J


def test_each_part_is_a_task_of_its_own(spark):
    df = spark.range(256).select((F.col("id") % 64).cast("int").alias("part"), "id")
    sizes = J._dealt(df, 64, "id").groupBy(F.spark_partition_id()).count().collect()
    assert [r["count"] for r in sizes] == [4] * 64


def test_pairs_handed_on_early_add_up(spark):
    rows = [(s, f, 20, s, f, 0) for s in range(12) for f in range(1, 40)]
    members = spark.createDataFrame(rows, "s long, fp long, n long, pos long, component long, other long")
    found = [sorted(map(tuple, J._between(members, 40, 100, 4, most=most).collect())) for most in (100, 1_000_000)]
    assert found[0] == found[1] and len(found[0]) == 39 * 38 // 2
