import hashlib

from pyspark.sql import functions as F

from keyloom.llm import exact_dedup as E

ROWS = [(1, "Ab É"), (2, "aB É"), (3, "ab é"), (4, None), (5, ""), (6, " "), (7, "x" * 300_000), (8, "X" * 300_000), (9, "dup"), (9, "dup"), (None, "dup"), (10, "only")]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out = []
    for d, t in rows:
        g = groups[lower(t)]
        keep = max([x for x in g if x is not None], default=None)
        out.append((d, keep, len(g), lower(t)))
    return sorted(out, key=str)


def test_groups(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("keep_id", F.lit("clash")).repartition(3)
    got = E.exact_groups(df).collect()
    digests = {lower(t): hashlib.sha256(lower(t).encode()).digest() for _, t in ROWS}
    assert sorted([(r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got], key=str) == sorted([(d, k, n, digests[t]) for d, k, n, t in brute(ROWS)], key=str)
    kept = [r.doc_id for r in got if r.kept]
    assert sorted(kept) == [2, 3, 5, 6, 8, 9, 10]


def test_weak_digest_keeps_texts_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = E.exact_groups(df, salts=4, digest=lambda t: (F.length(t) % 2).cast("string").cast("binary")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == sorted((d, k, n) for d, k, n, _ in brute(rows))


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(*r, "s", i) for i, r in enumerate(ROWS)], "doc_id long, text string, source string, __salt int")
    out = E.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 5, 6, 8, 9, 10]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_groups(df).isEmpty() and E.exact_dedup(df).isEmpty()
