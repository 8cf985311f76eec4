import corpus_pipeline as P
from tests.llm.test_ngram_jaccard_join import brute

from keyloom.llm import boosted_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = P.quality(spark, docs, SF)
    scores = {r.doc_id: r.score for r in boosted_quality.quality_scores(docs, labels).collect()}
    rows = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and set(rows) == {d for d, s in scores.items() if s >= 0.5}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    last = {}
    for d in sorted(rows):
        last[low(rows[d])] = d
    single = P.exact(spark, good, SF)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == set(last.values())
    near = P.near(spark, single, SF)
    left = {c for _, _, c in brute([(d, rows[d]) for d in last.values()])}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == left
    mixed = P.mix(spark, near, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == left
    packed = P.pack(spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == left and len(P.STAGES) == 5
    assert {r.doc_id for r in P.run(spark, SF).collect()} == left
