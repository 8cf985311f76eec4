import corpus_pipeline as P

from keyloom.llm import pfair_mixing


def test_sequences_follow_the_mixture(spark):
    # every document fills more than half of a sequence, so each has one of its own
    rows = [(i, "word " * (1200 + i % 7), "a" if i % 10 else "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = [r.doc_id for r in pfair_mixing.mixed(docs).orderBy("position").collect()]
    got = P.pack(spark, P.mix(spark, docs, ""), "").orderBy("sequence_id").collect()
    assert [r.sequence_id for r in got] == list(range(300)) and [r.doc_id for r in got] == want


def test_shared_sequences_follow_the_weights(spark):
    rows = [(i, "word " * (20 + i * 37 % 900), "a" if i % 10 else "b") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    position = {r.doc_id: r.position for r in pfair_mixing.mixed(docs).collect()}
    got = P.pack(spark, docs, "").orderBy("sequence_id", "offset").collect()
    assert sorted(r.doc_id for r in got) == list(range(2000))
    uses = {}
    for r in got:
        assert r.offset == uses.get(r.sequence_id, 0)
        uses[r.sequence_id] = r.offset + r.length
    assert max(uses.values()) <= 2048 and sorted(uses) == list(range(len(uses)))
    quarter = [position[r.doc_id] for r in got if r.sequence_id < len(uses) // 4]
    last = [position[r.doc_id] for r in got if r.sequence_id >= len(uses) * 3 // 4]
    assert sum(quarter) / len(quarter) + 500 < sum(last) / len(last)
