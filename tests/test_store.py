import json

import pytest

from keyloom.operators import names
from keyloom.plans import store
from keyloom.streaming.commits import commit_batch, commit_stream


def seed(seq, kind, value):
    return (seq, json.dumps({"name": f"n{seq}", "ids": [{kind: value}]}))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "seq long, json string")


def test_two_writers_on_one_version(spark, tmp_path):
    one, two = (store.SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    a, b = one.read(), two.read()
    a.entities = spark.createDataFrame([("c1", "domain:a.com", None, "A")], store.ENTITIES)
    b.entities = spark.createDataFrame([("c2", "domain:b.com", None, "B")], store.ENTITIES)
    assert one.publish(a) == 1
    with pytest.raises(store.Conflict):
        two.publish(b)
    assert [r.canonical_id for r in two.read().entities.collect()] == ["c1"]
    assert two.publish(b) == 2 and one.version() == 2
    with pytest.raises(store.Conflict):
        one.publish(a)
    assert [r.canonical_id for r in one.read().entities.collect()] == ["c2"]


def test_a_writer_that_did_not_end(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    s.publish(store.empty(spark))
    (tmp_path / "s" / "current-2").touch()
    assert store.SnapshotStore(spark, str(tmp_path / "s")).version() == 1
    with pytest.raises(store.Conflict):
        s.publish(store.empty(spark))


def test_batches_count_once_and_others_may_publish(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))
    assert commit_batch(batch(spark, seed(1, "domain", "a.com")), 0, s, "x")
    other = store.SnapshotStore(spark, str(tmp_path / "s"))
    other.publish(other.read())
    assert commit_batch(batch(spark, seed(2, "domain", "b.com")), 1, s, "x")
    assert s.read().nodes.count() == 2
    assert not commit_batch(batch(spark, seed(3, "domain", "c.com")), 1, s, "x")  # run again after a failure
    assert commit_batch(batch(spark, seed(4, "domain", "d.com")), 0, s, "another stream")
    assert sorted(r.key for r in s.read().nodes.collect()) == ["domain:a.com", "domain:b.com", "domain:d.com"]


class Racing(store.SnapshotStore):
    """Somebody else publishes between this store's read and its first publish."""

    raced = False

    def publish(self, snapshot, **options):
        if not self.raced:
            self.raced = True
            other = store.SnapshotStore(self.spark, self.path)
            commit_batch(batch(self.spark, seed(9, "domain", "other.com")), 0, other, "other")
        return super().publish(snapshot, **options)


def test_a_batch_that_loses_a_race_is_committed_again(spark, tmp_path):
    s = Racing(spark, str(tmp_path / "s"))
    assert commit_batch(batch(spark, seed(1, "domain", "a.com")), 0, s, "x")
    assert sorted(r.key for r in s.read().nodes.collect()) == ["domain:a.com", "domain:other.com"]


def test_a_stream_over_restarts(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path / "s"))

    def run(name, *rows):
        batch(spark, *rows).coalesce(1).write.json(str(tmp_path / "in" / name))
        stream = spark.readStream.schema("seq long, json string").option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        q = commit_stream(stream, store.SnapshotStore(spark, str(tmp_path / "s")), str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()

    run("a", seed(1, "domain", "a.com"))
    s.read()
    s.publish(s.read())
    run("b", seed(2, "domain", "b.com"))
    assert s.read().nodes.count() == 2
    commits = sorted(p for p in (tmp_path / "c" / "commits").iterdir() if p.name.isdigit())
    version = s.version()
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):  # published, but not acknowledged
        p.unlink(missing_ok=True)
    run("c", seed(3, "domain", "c.com"))
    assert s.read().nodes.count() == 3 and s.version() == version + 1


def test_names_by_classes(spark):
    rows = [("n", [], 1), ("n", ["a"], 2), ("n", ["a", "b"], 3), ("n", ["c"], 4), ("n", ["c"], 5), ("n", [], 6), ("dead", ["a"], 7)]
    s = store.empty(spark)
    s.entities = spark.createDataFrame([(f"c{i}", f"a{i}", None, "N") for *_, i in rows if i != 7], store.ENTITIES)
    s.name_index = store.index_names(s.name_index, spark.createDataFrame([(n, q, f"c{i}", None) for n, q, i in rows], "name_norm string, qualifiers array<string>, canonical_id string, source string"))
    asked = [("n", []), ("n", ["a"]), ("n", ["a", "b", "x"]), ("n", ["c"]), ("n", ["x"]), ("dead", ["a"]), ("no", ["a"]), ("n", ["a"])]
    q = spark.createDataFrame([(i, n, t, None, None, None, None) for i, (n, t) in enumerate(asked)], names.QUERY)
    want = []
    for n, t in asked:
        own = [(set(x), f"c{i}") for m, x, i in rows if m == n and i != 7]
        within = sorted(c for x, c in own if not t or x <= set(t))
        near = sorted(c for x, c in own if x & set(t))
        want.append((within[0], []) if len(within) == 1 else (None, within or (near if len(near) > 1 else [])))
    out = names.resolve_names(q, s).orderBy("query_id").collect()
    assert [(r.canonical_id, [c.canonical_id for c in r.candidates]) for r in out] == want
    assert all(r.n_candidates == len(r.candidates) for r in out)
    few = names.resolve_names(q, s, listed=False)
    assert "candidates" not in few.columns and [r.n_candidates for r in few.orderBy("query_id").collect()] == [len(w[1]) for w in want]
    lists = [len(r.canonical_ids) for r in names.find_by_name(q, s.name_index).orderBy("query_id").collect()]
    assert lists == [r.n for r in names.count_by_name(q, s.name_index).orderBy("query_id").collect()]
