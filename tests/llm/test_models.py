"""Quality, rules and languages: held-out accuracy and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import boosted_quality as Q
from keyloom.llm import decision_list as D
from keyloom.llm import mixture_language as M

SF = "/root/testdata/sf0.01"
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "x" * 200_000), (-5, "1234 !!"), (-5, "1234 !!"), (None, "the end of it")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(*r, "zz", "s", 1, 0.5) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_quality_on_held_out_rows(spark, docs, labels):
    got = Q.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_of_odd_rows(spark, labels, docs):
    forest = Q.fit(docs, labels)
    got = Q.scored(odd(spark), forest).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert Q.scored(odd(spark).limit(0), forest).isEmpty()
    empty = Q.fit(docs.limit(0), labels)
    assert empty.scores(np.zeros((2, len(Q.FEATURES)), np.float32)).tolist() == [0.5, 0.5]


def test_boosting_fits_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = Q.fitted(x, y)
    assert ((forest.scores(x) >= 0.5) == (y == 1)).mean() > 0.97


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, docs):
    extra = spark.createDataFrame([*ODD[:-3], (-8, "a b c a b c a b"), (-9, "\x0b\x0c x y \x1c z\n\n x y \x1c z\n"), (-10, "é é #|é")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    want = {r.doc_id: counts(r.text) for r in rows.collect()}
    got = {r.doc_id: tuple(r)[1:6] for r in D.with_counts(rows).collect()}
    assert got == want


def test_rules(spark, docs, labels):
    out = D.quality_rules(docs, labels).join(labels, "doc_id").collect()
    fair = [r for r in out if not r.base_failed]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert sum(r.kept for r in fair if r.quality == 1) / sum(r.quality == 1 for r in fair) >= 0.98
    assert sum(not r.kept for r in fair if r.quality == 0) / sum(r.quality == 0 for r in fair) >= 0.6
    got = D.quality_rules(odd(spark), labels).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got)


def test_covering_learns_and_prunes():
    random.seed(4)
    cells = Counter()
    for _ in range(3000):
        x, y, noise = random.randrange(10), random.randrange(10), random.randrange(10)
        cells[((x, y, noise), int(x > 6 and y <= 2), random.randrange(3))] += 1
    rules = D.learned([(*k, n) for k, n in sorted(cells.items())], ["x", "y", "z"], [list(map(float, range(9)))] * 3)
    assert len(rules) == 1 and set(rules[0].conditions) == {D.Condition("x", True, 6.0), D.Condition("y", False, 2.0)} and not rules[0].wrong
    assert D.learned([], ["x"], [[0.0]]) == []


def test_languages_on_held_out_rows(spark, docs):
    got = M.identified(docs, M.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter(M.held_out()).collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.95


def test_language_mixtures_and_odd_rows(spark, docs):
    model = M.fit(docs)
    one = {r.lang: r.text for r in docs.filter("length(text) between 2000 and 6000").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    both = spark.createDataFrame([(1, one["en"] + "\n" + one["de"])], "doc_id long, text string")
    r = M.identified(both, model).first()
    assert r.lang_pred in ("en", "de") and 0.3 < r.score < 0.8
    got = {(r.doc_id or 0): (r.lang_pred, r.score) for r in M.identified(odd(spark), model).collect()}
    assert got[-1] == got[-2] == got[-3] == got[-5] == ("und", 0.0) and got[0][0] in model.names
    none = M.fit(docs.limit(0))
    assert M.identified(odd(spark), none).filter("lang_pred <> 'und'").isEmpty()
