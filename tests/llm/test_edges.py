"""Nulls, repeats, ties, clashing names and empty tables; learned models against plain versions."""

import math

import corpus_pipeline as P
import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import boosted_quality as Q
from keyloom.llm import exact_dedup as E
from keyloom.llm import mixture_language as M
from keyloom.llm import ngram_jaccard_join as J
from keyloom.llm import pfair_mixing as X
from keyloom.llm import trie_token_counts as T
from keyloom.llm.bytetext import slices

SF = "/root/testdata/sf0.001"
CLASH = "__id string, __score double, id string, score int, digest string, number int, position long, h long, n long, __position int, __repeat int, fp long, slot int"
VALUES = ("a", 0.1, "b", 2, "c", 3, 4, 5, 6, 7, 8, 9, 10)


def table(spark, rows):
    return spark.createDataFrame([(*r, *VALUES) for r in rows], f"doc_id long, text string, source string, {CLASH}").repartition(3)


def kept(df, out):
    assert out.columns == df.columns and all(tuple(r)[3:] == VALUES for r in out.collect())
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)


def test_exact_with_repeated_ids(spark):
    rows = [(5, "a", "s"), (5, "B", "s"), (7, "b", "s"), (7, "b", "s"), (None, "a", "s"), (None, None, "s"), (8, "", "s")]
    df = table(spark, rows)
    assert kept(df, E.exact_dedup(df)) == sorted([(5, "a", "s"), (7, "b", "s"), (8, "", "s")], key=str)
    own = table(spark, [(1, "x", "s"), (2, "X", "s"), (3, None, "s"), (4, "", "s")])
    assert kept(own, E.exact_dedup(own)) == [(2, "X", "s"), (4, "", "s")]
    assert E.exact_dedup(df.limit(0)).isEmpty()


def test_near_with_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, "s"), (1, text + " more", "s"), (3, text, "s"), (4, None, "s"), (5, "", "s"), (None, text, "s"), (6, " \n", "s")]
    df = table(spark, rows)
    assert kept(df, J.one_of_each(df)) == sorted([r for r in rows if r[0] != 3], key=str)
    assert J.one_of_each(df.limit(0)).isEmpty()


def test_mixture_with_clashing_names_and_ties(spark):
    rows = [(i, "t", s) for i, s in enumerate(["a", "b", None, "a"] * 10)] + [(1, "t", "a"), (None, "t", "b"), (None, "t", "b")]
    df = table(spark, rows)
    assert kept(df, X.in_mixed_order(df)) == sorted(rows, key=str)
    assert X.in_mixed_order(df.limit(0)).isEmpty()
    even = X.mixed(spark.range(4000).selectExpr("id doc_id", "string(id % 4) source"), {str(i): 1.0 for i in range(4)}, block_rows=10).collect()
    by_slot = {r.slot: r.source for r in even}
    assert all(len({by_slot[s + k] for k in range(4)}) == 4 for s in range(0, 400, 4))


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_BLOCKS", 20)
    out = X.mixed(spark.range(1000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source")).collect()
    assert sorted(r.position for r in out) == list(range(1000)) and max(r.block for r in out) <= 20


def test_quality_with_clashing_names(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.limit(60).collect()] + [(None, None, None), (None, "", "s")]
    df = table(spark, rows)
    assert set(kept(df, Q.good_only(df, labels))) <= set(rows)
    assert Q.good_only(df.limit(0), labels).isEmpty()
    got = Q.quality_scores(df, labels.limit(0)).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1
    assert all(r.held_out is not None for r in got) and not any(r.held_out for r in got if r.doc_id is None)


def test_labelled_rows_that_repeat_count_once(spark):
    docs = spark.createDataFrame([(1, "a b")] * 500 + [(2, "c d"), (3, "e f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    learnt = {r.doc_id for r in docs.select("doc_id").distinct().filter(~Q.held_out()).collect()}
    x, y = Q.training_rows(docs, labels)
    assert len(y) == len(learnt) and y.sum() == len(learnt - {2})


def walk(forest, row):
    total = forest.base
    for at in forest.roots.tolist():
        while forest.left[at] != at:
            at = int(forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at])
        total += forest.value[at]
    return 1 / (1 + math.exp(-total))


def test_scores_against_a_plain_walk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    forest = Q.fit(docs, labels)
    assert len(forest.roots) > 10 and len(set(forest.feature.tolist())) > 1
    text = [r.text for r in docs.collect()]
    got = [r.score for r in Q.scored(docs.coalesce(1), forest).collect()]
    x = np.concatenate([Q.statistics(p) for p in slices(pa.array(text))])
    want = [walk(forest, row) for row in x]
    assert sorted(got) == pytest.approx(sorted(want), abs=1e-9)


def plain_mixture(model, text):
    """The definition for one document: words one by one, sets grown one language at a time."""
    part = next(slices(pa.array([text])))
    code, gram_offsets, _, _ = M._grams(part, model.bits)
    words = [[float(np.add.reduce(model.table[code[a:b], k])) for k in range(len(model.names))] for a, b in zip(gram_offsets, gram_offsets[1:], strict=False)]
    if not words:
        return None

    def em(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(len(model.names))]
        for _ in range(M.ROUNDS):
            new = [0.0] * len(share)
            for w in words:
                p = [s * math.exp(x - max(w)) for s, x in zip(share, w, strict=True)]
                new = [n + x / sum(p) / len(words) for n, x in zip(new, p, strict=True)]
            moved, share = max(abs(a - b) for a, b in zip(share, new, strict=True)), new
            if moved < 1e-3:
                break
        reached = sum(math.log(max(sum(s * math.exp(x - max(w)) for s, x in zip(share, w, strict=True)), 1e-300)) + max(w) for w in words)
        return share, reached

    whole, _ = em(range(len(model.names)))
    single = [sum(w[k] for w in words) for k in range(len(model.names))]
    chosen = [max(range(len(single)), key=lambda k: single[k])]
    best, reached = [float(k == chosen[0]) for k in range(len(single))], single[chosen[0]]
    while len(chosen) < len(single):
        rest = max((k for k in range(len(single)) if k not in chosen), key=lambda k: whole[k])
        if whole[rest] * len(words) <= 0.5:
            break
        share, gain = em([*chosen, rest])
        if not 2 * (gain - reached) > math.log(len(words)):
            break
        chosen, best, reached = [*chosen, rest], share, gain
    return best


def test_languages_against_a_plain_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.fit(docs)
    text = [r.text for r in docs.filter("length(text) < 3000").limit(60).collect()]
    text += [text[0] + " " + next(t for t in text[1:] if t and t[:3] != text[0][:3]), "", None, "1 2"]
    got = M.identified(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), model).collect()
    alone = M.identified(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").repartition(40), model).collect()
    assert sorted(map(str, got)) == sorted(map(str, alone))  # no document depends on its neighbours
    for r in got:
        want = plain_mixture(model, text[r.doc_id] or "")
        if want is None:
            assert (r.lang_pred, r.score, r.languages) == ("und", 0.0, [])
            continue
        assert {x.lang: x.share for x in r.languages} == pytest.approx({n: w for n, w in zip(model.names, want, strict=True) if w}, abs=2e-3)
        assert r.lang_pred == r.languages[0].lang and r.score == r.languages[0].share


def test_more_languages_than_a_full_table_holds(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q " * 20, f"l{i:03}") for i in range(600)]
    docs = spark.createDataFrame([(i * 7 + k, t, n) for i, t, n in rows for k in range(7)], "doc_id long, text string, lang string")
    model = M.fit(docs)
    assert len(model.names) == 600 and model.table.size <= M.MOST_CELLS and model.bits < M.BITS
    got = M.identified(docs.limit(50), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 48


def test_equal_languages_tie_by_name(spark):
    docs = spark.createDataFrame([(i, "same words here", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = M.fit(docs)
    model.table[:] = model.table[:, :1]
    assert {r.lang_pred for r in M.identified(docs, model).collect()} == {"a"}


def test_a_very_long_word():
    trie = T.PieceTrie(T.piece_scores(T.default_vocabulary()))
    word = "unbelievable" * 400 + "☃" * 300
    part = next(slices(pa.array([f"{word} {word[:50]} {word}"])))
    long, short, again = trie.of_words(part).tolist()
    assert long == again == trie.count_long(T.MARK + word.encode()) and short == trie.count_long(T.MARK + word[:50].encode())
    assert trie.count_long(T.MARK + b"\x01" * 1_100_000) == 1_100_001 - 0 if trie.count_long(T.MARK) == 1 else True


def test_stages_of_odd_tables(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    text = real.filter("length(text) > 400").first().text
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, text, None, "s", None), (2, text, None, "s", None), (3, "".join(c.upper() if c.isascii() else c for c in text), "en", "s", 1), (4, text + " x", "en", "t", 1), (5, " \n", "en", "t", 1)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `__id` string, position int")
    for name, stage in P.STAGES:
        for given in (df, df.limit(0)):
            out = stage(spark, given, SF)
            assert name == "packing" or out.columns == given.columns
            n = out.count()
            assert n == 0 if given is not df else n > 0 or name == "quality"
    assert sorted(r.doc_id for r in P.exact(spark, df, SF).collect()) == [1, 3, 4, 5]
