import random
import re

import pytest

from keyloom.llm import ngram_jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets, parent = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), root(d)) for d in sets)


def corpus(seed, n):
    random.seed(seed)
    base = [[random.choice("abcdefghijklmnopqrstuvwxyz") * random.randint(1, 3) for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = random.choice(["x", "y", "é"]) + str(random.randrange(30))
        if random.random() < 0.2:
            w = w[: random.randint(0, 8)]
        rows.append((i * 3 + 1, random.choice([" ", "\n", "\t"]).join(w)))
    return rows + [(5000, None), (5002, ""), (5003, " \n"), (5005, "a b"), (5006, "A B"), (5008, "a b c"), (5009, "É b")]


@pytest.mark.parametrize("crowd", [2, 4])
def test_against_all_pairs(spark, monkeypatch, crowd):
    """With small limits most regions are crowded and joined again."""
    monkeypatch.setattr(J, "CROWD", crowd)
    monkeypatch.setattr(J, "TILE", 16)
    rows = corpus(3, 220)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect())
    assert got == brute(rows)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "z"), (4, None), (5, "a b c d e f g h")]
    out = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_repeated_rows_nulls_and_nothing(spark):
    rows = [(7, "a b c"), (7, "a b c"), (None, "a b c"), (8, "a b c")]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (7, 7), (7, 7), (8, 7)]
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def test_bounds():
    """Linked sets meet at least least_meetings times in their windows, whatever the order."""
    random.seed(1)
    for _ in range(3000):
        n, m = random.randint(1, 60), random.randint(1, 60)
        if 100 * min(n, m) < 75 * max(n, m):
            continue
        common = int(J.least_overlap(n, m))
        if common > min(n, m):
            continue
        both = random.sample(range(n + m - common), n + m - common)
        a, b = sorted(both[:n]), sorted(both[n - common :])
        assert len(set(a) & set(b)) == common
        w = lambda s: set(s[: len(s) - -(-75 * len(s) // 100) + 1])
        met = w(a) & w(b)
        assert len(met) >= J.least_meetings(n, m) >= 1
        s = min(set(a) & set(b))
        assert J._fits(n, m, a.index(s), b.index(s), 75, 100)
