import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from keyloom.llm import line_dedup as L


def test_short_lines_by_equal_text(spark, tmp_path):
    rows = [(1, "All rights reserved.\n\nWh the.\nWh the."), (2, "All rights reserved.\nAll rights reserved!\n\nx"), (3, "x\n  ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in L.query(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(1, 4, 1, "All rights reserved.\n\nWh the."), (2, 4, 1, "All rights reserved!\n\nx"), (3, 2, 1, "  ")]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(words, k):
    words = list(words)
    for _ in range(k):
        i, r = random.randrange(len(words)), random.random()
        words[i : i + 1] = [] if r < 0.3 else [words[i], random.choice(WORDS)] if r < 0.6 else [random.choice(WORDS)]
    return words


WORDS = [f"{a}{b}{c}ing" for a in "bdfg" for b in "aeiou" for c in "lmnr"]


def test_bound_grows_with_the_line(spark):
    random.seed(11)
    base = [[random.choice(WORDS) for _ in range(n)] for n in (9, 10, 11, 18, 19, 20, 21, 39, 40, 41, 60, 79, 80, 130)]
    lines = [w for b in base for k in (0, 1, 1, 1, 2, 2, 3, 4, 5, 7) for w in [changed(b, k)]] + [[random.choice(WORDS) for _ in range(random.randint(9, 40))] for _ in range(40)]
    lines = sorted({" ".join(w) for w in lines})
    want = set()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            m, n = len(a.split()), len(b.split())
            words = min(m, n) >= 10 and distance(a.split(), b.split()) <= max(1, max(m, n) // 20)
            if words or (abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2):
                want.add(frozenset(hashlib.md5(x.encode()).digest() for x in (a, b)))
    got = links_of(spark, lines)
    assert got <= want and len(want) > 100
    assert classes(got) == classes(want)


def links_of(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return {frozenset((bytes(r.a), bytes(r.b))) for r in L.connecting_links(df, L.line_keys(df)).collect()}


def classes(links):
    of = {}
    for a, b in (tuple(x) for x in links):
        both = of.get(a, {a}) | of.get(b, {b})
        of |= dict.fromkeys(both, both)
    return {frozenset(x) for x in of.values()}


def test_crowds_that_share_segments(spark):
    """Lines that share a segment and are not alike, with near copies among them: no link between components is lost."""
    random.seed(13)
    head, tail = "all of these lines begin in one way, ", " and they all end in the very same way"
    short = [head + "".join(random.choices("abcdefgh", k=9)) + tail for _ in range(60)]
    short += [x[:k] + random.choice("xyz ") + x[k + random.randint(0, 1) :] for x in short[:40] for k in [random.randrange(len(x))]]
    long = [[*(f"head{i}" for i in range(20)), *random.choices(WORDS, k=30)] for _ in range(60)]
    long += [changed(x, 2) for x in long[:40]]
    spaced = [" ".join(x)[:k] + " " + " ".join(x)[k:].replace(" ", "", 1) for x in long[:20] for k in [random.randrange(20, 300)]]
    cjk = ["".join(chr(0x4E00 + random.randrange(3000)) for _ in range(45)) for _ in range(10)]
    cjk += [x[:k] + "ab" + x[k + 1 :] for x in cjk for k in (7, 30)]
    lines = sorted({*short, *(" ".join(x) for x in long), *spaced, *cjk})
    want = set()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            p, q = (re.findall(r"[\u4e00-\u9fff]|[^\s\u4e00-\u9fff]+", x) for x in (a, b))
            near = abs(len(p) - len(q)) <= 4 and min(len(p), len(q)) >= 10 and distance(p, q) <= max(1, max(len(p), len(q)) // 20)
            if near or (abs(len(a) - len(b)) <= 2 and sum((Counter(a) - Counter(b)).values()) <= 2 and distance(a, b) <= 2):
                want.add(frozenset(hashlib.md5(x.encode()).digest() for x in (a, b)))
    got = links_of(spark, lines)
    assert got <= want and len(want) > 60
    assert classes(got) == classes(want)


def test_edges(spark):
    line = "this line is repeated, more or less, in some documents"
    docs = [(None, line), (1, None), (2, ""), (3, line), (3, line), (4, "\n".join([line + "!", "", " ", "short", "short"])), (5, "w " * 30000 + "end"), (6, "ffff\n\f\n\f")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id long, text string, line string, h string")
    got = sorted([tuple(r) for r in L.without_repeated_lines(df, least_exact=1).collect()], key=str)
    assert got == sorted([(None, 1, 0, line), (1, 0, 0, None), (2, 1, 0, ""), (3, 1, 1, ""), (3, 1, 1, ""), (4, 5, 2, "\n \nshort"), (5, 1, 0, docs[-2][1]), (6, 3, 0, "ffff\n\f\n\f")], key=str)
    assert L.without_repeated_lines(df.limit(0)).isEmpty()


def test_long_lines_with_a_changed_word(spark):
    random.seed(12)
    text = [random.choice(WORDS) for _ in range(45)]
    other = " ".join([*text[:20], "replacement", *text[21:]])
    unspaced = "".join(chr(0x4E00 + random.randrange(3000)) for _ in range(80))
    docs = [(1, " ".join(text)), (2, other), (3, unspaced), (4, unspaced[:30] + "漢字漢字"[:4] + unspaced[34:])]
    got = {r.doc_id: r.n_dropped for r in L.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 1}


def test_probes_are_compiled_and_whole(spark):
    """The JVM never compiles a method of more than 8,000 bytes; and no place of a segment is left out."""
    random.seed(14)
    line = "".join(random.choices("abcdefgh ", k=50))
    df = spark.createDataFrame([(1, line, len(line))], "h long, line string, n int")
    probes = L.probe_keys(df, L.EDITS)
    text = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(probes._jdf.queryExecution().executedPlan())
    assert max(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)) < 8000
    got = {r.key for r in probes.collect()} | set(df.select(F.expr(f"explode({L._array(L.index_keys(L.EDITS))}) key")).toPandas()["key"])
    shorter = [(line[:i] + line[i + 1 :])[:j] + c + (line[:i] + line[i + 1 :])[j + k :] for i in range(50) for j in range(0, 49, 3) for k, c in ((1, ""), (1, "z"))]
    other = spark.createDataFrame([(x, len(x)) for x in {*shorter}], "line string, n int")
    keys = other.select("line", F.expr(f"{L._array(L.index_keys(L.EDITS))} keys")).collect()
    assert len(keys) > 500 and all(got & set(r["keys"]) for r in keys)


def test_runs_as_many_as_edits_can_spoil(spark):
    """Two characters spoil at most eight runs of telling words: a ninth is not needed, and nine are enough."""
    random.seed(15)
    base = [[random.choice(WORDS) + random.choice(WORDS) for _ in range(n)] for n in (40, 43, 50) for _ in range(4)]
    pairs = []
    for words in base:
        for _ in range(40):
            text = " ".join(words)
            for _ in range(2):
                i = random.randrange(1, len(text) - 1)
                place = random.choice([m.start() for m in re.finditer(" ", text)])
                text = random.choice([text[:place] + text[place + 1 :], text[:i] + " " + text[i:], text[:i] + "\u4e00" + text[i:], text[:place] + "\u4e00" + text[place + 1 :], text[:i] + "x" + text[i + 1 :]])
            pairs.append((" ".join(words), text))
    lines = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "line string")
    met = {r.line: set(r.met) for r in L.line_keys(lines.withColumn("text", F.col("line"))).select(F.col("text").alias("line"), "met").collect()}
    assert all(len(met[" ".join(words)]) == 9 for words in base)
    assert all(met[a] & met[b] for a, b in pairs)
