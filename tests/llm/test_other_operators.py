import hashlib
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from keyloom.llm import chat_format as C
from keyloom.llm import line_dedup as L
from keyloom.llm import pfair_mixing as P
from keyloom.llm import trie_token_counts as T
from keyloom.llm.bytetext import slices

# ---- mixing


def test_phases_hold_every_lag():
    random.seed(2)
    for _ in range(150):
        n = random.randint(1, 6)
        rows, tickets, size = [random.randint(1, 60) for _ in range(n)], [random.randint(1, 9) for _ in range(n)], random.randint(1, 5)
        plan, at, places = P.phases(rows, tickets, size), {}, []
        for i in range(n):
            for k in range(rows[i]):
                p = [p for p in plan if len(p.slots[i]) and p.served[i] <= k // size][-1]
                j = k // size - p.served[i]
                s = j // len(p.slots[i]) * p.length + p.slots[i][j % len(p.slots[i])]
                at[int(p.first_slot + s)] = i
                places.append(int(p.first_row + s * size + k % size))
        assert sorted(places) == list(range(sum(rows))) and sorted(at) == list(range(len(at)))
        for a, p in enumerate(plan):
            end = plan[a + 1].first_slot if a + 1 < len(plan) else len(at)
            active = [i for i in range(n) if len(p.slots[i])]
            total, served = sum(tickets[i] for i in active), Counter()
            for s in range(p.first_slot, end):
                served[at[s]] += 1
                assert all(abs(served[i] - (s + 1 - p.first_slot) * tickets[i] / total) < 1 for i in active)


def test_mixed(spark):
    rows = [(i, ["a", "b", None][i % 7 % 3], "x") for i in range(500)] + [(3, "a", "x"), (None, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(3)
    got = P.mixed(df, {"a": 3, "b": 1}, block_rows=4, tickets=8, buckets=5).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter((a, b) for a, b, _ in rows)
    blocks = Counter((r.source, r.block) for r in got)
    assert max(blocks.values()) <= 4 and [r.slot for r in got] == sorted(r.slot for r in got)
    docs = df.withColumn("text", F.lit("t"))
    assert P.in_mixed_order(docs).columns == docs.columns
    assert P.mixed(df.limit(0)).isEmpty()


# ---- lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(s, k):
    s = list(s)
    for _ in range(k):
        r, i = random.random(), random.randrange(len(s) + 1)
        if r < 0.33 or not s:
            s.insert(i, random.choice("abcé"))
        elif r < 0.66:
            s.pop(min(i, len(s) - 1))
        else:
            s[min(i, len(s) - 1)] = random.choice("abcé")
    return "".join(s)


def test_edit_distance_in_the_band(spark):
    random.seed(5)
    for edits in (1, 2, 3):
        rows = []
        for _ in range(200):
            a = "".join(random.choice("abcé🙂") for _ in range(random.randint(0, 60)))
            rows.append((a, changed(a, random.randint(0, edits + 2))))
        rows += [("ab" * 60 + "x" + "cd" * 60, "ab" * 60 + "cd" * 60), ("ab" * 100, "ba" * 100), ("", "a"), ("", "")]
        got = Counter(tuple(r) for r in L.within(spark.createDataFrame(rows, "p string, q string"), edits).collect())
        assert got == Counter(r for r in rows if distance(*r) <= edits)


def test_lines_against_all_pairs(spark):
    random.seed(6)
    base = ["".join(random.choice("abcdef ") for _ in range(random.randint(8, 40))) for _ in range(20)]
    line = lambda: changed(random.choice(base), random.choice([0, 0, 1, 2, 3])) if random.random() < 0.8 else random.choice(["", "x", " " * 12])
    docs = [(i, "\n".join(line() for _ in range(random.randint(1, 9)))) for i in range(70)] + [(500, None), (501, ""), (502, "\n")]
    seen = [(d, i, x) for d, t in docs if t is not None for i, x in enumerate(t.split("\n")) if len(x) >= 10 and x.strip()]
    lines, parent = sorted({x for _, _, x in seen}), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2:
                parent[root(a)] = root(b)
    first = {}
    for d, i, x in seen:
        first.setdefault(root(x), (d, i))
    gone = {(d, i) for d, i, _ in seen} - set(first.values())
    want = []
    for d, t in docs:
        own = [] if t is None else t.split("\n")
        kept = [x for i, x in enumerate(own) if (d, i) not in gone]
        want.append((d, len(own), len(own) - len(kept), None if t is None else "\n".join(kept)))
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_lines int")
    got = [tuple(r) for r in L.without_repeated_lines(df, least_chars=10).orderBy("doc_id").collect()]
    assert got == want
    assert L.without_repeated_lines(df.limit(0)).isEmpty()


# ---- chats


def test_chats_with_parts(spark):
    parts = "array<struct<type: string, text: string, ref: string, tokens: int>>"
    rows = [
        (1, 0, "user", [("text", "see <image> \\ [INST]", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]),
        (1, 1, "assistant", [("text", "</s>ok\\", None, None)]),
        (1, 2, None, None),
        (2, 5, "ro\nle</s>", [("document", None, "d.pdf", None), ("odd", "kept", None, None), None]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}").withColumn("segments", F.lit(1))
    out = {r.conv_id: r for r in C.format_chats(df, text_col=None, parts_col="parts").collect()}
    assert [tuple(a) for a in out[1].attachments] == [(0, "image", "a.png", 576), (0, "audio", "b.wav", 7)] and out[1].attachment_tokens == 583
    assert [tuple(a) for a in out[2].attachments] == [(5, "document", "d.pdf", 1024)]
    text = "".join(s.text for s in out[1].segments)
    assert text == "<s>user\nsee <\\image> \\\\ [\\INST]<image><audio></s><s>assistant\n<\\/s>ok\\\\</s><s>\n</s>"
    assert [s.text for s in out[1].segments if s.loss] == ["<\\/s>ok\\\\"]
    back = C.format_chats(df, text_col=None, parts_col="parts").select("conv_id", F.explode(C.parsed(C.formatted_text(F.col("segments")))).alias("t"))
    assert {(r.conv_id, r.t.role, r.t.text) for r in back.collect()} == {(1, "user", "see <image> \\ [INST]<image><audio>"), (1, "assistant", "</s>ok\\"), (1, "", ""), (2, "ro\nle</s>", "<document>kept")}


def test_any_text_comes_back(spark):
    random.seed(7)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<image>", "\\", "<", "[", "/", "s>", "\n", "é", "🙂", "a"]
    rows = [(c, t, random.choice(["user", "assistant", "system"]), random.choice([None, "".join(random.choice(bits) for _ in range(random.randint(0, 12)))])) for c in range(40) for t in range(random.randint(1, 150 if c == 0 else 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for r in C.digests(C.format_chats(df)).collect():
        own = [(role, text or "") for c, _, role, text in rows if c == r.conv_id]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---- token counts


def test_counts_against_plain_search(spark):
    scores = T.piece_scores(T.default_vocabulary())
    trie = T.PieceTrie(scores)
    byte, longest = min(scores.values()) - round(T.SCALE * T.BYTE_PENALTY), max(map(len, scores))

    def plain(word):
        b, best = T.MARK + word, [(0, 0)]
        for e in range(1, len(b) + 1):
            ways = [(best[e - 1][0] + byte, best[e - 1][1] - 1)]
            ways += [(best[e - k][0] + scores[b[e - k : e]], best[e - k][1] - 1) for k in range(1, min(e, longest) + 1) if b[e - k : e] in scores]
            best.append(max(ways))
        return -best[-1][1]

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()] + ["", None, " \n", "日本語 ☃☃ 🙂x", "a" * 300]
    seen = {}
    for part in slices(pa.array(texts), 5000):
        counts = trie.of_words(part)
        for i in range(part.n_docs):
            words = (texts[part.first + i] or "").encode().split()
            for w, n in zip(words, counts[part.word_offsets[i] : part.word_offsets[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, plain(w)) == n
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in T.token_counts(df, T.default_vocabulary()).collect()}
    assert got == {i: (len((t or "").encode().split()), sum(seen[w] for w in (t or "").encode().split())) for i, t in enumerate(texts)}
    assert T.token_counts(df.limit(0), T.default_vocabulary()).isEmpty()
