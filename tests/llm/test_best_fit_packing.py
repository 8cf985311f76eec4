import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from keyloom.llm import best_fit_packing as B
from keyloom.llm.bytetext import slices


def one_by_one(items, capacity):
    bins = []
    for s in sorted(items, reverse=True):
        fits = [k for k, used in enumerate(bins) if used + s <= capacity]
        if fits:
            bins[max(fits, key=lambda k: bins[k])] += s
        else:
            bins.append(s)
    return len(bins)


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_best_fit_on_counts_equals_placing_one_by_one():
    random.seed(1)
    for _ in range(400):
        capacity = random.choice([10, 20, 50, 100])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 60))]
        plan = B.best_fit(Counter(items), capacity)
        assert sum(n for _, n in plan) == one_by_one(items, capacity)
        packed = B.packed(Counter(items), capacity)
        back = Counter()
        for bins, n in packed:
            assert n > 0 and sum(bins) <= capacity
            back.update({s: bins.count(s) * n for s in set(bins)})
        assert back == Counter(items)


def test_dominance_keeps_the_optimum():
    random.seed(2)
    for _ in range(300):
        capacity = random.choice([10, 15, 20])
        items = [random.randint(1, capacity) for _ in range(random.randint(1, 10))]
        fixed, left = B.reduced(Counter(items), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)


def test_bins_of_many_pieces_are_near_the_bound():
    rng = np.random.default_rng(3)
    for spread in (0.6, 1.0):
        lengths = np.clip(rng.lognormal(5, spread, 200_000), 1, 2048).astype(int).tolist() + [2048] * 500
        counts = Counter(lengths)
        bins = sum(n for _, n in B.packed(counts))
        bound = -(-sum(lengths) // 2048)
        assert bound <= bins <= 1.001 * bound + 1
        assert bins <= sum(n for _, n in B.best_fit(counts, 2048))


ODD_WORDS = [
    "don't", "I'LL", "'re'reap", ".'s", "x<|startoftext|>y", "<|", "a<b|c", "ÀÉÎÕÜ", "straße", "İstanbul", "ŉ", "ſ", "naïve.", "cafe\u0301", "Привет,", "МИР!!!", "Ёж", "ΣΑΣ", "日本語", "テスト",
    "ﬁn", "a1b22c", "½", "x²", "٣٤", "___", "$$$", "(a)[b]{c}", "a\x01b", "\x7f", "\u00a0", "a\u00a0b", "\u2003", "\u2028z", "e\u200db", "🙂🙂", "👩\u200d🚀", "ª", "º", "×", "÷", "\ue000", "a\ue000b", "q" * 101, "é" * 60, "Z" * 300, "~", "{|}", "@home", "`x`",
]


def test_words_are_what_the_tokenizer_makes_of_them():
    words = B.words_of(B.default_vocabulary(), B.mergeable(B.default_vocabulary()))
    assert words.merge is not None
    random.seed(4)
    letters = "etaoinshrdluäöüßéèçñóíÉÀabcdefgXYZжшя"
    texts = ODD_WORDS + ["".join(random.choices(letters, k=random.randint(1, 14))) + random.choice(["", ".", ",", "!?", "-", "9", "'s"]) for _ in range(5000)]
    for own in (texts, [t for t in texts if "\ue000" not in t], texts[-1:]):
        ids, counts = words.encode([t.encode() for t in own])
        ends = np.cumsum(counts)
        for t, a, b in zip(own, ends - counts, ends, strict=True):
            assert ids[a:b].tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t
    plain = B.Words(B.default_vocabulary(), False).encode([t.encode() for t in texts])
    assert all((x == y).all() for x, y in zip(plain, words.encode([t.encode() for t in texts]), strict=True))


def test_a_full_cache_forgets_and_still_answers():
    words = B.words_of(B.default_vocabulary(), True)
    small, texts = B.WordCache(words, most=50), [" ".join(f"w{i * k} common." for i in range(40)) for k in range(1, 30)]
    for part in (p for t in texts for p in slices(pa.array([t, None, ""]))):
        ids, counts = small.lookup(part)
        assert ids.tolist() == words.tokenizer.encode(part.data.tobytes().decode(), add_special_tokens=False).ids
        assert counts.sum() == len(ids) and len(small.keys) <= 50 + 81


def test_pack(spark):
    docs = [(1, "Hello, World! it's 2024 éÉ"), (2, None), (3, ""), (4, "a " * 5000), (5, "<|endoftext|>  x"), (5, "<|endoftext|>  x"), (None, "q"), (6, "ｗide space ΣΑΣ")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, length string").repartition(3)
    out = B.pack(df, B.default_vocabulary(), capacity=64).collect()
    tok = Tokenizer.from_file(B.default_vocabulary())
    want = []
    for d, t in docs:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[a : a + 64], "<u4")
            want.append((d, k, a, len(part), zlib.crc32(part.tobytes())))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=str) == sorted(want, key=str)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 64
    assert B.pack(df.limit(0), B.default_vocabulary()).isEmpty()
