"""Near-duplicate lines by a segment-partition edit join; DataFrame functions only.

Two lines within ``edits`` edits: cut one into edits + 1 segments and at least one survives
unchanged in the other (pigeonhole), at nearly the same place. So each distinct line puts its
segments, with its length and the segment's number, into an index; each line probes with those of its
substrings that could be such a segment of a line as long as itself or shorter by up to
``edits`` (the multi-match-aware windows of Li et al., 2011). Candidates are verified by edit distance
with the bits of a band of 2 * edits + 1 diagonals in one integer per character. Linked lines form
classes; of each class the first occurrence stays.

That bound is absolute. Lines of ``LEAST_WORDS`` words and more are linked by a bound that grows
with them, too: one word edit (a word replaced, inserted or removed) for every ``WORDS_AN_EDIT``
words of the longer line, at least one. One edit leaves half of the other words in common at the beginning
or at the end, and lines of fewer than ``LONG`` words meet by these two segments. In longer lines
the segments are all runs of ``RUN`` words among those of ``TELLING`` letters and more (an edit of the line is one of that
sequence at most), in the order of their hashes: edits that spoil d of them leave one
that both lines have among their first d + 1, and lines meet by those. Lines with too few such words, and those
that may have a partner with too few, meet by runs of ``GRAM`` of all words as well. These cover the bound in characters, too, so
long lines need no segments of characters. The distance in words is found by furthest reaching
diagonals, one round per edit. Words are compared by 64-bit hashes.

A class needs links that connect it, not all of its links. So the lines that share a key are first
compared with one of them, the most frequent. Where the links found leave the
lines of a key in several components, the pairs between components are compared as well. Pairs whose
numbers of words, or parities of words and characters, allow no link are passed over before their texts are read.

Equal lines are one line from the start, compared by their 128-bit digests. Keys are 64-bit hashes, so the join
moves two numbers per substring; texts come to the candidates only. (Two lines with one 64-bit hash
would count as one in the lists of keys only, never in the classes.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.components import connected_components
from keyloom.plans.workspace import discard, small, stored

EDITS, LEAST_CHARS = 2, 24
LEAST_WORDS, WORDS_AN_EDIT, LONG = 10, 20, 40
GRAM, RUN, TELLING = 4, 3, 6  # GRAM is a power of 2
SPOILT = 3  # words that one character edit can spoil: a character that is a word by itself goes between two others
SPOILT_TELLING = 2  # telling ones among them: that character is none
UNSPACED = r"\u0e00-\u0e7f\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"  # each character is a word
BLOCK, LONGEST_BIT = 8, 30  # columns of the table at a time; strings have fewer than 2**31 characters
MOST_BROADCAST = 1_000_000  # rows of two numbers


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, line_no, line) for each \\n-split line; null text has none."""
    return docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))


def _segment(k: int, segments: int, n: str) -> tuple[str, str]:
    """(start from 1, length) of segment k of a line of n characters, as SQL; the last ones are longer."""
    short, longer = f"({n} div {segments})", f"({n} % {segments})"
    before = f"greatest(0, {k} - ({segments} - {longer}))"  # longer segments before this one
    return f"({k} * {short} + {before} + 1)", f"({short} + if({k} >= {segments} - {longer}, 1, 0))"


def index_keys(edits: int, line: str = "line", n: str = "n") -> list[str]:
    """SQL for the index keys of a line."""
    out = []
    for k in range(edits + 1):
        start, size = _segment(k, edits + 1, n)
        out.append(f"xxhash64({k}, {n}, substring({line}, {start}, {size}))")
    return out


def probes(edits: int) -> list[tuple[int, int, int]]:
    """(segment k, d, move): where a line looks for segment k of a line shorter by d, moved by so many characters; its own index keys aside."""
    moves = [(k, d, range(max(-k, d - (edits - k)), min(k, d + (edits - k)) + 1)) for d in range(edits + 1) for k in range(edits + 1)]
    return [(k, d, move) for k, d, every in moves for move in every if d or move]


def probe_keys(lines: DataFrame, edits: int, line: str = "line", n: str = "n") -> DataFrame:
    """``lines`` without ``line`` and ``n``, by ``key``: the probe keys of each line, for partners as long or shorter by up to ``edits``.

    One row a probe and one expression for all of them: a method of all probes at once is too long for the JVM to compile.
    """
    given = [c for c in lines.columns if c not in (line, n)]
    every = ", ".join(f"named_struct('k', {k}, 'd', {d}, 'move', {move})" for k, d, move in probes(edits))
    start, size = _segment("__p.k", edits + 1, f"({n} - __p.d)")
    rows = lines.selectExpr("*", f"explode(array({every})) __p").selectExpr("*", f"cast({start} + __p.move as int) __start", f"cast({size} as int) __size")
    rows = rows.filter(f"__start between 1 and {n} - __size + 1")
    return rows.selectExpr(*given, f"xxhash64(__p.k, {n} - __p.d, substring({line}, __start, __size)) key")


def distance_sql(edits: int, x: str = "x", y: str = "y") -> str:
    """SQL for the edit distance of two arrays of characters; right wherever it is at most ``edits``.

    Bit-parallel (Myers) in a band (Hyyro 2003). While column j is computed, bit i stands for
    row j - edits + i, so the band moves down a row with each column and 2 * edits + 1 bits
    suffice for any length. ``vp`` and ``vn`` mark vertical differences of +1 and -1. The score
    follows the lowest diagonal of the band until that reaches the last row, then this row.
    ``x`` must be longer than ``edits``, ``y`` not longer than ``x`` and shorter by ``edits`` at most.
    Columns go in blocks; once the whole band exceeds ``edits``, later blocks are passed over.
    """
    c, top, full = edits, 2 * edits, (1 << (2 * edits + 1)) - 1
    m, n = f"size({x})", f"size({y})"
    eq = " | ".join(f"if(j + {i - c} between 1 and {m} and {x}[greatest(0, least({m}, j + {i - c}) - 1)] = {y}[j - 1], {1 << i}, 0)" for i in range(top + 1))
    d0 = f"((((((e & s.vp) + s.vp) ^ s.vp) | e) | s.vn) & {full})"
    hp = f"((s.vn | (~(d | s.vp))) & {full})"
    row = f"({m} - j + {c})"
    score = f"s.score + if(j + {c} <= {m}, if((d & {1 << top}) = 0, 1, 0), (shiftright(h, {row}) & 1) - (shiftright((d & s.vp), {row}) & 1))"
    new = f"named_struct('vp', (((d & s.vp) | (~(shiftright(d, 1) | h))) & {full}), 'vn', (shiftright(d, 1) & h), 'score', {score})"
    step = f"transform(array({eq}), e -> transform(array({d0}), d -> transform(array({hp}), h -> {new})[0])[0])[0]"
    dead = f"r.score - bit_count(r.vp) > {c}"
    block = f"aggregate(sequence(b * {BLOCK} + 1, least({n}, (b + 1) * {BLOCK})), r, (s, j) -> {step})"
    return f"aggregate(sequence(0, ({n} - 1) div {BLOCK}), named_struct('vp', {(full << c) & full}, 'vn', 0, 'score', {c}), (r, b) -> if({dead}, r, {block}), r -> r.score)"


def _let(value: str, name: str, body: str) -> str:
    """SQL that computes ``value`` once and uses it in ``body`` by name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _common(p: str, q: str) -> str:
    """SQL for the length of the common beginning of two strings, by bisection."""
    same = f"step <= least(length({p}), length({q})) - k and substring({p}, k + 1, step) = substring({q}, k + 1, step)"
    return f"aggregate(transform(sequence(0, {LONGEST_BIT}), i -> shiftleft(1, {LONGEST_BIT} - i)), 0, (k, step) -> if({same}, k + step, k))"


def within_sql(edits: int, p: str = "p", q: str = "q") -> str:
    """SQL: are two strings, whose lengths differ by at most ``edits``, within ``edits`` edits?

    What both begin and end with is left out of the table: that changes no edit distance.
    """
    table = f"if(greatest(length(u.p), length(u.q)) <= {edits}, true, {distance_sql(edits, 'v.x', 'v.y')} <= {edits})"
    arrays = "if(length(u.p) >= length(u.q), named_struct('x', split(u.p, ''), 'y', split(u.q, '')), named_struct('x', split(u.q, ''), 'y', split(u.p, '')))"
    middle = _let("named_struct('p', substring(t.p, l + 1), 'q', substring(t.q, l + 1))", "u", _let(arrays, "v", table))
    tails = f"named_struct('p', reverse(substring({p}, f + 1)), 'q', reverse(substring({q}, f + 1)))"
    return _let(_common(p, q), "f", _let(tails, "t", _let(_common("t.p", "t.q"), "l", middle)))


def within(pairs: DataFrame, edits: int) -> DataFrame:
    """The rows of ``pairs`` (p, q) whose strings are within ``edits`` edits."""
    near = f"if(abs(length(p) - length(q)) <= {edits}, {within_sql(edits)}, false)"
    return pairs.filter(near)


def _eligible(lines: DataFrame, least_chars: int) -> DataFrame:
    return lines.filter((F.length("line") >= least_chars) & F.expr(r"trim(leading ' \t\n\u000b\u000c\r' from line) <> ''"))


def _least_exact(least_chars: int, least_exact: int | None) -> int:
    return least_chars if least_exact is None else min(least_exact, least_chars)


def split_sql(line: str = "line") -> str:
    """SQL for a line's words; white space between them does not count."""
    pattern = f"[{UNSPACED}]|[^\\s{UNSPACED}]+".replace("\\", "\\\\")
    plain = f"array_remove(split({line}, ' '), '')"  # most lines: single characters are cut without a pattern
    spaces = " or ".join(rf"contains({line}, '{c}')" for c in (r"\t", r"\u000b", r"\u000c", r"\r", r"\n"))
    odd = f"if(octet_length({line}) = length({line}), {spaces}, {line} rlike '[\\\\t-\\\\r\\\\u0e00-\\\\u0e7f\\\\u3040-\\\\x{{10ffff}}]')"  # all of UNSPACED, in few ranges
    return f"if({odd}, regexp_extract_all({line}, '{pattern}', 0), {plain})"


def words_sql(line: str = "line") -> str:
    """SQL for the hashes of a line's words."""
    return f"transform({split_sql(line)}, word -> xxhash64(word))"


def word_edits_sql(n: str) -> str:
    """SQL for the word edits allowed where the longer line has ``n`` words."""
    return f"cast(greatest(1, {n} div {WORDS_AN_EDIT}) as int)"


def _beside(array: str, step: int, both: str) -> str:
    """SQL: ``both`` of each element p of an array and the one q that is ``step`` further on."""
    return f"zip_with(slice({array}, 1, size({array}) - {step}), slice({array}, 1 + {step}, size({array}) - {step}), (p, q) -> {both})"


def half_keys(words: str = "words") -> str:
    """SQL for the keys of the beginning and the end of an array of words."""
    n = f"size({words})"
    # halves as the longer line (n - 1) div 2 and as the shorter one of n + 1 words: n div 2
    halves = [f"cast(({n} - 1) div 2 as int)", f"cast({n} div 2 as int)"]
    ends = ", ".join(f"xxhash64({side}, {half}, slice({words}, {start}, {half}))" for half in halves for side, start in enumerate(("1", f"{n} - {half} + 1")))
    return f"array_distinct(array({ends}))"


def _grams(words: str, body: str) -> str:
    """SQL: ``body`` of the hashes of all runs of ``GRAM`` words, found by doubling."""
    out = body.format(f"grams{GRAM}")
    for i in reversed(range(GRAM.bit_length() - 1)):
        out = _let(_beside(words if i == 0 else f"grams{1 << i}", 1 << i, "xxhash64(p, q)"), f"grams{2 << i}", out)
    return out


def _most_edits(n: str) -> str:
    """SQL for the word edits allowed to a line of ``n`` words and the longest partner it may have."""
    return word_edits_sql(f"({n} * {WORDS_AN_EDIT} div {WORDS_AN_EDIT - 1})")


def _spoilt(width: int, words: int, edits: int, n: str) -> str:
    """SQL for the runs of ``width`` words of a line that edits can spoil; an edit of a character spoils so many words, and with them the runs over their place."""
    return f"greatest({(words + width - 1) * edits}, {width} * {_most_edits(n)})"


def _first(runs: str, spoilt: str) -> str:
    """SQL for the first of an array of runs: as many as edits can spoil, and one."""
    return f"slice(sort_array(array_distinct({runs})), 1, {spoilt} + 1)"


def _runs(words: str, width: int) -> str:
    """SQL for the hashes of all runs of ``width`` words, in one pass; there must be so many words."""
    return f"transform(slice({words}, 1, size({words}) - {width - 1}), (w, i) -> xxhash64(w, {', '.join(f'{words}[i + {k}]' for k in range(1, width))}))"


def run_keys(edits: int, telling: str, n: str) -> str:
    """SQL for the keys of the telling words of a line of ``n`` words."""
    return f"if(size({telling}) < {RUN}, array(), {_first(_runs(telling, RUN), _spoilt(RUN, SPOILT_TELLING, edits, n))})"


def needs_grams(edits: int, telling: str, n: str) -> str:
    """SQL: may a line of ``n`` words, or a partner of it, have too few telling words to share a run of them?"""
    return f"size({telling}) <= {_spoilt(RUN, SPOILT_TELLING, edits, n)} + {RUN - 1} + greatest({SPOILT_TELLING * edits}, {_most_edits(n)})"


def gram_keys(edits: int, words: str, n: str) -> str:
    """SQL for the keys of all words of a line."""
    return _first(_runs(words, GRAM), _spoilt(GRAM, SPOILT, edits, n))


def words_within_sql(x: str = "x", y: str = "y") -> str:
    """SQL: are two arrays of words within the word edits allowed to the longer one?

    After e edits, element d + e + 1 of the state is how far into ``x`` so many edits reach on diagonal d, the place in
    ``x`` less the place in ``y``; each round adds an edit and follows the equal words after it. First, the words
    of one that the other lacks, and its runs of words, must be as few as so many edits can make them, and in
    order of size no word may lie further ahead.
    """
    m, n, none = f"size({x})", f"size({y})", -(1 << 30)
    most = word_edits_sql(f"greatest({m}, {n})")
    run = lambda size: f"array_position(zip_with(slice({x}, at + 1, {size}), slice({y}, at - d + 1, {size}), (p, q) -> p <> q), true)"
    room = f"least({m} - at, {n} - at + d)"
    follow = _let(room, "room", _let(run(f"least({BLOCK}, room)"), "k", f"at + if(k > 0, k - 1, if(room <= {BLOCK}, room, {_let(run('room'), 'l', 'if(l > 0, l - 1, room)')}))"))
    slide = lambda at: _let(at, "at", f"if(at < 0 or at < d or at > {m} or at - d > {n}, {none}, {follow})")
    start = f"transform(sequence(0, 0), d -> cast({slide('0')} as int))"
    # in order: a word replaced, one of x removed, one of y inserted
    ways = f"greatest(if(abs(d) < e, least(s[d + e - 1] + 1, {m}, {n} + d), {none}), if(d > 1 - e, least(s[d + e - 2] + 1, {m}), {none}), if(d < e - 1, least(s[d + e], {n} + d), {none}))"
    step = f"transform(sequence(-e, e), d -> cast({slide(ways)} as int))"
    done = _let("size(s) div 2", "r", f"abs({m} - {n}) <= r and s[{m} - {n} + r] >= {m}")
    search = f"aggregate(sequence(1, t), {start}, (s, e) -> if({done}, s, {step}), s -> {done})"
    few = lambda p, q, times: f"size(array_except({p}, {q})) <= {times} * t and size(array_except({q}, {p})) <= {times} * t"
    room = f"greatest(0, least({m}, {n}) - t)"
    ahead = lambda p, q: f"array_contains(zip_with(slice(sorted.{p}, 1, {room}), slice(sorted.{q}, 1 + t, {room}), (p, q) -> p > q), true)"
    ranks = _let(f"named_struct('x', sort_array({x}), 'y', sort_array({y}))", "sorted", f"not ({ahead('x', 'y')} or {ahead('y', 'x')})")
    grams = _let(f"named_struct('x', {_grams(x, '{}')}, 'y', {_grams(y, '{}')})", "runs", few("runs.x", "runs.y", GRAM))
    near = f"if(abs({m} - {n}) <= t and {few(x, y, 1)}, if({ranks}, if({grams}, {search}, false), false), false)"
    return f"if(least({m}, {n}) >= {LEAST_WORDS}, {_let(most, 't', near)}, false)"


def _least_long(edits: int) -> int:
    """The fewest words of a line that meets others by runs: a partner of one of ``LONG`` words may have so few."""
    return LONG - (SPOILT - 1) * edits


def _most_short(edits: int) -> int:
    """Lines of fewer words meet others by segments of characters."""
    return max(LONG, 2 * (SPOILT + GRAM - 1) * edits)


def line_keys(lines: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``lines`` (line, and any others) with h, id, n_words, and the keys.

    ``met`` are keys for both sides; ``short`` is the line where it meets others by segments of characters.
    """
    near, least = f"n >= {least_chars}", _least_long(edits)
    short = f"{near} and n_words < {_most_short(edits)}"
    halves = f"if({near} and n_words >= {LEAST_WORDS} and n_words < {LONG}, {half_keys('parts')}, array())"
    runs = f"if(telling is not null, {run_keys(edits, 'telling', 'n_words')}, array())"
    grams = f"if(telling is not null and {needs_grams(edits, 'telling', 'n_words')}, {gram_keys(edits, 'parts', 'n_words')}, array())"
    rows = lines.select("*", F.xxhash64("line").alias("h"), _digest("line").alias("id"), F.length("line").alias("n"), F.expr(split_sql()).alias("parts"))
    rows = rows.selectExpr("*", "size(parts) n_words")
    rows = rows.selectExpr("*", f"if({near} and n_words >= {least}, filter(parts, x -> length(x) >= {TELLING}), null) telling")
    given = [c for c in lines.columns if c != "line"]
    return rows.selectExpr(*given, "h", "id", "n_words", f"concat({halves}, {runs}, {grams}) met", f"if({short}, line, null) short")


def parity(items: str, number: str) -> str:
    """SQL: which of 64 classes of the items of an array, by a number of each item x, occur an odd number of times."""
    return f"aggregate({items}, 0L, (s, x) -> s ^ shiftleft(1L, cast({number} & 63 as int)))"


def parities(texts: DataFrame, edits: int) -> DataFrame:
    """(h, words, chars) of ``texts`` (h, line): which of 64 classes of words, and of characters (of short lines), occur an odd number of times."""
    rows = texts.selectExpr("h", "line", f"{split_sql()} parts")
    rows = rows.selectExpr("h", f"{parity('parts', 'xxhash64(x)')} words", f"if(size(parts) < {_most_short(edits)}, {parity(SPLIT, 'ascii(x)')}, null) chars")
    return rows.groupBy("h").agg(F.max("words").alias("words"), F.max("chars").alias("chars"))


SPLIT = "split(line, '')"


def _array(items: list[str]) -> str:
    return f"array({', '.join(items)})"


def _lists(keys: DataFrame, edits: int) -> DataFrame:
    """(key, h, own, by_chars, n, n_words): the lines of each key that more than one has.

    ``own``: by a key of its own, not by a probe alone; ``by_chars``: the key is one of characters; ``n``: how
    often the line occurs, in the lists of its own keys. Counting is partial first, so a key or a line that is everywhere is no hot one.
    """
    members = []
    judged = F.max("n_words").alias("n_words")
    kind = lambda own, by_chars: [F.lit(own).alias("own"), F.lit(by_chars).alias("by_chars")]
    short = keys.filter("short is not null").withColumn("n", F.length("short"))
    for by_chars in (False, True):
        rows = (short if by_chars else keys).select("h", "n_words", F.expr(f"explode({_array(index_keys(edits, 'short'))})" if by_chars else "explode(met)").alias("key"))
        ends = rows.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        if by_chars:
            ends = stored(ends, "index")
            # each distinct line probes once, however often it occurs
            once = short.groupBy("h", "short", "n").agg(judged)
            hits = stored(probe_keys(once, edits, "short").hint("merge").join(ends, "key").filter("low <> h or high <> h").drop("low", "high"), "hits")
            members.append(hits.select("key", "h", *kind(False, True), F.lit(1).cast("long").alias("n"), "n_words"))
            shared = stored(ends.filter("low <> high").select("key").union(hits.select("key")).distinct(), "shared")
            discard(ends)
        else:
            shared = stored(ends.filter("low <> high").select("key"), "shared")
        again = rows.join(small(shared, MOST_BROADCAST), "key", "left_semi")
        members.append(again.groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"), judged).select("key", "h", *kind(True, by_chars), "n", "n_words"))
    every = members[0]
    for m in members[1:]:
        every = every.unionByName(m)
    return stored(every.groupBy("key", "h").agg(F.max("own").alias("own"), F.max("by_chars").alias("by_chars"), F.max("n").alias("n"), judged), "lists")


def _possible(edits: int, words: str = "bit_count(x.words ^ y.words)", by_edits: str = "true") -> str:
    """SQL: may the lines x and y, which share a key, be linked?

    A word replaced flips two parities of ``words`` at most, one removed or inserted one; an edit of a character flips
    SPOILT + 1 of words and two of characters. ``by_edits``: what else holds for long lines within ``edits`` edits.
    """
    allowed, more = word_edits_sql("greatest(x.n_words, y.n_words)"), "abs(x.n_words - y.n_words)"
    few = f"{words} <= {(SPOILT + 1) * edits}"
    by_words = f"{more} <= {allowed} and {words} <= 2 * {allowed} - {more}"
    long = f"least(x.n_words, y.n_words) >= {_least_long(edits)} and {more} <= {(SPOILT - 1) * edits} and {few} and {by_edits}"
    return f"if(x.by_chars, {few} and bit_count(x.chars ^ y.chars) <= {2 * edits}, ({by_words}) or ({long}))"


FINE = [f"fine{i}" for i in range(8)]


def _texts(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(h, line) of the lines with these 64-bit hashes."""
    return lines.select(F.xxhash64("line").alias("h"), "line").join(small(ids.distinct(), MOST_BROADCAST), "h", "left_semi").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(h, g, a, b): the pairs (h, g) whose lines are linked; a and b are the lines' ids."""
    both = pairs.join(texts.select("h", F.col("line").alias("p")), "h").join(texts.select(F.col("h").alias("g"), F.col("line").alias("q")), "g")
    by_words = _let(f"named_struct('x', {words_sql('p')}, 'y', {words_sql('q')})", "w", words_within_sql("w.x", "w.y"))
    near = both.filter(F.expr(f"if(abs(length(p) - length(q)) <= {edits}, {within_sql(edits)}, false) or {by_words}"))
    return stored(near.select("h", "g", _digest("p").alias("a"), _digest("q").alias("b")), "links")


def connecting_links(lines: DataFrame, keys: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): ids of different lines that are linked; they connect all lines that any links connect.

    ``keys`` is what :func:`line_keys` gives for ``lines`` (line).
    """
    lists = _lists(keys, edits)
    texts = stored(_texts(lines, lists.select("h")), "texts")
    judged = stored(lists.join(parities(texts, edits), "h"), "judged")
    discard(lists)
    lists = judged
    pair = [F.least("x.h", "y.h").alias("h"), F.greatest("x.h", "y.h").alias("g")]
    # the most frequent line, then by hash; one number as the order and no struct, so that this needs no sorting
    rank = F.expr("shiftleft(least(n, 1048575L), 43) | shiftrightunsigned(h, 21)")
    centres = lists.filter("own").groupBy("key").agg(*(F.max_by(c, rank).alias(c) for c in ("h", "by_chars", "n_words", "words", "chars"))).alias("x")
    stars = stored(centres.join(lists.alias("y"), F.expr(f"x.key = y.key and x.h <> y.h and {_possible(edits)}")).select(*pair).distinct(), "stars")
    links = _verified(stars, texts, edits)
    components = connected_components(links.select("h", "g"), "h", "g")
    named = lists.join(components, F.col("h") == F.col("node"), "left").drop("node").withColumn("component", F.coalesce("component", "h"))
    named = stored(named, "named")
    discard(lists)
    open_keys = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    apart = stored(named.join(open_keys, "key", "left_semi"), "apart")
    discard(named)
    met = "x.key = y.key and x.component <> y.component and (not y.own or x.h < y.h)"
    # whether a line may have a partner at all is seen without its text; those that may are judged by finer parities, too
    partner = F.expr(f"x.key = y.key and x.component <> y.component and (x.own or y.own) and {_possible(edits)}")
    some = stored(apart.alias("x").join(apart.alias("y"), partner, "left_semi").select("h"), "some")
    fine = [f"aggregate(filter(w, x -> (shiftright(x, 6) & {len(FINE) - 1}) = {i}), 0L, (s, x) -> s ^ shiftleft(1L, cast(x & 63 as int))) {name}" for i, name in enumerate(FINE)]
    closest = texts.join(small(some.distinct(), MOST_BROADCAST), "h", "left_semi").selectExpr("h", "length(line) long", f"{parity(SPLIT, 'ascii(x)')} letters", f"{words_sql()} w")
    closest = closest.selectExpr("h", "long", "letters", *fine).groupBy("h").agg(*(F.max(name).alias(name) for name in ("long", "letters", *FINE)))
    closest = stored(closest, "closest")
    known = apart.join(closest, "h")
    alike = f"abs(x.long - y.long) <= {edits} and bit_count(x.letters ^ y.letters) <= {2 * edits}"
    closer = " + ".join(f"bit_count(x.{name} ^ y.{name})" for name in FINE)
    pairs = known.filter("own").alias("x").join(known.alias("y"), F.expr(f"{met} and {_possible(edits)} and {_possible(edits, f'({closer})', alike)}"))
    rest = stored(pairs.select(*pair).distinct().join(stars, ["h", "g"], "left_anti"), "rest")
    more = _verified(rest, texts, edits)
    discard(apart, some, closest, texts, rest, stars)
    return links.unionByName(more).select("a", "b")


def _digest(line: str) -> Column:
    return F.unhex(F.md5(line))


def first_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS, least_exact: int | None = None) -> DataFrame:
    """(doc_id, line_no) of the first line of each class, by id and then place."""
    lines = _eligible(lines_of(docs, id_col, text_col), _least_exact(least_chars, least_exact))
    keys = stored(line_keys(lines, edits, least_chars), "keys")
    classes = connected_components(connecting_links(lines.filter(F.length("line") >= least_chars), keys, edits))
    firsts = stored(keys.groupBy("id").agg(F.min(F.struct("doc_id", "line_no")).alias("at")), "firsts")
    discard(keys)
    linked = small(stored(classes, "classes"), MOST_BROADCAST)
    alone = firsts.join(linked, F.col("id") == F.col("node"), "left_anti")
    named = firsts.join(linked, F.col("id") == F.col("node")).groupBy("component").agg(F.min("at").alias("at"))
    return alone.select("at.doc_id", "at.line_no").unionByName(named.select("at.doc_id", "at.line_no"))


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS, least_exact: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, text for every row of ``docs``: each class of lines once.

    Lines of at least ``least_chars`` characters take part; two are linked within ``edits`` edits,
    classes are what links connect, and the first line (smallest id, then place) stays. Few edits
    make any two shorter lines alike: those of at least ``least_exact`` characters (not given: none)
    are linked by equal text only. Still shorter and blank lines always stay. Null text gives no
    lines and null text; an empty text is one blank line; a text that loses all lines is empty. Rows
    with one id are taken for one document and keep the same lines. A null id comes first. An empty
    input gives no rows. Other columns are ignored, whatever their names.
    """
    if least_chars <= edits + 1:
        raise ValueError("lines must be longer than the edits allowed")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kept = first_lines(docs, edits=edits, least_chars=least_chars, least_exact=least_exact).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("line_no").alias("firsts"))
    # the texts are not sorted: each task looks its documents up in its share of the places
    rows = docs.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").withColumn("all", F.split("text", "\n", -1))
    firsts = F.coalesce("firsts", F.array().cast("array<int>"))
    taken = F.filter("all", lambda x, i: F.array_contains(firsts, i) | (F.length(x) < _least_exact(least_chars, least_exact)) | ~x.rlike(r"\S"))
    rows = rows.withColumn("kept", taken)
    n = F.coalesce(F.size("all"), F.lit(0))
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every document without the lines that were seen before."""
    return without_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), least_exact=1)
