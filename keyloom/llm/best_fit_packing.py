"""Best-fit packing after Martello-Toth dominance reduction.

Only lengths matter to the packing, and there are at most ``capacity`` different ones. So:

1. executors tokenise each document, cut the longer ones, and keep a row per piece with its
   length (no ids are moved);
2. the driver gets one count per length (at most ``capacity`` numbers, however many pieces),
   fixes dominating sets, and packs the rest best-fit, always for whole runs of equal bins;
3. executors give every piece its number among the pieces of its length (dealt over hash
   buckets, so no length is a hot key) and look up bin and offset for that number.

Fixed sets follow Martello and Toth: for the largest remaining length a set that fills its
bin at least as well as any alternative could is fixed for good. Here: a length that fills the
bin alone or fits with nothing that is left; a pair that fills the bin exactly; and, where
two more pieces do not fit beside it, the largest single partner that does.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from functools import cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bytetext import slices
from keyloom.operators.grouping import numbered
from keyloom.plans.workspace import arrow_map, stored

CAPACITY = 2048
END = 0  # the id after each document
MARK = "\ue000"  # separates words that are tokenised in one call; not in them (checked)
CACHE_WORDS, LONGEST_PLAIN, MOST_MARKS = 400_000, 100, 20_000
#: Letters that lower() and composition treat alike in every Unicode version, one for one.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e\u0410-\u044f"
ODD = re.compile(f"[^{LETTERS}!-&(-@[-`{{-~]|<\\|")  # apostrophes (cut by rules of their own), marks of special tokens, other scripts
PRETOKEN = re.compile(f"[{LETTERS}]+|[0-9]|[^{LETTERS}0-9 ]+| ")
WORD_END, RULES = "</w>", ['["</w>"', "NFC", "Lowercase", "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+", "ByteLevel"]
#: The last byte of a letter run as a symbol of its own: a-z as A-Z, trailing bytes of longer characters as 0 to 63.
SPELT_END = {b: bytes([b - 32]) for b in range(97, 123)} | {b: bytes([b - 128]) for b in range(128, 192)}
RUN = re.compile(rb"[a-z\x80-\xf4]+")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _tokens(vocabulary: str) -> tuple[dict[str, int], list[tuple[str, str]], str]:
    """(token -> id without added ones, merges in order, the rules before the model as text)."""
    known = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    added, model = {x["id"] for x in known["added_tokens"]}, known["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    return {t: i for t, i in model["vocab"].items() if i not in added}, merges, json.dumps([model.get("end_of_word_suffix"), known["normalizer"], known["pre_tokenizer"]])


@cache
def _byte_of() -> dict[str, int]:
    """The byte behind each visible stand-in of byte-level vocabularies: printable Latin-1 for itself, the others from 256 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in itself)}


@cache
def mergeable(vocabulary: str) -> bool:
    """Does merging by a token's rank alone give what the list of merges gives?

    The vocabulary must follow the rules of ``Words``, ids must rise with the merges, and merging each token's
    own text must end in that token. Then two neighbours that spell a token are, at
    its rank, the two parts that its merge names: all that happened within them so far happens
    to the token's own text, too.
    """
    tokens, merges, rules = _tokens(vocabulary)
    rank = {m: k for k, m in enumerate(merges)}
    ids = [tokens.get(a + b, -1) for a, b in merges]
    if any(r not in rules for r in RULES) or ids != sorted(set(ids)):
        return False
    for a, b in merges:
        bare = (a + b).removesuffix(WORD_END)
        parts = list(bare) if bare == a + b else [*bare[:-1], bare[-1] + WORD_END]
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            if (parts[k], parts[k + 1]) not in rank:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return True


class Words:
    """Token ids of whole words.

    Words of plain letters, digits and ASCII marks follow the vocabulary's rule for pre-tokens (letter
    runs, single digits, mark runs, lower case), which is a regular expression here. The pair merges
    of letter runs are done by tiktoken with the same vocabulary: bytes that end a run are symbols of
    their own there, spelt with bytes that no run of small letters holds. ``mergeable`` says where that is exact.
    All other words, and all words of other vocabularies, go to the tokenizer itself.
    """

    def __init__(self, vocabulary: str, merging: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32
        self.marks: dict[str, tuple[int, ...]] = {" ": ()}
        self.merge = self._merger(vocabulary) if merging else None

    def _merger(self, vocabulary: str):
        """bytes of a spelt letter run -> its ranks."""
        import tiktoken

        ranks = {}
        for token, i in sorted(_tokens(vocabulary)[0].items(), key=lambda x: x[1]):
            raw, ends = bytes(_byte_of()[c] for c in token.removesuffix(WORD_END)), token.endswith(WORD_END)
            if RUN.fullmatch(raw) and (raw[-1] in SPELT_END or not ends):
                ranks[raw[:-1] + SPELT_END[raw[-1]] if ends else raw] = i
        self.ids = np.array(list(ranks.values()), np.int64)
        return tiktoken.Encoding("letters", pat_str=".+", mergeable_ranks={raw: k for k, raw in enumerate(ranks)}, special_tokens={})._core_bpe.encode_single_piece

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.marks) > MOST_MARKS:
            self.marks = {" ": ()}
        marks, merge, found, whole = self.marks, self.merge, [], []
        for p in PRETOKEN.findall(" ".join(words).lower()):
            if p[0] >= "a" and p[0] not in "{|}~":
                raw = p.encode()
                found.append(merge(raw[:-1] + SPELT_END[raw[-1]]))
            else:
                if p not in marks:
                    own = self.tokenizer.encode(p, add_special_tokens=False).ids
                    marks[p] = tuple(-1 - i for i in own)  # ids, not ranks: told apart by their sign
                found.append(marks[p])
            whole.append(p == " ")
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        ids = np.where(flat < 0, -1 - flat, self.ids[np.maximum(flat, 0)])
        return ids, np.add.reduceat(sizes, np.concatenate([[0], np.flatnonzero(whole)]))

    def _others(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One call for all words where none has the mark."""
        if not any(MARK in t for t in texts):
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join(texts), add_special_tokens=False).ids, np.int64)
            k = len(self.mark)
            here = np.ones(max(0, len(ids) - k + 1), bool)
            for i, m in enumerate(self.mark):
                here &= ids[i : i + len(here)] == m
            at = np.flatnonzero(here)
            if len(at) == len(texts) - 1:
                bounds = np.concatenate([[0], np.repeat(at, 2) + np.tile([0, k], len(at)), [len(ids)]])
                counts = bounds[1::2] - bounds[::2]
                gone = np.ones(len(ids), bool)
                gone[(at[:, None] + np.arange(k)).ravel()] = False
                return ids[gone], counts
        each = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, count for each)."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [self.merge is not None and len(t) <= LONGEST_PLAIN and not ODD.search(t) for t in texts]
        order, ids, counts = [], [], []
        for way, kind in ((self._plain, True), (self._others, False)):
            own = [i for i, p in enumerate(plain) if p is kind]
            if own:
                order.append(np.array(own))
                found = way([texts[i] for i in own])
                ids.append(found[0])
                counts.append(found[1])
        order, ids, counts = np.concatenate(order), np.concatenate(ids), np.concatenate(counts)
        return _gathered(ids, np.cumsum(counts) - counts, counts, np.argsort(order))


def _gathered(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the entries ``at``, one after another, count for each)."""
    counts = counts[at]
    total = np.cumsum(counts)
    return ids[np.repeat(starts[at] - (total - counts), counts) + np.arange(total[-1])], counts


class WordCache:
    """Token ids of words by their hash; at the bound, the half that was not seen for longest goes."""

    def __init__(self, words: Words, most: int = CACHE_WORDS):
        self.words, self.most, self.time = words, most, 0
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, words.dtype)
        self.starts, self.counts, self.seen = (np.zeros(0, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        keep = np.sort(np.argsort(self.seen, kind="stable")[-(self.most // 2) :])
        self.ids, self.counts = _gathered(self.ids, self.starts, self.counts, keep)
        self.keys, self.seen, self.starts = self.keys[keep], self.seen[keep], np.cumsum(self.counts) - self.counts

    def lookup(self, part) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words of the slice in order, count for each word)."""
        if not len(part.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(part.word_hashes(lower=False), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self._shrink()
        self.time += 1
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            ids, counts = self.words.encode(part.words(first[new]))
            into = at[new]
            self.starts = np.insert(self.starts, into, np.cumsum(counts) - counts + len(self.ids))
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.keys, self.counts, self.seen = np.insert(self.keys, into, distinct[new]), np.insert(self.counts, into, counts), np.insert(self.seen, into, 0)
            at = np.searchsorted(self.keys, distinct)
        self.seen[at] = self.time
        return _gathered(self.ids, self.starts, self.counts, at[inverse])


@cache
def words_of(vocabulary: str, merging: bool) -> Words:
    """The vocabulary as this worker has loaded it; a reused worker keeps it, but no cache of words."""
    return Words(vocabulary, merging)


def pieces_of(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and a final 0, in pieces."""

    merging = mergeable(vocabulary)

    def run(batches):
        known = WordCache(words_of(vocabulary, merging))
        for batch in batches:
            names, out = batch.column(0), [[], [], [], [], []]
            for part in slices(batch.column(1), 2 << 20):
                ids, counts = known.lookup(part)
                per_word = np.concatenate([[0], np.cumsum(counts)])
                bounds = per_word[part.word_offsets]
                for i in range(part.n_docs):
                    n = int(bounds[i + 1] - bounds[i]) + 1
                    own = np.empty(n, "<u4")
                    own[:-1] = ids[bounds[i] : bounds[i + 1]]
                    own[-1] = END
                    for k, a in enumerate(range(0, n, capacity)):
                        for column, value in zip(out, (part.first + i, k, a, min(capacity, n - a), zlib.crc32(own[a : a + capacity].data)), strict=True):
                            column.append(value)
            at, piece, start, length, crc = out
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(at, pa.int64())).cast(pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, PIECES)


Plan = list[tuple[tuple[int, ...], int]]  # (lengths of a bin, number of such bins)


def reduced(counts: dict[int, int], capacity: int) -> tuple[Plan, dict[int, int]]:
    """Bins fixed by dominance, and the counts that are left.

    Lengths are taken from the largest down; partners come from everything that is left.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes, fixed = sorted(left), []

    def fix(bins: tuple[int, ...], n: int) -> None:
        fixed.append((bins, n))
        for s in bins:
            left[s] -= n
            if not left[s]:
                del left[s]
                sizes.pop(bisect_left(sizes, s))

    for s in sizes[::-1]:
        while s in left:
            room = capacity - s
            others = [x for x in sizes[:3] if left[x] > (x == s)]  # lengths beside one piece of s
            if not others or room < others[0]:
                fix((s,), left[s] if s > capacity - s or not others else 1)
                continue
            k = bisect_right(sizes, room) - 1
            if sizes[k] == s and left[s] < 2:
                k -= 1
            partner = sizes[k]
            twice = left[others[0]] - (others[0] == s) > 1
            pair = 2 * others[0] if twice else others[0] + others[1] if len(others) > 1 else capacity
            if partner != room and room >= pair:
                break  # three pieces or more could share the bin: nothing is proved
            fix((s, partner), left[s] // 2 if partner == s else min(left[s], left[partner]))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts; gives the bins that placing pieces one by one would."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, bins: tuple[int, ...], n: int) -> None:
        if n:
            if not open_bins[room]:
                insort(rooms, room)
            open_bins[room].append((bins, n))

    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                break
            room = rooms[k]
            bins, n = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(k)
            each = room // s
            full = min(n, c // each)
            put(room - each * s, bins + (s,) * each, full)
            c -= full * each
            n -= full
            if n and c < each:
                if c:
                    put(room - c * s, bins + (s,) * c, 1)
                    n, c = n - 1, 0
            put(room, bins, n)
        if c:
            each = capacity // s
            put(capacity - each * s, (s,) * each, c // each)
            put(capacity - c % each * s, (s,) * (c % each), 1 if c % each else 0)
    return [x for room in sorted(open_bins) for x in open_bins[room]]


def packed(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The bins for so many pieces of each length."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    fixed, rest = reduced(counts, capacity)
    return fixed + best_fit(rest, capacity)


def placements(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: (first piece number, first bin, offset) of each run of bins."""
    runs, used, bin_no = defaultdict(list), defaultdict(int), 0
    for bins, n in plan:
        offset = 0
        for s in bins:
            runs[s].append((used[s], bin_no, offset))
            used[s] += n
            offset += s
        bin_no += n
    return {s: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, buckets: int = 64, id_col: str = "doc_id", text_col: str = "text", places: DataFrame | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    With ``places`` (doc_id, position from 0, one for each id), pieces of equal length are packed in
    the order of position, and sequences are numbered by the mean position of their ids.

    Null text is empty; an empty document is the single id 0. Only documents of more than
    ``capacity`` ids are cut. A repeated row is packed as often as it occurs; a null id is
    kept. An empty input gives no rows. Other columns are ignored, whatever their names.
    The broadcast lookup has a few rows per length, so its size depends on ``capacity`` only.
    """
    pieces = stored(pieces_of(docs, vocabulary, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lookup = placements(packed(counts, capacity))

    def place(batches):
        for batch in batches:
            lengths, numbers = batch.column("length").to_numpy(), batch.column("__number").to_numpy()
            bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for s in np.unique(lengths).tolist():
                own = lengths == s
                first, bin_no, offset = lookup[s]
                k = np.searchsorted(first, numbers[own], "right") - 1
                bins[own] = bin_no[k] + numbers[own] - first[k]
                offsets[own] = offset[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    schema = f"{PIECES}, sequence_id long, offset long"
    if places is None:
        return arrow_map(numbered(pieces, ["length"], ["doc_id", "piece"], "__number", buckets=buckets), place, schema)
    at, share = F.col("__at_doc"), lambda c, n: F.floor(c * buckets / F.lit(n)).cast("int")
    n = (places.agg(F.max("position")).first()[0] or 0) + 1
    here = places.select(F.col("doc_id").alias("__id"), F.col("position").alias("__at_doc"))
    placed = stored(pieces.join(here, F.col("doc_id").eqNullSafe(F.col("__id"))).drop("__id"), "placed")
    ranked = numbered(placed, ["length"], ["__at_doc", "doc_id", "piece"], "__number", buckets=buckets, bucket=share(at, n)).drop("__at_doc")
    whole = stored(arrow_map(ranked, place, schema), "packed")
    means = whole.join(here, F.col("doc_id").eqNullSafe(F.col("__id"))).groupBy("sequence_id").agg((F.sum(at * F.col("length")) / F.sum("length")).alias("__mean"))
    order = numbered(stored(means, "means"), [], ["__mean", "sequence_id"], "__sequence", buckets=buckets, bucket=share(F.col("__mean"), n))
    named = order.select("sequence_id", "__sequence")
    return whole.join(named, "sequence_id").select(*whole.columns[:5], F.col("__sequence").alias("sequence_id"), "offset")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op9: all documents packed into sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
