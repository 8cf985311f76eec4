"""Token counts of whole texts by dynamic programming over a trie of their pre-tokens.

Tokens are those of a unigram model: of all ways to cut a pre-token (a word with the word mark
before it) into pieces, the one with the highest total score, and of equal ones the one with
fewest pieces. The best score of a prefix does not depend on what follows, so the distinct
pre-tokens of a slice of text go into a trie, each node's forward score is computed once for
all pre-tokens that share it, and the terminal nodes hold the counts. All nodes of one
depth are computed together. A worker keeps the counts of words it has seen, up to a bound.
Words of more than ``LONGEST`` bytes share no prefix worth a trie: each is a path of its own, followed byte by
byte with whole numbers of any size.

The vocabulary is a public piece file. Its ranks stand for frequencies as in Zipf's law:
the piece of rank r scores -ln(r + 1) - ln(H), H the harmonic sum; scores are integers (2**16
for 1), so sums are exact. A byte that no piece covers is one token with a far lower score.
Nothing is shuffled, and memory depends on the size of a slice only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bytetext import _RANDOM, Slice, _powers, slices
from keyloom.plans.workspace import arrow_map

MARK = "▁".encode()
SCALE, COUNT_BITS = 1 << 16, 20
BYTE_PENALTY = 20.0
CACHE_WORDS, LONGEST = 1_500_000, 2_000  # so few tokens fit COUNT_BITS, and their scores 64 bits
NONE = np.int64(-(1 << 62))


def piece_scores(model_file: str) -> dict[bytes, int]:
    """Integer scores of the ordinary pieces of a sentencepiece file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    own.sort(key=lambda i: (-model.get_score(i), i))
    harmonic = np.log(np.sum(1 / np.arange(1, len(own) + 1)))
    return {model.id_to_piece(i).encode(): -round(SCALE * (float(np.log(r + 1)) + harmonic)) for r, i in enumerate(own)}


class PieceTrie:
    """Counts for words, from scores of pieces."""

    def __init__(self, scores: dict[bytes, int]):
        self.scores, self.uncovered = scores, min(scores.values(), default=0) - round(SCALE * BYTE_PENALTY)
        self.byte = (min(scores.values(), default=0) - round(SCALE * BYTE_PENALTY)) * (1 << COUNT_BITS) - 1
        by_length: dict[int, list[tuple[int, int]]] = {}
        for piece, score in scores.items():
            total = 0
            for i, b in enumerate(piece):
                total += int(_RANDOM[b]) * int(_powers(len(piece) + 1)[0][i])
            by_length.setdefault(len(piece), []).append((total % (1 << 64), score * (1 << COUNT_BITS) - 1))
        #: by length in bytes: sorted hashes, and weights (score and -1 token in one number)
        self.pieces = {}
        for k, rows in sorted(by_length.items()):
            rows.sort()
            self.pieces[k] = np.array([h for h, _ in rows], np.uint64), np.array([w for _, w in rows], np.int64)
        self.longest = max(self.pieces, default=1)
        self._clear()

    def _clear(self) -> None:
        self.known, self.stored = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[start : start + length] (the mark included)."""
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * power[:-1], dtype=np.uint64, out=total[1:])
        order = np.argsort(-lengths, kind="stable")  # those that reach a depth come first
        starts, lengths = starts[order], lengths[order]
        best = np.full(len(starts), NONE)  # of terminal nodes
        node_of, forward = [np.zeros(len(starts), np.int64)], [np.zeros(1, np.int64)]  # the root
        live = len(starts)
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths[:live], -depth, "right"))
            s = starts[:live]
            prefix = (total[s + depth] - total[s]) * inverse[s]
            _, first, node = np.unique(prefix, return_index=True, return_inverse=True)
            end = s[first] + depth
            here = forward[-1][node_of[-1][first]] + self.byte
            for k, (hashes, weights) in self.pieces.items():
                if k > depth:
                    break
                begin = end - k
                h = (total[end] - total[begin]) * inverse[begin]
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                hit = np.flatnonzero(hashes[at] == h)
                if len(hit):
                    way = forward[-k][node_of[-k][first[hit]]] + weights[at[hit]]
                    here[hit] = np.maximum(here[hit], way)
            node_of.append(node)
            forward.append(here)
            if len(forward) > self.longest:
                node_of.pop(0)
                forward.pop(0)
            done = np.flatnonzero(lengths[:live] == depth)
            best[done] = here[node[done]]
        out = np.empty(len(starts), np.int64)
        out[order] = -best & ((1 << COUNT_BITS) - 1)
        return out

    def count_long(self, word: bytes) -> int:
        """Tokens of one pre-token (the mark included), however long."""
        reach = [(0, 0)] * self.longest  # (score, -tokens) of the prefixes that end last, in a ring
        for end in range(1, len(word) + 1):
            score, n = reach[(end - 1) % self.longest]
            best = (score + self.uncovered, n - 1)
            for k in range(1, min(end, self.longest) + 1):
                own = self.scores.get(word[end - k : end])
                if own is not None:
                    score, n = reach[(end - k) % self.longest]
                    best = max(best, (score + own, n - 1))
            reach[end % self.longest] = best
        return -reach[len(word) % self.longest][1]

    def of_words(self, part: Slice) -> np.ndarray:
        """Tokens of each word of a slice."""
        if not len(part.starts):
            return np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(part.word_hashes(lower=False), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            a, b = part.starts[first[new]], part.ends[first[new]]
            long = np.flatnonzero(b - a > LONGEST)
            counted = [self.count_long(MARK + part.data[a[i] : b[i]].tobytes()) for i in long.tolist()]
            b = b.copy()
            b[long] = a[long]  # the mark alone goes with the others
            lengths = b - a + len(MARK)
            starts = np.cumsum(lengths) - lengths
            data = np.empty(int(lengths.sum()), np.uint8)
            for i, x in enumerate(MARK):
                data[starts + i] = x
            body = np.ones(len(data), bool)
            body[(starts[:, None] + np.arange(len(MARK))).ravel()] = False
            data[body] = part.data[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))]
            counts = self.counts(data, starts, lengths)
            counts[long] = counted
            self.known = np.insert(self.known, at[new], distinct[new])
            self.stored = np.insert(self.stored, at[new], counts)
            at = np.searchsorted(self.known, distinct)
        return self.stored[at][inverse]


_TRIES: dict[str, PieceTrie] = {}


def trie(model_file: str) -> PieceTrie:
    """This worker's trie for a vocabulary; a reused worker keeps its counts."""
    if model_file not in _TRIES:
        _TRIES[model_file] = PieceTrie(piece_scores(model_file))
    return _TRIES[model_file]


def token_counts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens for every row of ``docs``.

    Null, empty and blank texts have no tokens. Repeated rows and null ids stay; an empty input
    gives no rows; other columns are ignored, whatever their names.
    """

    def run(batches):
        own = trie(model_file)
        for batch in batches:
            words, tokens = [], []
            for part in slices(batch.column(1), 2 << 20):
                total = np.concatenate([[0], np.cumsum(own.of_words(part))])[part.word_offsets]
                words.append(np.diff(part.word_offsets))
                tokens.append(np.diff(total))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words or none)), pa.array(np.concatenate(tokens or none))], names=["doc_id", "n_pretokens", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_pretokens long, n_tokens long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: pre-tokens and tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
