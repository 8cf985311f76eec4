"""Language identification by mixture inference.

Each language has a distribution of letter trigrams (hashed, smoothed) learnt from labelled
texts. A document is a mixture: each word comes from one language, with the document's
proportions; expectation-maximisation estimates these from the words' likelihoods. The
set of languages is chosen by penalised likelihood: starting from the best single language, one more
(the next by proportion) is taken while twice the gain in log likelihood exceeds log(words) for
its additional proportion. The prediction is the largest proportion within the chosen set.

All documents of a slice are inferred together; the languages' tables are the only thing that
is broadcast, and their size is languages x 2**bits. Likelihoods are looked up once for each
distinct word of a slice.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.bytetext import Slice, slices
from keyloom.plans.workspace import arrow_map

BITS, MOST_DOCS, ROUNDS, SMOOTH = 15, 20_000, 12, 0.5
MOST_CELLS, LEAST_BITS, BLOCK = 1 << 24, 10, 4096  # cells of all tables (4 bytes each in the broadcast)
UNKNOWN = "und"
U = np.uint64

_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:65] = _NOT_LETTER[91:97] = _NOT_LETTER[123:128] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(part: Slice, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter runs of a slice and their trigrams, each run padded by a mark on either side.

    (gram codes, gram offsets by run, run offsets by document, a hash of each run). Bytes above
    127 count as letters here: UTF-8 letters of any script, told apart by their bytes. A-Z is
    taken as a-z; both cases of other letters are learnt from the texts.
    """
    data = np.where(_NOT_LETTER[part.data], 0, _LOWER[part.data]).astype(np.uint64)
    edge = np.zeros(len(data) + 1, bool)
    edge[part.offsets] = True
    letter = data > 0
    start, end = letter.copy(), letter.copy()
    start[1:] &= ~letter[:-1] | edge[1 : len(data)]
    end[:-1] &= ~letter[1:] | edge[1 : len(data)]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    n = b - a
    offsets = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(a - offsets[:-1], n) + np.arange(offsets[-1])  # one trigram around each byte
    before = np.where(start[at], 0, data[at - 1]) if len(at) else at.astype(np.uint64)
    after = np.where(end[at], 0, data[np.minimum(at + 1, len(data) - 1)]) if len(at) else before
    code = ((before << U(16)) | (data[at] << U(8)) | after).astype(np.uint64)
    code = ((code * U(0x9E3779B97F4A7C15)) >> U(64 - bits)).astype(np.int64)
    return code, offsets, np.searchsorted(a, part.offsets), _run_hashes(data, at, offsets)


def _run_hashes(data: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.uint64)
    place = np.arange(len(at)) - np.repeat(offsets[:-1], np.diff(offsets))
    x = (data[at] + U(1)) * (place.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(0xD1B54A32D192ED03))
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return np.add.reduceat(x, offsets[:-1])


@dataclass
class Languages:
    """log probability of each trigram bucket by language: (2**bits, languages)."""

    names: list[str]
    table: np.ndarray
    bits: int

    def infer(self, part: Slice, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the first language or -1, its proportion, all proportions) for each document of a slice."""
        k, docs = len(self.names), part.n_docs
        best, score, every = np.full(docs, -1), np.zeros(docs), np.zeros((docs, k))
        code, gram_offsets, run_offsets, hashes = _grams(part, self.bits)
        if not len(hashes) or not k:
            return best, score, every
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        own = np.repeat(gram_offsets[first] - np.concatenate([[0], np.cumsum(np.diff(gram_offsets)[first])[:-1]]), np.diff(gram_offsets)[first])
        own = own + np.arange(len(own))
        word = np.add.reduceat(self.table[code[own]], np.concatenate([[0], np.cumsum(np.diff(gram_offsets)[first])[:-1]]), axis=0)
        has = np.diff(run_offsets) > 0
        starts, words = run_offsets[:-1][has], np.diff(run_offsets)[has]
        likelihood = word[inverse]  # (words, languages)
        single = np.add.reduceat(likelihood, starts, axis=0, dtype=np.float64)
        top = likelihood.max(axis=1, keepdims=True)
        p = np.exp(likelihood - top)
        fixed = np.add.reduceat(top[:, 0], starts, dtype=np.float64)
        share, _ = self._em(p, starts, words, np.ones((len(words), k), bool), rounds)
        order = np.argsort(-single, axis=1, kind="stable")[:, :1]
        chosen = np.zeros((len(words), k), bool)
        np.put_along_axis(chosen, order, True, axis=1)
        reached = np.take_along_axis(single, order, axis=1)[:, 0]
        proportions = chosen.astype(np.float64)
        active = np.arange(len(words))
        for _ in range(k - 1):  # documents whose set may still grow
            rest = np.where(chosen[active], -1.0, share[active])
            active = active[rest.max(axis=1) * words[active] > 0.5]
            if not len(active):
                break
            more = chosen[active].copy()
            more[np.arange(len(active)), np.where(more, -1.0, share[active]).argmax(axis=1)] = True
            rows = np.repeat(starts[active] - np.concatenate([[0], np.cumsum(words[active])[:-1]]), words[active])
            rows = rows + np.arange(len(rows))
            new_starts = np.concatenate([[0], np.cumsum(words[active])[:-1]])
            fit, gain = self._em(p[rows], new_starts, words[active], more, rounds)
            gain = gain + fixed[active]
            better = 2 * (gain - reached[active]) > np.log(words[active])
            active = active[better]
            chosen[active], proportions[active], reached[active] = more[better], fit[better], gain[better]
        best[has] = proportions.argmax(axis=1)
        score[has] = np.clip(proportions.max(axis=1), 0, 1)
        every[has] = proportions
        return best, score, every

    @staticmethod
    def _em(p: np.ndarray, starts: np.ndarray, words: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the allowed languages, and the log likelihood they reach."""
        share = allowed / allowed.sum(axis=1, keepdims=True)
        still = np.ones(len(words), bool)  # each document ends by itself, so none depends on its neighbours
        for _ in range(rounds):
            r = p * np.repeat(share, words, axis=0)
            total = r.sum(axis=1, keepdims=True)
            r /= np.maximum(total, 1e-300)
            new = np.add.reduceat(r, starts, axis=0) / words[:, None]
            moved = np.abs(new - share).max(axis=1, initial=0)
            share = np.where(still[:, None], new, share)
            still &= moved >= 1e-3
            if not still.any():
                break
        reached = np.log(np.maximum((p * np.repeat(share, words, axis=0)).sum(axis=1), 1e-300))
        return share, np.add.reduceat(reached, starts)


def held_out(id_col: str = "doc_id"):
    """Is a row kept from learning? A null id is not held out, but nothing is learnt from it either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS, bits: int = BITS) -> Languages:
    """Trigram tables from at most ``most_docs`` labelled documents that are not held out.

    The sample is dealt evenly over the languages by a hash of the ids. Where there are very many languages, trigrams share
    fewer buckets, so that all tables together keep to ``MOST_CELLS`` cells (at least 2**``LEAST_BITS`` a language).
    Counts are added up on the executors, by language and block of buckets; the driver gets one table.
    """
    ids = docs.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang")).filter(F.col("__lang").isNotNull() & F.col("__id").isNotNull() & ~held_out("__id"))
    names = sorted(r[0] for r in ids.select("__lang").distinct().collect())
    bits = max(min(bits, LEAST_BITS), min(bits, (MOST_CELLS // max(1, len(names))).bit_length() - 1))
    if not names:
        return Languages([], np.zeros((1 << bits, 0), np.float32), bits)
    each = max(1, most_docs // len(names))
    # a language's rows are ranked in hash buckets first, so that no window holds them all
    bucket = F.pmod(F.xxhash64("__id"), F.lit(64))
    near = Window.partitionBy("__lang", bucket).orderBy(F.xxhash64("__id"), "__id")
    whole = Window.partitionBy("__lang").orderBy(F.xxhash64("__id"), "__id")
    sample = ids.withColumn("k", F.row_number().over(near)).filter(F.col("k") <= each).withColumn("k", F.row_number().over(whole)).filter(F.col("k") <= each).select("__id", "__lang")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                code, gram_offsets, run_offsets, _ = _grams(part, bits)
                bounds = gram_offsets[run_offsets].tolist()
                for i in range(part.n_docs):
                    if bounds[i + 1] > bounds[i]:
                        c = np.bincount(code[bounds[i] : bounds[i + 1]], minlength=1 << bits)
                        lang = langs[part.first + i]
                        counts[lang] = counts[lang] + c if lang in counts else c
        step = min(BLOCK, 1 << bits)
        parts = [(lang, a // step, c[a : a + step].astype("<i8").tobytes()) for lang, c in counts.items() for a in range(0, 1 << bits, step)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["lang", "block", "counts"])

    def add(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for lang, block, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums[lang, block] = sums.get((lang, block), 0) + np.frombuffer(c, "<i8")
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], names=["lang", "block", "counts"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__id").select("__lang", "text")
    place, step = {name: i for i, name in enumerate(names)}, min(BLOCK, 1 << bits)
    table, blocks = np.full((1 << bits, len(names)), SMOOTH), "lang string, block int, counts binary"
    for r in arrow_map(arrow_map(rows, run, blocks).repartition("lang", "block"), add, blocks).collect():
        table[r["block"] * step : (r["block"] + 1) * step, place[r["lang"]]] += np.frombuffer(r["counts"], "<i8")
    return Languages(names, np.log(table / table.sum(axis=0)).astype(np.float32), bits)


def identified(docs: DataFrame, languages: Languages, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages for every row of ``docs``.

    ``languages`` is the chosen set with its proportions, the largest first (ties: in the order of their names), ``lang_pred`` its first and
    ``score`` the proportion of that. ``lang_pred`` is ``und``, with score 0 and no languages, if the text is null or has no letter. Repeated rows
    are predicted alike, null ids stay null, an empty input gives no rows; other columns are
    ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches):
        model = shared.value
        names = np.array([*model.names, UNKNOWN], object)
        for batch in batches:
            pred, score, found = [], [], []
            for part in slices(batch.column(1), 1 << 20):
                k, s, every = model.infer(part)
                pred.append(names[k])
                score.append(s)
                found.append(every)
            known = batch.column(2).to_numpy(zero_copy_only=False)
            every = np.concatenate(found) if found else np.zeros((0, len(model.names)))
            every[~known.astype(bool)] = 0
            row, lang = np.nonzero(every)
            order = np.lexsort((lang, -every[row, lang], row))
            parts = pa.StructArray.from_arrays([pa.array(names[lang[order]], pa.string()), pa.array(np.minimum(every[row, lang][order], 1.0))], names=["lang", "share"])
            bounds = pa.array(np.searchsorted(row, np.arange(len(every) + 1)).astype(np.int32))
            p = np.where(known, np.concatenate(pred), UNKNOWN) if pred else np.zeros(0, object)
            s = np.where(known, np.concatenate(score), 0.0) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.string()), pa.array(s), pa.ListArray.from_arrays(bounds, parts)], names=["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return arrow_map(rows, run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identified(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
