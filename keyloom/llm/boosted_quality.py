"""A quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts, as numpy arrays over Arrow columns. The trees are grown
on the driver from a bounded sample of labelled rows (``MOST_ROWS``, by a hash of the id) and
flattened into arrays: feature, threshold and two children for each node. Scoring moves all
documents of a batch down all trees at once, level by level, without a Python loop over rows.
The model is some tens of kilobytes, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keyloom.llm.bytetext import Slice, shingles, slices
from keyloom.operators.grouping import free_name
from keyloom.plans.workspace import arrow_map

MOST_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 60, 4, 64, 0.2, 10, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "log_lines", "upper", "digits", "non_ascii", "bang", "symbols", "pipes", "commas", "stops",
    "quotes", "upper_words", "symbol_words", "short_words", "distinct_words", "distinct_triples", "repeated_next", "distinct_lines", "line_length", "longest_word",
]
_GROUPS = {"upper": range(65, 91), "digits": range(48, 58), "non_ascii": range(128, 256), "bang": b"!?", "symbols": b"#*$%&<>@^~=+_{}[]\\/", "pipes": b"|", "commas": b",;:", "stops": b".", "quotes": b"\"'()"}


def _distinct(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct values in each document."""
    values, bounds = values.copy(), offsets.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), np.int64)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = 1
    return np.diff(np.concatenate([[0], np.cumsum(new)])[offsets])


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def statistics(part: Slice) -> np.ndarray:
    """A row of FEATURES per document; all zeros for an empty text."""
    n = np.diff(part.offsets)
    words = np.diff(part.word_offsets)
    per_byte, per_word = np.maximum(n, 1), np.maximum(words, 1)
    inside = part.ends - part.starts
    hashes = part.word_hashes(lower=False)
    triples, triple_offsets = shingles(part, 3)
    flags = {}
    for name, group in _GROUPS.items():
        table = np.zeros(256, bool)
        table[list(group)] = True
        flags[name] = table[part.data]
    newline = part.data == 10
    lines = _sums(newline, part.offsets) + (n > 0)
    # the hash of a line is the sum of its words' hashes with their places
    at = np.concatenate([[0], np.cumsum(newline)])[part.starts] if len(part.starts) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(part.n_docs), words)
    line = at + doc  # also grows from one document to the next
    first = np.flatnonzero(np.diff(line, prepend=-1)) if len(line) else np.zeros(0, np.int64)
    if len(first):
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        text_lines = np.add.reduceat(hashes * (2 * place.astype(np.uint64) + np.uint64(1)), first)
    else:
        text_lines = np.zeros(0, np.uint64)
    line_offsets = np.searchsorted(first, part.word_offsets)
    with_words = np.diff(line_offsets)
    start = part.data[part.starts] if len(part.starts) else part.data[:0]
    end = part.data[part.ends - 1] if len(part.starts) else part.data[:0]
    second = part.data[np.minimum(part.starts + 1, part.ends - 1)] if len(part.starts) else start
    big = (start >= 65) & (start <= 90) & (second >= 65) & (second <= 90)
    odd = flags["symbols"][part.ends - 1] | flags["pipes"][part.ends - 1] if len(part.starts) else np.zeros(0, bool)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[part.word_offsets[:-1][words > 0]] = False
    longest = np.zeros(part.n_docs, np.int64)
    if len(inside):
        longest[words > 0] = np.maximum.reduceat(inside, part.word_offsets[:-1][words > 0])
    bang_end = (end == 33) | (end == 63)
    columns = [
        np.log1p(n), np.log1p(words), _sums(inside, part.word_offsets) / per_word, np.log1p(lines),
        *[_sums(flags[k], part.offsets) / per_byte for k in _GROUPS],
        _sums(big, part.word_offsets) / per_word, _sums(odd | bang_end, part.word_offsets) / per_word, _sums(inside <= 2, part.word_offsets) / per_word,
        _distinct(hashes, part.word_offsets) / per_word, _distinct(triples, triple_offsets) / np.maximum(np.diff(triple_offsets), 1),
        _sums(again, part.word_offsets) / per_word, _distinct(text_lines, line_offsets) / np.maximum(with_words, 1), n / np.maximum(lines, 1), longest,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Forest:
    """Trees as flat arrays; children of a leaf are the leaf itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray, chunk: int = 8192) -> np.ndarray:
        out = np.full(len(x), self.base)
        for a in range(0, len(x), chunk):
            rows = x[a : a + chunk]
            at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            row = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = np.where(rows[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + chunk] += self.value[at].sum(axis=1)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fitted(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least_leaf: int = LEAST_LEAF, l2: float = L2) -> Forest:
    """Second-order boosting of the logistic loss on quantile histograms; rows in any order.

    With one class only, or no rows, the forest is its prior.
    """
    n, k = x.shape
    prior = (float(y.sum()) + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if n and 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)], axis=1)
        margin = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            root = len(nodes)
            roots.append(root)
            nodes.append([0, np.inf, root, root, 0.0])
            at, open_nodes = np.full(n, root), [root]
            for level in range(depth + 1):
                grown: list[int] = []
                for node in open_nodes:
                    rows = np.flatnonzero(at == node)
                    gs, hs = g[rows].sum(), h[rows].sum()
                    nodes[node][4] = -rate * gs / (hs + l2)
                    if level == depth or len(rows) < 2 * least_leaf:
                        continue
                    flat = (binned[rows] + np.arange(k) * bins).ravel()
                    size = k * bins
                    gb = np.bincount(flat, np.repeat(g[rows], k), size).reshape(k, bins).cumsum(1)
                    hb = np.bincount(flat, np.repeat(h[rows], k), size).reshape(k, bins).cumsum(1)
                    cb = np.bincount(flat, minlength=size).reshape(k, bins).cumsum(1)
                    gain = gb**2 / (hb + l2) + (gs - gb) ** 2 / (hs - hb + l2) - gs**2 / (hs + l2)
                    gain[(cb < least_leaf) | (len(rows) - cb < least_leaf)] = -np.inf
                    j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                    if not gain[j, b] > 1e-6 or b >= len(edges[j]):
                        continue
                    a, c = len(nodes), len(nodes) + 1
                    nodes[node][:4] = [int(j), float(edges[j][b]), a, c]
                    nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, c, c, 0.0]]
                    at[rows] = np.where(binned[rows, j] <= b, a, c)
                    grown += [a, c]
                open_nodes = grown
            margin += np.array([x[4] for x in nodes])[at]
    if not roots:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Forest(f.astype(np.int32), t.astype(np.float32), left.astype(np.int32), right.astype(np.int32), v.astype(np.float64), np.array(roots, np.int32), base, depth)


def held_out(id_col: str = "doc_id"):
    """Is a row kept from learning? A null id is not held out, but has no labels either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most_rows`` labelled documents that are not held out.

    An id labelled more than once has its largest label; of rows that repeat an id, the greatest text counts.
    """
    own = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).filter(F.col("__id").isNotNull() & F.col("__label").isin(0, 1))
    own = own.filter(~held_out("__id")).groupBy("__id").agg(F.max("__label").alias("__label"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(most_rows)  # the bound of the broadcast

    def run(batches):
        for batch in batches:
            for part in slices(batch.column(1)):
                x = statistics(part)
                y = batch.column(0).slice(part.first, part.n_docs).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([y, pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["y", "x"])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(own), "__id")
    rows = rows.groupBy("__id").agg(F.max("__label").alias("__label"), F.max("text").alias("text")).select("__label", "text")
    found = arrow_map(rows, run, "y int, x array<float>").toArrow()
    y = found.column("y").to_numpy().astype(np.float64)
    x = found.column("x").combine_chunks()
    x = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).values.to_numpy(zero_copy_only=False).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)), np.float32)
    order = np.lexsort([*x.T, y])  # no order of tasks shows in the model
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, **options) -> Forest:
    return fitted(*training_rows(docs, labels, **options))


def scored(docs: DataFrame, forest: Forest, *, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with all their columns and ``name``: 0 to 1, higher for better texts.

    Null text is empty; empty texts are scored like others. Repeated rows score alike. An
    existing column ``name`` is replaced.
    """
    docs = docs.drop(name)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            x = [statistics(part) for part in slices(batch.column(at))]
            score = shared.value.scores(np.concatenate(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return arrow_map(docs, run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; labels come from rows not held out.

    Null and empty texts are scored by the statistics of an empty text. Repeated rows stay and score alike; a null id is not
    held out. Without labels every score is the prior. An empty table gives no rows; other columns are ignored.
    """
    forest = fit(docs, labels)
    rows = scored(docs.select("doc_id", "text"), forest)
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, *, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns, whatever their names.

    Null and empty texts are judged like others; repeated rows stay or go together. An empty table stays empty.
    """
    own = free_name(docs, "score")
    return scored(docs, fit(docs, labels), name=own).filter(F.col(own) >= least).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: a quality score for every document."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
