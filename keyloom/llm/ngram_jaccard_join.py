"""Exact Jaccard join on word shingles, as a join of Voronoi regions in the Jaccard metric.

Jaccard distance is a metric, but texts that are no copies of each other all lie at distance
(nearly) 1, so a few documents as pivots would leave almost everything at equal distance from
all of them. The pivots of the first level are therefore the single shingles themselves, taken as
one-element sets: A lies at distance 1 - 1/|A| from the pivots it contains and at 1 from all
others, ties going to the first pivot in one global order (rare shingles first). That gives
each document its region. Windows: a partner at distance <= 1 - t shares at least t|A|
shingles, so it shares one of the first |A| - ceil(t|A|) + 1 in the order; a boundary document
is replicated to exactly these regions, and no link can be missed.

Inside a region a pair is a candidate if its sizes and the shingles left behind the pivot still
allow the needed overlap, and if it meets in as many regions as its sizes demand. A crowded region takes
documents as pivots, joins everybody to them first, and is joined again (exactly) only between
the components that the links found so far leave apart: within a component nothing more
can be learnt, so a group of n copies costs about n comparisons.

Identical sets are one entry throughout. Candidates are verified on their whole sets.
The global order uses the counts of shingles over all documents, in 2**bits buckets (a fixed
size for any corpus); the order affects the speed only. Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bytetext import sets_of, shingles, slices
from keyloom.operators.components import connected_components
from keyloom.operators.grouping import free_name, salt, salt_mask, salts_of
from keyloom.plans.workspace import arrow_map, small, stored

WIDTH, NUMER, DENOM = 5, 75, 100  # words in a shingle; similarity of at least NUMER / DENOM
BITS = 20
CHUNK = 4096
CROWD, PER_ENTRY, PIVOTS = 4, 2, 2  # a region of more than CROWD entries and PER_ENTRY pairs for each is joined to PIVOTS pivots first
ENTRY = np.dtype([("s", "<u8"), ("fp", "<u8"), ("n", "<u4"), ("pos", "<u4")])
ENTRIES_A_TASK = 500_000  # of 24 bytes; a task holds and sorts them in several copies, two tasks beside a full heap
MOST_PAIRS = 500_000  # that a task holds before it hands them on
MOST_BROADCAST = 1_000_000  # ids
TILE = 2048  # texts of one block of candidates
U = np.uint64


def _sets(column, width: int):
    """(slice, sorted distinct shingles, offsets) of each slice of a column."""
    for part in slices(column):
        yield part, *sets_of(*shingles(part, width))


def _fingerprint(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 bits for each set, of its shingles and its size."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values ^ (values >> U(29))) * U(0xBF58476D1CE4E5B9), dtype=np.uint64, out=total[1:])
    x = total[offsets[1:]] - total[offsets[:-1]]
    return (x ^ (x >> U(32)) ^ np.diff(offsets).astype(np.uint64)) * U(0x94D049BB133111EB)


COUNT = np.dtype([("at", "<u2"), ("n", "<u4")])


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    out = np.empty(len(at), COUNT)
    out["at"], out["n"] = at, counts[at]
    return out.tobytes()


def _scan(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """A row per document (doc_id, n, fp), and rows (chunk, counts) of each task's sketch."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            ns, fps = [], []
            for _, values, offsets in _sets(batch.column(1), width):
                counts += np.bincount((values >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
                ns.append(np.diff(offsets))
                fps.append(_fingerprint(values, offsets))
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.concatenate(ns) if ns else np.zeros(0, np.int64)), pa.array(np.concatenate(fps).view(np.int64) if fps else np.zeros(0, np.int64)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=["doc_id", "n", "fp", "chunk", "counts"],
            )
        step = min(CHUNK, 1 << bits)
        some = [i for i in range(0, 1 << bits, step) if counts[i : i + step].any()]  # most are sparse where tasks are small
        k = len(some)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([i // step for i in some], pa.int32()), pa.array([_sparse(counts[i : i + step]) for i in some], pa.binary())],
            names=["doc_id", "n", "fp", "chunk", "counts"],
        )

    return arrow_map(docs, run, "doc_id long, n long, fp long, chunk int, counts binary")


def _ranks(scan: DataFrame, bits: int) -> np.ndarray:
    """For each bucket its class in the global order: 0 for usual counts, then by size."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(c.as_buffer(), COUNT)
                if k not in total:
                    total[k] = np.zeros(CHUNK, np.int64)
                total[k][own["at"]] += own["n"]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    counts, step = np.zeros(1 << bits, np.int64), min(CHUNK, 1 << bits)
    rows = scan.filter("chunk is not null").select("chunk", "counts")
    for r in arrow_map(rows.repartition("chunk"), add, "chunk int, counts binary").collect():
        counts[r["chunk"] * step : (r["chunk"] + 1) * step] = np.frombuffer(r["counts"], "<i8")[:step]
    usual = float(np.median(counts))
    excess = np.maximum(0, counts - usual - 4 * np.sqrt(usual + 1))
    return np.where(excess > 0, 1 + np.floor(2 * np.log2(1 + excess)), 0).astype(np.uint8)


def least_overlap(n, m, numer: int = NUMER, denom: int = DENOM):
    """The smallest |A & B| with |A & B| / |A | B| >= numer / denom, for |A| = n and |B| = m."""
    return -(-(numer * (n + m)) // (numer + denom))


def least_meetings(n, m, numer: int = NUMER, denom: int = DENOM):
    """In how many regions linked sets of these sizes meet at least."""
    return least_overlap(n, m, numer, denom) - np.maximum(-(-numer * n // denom), -(-numer * m // denom)) + 1


def _prefixes(docs: DataFrame, ranks, width: int, bits: int, numer: int, denom: int, parts: int) -> DataFrame:
    """(part, entries): each set's entries for the regions in its window, by part of the regions."""

    def run(batches):
        order = ranks.value
        held, count = [], 0

        def flush():
            rows = np.concatenate(held)
            to = (rows["s"] % U(parts)).astype(np.int32)
            at = np.lexsort((rows["fp"], rows["s"], to))
            rows, to = rows[at], to[at]
            new = np.ones(len(rows), bool)
            new[1:] = (rows["s"][1:] != rows["s"][:-1]) | (rows["fp"][1:] != rows["fp"][:-1])
            rows, to = rows[new], to[new]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            ends = np.append(first[1:], len(rows))
            return pa.RecordBatch.from_arrays([pa.array(to[first]), pa.array([rows[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["part", "entries"])

        for batch in batches:
            for _, values, offsets in _sets(batch.column(0), width):
                fp, n = _fingerprint(values, offsets), np.diff(offsets)
                window = np.where(n > 0, n - -(-numer * n // denom) + 1, 0)
                doc = np.repeat(np.arange(len(n)), n)
                rank = order[(values >> U(64 - bits)).astype(np.int64)]
                # by document, then class; the sets are sorted by hash already
                at = np.argsort((doc.astype(np.int64) << 8) | rank, kind="stable")
                pos = np.arange(len(values)) - offsets[doc]
                inside = pos < window[doc]
                rows = np.empty(int(inside.sum()), ENTRY)
                rows["s"], rows["fp"], rows["n"], rows["pos"] = values[at][inside], fp[doc][inside], n[doc][inside], pos[inside]
                held.append(rows)
                count += len(rows)
                if count >= ENTRIES_A_TASK:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return arrow_map(docs.select("text"), run, "part int, entries binary")


def _dealt(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """``columns`` of ``df``, each part in the task of its number: hashed numbers would leave some tasks several times the usual load."""
    return df.repartitionById(tasks, F.col("part")).select(*columns)


def _fits(n, m, i, j, numer: int, denom: int):
    """May two sets that meet at places i and j, and nowhere before, be linked?"""
    small, large = np.minimum(n, m), np.maximum(n, m)
    return (denom * small >= numer * large) & (np.minimum(n - i, m - j) >= least_overlap(n, m, numer, denom))


def _fit(p: np.ndarray, q: np.ndarray, numer: int, denom: int) -> np.ndarray:
    return _fits(*(x.astype(np.int64) for x in (p["n"], q["n"], p["pos"], q["pos"])), numer, denom)


def _pairs_of(rows: np.ndarray, first: np.ndarray, size: np.ndarray, numer: int, denom: int, chunk: int = 250_000):
    """(x, y, do the places fit?) for all pairs of rows[first : first + size], sizes permitting."""
    left = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    partners = np.repeat(first + size, size) - left - 1
    done = np.concatenate([[0], np.cumsum(partners)])
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(done, done[a] + chunk, "right")) - 1)
        x = np.repeat(left[a:b], partners[a:b])
        y = x + 1 + np.arange(len(x)) - np.repeat(done[a:b] - done[a], partners[a:b])
        n, m = rows["n"][x].astype(np.int64), rows["n"][y].astype(np.int64)
        ok = denom * np.minimum(n, m) >= numer * np.maximum(n, m)
        x, y = x[ok], y[ok]
        yield x, y, _fit(rows[x], rows[y], numer, denom)
        a = b


PAIR = "fp_a long, n_a long, fp_b long, n_b long"


MET = np.dtype([("fa", "<u8"), ("fb", "<u8"), ("na", "<u4"), ("nb", "<u4"), ("met", "<u4"), ("more", "<u4"), ("fit", "?")])


def _ints(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array(x.astype(np.int64)) for x in arrays]


def _summed(rows: np.ndarray) -> np.ndarray:
    """Each pair once (the smaller fingerprint first), with the sum of its meetings."""
    turn = rows["fa"] > rows["fb"]
    own = rows.copy()
    for x, y in (("fa", "fb"), ("na", "nb")):
        own[x], own[y] = np.where(turn, rows[y], rows[x]), np.where(turn, rows[x], rows[y])
    own = own[np.lexsort((own["fb"], own["fa"]))]
    if not len(own):
        return own
    first = np.flatnonzero(np.concatenate([[True], (own["fa"][1:] != own["fa"][:-1]) | (own["fb"][1:] != own["fb"][:-1])]))
    met, fit = np.add.reduceat(own["met"], first), np.logical_or.reduceat(own["fit"], first)
    own = own[first]
    own["met"], own["fit"] = met, fit
    return own


def _packed(rows: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(part, pairs) for the tasks that add the meetings up."""
    if not len(rows):
        return []
    to = ((rows["fa"] ^ rows["fb"]) % U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    first = np.flatnonzero(np.diff(to[order], prepend=-1)).tolist()
    return [(int(to[order[a]]), rows[order[a:b]].tobytes()) for a, b in zip(first, [*first[1:], len(rows)], strict=True)]


class _Counted:
    """Pairs of a task, each once, with how often they met and whether they ever fitted."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        _, self.first, self.set_of = np.unique(rows["fp"], return_index=True, return_inverse=True)
        self.code, self.count, self.fit = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.held, self.n_held = [], 0

    def add(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray, count: int = 1) -> None:
        a, b = self.set_of[x].astype(np.int64), self.set_of[y].astype(np.int64)
        self.held.append(((np.minimum(a, b) << 32) | np.maximum(a, b), np.full(len(a), count), fit))
        self.n_held += len(a)
        if self.n_held > 1_000_000:
            self.settle()

    def settle(self) -> None:
        code, count, fit = (np.concatenate(c) for c in zip((self.code, self.count, self.fit), *self.held, strict=True))
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if len(first):
            self.code, self.count, self.fit = code[first], np.add.reduceat(count[order], first), np.logical_or.reduceat(fit[order], first)
        self.held, self.n_held = [], 0

    def packed(self, parts: int) -> list[tuple[int, bytes]]:
        """(part, pairs) for the tasks that add the meetings up."""
        self.settle()
        p, q = self.rows[self.first[self.code >> 32]], self.rows[self.first[self.code & 0xFFFFFFFF]]
        out = np.empty(len(p), MET)
        out["fa"], out["na"], out["fb"], out["nb"], out["met"], out["more"], out["fit"] = p["fp"], p["n"], q["fp"], q["n"], self.count, 0, self.fit
        return _packed(out, parts)


def _regions(prefixes: DataFrame, numer: int, denom: int, parts: int) -> DataFrame:
    """What the regions give, by ``kind``.

    0: packed pairs of a part, with the number of their meetings in calm regions and whether the
    places of one meeting fit; 1: for each set (fp_a) the number of its crowded regions; 2: the
    entries of a region that is to be joined again.
    """

    def batch(kind: int, part=None, fp=None, met=None, packed=None) -> pa.RecordBatch:
        k = len(fp) if fp is not None else len(packed)
        columns = [(np.full(k, kind), pa.int32()), (part, pa.int32()), (fp, pa.int64()), (met, pa.int64()), (packed, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.nulls(k, t) if c is None else pa.array(c, t) for c, t in columns], names=["kind", "part", "fp_a", "met", "packed"])

    def run(batches):
        blobs = [c.as_buffer() for b in batches for c in b.column(0)]
        if not blobs:
            return
        rows = np.concatenate([np.frombuffer(b, ENTRY) for b in blobs])
        del blobs
        rows = rows[np.lexsort((rows["fp"], rows["s"]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows["s"][1:] != rows["s"][:-1]) | (rows["fp"][1:] != rows["fp"][:-1])
        rows = rows[new]
        first = np.flatnonzero(np.concatenate([[True], rows["s"][1:] != rows["s"][:-1]]))
        size = np.diff(np.append(first, len(rows)))
        alone = np.repeat(size == 1, size)
        rows = rows[~alone]
        first, size = np.cumsum(size[size > 1]) - size[size > 1], size[size > 1]
        if not len(rows):
            return
        pairs = _Counted(rows)
        calm = size <= CROWD
        for x, y, fit in _pairs_of(rows, first[calm], size[calm], numer, denom):
            pairs.add(x, y, fit)
        crowded = rows[np.repeat(~calm, size)]
        for a, k in zip(first[~calm].tolist(), size[~calm].tolist(), strict=True):
            found, full = [], 0
            for x, y, fit in _pairs_of(rows, np.array([a]), np.array([k]), numer, denom, 250_000):
                found.append((x[fit], y[fit]))
                full += int(fit.sum())
                if full > PER_ENTRY * k:
                    break
            if full > PER_ENTRY * k:
                own, found = np.arange(a, a + k), []
                for pivot in own[np.lexsort((rows["fp"][own], rows["pos"][own]))[:PIVOTS]].tolist():
                    fit = _fit(rows[pivot : pivot + 1], rows[own], numer, denom) & (own != pivot)
                    found.append((np.full(int(fit.sum()), pivot), own[fit]))
                yield batch(2, packed=[rows[a : a + k].tobytes()])
            for x, y in found:
                pairs.add(x, y, np.ones(len(x), bool), 0)  # counted with the crowded regions
        if out := pairs.packed(parts):
            yield batch(0, part=[k for k, _ in out], packed=[b for _, b in out])
        if len(crowded):
            fp, n = np.unique(crowded["fp"], return_counts=True)
            yield batch(1, fp=fp.astype(np.int64), met=n.astype(np.int64))

    return arrow_map(prefixes, run, "kind int, part int, fp_a long, met long, packed binary")


def _met(packed: DataFrame, tasks: int, enough=None) -> DataFrame:
    """Each pair once, with the sum of its meetings; only those for which ``enough(pairs)`` holds."""

    def run(batches):
        blobs = [c.as_buffer() for b in batches for c in b.column(0)]
        if not blobs:
            return
        own = _summed(np.concatenate([np.frombuffer(b, MET) for b in blobs]))
        if enough is not None:
            own = own[enough(own)]
        yield pa.RecordBatch.from_arrays([*_ints(own["fa"], own["na"], own["fb"], own["nb"], own["met"]), pa.array(own["fit"])], names=["fp_a", "n_a", "fp_b", "n_b", "met", "fit"])

    return arrow_map(_dealt(packed.select("part", "packed"), tasks, "packed"), run, f"{PAIR}, met long, fit boolean")


def _least_sql(numer: int, denom: int) -> str:
    """``least_meetings`` of n_a and n_b in SQL."""
    return f"(ceil({numer} * (n_a + n_b) / {numer + denom}) - greatest(ceil({numer} * n_a / {denom}), ceil({numer} * n_b / {denom})) + 1)"


def _candidates(found: DataFrame, numer: int, denom: int, tasks: int) -> DataFrame:
    """The pairs whose meetings suffice.

    Two linked sets share ``least_overlap`` shingles or more. Outside their windows lie the last ones
    of these in the order, at most as many as the larger part that one of the windows leaves out; so
    they meet at least ``least`` times, and the first time their places fit. Meetings in
    crowded regions are not counted pair by pair, but each set has at most as many as it has
    crowded regions; pairs that meet only there are found when those are joined again.
    """
    pairs = _met(found.filter("kind = 0"), tasks)
    crowded = found.filter("kind = 1").groupBy("fp_a").agg(F.sum("met").alias("crowded"))
    if crowded.isEmpty():
        pairs = pairs.withColumn("more", F.lit(0))
    else:
        for k in "ab":
            pairs = pairs.join(crowded.select(F.col("fp_a").alias(f"fp_{k}"), F.col("crowded").alias(f"crowded_{k}")), f"fp_{k}", "left")
        pairs = pairs.withColumn("more", F.least(F.coalesce("crowded_a", F.lit(0)), F.coalesce("crowded_b", F.lit(0))))
    return pairs.filter(f"met + more >= {_least_sql(numer, denom)} and (fit or more > 0)").select("fp_a", "n_a", "fp_b", "n_b")


def _members(crowds: DataFrame) -> DataFrame:
    """The entries of crowded regions as rows."""

    def run(batches):
        for batch in batches:
            for c in batch.column(0):
                r = np.frombuffer(c.as_buffer(), ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(r["s"].astype(np.int64)), pa.array(r["fp"].astype(np.int64)), pa.array(r["n"].astype(np.int64)), pa.array(r["pos"].astype(np.int64))], names=["s", "fp", "n", "pos"])

    return arrow_map(crowds.select("packed"), run, "s long, fp long, n long, pos long")


def _between(members: DataFrame, numer: int, denom: int, tasks: int, block: int = 512, most: int = MOST_PAIRS) -> DataFrame:
    """Candidate pairs of different components, region by region (s, fp, n, pos, component, other).

    Pairs that also met in regions that are not joined again were judged before; ``other`` bounds
    how many crowded ones of these a set has, so met + other must reach ``least_meetings`` here too.
    """
    def pairs(rows: np.ndarray, comp: np.ndarray, other: np.ndarray):
        for a in range(0, len(rows), block):
            for b in range(a, len(rows), block):
                p, q = rows[a : a + block], rows[b : b + block]
                small, large = np.minimum(p["n"][:, None], q["n"][None]).astype(np.int64), np.maximum(p["n"][:, None], q["n"][None]).astype(np.int64)
                ok = (comp[a : a + block, None] != comp[None, b : b + block]) & (denom * small >= numer * large)
                x, y = np.nonzero(np.triu(ok, 1) if a == b else ok)
                out = np.empty(len(x), MET)
                p, q = p[x], q[y]
                out["fa"], out["na"], out["fb"], out["nb"], out["met"], out["fit"] = p["fp"], p["n"], q["fp"], q["n"], 1, _fit(p, q, numer, denom)
                out["more"] = np.minimum(other[a : a + block][x], other[b : b + block][y])
                yield out

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        found, n_found = [], 0

        def region():
            s, fp, n, pos, comp, other = (np.concatenate(c) for c in zip(*held, strict=True))
            if (comp != comp[0]).any():
                rows = np.empty(len(s), ENTRY)
                rows["s"], rows["fp"], rows["n"], rows["pos"] = s.astype(np.uint64), fp.astype(np.uint64), n, pos
                yield from pairs(rows, comp, other)

        def handed(own: np.ndarray):
            out = _packed(own, tasks)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=["part", "packed"])

        def ended():
            nonlocal found, n_found
            for out in region():
                found.append(out)
                n_found += len(out)
                if n_found > most:
                    own = _summed(np.concatenate(found))
                    found, n_found = [own], len(own)
                    if 2 * len(own) > most:  # the rest of the sum is the reader's
                        yield handed(own)
                        found, n_found = [], 0

        for batch in batches:
            s, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(s):
                continue
            cuts = [0, *(np.flatnonzero(s[1:] != s[:-1]) + 1).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[-1][0][0] != s[a]:
                    yield from ended()
                    held = []
                held.append((s[a:b], *(c[a:b] for c in rest)))
        if held:
            yield from ended()
        if found:
            yield handed(_summed(np.concatenate(found)))

    def enough(p: np.ndarray) -> np.ndarray:
        n, m = p["na"].astype(np.int64), p["nb"].astype(np.int64)
        return p["fit"] & (p["met"].astype(np.int64) + p["more"] >= least_meetings(n, m, numer, denom))

    entries = members.select("s", "fp", "n", "pos", "component", "other").repartition("s").sortWithinPartitions("s")
    return _met(arrow_map(entries, run, "part int, packed binary"), tasks, enough).select("fp_a", "n_a", "fp_b", "n_b")


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int, numer: int, denom: int) -> DataFrame:
    """The pairs (a, b: doc ids of representatives) whose whole sets are similar enough.

    Candidates that hang together are verified in one place, so that a text is moved once for
    all its pairs. Where more than ``TILE`` of them hang together, they are dealt into blocks, and
    each pair of blocks that holds candidates is a place (a tile) of its own.
    """
    for k in "ab":
        pairs = pairs.join(reps.select(F.col("fp").alias(f"fp_{k}"), F.col("n").alias(f"n_{k}"), F.col("rep").alias(k)), [f"fp_{k}", f"n_{k}"])
    pairs = stored(pairs.select("a", "b").distinct(), "pairs")
    together = connected_components(pairs)
    blocks = together.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    placed = pairs.join(together, F.col("a") == F.col("node")).join(blocks, "component")
    at = [F.pmod(F.xxhash64(k), F.col("blocks")) for k in "ab"]
    placed = stored(placed.select("a", "b", F.xxhash64("component", F.least(*at), F.greatest(*at)).alias("tile")), "tiles")
    needed = placed.select("tile", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(needed.hint("merge"), "doc_id").select("tile", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = texts.unionByName(placed.withColumn("text", F.lit(None).cast("string"))).repartition("tile").sortWithinPartitions("tile", "b")

    def verify(batches):
        tile, sets = None, {}
        for batch in batches:
            tiles, ones, others = (batch.column(i).to_pylist() for i in range(3))
            found: list[tuple[int, int]] = []
            own: dict[int, np.ndarray] = {}
            for part, values, offsets in _sets(batch.column(3), width):
                for i in range(part.n_docs):
                    if others[part.first + i] is None:
                        own[part.first + i] = values[offsets[i] : offsets[i + 1]].copy()
            for i, (t, x, y) in enumerate(zip(tiles, ones, others, strict=True)):
                if t != tile:
                    tile, sets = t, {}
                if y is None:
                    sets[x] = own[i]
                else:
                    both = np.concatenate([sets[x], sets[y]])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if denom * common >= numer * (len(both) - common):
                        found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return stored(arrow_map(rows, verify, "a long, b long"), "links")


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, numer: int = NUMER, denom: int = DENOM, bits: int = BITS, salts: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Two documents are linked when denom * |A & B| >= numer * |A | B| for their sets of
    distinct ``width``-word shingles (A-Z ignored in case); ``component_id`` is the smallest id
    reachable by links. A shorter text is one shingle. Null, empty and wordless texts have no
    set and are linked with nothing, not even with each other. Repeated rows stay, with one
    component. Ids must be unique per text and not null: rows with a null id get a null
    component. An empty input gives no rows. Other columns are ignored, whatever their names.
    """
    if not 0 < numer <= denom:
        raise ValueError("the similarity must be above 0 and at most 1")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scan = stored(_scan(docs, width, bits), "scan")
    ranks = spark.sparkContext.broadcast(_ranks(scan, bits))
    rows = scan.filter("chunk is null").select("doc_id", "n", "fp", salt("doc_id", salts=salts).alias("salt"))
    salted = rows.filter("n > 0 and doc_id is not null").groupBy("n", "fp", "salt").agg(F.min("doc_id").alias("doc_id"))
    reps = stored(salted.groupBy("n", "fp").agg(F.min("doc_id").alias("rep"), salt_mask("salt").alias("mask")), "reps")

    entries = rows.agg(F.sum(F.expr(f"n - ceil({numer} * n / {denom}) + 1"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // ENTRIES_A_TASK))
    prefixes = _prefixes(docs.filter("doc_id is not null"), ranks, width, bits, numer, denom, tasks)
    found = stored(_regions(_dealt(prefixes, tasks, "entries"), numer, denom, tasks), "regions")

    links = _links(_candidates(found, numer, denom, tasks), reps, docs, width, numer, denom)
    components = connected_components(links)
    crowds = found.filter("kind = 2")
    if not crowds.isEmpty():
        labels = reps.join(components, F.col("rep") == F.col("node"), "left").select("n", "fp", F.coalesce("component", "rep").alias("component"))
        crowded = found.filter("kind = 1").groupBy(F.col("fp_a").alias("fp")).agg(F.sum("met").alias("crowded"))
        members = stored(_members(crowds).join(labels, ["n", "fp"]), "members")
        here = members.groupBy("fp").agg(F.count(F.lit(1)).alias("here"))
        members = members.join(here, "fp").join(crowded, "fp").withColumn("other", F.col("crowded") - F.col("here"))
        again = _between(members, numer, denom, tasks)
        more = _links(again, reps, docs, width, numer, denom)
        components = connected_components(links.unionByName(more))
    labelled = reps.join(components, F.col("rep") == F.col("node"), "left").select("n", "fp", "mask", F.coalesce("component", "rep").alias("component_id"))
    spread = labelled.withColumn("salt", F.explode(salts_of("mask", salts))).drop("mask")
    return rows.join(spread, ["n", "fp", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps the document with its smallest id.

    All columns stay, whatever their names. Documents without words (null, empty, blank) and rows with a null id
    always stay, and so do repeated rows of a document that stays. An empty table stays empty.
    """
    found = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    own = free_name(docs, "id")
    gone = stored(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(own)).distinct(), "gone")
    return docs.join(small(gone, MOST_BROADCAST), F.col(id_col) == F.col(own), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document with the size of its set and its component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
