"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in a hashed order, form blocks of ``block_rows``. With target weight w the
j-th block (from 1) of a source is released at slot floor((j - 1) / w) and due at ceil(j / w).
In each slot the released block with the earliest deadline goes next. On one processor this
keeps every deadline (Baruah et al., 1996), so at any slot each source is less than one block
away from its share.

Weights are exact whole numbers, never rounded. Where their sum over the common divisor is at
most ``LONGEST_PERIOD`` (and the blocks left), the schedule repeats after so many slots: the driver simulates one
period, and a block's slot follows from its number by arithmetic. Otherwise it simulates the whole
phase. When a source runs out, a new phase starts with the weights of those that are left; there
are at most as many phases as sources. All rows keep a place: none is dropped or repeated.

Only the counts of rows by source and the slots of the phases (8 bytes for each of at most
``MOST_BLOCKS`` whole blocks, and a last one for each source) are on the driver and in a broadcast. Rows are numbered within their source over hash buckets, so that a source with a
third of all rows is no hot key.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.grouping import free_name, numbered
from keyloom.plans.workspace import arrow_map, stored

BLOCK_ROWS, TICKETS, MOST_SOURCES = 16, 1000, 1_000
LONGEST_PERIOD, MOST_BLOCKS = 1 << 14, 1 << 20


def period(tickets: list[int], blocks: list[int] | None = None) -> list[int]:
    """The source of each slot of one period (sum of tickets) under earliest deadline first.

    With ``blocks``, the slots until the first source has had so many. Equal deadlines: the
    source with more tickets, then the earlier one, goes first.
    """
    total, waiting, ready, out = sum(tickets), [], [], []
    for i, q in enumerate(tickets):
        if q:
            heapq.heappush(waiting, (0, i, 1))
    for slot in range(total if blocks is None else min(total, sum(blocks))):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // tickets[i]), -tickets[i], i, j))
        if not ready:
            raise AssertionError("idle slot: the tickets do not fill the period")
        due, _, i, j = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("deadline missed")
        out.append(i)
        if blocks is not None and j == blocks[i]:
            break
        if j < tickets[i]:
            heapq.heappush(waiting, (j * total // tickets[i], i, j + 1))
    return out


def tickets_of(weights: dict[str | None, float], sources: list[str | None], tickets: int = TICKETS) -> list[int]:
    """Whole numbers in exactly the proportion of the weights; without one, a share of one in ``tickets`` of their sum."""
    own = [Fraction(max(0.0, float(weights.get(s, 0.0)))) for s in sources]
    least = sum(own) / tickets or Fraction(1)
    own = [w or least for w in own]
    scale = lcm(*[w.denominator for w in own])
    return [int(w * scale) for w in own]


def tempered(rows: dict[str | None, int], power: float = 0.5) -> dict[str | None, float]:
    """Weights in proportion to the sources' sizes to a power below 1."""
    return {s: n**power for s, n in rows.items()}


@dataclass
class Phase:
    """From ``first_slot`` on; ``served`` and ``active`` by source; ``slots[i]`` are source i's slots in a period."""

    first_slot: int
    first_row: int
    length: int
    served: np.ndarray
    slots: list[np.ndarray]


def phases(rows: list[int], tickets: list[int], block_rows: int = BLOCK_ROWS) -> list[Phase]:
    """The schedule of all blocks in phases; each but the last ends when a source runs out."""
    blocks = np.array([-(-n // block_rows) for n in rows], np.int64)
    served, out, slot, row = np.zeros(len(rows), np.int64), [], 0, 0
    while (served < blocks).any():
        active = [i for i in range(len(rows)) if served[i] < blocks[i]]
        common = gcd(*[tickets[i] for i in active])
        q, left = [tickets[i] // common for i in active], [int(blocks[i] - served[i]) for i in active]
        periodic = sum(q) <= min(LONGEST_PERIOD, sum(left))
        order = np.array(period(q, None if periodic else left))
        length, slots = len(order), [np.zeros(0, np.int64)] * len(rows)
        ends = []
        for k, i in enumerate(active):
            slots[i] = np.flatnonzero(order == k)
            if periodic:
                ends.append(int((left[k] - 1) // q[k] * length + slots[i][(left[k] - 1) % q[k]]) + 1)
            else:
                ends.append(length if order[-1] == k else length + 1)
        stop = min(ends)
        out.append(Phase(slot, row, length, served.copy(), slots))
        for i in active:
            served[i] += stop // length * len(slots[i]) + np.searchsorted(slots[i], stop % length)
        ended = active[ends.index(stop)]
        slot += stop
        row += stop * block_rows - int(blocks[ended] * block_rows - rows[ended])
    return out


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, tickets: int = TICKETS, buckets: int = 64) -> DataFrame:
    """doc_id, source, block, slot, position for every row of ``docs``.

    Blocks have ``block_rows`` rows; if that is not given, ``BLOCK_ROWS``, or as many more as it takes to have no more than
    ``MOST_BLOCKS`` whole blocks: the schedule on the driver, and its broadcast, then have a fixed bound.

    ``block`` counts within the source, ``slot`` over all blocks, ``position`` (from 0, dense) over
    all rows. ``weights`` are the targets; without them, the square roots of the sizes. A
    source without a weight gets one part in ``tickets`` of the others' sum; null is a source of
    its own. Repeated rows get places of their own; null ids too. An empty input gives no rows.
    Other columns are ignored, whatever their names. More than ``MOST_SOURCES`` sources raise an error.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source")), "sources")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(sizes.values()) // MOST_BLOCKS))
    plan = phases([sizes[s] for s in names], tickets_of(weights if weights is not None else tempered(sizes), names, tickets), block_rows)
    shared = rows.sparkSession.sparkContext.broadcast((names, plan))

    def place(batches):
        names, plan = shared.value
        index = {s: i for i, s in enumerate(names)}
        for batch in batches:
            number = batch.column(2).to_numpy()
            own = batch.column(1).dictionary_encode()
            codes = own.indices.fill_null(len(own.dictionary)).to_numpy(zero_copy_only=False)
            block = number // block_rows
            slot, position = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
            for code, name in enumerate([*own.dictionary.to_pylist(), None]):
                at = np.flatnonzero(codes == code)
                if not len(at):
                    continue
                i = index[name]
                served = np.array([p.served[i] for p in plan if len(p.slots[i])])
                mine = [p for p in plan if len(p.slots[i])]
                phase = np.searchsorted(served, block[at], "right") - 1
                for k in np.unique(phase).tolist():
                    p, rows_of = mine[k], at[phase == k]
                    j = block[rows_of] - p.served[i]
                    s = j // len(p.slots[i]) * p.length + p.slots[i][j % len(p.slots[i])]
                    slot[rows_of] = p.first_slot + s
                    position[rows_of] = p.first_row + s * block_rows + number[rows_of] % block_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block), pa.array(slot), pa.array(position)], names=["doc_id", "source", "block", "slot", "position"])

    return arrow_map(_ordered(rows, buckets), place, "doc_id long, source string, block long, slot long, position long")


def _ordered(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows numbered within their source in an order that no property of the row decides."""
    return numbered(rows.withColumn("__order", F.xxhash64("doc_id")), ["source"], ["__order", "doc_id"], "number", buckets=buckets).select("doc_id", "source", "number")


def in_mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, sorted by their place in the mixture.

    Rows that repeat an id stay, one after another at the first place of the id, also if their sources differ; so do rows with a null id.
    Null sources are a source of their own. An empty table stays empty.
    """
    own, place = free_name(docs, "id"), free_name(docs, "position")
    places = mixed(docs, weights, id_col=id_col, source_col=source_col, **options).groupBy(F.col("doc_id").alias(own)).agg(F.min("position").alias(place))
    return docs.join(places, F.col(id_col).eqNullSafe(F.col(own))).orderBy(place).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the place of every document in the mixture of sources."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
