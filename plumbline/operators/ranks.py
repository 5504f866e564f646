"""Ranks of many columns at once, and within every pair of columns that miss different cells.

Cut points at equal shares of the rows divide each column into ordered slots: one for each
cut point, one between two of them.  One scan counts the cells of all slots of all columns.
A cell on a cut point, which any frequent value is, has its rank from these counts alone;
so columns of few values need no more.  The other cells are shuffled once, to a bucket of
neighbouring slots, which is ordered as a whole; then the ranks of a block of rows meet in
a second shuffle, and partial sums of products follow.  The work grows with the cells,
never with a shuffle for each column or pair.

Both shuffles move the cells that one block of rows has in one bucket as one row.  They
keep the block's order throughout, so neither row numbers nor known ranks travel: a block
takes its slots along, and finds by them where each rank belongs.

Missing cells: within a pair, a cell's rank leaves out the rows that the other column
misses.  It is the rank among all cells of its column, less the rank among those rows;
so every count is kept once for all rows and once for each column with missing cells.

Memory: a task holds a block (``BLOCK`` ranks) or a bucket: ``BUCKET_CELLS`` cells and one
slot, some 80 bytes a cell.  A slot holds the column's rows over its number of cut points, or
a few times that where the sketch errs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import SKETCH_K, sketched_quantiles
from plumbline.shared import cut, spread

# Functions that run in tasks go to the executors by value: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cut points per column, fewer where columns and missing columns are many: their counts pass through the driver.
MOST_EDGES = 4095
FEWEST_EDGES = 63
COUNTED = 400_000
# Ranks of a block of rows, and its rows at most.
BLOCK = 1 << 23
BLOCK_ROWS = 1 << 17
# Cells of some rows that are written as one value.
PACKED = 1 << 17
# Cells that are ordered together, but for those of the last slot.
BUCKET_CELLS = 1 << 18
# Ranks of a bucket that are sent at once.
SENT = 1 << 24

# Rows of the table, their filled cells by column, and the columns' values one after the other.
_PACKED = "rows long, filled array<long>, cells binary"
# Of a block and bucket: the values and bits of the missing columns; the bucket -1 - block has the block's slots.
_CELLS = "block long, bucket long, cells binary, missing binary"
# The same cells' doubled ranks in the bucket, from the number ``part`` of their column on.
_RANKS = "block long, bucket long, part int, cells binary"


@dataclass(frozen=True)
class _Places:
    """What tells a cell's rank from its slot, and where the ranks of cells between cut points come from."""

    edges: list[np.ndarray]
    gappy: list[int]
    # per column the counts that its pairs need: 0 for all cells, else 1 + place of the partner in ``gappy``
    parts: list[list[int]]
    # per column and slot its bucket, numbered from 0; the number of the column's first bucket
    bucket: list[np.ndarray]
    first: np.ndarray
    # per column, by part and slot: twice the centred rank, less that in the bucket for a slot between cut points; at the end 0, for missing cells
    base: list[np.ndarray]
    rows: int


def rank_sums(df: DataFrame, values: Mapping[str, Column], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Partial sums (pair, n, sx, sy, qx, qy, p) of centred average ranks, over the complete rows of each pair.

    ``pair`` is the number of the pair in ``pairs``; a pair without complete rows has none.
    """
    names = list(values)
    cells = spread(df.select(*[values[n].cast("double").alias(f"x{i}") for i, n in enumerate(names)]))
    edges, slots = _cut_points(cells, len(names))
    # written once, packed: two passes read it, and the rows of a block must not change when a task is run again
    source = cut(cells.mapInArrow(_packed(max(1, PACKED // len(names))), _PACKED))
    held = source.select("rows", F.posexplode("filled")).groupBy("pos").agg((F.sum("col") < F.sum("rows")).alias("gappy"))
    gappy = sorted(r["pos"] for r in held.where("gappy").collect())  # a row per column
    counts = _slot_counts(source, edges, gappy, slots)
    at = {n: i for i, n in enumerate(names)}
    index = [(at[a], at[b]) for a, b in pairs]
    places = _places(edges, gappy, counts, index)
    cells = source.mapInArrow(_cells(places), _CELLS)
    sums = _products(places, index)
    schema = "pair long, " + ", ".join(f"{f} double" for f in ("n", "sx", "sy", "qx", "qy", "p"))
    if not any(len(b) and b.max() >= 0 for b in places.bucket):

        def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for cell in batch.column("cells"):
                    yield sums(cell.as_buffer(), [])

        return cells.mapInArrow(known, schema)  # every cell sits on a cut point

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, ranks = None, []
        for batch in batches:
            for bucket, part, cell in zip(batch.column("bucket").to_pylist(), batch.column("part").to_pylist(), batch.column("cells")):
                if bucket < 0:
                    slot = cell.as_buffer()
                else:
                    ranks.append((bucket, part, cell.as_buffer()))
        yield sums(slot, ranks)

    return cells.groupBy("bucket").applyInArrow(_rank_bucket(places), _RANKS).groupBy("block").applyInArrow(met, schema)


def _cut_points(cells: DataFrame, columns: int) -> tuple[list[np.ndarray], int]:
    """Sorted cut points of each column, the slots of a column."""
    names = [f"x{i}" for i in range(columns)]
    wanted = {}
    for n in names:
        most = max(FEWEST_EDGES, min(MOST_EDGES, COUNTED // (2 * columns * columns)))
        wanted[n] = [(i + 1) / (most + 1) for i in range(most)]
    found = sketched_quantiles(cells, {n: F.col(n) for n in names}, wanted, SKETCH_K)
    edges = [np.array(sorted(set(found[n][3])), float) for n in names]
    return edges, 2 * max((len(e) for e in edges), default=0) + 2


def _packed(rows: int):
    """Rows to ``_PACKED``, so many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks((np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns]) for b in batches), rows):
            filled = np.count_nonzero(~np.isnan(x), axis=1)
            yield pa.RecordBatch.from_pydict({"rows": [x.shape[1]], "filled": [filled.tolist()], "cells": [x.tobytes()]})

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for rows, cells in zip(batch.column("rows").to_pylist(), batch.column("cells")):
            yield np.frombuffer(cells.as_buffer(), float).reshape(-1, rows)


def _blocks(parts: Iterator[np.ndarray], rows: int) -> Iterator[np.ndarray]:
    """Cells by column and row, NaN where one is missing, so many rows at a time."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.shape[1]
        if size >= rows:
            x = np.concatenate(held, axis=1)
            whole = size - size % rows
            for start in range(0, whole, rows):
                yield x[:, start : start + rows]
            held, size = [x[:, whole:]], size - whole
    if size:
        yield np.concatenate(held, axis=1)


def _slots(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Slots of a column's cells: even on a cut point, odd between two, -1 for a missing cell."""
    at = np.searchsorted(edges, v, "right")
    on = (at > 0) & (np.append(edges, np.nan)[at - 1] == v)
    return np.where(np.isnan(v), -1, 2 * at + ~on)


def _slot_counts(source: DataFrame, edges: list[np.ndarray], gappy: list[int], slots: int) -> list[np.ndarray]:
    """Per column its cells by slot: all of them, and those in rows where each gappy column is filled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the slot before the first holds the missing cells
        n = np.zeros((len(edges), 1 + len(gappy), 1 + slots), np.int64)
        for x in _blocks(_unpacked(batches), BLOCK_ROWS):
            lacking = [np.flatnonzero(np.isnan(x[g])) for g in gappy]
            for i, e in enumerate(edges):
                slot = _slots(e, x[i]) + 1
                n[i, 0] += np.bincount(slot, minlength=1 + slots)
                for j, rows in enumerate(lacking, 1):
                    n[i, j] += np.bincount(slot[rows], minlength=1 + slots)
        n[:, 1:] = n[:, :1] - n[:, 1:]
        n = n[:, :, 1:]
        held = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"col": held[0], "part": held[1], "slot": held[2], "n": n[held]})

    parts = source.mapInArrow(count, "col long, part long, slot long, n long")
    out = np.zeros((len(edges), 1 + len(gappy), slots), np.int64)
    # bounded by COUNTED, whatever the rows
    total = parts.groupBy("col", "part", "slot").agg(F.sum("n").alias("n")).toArrow()
    out[tuple(total[c].to_numpy() for c in ("col", "part", "slot"))] = total["n"].to_numpy()
    return [c.T for c in out]


def _places(edges: list[np.ndarray], gappy: list[int], counts: list[np.ndarray], index: list[tuple[int, int]]) -> _Places:
    parts: list[set[int]] = [set() for _ in edges]
    for a, b in index:
        for i, other in ((a, b), (b, a)):
            parts[i].add(1 + gappy.index(other) if other in gappy else 0)
    bucket, base, first, buckets = [], [], [], 0
    for c, needed in zip(counts, parts):
        between = c * (np.arange(len(c)) % 2)[:, None] * bool(needed)
        lower = np.cumsum(between, axis=0) - between
        own = np.full(len(c), -1)
        starts = lower[:, 0].copy()
        held = between[:, 0] > 0
        if held.any():
            ids, at, own[held] = np.unique(starts[held] // BUCKET_CELLS, return_index=True, return_inverse=True)
            opening = np.flatnonzero(held)[at]  # the first slot of each bucket
            lower[held] -= lower[opening[own[held]]]
            first.append(buckets)
            buckets += len(ids)
        else:
            first.append(buckets)
        below = np.cumsum(c, axis=0) - c
        twice = np.where(held[:, None], 2 * (below - lower), 2 * below + c + 1) - (c.sum(axis=0) + 1)
        bucket.append(own)
        base.append(np.pad(twice[:, sorted(needed)].T, ((0, 0), (0, 1))).astype(float))
    rows = max(1, min(BLOCK_ROWS, BLOCK // (len(edges) * (1 + len(gappy)))))
    return _Places(edges, gappy, [sorted(p) for p in parts], bucket, np.array(first), base, rows)


def _between(slot: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that have a cell between cut points, by bucket and then as they stand, and these buckets."""
    rows = np.flatnonzero((slot > 0) & (slot % 2 == 1))
    own = bucket[slot[rows]].astype(np.uint16)
    order = np.argsort(own, kind="stable")
    return rows[order], own[order]


def _binary(a: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The rows of ``a``, up to each end, as one value each."""
    step = a.dtype.itemsize * (a.shape[1] if a.ndim > 1 else 1)
    offsets = (np.append(0, ends) * step).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(a.tobytes())])


def _cells(places: _Places):
    """Rows to ``_CELLS``: of each block its slots, and the cells between cut points by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names = ["block", "bucket", "cells", "missing"]
        for x in _blocks(_unpacked(batches), places.rows):
            slot = np.stack([_slots(e, v) for e, v in zip(places.edges, x)]).astype(np.int16)
            missing = np.packbits(np.isnan(x[places.gappy]), axis=0).T
            whole = pa.array([slot.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1 - block]), whole, pa.array([None], pa.binary())], names)
            for i, parts in enumerate(places.parts):
                rows, own = _between(slot[i], places.bucket[i]) if parts else ((), ())
                if len(rows):
                    found, starts = np.unique(own, return_index=True)
                    ends = np.append(starts[1:], len(rows))
                    key = pa.array(np.full(len(found), block))
                    yield pa.RecordBatch.from_arrays([key, pa.array(places.first[i] + found.astype(np.int64)), _binary(x[i][rows], ends), _binary(missing[rows], ends)], names)
            block += 1

    return run


def _rank_bucket(places: _Places):
    """``_CELLS`` of one bucket to ``_RANKS``: twice the average rank, among all its cells and those with each partner filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        bucket = table["bucket"][0].as_py()
        names = ["block", "bucket", "part", "cells"]
        block = table["block"].combine_chunks()
        if bucket < 0:
            yield pa.RecordBatch.from_arrays([block, table["bucket"].combine_chunks(), pa.array([0], pa.int32()), table["cells"].combine_chunks()], names)
            return
        parts = places.parts[int(np.searchsorted(places.first, bucket, "right")) - 1]
        values = table["cells"].to_pylist()
        ends = np.cumsum([len(b) // 8 for b in values])
        v = np.frombuffer(b"".join(values), float)
        missing = np.frombuffer(b"".join(table["missing"].to_pylist()), np.uint8).reshape(len(v), -1)
        del table, values
        order = np.argsort(v)
        ordered = v[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        bounds = np.append(np.flatnonzero(new), len(v))  # of equal values
        tie = np.empty(len(v), np.int32)
        tie[order] = np.cumsum(new) - 1
        most = max(1, SENT // len(v))
        for start in range(0, len(parts), most):
            some = parts[start : start + most]
            rank = np.empty((len(v), len(some)), np.int32)
            for k, part in enumerate(some):
                below = bounds
                if part:
                    lacks = missing[:, (part - 1) // 8] >> (7 - (part - 1) % 8) & 1
                    below = np.append(0, np.cumsum(lacks[order] ^ 1, dtype=np.int64))[bounds]
                rank[:, k] = (below[:-1] + below[1:] + 1)[tie]
            same = [pa.array(np.full(len(ends), bucket)), pa.array(np.full(len(ends), start, np.int32))]
            yield pa.RecordBatch.from_arrays([block, *same, _binary(rank, ends)], names)

    return run


def _products(places: _Places, index: list[tuple[int, int]]):
    """The slots of a block and its ranks (bucket, part, ranks) to sums by pair."""
    columns = len(places.edges)
    partner = [1 + places.gappy.index(i) if i in places.gappy else 0 for i in range(columns)]

    def run(slots, ranks: list) -> pa.RecordBatch:
        slot = np.frombuffer(slots, np.int16).reshape(columns, -1)
        filled = (slot >= 0).astype(float)
        at = slot.astype(np.intp)
        local: list = [None] * columns
        where: dict = {}
        for i, parts in enumerate(places.parts):
            rows, own = _between(slot[i], places.bucket[i]) if parts else ((), ())
            if len(rows):
                local[i] = np.zeros((len(parts), slot.shape[1]), np.int32)
                found, starts = np.unique(own, return_index=True)
                where |= {places.first[i] + b: (i, r) for b, r in zip(found.tolist(), np.split(rows, starts[1:]))}
        for bucket, part, cell in ranks:
            i, rows = where[bucket]
            r = np.frombuffer(cell, np.int32).reshape(len(rows), -1)
            for k in range(r.shape[1]):
                local[i][part + k, rows] = r[:, k]

        held: dict = {}

        def centred(i: int, part: int) -> np.ndarray:
            """Ranks of column ``i``, zero where it is missing."""
            if (i, part) not in held:
                k = places.parts[i].index(part)
                x = places.base[i][k][at[i]]
                if local[i] is not None:
                    x += local[i][k]
                x *= 0.5
                held[i, part] = x
            return held[i, part]

        out = np.zeros((6, len(index)))
        for pair, (a, b) in enumerate(index):
            x, y = centred(a, partner[b]), centred(b, partner[a])
            fx = x * filled[b] if partner[b] else x
            fy = y * filled[a] if partner[a] else y
            out[:, pair] = filled[a] @ filled[b], fx.sum(), fy.sum(), fx @ fx, fy @ fy, x @ y
        return pa.RecordBatch.from_pydict({"pair": np.arange(len(index)), **dict(zip(("n", "sx", "sy", "qx", "qy", "p"), out))})

    return run
