"""Neighbours within wide tiles: one shuffle of points, then numpy over the whole groups of a task.

A point goes to the tile it lies in and is copied to a tile beside it only where that lies within reach.  Tiles are far wider than the
reach, so there are few copies, and no pair of points is shuffled.  A task gets its tiles sorted and looks at as many
whole ones at a time as fit into some 100,000 rows; within them points are sorted by small cells and meet in chunks of a bounded number of pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
TILES = [f"_t{a}" for a in AXES]
#: Rows of whole groups that are looked at together, and pairs that are held at a time.
ROWS, PAIRS = 1 << 17, 1 << 20
#: Bits of a cell's number along an axis, counted from its tile.
BITS = 6


def finite() -> Column:
    """Points with three finite coordinates."""
    there = F.lit(True)
    for a in AXES:
        there = there & F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False))
    return there


def spread(points: DataFrame, lowest: dict[str, Column], own: dict[str, Column], highest: dict[str, Column]) -> DataFrame:
    """Rows of ``points`` in every tile from ``lowest`` to ``highest`` (``_tx``, ``_ty``, ``_tz``); ``_copy`` has a bit for each axis
    along which the tile is not the point's ``own``."""
    out, copy = points.withColumns({f"_o{a}": own[a] for a in AXES}), F.lit(0)
    for i, a in enumerate(AXES):
        out = out.withColumn(f"_t{a}", F.explode(F.sequence(lowest[a], highest[a])))
        copy = copy + F.when(F.col(f"_t{a}") != F.col(f"_o{a}"), 1 << i).otherwise(0)
    return out.withColumn("_copy", copy.cast("int")).drop(*[f"_o{a}" for a in AXES])


def together(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a tile in one task, one tile after the other."""
    return points.repartition(*keys, *TILES).sortWithinPartitions(*keys, *TILES)


def group_numbers(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Number of each row's group of equal ``names`` in sorted rows; a null is a group of its own."""
    change = np.zeros(table.num_rows, bool)
    for name in names:
        column = table.column(name).combine_chunks()
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, max(0, len(column) - 1))), True)
        change[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.cumsum(change)


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups (of equal ``names``), with the number of each row's group."""
    held, size, enough = [], 0, rows
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group = group_numbers(table, names)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield table.slice(0, last).combine_chunks(), group[:last]
        rest = table.slice(last)
        held, size = rest.to_batches(), rest.num_rows
        enough = max(rows, 2 * size)
    if size:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_numbers(table, names)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def cell_keys(group: np.ndarray, cells: Sequence[np.ndarray]) -> np.ndarray:
    """One number a row, by group and cell; ``cells`` count from 1, so that a step down stays within the group."""
    key = group.astype(np.int64)
    for cell in cells:
        key = (key << BITS) + cell.astype(np.int64)
    return key


def meetings(asked: np.ndarray, keys: np.ndarray, half: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of ``asked`` and of the sorted ``keys`` whose cells differ by one step an axis at most, in chunks, with the
    rows ``i`` of a chunk that meet any and where each begins.  ``half``: of ``asked``, which is ``keys``, each pair once."""
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if not half or (dx, dy) >= (0, 0)]
    for dx, dy in steps:
        middle = asked + (dx << 2 * BITS) + (dy << BITS)
        low = np.searchsorted(keys, middle - 1, "left")
        high = np.searchsorted(keys, middle + 1, "right")
        if half and (dx, dy) == (0, 0):
            low = np.arange(1, len(keys) + 1)
        counts = np.maximum(high - low, 0)
        rows = np.flatnonzero(counts)
        ends = np.cumsum(counts[rows])
        begin = 0
        while begin < len(rows):
            done = int(ends[begin - 1]) if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            some = rows[begin:stop]
            n = counts[some]
            starts = np.cumsum(n) - n
            j = np.arange(int(n.sum())) + np.repeat(low[some] - starts, n)
            yield np.repeat(some, n), j, some, starts
            begin = stop


def squared(points: Sequence[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    total = None
    for x in points:
        delta = x[i] - x[j]
        total = delta * delta if total is None else total + delta * delta
    return total


def sites(group: np.ndarray, columns: Sequence[np.ndarray], idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their places and ``idx``, where the rows of each place begin, and how many it has."""
    order = np.lexsort((idx, *reversed(columns), group))
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.diff(group[order]) != 0
    for c in columns:
        fresh[1:] |= np.diff(c[order]) != 0
    starts = np.flatnonzero(fresh)
    return order, starts, np.diff(np.append(starts, len(order)))


def expanded(i: np.ndarray, j: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All rows of the places ``i`` with all rows of the places ``j``, in chunks."""
    ends = np.cumsum(counts[i] * counts[j])
    total = int(ends[-1]) if len(ends) else 0
    for begin in range(0, total, PAIRS):
        at = np.arange(begin, min(begin + PAIRS, total))
        pair = np.searchsorted(ends, at, "right")
        a, b = i[pair], j[pair]
        inner = at - (ends[pair] - counts[a] * counts[b])
        yield starts[a] + inner // counts[b], starts[b] + inner % counts[b]


def mapped(points: DataFrame, keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``work`` over the whole tiles of every task."""
    names = [*keys, *TILES]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, names):
            yield from work(table, group)

    return together(points, keys).mapInArrow(read, schema)


register_pickle_by_value(sys.modules[__name__])
