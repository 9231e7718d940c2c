"""Gaussian density on voxels, inside volume and iso crossings."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import tiles

KEY = ("structure_id",)
INFLUENCE = 2.5
LEAST_VOXEL = 0.05
COARSEN = 1.5
ATOMS_PER_TASK = 16384
#: Directions of lattice edges: axes, face diagonals and the body diagonal.
FORWARD = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (1, 1, 1)]
#: Blocks of voxels that are held at a time.
HELD_BLOCKS = 64


def contributing(atoms: DataFrame, inflation: float = 0.0, show_water: bool = False,
                 show_hydrogen: bool = False) -> DataFrame:
    """Atoms that add to the field, with their radius ``r``."""
    keep = F.lit(True)
    if not show_water:
        keep = keep & ~F.col("is_water")
    if not show_hydrogen:
        keep = keep & (F.col("element") != 1)
    return (atoms.where(keep).withColumn("r", F.col("vdw_radius") + F.lit(float(inflation)))
            .where(F.col("r") > 0))


def voxel_grid(atoms: DataFrame, voxel: float = 0.6, max_voxels: int | None = None,
               keys: Sequence[str] = KEY) -> DataFrame:
    """Grid of each structure: origin, voxel size, dimensions and reach of the field.

    The voxel has the requested size.  Only if ``max_voxels`` is given, a grid with more points gets a
    voxel that is larger by half, as often as needed; ``coarsened`` counts how often.
    """
    stats = atoms.groupBy(*keys).agg(
        *[F.min(a).alias(f"_min_{a}") for a in "xyz"], *[F.max(a).alias(f"_max_{a}") for a in "xyz"],
        F.max("r").alias("_r"))
    reach = F.col("_r") * INFLUENCE
    start = max(float(voxel), LEAST_VOXEL)

    def dim(axis: str, size: Column) -> Column:
        extent = F.col(f"_max_{axis}") - F.col(f"_min_{axis}") + 2 * F.col("reach")
        return F.greatest(F.lit(2), F.ceil(extent / size) + 1)

    def points(size: Column) -> Column:
        return dim("x", size).cast("double") * dim("y", size) * dim("z", size)

    sized = stats.withColumn("reach", reach)
    if max_voxels is None:
        sized = sized.withColumns({"voxel": F.lit(start), "coarsened": F.lit(0)})
    else:
        if max_voxels < 8:
            raise ValueError("a grid has 8 points at least")
        extent = F.greatest(*[F.col(f"_max_{a}") - F.col(f"_min_{a}") + 2 * F.col("reach") for a in "xyz"])
        enough = F.greatest(F.lit(0), F.ceil(F.log(extent / start) / F.log(F.lit(COARSEN)))).cast("int")  # two points an axis
        times = F.filter(F.sequence(F.lit(0), enough), lambda k: points(
            F.lit(start) * F.pow(F.lit(COARSEN), k.cast("double"))) <= F.lit(float(max_voxels)))
        sized = (sized.withColumn("coarsened", F.get(times, F.lit(0)))
                 .withColumn("voxel", F.lit(start) * F.pow(F.lit(COARSEN), F.col("coarsened").cast("double"))))
    return sized.select(
        *keys, "reach", "voxel", "coarsened", *[(F.col(f"_min_{a}") - F.col("reach")).alias(f"origin_{a}") for a in "xyz"],
        *[dim(a, F.col("voxel")).cast("int").alias(f"n{a}") for a in "xyz"])


def density_field(atoms: DataFrame, grid: DataFrame, sharpness: float = -2.3, keys: Sequence[str] = KEY,
                  per_block: int = 24) -> DataFrame:
    """Sum of ``exp(B (d^2/r^2 - 1))`` over atoms within reach, at every voxel that gets any.

    The lattice is cut into blocks of ``per_block`` voxels an axis; an atom goes to every block it reaches and
    is scattered to the voxels of that block only. A block is summed where its atoms are, so no voxel is shuffled,
    and as many tasks are used as there are ``ATOMS_PER_TASK`` atoms, so a task's table of sums does not grow with
    the input. Equal atoms at one place are counted first and scattered once; their places are staged for the count.
    """
    if sharpness >= 0:
        raise ValueError("sharpness has to be negative")
    places = stage(atoms.groupBy(*keys, "x", "y", "z", "r").agg(F.count(F.lit(1)).alias("_n")), "atom-places")
    spread = places.join(grid, list(keys))

    def index(axis: str, sign: int) -> Column:
        return (F.col(axis) + sign * F.col("reach") - F.col(f"origin_{axis}")) / F.col("voxel")

    blocks = [f"_b{a}" for a in "xyz"]
    for a in "xyz":
        spread = spread.withColumns({
            f"_low_{a}": F.greatest(F.lit(0), F.ceil(index(a, -1))).cast("int"),
            f"_high_{a}": F.least(F.col(f"n{a}") - 1, F.floor(index(a, 1))).cast("int")}).where(F.col(f"_low_{a}") <= F.col(f"_high_{a}"))
    for a in "xyz":
        spread = spread.withColumn(f"_b{a}", F.explode(F.sequence(
            F.floor(F.col(f"_low_{a}") / per_block).cast("int"), F.floor(F.col(f"_high_{a}") / per_block).cast("int"))))
    tasks = max(1, -(-places.count() // ATOMS_PER_TASK))
    spread = spread.repartition(tasks, *keys, *blocks)
    for a in "xyz":
        low = F.greatest(F.col(f"_low_{a}"), F.col(f"_b{a}") * per_block)
        high = F.least(F.col(f"_high_{a}"), (F.col(f"_b{a}") + 1) * per_block - 1)
        spread = (spread.withColumn(f"i{a}", F.explode(F.sequence(low, high)))
                  .withColumn(f"_d{a}", F.col(f"origin_{a}") + F.col(f"i{a}") * F.col("voxel") - F.col(a)))
    d2 = F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy") + F.col("_dz") * F.col("_dz")
    value = F.col("_n") * F.exp(F.lit(float(sharpness)) * (F.col("_d2") / (F.col("r") * F.col("r")) - 1.0))
    return (spread.withColumn("_d2", d2).where(F.col("_d2") <= F.col("reach") * F.col("reach"))
            .groupBy(*keys, *blocks, "ix", "iy", "iz").agg(F.sum(value).alias("density")).drop(*blocks))


def inside_volume(field: DataFrame, grid: DataFrame, iso: float = 0.5, keys: Sequence[str] = KEY) -> DataFrame:
    """Voxels at or above the threshold and the volume they stand for."""
    counted = field.groupBy(*keys).agg(F.count_if(F.col("density") >= iso).alias("inside_voxels"))
    return counted.join(grid.select(*keys, "voxel"), list(keys)).select(
        *keys, "inside_voxels", (F.col("inside_voxels") * F.pow("voxel", F.lit(3.0))).alias("volume"))


def iso_crossings(field: DataFrame, grid: DataFrame, iso: float = 0.5, keys: Sequence[str] = KEY) -> DataFrame:
    """Points where the field crosses the threshold on lattice edges in seven directions.

    The directions are those of the six-tetrahedra split of a cube: axes, face diagonals and the body
    diagonal.  Every crossing edge has exactly one inside end, so only inside voxels look at their
    fourteen neighbours; a voxel without a row has density zero.  The field, read as both, is staged; a look
    goes by one packed voxel number, and looks beyond the lattice are left out before they become rows.
    """
    field = stage(field.join(grid, list(keys)).select(
        *keys, "density", *[f"{p}{a}" for a in "xyz" for p in "in"], *[f"origin_{a}" for a in "xyz"], "voxel"), "field")
    steps = F.array(*[F.struct(F.lit(s * dx).alias("dx"), F.lit(s * dy).alias("dy"), F.lit(s * dz).alias("dz"),
                               F.lit(s > 0).alias("up"))
                      for s in (1, -1) for dx, dy, dz in FORWARD])
    def within(step: Column) -> Column:
        there = F.lit(True)
        for a in "xyz":
            there = there & (F.col(f"i{a}") + step[f"d{a}"]).between(F.lit(0), F.col(f"n{a}") - 1)
        return there

    def number(x: Column, y: Column, z: Column) -> Column:
        return (x.cast("long") * F.col("ny") + y) * F.col("nz") + z

    inside = field.where(F.col("density") >= iso)
    looks = inside.withColumn("_s", F.explode(F.filter(steps, within)))
    looks = looks.withColumns({f"j{a}": F.col(f"i{a}") + F.col(f"_s.d{a}") for a in "xyz"})
    looks = looks.withColumn("_at", number(F.col("jx"), F.col("jy"), F.col("jz")))
    other = field.select(*keys, number(F.col("ix"), F.col("iy"), F.col("iz")).alias("_at"), F.col("density").alias("_other"))
    edges = (looks.join(other, [*keys, "_at"], "left")
             .withColumn("_other", F.coalesce("_other", F.lit(0.0))).where(F.col("_other") < iso))
    up = F.col("_s.up")
    low = F.when(up, F.col("density")).otherwise(F.col("_other"))
    high = F.when(up, F.col("_other")).otherwise(F.col("density"))
    span = high - low
    share = F.when(F.abs(span) > 1e-8, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (iso - low) / span))).otherwise(0.5)
    out = edges.withColumn("t", share)
    start = {a: F.when(up, F.col(f"i{a}")).otherwise(F.col(f"j{a}")) for a in "xyz"}
    step = {a: F.abs(F.col(f"_s.d{a}")) for a in "xyz"}
    return out.select(
        *keys, *[start[a].alias(f"a{a}") for a in "xyz"], *[step[a].alias(f"d{a}") for a in "xyz"], "t",
        *[(F.col(f"origin_{a}") + F.col("voxel") * (start[a] + F.col("t") * step[a])).alias(a) for a in "xyz"])


def crossings(atoms: DataFrame, grid: DataFrame, sharpness: float = -2.3, iso: float = 0.5, keys: Sequence[str] = KEY,
              per_block: int = 24) -> DataFrame:
    """The points of :func:`iso_crossings` of the field of ``atoms``, of which no voxel becomes a row.

    A block of ``per_block`` voxels an axis has the edges that begin in it, and sums the voxels one step beyond its upper sides
    as well, so an atom goes to every block it reaches or reaches the border of.  Sums are made row by row, so a task holds
    the voxels of a few blocks, however many atoms they have.
    """
    if sharpness >= 0:
        raise ValueError("sharpness has to be negative")
    lattice = [*[f"origin_{a}" for a in "xyz"], *[f"n{a}" for a in "xyz"], "voxel", "reach"]
    spread = atoms.select(*keys, "x", "y", "z", "r").where(tiles.finite()).join(grid.select(*keys, *lattice), list(keys))
    low, high = {}, {}
    for a in "xyz":
        at = (F.col(a) - F.col(f"origin_{a}"))
        low[a] = F.greatest(F.lit(0), F.ceil((at - F.col("reach")) / F.col("voxel"))).cast("int")
        high[a] = F.least(F.col(f"n{a}") - 1, F.floor((at + F.col("reach")) / F.col("voxel"))).cast("int")
        spread = spread.where(low[a] <= high[a])
    first = {a: F.floor(F.greatest(F.lit(0), low[a] - 1) / per_block).cast("long") for a in "xyz"}
    last = {a: F.floor(high[a] / per_block).cast("long") for a in "xyz"}
    rows = tiles.together(tiles.spread(spread, first, first, last).drop("_copy"), keys)
    named = [*keys, *tiles.TILES]
    schema = ", ".join([*[f"{k} {atoms.schema[k].dataType.simpleString()}" for k in keys], *[f"{p}{a} int" for p in "ad" for a in "xyz"],
                        *[f"{c} double" for c in ("t", "x", "y", "z")]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_head, open_sums = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            group = tiles.group_numbers(table, named)
            starts = np.searchsorted(group, np.arange(group[-1] + 1 if len(group) else 0))
            for begin in range(0, len(starts), HELD_BLOCKS):
                heads = starts[begin:begin + HELD_BLOCKS]
                stop = starts[begin + HELD_BLOCKS] if begin + HELD_BLOCKS < len(starts) else len(group)
                part = table.slice(int(heads[0]), int(stop - heads[0])).combine_chunks()
                sums = block_sums(part, group[heads[0]:stop] - group[heads[0]], len(heads), sharpness, per_block)
                head = part.take(pa.array(heads - heads[0])).select([*named, *lattice])
                if open_head is not None:
                    if open_head.select(named).equals(head.slice(0, 1).select(named)):
                        sums[0] += open_sums[0]
                    else:
                        yield from block_crossings(open_head, open_sums, keys, iso, per_block)
                yield from block_crossings(head.slice(0, len(heads) - 1), sums[:-1], keys, iso, per_block)
                open_head, open_sums = head.slice(len(heads) - 1).combine_chunks(), sums[-1:].copy()
        if open_head is not None:
            yield from block_crossings(open_head, open_sums, keys, iso, per_block)

    return rows.mapInArrow(read, schema)


def block_sums(table: pa.Table, block: np.ndarray, blocks: int, sharpness: float, per_block: int) -> np.ndarray:
    """Density at the voxels of some blocks, and one step beyond their upper sides, from the atoms of ``table``."""
    side = per_block + 1
    sums = np.zeros(blocks * side ** 3)
    low, size, base = [], [], []
    reach, voxel, r = (tiles.numbers(table, c) for c in ("reach", "voxel", "r"))
    at, origins = [tiles.numbers(table, a) for a in "xyz"], [tiles.numbers(table, f"origin_{a}") for a in "xyz"]
    for a, x, origin in zip("xyz", at, origins, strict=True):
        begin = tiles.numbers(table, f"_t{a}") * per_block
        lowest = np.maximum(np.ceil((x - origin - reach) / voxel), begin).astype(np.int64)
        highest = np.minimum(np.minimum(np.floor((x - origin + reach) / voxel), tiles.numbers(table, f"n{a}") - 1), begin + per_block).astype(np.int64)
        low.append(lowest)
        size.append(np.maximum(highest - lowest + 1, 0))
        base.append(begin)
    counts = size[0] * size[1] * size[2]
    ends = np.cumsum(counts)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, tiles.PAIRS):
        place = np.arange(begin, min(begin + tiles.PAIRS, int(ends[-1])))
        row = np.searchsorted(ends, place, "right")
        inner = place - (ends[row] - counts[row])
        steps = (inner // (size[1] * size[2])[row], inner // size[2][row] % size[1][row], inner % size[2][row])
        index = [low[k][row] + steps[k] for k in range(3)]
        d2 = 0.0
        for k in range(3):
            delta = origins[k][row] + index[k] * voxel[row] - at[k][row]
            d2 = d2 + delta * delta
        near = np.flatnonzero(d2 <= (reach * reach)[row])
        row, d2 = row[near], d2[near]
        cell = block[row]
        for k in range(3):
            cell = cell * side + index[k][near] - base[k][row]
        sums += np.bincount(cell, np.exp(sharpness * (d2 / (r[row] * r[row]) - 1.0)), minlength=len(sums))
    return sums.reshape(blocks, side, side, side)


def block_crossings(heads: pa.Table, sums: np.ndarray, keys: Sequence[str], iso: float, per_block: int) -> Iterator[pa.RecordBatch]:
    """Crossings of the edges that begin in some blocks; ``heads`` has a row of each block."""
    if not len(sums):
        return
    begin = [tiles.numbers(heads, t) * per_block for t in tiles.TILES]
    ends = [tiles.numbers(heads, f"n{a}") for a in "xyz"]
    origins, voxel = [tiles.numbers(heads, f"origin_{a}") for a in "xyz"], tiles.numbers(heads, "voxel")
    inside, start = sums >= iso, sums[:, :-1, :-1, :-1]
    for step in FORWARD:
        window = tuple(slice(d, d + per_block) for d in step)
        found = np.nonzero(inside[:, :-1, :-1, :-1] != inside[(slice(None), *window)])
        own = found[0]
        corner = [begin[k][own] + found[k + 1] for k in range(3)]
        there = np.ones(len(own), bool)
        for k in range(3):
            there &= corner[k] + step[k] < ends[k][own]
        own, corner, found = own[there], [c[there] for c in corner], tuple(f[there] for f in found)
        if not len(own):
            continue
        low, high = start[found], sums[(slice(None), *window)][found]
        span = high - low
        wide = np.abs(span) > 1e-8
        t = np.where(wide, np.clip((iso - low) / np.where(wide, span, 1.0), 0.0, 1.0), 0.5)
        columns = [*[heads.column(k).combine_chunks().take(pa.array(own)) for k in keys], *[pa.array(c.astype(np.int32)) for c in corner],
                   *[pa.array(np.full(len(own), d, np.int32)) for d in step], pa.array(t),
                   *[pa.array(origins[k][own] + voxel[own] * (corner[k] + t * step[k])) for k in range(3)]]
        yield pa.RecordBatch.from_arrays(columns, names=[*keys, *[f"{p}{a}" for p in "ad" for a in "xyz"], "t", "x", "y", "z"])


register_pickle_by_value(sys.modules[__name__])
