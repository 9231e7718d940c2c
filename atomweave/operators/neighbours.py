"""Distance joins: bonds, atoms within a distance, nearest partner, nearest attribute."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.tables import MAX_COVALENT_RADIUS
from ..session import stage
from . import grid, pyramid, tiles

KEY = ("structure_id",)

# Rule values for bonds (Å).
BOND_TOLERANCE = 0.45
MIN_BOND_LENGTH = 0.4

# Nearly all atoms have a covalent radius up to this; the few larger ones get their own wider grid.
COMMON_RADIUS = 1.25

# Edge of a tile of bonds (Å), and cells along an edge of a tile of molecules.  The borders lie half an edge from the origin.
TILE = 96.0
CELLS = 10


def without_lone_ions(atoms: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Drop hetero atoms that are the only atom of their residue; a column ``is_alone`` says so without a grouping."""
    if "is_alone" in atoms.columns:
        return atoms.where(~(F.col("is_alone") & F.col("is_hetatm")))
    lone = (atoms.groupBy(*keys, "residue_idx")
            .agg(F.count(F.lit(1)).alias("_n"), F.bool_or("is_hetatm").alias("_het"))
            .where((F.col("_n") == 1) & F.col("_het")).select(*keys, "residue_idx"))
    return atoms.join(lone, [*keys, "residue_idx"], "left_anti")


def bonds(atoms: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Bonds by distance: 0.4 Å <= d <= r1 + r2 + 0.45 Å, each pair once with atom_a < atom_b.

    Points are shuffled once, to wide tiles (:mod:`tiles`); a tile takes the pairs with one end of its own along each axis, the other
    ends come from the tiles above.  Common atoms meet in small cells, the rare large ones meet every atom in wide cells.  The copies
    of a place meet as one place.
    """
    reach = (2 * MAX_COVALENT_RADIUS + BOND_TOLERANCE) * 1.001
    own = {a: F.floor((F.col(a) + TILE / 2) / TILE).cast("long") for a in "xyz"}
    lowest = {a: F.floor((F.col(a) + TILE / 2 - reach) / TILE).cast("long") for a in "xyz"}
    points = atoms.select(*keys, "atom_idx", "x", "y", "z", F.col("covalent_radius").alias("r"))
    points = points.where(tiles.finite() & F.col("r").isNotNull() & F.col("atom_idx").isNotNull())
    kind = points.schema["atom_idx"].dataType.simpleString()
    schema = ", ".join([*[f"{k} {points.schema[k].dataType.simpleString()}" for k in keys], f"atom_a {kind}", f"atom_b {kind}"])
    found = tiles.mapped(tiles.spread(points, lowest, own, own), keys, _bonds_of_tiles(tuple(keys)), schema)
    return found.withColumn("bond_order", F.lit(1))


def _bonds_of_tiles(keys: tuple[str, ...]):
    """Function from whole tiles to their bonds."""
    def work(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, z, r, idx, copy = (tiles.numbers(table, c) for c in ("x", "y", "z", "r", "atom_idx", "_copy"))
        order, starts, counts = tiles.sites(group, (x, y, z, r), idx)
        first = order[starts]
        places, radii, copied, tile = [c[first] for c in (x, y, z)], r[first], copy[first], group[first]
        origins = [(tiles.numbers(table, t)[first] - 0.5) * TILE for t in tiles.TILES]

        def cells(edge: float) -> np.ndarray:
            return tiles.cell_keys(tile, [1 + np.floor((p - o) / edge) for p, o in zip(places, origins, strict=True)])

        def bonded(i: np.ndarray, j: np.ndarray, extra: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
            d2 = tiles.squared(places, i, j)
            reach = radii[i] + radii[j] + BOND_TOLERANCE
            keep = (d2 >= MIN_BOND_LENGTH ** 2) & (d2 <= reach * reach) & (copied[i] & copied[j] == 0) & extra
            return i[keep], j[keep]

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            common, large = np.flatnonzero(radii <= COMMON_RADIUS), np.flatnonzero(radii > COMMON_RADIUS)
            key = cells(2 * COMMON_RADIUS + BOND_TOLERANCE)[common]
            common = common[np.argsort(key, kind="stable")]
            key = np.sort(key)
            for i, j, *_ in tiles.meetings(key, key, half=True):
                yield bonded(common[i], common[j])
            if len(large):
                key = cells(2 * MAX_COVALENT_RADIUS + BOND_TOLERANCE)
                sort = np.argsort(key, kind="stable")
                for i, j, *_ in tiles.meetings(key[large], key[sort]):
                    i, j = large[i], sort[j]
                    yield bonded(i, j, (radii[j] <= COMMON_RADIUS) | (i < j))

        for i, j in pairs():
            for a, b in tiles.expanded(i, j, starts, counts):
                a, b = order[a], order[b]
                own = [table.column(k).combine_chunks().take(pa.array(a)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.minimum(idx[a], idx[b])), pa.array(np.maximum(idx[a], idx[b]))],
                                                 names=[*keys, "atom_a", "atom_b"])
    return work


def within(atoms: DataFrame, seeds: DataFrame, distance: float, keys: Sequence[str] = KEY) -> DataFrame:
    """Atoms at most ``distance`` away from any seed (seeds included).

    A semi join: it stops at the first seed found.  Seeds at one place count once.
    """
    if distance <= 0:
        raise ValueError("distance has to be positive")
    places = seeds.select(*keys, "x", "y", "z").dropDuplicates()
    return grid.candidates(atoms, places, keys, max(float(distance), 1.0), how="left_semi",
                           condition=grid.distance2() <= F.lit(float(distance) ** 2))


def with_within(atoms: DataFrame, seeds: DataFrame, distance: float, name: str = "within", keys: Sequence[str] = KEY,
                idx: str = "atom_idx") -> DataFrame:
    """Atoms with a flag for :func:`within`, to be combined with other conditions by and, or and not."""
    near = within(atoms.select(*keys, idx, "x", "y", "z"), seeds, distance, keys).select(*keys, idx).distinct()
    flagged = atoms.join(near.withColumn("_near", F.lit(True)), [*keys, idx], "left")
    return flagged.withColumn(name, F.coalesce("_near", F.lit(False))).drop("_near")


def shortest_distance(left: DataFrame, right: DataFrame, usual: float = 6.0,
                      keys: Sequence[str] = KEY) -> DataFrame:
    """Shortest distance between two selections of each structure.

    Most selections that are compared lie close together and are settled on a grid with cells of
    ``usual`` Å.  The structures that have no pair there are settled by bounds on boxes of occupied cells
    (:mod:`pyramid`), which joins points of few pairs of cells only, however many points and however far apart.
    """
    a, b = (stage(side.select(*keys, "x", "y", "z").dropDuplicates(), "selection") for side in (left, right))
    near = stage(grid.candidates(a, b, keys, float(usual), condition=grid.distance2() <= F.lit(float(usual) ** 2))
                 .groupBy(*keys).agg(F.min("d2").alias("d2")), "near-distances")
    far_a, far_b = (side.join(near, list(keys), "left_anti") for side in (a, b))
    far = pyramid.closest(far_a, far_b, keys)
    return near.unionByName(far).select(*keys, F.sqrt("d2").alias("distance"))


def _partners(molecules: DataFrame, cell_size: float, keys: Sequence[str], idx: str, carried: Sequence[str] = ()) -> DataFrame:
    """``keys`` and, of every molecule, ``id`` and the ``carried`` columns, ``d2``, and ``partner_id`` and ``partner_`` carried columns of
    the nearest other one, null without one near.

    Molecules are shuffled once, to tiles of many cells (:mod:`tiles`), and answered in the tile they lie in; what is wanted of a
    partner travels with it, so nothing is looked up afterwards.
    """
    cells = {a: F.floor(F.col(a) / cell_size).cast("long") for a in "xyz"}
    slim = molecules.select(*keys, "x", "y", "z", F.col(idx).alias("id"), *carried)
    tile = [{a: F.floor((cells[a] + CELLS // 2 + step) / CELLS).cast("long") for a in "xyz"} for step in (-1, 0, 1)]
    own = ["id", *carried]
    fields = [*[(k, slim.schema[k].dataType) for k in keys], *[(c, slim.schema[c].dataType) for c in own],
              ("d2", DoubleType()), *[(f"partner_{c}", slim.schema[c].dataType) for c in own]]
    schema = ", ".join(f"{name} {kind.simpleString()}" for name, kind in fields)
    found = tiles.mapped(tiles.spread(slim.where(tiles.finite()), *tile), keys, _partners_of_tiles(tuple(keys), tuple(own), cell_size), schema)
    nowhere = slim.where(~tiles.finite()).select(*keys, *own, *[F.lit(None).cast(kind).alias(name) for name, kind in fields[len(keys) + len(own):]])
    return found.unionByName(nowhere)


def _partners_of_tiles(keys: tuple[str, ...], own: tuple[str, ...], cell_size: float):
    """Function from whole tiles to their molecules with the nearest partner."""
    nobody = np.iinfo(np.int64).max

    def work(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, z, ids, copy = (tiles.numbers(table, c) for c in ("x", "y", "z", "id", "_copy"))
        order, starts, counts = tiles.sites(group, (x, y, z), ids)
        first = order[starts]
        places, smallest = [c[first] for c in (x, y, z)], ids[first].astype(np.int64)
        cells = [np.floor(p / cell_size) - tiles.numbers(table, t)[first] * CELLS + CELLS // 2 + 2 for p, t in zip(places, tiles.TILES, strict=True)]
        key = tiles.cell_keys(group[first], cells)
        sort = np.argsort(key, kind="stable")
        alone = np.flatnonzero((counts == 1) & (copy[first] == 0))
        best, best_id, best_at = np.full(len(alone), np.inf), np.full(len(alone), nobody), np.full(len(alone), -1)
        for i, j, some, begins in tiles.meetings(key[alone], key[sort]):
            i, j = alone[i], sort[j]
            d2 = np.where(smallest[i] == smallest[j], np.inf, tiles.squared(places, i, j))
            least = np.minimum.reduceat(d2, begins)
            length = np.diff(np.append(begins, len(i)))
            nearest = np.where(d2 == np.repeat(least, length), smallest[j], nobody)
            least_id = np.minimum.reduceat(nearest, begins)
            at = np.maximum.reduceat(np.where(nearest == np.repeat(least_id, length), j, -1), begins)
            better = np.isfinite(least) & ((least < best[some]) | ((least == best[some]) & (least_id < best_id[some])))
            taken = some[better]
            best[taken], best_id[taken], best_at[taken] = least[better], least_id[better], at[better]
        # a place with several: its smallest id has the second smallest, the others have the smallest
        place = np.repeat(np.arange(len(starts)), counts)
        crowded = np.flatnonzero((counts[place] > 1) & (copy[order] == 0))
        head = starts[place[crowded]]
        other = order[np.where(crowded == head, head + 1, head)]
        rows = np.concatenate((order[crowded], first[alone]))
        partner = np.concatenate((other, first[best_at]))
        none = np.concatenate((np.zeros(len(crowded), bool), best_at < 0))
        d2 = np.concatenate((np.zeros(len(crowded)), best))
        at, to = pa.array(rows), pa.array(partner, mask=none)
        yield from pa.Table.from_arrays(
            [*[table.column(c).take(at) for c in (*keys, *own)], pa.array(d2, mask=none), *[table.column(c).take(to) for c in own]],
            names=[*keys, *own, "d2", *[f"partner_{c}" for c in own]]).combine_chunks().to_batches(max_chunksize=tiles.ROWS)
    return work


def nearest_partner(molecules: DataFrame, cell_size: float, keys: Sequence[str] = ("structure_id", "tick"),
                    idx: str = "mol_id") -> DataFrame:
    """Nearest other molecule of each molecule among its neighbour cells, ties to the smallest id.

    Molecules at exactly one place are each other's nearest partners at distance zero and are
    answered by the smallest two ids of the place; only places are paired with places.
    """
    found = _partners(molecules, cell_size, keys, idx).where(F.col("partner_id").isNotNull())
    return found.select(*keys, F.col("id").alias(idx), "partner_id", "d2")


def contacts(molecules: DataFrame, cell_size: float, keys: Sequence[str] = ("structure_id", "tick"),
             idx: str = "mol_id") -> DataFrame:
    """Nearest partner with the sum of contact radii and whether the two touch."""
    radius_sum = F.col("radius") + F.col("partner_radius")
    return (_partners(molecules, cell_size, keys, idx, ("radius", "roll"))
            .select(*keys, F.col("id").alias(idx), "partner_id", "d2", radius_sum.alias("radius_sum"),
                    "roll", F.coalesce(F.col("d2") <= radius_sum * radius_sum, F.lit(False)).alias("in_contact")))


def nearest_attribute(points: DataFrame, atoms: DataFrame, attribute: str, cell_size: float,
                      keys: Sequence[str] = KEY, point_id: str = "point_id") -> DataFrame:
    """Give each point the attribute of its nearest atom: fewest cells away, then least distance, then
    smallest atom index.

    Neighbour cells are searched first.  Points without any atom there are searched again with cells of
    twice the size, and so on; a find counts once its ring of original cells was covered in full.  Only
    points of keys without any atom, or without finite coordinates, keep a null attribute.

    Points are copied to the tiles beside their own, places of atoms go to one; these are made once, for keys that have points.
    """
    identity = [*keys, point_id]
    slim = stage(points.select(*identity, "x", "y", "z").where(tiles.finite()), "slim-points")
    places = (atoms.select(*keys, "x", "y", "z", "atom_idx", attribute).join(slim.select(*keys).distinct(), list(keys), "left_semi")
              .groupBy(*keys, "x", "y", "z").agg(F.min(F.struct("atom_idx", attribute)).alias("_a")))
    sources = stage(places.select(*keys, "x", "y", "z", F.col("_a.atom_idx").alias("atom_idx"),
                                  F.col(f"_a.{attribute}").alias(attribute)), "attribute-places")
    steps = [F.abs(F.floor(F.col(a) / cell_size) - F.floor(F.col(f"{a}_r") / cell_size)) for a in "xyz"]

    def best(wanted: DataFrame, times: int) -> DataFrame:
        """Best atom among cells ``times`` as large; all rings below ``times`` are covered."""
        ring = F.greatest(F.lit(1), *steps)
        return (grid.candidates(sources, wanted, keys, cell_size * times).where(ring <= max(1, times - 1))
                .groupBy(*keys, F.col(f"{point_id}_r").alias(point_id))
                .agg(F.min(F.struct(ring.alias("ring"), "d2", "atom_idx", attribute)).alias("_best"))
                .select(*identity, F.col("_best.d2").alias("d2"), F.col("_best.atom_idx").alias("atom_idx"),
                        F.col(f"_best.{attribute}").alias(attribute)))

    found, times = best(slim, 1), 4
    answerable = slim.join(sources.select(*keys).distinct(), list(keys), "left_semi")
    missing = stage(answerable.join(found.select(*identity), identity, "left_anti"), "far-points")
    while not missing.isEmpty():
        more = stage(best(missing, times), "far-finds")
        found, times = found.unionByName(more), 2 * times
        missing = stage(missing.join(more.select(*identity), identity, "left_anti"), "far-points")
    return points.select(*identity).join(found, identity, "left")


register_pickle_by_value(sys.modules[__name__])
