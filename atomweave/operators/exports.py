"""Point and bond tables for export, thinning, and selections as index sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from . import scans

KEY = ("structure_id",)


def thin_atoms(atoms: DataFrame, max_atoms: int, keys: Sequence[str] = KEY) -> DataFrame:
    """Evenly spread subset of at most ``max_atoms`` rows per structure (0 = all), a fixed rule.

    Slot i takes candidate floor(i N / M).  Candidate r is taken exactly when i = ceil(r M / N)
    satisfies that, so each row decides for itself from its rank and the count.
    """
    ranked = scans.row_index(atoms, keys, "atom_idx", ["atom_idx"], "_r", total="num_before_limit")
    if max_atoms <= 0:
        return ranked.drop("_r")
    n, r, m = F.col("num_before_limit"), F.col("_r"), F.lit(int(max_atoms)).cast("long")
    slot = F.expr(f"(_r * {int(max_atoms)}L + num_before_limit - 1) div num_before_limit")
    taken = F.expr(f"(_slot * num_before_limit) div {int(max_atoms)}L")
    kept = ranked.withColumn("_slot", slot).where((n <= m) | ((F.col("_slot") < m) & (taken == r)))
    return kept.drop("_r", "_slot")


def point_table(atoms: DataFrame, units: float = 10.0, radius_scale: float | Column = 1.0,
                colour: Column | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Scaled positions, radii and a colour class per atom."""
    scale = radius_scale if isinstance(radius_scale, Column) else F.lit(float(radius_scale))
    return atoms.select(
        *keys, "atom_idx", *[(F.col(a) * F.lit(float(units))).alias(f"p{a}") for a in "xyz"],
        (F.col("vdw_radius") * scale * F.lit(float(units))).alias("radius"),
        (F.lit("#FFFFFF") if colour is None else colour).alias("colour"))


def write_points(points: DataFrame, path: str, buckets: int = 64) -> None:
    """Points as Parquet under a bounded number of folders, structures hashed to folders."""
    (points.withColumn("bucket", F.pmod(F.hash("structure_id"), F.lit(buckets)))
     .write.mode("errorifexists").partitionBy("bucket").parquet(path))


def bonds_of(bonds: DataFrame, selected: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Bonds with both ends in the selection."""
    chosen = selected.select(*keys, "atom_idx")
    for end in ("atom_a", "atom_b"):
        bonds = bonds.join(chosen.withColumnRenamed("atom_idx", end), [*keys, end], "left_semi")
    return bonds


def bond_table(bonds: DataFrame, atoms: DataFrame, units: float = 10.0, split: bool = True,
               keys: Sequence[str] = KEY) -> DataFrame:
    """Bond segments: two halves in the colour of their own atom, or one; without zero-length ones.

    ``atoms`` needs ``colour``.
    """
    ends = bonds
    for end in ("a", "b"):
        place = atoms.select(*keys, F.col("atom_idx").alias(f"atom_{end}"),
                             F.struct(*[(F.col(c) * F.lit(float(units))).alias(c) for c in "xyz"]).alias(f"_{end}"),
                             F.col("colour").alias(f"_colour_{end}"))
        ends = ends.join(place, [*keys, f"atom_{end}"])
    a, b = v.vec("_a"), v.vec("_b")
    middle = v.scale(v.add(a, b), 0.5)

    def segment(half: int, start: v.Vector, stop: v.Vector, colour: str) -> Column:
        return F.struct(F.lit(half).alias("half"), v.pack(start).alias("s"), v.pack(stop).alias("e"),
                        F.col(colour).alias("colour"))

    parts = ([segment(1, a, middle, "_colour_a"), segment(2, middle, b, "_colour_b")] if split
             else [segment(0, a, b, "_colour_a")])
    out = ends.select(*keys, "atom_a", "atom_b", F.explode(F.array(*parts)).alias("_g"))
    return (out.where(v.distance(v.vec("_g.s"), v.vec("_g.e")) > 1e-8)
            .select(*keys, "atom_a", "atom_b", "_g.half", "_g.colour",
                    *[F.col(f"_g.s.{c}").alias(f"start_{c}") for c in "xyz"],
                    *[F.col(f"_g.e.{c}").alias(f"end_{c}") for c in "xyz"]))


def union_of(*selections: DataFrame) -> DataFrame:
    """Atoms in any of the selections (index sets)."""
    return reduce(lambda a, b: a.unionByName(b), selections).distinct()


def intersection_of(*selections: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), selections)


def complement_of(universe: DataFrame, selection: DataFrame) -> DataFrame:
    return universe.subtract(selection)


def canonical_pairs(pairs: DataFrame, a: str, b: str, keys: Sequence[str] = KEY, min_gap: int = 0) -> DataFrame:
    """Unordered pairs once, as ``(low, high)``, at least ``min_gap`` apart."""
    low, high = F.least(a, b), F.greatest(a, b)
    return pairs.where(high - low >= min_gap).select(*keys, low.alias("low"), high.alias("high")).distinct()
