"""Distance joins as equi-joins on a uniform grid.

Catalyst plans a distance predicate as a nested-loop join.  Two points closer than a cutoff lie in
cells (edge >= cutoff) that differ by at most one step per axis, so a join on cell keys finds every
pair.  To keep the shuffle small, join keys are *tiles* of ``per_tile`` cells per axis: the left side
goes to its one tile, a right row is copied to every tile its neighbour cells touch (8 copies for
two cells per tile, instead of 27 with single cells).  The join stays an ordinary equi-join, so
adaptive execution can pick a broadcast for a side it has measured to be small and splits tiles that
turn out to be hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

AXES = ("x", "y", "z")
COPIES = 64


def cell(axis: str, edge: float | str) -> Column:
    """Cell number along one axis (floor, hence right for negative coordinates).

    ``edge`` is a number or the name of a column present on both sides.
    """
    size = F.col(edge) if isinstance(edge, str) else F.lit(float(edge))
    return F.floor(F.col(axis) / size).cast("long")


def tile_of(cell_number: Column, per_tile: int) -> Column:
    return F.floor(cell_number / F.lit(per_tile)).cast("long")


def candidates(left: DataFrame, right: DataFrame, keys: Sequence[str], edge: float | str, rings: int = 1,
               per_tile: int = 2, condition: Column | None = None, how: str = "inner") -> DataFrame:
    """All left/right pairs of one key whose cells differ by at most ``rings`` steps per axis.

    Non-key columns of the right side get the suffix ``_r``; ``d2`` is the squared distance.
    ``condition`` (on suffixed columns and ``d2``) is evaluated inside the join; with
    ``how='left_semi'`` the join stops at the first match.
    """
    tiles = [f"_t{a}" for a in AXES]
    cells = {f"_c{a}": cell(a, edge) for a in AXES}
    lhs = left.withColumns(cells | {f"_t{a}": tile_of(cells[f"_c{a}"], per_tile) for a in AXES})
    rhs = right.withColumns(cells)
    for axis in AXES:
        own = F.col(f"_c{axis}")
        rhs = rhs.withColumn(f"_t{axis}", F.explode(
            F.sequence(tile_of(own - rings, per_tile), tile_of(own + rings, per_tile))))
    fixed = {*keys, *tiles}
    rhs = rhs.select(*[F.col(c) if c in fixed else F.col(c).alias(f"{c}_r") for c in rhs.columns])

    near = F.lit(True)
    for axis in AXES:
        near = near & (F.abs(F.col(f"_c{axis}") - F.col(f"_c{axis}_r")) <= rings)
    if condition is not None:
        near = near & condition
    on = None
    for key in [*keys, *tiles]:
        equal = F.col(f"_l.{key}") == F.col(f"_r.{key}")
        on = equal if on is None else on & equal
    joined = lhs.alias("_l").join(rhs.alias("_r"), on & near, how)
    if how == "left_semi":
        return joined.select(*[F.col(f"_l.{c}") for c in left.columns])
    return joined.select(
        *[F.col(f"_l.{c}") for c in left.columns],
        *[F.col(f"{c}_r") for c in right.columns if c not in keys],
        distance2().alias("d2"))


def distance2(suffix: str = "_r") -> Column:
    """Squared distance of the left point to the right point (no square root in the hot path)."""
    total = None
    for axis in AXES:
        delta = F.col(axis) - F.col(f"{axis}{suffix}")
        total = delta * delta if total is None else total + delta * delta
    return total


def collapse_copies(points: DataFrame, keys: Sequence[str], same: Sequence[str], idx: str,
                    more_than: int = COPIES) -> tuple[DataFrame, DataFrame]:
    """Represent large groups of identical points by their smallest index.

    Returns ``(representatives, members)``.  ``members`` lists ``(keys, idx, member)`` for sites with
    more than ``more_than`` identical rows only, so it is normally empty and adaptive execution
    drops the joins with it; with many copies it keeps a join from pairing the copies of one place
    with each other.  The marked points are staged once, as a self join reads them on both sides.
    """
    site = [*keys, *same]
    heavy = (points.groupBy(*site)
             .agg(F.count(F.lit(1)).alias("_n"), F.min(idx).alias("_rep"))
             .where(F.col("_n") > more_than).drop("_n"))
    marked = stage(points.join(heavy, site, "left"), "points")
    representatives = marked.where(F.col("_rep").isNull() | (F.col("_rep") == F.col(idx))).drop("_rep")
    members = (marked.where(F.col("_rep").isNotNull())
               .select(*keys, F.col("_rep").alias(idx), F.col(idx).alias("member")))
    return representatives, members


def expand_copies(pairs: DataFrame, members: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    """Replace a representative in column ``idx`` by all members of its site."""
    lookup = members.select(*keys, F.col(members.columns[len(keys)]).alias(idx), F.col("member"))
    return (pairs.join(lookup, [*keys, idx], "left")
            .withColumn(idx, F.coalesce(F.col("member"), F.col(idx))).drop("member"))
