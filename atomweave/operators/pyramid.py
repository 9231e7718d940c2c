"""Closest pairs by bounds on boxes of occupied cells, from coarse cells to fine ones.

Points of both sides are summed up as the boxes of the cells they occupy.  A pair of cells can hold the closest pair only if the
distance of its boxes is at most the best distance known so far, that of some pair of points.  The cells of the pairs that are left are
split, four ways along each axis, and looked at again; points are joined only for the pairs of small cells that are left at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import grid

#: Cells along an axis into which a cell is split, and levels at most (4 ** 24 cells along an axis are finer than doubles).
SPLIT, LEVELS = 4, 24
#: Pairs of cells with at most so many pairs of points are not split any more.
SMALL = 256


def _boxes(points: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    """Occupied cells of a level: parent and cell, number of points, box, and one of the points."""
    edge = F.col("_edge") / float(SPLIT ** level)
    cells = {f"c{a}": F.floor((F.col(a) - F.col(f"_o{a}")) / edge).cast("long") for a in "xyz"}
    named = points.withColumns(cells).withColumns({f"p{a}": F.floor(F.col(f"c{a}") / SPLIT).cast("long") for a in "xyz"})
    return named.groupBy(*keys, *[f"{n}{a}" for n in "pc" for a in "xyz"]).agg(
        F.count(F.lit(1)).alias("n"), *[f(a).alias(f"{n}{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))],
        F.min(F.struct("x", "y", "z")).alias("one"))


def _box_distance2(a: str, b: str) -> Column:
    """Least squared distance of two boxes."""
    total = F.lit(0.0)
    for x in "xyz":
        gap = F.greatest(F.lit(0.0), F.col(f"{a}.l{x}") - F.col(f"{b}.h{x}"), F.col(f"{b}.l{x}") - F.col(f"{a}.h{x}"))
        total = total + gap * gap
    return total


def _point_distance2(a: str, b: str) -> Column:
    return sum(((F.col(f"{a}.one.{x}") - F.col(f"{b}.one.{x}")) * (F.col(f"{a}.one.{x}") - F.col(f"{b}.one.{x}")) for x in "xyz"), F.lit(0.0))


def closest(left: DataFrame, right: DataFrame, keys: Sequence[str], counts: list[int] | None = None) -> DataFrame:
    """``keys`` and ``d2``, the squared distance of the closest pair of points of each key that both sides (keys, x, y, z) have.

    Non-finite coordinates have no part.  With ``counts``, the numbers of pairs of cells, and at last of points, that were looked at are appended.
    """
    keys = list(keys)
    finite = F.lit(True)
    for a in "xyz":
        finite = finite & (F.abs(F.col(a)) < float("inf"))
    sides = [stage(side.select(*keys, "x", "y", "z").where(finite), "closest-side") for side in (left, right)]
    frames = [side.groupBy(*keys).agg(*[f(a).alias(f"_{n}{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))]) for side in sides]
    both = frames[0].join(frames[1].withColumnsRenamed({f"_{n}{a}": f"_{n}{a}2" for a in "xyz" for n in "lh"}), keys)
    origin = {f"_o{a}": F.least(f"_l{a}", f"_l{a}2") for a in "xyz"}
    extent = F.greatest(*[F.greatest(f"_h{a}", f"_h{a}2") - F.least(f"_l{a}", f"_l{a}2") for a in "xyz"], F.lit(1e-300))
    frame = stage(both.select(*keys, *[c.alias(n) for n, c in origin.items()], (extent * (1 + 1e-9)).alias("_edge")), "closest-frames")
    a, b = (stage(side.join(frame, keys), "closest-points") for side in sides)

    cell, parent = [f"c{x}" for x in "xyz"], [f"p{x}" for x in "xyz"]
    boxes = ["n", "one", *[f"{n}{x}" for n in "lh" for x in "xyz"]]
    # level 0 is one cell; pairs of cells are (cell of a, cell of b)
    pairs = frame.select(*keys, *[F.lit(0).cast("long").alias(f"{s}{x}") for s in "ab" for x in "xyz"])
    known = None
    finished: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        split = pairs
        for side, points in (("a", a), ("b", b)):
            wanted = pairs.select(*keys, *[F.col(f"{side}{x}").alias(f"p{x}") for x in "xyz"]).distinct()
            made = _boxes(points, keys, level).join(wanted, [*keys, *parent], "left_semi").select(
                *keys, *[F.col(f"p{x}").alias(f"{side}{x}") for x in "xyz"], F.struct(*cell, *boxes).alias(side))
            split = split.join(made, [*keys, *[f"{side}{x}" for x in "xyz"]])
        bounded = stage(split.select(*keys, "a", "b", _box_distance2("a", "b").alias("least"), _point_distance2("a", "b").alias("some")), "cell-pairs")
        if counts is not None:
            counts.append(bounded.count())
        best = bounded.groupBy(*keys).agg(F.min("some").alias("some"))
        if known is not None:
            best = best.unionByName(known).groupBy(*keys).agg(F.min("some").alias("some"))
        known = stage(best, "best-distances")
        left_over = bounded.drop("some").join(known, keys).where(F.col("least") <= F.col("some"))
        small = (F.col("a.n") * F.col("b.n") <= SMALL) if level < LEVELS else F.lit(True)
        left_over = stage(left_over.withColumn("_small", small), "open-pairs")
        done = left_over.where("_small")
        finished.append(_joined(done, a, b, keys, level))
        pairs = left_over.where("NOT _small").select(*keys, *[F.col(f"{s}.c{x}").alias(f"{s}{x}") for s in "ab" for x in "xyz"])
        if pairs.isEmpty():
            break
    found = finished[0]
    for more in finished[1:]:
        found = found.unionByName(more)
    if counts is not None:
        found = stage(found, "point-pairs")
        counts.append(found.count())
    return found.groupBy(*keys).agg(F.min("d2").alias("d2"))


def _joined(pairs: DataFrame, a: DataFrame, b: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Squared distances of the points of pairs of cells."""
    edge = F.col("_edge") / float(SPLIT ** level)
    out = pairs.select(*keys, *[F.col(f"{s}.c{x}").alias(f"{s}{x}") for s in "ab" for x in "xyz"])
    for side, points, suffix in (("a", a, ""), ("b", b, "_r")):
        placed = points.select(*keys, *[F.floor((F.col(x) - F.col(f"_o{x}")) / edge).cast("long").alias(f"{side}{x}") for x in "xyz"],
                               *[F.col(x).alias(f"{x}{suffix}") for x in "xyz"])
        out = out.join(placed, [*keys, *[f"{side}{x}" for x in "xyz"]])
    return out.select(*keys, grid.distance2().alias("d2"))
