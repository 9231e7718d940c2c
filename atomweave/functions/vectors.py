"""Vector algebra on triples of columns; everything stays inside generated code."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]

NEARLY_ZERO = 1e-4
SMALL = 1e-8


def vec(source: str | Column, names=("x", "y", "z")) -> Vector:
    """Components of a struct column."""
    base = F.col(source) if isinstance(source, str) else source
    return tuple(base.getField(n) for n in names)


def vec0(source: str | Column, names=("x", "y", "z")) -> Vector:
    """Components of a struct column with zero for null.

    For formulas whose result is only used under a condition that the vectors are there: without
    null checks the generated code stays small enough to be compiled by the JVM.
    """
    return tuple(F.coalesce(c, F.lit(0.0)) for c in vec(source, names))


def flat(source: str | Column, prefix: str) -> list[Column]:
    """Zero-filled components as columns ``<prefix>x, <prefix>y, <prefix>z``."""
    return [c.alias(f"{prefix}{n}") for c, n in zip(vec0(source), "xyz")]


def columns(prefix: str = "", suffix: str = "") -> Vector:
    """Components held in flat columns such as ``x_r, y_r, z_r``."""
    return tuple(F.col(f"{prefix}{a}{suffix}") for a in "xyz")


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b))


def scale(a: Vector, k) -> Vector:
    return tuple(p * k for p in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vector, b: Vector) -> Column:
    return length(sub(a, b))


def nearly_zero(a: Vector) -> Column:
    """True when every component is within 1e-4 of zero."""
    return (F.abs(a[0]) <= NEARLY_ZERO) & (F.abs(a[1]) <= NEARLY_ZERO) & (F.abs(a[2]) <= NEARLY_ZERO)


def unit(a: Vector) -> Vector:
    """Unit vector, or the zero vector when the length is negligible."""
    square = dot(a, a)
    return tuple(F.when(square < SMALL, F.lit(0.0)).otherwise(p / F.sqrt(square)) for p in a)


def lerp(a: Vector, b: Vector, t) -> Vector:
    return tuple(p + (q - p) * t for p, q in zip(a, b))


def pack(a: Vector) -> Column:
    """Back to a struct column."""
    return F.struct(*[c.alias(n) for c, n in zip(a, "xyz")])


def angle_between(p: Vector, q: Vector) -> Column:
    """Angle between two vectors; null when one has no length."""
    cosine = dot(p, q) / F.sqrt(dot(p, p) * dot(q, q))
    flat = (dot(p, p) < SMALL) | (dot(q, q) < SMALL)
    return F.when(~flat, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def torsion(middle: Vector, n1: Vector, n2: Vector) -> Column:
    """Signed torsion in the chemists' convention (right-handed helix: negative phi); 0 when collinear.

    With n1, n2 the plane normals and u the unit middle bond, the torsion is
    atan2(u . (n1 x n2), n1 . n2), above -180 and up to 180: Spark's atan2 reads a sine of -0.0 as 0.0, so
    a flat zigzag is 180 whatever the sign of its zero.
    """
    sine = dot(middle, cross(n1, n2)) / length(middle)
    return F.when(nearly_zero(n1) | nearly_zero(n2), F.lit(0.0)).otherwise(F.degrees(F.atan2(sine, dot(n1, n2))))


def dihedral_degrees(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Torsion of four points."""
    middle = sub(c, b)
    return torsion(middle, cross(sub(b, a), middle), cross(middle, sub(d, c)))


register_pickle_by_value(sys.modules[__name__])  # functions sent to executors that lack this package use it
