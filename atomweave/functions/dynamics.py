"""Row-level rules for moving molecules: box boundaries, distance bands, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGENERATE = 1e-8


def wrap(value: Column, low: Column, high: Column) -> Column:
    """Periodic image inside ``[low, high]``; inside values and a box without extent stay as they are."""
    extent = high - low
    moved = low + F.pmod(F.pmod(value - low, extent) + extent, extent)
    outside = (value < low) | (value > high)
    return F.when((extent > DEGENERATE) & outside, moved).otherwise(value)


def reflect(value: Column, velocity: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Position and velocity after mirroring at the walls as often as needed.

    Every bounce shortens the overshoot by one box length and alternates the wall, so the number of
    bounces and the final side follow from the overshoot in closed form.
    """
    extent = F.when(high - low > DEGENERATE, high - low)
    above = value > high
    overshoot = F.when(above, value - high).when(value < low, low - value).otherwise(F.lit(0.0))
    bounces = F.ceil(overshoot / extent)
    odd = bounces % 2 == 1
    # an odd count ends in front of the wall hit first, an even count in front of the opposite one
    left = overshoot - extent * F.when(odd, bounces - 1).otherwise(bounces)
    mirrored = (F.when(above & odd, high - left)
                .when(above, high + left)
                .when(odd, low + left)
                .otherwise(low - left))
    position = F.greatest(low, F.least(high, mirrored))
    last_wall_is_high = above == odd
    speed = F.when(last_wall_is_high, -F.abs(velocity)).otherwise(F.abs(velocity))
    moves = extent.isNotNull() & (overshoot > 0)
    return F.when(moves, position).otherwise(value), F.when(moves, speed).otherwise(velocity)


def detail_band(d2: Column, full: float, backbone: float, blob: float) -> Column:
    """Distance band; thresholds that are out of order are raised to the previous one."""
    first = max(float(full), 0.0)
    second = max(float(backbone), first)
    third = max(float(blob), second)
    return (F.when(d2 <= first * first, F.lit("Full"))
            .when(d2 <= second * second, F.lit("Backbone"))
            .when(d2 <= third * third, F.lit("Blob"))
            .otherwise(F.lit("Hidden")))


def step_probability(rate: Column | float, dt: Column | float) -> Column:
    """Probability of at least one event of a Poisson rate within one step."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    t = dt if isinstance(dt, Column) else F.lit(float(dt))
    return 1.0 - F.exp(-r * t)


def binds(d2: Column, contact_sum: Column, rate: Column | float, dt: Column | float, roll: Column) -> Column:
    """Decision to bind: in contact, with a positive rate and step, and the roll below the probability."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    t = dt if isinstance(dt, Column) else F.lit(float(dt))
    possible = (contact_sum > 0) & (r > 0) & (t > 0) & (d2 <= contact_sum * contact_sum)
    return F.coalesce(possible & (roll < step_probability(r, t)), F.lit(False))


def unbinds(rate: Column | float, dt: Column | float, roll: Column) -> Column:
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    t = dt if isinstance(dt, Column) else F.lit(float(dt))
    return (r > 0) & (t > 0) & (roll < step_probability(r, t))
