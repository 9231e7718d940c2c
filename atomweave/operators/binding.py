"""Molecule snapshots over ticks: binding state, displacements, bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dynamics
from . import scans

KEYS = ("structure_id", "mol_id")


def decisions(contacts: DataFrame, bind_rate: float, unbind_rate: float, dt: float) -> DataFrame:
    """Contact rows with ``bind`` and ``unbind``: what would happen to a free or a bound molecule."""
    return (contacts
            .withColumn("bind", dynamics.binds(F.col("d2"), F.col("radius_sum"), bind_rate, dt, F.col("roll")))
            .withColumn("unbind", dynamics.unbinds(unbind_rate, dt, F.col("roll"))))


def two_state(events: DataFrame, set_on: Column, set_off: Column, swap: Column, name: str,
              keys: Sequence[str] = KEYS, ordinal: str = "tick", width: int = scans.BLOCK) -> DataFrame:
    """State of an on/off switch after each row of an ordered event series, starting off.

    In closed form the state is the value of the last set event, flipped once per swap since then.
    A whole block of events is again one event (set or swap), so the same form gives the state at the
    start of each block from the block summaries.
    """
    here = scans.upto(keys, [ordinal])
    rows = (scans.tag(events, ordinal, width)
            .withColumn("_set", F.when(set_on, 1).when(set_off, 0))
            .withColumn("_swaps", F.sum(F.when(swap, 1).otherwise(0)).over(here))
            .withColumn("_at_set", F.last(F.when(F.col("_set").isNotNull(), F.col("_swaps")), ignorenulls=True).over(here))
            .withColumn("_value", F.last("_set", ignorenulls=True).over(here)))
    ends = rows.groupBy(*keys, "_blk").agg(
        F.max_by(F.struct("_value", "_swaps", "_at_set"), ordinal).alias("_e"))
    flips = F.col("_e._swaps") - F.coalesce(F.col("_e._at_set"), F.lit(0))
    before = scans.earlier(keys)
    blocks = (ends.withColumn("_bset", (F.col("_e._value") + flips) % 2)
              .withColumn("_bswap", F.when(F.col("_bset").isNull(), flips).otherwise(0))
              .withColumn("_cum", F.sum("_bswap").over(
                  scans.across(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
              .select(*keys, "_blk", (
                  F.coalesce(F.last("_bset", ignorenulls=True).over(before), F.lit(0))
                  + F.coalesce(F.last("_cum").over(before), F.lit(0))
                  - F.coalesce(F.last(F.when(F.col("_bset").isNotNull(), F.col("_cum")), ignorenulls=True).over(before),
                               F.lit(0))).alias("_start")))
    value = F.coalesce(F.col("_value"), F.col("_start"))
    state = (value + F.col("_swaps") - F.coalesce(F.col("_at_set"), F.lit(0))) % 2 == 1
    return (scans.attach(rows, keys, blocks).withColumn(name, state)
            .drop("_blk", "_set", "_swaps", "_at_set", "_value", "_start"))


def binding_states(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bound or free after every tick: a free molecule binds on ``bind``, a bound one leaves on ``unbind``."""
    bind, unbind = F.col("bind"), F.col("unbind")
    return two_state(events, bind & ~unbind, unbind & ~bind, bind & unbind, "bound", keys)


def bound_counts(states: DataFrame, keys: Sequence[str] = ("structure_id", "tick")) -> DataFrame:
    return states.groupBy(*keys).agg(F.count_if("bound").alias("num_bound"))


def displacement_statistics(snapshots: DataFrame, dt: float, diffusion: float,
                            keys: Sequence[str] = KEYS) -> DataFrame:
    """Per structure and axis: mean step, mean square step, share within one sigma, estimated D.

    A step is the way from one tick to the next; sigma = sqrt(2 D dt) for the stated ``diffusion``.
    """
    window = Window.partitionBy(*keys, "_blk").orderBy("tick")
    framed = (scans.halo(snapshots, "tick", before=1, after=0)
              .withColumn("_p", F.lag(F.struct("tick", "x", "y", "z")).over(window)))
    steps = scans.drop_halo(framed).where(F.col("_p.tick") == F.col("tick") - 1)
    sigma = (2.0 * diffusion * dt) ** 0.5
    axes = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), (F.col(a) - F.col(f"_p.{a}")).alias("step"))
                               for a in "xyz"]))
    long = steps.select(keys[0], axes.alias("_a")).select(keys[0], "_a.axis", "_a.step")
    mean_square = F.avg(F.col("step") * F.col("step"))
    return long.groupBy(keys[0], "axis").agg(
        F.avg("step").alias("mean_step"), mean_square.alias("mean_square"),
        F.avg(F.when(F.abs("step") <= sigma, 1.0).otherwise(0.0)).alias("within_sigma"),
        (mean_square / (2.0 * dt)).alias("diffusion"))


def with_bands(snapshots: DataFrame, viewer: tuple[float, float, float], full: float, backbone: float,
               blob: float) -> DataFrame:
    """Distance to the viewer and the detail band it falls into."""
    d2 = None
    for a, at in zip("xyz", viewer):
        delta = F.col(a) - F.lit(float(at))
        d2 = delta * delta if d2 is None else d2 + delta * delta
    return snapshots.withColumn("d2", d2).withColumn("band", dynamics.detail_band(F.col("d2"), full, backbone, blob))


def band_population(banded: DataFrame, keys: Sequence[str] = ("structure_id", "tick")) -> DataFrame:
    return banded.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("num_molecules"))


def limit_full_detail(banded: DataFrame, k: int, keys: Sequence[str] = ("structure_id", "tick"),
                      idx: str = "mol_id") -> DataFrame:
    """Only the nearest ``k`` keep the top band, the overflow moves one band down.

    The nearest are found with a group limit, which cuts each partition to k rows per group before
    the shuffle, and joined back; the full group is never sorted in one place.
    """
    k = max(0, int(k))
    top = banded.where(F.col("band") == "Full").select(*keys, idx, "d2")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("d2", idx))
    nearest = top.withColumn("_rank", rank).where(F.col("_rank") <= k).select(*keys, idx, F.lit(True).alias("_near"))
    band = F.when((F.col("band") == "Full") & F.col("_near").isNull(), "Backbone").otherwise(F.col("band"))
    return banded.join(nearest, [*keys, idx], "left").withColumn("band", band).drop("_near")
