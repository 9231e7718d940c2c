"""Frame series: sampling, lookups, per-frame aggregates.

``frames`` is a long table ``(traj_id, frame, atom_idx, x, y, z)`` with frames numbered from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

ON_A_FRAME = 1e-8


def thin(frames: DataFrame, stride: int = 1, max_frames: int = 0) -> DataFrame:
    """Every ``stride``-th frame, at most ``max_frames`` of them (0 = all)."""
    stride = max(1, int(stride))
    keep = F.col("frame") % stride == 0
    if max_frames > 0:
        keep = keep & (F.floor(F.col("frame") / stride) < max_frames)
    return frames.where(keep)


def complete_frames(frames: DataFrame, num_atoms: DataFrame) -> DataFrame:
    """``(traj_id, frame)`` of frames that hold every atom; ``num_atoms`` is ``(traj_id, num_atoms)``."""
    return (frames.groupBy("traj_id", "frame").agg(F.count(F.lit(1)).alias("_n"))
            .join(num_atoms, "traj_id").where(F.col("_n") == F.col("num_atoms")).select("traj_id", "frame"))


def only_complete(frames: DataFrame, num_atoms: DataFrame) -> DataFrame:
    return frames.join(complete_frames(frames, num_atoms), ["traj_id", "frame"], "left_semi")


def summary(frames: DataFrame, num_atoms: DataFrame, time_step: Column | float) -> DataFrame:
    """Frames, atoms and duration ``time_step * (frames - 1)`` per trajectory, incomplete frames excluded."""
    step = time_step if isinstance(time_step, Column) else F.lit(float(time_step))
    counts = complete_frames(frames, num_atoms).groupBy("traj_id").agg(F.count(F.lit(1)).alias("num_frames"))
    return counts.join(num_atoms, "traj_id").select(
        "traj_id", "num_frames", "num_atoms",
        (F.greatest(F.lit(0), F.col("num_frames") - 1) * step).alias("duration_ps"))


def _with_last_frame(requests: DataFrame, frames: DataFrame) -> DataFrame:
    last = frames.groupBy("traj_id").agg(F.max("frame").alias("_last"))
    return requests.join(last, "traj_id")


def sample(requests: DataFrame, frames: DataFrame, time: str = "t") -> DataFrame:
    """Positions at fractional frame times, blended between the two frames around them.

    ``requests`` is ``(traj_id, request_id, t)``; times outside the series are clamped.  A row of a frame goes
    to its own frame and to the one before, where both are put side by side; the requests join them there, and
    what they get is not shuffled again.
    """
    at = F.greatest(F.lit(0.0), F.least(F.col(time), F.col("_last").cast("double")))
    asked = _with_last_frame(requests, frames).withColumn("_at", at).withColumn("frame", F.floor("_at"))
    share = F.col("_at") - F.col("frame")
    exact = (share <= ON_A_FRAME) | (F.col("frame") >= F.col("_last"))
    asked = asked.select("traj_id", "request_id", "frame", F.when(~exact, share).alias("_w"))
    place = F.struct("x", "y", "z")
    sides = frames.select("traj_id", F.explode(F.array(
        F.struct(F.col("frame").cast("long").alias("frame"), F.lit(1).alias("role"), place.alias("a"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("b")),
        F.struct((F.col("frame") - 1).cast("long").alias("frame"), F.lit(2).alias("role"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("a"),
                 place.alias("b")))).alias("_s"), "atom_idx")
    sides = sides.select("traj_id", "_s.frame", "atom_idx", F.col("_s.role").alias("_role"), *[F.col(f"_s.{s}.{c}").alias(f"_{s}{c}") for s in "ab" for c in "xyz"])
    both = (sides.repartition("traj_id", "frame").groupBy("traj_id", "frame", "atom_idx")
            .agg(F.bit_or("_role").alias("_role"), *[F.max(f"_{s}{c}").alias(f"_{s}{c}") for s in "ab" for c in "xyz"]))
    first, second = F.coalesce(1.0 - F.col("_w"), F.lit(1.0)), F.col("_w")
    there = (F.col("_role") != 2) | (F.col("_w").isNotNull())

    def blend(c: str) -> Column:
        one, two = first * F.col(f"_a{c}"), second * F.col(f"_b{c}")
        return F.coalesce(one + two, one, two).alias(c)

    return asked.join(both, ["traj_id", "frame"]).where(there).select(
        "traj_id", "request_id", "atom_idx", *[blend(c) for c in "xyz"])


def sample_nearest(requests: DataFrame, frames: DataFrame, time: str = "t") -> DataFrame:
    """Positions of the frame closest to each requested time (halves round up)."""
    at = F.greatest(F.lit(0.0), F.least(F.col(time), F.col("_last").cast("double")))
    wanted = _with_last_frame(requests, frames).select(
        "traj_id", "request_id", F.floor(at + 0.5).cast("long").alias("frame"))
    return wanted.join(frames, ["traj_id", "frame"]).select("traj_id", "request_id", "frame", "atom_idx", "x", "y", "z")


def frame_time(clock: Column, fps: Column | float, num_frames: Column, loop: Column) -> Column:
    """Clock seconds to frame time: looping by remainder of the last frame, or held at the last frame."""
    last = (num_frames - 1).cast("double")
    run = clock * fps
    looped = F.when(run >= last, F.pmod(run, F.when(last > 0, last))).otherwise(run)
    return F.when(num_frames < 2, F.lit(0.0)).when(loop, looped).otherwise(F.least(run, last))


def normalised_time(time: Column, num_frames: Column) -> Column:
    """Frame time as a share of the series, 0 for fewer than two frames."""
    return F.when(num_frames < 2, F.lit(0.0)).otherwise(time / (num_frames - 1))


def time_of_share(share: Column, num_frames: Column) -> Column:
    """Share of the series back to frame time."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (num_frames - 1)


def lookup(frames: DataFrame, frame: int, atom: int | None = None) -> DataFrame:
    """One frame, or one atom of it; empty when out of range.  A plain filter, so partitions prune."""
    keep = F.col("frame") == frame
    if atom is not None:
        keep = keep & (F.col("atom_idx") == atom)
    return frames.where(keep)


def frame_bounds(frames: DataFrame) -> DataFrame:
    """Bounding box of every frame."""
    return frames.groupBy("traj_id", "frame").agg(*[
        f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def frame_series(frames: DataFrame, reference_frame: int = 0) -> DataFrame:
    """RMSD to a reference frame and radius of gyration (unit weights) of every frame.

    The reference frame is joined on ``(traj_id, atom_idx)``: it is as large as the structure, so it
    is not broadcast unless measured to be small.
    """
    reference = frames.where(F.col("frame") == reference_frame).select(
        "traj_id", "atom_idx", *[F.col(a).alias(f"{a}_r") for a in "xyz"])
    delta = v.sub(v.columns(), v.columns(suffix="_r"))
    spread = [F.var_pop(a) for a in "xyz"]  # merged centred moments: exact far from the origin as well
    return (frames.join(reference, ["traj_id", "atom_idx"]).groupBy("traj_id", "frame")
            .agg(F.sqrt(F.avg(v.dot(delta, delta))).alias("rmsd"), F.sqrt(sum(spread[1:], spread[0])).alias("gyration")))


def compatibility(structures: DataFrame, trajectories: DataFrame) -> DataFrame:
    """Whether atom counts fit, with the reason: ``(id, num_atoms)`` against ``(id, num_atoms)``."""
    left = structures.select("id", F.col("num_atoms").alias("structure_atoms"))
    right = trajectories.select("id", F.col("num_atoms").alias("trajectory_atoms"))
    s, t = F.coalesce("structure_atoms", F.lit(0)), F.coalesce("trajectory_atoms", F.lit(0))
    reason = (F.when(s == 0, "no structure").when(t == 0, "no trajectory")
              .when(s != t, F.format_string("trajectory has %d atoms, structure %d", t, s)).otherwise(""))
    return left.join(right, "id", "full_outer").select("id", (reason == "").alias("compatible"), reason.alias("reason"))
