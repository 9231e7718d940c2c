"""Trajectory files, frame series and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.operators import binding, trajectory
from atomweave.session import fresh_path
from atomweave.sources import dcd
from atomweave.streaming import binding as stream


def frames_of(count, atoms, first=0):
    return np.array([[(a + 100 * f, 2 * a, 3 * a - 10 * f) for a in range(atoms)] for f in range(first, first + count)], dtype=float)


def cells_of(count):
    return np.array([(60 + f, 70 + f, 80 + f) for f in range(count)], dtype=float)


def write(path, atoms=4, frames=3, cell=False, order="<", cut=0, magic=None, fixed=0):
    data = dcd.encode_header(atoms, frames, 0.002, cell, order) + dcd.encode_frames(
        frames_of(frames, atoms), cells_of(frames) if cell else None, order)
    data = data[:len(data) - cut] if cut else data
    if magic:
        data = data[:4] + magic + data[8:]
    if fixed:
        data = data[:40] + fixed.to_bytes(4, "little" if order == "<" else "big") + data[44:]
    path.write_bytes(data)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("split", [40, 300, 1 << 20])
def test_frames(spark, tmp_path, order, split):
    write(tmp_path / "a.dcd", order=order, cell=True)
    write(tmp_path / "b.DCD", order=order, frames=2)
    dcd.register(spark)
    rows = spark.read.format("dcd").option("splitBytes", split).load(str(tmp_path)).orderBy("path", "frame", "atom_idx").collect()
    assert len(rows) == 20
    assert [(r.frame, r.atom_idx, r.x, r.y, r.z) for r in rows[:12]] == [
        (f, a, a + 100 * f, 2 * a, 3 * a - 10 * f) for f in range(3) for a in range(4)]


def test_stride_limit_and_cells(spark, tmp_path):
    write(tmp_path / "a.dcd", frames=6, cell=True)
    dcd.register(spark)
    reader = spark.read.format("dcd").option("stride", 2).option("maxFrames", 2).option("splitBytes", 100)
    assert sorted({r.frame for r in reader.load(str(tmp_path)).collect()}) == [0, 2]
    cells = reader.option("table", "cells").load(str(tmp_path)).orderBy("frame").collect()
    assert [(r.frame, r.a, r.b, r.c) for r in cells] == [(0, 60.0, 70.0, 80.0), (2, 62.0, 72.0, 82.0)]


def test_report(spark, tmp_path):
    write(tmp_path / "good.dcd")
    write(tmp_path / "short.dcd", frames=4, cut=10)
    write(tmp_path / "velocity.dcd", magic=b"VELD")
    write(tmp_path / "fixed.dcd", fixed=2)
    (tmp_path / "empty.dcd").write_bytes(b"")
    (tmp_path / "foreign.dcd").write_bytes(b"not a trajectory at all" * 9)
    damaged = bytearray(dcd.encode_header(4, 2) + dcd.encode_frames(frames_of(2, 4)))
    damaged[-4] = 9
    (tmp_path / "damaged.dcd").write_bytes(bytes(damaged))
    dcd.register(spark)
    rows = {r.path.rsplit("/", 1)[1][:-4]: r for r in
            spark.read.format("dcd").option("table", "report").load(str(tmp_path)).collect()}
    assert (rows["good"].status, rows["good"].frames_loaded, rows["good"].num_atoms) == ("ok", 3, 4)
    assert rows["good"].time_step == pytest.approx(0.002)
    assert (rows["short"].status, rows["short"].frames_in_file, rows["short"].frames_loaded) == ("ok", 4, 3)
    for name in ("velocity", "fixed", "empty", "foreign", "damaged"):
        assert rows[name].status == "error" and rows[name].error, name
    skipping = spark.read.format("dcd").option("skipBad", "true").option("splitBytes", 1 << 20)
    (tmp_path / "damaged.dcd").unlink()
    assert skipping.load(str(tmp_path)).select("path", "frame").distinct().count() == 6
    with pytest.raises(Exception):
        spark.read.format("dcd").load(str(tmp_path)).count()


def test_sampling(spark):
    data = frames_of(3, 2)
    frames = spark.createDataFrame([(1, f, a, *map(float, data[f, a])) for f in range(3) for a in range(2)],
                                   "traj_id int, frame int, atom_idx int, x double, y double, z double")
    requests = spark.createDataFrame([(1, i, t) for i, t in enumerate((-1.0, 0.25, 1.0, 1.5, 9.0))], "traj_id int, request_id int, t double")
    got = {r.request_id: r.x for r in trajectory.sample(requests, frames).where("atom_idx = 0").collect()}
    assert got == {0: 0.0, 1: 25.0, 2: 100.0, 3: 150.0, 4: 200.0}
    nearest = {r.request_id: r.frame for r in trajectory.sample_nearest(requests, frames).where("atom_idx = 0").collect()}
    assert nearest == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2}
    assert trajectory.lookup(frames, 7).count() == 0


def test_stream_equals_batch_and_survives_restart(spark):
    rng = np.random.default_rng(1)
    rows = [(1, m, t, int(rng.integers(0, 9)), bool(rng.random() < 0.4), bool(rng.random() < 0.3)) for m in range(5) for t in range(30)]
    events = spark.createDataFrame(rows, "structure_id bigint, mol_id bigint, tick bigint, partner_id bigint, bind boolean, unbind boolean")
    landed, target, checkpoint = (fresh_path(spark, n) for n in ("landed", "target", "checkpoint"))
    batches = []
    for low, high in ((0, 12), (12, 20), (20, 30)):
        events.where(f"tick >= {low} AND tick < {high}").repartition(3).write.mode("append").parquet(landed)
        batches.append(stream.run_available(spark, landed, events.schema, target, checkpoint))
    assert batches == [1, 1, 1]
    got = {(r.mol_id, r.tick): r.bound for r in spark.read.schema(stream.OUTPUT).parquet(target).collect()}
    batch = {(r.mol_id, r.tick): r.bound for r in binding.binding_states(events).collect()}
    assert got == batch
    for m in range(5):
        bound = False
        for _, _, t, _, bind, unbind in (r for r in rows if r[1] == m):
            bound = (not unbind) if bound else bind
            assert got[(m, t)] == bound


def test_stream_loses_no_late_row(spark):
    rows = [(1, 1, t, 5, True, False) for t in range(7)]
    events = spark.createDataFrame(rows, "structure_id bigint, mol_id bigint, tick bigint, partner_id bigint, bind boolean, unbind boolean")
    landed, target, checkpoint = (fresh_path(spark, n) for n in ("landed", "target", "checkpoint"))
    for ticks in ((0, 1, 5), (2, 3, 4, 6)):
        events.where(events.tick.isin(*ticks)).write.mode("append").parquet(landed)
        stream.run_available(spark, landed, events.schema, target, checkpoint)
    states = spark.read.schema(stream.OUTPUT).parquet(target)
    assert sorted(r.tick for r in states.collect()) == list(range(7))
    assert sorted(r.tick for r in states.where("late").collect()) == [2, 3, 4]
    assert stream.late_counts(states).first().num_late == 3


def test_frame_spread_far_from_the_origin(spark):
    rows = [(1, f, a, 1e7 + a % 2, -1e7, 1e7) for f in range(2) for a in range(4)]
    frames = spark.createDataFrame(rows, "traj_id int, frame int, atom_idx int, x double, y double, z double")
    assert [r.gyration for r in trajectory.frame_series(frames).collect()] == pytest.approx([0.5, 0.5], rel=1e-9)


def test_report_of_a_cut_box_and_planned_slices(spark, tmp_path):
    size = 3 * (16 + 8) + 56
    write(tmp_path / "box.dcd", frames=4, cell=True, cut=size - 20)
    dcd.register(spark)
    report = spark.read.format("dcd").option("table", "report")
    bad = report.load(str(tmp_path)).first()
    assert bad.status == "error" and "box" in bad.error
    assert report.option("maxFrames", 3).load(str(tmp_path)).first().status == "ok"
    write(tmp_path / "box.dcd", frames=60, cell=True)
    def reader(**limits):
        options = {"path": str(tmp_path), "splitBytes": "1000"} | limits
        return dcd.TrajectoryReader(options, "frames")
    assert len(reader().partitions()) > 7 and len(reader(maxFrames="3", stride="2").partitions()) == 1


def test_options_become_byte_offsets(spark, tmp_path):
    write(tmp_path / "a.dcd", frames=40, cell=True)
    write(tmp_path / "b.dcd", frames=9)
    dcd.register(spark)

    def rows(**options):
        frames = spark.read.format("dcd").options(**({"splitBytes": 1000} | options)).load(str(tmp_path))
        return sorted((r.path, r.frame, r.atom_idx, r.x) for r in frames.collect())

    everything = rows()
    for options, keep in [
            ({"frames": "7"}, lambda r: r[1] == 7), ({"frames": "7", "atoms": "2"}, lambda r: r[1] == 7 and r[2] == 2),
            ({"frames": "6:9"}, lambda r: 6 <= r[1] < 9), ({"frames": "37:"}, lambda r: r[1] >= 37), ({"frames": ":0"}, lambda r: False),
            ({"frames": "1, 30,400", "atoms": ":2"}, lambda r: r[1] in (1, 30) and r[2] < 2), ({"atoms": "0,9"}, lambda r: r[2] == 0),
            ({"frames": ":20", "stride": 3, "maxFrames": 4}, lambda r: r[1] in (0, 3, 6, 9)), ({"frames": "5:", "stride": 4}, lambda r: r[1] >= 5 and r[1] % 4 == 0),
            ({"files": "b*", "atoms": "3:"}, lambda r: r[0].endswith("b.dcd") and r[2] >= 3), ({"frames": "-4"}, lambda r: False)]:
        assert rows(**options) == [r for r in everything if keep(r)], options


def test_planned_slices(tmp_path):
    write(tmp_path / "a.dcd", frames=400, cell=True)
    write(tmp_path / "b.dcd", frames=9)
    (tmp_path / "c.dcd").write_bytes(b"no trajectory")

    def planned(**options):
        reader = dcd.TrajectoryReader({"path": str(tmp_path), "splitBytes": "1000"} | options, "frames")
        slices = [s for p in reader.partitions() for s in p.slices]
        return [(s.start, s.stop) for s in slices if s.path.endswith("a.dcd")], len({s.path for s in slices})

    assert len(planned()[0]) > 50 and len(planned(frames="4:")[0]) > 50
    assert planned(frames="7") == ([(7, 8)], 3)
    assert planned(frames=":4")[0] == planned(maxFrames="2", stride="3")[0] == [(i, i + 1) for i in range(4)]
    assert planned(frames="3,5")[0] == [(3, 4), (4, 5), (5, 6)] and planned(frames="-1")[1] == 0 and planned(files="b.dcd")[1] == 1


def test_report_by_ranges_equals_report_by_files(spark, tmp_path):
    write(tmp_path / "good.dcd", frames=60, cell=True)
    write(tmp_path / "short.dcd", frames=4, cut=10)
    write(tmp_path / "velocity.dcd", magic=b"VELD")
    write(tmp_path / "box.dcd", frames=40, cell=True, cut=3 * (16 + 8) + 56 - 20)
    (tmp_path / "empty.dcd").write_bytes(b"")
    (tmp_path / "nothing.dcd").write_bytes(dcd.encode_header(4, 2))
    damaged = bytearray(dcd.encode_header(4, 50) + dcd.encode_frames(frames_of(50, 4)))
    for frame in (49, 23, 31):
        damaged[len(dcd.encode_header(4, 50)) + frame * 3 * 24 + 72 - 4] = 9
    (tmp_path / "damaged.dcd").write_bytes(bytes(damaged))
    dcd.register(spark)
    by_file = spark.read.format("dcd").option("table", "report")
    for options in ({}, {"stride": 3, "maxFrames": 5}):
        want = {tuple(r) for r in by_file.options(**options).load(str(tmp_path)).collect()}
        got = {tuple(r) for r in dcd.report(spark, str(tmp_path), options.get("stride", 1), options.get("maxFrames", 0), split_bytes=500).collect()}
        assert got == want and len(got) == 7
    checks = spark.read.format("dcd").option("table", "checks").option("splitBytes", 900).load(str(tmp_path))
    assert checks.where("path LIKE '%good.dcd'").groupBy(F.spark_partition_id()).count().count() >= 9


def test_samples_are_not_summed_after_the_join(spark):
    """What the requests get is not grouped again; a frame without its successor counts by its own share."""
    frames = spark.createDataFrame([(1, f, a, 10.0 * f + a, 0.0, 1.0) for f in (0, 1, 3) for a in (0, 1)],
                                   "traj_id int, frame int, atom_idx int, x double, y double, z double")
    requests = spark.createDataFrame([(1, 1, 0.25), (1, 2, 1.5), (1, 3, 9.0), (1, 4, 2.5)], "traj_id int, request_id int, t double")
    found = trajectory.sample(requests, frames)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("Join")]
    got = {(r.request_id, r.atom_idx): (r.x, r.z) for r in found.collect()}
    assert got == {(1, 0): (2.5, 1.0), (1, 1): (3.5, 1.0), (2, 0): (5.0, 0.5), (2, 1): (5.5, 0.5), (3, 0): (30.0, 1.0),
                   (3, 1): (31.0, 1.0), (4, 0): (15.0, 0.5), (4, 1): (15.5, 0.5)}
