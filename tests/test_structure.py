"""Secondary structure, backbone curves, blocked scans, grid joins, density: against brute force."""

import math
import random
import subprocess
import sys
from types import SimpleNamespace

import numpy as np
import pytest
import samples
from pyspark import cloudpickle
from pyspark.sql import functions as F

from atomweave import session
from atomweave.functions import chemistry
from atomweave.operators import backbone, binding, density, grid, measures, neighbours, scans, secondary
from atomweave.plans import joining


def states(spark, rows):
    atoms = spark.createDataFrame(rows, samples.PEPTIDE_SCHEMA).withColumn("residue_class", F.lit("AminoAcid"))
    residues = atoms.select("structure_id", "residue_idx").distinct()
    found = secondary.compute(atoms, residues).orderBy("residue_idx").collect()
    return "".join({"Coil": "C", "Helix": "H", "Sheet": "E", "Turn": "T"}[r.ss] for r in found)


def test_helix_strand_proline(spark):
    assert states(spark, samples.peptide(16, -57, -47)) == "C" + "H" * 14 + "C"
    assert states(spark, samples.peptide(16, -139, 135)) == "C" * 16
    assert states(spark, samples.peptide(10, -57, -47)) == "CHHHHHHHHC"
    assert states(spark, samples.peptide(10, -57, -47, {5: "PRO"})) == "CTTHHHHHHC"


def test_torsions_of_built_helix(spark):
    atoms = spark.createDataFrame(samples.peptide(8, -57, -47), samples.PEPTIDE_SCHEMA).withColumn("residue_class", F.lit("AminoAcid"))
    rows = secondary.torsions(secondary.gather_backbone(atoms)).orderBy("residue_idx").collect()
    assert rows[0].phi is None and rows[7].psi is None
    for r in rows[1:7]:
        assert r.phi == pytest.approx(-57, abs=1e-6) and r.psi == pytest.approx(-47, abs=1e-6)
        assert abs(r.omega) == pytest.approx(180, abs=1e-6)


def test_copies_do_not_change_the_best_bonds(spark):
    rows = samples.peptide(12, -57, -47)
    copies = [(1, a + 48 * k, i + 12 * k, k, n, r, x, y, z) for k in range(7) for (_, a, i, _, n, r, x, y, z) in rows]
    atoms = spark.createDataFrame(copies, samples.PEPTIDE_SCHEMA).withColumn("residue_class", F.lit("AminoAcid"))
    hydrogens = secondary.estimate_amide_h(secondary.gather_backbone(atoms))
    full = {(r.nh, r.co) for r in secondary.best_two(secondary.hydrogen_bonds(hydrogens)).collect()}
    cut = {(r.nh, r.co) for r in secondary.best_two(secondary.hydrogen_bonds(hydrogens, best_only=True)).collect()}
    assert full == cut and full


@pytest.mark.parametrize("width", [1, 3, 16, 1000])
def test_blocked_scans(spark, width):
    rng = random.Random(width)
    data = [(k, o, rng.choice("ab"), rng.randrange(3)) for k in (1, 2) for o in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(data, "k int, o int, s string, v int")
    numbered = scans.runs(df, ["k"], "o", F.struct("s"), {"run": lambda a, b: a["s"] != b["s"]}, index="i",
                          positions=["run"], width=width)
    ranked = scans.row_index(df, ["k"], "o", ["o"], "i", total="n", width=width)
    summed = scans.running_sum(df, ["k"], "o", {"t": F.col("v")}, width=width)
    before = scans.last_before(df, ["k"], "o", F.when(F.col("v") == 2, F.col("o")), "b", width=width)
    switched = binding.two_state(df, (F.col("v") == 0) & (F.col("s") == "a"), (F.col("v") == 0) & (F.col("s") == "b"),
                                 F.col("v") == 1, "on", ["k"], "o", width=width)
    for k in (1, 2):
        mine = [row for row in data if row[0] == k]
        run, start, total, last, on, expected = -1, 0, 0, None, False, []
        for i, (_, o, s, v) in enumerate(mine):
            if i == 0 or mine[i - 1][2] != s:
                run, start = run + 1, i
            ends = i + 1 == len(mine) or mine[i + 1][2] != s
            total += v
            on = {0: s == "a", 1: not on, 2: on}[v]
            expected.append((o, i, run, i - start, ends, total, last, on))
            last = o if v == 2 else last
        def column(frame, *names):
            return [tuple(r[n] for n in names) for r in frame.where(F.col("k") == k).orderBy("o").collect()]
        assert column(numbered, "o", "i", "run", "run_pos", "run_end") == [e[:5] for e in expected]
        assert column(ranked, "i", "n") == [(e[1], 60) for e in expected]
        assert column(summed, "t") == [(e[5],) for e in expected]
        assert column(before, "b") == [(e[6],) for e in expected]
        assert column(switched, "on") == [(e[7],) for e in expected]


def test_bonds_against_all_pairs(spark):
    rng = random.Random(3)
    radii = {1: 0.31, 6: 0.76, 8: 0.66, 20: 1.76, 55: 2.44, 30: 1.22}
    rows = [(s, i, *(rng.uniform(-9, 9) for _ in range(3)), rng.choice(list(radii))) for s in (1, 2) for i in range(220)]
    rows += [(1, 220 + i, 1.0, 1.0, 1.0, 6) for i in range(90)] + [(1, 400, 2.0, 1.0, 1.0, 6)]
    atoms = spark.createDataFrame([(s, i, x, y, z, radii[e]) for s, i, x, y, z, e in rows],
                                  "structure_id int, atom_idx int, x double, y double, z double, covalent_radius double")
    expected = set()
    for i, (s, a, *p, e) in enumerate(rows):
        for t, b, *q, f in rows[i + 1:]:
            d2 = sum((u - w) ** 2 for u, w in zip(p, q))
            if s == t and 0.16 <= d2 <= (radii[e] + radii[f] + 0.45) ** 2:
                expected.add((s, min(a, b), max(a, b)))
    got = [(r.structure_id, r.atom_a, r.atom_b) for r in neighbours.bonds(atoms).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    assert sum(1 for g in got if g[2] == 400) >= 90


def test_nearest_partner_with_copies(spark):
    rng = random.Random(5)
    rows = [(1, 1, i, *(float(rng.randrange(-20, 20)) for _ in range(3))) for i in range(150)]
    rows += [(1, 1, 150 + i, 3.0, 3.0, 3.0) for i in range(40)]
    molecules = spark.createDataFrame(rows, "structure_id int, tick int, mol_id int, x double, y double, z double")
    got = {r.mol_id: (r.partner_id, r.d2) for r in neighbours.nearest_partner(molecules, 5.0).collect()}
    for _, _, i, *p in rows:
        near = [(sum((u - w) ** 2 for u, w in zip(p, q)), j) for _, _, j, *q in rows
                if j != i and all(abs(math.floor(u / 5) - math.floor(w / 5)) <= 1 for u, w in zip(p, q))]
        assert got.get(i) == ((min(near)[1], min(near)[0]) if near else None)


def test_shortest_distance_far_apart(spark):
    left = spark.createDataFrame([(1, float(i), 0.0, 0.0) for i in range(5)] + [(2, 0.0, 0.0, 0.0)], "structure_id int, x double, y double, z double")
    right = spark.createDataFrame([(1, 100.0 + i, 3.0, 0.0) for i in range(4)] + [(2, 1.0, 1.0, 0.0)], "structure_id int, x double, y double, z double")
    got = {r.structure_id: r.distance for r in neighbours.shortest_distance(left, right).collect()}
    assert got == {1: pytest.approx(math.hypot(96, 3)), 2: pytest.approx(math.sqrt(2))}


def test_side_vectors_against_a_loop(spark):
    rng = np.random.default_rng(7)
    steps, sides = rng.normal(size=(60, 3)), rng.normal(size=(60, 3))
    positions = np.cumsum(steps, axis=0)
    has = rng.random(60) < 0.5
    has[:4] = False
    rows = [(1, 0, 0, i, *map(float, positions[i]), tuple(map(float, sides[i])) if has[i] else None) for i in range(60)]
    guides = spark.createDataFrame(rows, "structure_id int, chain_idx int, segment int, seq int, x double, y double, z double, "
                                         "carbonyl struct<x:double,y:double,z:double>")
    got = np.array([tuple(r.right) for r in backbone.orient(guides).orderBy("seq").collect()])
    last = np.zeros(3)
    for i in range(60):
        walk = positions[i + 1] - positions[i] if i < 59 else positions[i] - positions[i - 1]
        walk = walk / np.linalg.norm(walk)
        if has[i]:
            right = np.cross(walk, sides[i])
        else:
            hint = last if last.any() else np.array([0.0, 0.0, 1.0])
            right = hint - walk * (hint @ walk)
        right = right / np.linalg.norm(right)
        if last.any() and right @ last < 0:
            right = -right
        assert np.allclose(got[i], right), i
        last = right


def test_curve_passes_through_anchors(spark):
    rows = [(1, 0, 0, i, i, 6, float(i), math.sin(i), 0.0, (0.0, 0.0, 1.0)) for i in range(6)]
    guides = spark.createDataFrame(rows, "structure_id int, chain_idx int, segment int, seq int, residue_idx int, num_points int, "
                                         "x double, y double, z double, right struct<x:double,y:double,z:double>")
    points = backbone.resample(guides, steps=4, side=True).orderBy("point").collect()
    assert len(points) == 21 and points[-1].alpha == 1.0
    for i in range(6):
        assert (points[4 * i].x, points[4 * i].y) == pytest.approx((i, math.sin(i)))
    for p in points:
        assert p.forward_x * p.right_x + p.forward_y * p.right_y + p.forward_z * p.right_z == pytest.approx(0, abs=1e-9)


def test_single_atom_surface_radius(spark):
    atoms = chemistry.with_elements(spark.createDataFrame(
        [(1, 0, 1.0, 2.0, 3.0, 6, False)], "structure_id int, atom_idx int, x double, y double, z double, element int, is_water boolean"))
    used = density.contributing(atoms)
    lattice = density.voxel_grid(used, 0.3)
    found = density.iso_crossings(density.density_field(used, lattice), lattice).collect()
    radius = 1.70 * math.sqrt(1 + math.log(0.5) / -2.3)
    distances = [math.dist((r.x, r.y, r.z), (1, 2, 3)) for r in found]
    errors = [abs(d - radius) for d in distances]
    assert len(errors) > 100 and max(errors) < 0.1 and sum(errors) / len(errors) < 0.03
    coarse = density.voxel_grid(used, 0.3, max_voxels=1000).first()
    assert coarse.nx * coarse.ny * coarse.nz <= 1000 and coarse.voxel > 0.3


def test_grid_join_negative_coordinates(spark):
    rng = random.Random(11)
    rows = [(1, i, *(rng.uniform(-30, 30) for _ in range(3))) for i in range(300)]
    df = spark.createDataFrame(rows, "structure_id int, i int, x double, y double, z double")
    got = grid.candidates(df, df, ["structure_id"], 6.0, condition=grid.distance2() <= 36.0).count()
    assert got == sum(math.dist(p[2:], q[2:]) <= 6 for p in rows for q in rows)


def test_nearest_attribute_is_found_at_any_distance(spark):
    atoms = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, "a"), (1, 1, 500.0, 0.0, 0.0, "b")],
                                  "structure_id int, atom_idx int, x double, y double, z double, kind string")
    points = spark.createDataFrame([(1, 1, 1.0, 0.0, 0.0), (1, 2, 200.0, 90.0, 0.0), (1, 3, -9000.0, 1.0, 1.0), (2, 4, 0.0, 0.0, 0.0)],
                                   "structure_id int, point_id int, x double, y double, z double")
    got = {r.point_id: r.kind for r in neighbours.nearest_attribute(points, atoms, "kind", 2.0).collect()}
    assert got == {1: "a", 2: "a", 3: "a", 4: None}


def test_within_flag_and_strict_comparison(spark):
    atoms = spark.createDataFrame([(1, i, float(3 * i), 0.0, 0.0) for i in range(5)],
                                  "structure_id int, atom_idx int, x double, y double, z double")
    flagged = neighbours.with_within(atoms, atoms.where("atom_idx = 0"), 4.0)
    assert [r.atom_idx for r in flagged.where("NOT within OR atom_idx = 1").orderBy("atom_idx").collect()] == [1, 2, 3, 4]
    other = atoms.where("atom_idx < 4").union(atoms.where("atom_idx = 0"))
    got = sorted((r.atom_idx, r.status) for r in measures.reconcile_strict(atoms, other, atoms.columns).collect())
    assert got == [(0, "only_b"), (4, "only_a")]
    assert measures.reconcile_strict(atoms, atoms, atoms.columns).count() == 0


def test_staging_folder(spark):
    path = session.fresh_path(spark, "probe")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3 and path.startswith(session.shared_folder(spark))
    before = list(session._STAGED)
    session._STAGED[:] = [path]
    assert session.drop_staged(spark) == 1
    session._STAGED[:] = [p for p in before if p != path]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


@pytest.mark.parametrize("folder, default, want", [
    ("/shared/points", "file:///", "file:///shared/points"), ("file:///shared/points", "file:///", "file:///shared/points"),
    ("/shared/points", "hdfs://name:8020", "hdfs://name:8020/shared/points"), ("s3a://store/points", "file:///", "s3a://store/points")])
def test_shared_folder_of_a_cluster(folder, default, want):
    hadoop = SimpleNamespace(get=lambda key, other=None: default)
    context = SimpleNamespace(master="local-cluster[3,2,1024]", _jsc=SimpleNamespace(hadoopConfiguration=lambda: hadoop))
    assert session.shared_folder(SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=context)) == want


def test_hydrogen_bonds_are_not_broadcast_by_a_guess(spark, tmp_path):
    orders = spark.range(400).selectExpr("id AS o_orderkey", "id AS o_custkey")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    found = joining.hydrogen_bonds(spark, str(tmp_path))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert found.count() > 0


def test_side_vectors_on_executors_without_the_package(tmp_path):
    (tmp_path / "sent").write_bytes(cloudpickle.dumps((backbone.block_products, backbone.carry_along)))
    code = """
import pickle, sys
import pandas as pd
products, along = pickle.load(open(sys.argv[1], "rb"))
rows = pd.DataFrame({"s": 1, "seq": [0, 1], "wx": [0.0, 1.0], "wy": 0.0, "wz": [1.0, 0.0], "hx": 1.0, "hy": 0.0, "hz": 0.0})
print(*(len(pd.concat(f(iter([rows]), ["s"]))) for f in (products, along)), "atomweave" in sys.modules)
"""
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "sent")], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == ["1", "2", "False"], done.stderr


def stepped(directions, start):
    """Side vectors without carbonyl, one after the other."""
    out, spare = [], []
    for w in directions:
        rest = start - w * (w @ start)
        spare.append(rest @ rest < 1e-4)
        if spare[-1]:
            axis = np.array([0.0, 0.0, 1.0]) if abs(w[2]) < 0.9 else np.array([1.0, 0.0, 0.0])
            rest = axis - w * (w @ axis)
            rest = -rest if rest @ start < 0 else rest
        start = rest / np.linalg.norm(rest)
        out.append(start)
    return np.array(out), np.array(spare)


def ways_with_breaks(rng, n, breaks):
    """Random directions; at some rows the direction is nearly that of the side vector before it, so the rule needs an axis."""
    ways, start = rng.normal(size=(n, 3)), np.array([0.0, 0.0, 1.0])
    ways /= np.linalg.norm(ways, axis=1, keepdims=True)
    for i in range(n):
        if i in breaks:
            ways[i] = start + [0.004, -0.003, 0.002]
            ways[i] /= np.linalg.norm(ways[i])
        start = stepped(ways[i:i + 1], start)[0][0]
    return ways


def test_carried_vectors_are_products_of_projections():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 700, 3, 1, 50, 64]
    ways = [ways_with_breaks(rng, n, set(rng.integers(0, n, k).tolist())) for n, k in zip(sizes, (0, 1, 9, 0, 1, 40, 64))]
    want = [stepped(w, np.array([0.0, 0.0, 1.0])) for w in ways]
    place = np.concatenate([np.arange(n) for n in sizes])
    right, spare = backbone.carried(np.concatenate(ways), place, np.tile([0.0, 0.0, 1.0], (len(place), 1)))
    assert np.allclose(right, np.concatenate([w[0] for w in want]), atol=1e-9) and (spare == np.concatenate([w[1] for w in want])).all()


@pytest.mark.parametrize("breaks", [(), (3, 11, 12, 40, 41, 77)])
def test_long_chain_without_carbonyls(spark, breaks):
    """Stretches over many blocks, also with rows that need an axis, and with batches that end within a block."""
    rng = np.random.default_rng(9)
    n, has = 130, {60, 100}
    ways = ways_with_breaks(rng, n, breaks)
    positions = np.concatenate(([np.zeros(3)], np.cumsum(ways, axis=0)))[:n]
    rows = [(k, 0, 0, i, *map(float, positions[i]), (0.3, -0.7, 0.2) if i in has and k == 1 else None) for k in (1, 2) for i in range(n)]
    guides = spark.createDataFrame(rows, "structure_id int, chain_idx int, segment int, seq int, x double, y double, z double, "
                                         "carbonyl struct<x:double,y:double,z:double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        got = {(r.structure_id, r.seq): tuple(r.right) for r in backbone.orient(guides, width=8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (1, 2):
        last = None
        for i in range(n):
            walk = positions[i + 1] - positions[i] if i < n - 1 else positions[i] - positions[i - 1]
            walk = walk / np.linalg.norm(walk)
            if i in has and k == 1:
                right = np.cross(walk, (0.3, -0.7, 0.2))
                right = right / np.linalg.norm(right)
            else:
                right = stepped(walk[None], np.array([0.0, 0.0, 1.0]) if last is None else last)[0][0]
            right = -right if last is not None and right @ last < 0 else right
            assert np.allclose(got[k, i], right, atol=1e-7), (k, i)
            last = right


def test_closest_pairs_by_bounds(spark):
    """Clouds of many shapes against all pairs, ties and single points included; far clouds without a full product."""
    from atomweave.operators import pyramid
    rng = np.random.default_rng(12)
    clouds = {1: (rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) + 40), 2: (np.zeros((1, 3)), np.full((1, 3), 7.0)),
              3: (np.tile(np.arange(20.0)[:, None], (1, 3)), np.tile(np.arange(20.0)[:, None], (1, 3)) + [0.0, 9.0, 0.0]),
              4: (rng.normal(size=(50, 3)) * [1000, 1, 1e-3], rng.normal(size=(50, 3)) * [1, 1000, 1e-3] + 1e6), 5: (np.ones((4, 3)), np.ones((3, 3))),
              6: (rng.random((400, 3)) * [50, 50, 0], rng.random((400, 3)) * [50, 50, 0] + [0, 0, 200])}
    sides = [spark.createDataFrame([(k, *map(float, p)) for k, c in clouds.items() for p in c[s]] + [(90 + s, 0.0, 0.0, 0.0), (1, float("nan"), 0.0, 0.0)],
                                   "structure_id int, x double, y double, z double") for s in (0, 1)]
    counts = []
    got = {r.structure_id: r.d2 for r in pyramid.closest(*sides, ["structure_id"], counts).collect()}
    assert got == {k: pytest.approx(((a[:, None] - b[None]) ** 2).sum(axis=2).min()) for k, (a, b) in clouds.items()}
    two = [side.where("structure_id IN (1, 6)") for side in sides]
    counts.clear()
    pyramid.closest(*two, ["structure_id"], counts)
    assert sum(counts) < 0.1 * (300 * 200 + 400 * 400)
    distances = {r.structure_id: r.distance for r in neighbours.shortest_distance(*sides).collect()}
    assert distances == {k: pytest.approx(math.sqrt(d)) for k, d in got.items()}


def test_gyration_far_from_the_origin(spark):
    rows = [(1, i, 1e8 + i % 2, 1e8, -1e8, 12.0 if i % 3 else 1.0) for i in range(12)] + [(2, 0, 1.0, 2.0, 3.0, None), (2, 1, 3.0, 2.0, 3.0, 0.0), (3, 0, 0.0, 0.0, 0.0, 5.0)]
    atoms = spark.createDataFrame(rows, "structure_id int, atom_idx int, x double, y double, z double, mass double")
    got = {r.structure_id: r.radius_of_gyration for r in measures.radius_of_gyration(atoms, F.col("structure_id") < 3).collect()}
    weights = np.array([12.0 if i % 3 else 1.0 for i in range(12)])
    xs = np.array([i % 2 for i in range(12)], float)
    want = math.sqrt((weights * (xs - (weights * xs).sum() / weights.sum()) ** 2).sum() / weights.sum())
    assert got == {1: pytest.approx(want, rel=1e-6), 2: pytest.approx(1.0), 3: 0.0}


def test_quality_report_keeps_structures_without_an_expectation(spark):
    summary = spark.createDataFrame([(1, 10, 9, 3), (2, 10, 9, 3)], "structure_id int, num_atoms int, num_bonds int, num_residues int")
    composition = spark.createDataFrame([(2, 1, 1)], "structure_id int, num_helix int, num_sheet int")
    expectations = spark.createDataFrame([(2, 1, 20, 0, 0)], "structure_id int, min_atoms int, max_atoms int, file_helix int, file_sheet int")
    got = {r.structure_id: tuple(r)[1:] for r in measures.quality_report(summary, composition, expectations).collect()}
    assert got == {1: (None, True, None, None), 2: (True, True, True, True)}


def test_strict_reconciliation_by_digests(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (1, 2, None), (2, 1, "y"), (3, 1, "z")], "structure_id int, atom_idx int, name string")
    b = spark.createDataFrame([(1, 2, None), (1, 1, "x"), (2, 1, "y"), (4, 1, "z")], "structure_id int, atom_idx int, name string")
    got = sorted(map(tuple, measures.reconcile_by_digest(a, b, ["atom_idx", "name"]).collect()))
    assert got == [(1, 1, "x", "only_a"), (3, 1, "z", "only_a"), (4, 1, "z", "only_b")]
    assert measures.reconcile_by_digest(a, a.repartition(5), ["atom_idx", "name"]).count() == 0


def test_field_uses_tasks_by_its_atoms(spark, monkeypatch):
    """More atoms are more tasks, and blocks of any width give the same sums."""
    monkeypatch.setattr(density, "ATOMS_PER_TASK", 5, raising=False)
    rng = random.Random(8)
    rows = [(1, *(rng.uniform(-4, 4) for _ in range(3)), 1.7) for _ in range(40)]
    atoms = spark.createDataFrame(rows, "structure_id int, x double, y double, z double, r double")
    lattice = density.voxel_grid(atoms, 0.9)
    fields = [density.density_field(atoms, lattice, per_block=width) for width in (3, 1000)]
    assert fields[0].rdd.getNumPartitions() == 8
    narrow, wide = ({(r.ix, r.iy, r.iz): r.density for r in f.collect()} for f in fields)
    assert narrow.keys() == wide.keys() and all(abs(wide[k] - v) < 1e-9 for k, v in narrow.items())


def test_bridges_use_tasks_by_their_bonds(spark, monkeypatch):
    monkeypatch.setattr(secondary, "BONDS_PER_TASK", 5, raising=False)
    bonds = spark.createDataFrame([(1, 3 * k, 3 * k + 7) for k in range(20)] + [(1, 3 * k + 7, 3 * k) for k in range(20)],
                                  "structure_id int, co int, nh int")
    found = secondary.bridges(bonds)
    assert found.rdd.getNumPartitions() == 8
    assert {(r.i, r.j) for r in found.where("antiparallel").collect()} >= {(3 * k, 3 * k + 7) for k in range(20)}
