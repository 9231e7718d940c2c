"""What large tables cost in shuffles: rows that must not be multiplied or moved twice."""

import random

import pytest
from pyspark.sql import functions as F

from atomweave.operators import assemble, neighbours, tiles
from atomweave.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    """Shuffles of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(plan.count(kind) for kind in ("Exchange hashpartitioning", "Exchange rangepartitioning"))


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(9)
    rows = [(1 + i % 2, 7, i, *(rng.uniform(-150, 150) for _ in range(3))) for i in range(900)]
    return spark.createDataFrame(rows, "structure_id int, tick int, atom_idx int, x double, y double, z double").withColumns(
        {"covalent_radius": F.lit(0.7), "radius": F.lit(1.0), "roll": F.lit(0.5), "mol_id": F.col("atom_idx")})


def test_partners_take_one_shuffle_and_few_copies(spark, points):
    """Molecules went to eight tiles each, and were shuffled seven times."""
    found = neighbours.contacts(points, 10.0)
    assert exchanges(found) == 1 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    cells = {a: F.floor(F.col(a) / 10) for a in "xyz"}
    tile = [{a: F.floor((cells[a] + neighbours.CELLS // 2 + step) / neighbours.CELLS) for a in "xyz"} for step in (-1, 0, 1)]
    assert tiles.spread(points, *tile).count() < 2 * points.count()
    assert found.count() == points.count()


def test_bonds_take_one_shuffle(spark, points):
    """Points went to eight tiles each for either of two joins."""
    found = neighbours.bonds(points)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert exchanges(found) == 1 and "Join" not in plan


def test_bonds_across_tiles(spark):
    """Chains of atoms a bond apart that cross the borders of tiles along each axis and each diagonal."""
    step, middle = 1.4, neighbours.TILE / 2
    rows, expected = [], set()
    for s, (dx, dy, dz) in enumerate([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]):
        length = (dx * dx + dy * dy + dz * dz) ** 0.5
        for i in range(12):
            at = (i - 5.5) * step / length
            rows.append((s, i, middle + dx * at, -middle + dy * at, 3 * middle + dz * at, 0.7))
        expected |= {(s, i, i + 1) for i in range(11)}
    atoms = spark.createDataFrame(rows, "structure_id int, atom_idx int, x double, y double, z double, covalent_radius double")
    got = [(r.structure_id, r.atom_a, r.atom_b) for r in neighbours.bonds(atoms).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_groups_are_whole_whatever_the_batches(spark):
    """Tiles that a batch cuts, and tiles larger than what is looked at together."""
    import numpy as np
    import pyarrow as pa
    keys = np.repeat(np.arange(6), [3, 50, 1, 20, 2, 9])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 4]), pa.array(np.arange(i, min(i + 4, len(keys))))], ["k", "v"])
               for i in range(0, len(keys), 4)]
    parts = list(tiles.whole_groups(iter(batches), ["k"], rows=8))
    assert [v for t, _ in parts for v in t.column("v").to_pylist()] == list(range(len(keys)))
    seen = [k for t, _ in parts for k in dict.fromkeys(t.column("k").to_pylist())]
    assert seen == list(range(6)) and all(g[0] == 0 for _, g in parts)


def test_atoms_are_numbered_where_they_lie(spark):
    """Atoms put in order by block were shuffled again to be numbered, and once more to find lone ions."""
    kept = fx.chemistry.enrich(fx.atoms(spark, SF, keep_block=True)).withColumnRenamed("atom_idx", "line_no")
    rows = assemble.number_runs(kept, mark_alone=True)
    again = assemble.number_runs(kept.drop("_blk"), mark_alone=True)
    assert exchanges(rows) <= exchanges(again) - 2
    plain = fx.numbered(spark, SF)
    with_mark = neighbours.without_lone_ions(plain).select("structure_id", "atom_idx")
    grouped = neighbours.without_lone_ions(plain.drop("is_alone")).select("structure_id", "atom_idx")
    assert with_mark.exceptAll(grouped).isEmpty() and grouped.exceptAll(with_mark).isEmpty()


def test_decisions_are_staged_with_what_is_read(spark):
    from atomweave.plans import ordering
    assert ordering.decided(spark, SF).columns == ["structure_id", "mol_id", "tick", "bind", "unbind"]


def test_strewn_keys_are_few_blocks(spark):
    """Rows of a key that lie far apart were a block each."""
    from atomweave.operators import scans
    far = spark.range(0, 100).select(F.lit(1).alias("k"), (F.col("id") * 10_000_000).alias("o"))
    width = scans.block_width(far, "o")
    assert scans.tag(far, "o", width).select("_blk").distinct().count() <= 32
    got = scans.row_index(far, ["k"], "o", ["o"], "i", width=width).where("i * 10000000 <> o").count()
    assert got == 0


def test_crossings_without_voxel_rows(spark):
    """The field went out as a row a voxel, was written, read twice and looked up fourteen times a voxel; same points here, in small blocks."""
    from atomweave.functions import chemistry
    from atomweave.operators import density
    rng = random.Random(4)
    rows = [(1 + i % 3, i, *(rng.choice([rng.uniform(-6, 6), 2.5]) for _ in range(3)), rng.choice([6, 7, 8, 16]), False) for i in range(60)]
    atoms = chemistry.with_elements(spark.createDataFrame(rows, "structure_id int, atom_idx int, x double, y double, z double, element int, is_water boolean"))
    used = density.contributing(atoms)
    lattice = density.voxel_grid(used, 0.9)
    place = ["structure_id", "ax", "ay", "az", "dx", "dy", "dz"]
    def points(df):
        return {tuple(row[c] for c in place): tuple(row[c] for c in "txyz") for row in df.collect()}
    by_rows = points(density.iso_crossings(density.density_field(used, lattice), lattice))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # blocks go over several batches
    try:
        for per_block in (3, 24):
            got = density.crossings(used, lattice, per_block=per_block)
            rows = got.collect()
            assert len(rows) == len(by_rows)
            found = points(got)
            assert found.keys() == by_rows.keys()
            assert all(found[k] == pytest.approx(by_rows[k], abs=1e-9) for k in found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert exchanges(density.crossings(used, lattice)) <= 4


def test_stream_state_of_many_molecules_is_one_entry(spark, tmp_path):
    """The state store had an entry for each molecule, and a round trip for each in every batch."""
    from atomweave.streaming import binding as stream
    landed, target, checkpoint = (str(tmp_path / n) for n in ("landed", "target", "checkpoint"))
    schema = "structure_id bigint, mol_id bigint, tick bigint, partner_id bigint, bind boolean, unbind boolean"
    for ticks in ((0, 1), (2, 3)):
        rows = [(1, m, t, m + 100, t == m % 4, t == 3) for m in range(150) for t in ticks]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        stream.run_available(spark, landed, schema, target, checkpoint)
    got = {(r.mol_id, r.tick): (r.bound, r.bound_to) for r in spark.read.schema(stream.OUTPUT).parquet(target).collect()}
    assert got == {(m, t): ((True, m + 100) if m % 4 <= t < 3 or (m % 4 == 3 and t == 3) else (False, None))
                   for m in range(150) for t in range(4)}
    state = spark.read.format("statestore").option("stateVarName", "binding").load(checkpoint)
    assert state.count() == 3


def test_nearest_attribute_copies_points_not_atoms(spark, monkeypatch):
    """Every place of an atom went to eight tiles, and all atoms were made again for every search of farther cells."""
    made = []
    plain = neighbours.grid.candidates
    monkeypatch.setattr(neighbours.grid, "candidates", lambda left, right, *more, **named: made.append((left.count(), right.count())) or plain(
        left, right, *more, **named))
    atoms = spark.createDataFrame([(1 + i % 4, i, float(i % 30), 0.0, 0.0, i % 7) for i in range(400)],
                                  "structure_id int, atom_idx int, x double, y double, z double, element int")
    points = spark.createDataFrame([(1, 1, 5.0, 1.0, 0.0), (1, 2, 90.0, 0.0, 0.0), (9, 3, 0.0, 0.0, 0.0), (1, 4, float("nan"), 0.0, 0.0)],
                                   "structure_id int, point_id int, x double, y double, z double")
    got = {r.point_id: r.atom_idx for r in neighbours.nearest_attribute(points, atoms, "element", 4.0).collect()}
    assert got[1] == 4 and got[2] is not None and got[3] is None and got[4] is None
    assert len(made) > 1 and all(left == 15 for left, _ in made)  # the places of the structure with points, on the side without copies


def test_blocks_give_only_the_items_asked_for(spark):
    """Every value of every atom left the lexer for the model numbers; rows cut by blocks and quoted values included."""
    from atomweave.sources import cif, cif_blocks
    lines = ["data_X", "_entry.id E", "loop_", "_atom_site.id", "_atom_site.name", "_atom_site.pdbx_PDB_model_num"]
    lines += [f"{i} {name} {1 + i % 2}" for i, name in enumerate(["CA", "\"C A\"", "'loop_'", "N"] * 5)] + ["20 \"O", "5\"", "2", "21 ", "C 1", "#", "_exptl.method 'X RAY'"]
    text = "\n".join(lines)
    items = {"atom_site": ("pdbx_pdb_model_num",)}
    place = ["file", "ordinal", "category", "row", "items"]
    def rows(df):
        return sorted((r.file, r.ordinal, r.category, r.row, tuple(sorted(r["items"].items()))) for r in df.select(*place).collect())
    whole = spark.createDataFrame([(1, text)], "file int, value string")
    for size in (1, 3, 100):
        blocks = spark.createDataFrame([(1, i, "\n".join(lines[i:i + size])) for i in range(0, len(lines), size)], "file int, block long, text string")
        for only in (None, items):
            assert rows(cif_blocks.category_rows(blocks, items=only)) == rows(cif.category_rows(whole, items=only))
