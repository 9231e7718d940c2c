"""Selections, measures, identifiers, boundaries: exact counts and values."""

import math

import duckdb
import pytest
import samples
from pyspark.sql import functions as F

from atomweave.functions import appearance, chemistry, dynamics, identifiers, selection as sel
from atomweave.operators import exports, measures, neighbours
from atomweave.plans import fixtures, joining


@pytest.fixture(scope="module")
def atoms(spark):
    rows = [(1, i, n, r, c, s, h, e, b, float(i), 0.0, 0.0, " ", "Helix" if c == "A" else "Coil")
            for i, (n, r, c, s, h, e, b) in enumerate(samples.SELECTION)]
    return chemistry.enrich(spark.createDataFrame(
        rows, "structure_id int, atom_idx int, name string, res_name string, chain_id string, res_seq int, "
              "is_hetatm boolean, element int, b_factor double, x double, y double, z double, alt_loc string, ss string")).cache()


COUNTS = [
    (lambda: sel.everything(), 11), (lambda: sel.nothing(), 0), (lambda: sel.protein(), 9), (lambda: sel.water(), 1),
    (lambda: sel.hetero(), 2), (lambda: sel.ligand(), 1), (lambda: sel.backbone(), 8), (lambda: sel.sidechain(), 1),
    (lambda: sel.nucleic(), 0), (lambda: ~sel.water(), 10), (lambda: sel.chain("A"), 7), (lambda: sel.chain("B"), 2),
    (lambda: sel.chain("A+B"), 9), (lambda: sel.chain("a"), 7), (lambda: sel.resi("1"), 5), (lambda: sel.resi("1-2"), 7),
    (lambda: sel.resi("1+10"), 7), (lambda: sel.resn("ALA"), 5), (lambda: sel.resn("ala+GLY"), 7), (lambda: sel.name("CA"), 3),
    (lambda: sel.name("N+CA"), 6), (lambda: sel.element("C"), 5), (lambda: sel.element("Zn"), 1), (lambda: sel.ss("H"), 7),
    (lambda: sel.b_above(50), 4), (lambda: sel.b_below(25), 3), (lambda: sel.chain("A") & sel.name("CA"), 2),
    (lambda: (sel.chain("A") | sel.chain("B")) & sel.name("CA"), 3),
    (lambda: sel.chain("A") | sel.chain("B") & sel.name("CA"), 8), (lambda: sel.protein() & ~sel.backbone(), 1)]


def test_counts(atoms):
    counted = atoms.agg(*[F.count_if(build()).alias(f"c{i}") for i, (build, _) in enumerate(COUNTS)]).first()
    assert list(counted) == [count for _, count in COUNTS]


def test_within(atoms):
    zinc = atoms.where(sel.resn("ZN"))
    assert neighbours.within(atoms, zinc, 0.1).count() == 1
    assert neighbours.within(atoms, zinc, 100).count() == 11
    assert neighbours.within(atoms, atoms.where(sel.nothing()), 5).count() == 0
    with pytest.raises(ValueError):
        neighbours.within(atoms, zinc, 0)


@pytest.mark.parametrize("term", [lambda: sel.element("Qq"), lambda: sel.ss("H+X"), lambda: sel.resi("1-x"), lambda: sel.resi("")])
def test_bad_arguments(spark, term):
    with pytest.raises(sel.SelectionError):
        term()


def test_index_list_and_thinning(spark, atoms):
    row = sel.index_lists(atoms.where(sel.name("CA"))).first()
    assert (row.atom_indices, row.num_selected) == ([1, 6, 8], 3)
    for limit in (0, 1, 3, 4, 7, 11, 20):
        kept = [r.atom_idx for r in exports.thin_atoms(atoms, limit).orderBy("atom_idx").collect()]
        expected = list(range(11)) if limit == 0 or limit >= 11 else [i * 11 // limit for i in range(limit)]
        assert kept == expected


def points(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(rows)],
                                 "structure_id int, atom_idx int, x double, y double, z double")


def test_distance_angle_dihedral(spark):
    table = points(spark, [(1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1), (3, 4, 0), (0, 2, 0), (0, 3, 0), (0, 1, -1)])
    tuples = spark.createDataFrame([(1, 0, 0, 1, 2, 3), (1, 1, 1, 4, 1, 0), (1, 2, 1, 2, 5, 6), (1, 3, 0, 1, 2, 7), (1, 4, 1, 99, 2, 3)],
                                   "structure_id int, tuple_id int, a int, b int, c int, d int")
    got = {r.tuple_id: r for r in measures.measure_tuples(tuples, table).collect()}
    assert got[0].angle == pytest.approx(90) and got[0].dihedral == pytest.approx(-90)
    assert got[3].dihedral == pytest.approx(90)
    assert got[1].distance == pytest.approx(5) and got[1].angle == pytest.approx(0)
    assert got[2].angle == pytest.approx(180) and got[2].dihedral == 0
    assert got[4].distance is None and got[4].angle is None and got[4].dihedral is None


def test_masses_and_rmsd(spark):
    corners = points(spark, [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0)]).withColumn("mass", F.lit(12.0))
    assert measures.radius_of_gyration(corners).first().radius_of_gyration == pytest.approx(1.0)
    assert measures.centre_of_mass(corners).first()[1:] == (0.0, 0.0, 0.0)
    nameless = points(spark, [(1, 0, 0), (3, 0, 0)]).withColumn("mass", F.lit(0.0))
    assert measures.centre_of_mass(nameless).first().com_x == 2.0
    three = points(spark, [(0, 0, 0), (5, 0, 0), (9, 0, 0)])
    moved = three.withColumn("z", F.when(F.col("atom_idx") == 1, 3.0).otherwise(0.0))
    assert measures.rmsd(three, three).first().rmsd == 0
    assert measures.rmsd(three, moved).first().rmsd == pytest.approx(math.sqrt(3))
    assert measures.rmsd(three, moved, where=F.col("atom_idx") == 1).first().rmsd == pytest.approx(3)
    assert measures.rmsd(three, moved, where=F.lit(False)).first().rmsd is None
    assert measures.rmsd(three, moved.where("atom_idx < 2")).first().rmsd is None


def test_identifiers(spark):
    def valid(function, texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(function(F.col("t"))).collect()]
    assert all(valid(identifiers.valid_entry_id, ["1CRN", "4HHB", "6VXX", "1crn", "pdb_00001crn"]))
    assert not any(valid(identifiers.valid_entry_id, ["", "1CR", "1CRNX", "ACRN", "0CRN", "1C-N", "1CRN\n", "../1"]))
    assert all(valid(identifiers.valid_accession, ["P69905", "Q8N158", "O00533", "p69905", "A2BC19", "A0A023GPI8"]))
    assert not any(valid(identifiers.valid_accession, ["", "P6990", "A0A023GP", "1P6990", "P0A023GPI8", "P6990X"]))
    keys = spark.createDataFrame([("archive", " 1crn\t"), ("prediction", "p69905"), ("archive", "a/../b")], "s string, i string")
    got = keys.select(identifiers.storage_key(F.col("s"), F.col("i")).alias("k")).collect()
    assert [r.k for r in got] == ["rcsb-1CRN.cif", "alphafold-P69905.cif", None]


def test_boundaries_and_bands(spark):
    one = spark.range(1)
    def value(column):
        return one.select(column.alias("v")).first().v
    low, high = F.lit(-1.0), F.lit(1.0)
    assert value(dynamics.wrap(F.lit(1.5), low, high)) == -0.5
    assert value(dynamics.wrap(F.lit(-5.5), low, high)) == 0.5
    assert value(dynamics.wrap(F.lit(7.0), low, low)) == 7.0

    def bounced(v):
        v, s = float(v), 1.0
        for _ in range(100):
            if v < -1:
                v, s = -2 - v, abs(s)
            elif v > 1:
                v, s = 2 - v, -abs(s)
        return max(-1.0, min(1.0, v)), s
    for start in (0.5, 1.25, -1.5, 3.0, 3.25, -4.0, 9.5, -9.75, 40.0, -41.0):
        position, speed = dynamics.reflect(F.lit(start), F.lit(1.0), low, high)
        assert (value(position), value(speed)) == bounced(start), start
    bands = [value(dynamics.detail_band(F.lit(d * d), 10, 5, 20)) for d in (10.0, 10.1, 20.0, 20.1)]
    assert bands == ["Full", "Blob", "Blob", "Hidden"]
    assert value(dynamics.binds(F.lit(4.0), F.lit(2.0), 2.0, 0.5, F.lit(0.1)))
    assert not value(dynamics.binds(F.lit(4.1), F.lit(2.0), 2.0, 0.5, F.lit(0.1)))
    assert not value(dynamics.binds(F.lit(1.0), F.lit(2.0), 0.0, 0.5, F.lit(0.0)))
    assert not value(dynamics.unbinds(0.3, 0.0, F.lit(0.0)))
    assert value(appearance.iso_radius(F.lit(2.0), -2.3, 0.5)) == pytest.approx(2 * math.sqrt(1 + math.log(0.5) / -2.3))
    assert value(appearance.iso_radius(F.lit(2.0), 1.0, 0.5)) == 2.0


def test_flat_zigzag_is_180_in_both_engines(spark):
    """The triple product of these four atoms is -0.0, of their mirror image 0.0."""
    places = [(13.0, 6.75, 34.75), (39.0, 26.25, 32.75), (26.0, 16.5, 21.75), (22.0, 13.5, 3.5)]
    rows = [(k, i, x, y, sign * z) for k, sign in ((1, 1.0), (2, -1.0)) for i, (x, y, z) in enumerate(places)]
    atoms = spark.createDataFrame(rows, "structure_id int, atom_idx int, x double, y double, z double")
    tuples = spark.createDataFrame([(k, 0, 0, 1, 2, 3) for k in (1, 2)], "structure_id int, tuple_id int, a int, b int, c int, d int")
    assert [r.dihedral for r in measures.measure_tuples(tuples, atoms).collect()] == [180.0, 180.0]
    database = duckdb.connect()
    database.execute("CREATE TABLE atoms AS SELECT * FROM (VALUES " + ", ".join(str(r) for r in rows) + ") AS t(structure_id, atom_idx, x, y, z)")
    for a in "xyz":
        database.execute(f"ALTER TABLE atoms ALTER {a} TYPE DOUBLE")
    views = {**joining.MEASURED, "tuples": "SELECT DISTINCT structure_id, 0 AS tuple_id, 0 AS a, 1 AS b, 2 AS c, 3 AS d FROM atoms"}
    found = database.execute(fixtures.with_views(f"SELECT {joining.TORSION} FROM normals", extra=views)).fetchall()
    assert found == [(180.0,), (180.0,)]
