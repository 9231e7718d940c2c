"""A folder of both formats, bad files and a second landing."""

import samples
from pyspark.sql import functions as F

from atomweave.session import fresh_path
from atomweave.sources import loader


def folder_of_files(folder):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "one.cif").write_text(samples.cif_text())
    (folder / "two.pdb").write_text(samples.pdb_text())
    (folder / "by-content.txt").write_text(samples.pdb_text())
    (folder / "prose.txt").write_text("nothing of the kind")
    (folder / "empty.pdb").write_text("")
    (folder / "header.pdb").write_text("HEADER    PROTEIN\nTITLE     no atoms\n")
    (folder / "other.cif").write_text("data_x\n_entry.id X\n")
    (folder / "blank.cif").write_text("# nothing\n")
    (folder / "flat.cif").write_text(samples.cif_text().replace("Cartn_z", "height"))


REASONS = {"prose.txt": "unknown format", "header.pdb": "no atom records", "other.cif": "no atom_site",
           "blank.cif": "no atom_site", "flat.cif": "coordinate columns missing"}


def named(df):
    return {r.file.rsplit("/", 1)[1]: r for r in df.collect()}


def test_mixed_folder(spark, tmp_path):
    folder_of_files(tmp_path / "in")
    found = loader.load_folder(spark, str(tmp_path / "in"))
    structures = named(found["structures"])
    assert {k: r.reason for k, r in structures.items() if not r.success} == REASONS
    good = {k: r for k, r in structures.items() if r.success}
    assert {(r.format, r.num_atoms, r.num_residues, r.num_chains) for r in good.values()} == {("mmcif", 10, 3, 2), ("pdb", 10, 3, 2)}
    assert len({r.num_bonds for r in good.values()}) == 1 and good["two.pdb"].identifier == "1CRN" and good["by-content.txt"].format == "pdb"
    assert {k: r.reason for k, r in named(found["errors"]).items()} == REASONS
    for name in ("atoms", "residues", "chains", "bonds"):
        assert {r.file.rsplit("/", 1)[1] for r in found[name].select("file").distinct().collect()} == set(good)
    assert found["chains"].where("sequence = 'TT'").count() == 3


def test_nothing_to_load(spark):
    empty = spark.createDataFrame([("a/x.pdb", ""), ("a/y.cif", None)], "file string, value string")
    assert {r.reason for r in loader.load(empty)["errors"].collect()} == {"empty file"}
    found = loader.load(spark.createDataFrame([], "file string, value string"))
    assert {name: table.count() for name, table in found.items()} == dict.fromkeys(loader.TABLES, 0)


def test_landing_twice_loads_once(spark, tmp_path):
    source, target, checkpoint = tmp_path / "in", fresh_path(spark, "structure-tables"), fresh_path(spark, "loader-checkpoint")
    folder_of_files(source)
    assert loader.land(spark, str(source), target, checkpoint) == 1
    first = {n: t.count() for n, t in loader.tables(spark, target).items()}
    assert loader.land(spark, str(source), target, checkpoint) == 0
    (source / "later.pdb").write_text(samples.pdb_text())
    assert loader.land(spark, str(source), target, checkpoint) == 1
    tables = loader.tables(spark, target)
    assert tables["structures"].count() == first["structures"] + 1 == 9 and tables["errors"].count() == first["errors"]
    assert tables["atoms"].count() == first["atoms"] + 10 and tables["structures"].groupBy("file").count().where(F.col("count") > 1).count() == 0
