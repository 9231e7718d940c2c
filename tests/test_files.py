"""Both structure formats: exact values of a small fragment, and edge cases of each."""

import random

import compare
import pytest
import samples
from pyspark.sql import functions as F

from atomweave.functions import chemistry, selection as sel
from atomweave.operators import assemble, measures, neighbours
from atomweave.plans import catalogue, reading
from atomweave.sources import cif, manifest, pdb, routing


def lines_of(spark, text, file="f"):
    return pdb.split_lines(spark.createDataFrame([(file, text)], "file string, value string"))


def load_pdb(spark, text):
    return chemistry.enrich(pdb.raw_atoms(lines_of(spark, text)).where("is_valid"))


def load_cif(spark, text):
    rows = cif.category_rows(spark.createDataFrame([("f", text)], "file string, value string"))
    return chemistry.enrich(pdb.with_elements(cif.atom_sites(rows).where("is_valid AND model_no = 1")))


@pytest.mark.parametrize("load,text", [(load_pdb, samples.pdb_text()), (load_cif, samples.cif_text())], ids=["pdb", "cif"])
def test_fragment(spark, load, text):
    atoms = load(spark, text)
    numbered = assemble.number_runs(atoms, ["file"])
    rows = numbered.orderBy("atom_idx").collect()
    assert [r.element for r in rows] == [7, 6, 6, 8, 6, 8, 6, 7, 6, 30, 8]
    assert (rows[0].x, rows[0].y, rows[0].z, rows[0].b_factor) == (17.047, 14.099, 3.625, 13.79)
    residues = assemble.residue_table(numbered, ["file"])
    chains = assemble.chain_table(residues, ["file"]).orderBy("chain_idx").collect()
    assert residues.count() == 4 and [(c.chain_id, c.kind) for c in chains] == [("A", "Protein"), ("B", "Ligand")]
    assert assemble.chain_sequences(residues, ["file"]).where("chain_idx = 0").first().sequence == "TT"
    bonds = {(b.atom_a, b.atom_b) for b in neighbours.bonds(neighbours.without_lone_ions(numbered, ["file"]), ["file"]).collect()}
    assert {(0, 1), (1, 2), (2, 3), (1, 4), (2, 7)} <= bonds and (0, 3) not in bonds
    assert not any(9 in pair for pair in bonds)
    assert atoms.where(sel.load_filter()).count() == 10


def test_formats_agree(spark):
    both = [assemble.number_runs(load(spark, text), ["file"]) for load, text in
            ((load_pdb, samples.pdb_text()), (load_cif, samples.cif_text()))]
    status = measures.reconcile(*both, keys=["file"]).groupBy("status").count().collect()
    assert [(s.status, s["count"]) for s in status] == [("equal", 11)]


def test_pdb_header_and_ranges(spark):
    lines = lines_of(spark, samples.pdb_text())
    head = pdb.headers(lines).first()
    assert (head.identifier, head.title, head.method, head.resolution) == (
        "1CRN", "WATER STRUCTURE OF CRAMBIN", "X-RAY DIFFRACTION", 1.5)
    assert not head.is_prediction and head.num_models == 1
    found = [(r.kind, r.chain_id, r.first_seq, r.last_seq) for r in pdb.secondary_ranges(lines).orderBy("ordinal").collect()]
    assert found == [("Helix", "A", 7, 19), ("Sheet", "A", 1, 4)]


def test_models_and_breaks_across_blocks(spark):
    atom = samples.pdb_line(1, samples.FRAGMENT[0])
    text = "\n".join([atom, "MODEL        1", atom, atom, "ENDMDL", "MODEL        2", atom, "ENDMDL", atom,
                      "TER     ", "MODEL        1", atom, "TER     ", atom, "TER"])
    lines = lines_of(spark, text)
    for width in (1, 2, 3, 64):
        model = pdb.with_model(lines, width=width)
        numbers = [r.model_no for r in model.where(pdb.is_atom_line()).orderBy("line_no").collect()]
        assert numbers == [1, 1, 1, 2, 3, 1, 1]
    breaks = [r.break_before for r in pdb.with_breaks(pdb.with_model(lines)).orderBy("line_no").collect()]
    assert breaks == [False, True, False, True, True]


def test_short_and_bad_lines(spark):
    good = samples.pdb_line(1, samples.FRAGMENT[0])
    text = "\n".join([good[:54], good[:40], good.replace("17.047", "xx.yyy"), "ATO"])
    rows = pdb.with_elements(pdb.scan_atoms(lines_of(spark, text))).orderBy("line_no").collect()
    assert [r.is_valid for r in rows] == [True, False, False]
    assert (rows[0].occupancy, rows[0].b_factor, rows[0].element) == (1.0, 0.0, 7)
    files = spark.createDataFrame([("f",), ("empty",)], "file string")
    atoms = chemistry.with_flags(chemistry.with_residue_class(pdb.scan_atoms(lines_of(spark, text))))
    report = {r.file: r for r in pdb.load_report(files, atoms, sel.load_filter()).collect()}
    assert (report["f"].num_kept, report["f"].num_malformed, report["f"].success) == (1, 2, True)
    assert not report["empty"].success and report["empty"].reason == "no atom records"


def test_cif_tokens():
    text = ("data_x\n_a.b 'it''s ' \"q'uo\" # comment\n;first\n second\n;\n_c.d 5'-end x'\n;loop\n;\n'open to the end\n")
    assert list(cif.tokens(text)) == [
        ("data_x", False), ("_a.b", False), ("it''s ", True), ("q'uo", True), ("first\n second", True),
        ("_c.d", False), ("5'-end", False), ("x'", False), ("loop", True), ("open to the end\n", True)]
    rows = list(cif.rows_of("loop_ _k.a _k.b 1 2 3 4 5 loop_ _k.a _k.b 6 7 _m.x y _m.z .\nloop_ _atom_site.id 1 loop_ _atom_site.id 2"))
    assert rows == [("k", 0, {"a": "1", "b": "2"}), ("k", 1, {"a": "3", "b": "4"}), ("k", 2, {"a": "6", "b": "7"}),
                    ("atom_site", 0, {"id": "1"}), ("m", 0, {"x": "y", "z": "."})]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "one.cif").write_text(samples.cif_text())
    (tmp_path / "two.pdb").write_text(samples.pdb_text())
    (tmp_path / "three.txt").write_text("\nHETATM something")
    texts = cif.read_texts(spark, str(tmp_path))
    formats = {r.file.rsplit("/", 1)[1]: r.format for r in
               texts.select("file", routing.file_format(F.col("file"), F.col("value")).alias("format")).collect()}
    assert formats == {"one.cif": "mmcif", "two.pdb": "pdb", "three.txt": "pdb"}
    assert pdb.read_lines(spark, str(tmp_path / "two.pdb")).where(pdb.is_atom_line()).count() == 11
    landed = manifest.with_freshness(manifest.landed_files(spark, str(tmp_path)), F.current_timestamp(), 30)
    assert manifest.inventory(landed).first().num_fresh == 3
    old = manifest.with_freshness(landed, F.current_timestamp() + F.expr("INTERVAL 40 DAYS"), 30)
    assert old.where("is_fresh").count() == 0


def test_box_lengths_of_trajectories_over_several_files(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(reading, "FILE_FRAMES", 8)  # the ten frames wanted of a trajectory lie in three files, more follow
    name = "t8_box_lengths"
    assert reading.open_trajectories(spark, sf, "report").agg({"part": "max"}).first()[0] >= 3
    problem, count, *_ = compare.check(spark, sf, name, catalogue.QUERIES[name], catalogue.ORACLE[name], compare.connect(sf))
    assert problem is None and count > 0


def test_tokens_are_those_of_the_pattern():
    rng, parts = random.Random(5), ["'a'", "'a b'", '"b\'"', "'", '"', "''", "#", "a#b", "x'y", "\n;", "\n;\n", ";", "\t", "\r\n", "é", "w", "\x0b", "'a'b'"]
    for _ in range(3000):
        text = rng.choice([" ", "\n", ""]).join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = [(m.group(m.lastgroup), m.lastgroup != "word") for m in cif.TOKEN.finditer(text) if m.lastgroup]
        assert list(cif.tokens(text)) == want, text


def test_lines_are_rendered_once(spark):
    """Columns cut from a rendered line do not render it again."""
    from atomweave.plans import catalogue
    for name in ("a1_pdb_atom_scan", "a2_pdb_model_filter"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert max(line.count("array_position") for line in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["a4_pdb_header", "a5_pdb_ranges"])
def test_rendered_lines_read_the_atoms_once(spark, name):
    """Once for the positions and once for the blocks' sizes."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "l_linenumber" in line for line in plan.splitlines()) == 2


def test_header_of_a_file_without_header_records(spark):
    lines = lines_of(spark, "ATOM  \nEND", "bare").unionByName(lines_of(spark, "TITLE     ONE\nTITLE    2 TWO\nMODEL        3\nATOM  ", "full"))
    found = {r.file: (r.identifier, r.title, r.method, r.resolution, r.is_prediction, r.num_models) for r in pdb.headers(lines).collect()}
    assert found == {"bare": (None, "", None, None, False, 1), "full": (None, "ONE TWO", None, None, False, 3)}


def test_lines_of_one_row_are_taken_whole():
    text = "loop_\n_atom_site.id\n_atom_site.name\n1 a\n2 \"b'\"\n3\n'c d'\n4 #e\n_x\n5 f # g\n6 h\nloop_ _atom_site.id 9\n_m.x y"
    want = [("1", "a"), ("2", "b'"), ("3", "c d")]
    rows = list(cif.rows_of(text))
    assert [(i["id"], i["name"]) for c, _, i in rows if c == "atom_site"] == want
    only = list(cif.rows_of(text, items={"atom_site": ("name",)}))
    assert [i for c, _, i in only if c == "atom_site"] == [{"name": name} for _, name in want]
    stream = cif.Tokens("1 a\n2 \"b'\"\nx 3\n4\n5 6")
    assert list(stream.rows(2)) == [["1", "a"], ["2", "b'"], ["x", "3"]] and next(stream) == ("4", False)
    assert list(stream.rows(2)) == [["5", "6"]] and next(stream, None) is None
