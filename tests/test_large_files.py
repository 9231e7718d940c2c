"""Tag/value files in blocks: whatever the cuts, the rows are those of the reader that sees whole files."""

import random

import pytest
from pyspark.sql import functions as F

from atomweave.sources import cif, cif_blocks

ATOMS = "loop_\n_atom_site.group_PDB\n_atom_site.id\n_atom_site.label_atom_id\n_atom_site.Cartn_x\n"


def value(rng):
    return rng.choice(["1", "C", "?", ".", "-0.5", "'a b'", '"O5\'"', "'it''s'", "'spans\nlines'", "\n;text\nfield _x.y\nloop_\n;\n", "\n; one\n;",
                       '"', "'", "x'y", "data_inner", "a;b", "é", "'loop_'", "\n;;\n;\n", "# note\n7", "1_2", "_"])


def random_file(rng):
    """A file with all that a lexer and a reader can be in the middle of."""
    parts = []
    for _ in range(rng.randrange(1, 7)):
        kind = rng.randrange(7)
        if kind < 2:
            parts.append(f"_{rng.choice(['entry', 'struct', 'cell'])}.{rng.choice(['id', 'title', 'a'])} {value(rng)}\n")
        elif kind == 2:
            parts.append(ATOMS + "".join(f"ATOM {i} C{i} {i}.5\n" for i in range(rng.randrange(12))))
        elif kind < 5:
            tags = rng.sample(["a", "b", "c", "d"], rng.randrange(1, 4))
            category = rng.choice(["alpha", "beta", "atom_site"])
            cells = " ".join(value(rng) + ("\n" if rng.random() < 0.4 else "") for _ in range(rng.randrange(14)))
            parts.append("loop_\n" + "".join(f"_{category}.{t}{rng.choice([' ', chr(10)])}" for t in tags) + cells + "\n")
        elif kind == 5:
            parts.append(rng.choice(["data_x\n", "# comment 'open\n", "stray values 'here'\n", "_entry.id _entry.name\n", "_entry.id loop_\n", "stop_\n", "\n\n"]))
        else:
            parts.append("_alpha.a 'single value'\nloop_\n_beta.b _beta.b\n1 2 3 4\n")
    return "".join(parts)[:rng.choice([None, None, None, -1, -3])]


def files_and_blocks(count, seed):
    rng = random.Random(seed)
    files, blocks = [], []
    for i in range(count):
        text = random_file(rng)
        lines = text.split("\n")
        cuts = sorted(rng.sample(range(1, len(lines)), min(len(lines) - 1, rng.randrange(8)))) if rng.random() < 0.7 else list(range(1, len(lines)))
        files.append((i, text))
        for a, b in zip([0, *cuts], [*cuts, len(lines)], strict=True):
            blocks.append((i, 10 * a, "\n".join(lines[a:b])))
    rng.shuffle(blocks)
    return files, blocks


@pytest.mark.parametrize("categories", [None, ("atom_site", "alpha", "entry")])
def test_any_cut_gives_the_same_rows(spark, categories):
    files, blocks = files_and_blocks(400, 11 if categories else 12)
    texts = spark.createDataFrame(files, "file long, value string")
    cut = spark.createDataFrame(blocks, "file long, block long, text string").repartition(6)
    rows = lambda df: sorted((r.file, r.ordinal, r.category, r.row, sorted(r["items"].items())) for r in df.collect())
    want = rows(cif.category_rows(texts, ["file"], categories=categories))
    got = rows(cif_blocks.category_rows(cut, ["file"], categories=categories))
    texts_of = dict(files)
    for file in range(len(files)):
        mine, theirs = [r for r in got if r[0] == file], [r for r in want if r[0] == file]
        assert mine == theirs, (texts_of[file], [b for b in blocks if b[0] == file])


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    lines = "".join(f"ATOM {i} 'C {i}' {i}.25\n" for i in range(20_000))
    text = f"data_one\n_entry.id E1\n{ATOMS}{lines}loop_\n_note.id\n_note.text\n1\n;" + "long text\n" * 3000 + ";\n_struct.title 'late'\n"
    path = tmp_path / "one.cif"
    path.write_text(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        blocks = cif_blocks.file_blocks(spark, str(path))
        sizes = blocks.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.length("text")).alias("n")).collect()
        assert len(sizes) > 20 and max(r.n for r in sizes) < 60_000
        rows = lambda df: sorted((r.ordinal, r.category, r.row, sorted(r["items"].items())) for r in df.collect())
        want = rows(cif.category_rows(cif.read_texts(spark, str(path))))
        assert rows(cif_blocks.category_rows(blocks)) == want and len(want) == 20_003
        sites = cif.atom_sites(cif_blocks.read(spark, str(path), large=1000, categories=["atom_site"]))
        assert sites.count() == 20_000 and sites.where("x = line_no + 0.25 AND chain_id = ''").count() == 20_000
    finally:
        for key, old in before.items():
            spark.conf.set(key, old)


def test_small_and_large_files_together(spark, tmp_path):
    rng = random.Random(2)
    for i in range(12):
        (tmp_path / f"f{i}.cif").write_text(random_file(rng) + (f"loop_\n_alpha.a\n{'value ' * 400}\n" if i % 3 == 0 else ""))
    rows = lambda df: sorted((r.file, r.ordinal, r.category, r.row, sorted(r["items"].items())) for r in df.collect())
    want = rows(cif.category_rows(cif.read_texts(spark, str(tmp_path))))
    assert rows(cif_blocks.read(spark, str(tmp_path), large=1000)) == want
    assert rows(cif_blocks.read(spark, str(tmp_path))) == want
