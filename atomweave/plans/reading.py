"""Queries of section A: sources, reference tables, reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry, identifiers, tables
from ..operators import assemble
from ..functions.selection import load_filter
from ..session import fresh_path, stage
from ..sources import cif, cif_blocks, dcd, loader, manifest, pdb, routing
from . import fixtures as fx
from .registry import q, query, r

FILE = ["file"]

# element of the rendered lines: every fifth has an empty element column and is guessed from the name
PDB_ELEMENT = "CASE WHEN atom_idx % 5 = 0 AND name = 'ZN' AND NOT is_hetatm THEN 0 ELSE element END"
PDB_AT = "100 + 5 * CAST(atom_idx AS BIGINT)"


@query("a1_pdb_atom_scan", f"""
    SELECT structure_id AS file, {PDB_AT} + 4 AS line_no, is_hetatm, name, alt_loc, res_name, chain_id,
      res_seq % 10000 AS res_seq, ins_code, x, y, z, {q('occupancy', 2)} AS occupancy, b_factor, {PDB_ELEMENT} AS element
    FROM atoms""", "atoms")
def pdb_atom_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = pdb.with_elements(pdb.scan_atoms(fx.pdb_lines(spark, sf)))
    return found.where("is_valid").select(
        "file", "line_no", "is_hetatm", "name", "alt_loc", "res_name", "chain_id", "res_seq", "ins_code", "x", "y", "z",
        r("occupancy", 2).alias("occupancy"), "b_factor", "element")


@query("a2_pdb_model_filter", f"""
    SELECT structure_id AS file, {PDB_AT} + 4 AS line_no, CAST(floor(atom_idx / 300) AS INTEGER) + 1 AS model_no,
      atom_idx < 300 AS in_first_model FROM atoms""", "atoms")
def pdb_model_filter(spark: SparkSession, sf: str) -> DataFrame:
    return pdb.with_model(fx.pdb_lines(spark, sf)).where(pdb.is_atom_line()).select(
        "file", "line_no", "model_no", (F.col("model_no") == 1).alias("in_first_model"))


@query("a3_pdb_chain_breaks", f"""
    SELECT structure_id AS file, {PDB_AT} + 4 AS line_no, break_before OR atom_idx = 0 AS break_before
    FROM atoms WHERE atom_idx < 300""", "atoms")
def pdb_chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    return pdb.with_breaks(pdb.with_model(fx.pdb_lines(spark, sf))).select("file", "line_no", "break_before")


@query("a4_pdb_header", """
    SELECT s_suppkey AS file, lpad(CAST(s_suppkey % 10000 AS VARCHAR), 4, '0') AS identifier,
      s_name || ' NATION ' || CAST(s_nationkey AS VARCHAR) AS title, 'X-RAY DIFFRACTION' AS method,
      CASE WHEN s_suppkey % 40 > 0 THEN (s_suppkey % 40) / 10.0::DOUBLE END AS resolution,
      s_suppkey % 7 = 0 AS is_prediction,
      CAST(greatest(1, coalesce(m, 1)) AS BIGINT) AS num_models
    FROM supplier LEFT JOIN (SELECT structure_id, CAST(floor(max(atom_idx) / 300) AS INTEGER) + 1 AS m FROM atoms
                             GROUP BY structure_id) ON structure_id = s_suppkey""", "atoms")
def pdb_header(spark: SparkSession, sf: str) -> DataFrame:
    return pdb.headers(fx.pdb_lines(spark, sf)).withColumn("num_models", F.col("num_models").cast("long"))


@query("a5_pdb_ranges", """
    SELECT s_suppkey AS file, CAST(o AS BIGINT) AS ordinal, CASE o WHEN 6 THEN 'Helix' ELSE 'Sheet' END AS kind,
      chr(65 + s_nationkey % 4) AS chain_id, CASE o WHEN 6 THEN 7 ELSE s_nationkey END AS first_seq,
      CASE o WHEN 6 THEN 19 + s_nationkey ELSE 40 END AS last_seq
    FROM supplier CROSS JOIN (VALUES (6), (7)) AS v(o)""")
def pdb_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return pdb.secondary_ranges(fx.pdb_lines(spark, sf))


# what the rendered tag/value texts contain, written down from the atoms
CIF_NAME = "CASE WHEN atom_idx % 3 = 0 THEN name || '''' ELSE name END"
CIF_CELLS = {
    "group_pdb": "CASE WHEN is_hetatm THEN 'HETATM' ELSE 'ATOM' END", "id": "CAST(atom_idx AS VARCHAR)",
    "type_symbol": "CASE WHEN atom_idx % 5 = 0 THEN '?' ELSE upper(symbol) END", "label_atom_id": CIF_NAME,
    "label_alt_id": "CASE WHEN alt_loc = ' ' THEN '.' ELSE alt_loc END", "label_comp_id": "res_name",
    "label_asym_id": "chain_id", "label_seq_id": "CAST(res_seq AS VARCHAR)", "pdbx_pdb_ins_code": "'?'",
    "cartn_x": "format('{:.3f}', x)", "cartn_y": "format('{:.3f}', y)",
    "cartn_z": "CASE WHEN atom_idx % 97 = 0 THEN '?' ELSE format('{:.3f}', z) END",
    "occupancy": "format('{:.2f}', occupancy)", "b_iso_or_equiv": "format('{:.2f}', b_factor)",
    "pdbx_pdb_model_num": "CASE WHEN atom_idx % 11 = 0 THEN '2' ELSE '1' END",
}
CIF_FILE = "structure_id || '-' || CAST(floor(atom_idx / 256) AS BIGINT)"
CIF_PLACE = f"{CIF_FILE} AS file, CAST(atom_idx % 256 AS BIGINT)"
CIF_FILES = f"SELECT {CIF_FILE} AS file, structure_id, CAST(floor(atom_idx / 256) AS BIGINT) AS block, " \
            "min(atom_idx % 11) AS lowest_mod, count(*) AS n, count_if(atom_idx % 11 = 0 AND atom_idx % 97 <> 0) AS n2 " \
            "FROM atoms GROUP BY ALL"
CIF_SINGLE = """
    SELECT file, 'entry' AS category, 0::BIGINT AS row, 'id' AS item,
      CASE WHEN block = 1 THEN 'AF-' ELSE 'E' END || structure_id AS value FROM files
    UNION ALL SELECT file, 'struct', 0, 'title', 'a title' || chr(10) || 'over lines' FROM files
    UNION ALL SELECT file, 'exptl', 0, 'method', 'X-RAY DIFFRACTION' FROM files
    UNION ALL SELECT file, 'refine', 0, 'ls_d_res_high', (structure_id % 30) || '.5' FROM files
    UNION ALL SELECT file, 'struct_conf', row, item, value FROM files, (VALUES
        (0, 'conf_type_id', 'HELX_P'), (0, 'beg_label_asym_id', 'Q'), (0, 'beg_auth_asym_id', 'A'),
        (0, 'beg_auth_seq_id', '7'), (0, 'end_auth_seq_id', ''),
        (1, 'conf_type_id', 'TURN_P'), (1, 'beg_label_asym_id', 'Q'), (1, 'beg_auth_asym_id', 'B'),
        (1, 'beg_auth_seq_id', '3'), (1, 'end_auth_seq_id', '9'),
        (2, 'conf_type_id', 'OTHER'), (2, 'beg_label_asym_id', 'Q'), (2, 'beg_auth_asym_id', 'A'),
        (2, 'beg_auth_seq_id', '1'), (2, 'end_auth_seq_id', '2')) AS v(row, item, value)
      WHERE value <> ''
    UNION ALL SELECT file, 'struct_conf', 0, 'end_auth_seq_id', CAST(structure_id % 50 + 8 AS VARCHAR) FROM files
    UNION ALL SELECT file, 'struct_sheet_range', 0, item, value FROM files, (VALUES
        ('beg_label_asym_id', 'C'), ('end_label_seq_id', '40')) AS v(item, value)
    UNION ALL SELECT file, 'struct_sheet_range', 0, 'beg_label_seq_id', CAST(block AS VARCHAR) FROM files"""


@query("a6_cif_category_cells",
       " UNION ALL ".join(f"SELECT {CIF_PLACE} AS row, 'atom_site' AS category, '{item}' AS item, {text} AS value FROM enriched"
                          for item, text in CIF_CELLS.items())
       + " UNION ALL SELECT file, row, category, item, value FROM singles",
       "enriched", extra={"files": CIF_FILES, "singles": CIF_SINGLE})
def cif_category_cells(spark: SparkSession, sf: str) -> DataFrame:
    return cif.cells(cif.category_rows(fx.cif_texts(spark, sf), FILE), FILE)


CIF_ELEMENT = """CASE WHEN atom_idx % 5 <> 0 THEN element WHEN is_hetatm THEN
    CASE name WHEN 'CA' THEN 20 WHEN 'SG' THEN 106 WHEN 'ZN' THEN 30 ELSE element END
    ELSE CASE name WHEN 'ZN' THEN 0 ELSE element END END"""


@query("a7_cif_atom_site", f"""
    SELECT {CIF_PLACE} AS line_no, is_hetatm, {CIF_NAME} AS name, alt_loc, res_name, chain_id, res_seq, ins_code,
      x, y, z, {q('occupancy', 2)} AS occupancy, b_factor, CAST({CIF_ELEMENT} AS INTEGER) AS element
    FROM enriched WHERE atom_idx % 97 <> 0 AND atom_idx % 11 <> 0""", "enriched")
def cif_atom_site(spark: SparkSession, sf: str) -> DataFrame:
    rows = cif.category_rows(fx.cif_texts(spark, sf), FILE, categories=["atom_site"])
    found = pdb.with_elements(cif.atom_sites(rows, FILE).where("is_valid AND model_no = 1"))
    return found.select("file", "line_no", "is_hetatm", "name", "alt_loc", "res_name", "chain_id", "res_seq", "ins_code",
                        "x", "y", "z", r("occupancy", 2).alias("occupancy"), "b_factor", "element")


def read_in_blocks(spark: SparkSession, sf: str, categories: list[str], items: dict[str, tuple] | None = None) -> DataFrame:
    """Category rows of one file a structure, each lexed by as many tasks as it has blocks."""
    blocks = stage(fx.cif_blocks(spark, sf), "cif-blocks").withColumnRenamed("structure_id", "file")
    return cif_blocks.category_rows(blocks, FILE, categories, items)


@query("a7_atom_site_in_blocks", f"""
    SELECT CAST(structure_id AS BIGINT) AS file, CAST(atom_idx AS BIGINT) AS line_no, is_hetatm, {CIF_NAME} AS name, alt_loc, res_name,
      chain_id, res_seq, ins_code, x, y, z, {q('occupancy', 2)} AS occupancy, b_factor, CAST({CIF_ELEMENT} AS INTEGER) AS element
    FROM enriched WHERE atom_idx % 97 <> 0 AND atom_idx % 11 <> 0""", "enriched")
def atom_site_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_in_blocks(spark, sf, ["atom_site"])
    found = pdb.with_elements(cif.atom_sites(rows, FILE).where("is_valid AND model_no = 1"))
    return found.select(F.col("file").cast("long").alias("file"), "line_no", "is_hetatm", "name", "alt_loc", "res_name", "chain_id",
                        "res_seq", "ins_code", "x", "y", "z", r("occupancy", 2).alias("occupancy"), "b_factor", "element")


@query("a8_metadata_in_blocks", """
    SELECT CAST(structure_id AS BIGINT) AS file, 'AF-' || structure_id AS identifier, 'a title' || chr(10) || 'over lines' AS title,
      'X-RAY DIFFRACTION' AS method, CAST((structure_id % 30) || '.5' AS DOUBLE) AS resolution, TRUE AS is_prediction,
      CAST(2 AS BIGINT) AS num_models FROM atoms GROUP BY structure_id""", "atoms")
def metadata_in_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = cif.metadata(read_in_blocks(spark, sf, list(cif.CATEGORIES), cif.METADATA_ITEMS), FILE)
    return found.withColumns({"file": F.col("file").cast("long"), "num_models": F.col("num_models").cast("long")})


@query("a8_cif_metadata", """
    SELECT file, CASE WHEN block = 1 THEN 'AF-' ELSE 'E' END || structure_id AS identifier,
      'a title' || chr(10) || 'over lines' AS title, 'X-RAY DIFFRACTION' AS method,
      CAST((structure_id % 30) || '.5' AS DOUBLE) AS resolution, block = 1 AS is_prediction,
      CAST(CASE WHEN n2 > 0 THEN 2 ELSE 1 END AS BIGINT) AS num_models FROM files""",
       "atoms", extra={"files": CIF_FILES.replace(" AND atom_idx % 97 <> 0", "")})
def cif_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = cif.category_rows(fx.cif_texts(spark, sf), FILE, categories=cif.CATEGORIES, items=cif.METADATA_ITEMS)
    return cif.metadata(rows, FILE).withColumn("num_models", F.col("num_models").cast("long"))


@query("a9_cif_ranges", """
    SELECT file, 'Helix' AS kind, 'A' AS chain_id, 7 AS first_seq, CAST(structure_id % 50 + 8 AS INTEGER) AS last_seq FROM files
    UNION ALL SELECT file, 'Turn', 'B', 3, 9 FROM files
    UNION ALL SELECT file, 'Sheet', 'C', CAST(block AS INTEGER), 40 FROM files""", "atoms", extra={"files": CIF_FILES})
def cif_ranges(spark: SparkSession, sf: str) -> DataFrame:
    rows = cif.category_rows(fx.cif_texts(spark, sf), FILE, categories=["struct_conf", "struct_sheet_range"])
    return cif.secondary_ranges(rows, FILE).drop("ordinal")


ROUTED = """
    SELECT doc_id, 'a/b.c/' || doc_id || CASE doc_id % 7 WHEN 0 THEN '.cif' WHEN 1 THEN '.PDB' WHEN 2 THEN '.ent'
             WHEN 3 THEN '.bcif' WHEN 4 THEN '.txt' ELSE '' END AS path,
      CASE doc_id % 6 WHEN 0 THEN 'DATA_x ' || text WHEN 1 THEN text || chr(10) || 'HETATM 1'
           WHEN 2 THEN 'Header ' || text WHEN 3 THEN text || ' loop_ ' ELSE text END AS content
    FROM documents"""


@query("a10_format_routing", """
    SELECT doc_id, CASE WHEN ext IN ('cif', 'mmcif', 'bcif') THEN 'mmcif' WHEN ext IN ('pdb', 'ent') THEN 'pdb'
        WHEN contains(head, '_atom_site.') OR contains(head, 'loop_') OR starts_with(head, 'data_') THEN 'mmcif'
        WHEN contains(head, chr(10) || 'atom  ') OR starts_with(head, 'atom  ') OR contains(head, chr(10) || 'hetatm')
          OR starts_with(head, 'hetatm') OR starts_with(head, 'header') THEN 'pdb' ELSE 'unknown' END AS format
    FROM (SELECT doc_id, CASE WHEN doc_id % 7 < 5 THEN lower(string_split(path, '.')[-1]) ELSE '' END AS ext,
                 lower(content) AS head FROM routed)""", extra={"routed": ROUTED})
def format_routing(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "concat('a/b.c/', doc_id, CASE doc_id % 7 WHEN 0 THEN '.cif' WHEN 1 THEN '.PDB' WHEN 2 THEN '.ent' "
        "WHEN 3 THEN '.bcif' WHEN 4 THEN '.txt' ELSE '' END) AS path",
        "CASE doc_id % 6 WHEN 0 THEN concat('DATA_x ', text) WHEN 1 THEN concat(text, '\\n', 'HETATM 1') "
        "WHEN 2 THEN concat('Header ', text) WHEN 3 THEN concat(text, ' loop_ ') ELSE text END AS content")
    return files.select("doc_id", routing.file_format(F.col("path"), F.col("content")).alias("format"))


FILE_FRAMES = 4096


def landed_trajectories(spark: SparkSession, sf: str) -> str:
    """Write the frame view as trajectory files of at most 4096 frames into the shared folder.

    Files are written by the tasks that hold the frames, through ``pyarrow.fs``.
    """
    target = fresh_path(spark, "trajectories")
    frames = fx.frames(spark, sf).withColumn("part", F.floor(F.col("frame") / FILE_FRAMES))
    encode_header, encode_frames = dcd.encode_header, dcd.encode_frames

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs as pafs
        traj, part = int(pdf["traj_id"].iloc[0]), int(pdf["part"].iloc[0])
        pdf = pdf.sort_values(["frame", "atom_idx"])
        first, last = int(pdf["frame"].min()), int(pdf["frame"].max())
        short = len(pdf) % 20
        whole = pdf.iloc[:len(pdf) - short]
        xyz = whole[["x", "y", "z"]].to_numpy().reshape(-1, 20, 3)
        cells = np.array([[60.0 + f, 70.0 + f, 80.0 + f] for f in range(first, first + len(xyz))]).reshape(-1, 3)
        order = ">" if traj % 2 else "<"
        data = encode_header(20, last - first + 1, 0.002, True, order) + encode_frames(xyz, cells, order)
        if short:  # an interrupted copy: the last frame breaks off
            data += encode_frames(np.zeros((1, 20, 3)), np.zeros((1, 3)), order)[:100]
        if traj % 10 == 9:
            data = data[:4] + b"VELD" + data[8:]
        system, base = pafs.FileSystem.from_uri(target) if "://" in target or target.startswith("file:") else (
            pafs.LocalFileSystem(), target)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{traj}-{part}.dcd") as out:
            out.write(data)
        return pd.DataFrame({"files": [1]})

    frames.groupBy("traj_id", "part").applyInPandas(write, "files int").agg(F.sum("files")).collect()
    return target


def open_trajectories(spark: SparkSession, sf: str, table: str, good_only: bool = True, **options) -> DataFrame:
    dcd.register(spark)
    folder = landed_trajectories(spark, sf)
    reader = spark.read.format("dcd").option("table", table)
    for name, value in options.items():
        reader = reader.option(name, value)
    if good_only:
        reader = reader.option("skipBad", "true")
    return numbered(reader.load(folder))


def numbered(files: DataFrame) -> DataFrame:
    """``traj_id`` and ``part`` in place of ``path``."""
    name = F.regexp_extract("path", r"(\d+)-(\d+)\.dcd$", 1).cast("long")
    part = F.regexp_extract("path", r"(\d+)-(\d+)\.dcd$", 2).cast("long")
    return files.withColumn("traj_id", name).withColumn("part", part).drop("path")


@query("a11_dcd_frames", """
    SELECT traj_id, CAST(frame // 4096 AS BIGINT) AS part, CAST(frame % 4096 AS BIGINT) AS frame,
      CAST(atom_idx AS BIGINT) AS atom_idx, x, y, z
    FROM whole WHERE traj_id % 10 <> 9""", "whole")
def dcd_frames(spark: SparkSession, sf: str) -> DataFrame:
    return open_trajectories(spark, sf, "frames", splitBytes=65536)


@query("a12_dcd_report", """
    SELECT traj_id, CAST(frame // 4096 AS BIGINT) AS part,
      CASE WHEN traj_id % 10 = 9 OR count(DISTINCT frame) FILTER (WHERE n = 20) = 0 THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN traj_id % 10 = 9 THEN NULL ELSE count(DISTINCT frame) END AS frames_in_file,
      CASE WHEN traj_id % 10 = 9 THEN 0 ELSE count(DISTINCT frame) FILTER (WHERE n = 20) END AS frames_loaded
    FROM (SELECT traj_id, frame, count(*) AS n FROM frames GROUP BY ALL) GROUP BY traj_id, part""", "frames")
def dcd_report(spark: SparkSession, sf: str) -> DataFrame:
    found = dcd.report(spark, landed_trajectories(spark, sf), split_bytes=65536)
    return numbered(found).select("traj_id", "part", "status", "frames_in_file", "frames_loaded")


@query("a13_frame_stride", """
    SELECT traj_id, frame, atom_idx, x, y, z FROM frames WHERE frame % 3 = 0 AND frame // 3 < 5""", "frames")
def frame_stride(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import trajectory
    return trajectory.thin(fx.frames(spark, sf), stride=3, max_frames=5)


@query("a13_stride_in_files", """
    SELECT traj_id, CAST(frame AS BIGINT) AS frame, CAST(atom_idx AS BIGINT) AS atom_idx, x, y, z
    FROM whole WHERE frame % 3 = 0 AND frame // 3 < 5 AND traj_id % 10 <> 9""", "whole")
def stride_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """Stride and limit in the source; a trajectory's first file holds all its wanted frames."""
    found = open_trajectories(spark, sf, "frames", stride=3, maxFrames=5, files="*-0.dcd", splitBytes=65536)
    return found.select("traj_id", "frame", "atom_idx", "x", "y", "z")


@query("t4_lookup_in_files", """
    SELECT traj_id, CAST(frame // 4096 AS BIGINT) AS part, CAST(frame % 4096 AS BIGINT) AS frame, CAST(atom_idx AS BIGINT) AS atom_idx, x, y, z
    FROM whole WHERE frame % 4096 = 7 AND atom_idx = 3 AND traj_id % 10 <> 9""", "whole")
def lookup_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """One atom of one frame of every file, which is one seek a file."""
    found = open_trajectories(spark, sf, "frames", frames="7", atoms="3", splitBytes=65536)
    return found.select("traj_id", "part", "frame", "atom_idx", "x", "y", "z")


@query("a14_element_table", """
    SELECT structure_id, atom_idx, e.symbol, e.vdw_radius, e.covalent_radius, e.mass, e.red, e.green, e.blue
    FROM (SELECT *, CASE WHEN b_factor > 95 THEN 200 ELSE CAST(b_factor AS INTEGER) END AS number FROM atoms) a
    JOIN elements e ON e.atomic_number = CASE WHEN number > 118 THEN 0 ELSE number END""", "atoms", "elements")
def element_table(spark: SparkSession, sf: str) -> DataFrame:
    numbers = fx.atoms(spark, sf).withColumn(
        "number", F.when(F.col("b_factor") > 95, 200).otherwise(F.col("b_factor").cast("int")))
    columns = ("symbol", "vdw_radius", "covalent_radius", "mass", "red", "green", "blue")
    return chemistry.with_elements(numbers, columns, "number").select("structure_id", "atom_idx", *columns)


@query("a15_residue_table", """
    SELECT p_partkey, coalesce(r.residue_class, 'Other') AS residue_class, coalesce(r.letter, 'X') AS letter
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 3) WHEN p_partkey % 3 = 1 THEN
            ['ala', 'HOH', 'DG', 'u', 'TIP3', 'MSE', 'XYZ'][p_size % 7 + 1] ELSE upper(substr(p_type, 1, 2)) END AS name FROM part) p
    LEFT JOIN residues r ON upper(p.name) = r.residue_name""", "residues")
def residue_table(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN substr(p_name, 1, 3) WHEN p_partkey % 3 = 1 THEN "
        "element_at(array('ala', 'HOH', 'DG', 'u', 'TIP3', 'MSE', 'XYZ'), CAST(p_size % 7 + 1 AS INT)) "
        "ELSE upper(substr(p_type, 1, 2)) END AS res_name")
    return chemistry.with_residue_class(names).select("p_partkey", "residue_class", "letter")


@query("a16_prediction_response", """
    SELECT page_id, CASE WHEN page_id % 10 = 9 THEN NULL WHEN page_id % 2 = 0 THEN url || '.pdb' ELSE url || '.cif' END AS file_url
    FROM pages""")
def prediction_response(spark: SparkSession, sf: str) -> DataFrame:
    bodies = fx.table(spark, sf, "pages").selectExpr(
        "page_id", "CASE WHEN page_id % 10 = 9 THEN '[]' ELSE to_json(array(named_struct("
        "'cifUrl', CASE WHEN page_id % 2 = 0 THEN '' ELSE concat(url, '.cif') END, 'pdbUrl', concat(url, '.pdb')), "
        "named_struct('cifUrl', 'second', 'pdbUrl', 'second'))) END AS body")
    return bodies.select("page_id", identifiers.prediction_file_url(F.col("body")).alias("file_url"))


INVENTORY_NOW = "2000-01-01 00:00:00"


@query("a17_landed_inventory", f"""
    SELECT count(*) AS num_files, count_if(length > 0 AND TIMESTAMP '{INVENTORY_NOW}' - modified < INTERVAL 1200 DAY) AS num_fresh,
      CAST(sum(length) AS BIGINT) AS total_bytes FROM landed""", "landed")
def landed_inventory(spark: SparkSession, sf: str) -> DataFrame:
    files = manifest.with_freshness(fx.landed(spark, sf), F.lit(INVENTORY_NOW).cast("timestamp"), 1200)
    return manifest.inventory(files)


@query("a18_load_report", f"""
    SELECT file, count_if(valid AND kept) AS num_kept, count_if(valid AND NOT kept) AS num_discarded,
      count_if(NOT valid) AS num_malformed, count_if(valid AND kept) > 0 AS success,
      CASE WHEN count_if(valid AND kept) > 0 THEN '' ELSE 'no atom left after load options' END AS reason
    FROM (SELECT {CIF_FILE} AS file, atom_idx % 97 <> 0 AS valid, NOT is_water AND NOT is_secondary_altloc AS kept
          FROM enriched WHERE atom_idx % 11 <> 0 OR atom_idx % 97 = 0) GROUP BY file""", "enriched")
def load_report(spark: SparkSession, sf: str) -> DataFrame:
    texts = fx.cif_texts(spark, sf)
    atoms = cif.atom_sites(cif.category_rows(texts, FILE, categories=["atom_site"]), FILE)
    atoms = atoms.where("model_no = 1 OR NOT is_valid")
    flagged = chemistry.with_flags(chemistry.with_residue_class(atoms))
    return pdb.load_report(texts, flagged, load_filter(), FILE)


@query("a10_mixed_load", f"""
    SELECT file || CASE block % 4 WHEN 2 THEN '.cif' WHEN 3 THEN '.txt' ELSE '' END AS file,
      CASE WHEN block % 4 = 3 THEN 'unknown' ELSE 'mmcif' END AS format, num_kept, num_kept > 0 AS success,
      CASE WHEN block % 4 = 2 THEN 'coordinate columns missing' WHEN block % 4 = 3 THEN 'unknown format'
           WHEN num_kept = 0 THEN 'no atom left after load options' ELSE '' END AS reason,
      CASE WHEN num_kept > 0 THEN num_kept END AS num_atoms, CASE WHEN block % 4 <> 3 THEN structure_id % 30 + 0.5::DOUBLE END AS resolution
    FROM (SELECT {CIF_FILE} AS file, structure_id, CAST(floor(atom_idx / 256) AS BIGINT) AS block,
            CASE WHEN any_value(floor(atom_idx / 256)) % 4 >= 2 THEN 0 ELSE
              count_if(atom_idx % 11 <> 0 AND atom_idx % 97 <> 0 AND NOT is_water AND NOT is_secondary_altloc) END AS num_kept
          FROM enriched GROUP BY ALL)""", "enriched")
def mixed_load(spark: SparkSession, sf: str) -> DataFrame:
    """Files of several kinds through one loader: by content, with a missing column, and foreign ones."""
    block = F.col("block") % 4
    texts = fx.cif_texts(spark, sf).select(
        F.concat("file", F.when(block == 2, ".cif").when(block == 3, ".txt").otherwise("")).alias("file"),
        F.when(block == 2, F.replace("value", F.lit("_atom_site.Cartn_z"), F.lit("_atom_site.height")))
         .when(block == 3, F.lit("a note about a structure")).otherwise(F.col("value")).alias("value"))
    found = loader.load(texts, bond=False)["structures"]
    return found.select("file", "format", "num_kept", "success", "reason", "num_atoms", "resolution")
