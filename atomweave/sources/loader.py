"""From a folder of structure files, in whatever format, to tables; once, or as files land.

Each file goes to its reader by :mod:`routing`; both readers end in the same raw atom rows, and everything after is
one plan for all files.  A file that gives no atoms has a row in ``structures`` that says why, and in ``errors``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry, selection
from ..operators import assemble, neighbours
from ..session import stage
from . import cif, pdb, routing

KEY = ["file"]
RAW = ["file", "line_no", "is_hetatm", "padded_name", "name", "alt_loc", "res_name", "chain_id", "res_seq", "ins_code", "x", "y", "z",
       "occupancy", "b_factor", "symbol", "break_before", "is_valid", "element"]
HEADER = ["file", "identifier", "title", "method", "resolution", "is_prediction", "num_models"]
TABLES = ("structures", "atoms", "residues", "chains", "bonds", "errors")
#: Items a file's atom rows need.
COORDINATES = ("cartn_x", "cartn_y", "cartn_z")


def routed(texts: DataFrame) -> DataFrame:
    """``file``, ``value`` and ``format`` (mmcif, pdb or unknown)."""
    return texts.select("file", "value", routing.file_format(F.col("file"), F.coalesce("value", F.lit(""))).alias("format"))


def _why_no_atoms(rows: DataFrame) -> DataFrame:
    """Tag/value files without an atom_site category, or whose atoms lack a coordinate item."""
    site = F.col("category") == "atom_site"
    complete = site
    for name in COORDINATES:
        complete = complete & F.map_contains_key("items", F.lit(name))
    found = rows.groupBy("file").agg(F.bool_or(site).alias("_site"), F.bool_or(complete).alias("_complete"))
    return found.select("file", F.when(~F.col("_site"), "no atom_site").when(~F.col("_complete"), "coordinate columns missing").alias("_why"))


def reports(texts: DataFrame, raw: DataFrame, categories: DataFrame) -> DataFrame:
    """``file``, ``format``, atoms kept, discarded and malformed, ``success`` and ``reason`` of every file, without or with rows."""
    flagged = chemistry.with_flags(chemistry.with_residue_class(raw))
    counted = pdb.load_report(texts.select("file"), flagged, selection.load_filter(), KEY)
    formats = texts.select("file", "format", F.coalesce(F.length("value"), F.lit(0)).alias("_size"))
    why = (F.when(F.col("success"), "").when(F.col("_size") == 0, "empty file").when(F.col("format") == "unknown", "unknown format")
           .otherwise(F.coalesce("_why", F.when(F.col("format") == "mmcif", F.when(F.col("_known").isNull(), "no atom_site")), F.col("reason"))))
    known = _why_no_atoms(categories).withColumn("_known", F.lit(True))
    return counted.join(formats, "file").join(known, "file", "left").select(
        "file", "format", "num_kept", "num_discarded", "num_malformed", "success", why.alias("reason"))


def load(texts: DataFrame, bond: bool = True) -> dict[str, DataFrame]:
    """``structures``, ``atoms``, ``residues`` (with secondary structure from the file), ``chains``, ``bonds`` and ``errors`` of files
    ``(file, value)``; the first model of each, water and further alternate places left out.

    Null and empty texts are files without atoms; an empty table gives empty tables.
    """
    files = stage(routed(texts), "routed-files")
    lines = pdb.split_lines(files.where("format = 'pdb' AND value IS NOT NULL"))
    categories = stage(cif.category_rows(files.where("format = 'mmcif'"), categories=cif.CATEGORIES), "categories")
    sites = pdb.with_elements(cif.atom_sites(categories)).where("model_no = 1 OR NOT is_valid")
    raw = stage(pdb.raw_atoms(lines).select(*RAW).unionByName(sites.select(*RAW)), "raw-atoms")
    kept = chemistry.enrich(raw.where("is_valid")).where(selection.load_filter())
    atoms = stage(assemble.number_runs(kept, KEY), "atoms")
    ranges = pdb.secondary_ranges(lines).unionByName(cif.secondary_ranges(categories))
    residues = stage(assemble.apply_ranges(assemble.residue_table(atoms, KEY), ranges, KEY), "residues")
    chains = assemble.chain_table(residues, KEY).join(assemble.chain_sequences(residues, KEY), [*KEY, "chain_idx"], "left")
    bonds = neighbours.bonds(neighbours.without_lone_ions(atoms, KEY), KEY)
    bonds = stage(bonds, "bonds") if bond else bonds.limit(0)
    headers = pdb.headers(lines).select(*HEADER).unionByName(cif.metadata(categories).select(*HEADER))
    report = stage(reports(files, raw, categories), "reports")
    structures = (report.join(headers, "file", "left").join(assemble.structure_summary(atoms, bonds, KEY), "file", "left"))
    return {"structures": structures, "atoms": atoms, "residues": residues, "chains": chains, "bonds": bonds,
            "errors": report.where("NOT success").select("file", "format", "reason")}


def load_folder(spark: SparkSession, paths: str | list[str]) -> dict[str, DataFrame]:
    """:func:`load` of all files of a folder.  Files of no bytes have no row: Spark's readers pass over them."""
    return load(cif.read_texts(spark, paths))


def land(spark: SparkSession, folder: str, target: str, checkpoint: str) -> int:
    """Load the files of ``folder`` that have not been loaded yet, and append them to the tables below ``target``.

    The files come from a file stream, so each is taken once, whatever fails in between: a batch writes its own
    ``batch=<number>`` folder of every table and overwrites it when it is repeated.  Empty files give no row.  Returns
    the number of batches run.
    """
    texts = (spark.readStream.schema("value string").text(folder, wholetext=True)
             .select(F.col("_metadata.file_path").alias("file"), "value"))
    done = []

    def save(batch: DataFrame, number: int) -> None:
        for name, table in load(batch).items():
            table.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        done.append(number)

    query = texts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    """The tables that :func:`land` has written."""
    return {name: spark.read.parquet(f"{target}/{name}").drop("batch") for name in TABLES}
