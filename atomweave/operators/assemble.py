"""From raw atom rows to numbered atoms, residues and chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

KEY = ("structure_id",)


def number_runs(atoms: DataFrame, keys: Sequence[str] = KEY, ordinal: str = "line_no",
                width: int = scans.BLOCK, mark_alone: bool = False) -> DataFrame:
    """Add dense ``atom_idx``, ``residue_idx`` and ``chain_idx`` by consecutive runs, and with ``mark_alone`` whether an atom
    ``is_alone`` in its residue.

    A chain is a run of equal ``chain_id`` without a forced ``break_before``; a residue is a run of
    equal sequence number, insertion code and name inside one chain run, so one id may give several
    chains.
    """
    state = F.struct("chain_id", "res_seq", "ins_code", "res_name", "break_before")

    def new_chain(now: Column, before: Column) -> Column:
        return now["break_before"] | (now["chain_id"] != before["chain_id"])

    def new_residue(now: Column, before: Column) -> Column:
        return (new_chain(now, before) | (now["res_seq"] != before["res_seq"])
                | (now["ins_code"] != before["ins_code"]) | (now["res_name"] != before["res_name"]))

    numbered = scans.runs(atoms, keys, ordinal, state,
                          {"chain_idx": new_chain, "residue_idx": new_residue}, index="atom_idx",
                          positions=["residue_idx"] if mark_alone else [], width=width)
    if mark_alone:
        numbered = numbered.withColumn("is_alone", (F.col("residue_idx_pos") == 0) & F.col("residue_idx_end")).drop(
            "residue_idx_pos", "residue_idx_end")
    return numbered.withColumns({c: F.col(c).cast("int") for c in ("atom_idx", "residue_idx", "chain_idx")})


def residue_table(atoms: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per residue with its atom span."""
    return atoms.groupBy(*keys, "residue_idx").agg(
        F.first("chain_idx").alias("chain_idx"), F.first("chain_id").alias("chain_id"),
        F.first("res_name").alias("res_name"), F.first("res_seq").alias("res_seq"),
        F.first("ins_code").alias("ins_code"), F.first("residue_class").alias("residue_class"),
        F.first("letter").alias("letter"),
        F.min("atom_idx").alias("first_atom"), F.count(F.lit(1)).alias("num_atoms"))


def chain_table(residues: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One row per chain with its residue and atom span and its kind."""
    spans = residues.groupBy(*keys, "chain_idx").agg(
        F.first("chain_id").alias("chain_id"),
        F.min("residue_idx").alias("first_residue"), F.count(F.lit(1)).alias("num_residues"),
        F.min("first_atom").alias("first_atom"), F.sum("num_atoms").alias("num_atoms"),
        *[F.count_if(F.col("residue_class") == klass).alias(name) for klass, name in (
            ("AminoAcid", "_amino"), ("DeoxyNucleotide", "_deoxy"), ("Nucleotide", "_ribo"),
            ("Water", "_water"), ("Other", "_other"))])
    return spans.withColumn("kind", chain_kind(*[F.col(c) for c in (
        "_amino", "_deoxy", "_ribo", "_water", "_other")])).drop("_amino", "_deoxy", "_ribo", "_water", "_other")


def chain_kind(amino: Column, deoxy: Column, ribo: Column, water: Column, other: Column) -> Column:
    """Kind by majority of polymer residues; water and ligands only count without any polymer."""
    return (F.when((amino > 0) & (amino >= deoxy) & (amino >= ribo), "Protein")
            .when((deoxy > 0) & (deoxy >= ribo), "Dna")
            .when(ribo > 0, "Rna")
            .when((water > 0) & (other == 0), "Water")
            .when(other > 0, "Ligand")
            .otherwise("Unknown"))


def chain_sequences(residues: DataFrame, keys: Sequence[str] = KEY, chunk: int = 4096) -> DataFrame:
    """One-letter sequence of each chain in residue order.

    Letters are joined in pieces of at most ``chunk`` residues first, then the pieces of a chain.
    """
    pieces = (residues
            .groupBy(*keys, "chain_idx", F.floor(F.col("residue_idx") / chunk).cast("long").alias("piece"))
            .agg(F.sort_array(F.collect_list(F.struct("residue_idx", "letter"))).alias("_letters"))
            .withColumn("_text", F.array_join(F.transform("_letters", lambda e: e["letter"]), "")))
    joined = F.sort_array(F.collect_list(F.struct("piece", "_text")))
    return pieces.groupBy(*keys, "chain_idx").agg(
        F.array_join(F.transform(joined, lambda e: e["_text"]), "").alias("sequence"))


def apply_ranges(residues: DataFrame, ranges: DataFrame, keys: Sequence[str] = KEY,
                 bucket: int = 64) -> DataFrame:
    """Secondary structure of residues from file ranges ``(chain_id, first_seq, last_seq, kind, ordinal)``.

    A range covers every chain run with its id; where ranges overlap the later one wins.  The range
    join is an equi-join on sequence-number buckets, so neither side is broadcast or crossed, and the
    winner is a partial aggregate.
    """
    spans = (ranges.where(F.col("first_seq") <= F.col("last_seq"))
             .withColumn("_bucket", F.explode(F.sequence(
                 F.floor(F.col("first_seq") / bucket), F.floor(F.col("last_seq") / bucket))))
             .select(*keys, "chain_id", "_bucket", "first_seq", "last_seq", "kind", "ordinal"))
    hits = (residues.select(*keys, "residue_idx", "chain_id", "res_seq",
                            F.floor(F.col("res_seq") / bucket).alias("_bucket"))
            .join(spans, [*keys, "chain_id", "_bucket"])
            .where(F.col("res_seq").between(F.col("first_seq"), F.col("last_seq")))
            .groupBy(*keys, "residue_idx").agg(F.max_by("kind", "ordinal").alias("ss")))
    return (residues.drop("ss").join(hits, [*keys, "residue_idx"], "left")
            .withColumn("ss", F.coalesce("ss", F.lit("Coil"))))


def secondary_structure_by_policy(from_file: DataFrame, computed: DataFrame, structures: DataFrame,
                                  keys: Sequence[str] = KEY) -> DataFrame:
    """Residue states chosen per structure.

    ``structures`` has ``policy`` (FromFile, Compute or FromFileElseCompute) and ``has_ranges``.
    """
    use_file = (F.when(F.col("policy") == "FromFile", True)
                .when(F.col("policy") == "Compute", False).otherwise(F.col("has_ranges")))
    return (from_file.select(*keys, "residue_idx", F.col("ss").alias("_file"))
            .join(computed.select(*keys, "residue_idx", F.col("ss").alias("_computed")),
                  [*keys, "residue_idx"], "left")
            .join(structures.select(*keys, use_file.alias("_use")), list(keys))
            .select(*keys, "residue_idx", F.when(F.col("_use"), F.col("_file"))
                    .otherwise(F.coalesce("_computed", F.lit("Coil"))).alias("ss")))


def centre_on_origin(atoms: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Shift each structure so that its bounding-box centre is the origin."""
    bounds = atoms.groupBy(*keys).agg(*[
        ((F.min(a) + F.max(a)) / 2).alias(f"_mid_{a}") for a in "xyz"])
    near = None
    for a in "xyz":
        term = F.abs(F.col(f"_mid_{a}")) <= 1e-4
        near = term if near is None else near & term
    shifted = atoms.join(bounds, list(keys))
    moved = {a: F.when(near, F.col(a)).otherwise(F.col(a) - F.col(f"_mid_{a}")) for a in "xyz"}
    return shifted.withColumns(moved).drop("_mid_x", "_mid_y", "_mid_z")


def structure_summary(atoms: DataFrame, bonds: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Counts of atoms, residues, chains and bonds; the dense numbering makes distinct counts maxima."""
    counts = atoms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_atoms"),
        (F.max("residue_idx") + 1).cast("long").alias("num_residues"),
        (F.max("chain_idx") + 1).cast("long").alias("num_chains"))
    bonded = bonds.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_bonds"))
    return (counts.join(bonded, list(keys), "left")
            .withColumn("num_bonds", F.coalesce("num_bonds", F.lit(0).cast("long"))))
