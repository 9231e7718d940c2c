"""Element and residue attributes of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

NUCLEIC_CLASSES = ("DeoxyNucleotide", "Nucleotide")
FLAG_BITS = ("is_hetatm", "is_backbone", "is_anchor", "is_secondary_altloc", "is_water")


def with_elements(df: DataFrame, columns=("vdw_radius", "covalent_radius", "mass"),
                  number: str = "element") -> DataFrame:
    """Add element attributes; numbers outside the table get the values of element 0."""
    table = tables.elements(df.sparkSession).select(F.col("atomic_number").alias("_z"), *columns)
    key = F.when(F.col(number).between(0, tables.MAX_ATOMIC_NUMBER), F.col(number)).otherwise(0)
    return df.join(F.broadcast(table), key == F.col("_z"), "left").drop("_z")


def with_residue_class(df: DataFrame, name: str = "res_name") -> DataFrame:
    """Add ``residue_class`` and one-letter ``letter``; unknown names are Other and X."""
    table = tables.residue_names(df.sparkSession)
    return (df.join(F.broadcast(table), F.upper(F.col(name)) == F.col("residue_name"), "left")
            .withColumn("residue_class", F.coalesce("residue_class", F.lit("Other")))
            .withColumn("letter", F.coalesce("letter", F.lit("X")))
            .drop("residue_name"))


def is_backbone(name: Column, klass: Column) -> Column:
    upper = F.upper(name)
    return (F.when(klass == "AminoAcid", upper.isin(tables.PROTEIN_BACKBONE))
            .when(klass.isin(*NUCLEIC_CLASSES), upper.isin(tables.NUCLEIC_BACKBONE))
            .otherwise(F.lit(False)))


def is_anchor(name: Column, klass: Column) -> Column:
    upper = F.upper(name)
    return (F.when(klass == "AminoAcid", upper.isin(tables.PROTEIN_ANCHORS))
            .when(klass.isin(*NUCLEIC_CLASSES), upper.isin(tables.NUCLEIC_ANCHORS))
            .otherwise(F.lit(False)))


def is_primary_altloc(alt_loc: Column) -> Column:
    return alt_loc.isin(" ", "A")


def with_flags(df: DataFrame) -> DataFrame:
    """The five atom flags as booleans plus the bit mask used in exports."""
    klass, name = F.col("residue_class"), F.col("name")
    flagged = (df.withColumn("is_water", klass == "Water")
               .withColumn("is_secondary_altloc", ~is_primary_altloc(F.col("alt_loc")))
               .withColumn("is_backbone", is_backbone(name, klass))
               .withColumn("is_anchor", is_anchor(name, klass)))
    mask = F.lit(0)
    for bit, column in enumerate(FLAG_BITS):
        mask = mask.bitwiseOR(F.when(F.col(column), F.lit(1 << bit)).otherwise(F.lit(0)))
    return flagged.withColumn("flags", mask)


def enrich(atoms: DataFrame) -> DataFrame:
    """Atoms with element attributes, residue class, one-letter code and flags."""
    return with_flags(with_residue_class(with_elements(atoms)))


def _lookup(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Atomic number of an upper-case symbol, null when it is none."""
    table = tables.elements(df.sparkSession).where("atomic_number > 0").select(
        F.upper("symbol").alias("_s"), F.col("atomic_number").alias(name))
    return df.join(F.broadcast(table), key == F.col("_s"), "left").drop("_s")


def with_number_from_symbol(df: DataFrame, symbol: str, name: str = "element") -> DataFrame:
    """Atomic number of a symbol: two letters first, then one, else 0."""
    text = F.upper(F.trim(F.col(symbol)))
    found = _lookup(_lookup(df, F.substring(text, 1, 2), "_z2"), F.substring(text, 1, 1), "_z1")
    return found.withColumn(name, F.coalesce("_z2", "_z1", F.lit(0))).drop("_z2", "_z1")


def with_number_from_name(df: DataFrame, padded: str, hetatm: str, name: str = "element_guess") -> DataFrame:
    """Atomic number guessed from the padded four-column atom name.

    A blank or digit in front means a one-letter symbol in the second column; otherwise hetero atoms
    try two letters and everything else takes the first letter.
    """
    text = F.upper(F.col(padded))
    shifted = F.length(padded) >= 2
    leading = text.rlike(r"^[\s0-9]") & shifted
    two = F.when(~leading & (F.col(hetatm) | ~shifted), F.trim(F.substring(text, 1, 2)))
    one = F.when(leading, F.substring(text, 2, 1)).otherwise(F.substring(text, 1, 1))
    found = _lookup(_lookup(df, two, "_z2"), one, "_z1")
    return found.withColumn(name, F.coalesce("_z2", "_z1", F.lit(0))).drop("_z2", "_z1")


def atomic_number(symbol: str) -> int:
    """Driver-side symbol lookup for query arguments; 0 when unknown."""
    text = symbol.strip().upper()
    return tables.ATOMIC_NUMBERS.get(text[:2], tables.ATOMIC_NUMBERS.get(text[:1], 0))
