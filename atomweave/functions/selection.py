"""Atom selection as boolean columns; combine them with ``&``, ``|`` and ``~``.

The predicates only name columns of an enriched atom table, so one ``filter`` with any combination
is simplified and compiled by Catalyst and pushed towards the scan.  ``within`` needs a join and is
in :mod:`atomweave.operators.neighbours`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chemistry import NUCLEIC_CLASSES, atomic_number

SECONDARY_LETTERS = {"H": "Helix", "S": "Sheet", "T": "Turn", "C": "Coil"}


class SelectionError(ValueError):
    """An argument of a selection term cannot be understood."""


def _parts(value: str) -> list[str]:
    return [part for part in re.split(r"[+,]", value) if part]


def everything() -> Column:
    return F.lit(True)


def nothing() -> Column:
    return F.lit(False)


def _of_class(*names: str) -> Column:
    return F.col("residue_class").isin(*names)


def protein() -> Column:
    return _of_class("AminoAcid")


def dna() -> Column:
    return _of_class("DeoxyNucleotide")


def rna() -> Column:
    return _of_class("Nucleotide")


def nucleic() -> Column:
    return _of_class(*NUCLEIC_CLASSES)


def water() -> Column:
    return F.col("is_water")


def hetero() -> Column:
    return F.col("is_hetatm")


def backbone() -> Column:
    return F.col("is_backbone")


def ligand() -> Column:
    """Hetero groups without water."""
    return hetero() & ~water()


def sidechain() -> Column:
    """Amino-acid atoms outside the backbone."""
    return protein() & ~backbone()


def _upper_in(column: str, value: str) -> Column:
    wanted = [part.upper() for part in _parts(value)]
    return F.upper(F.col(column)).isin(wanted) if wanted else F.lit(False)


def chain(value: str) -> Column:
    """Chain ids such as ``A+B``, case-insensitive."""
    return _upper_in("chain_id", value)


def resn(value: str) -> Column:
    return _upper_in("res_name", value)


def name(value: str) -> Column:
    return _upper_in("name", value)


def resi(value: str) -> Column:
    """Sequence numbers and inclusive ranges such as ``1-50+60``; a leading minus is a sign."""
    terms = []
    for part in _parts(value):
        match = re.fullmatch(r"([+-]?\d+)(?:-(-?\d+))?", part)
        if not match:
            raise SelectionError(f"{value!r} is not a list of residue numbers")
        low = int(match.group(1))
        high = int(match.group(2)) if match.group(2) is not None else low
        terms.append(F.col("res_seq").between(low, high))
    if not terms:
        raise SelectionError(f"{value!r} is not a list of residue numbers")
    return reduce(lambda a, b: a | b, terms)


def element(value: str) -> Column:
    """Element symbols such as ``C+Fe``; an unknown symbol is an error."""
    numbers = []
    for part in _parts(value):
        number = atomic_number(part)
        if number == 0:
            raise SelectionError(f"{part!r} is not an element symbol")
        numbers.append(number)
    return F.col("element").isin(numbers) if numbers else F.lit(False)


def ss(value: str) -> Column:
    """Secondary structure letters H, S, T, C."""
    kinds = []
    for part in _parts(value):
        if part.upper() not in SECONDARY_LETTERS:
            raise SelectionError(f"{part!r} is not a secondary structure letter (H, S, T or C)")
        kinds.append(SECONDARY_LETTERS[part.upper()])
    return F.col("ss").isin(kinds) if kinds else F.lit(False)


def b_above(value: float) -> Column:
    return F.col("b_factor") > F.lit(float(value))


def b_below(value: float) -> Column:
    return F.col("b_factor") < F.lit(float(value))


def load_filter(discard_water: bool = True, discard_hydrogen: bool = False, primary_altloc_only: bool = True) -> Column:
    """Which atoms a load keeps.  The hydrogen switch drops atomic numbers 1 and 2."""
    keep = F.lit(True)
    if discard_water:
        keep = keep & ~F.col("is_water")
    if discard_hydrogen:
        keep = keep & ~F.col("element").isin(1, 2)
    if primary_altloc_only:
        keep = keep & ~F.col("is_secondary_altloc")
    return keep


def drawn(representation: Column | str, show_water: bool = False, show_hydrogen: bool = True,
          points: bool = False) -> Column:
    """Which atoms a representation shows; ``points`` is the export variant, where Surface keeps all."""
    kind = representation if isinstance(representation, Column) else F.lit(representation)
    keep = F.lit(True)
    if not show_water:
        keep = keep & ~F.col("is_water")
    if not show_hydrogen:
        keep = keep & (F.col("element") != 1)
    subset = (F.when(kind == "Backbone", F.col("is_backbone") | F.col("is_hetatm"))
              .when(kind == "AlphaTrace", F.col("is_anchor") | F.col("is_hetatm"))
              .when(kind == "Cartoon", F.col("is_hetatm"))
              .when(kind == "Surface", F.lit(points))
              .otherwise(F.lit(True)))
    return keep & subset


def index_lists(selected: DataFrame, chunk: int = 4096) -> DataFrame:
    """Ascending atom indices of a selection in chunks of bounded length, with the structure's count.

    A structure of any size yields as many rows as it needs; no list grows with the data.
    """
    chunks = (selected.groupBy("structure_id", F.floor(F.col("atom_idx") / chunk).cast("long").alias("chunk"))
              .agg(F.sort_array(F.collect_list("atom_idx")).alias("atom_indices")))
    return chunks.withColumn("num_selected", F.sum(F.size("atom_indices")).over(Window.partitionBy("structure_id")))
