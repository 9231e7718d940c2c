"""Which reader a file belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MMCIF_EXTENSIONS = ("cif", "mmcif", "bcif")
PDB_EXTENSIONS = ("pdb", "ent")


def format_from_content(content: Column) -> Column:
    """Format by marks anywhere in the text, upper and lower case alike."""
    head = F.lower(content)
    cif = head.contains("_atom_site.") | head.contains("loop_") | head.startswith("data_")
    pdb = (head.contains("\natom  ") | head.startswith("atom  ") | head.contains("\nhetatm")
           | head.startswith("hetatm") | head.startswith("header"))
    return F.when(cif, "mmcif").when(pdb, "pdb").otherwise("unknown")


def file_format(path: Column, content: Column) -> Column:
    """Format by file extension, else by content."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return (F.when(extension.isin(*MMCIF_EXTENSIONS), "mmcif")
            .when(extension.isin(*PDB_EXTENSIONS), "pdb").otherwise(format_from_content(content)))
