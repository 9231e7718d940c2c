"""Fixed-column structure files as line tables and record tables.

All functions work on a line table ``(file, line_no, line)``; ``read_lines`` makes one from files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chemistry
from ..operators import scans

KEY = ("file",)

# Columns of the format, counted from 1: (first, length).
ATOM_COLUMNS = {
    "padded_name": (13, 4), "alt_loc": (17, 1), "res_name": (18, 3), "chain_id": (22, 1), "res_seq": (23, 4),
    "ins_code": (27, 1), "x": (31, 8), "y": (39, 8), "z": (47, 8), "occupancy": (55, 6), "b_factor": (61, 6),
    "symbol": (77, 2),
}


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of structure files with their number, order kept; one row per file on the way in."""
    texts = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return split_lines(texts)


def split_lines(texts: DataFrame, text: str = "value", keys: Sequence[str] = KEY) -> DataFrame:
    return texts.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line_no", "line"))


def cut(name: str) -> Column:
    first, length = ATOM_COLUMNS[name]
    return F.substring("line", first, length)


def field(first: int, length: int) -> Column:
    return F.trim(F.substring("line", first, length))


def number(text: Column, kind: str = "double") -> Column:
    """Number in a column range; null when blank or not a number."""
    return F.trim(text).try_cast(kind)


def record(length: int = 6) -> Column:
    """Record name at the start of a line, case-insensitive; lines under six characters have none."""
    return F.when(F.length("line") >= 6, F.upper(F.substring("line", 1, length)))


def is_atom_line() -> Column:
    return record().isin("ATOM  ", "HETATM")


def is_ter() -> Column:
    return record(3) == "TER"


def scan_atoms(lines: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Atom records; a row without three readable coordinates is marked invalid, not dropped."""
    one_char = {c: F.coalesce(F.when(F.length(cut(c)) == 1, cut(c)), F.lit(" ")) for c in ("alt_loc", "ins_code")}
    extra = [c for c in lines.columns if c not in {*keys, "line_no", "line"}]
    rows = lines.where(is_atom_line()).select(
        *keys, "line_no", *extra,
        (record() == "HETATM").alias("is_hetatm"),
        cut("padded_name").alias("padded_name"), F.trim(cut("padded_name")).alias("name"),
        one_char["alt_loc"].alias("alt_loc"), F.trim(cut("res_name")).alias("res_name"),
        F.trim(cut("chain_id")).alias("chain_id"),
        F.coalesce(number(cut("res_seq"), "int"), F.lit(0)).alias("res_seq"),
        one_char["ins_code"].alias("ins_code"),
        number(cut("x")).alias("x"), number(cut("y")).alias("y"), number(cut("z")).alias("z"),
        F.coalesce(number(cut("occupancy")), F.lit(1.0)).alias("occupancy"),
        F.coalesce(number(cut("b_factor")), F.lit(0.0)).alias("b_factor"),
        F.trim(cut("symbol")).alias("symbol"))
    return rows.withColumn("is_valid", F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def with_elements(atoms: DataFrame) -> DataFrame:
    """Atomic number from the element column, or guessed from the atom name where that is empty."""
    named = chemistry.with_number_from_name(
        chemistry.with_number_from_symbol(atoms, "symbol", "_z"), "padded_name", "is_hetatm", "_g")
    return named.withColumn("element", F.when(F.col("_z") > 0, F.col("_z")).otherwise(F.col("_g"))).drop("_z", "_g")


def with_model(lines: DataFrame, keys: Sequence[str] = KEY, width: int = scans.BLOCK) -> DataFrame:
    """Add ``model_no``: the last MODEL number plus the ENDMDL records since; 1 before any MODEL.

    A block of lines is summarised by its last MODEL number and the ENDMDL count after it.
    """
    is_model, is_end = record() == "MODEL ", record() == "ENDMDL"
    here = scans.upto(keys, ["line_no"])
    rows = (scans.tag(lines, "line_no", width)
            .withColumn("_m", F.when(is_model, F.coalesce(number(F.substring("line", 11, 4), "int"), F.lit(1))))
            .withColumn("_ends", F.sum(F.when(is_end, 1).otherwise(0)).over(here))
            .withColumn("_at", F.last(F.when(F.col("_m").isNotNull(), F.col("_ends")), ignorenulls=True).over(here))
            .withColumn("_model", F.last("_m", ignorenulls=True).over(here)))
    ends = rows.groupBy(*keys, "_blk").agg(F.max_by(F.struct("_model", "_ends", "_at"), "line_no").alias("_e"))
    cumulative = F.sum("_e._ends").over(scans.across(keys).rowsBetween(scans.Window.unboundedPreceding, 0))
    before = scans.earlier(keys)
    blocks = (ends.withColumn("_cum", cumulative)
              .withColumn("_abs", F.col("_cum") - F.col("_e._ends") + F.col("_e._at"))
              .select(*keys, "_blk",
                      F.last("_e._model", ignorenulls=True).over(before).alias("_m0"),
                      (F.coalesce(F.last("_cum").over(before), F.lit(0))
                       - F.last("_abs", ignorenulls=True).over(before)).alias("_e0")))
    inside = F.col("_model") + F.col("_ends") - F.col("_at")
    carried = F.col("_m0") + F.col("_e0") + F.col("_ends")
    return (scans.attach(rows, keys, blocks)
            .withColumn("model_no", F.coalesce(inside, carried, F.lit(1)).cast("int"))
            .drop("_blk", "_m", "_ends", "_at", "_model", "_m0", "_e0"))


def with_breaks(lines: DataFrame, keys: Sequence[str] = KEY, model: int = 1) -> DataFrame:
    """Add ``break_before`` to atom lines of one model: a TER or MODEL record since the atom before.

    Needs ``model_no``.  Among the records that matter the one before an atom is either a break or an
    atom, so the flag is whether the latest of them is a break.
    """
    is_break = is_ter() | (record() == "MODEL ")
    is_kept = is_atom_line() & (F.col("model_no") == model)
    marked = scans.last_before(lines.where(is_break | is_kept), keys, "line_no",
                               F.when(is_break & ~is_atom_line(), F.lit("break")).otherwise(F.lit("atom")), "_since")
    return (marked.where(is_kept).withColumn("break_before", F.coalesce(F.col("_since") == "break", F.lit(False)))
            .drop("_since"))


def headers(lines: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Identifier, title, method, resolution, prediction flag and model count of each file.

    Lines are read once: all that are no header records become one row a file.  Title parts are joined in line
    order.  A file without header records has empty texts, no resolution and one model.
    """
    rec = record()
    kinds = ("HEADER", "TITLE ", "EXPDTA", "REMARK", "MODEL ")
    head = rec.isin(*kinds)
    rows = lines.select(*keys, *[F.when(head, c).alias(n) for n, c in
                                 (("line_no", F.col("line_no")), ("line", F.col("line")), ("_rec", rec))]).distinct()
    at = F.col("line_no")

    def is_(kind: str) -> Column:
        return F.col("_rec") == kind

    def latest(kind: str, value: Column, present: Column) -> Column:
        return F.max_by(value, F.when(is_(kind) & present, at))

    code, part, method = field(63, 4), field(11, 70), field(11, 70)
    resolution = number(F.substring("line", 24, 8))
    resolved = ((number(F.substring("line", 8, 3), "int") == 2)
                & F.upper(F.substring("line", 12, 60)).contains("RESOLUTION") & (resolution > 0))
    model = F.coalesce(number(F.substring("line", 11, 4), "int"), F.lit(1))
    titles = F.collect_list(F.when(is_("TITLE ") & (part != ""), F.struct(at.alias("at"), part.alias("part"))))
    found = rows.groupBy(*keys).agg(
        latest("HEADER", code, code != "").alias("identifier"),
        F.array_join(F.transform(F.sort_array(titles), lambda t: t["part"]), " ").alias("title"),
        latest("EXPDTA", method, F.lit(True)).alias("method"),
        latest("REMARK", resolution, F.coalesce(resolved, F.lit(False))).alias("resolution"),
        F.bool_or(is_("REMARK") & F.upper("line").contains("ALPHAFOLD")).alias("_remark"),
        F.greatest(F.lit(1), F.coalesce(F.max(F.when(is_("MODEL "), model)), F.lit(1))).alias("num_models"))
    predicted = F.coalesce(F.col("_remark") | F.upper("title").contains("ALPHAFOLD"), F.lit(False))
    return found.withColumn("is_prediction", predicted).drop("_remark")


def secondary_ranges(lines: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """HELIX and SHEET ranges; the ordinal is the line number."""
    rec = record()
    helix = rec == "HELIX "

    def integer(first: int) -> Column:
        return F.coalesce(number(F.substring("line", first, 4), "int"), F.lit(0))

    return lines.where(rec.isin("HELIX ", "SHEET ")).select(
        *keys, F.col("line_no").alias("ordinal"),
        F.when(helix, "Helix").otherwise("Sheet").alias("kind"),
        F.when(helix, field(20, 1)).otherwise(field(22, 1)).alias("chain_id"),
        F.when(helix, integer(22)).otherwise(integer(23)).alias("first_seq"),
        integer(34).alias("last_seq"))


def raw_atoms(lines: DataFrame, keys: Sequence[str] = KEY, model: int = 1) -> DataFrame:
    """Atom rows of one model with break flags and elements, ready for load filter and numbering."""
    return with_elements(scan_atoms(with_breaks(with_model(lines, keys), keys, model), keys))


def load_report(files: DataFrame, atoms: DataFrame, kept: Column, keys: Sequence[str] = KEY) -> DataFrame:
    """Per file: atoms kept, discarded by options, malformed, and success with its reason.

    ``atoms`` are raw rows with ``is_valid``; ``kept`` is the load filter.  Files without a single atom
    row appear through the left join.
    """
    valid = F.col("is_valid")
    counts = atoms.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(valid & kept).alias("num_kept"), F.count_if(valid & ~kept).alias("num_discarded"),
        F.count_if(~valid).alias("num_malformed"))
    reason = (F.when(F.coalesce("_rows", F.lit(0)) == 0, "no atom records")
              .when(F.col("num_kept") == 0, "no atom left after load options").otherwise(""))
    return files.select(*keys).join(counts, list(keys), "left").select(
        *keys, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("num_kept", "num_discarded", "num_malformed")],
        (reason == "").alias("success"), reason.alias("reason"))
