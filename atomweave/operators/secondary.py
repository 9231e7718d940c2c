"""Secondary structure from backbone hydrogen bonds.

The patterns are set operations on the table of hydrogen bonds ``(nh, co)``: every bond knows which
turns and bridges it can be part of, so each pattern is one explode and one aggregate over the bonds
instead of repeated self joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..session import stage
from . import grid, scans

KEY = ("structure_id",)

# Rule values (Kabsch and Sander 1983): energies in kcal/mol, lengths in Å.
CHARGE_FACTOR = 27.888
BOND_ENERGY = -0.5
MIN_DISTANCE = 0.5
CLAMPED_ENERGY = -9.9
CA_CUTOFF = 9.0
NH_LENGTH = 1.0
PEPTIDE_MAX = 2.5

BONDS_PER_TASK = 32768
ACCEPTOR_CELLS = 4  # cells of a tile along an axis: an acceptor goes to 3.4 tiles, not to 8 as with two

BACKBONE_ATOMS = {"n": "N", "ca": "CA", "c": "C", "o": "O"}

# State precedence: a lower number wins, residues without a mark are Coil.
PRECEDENCE = {1: "Helix", 2: "Sheet", 3: "Helix", 4: "Turn"}


def gather_backbone(atoms: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Last N, CA, C and O position of every amino residue, and whether all four are there."""
    place = F.struct("x", "y", "z")
    return (atoms.where(F.col("residue_class") == "AminoAcid")
            .groupBy(*keys, "residue_idx")
            .agg(F.first("chain_idx").alias("chain_idx"), F.first("res_name").alias("res_name"),
                 *[F.max_by(place, F.when(F.upper("name") == atom, F.col("atom_idx"))).alias(column)
                   for column, atom in BACKBONE_ATOMS.items()])
            .withColumn("complete", F.col("n").isNotNull() & F.col("ca").isNotNull()
                        & F.col("c").isNotNull() & F.col("o").isNotNull()))


def estimate_amide_h(backbone: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Add ``h``, the estimated amide hydrogen; null where the residue cannot be a donor.

    The hydrogen points away from the carbonyl of the residue before, which must be the preceding
    residue of the same chain, complete and peptide-bound.  Proline has none.
    """
    window = Window.partitionBy(*keys, "_blk").orderBy("residue_idx")
    blocks = scans.halo(backbone, "residue_idx", before=1, after=0)
    with_prev = blocks.withColumn(
        "_p", F.lag(F.struct("residue_idx", "chain_idx", "complete", "c", "o")).over(window))
    with_prev = scans.drop_halo(with_prev)
    carbonyl = v.sub(v.vec0("_p.c"), v.vec0("_p.o"))
    link = v.sub(v.vec0("_p.c"), v.vec0("n"))
    measured = with_prev.withColumns({"_cx": carbonyl[0], "_cy": carbonyl[1], "_cz": carbonyl[2],
                                      "_len": v.length(carbonyl), "_link2": v.dot(link, link)})
    donor = (F.col("complete") & F.col("_p.complete")
             & (F.col("_p.residue_idx") == F.col("residue_idx") - 1)
             & (F.col("_p.chain_idx") == F.col("chain_idx"))
             & (F.upper("res_name") != "PRO")
             & (F.col("_link2") <= PEPTIDE_MAX ** 2) & (F.col("_len") >= 1e-4))
    step = v.scale(v.columns("_c"), F.lit(NH_LENGTH) / F.col("_len"))
    hydrogen = v.pack(v.add(v.vec0("n"), step))
    return measured.withColumn("h", F.when(donor, hydrogen)).drop("_p", "_cx", "_cy", "_cz", "_len", "_link2")


def bond_energy(on: Column, ch: Column, oh: Column, cn: Column) -> Column:
    """Electrostatic energy of N-H...O=C from the four distances between its atoms."""
    clash = F.least(on, ch, oh, cn) < MIN_DISTANCE
    return F.when(clash, F.lit(CLAMPED_ENERGY)).otherwise(CHARGE_FACTOR * (1 / on + 1 / ch - 1 / oh - 1 / cn))


def hydrogen_bonds(backbone: DataFrame, keys: Sequence[str] = KEY, best_only: bool = False) -> DataFrame:
    """Hydrogen bonds ``(nh donor, co acceptor, energy, same_chain)`` below the energy limit.

    With ``best_only`` acceptors with identical coordinates are cut to the five smallest ordinals
    first.  A donor keeps two acceptors, ties going to the smaller ordinal, and may not use up to
    three neighbours, so the other copies can never be chosen: the result for :func:`best_two` is the
    same while a pile of copies is not paired row by row.

    Both sides are shuffled whatever size the planner takes them for: it does not count the tiles an
    acceptor is copied to, nor the rows that an explode below the backbone makes.
    """
    whole = backbone.where("complete")
    shared = [*keys, "residue_idx", "chain_idx", *v.flat("ca", "")]
    donors = whole.where(F.col("h").isNotNull()).select(*shared, *v.flat("n", "n"), *v.flat("h", "h"))
    acceptors = whole.select(*shared, *v.flat("c", "c"), *v.flat("o", "o"))
    if best_only:
        spot = ["x", "y", "z", *[f"{p}{a}" for p in "co" for a in "xyz"]]
        rank = F.row_number().over(Window.partitionBy(*keys, *spot).orderBy("residue_idx"))
        acceptors = acceptors.withColumn("_rank", rank).where(F.col("_rank") <= 5).drop("_rank")
    apart = F.abs(F.col("residue_idx") - F.col("residue_idx_r")) >= 2
    near = grid.candidates(donors, acceptors.hint("merge"), keys, CA_CUTOFF, per_tile=ACCEPTOR_CELLS,
                           condition=(grid.distance2() <= CA_CUTOFF ** 2) & apart)
    n, h, c, o = v.columns("n"), v.columns("h"), v.columns("c", "_r"), v.columns("o", "_r")
    measured = near.select(*keys, F.col("residue_idx").alias("nh"), F.col("residue_idx_r").alias("co"),
                           (F.col("chain_idx") == F.col("chain_idx_r")).alias("same_chain"),
                           v.distance(o, n).alias("_on"), v.distance(c, h).alias("_ch"),
                           v.distance(o, h).alias("_oh"), v.distance(c, n).alias("_cn"))
    energy = bond_energy(*[F.col(d) for d in ("_on", "_ch", "_oh", "_cn")])
    # the explode keeps the energy test above the join: otherwise the formula is copied into the join
    # condition, in front of the cheap tests
    return (measured.withColumn("energy", F.explode(F.array(energy))).where(F.col("energy") < BOND_ENERGY)
            .drop("_on", "_ch", "_oh", "_cn"))


def best_two(bonds: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """The two strongest bonds of each donor; ranking is cut before the shuffle by Spark's group limit."""
    rank = F.row_number().over(Window.partitionBy(*keys, "nh").orderBy("energy", "co"))
    return bonds.withColumn("rank", rank).where(F.col("rank") <= 2)


def turns(bonds: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """n-turns: residue i accepts a bond from residue i+n of the same chain, n = 3, 4, 5."""
    n = F.col("nh") - F.col("co")
    return (bonds.where(n.isin(3, 4, 5) & F.col("same_chain"))
            .select(*keys, n.cast("int").alias("n"), F.col("co").alias("i")).distinct())


def helix_starts(all_turns: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Positions i with n-turns at i-1 and i: two turns vote for one start, no self join."""
    votes = all_turns.select(*keys, "n", F.explode(F.array(
        F.struct(F.col("i").alias("i"), F.lit(1).alias("role")),
        F.struct((F.col("i") + 1).alias("i"), F.lit(2).alias("role")))).alias("_v"))
    return (votes.groupBy(*keys, "n", F.col("_v.i").alias("i"))
            .agg(F.bit_or("_v.role").alias("_roles")).where(F.col("_roles") == 3).drop("_roles"))


def bridges(bonds: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Residue pairs (i < j, at least three apart) joined by a parallel or antiparallel bridge.

    Each of the four patterns needs two bonds.  A bond names the pair and the half of a pattern it
    provides (one bit each); a pair is a bridge when both halves of one pattern were named. The bonds are
    staged and counted: there are as many tasks as ``BONDS_PER_TASK`` bonds, so a task's table of pairs does not
    grow with the input.
    """
    co, nh = F.col("co"), F.col("nh")
    halves = [  # (i, j) of the pair for which this bond is the given half
        (co + 1, nh), (nh - 1, co),          # parallel:      CO(i-1)-NH(j)   and CO(j)-NH(i+1)
        (nh, co + 1), (co, nh - 1),          # parallel:      CO(j-1)-NH(i)   and CO(i)-NH(j+1)
        (co, nh), (nh, co),                  # antiparallel:  CO(i)-NH(j)     and CO(j)-NH(i)
        (co + 1, nh - 1), (nh - 1, co + 1),  # antiparallel:  CO(i-1)-NH(j+1) and CO(j-1)-NH(i+1)
    ]
    bonds = stage(bonds.select(*keys, "co", "nh"), "bridge-bonds")
    votes = bonds.select(*keys, F.explode(F.array(*[
        F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"), F.lit(1 << bit).alias("half"))
        for bit, (i, j) in enumerate(halves)])).alias("_v"))
    votes = votes.select(*keys, "_v.i", "_v.j", "_v.half").where(F.col("j") - F.col("i") >= 3)
    tasks = max(1, -(-bonds.count() // BONDS_PER_TASK))
    pairs = votes.repartition(tasks, *keys, "i", "j").groupBy(*keys, "i", "j").agg(F.bit_or("half").alias("_m"))

    def both(low: int) -> Column:
        return F.col("_m").bitwiseAND(F.lit(low * 3)) == low * 3

    return (pairs.withColumn("parallel", both(1) | both(4)).withColumn("antiparallel", both(16) | both(64))
            .where(F.col("parallel") | F.col("antiparallel")).drop("_m"))


def assign(residues: DataFrame, backbone: DataFrame, bonds: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """State of every residue: 4-helix, then sheet, then 3- and 5-helix, then turn, else coil.

    Structures with fewer than four complete residues stay coil.  Marks are collected as numbers and
    the strongest one wins, which is what marking in this order without overwriting gives.
    """
    all_turns = turns(bonds, keys)
    i, n = F.col("i"), F.col("n")

    def mark(source: DataFrame, first: Column, last: Column, level: Column) -> DataFrame:
        return source.select(*keys, F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("residue_idx"),
                             level.alias("level"))

    helices = mark(helix_starts(all_turns, keys), i, i + n - 1, F.when(n == 4, 1).otherwise(3))
    turned = mark(all_turns, i + 1, i + n - 1, F.lit(4))
    sheets = bridges(bonds, keys).select(
        *keys, F.explode(F.array("i", "j")).alias("residue_idx"), F.lit(2).alias("level"))
    marks = (helices.unionByName(turned).unionByName(sheets)
             .groupBy(*keys, "residue_idx").agg(F.min("level").alias("level")))
    enough = (backbone.where("complete").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
              .where(F.col("_n") >= 4).select(*keys))
    marks = marks.join(enough, list(keys), "left_semi")
    state = None
    for level, kind in PRECEDENCE.items():
        hit = F.col("level") == level
        state = F.when(hit, kind) if state is None else state.when(hit, kind)
    return (residues.drop("ss").join(marks, [*keys, "residue_idx"], "left")
            .withColumn("ss", state.otherwise("Coil")).drop("level"))


def compute(atoms: DataFrame, residues: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Atoms and residues to residue states.

    The gathered backbone (one row per residue) and the chosen bonds (at most two per residue) are
    staged, because several patterns read them.
    """
    backbone = stage(estimate_amide_h(gather_backbone(atoms, keys), keys), "backbone")
    bonds = stage(best_two(hydrogen_bonds(backbone, keys, best_only=True), keys), "hydrogen_bonds")
    return assign(residues, backbone, bonds, keys)


def torsions(backbone: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """phi, psi and omega of each residue; null where a neighbour of the same chain is missing."""
    window = Window.partitionBy(*keys, "_blk").orderBy("residue_idx")
    around = F.struct("residue_idx", "chain_idx", "n", "ca", "c")
    framed = scans.drop_halo(
        scans.halo(backbone, "residue_idx", before=1, after=1)
        .withColumn("_p", F.lag(around).over(window)).withColumn("_f", F.lead(around).over(window)))

    def linked(side: str, step: int) -> Column:
        return ((F.col(f"{side}.residue_idx") == F.col("residue_idx") + step)
                & (F.col(f"{side}.chain_idx") == F.col("chain_idx")))

    n, ca, c = v.vec0("n"), v.vec0("ca"), v.vec0("c")
    phi = v.dihedral_degrees(v.vec0("_p.c"), n, ca, c)
    psi = v.dihedral_degrees(n, ca, c, v.vec0("_f.n"))
    omega = v.dihedral_degrees(v.vec0("_p.ca"), v.vec0("_p.c"), n, ca)
    has = F.col("n").isNotNull() & F.col("ca").isNotNull() & F.col("c").isNotNull()
    before = has & linked("_p", -1) & F.col("_p.c").isNotNull()
    return framed.select(
        *keys, "residue_idx", "chain_idx",
        F.when(before, phi).alias("phi"),
        F.when(has & linked("_f", 1) & F.col("_f.n").isNotNull(), psi).alias("psi"),
        F.when(before & F.col("_p.ca").isNotNull(), omega).alias("omega"))
