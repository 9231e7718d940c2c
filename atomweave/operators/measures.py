"""Geometric and mass measures, RMSD, measured tuples, quality and attribution reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..session import stage

KEY = ("structure_id",)
NO_MASS = 1e-8
LEAST_MASS = 1e-4


def _masked(where: Column | None, value: Column) -> Column:
    return value if where is None else F.when(where, value)


def bounds(atoms: DataFrame, where: Column | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Bounding box and B-factor range of all or of the selected atoms; null when none is selected."""
    out = []
    for a in "xyz":
        out += [F.min(_masked(where, F.col(a))).alias(f"min_{a}"), F.max(_masked(where, F.col(a))).alias(f"max_{a}")]
    out += [F.min(_masked(where, F.col("b_factor"))).alias("min_b"), F.max(_masked(where, F.col("b_factor"))).alias("max_b")]
    return atoms.groupBy(*keys).agg(*out)


def _centroid(where: Column | None) -> list[Column]:
    return [F.coalesce(F.avg(_masked(where, F.col(a))), F.lit(0.0)) for a in "xyz"]


def _mass_centre(where: Column | None) -> list[Column]:
    total = F.sum(_masked(where, F.col("mass")))
    return [F.when(total > NO_MASS, F.sum(_masked(where, F.col("mass") * F.col(a))) / total).otherwise(plain)
            for a, plain in zip("xyz", _centroid(where))]


def centroid(atoms: DataFrame, where: Column | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Geometric centre; the zero vector when nothing is selected."""
    return atoms.groupBy(*keys).agg(*[c.alias(f"centre_{a}") for c, a in zip(_centroid(where), "xyz")])


def total_mass(atoms: DataFrame, where: Column | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    return atoms.groupBy(*keys).agg(
        F.coalesce(F.sum(_masked(where, F.col("mass"))), F.lit(0.0)).alias("total_mass"))


def centre_of_mass(atoms: DataFrame, where: Column | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Centre of mass; the centroid when the selection has no known mass."""
    return atoms.groupBy(*keys).agg(*[c.alias(f"com_{a}") for c, a in zip(_mass_centre(where), "xyz")])


def radius_of_gyration(atoms: DataFrame, where: Column | None = None, keys: Sequence[str] = KEY) -> DataFrame:
    """Mass-weighted spread around the centre of mass; zero when nothing is selected.

    Atoms of one mass are summed up as count, mean and variance (moments around the mean, which Spark merges as such), then the
    few masses of a structure as groups with a weight each: no large squares are subtracted, so the origin may be far away.
    """
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    by_mass = atoms.groupBy(*keys, F.when(chosen, F.coalesce("mass", F.lit(0.0))).alias("_m")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in "xyz"], *[F.var_pop(a).alias(f"v{a}") for a in "xyz"])
    groups = by_mass.groupBy(*keys).agg(F.collect_list(F.when(F.col("_m").isNotNull(), F.struct(  # one for each mass: 119 at most
        F.col("_m").alias("m"), "n", *[c for a in "xyz" for c in (a, f"v{a}")]))).alias("_g"))

    def total(value) -> Column:
        return F.aggregate("_g", F.lit(0.0), lambda so_far, g: so_far + value(g))

    heavy = total(lambda g: g["m"] * g["n"]) > NO_MASS
    share = groups.withColumns({"_heavy": heavy, "_all": total(lambda g: F.when(heavy, g["m"]).otherwise(1.0) * g["n"])})
    share = share.withColumns({f"_c{a}": F.try_divide(total(
        lambda g, a=a: F.when(F.col("_heavy"), g["m"]).otherwise(1.0) * g["n"] * g[a]), F.col("_all")) for a in "xyz"})

    def weight(g: Column) -> Column:
        return F.greatest(g["m"], F.lit(LEAST_MASS)) * g["n"]

    def spread(g: Column) -> Column:
        parts = [g[f"v{a}"] + (g[a] - F.col(f"_c{a}")) * (g[a] - F.col(f"_c{a}")) for a in "xyz"]
        return weight(g) * (parts[0] + parts[1] + parts[2])

    return share.select(*keys, F.when(F.size("_g") > 0, F.sqrt(F.try_divide(total(spread), total(weight)))).otherwise(F.lit(0.0)).alias("radius_of_gyration"))


def rmsd(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY, idx: str = "atom_idx",
         where: Column | None = None) -> DataFrame:
    """RMSD of two coordinate sets without superposition.

    Null when the sets differ in length, are empty, or the selection (a condition on the columns of
    ``a``) is empty.
    """
    chosen = F.lit(True) if where is None else where
    left = a.select(*keys, idx, "x", "y", "z", chosen.alias("_chosen"))
    right = b.select(*keys, idx, *[F.col(c).alias(f"{c}_r") for c in "xyz"])
    both = left.join(right, [*keys, idx], "full_outer")
    square = v.dot(v.sub(v.columns(), v.columns(suffix="_r")), v.sub(v.columns(), v.columns(suffix="_r")))
    grouped = both.groupBy(*keys).agg(
        F.bool_and(F.col("x").isNotNull() & F.col("x_r").isNotNull()).alias("_paired"),
        F.avg(F.when(F.col("_chosen"), square)).alias("_mean"))
    return grouped.select(*keys, F.when(F.col("_paired"), F.sqrt("_mean")).alias("rmsd"))


def measure_tuples(tuples: DataFrame, atoms: DataFrame, keys: Sequence[str] = KEY,
                   tuple_id: str = "tuple_id") -> DataFrame:
    """Distance a-b, angle a-b-c and torsion a-b-c-d for a table of atom tuples.

    One join for all four atoms: tuples are unpivoted to (tuple, slot, atom), joined once and put back
    together by an aggregate.  A measure is null when one of its atoms is missing.
    """
    slots = ["a", "b", "c", "d"]
    long = tuples.select(*keys, tuple_id, F.posexplode(F.array(*slots)).alias("_slot", "atom_idx"))
    place = F.struct("x", "y", "z")
    found = (long.join(atoms.select(*keys, "atom_idx", place.alias("_p")), [*keys, "atom_idx"], "left")
             .groupBy(*keys, tuple_id)
             .agg(*[F.max(F.when(F.col("_slot") == i, F.col("_p"))).alias(f"_{s}") for i, s in enumerate(slots)]))
    have = {s: F.col(f"_{s}").isNotNull() for s in slots}
    # legs and plane normals become columns of their own, so each is computed once
    points = {s: v.vec0(f"_{s}") for s in slots}
    legs = {"u": ("a", "b"), "v": ("b", "c"), "w": ("c", "d")}
    found = found.withColumns({f"_{leg}{x}": q for leg, (p, s) in legs.items()
                               for x, q in zip("xyz", v.sub(points[s], points[p]))})
    first, middle, last = (v.columns(f"_{leg}") for leg in legs)
    found = found.withColumns({f"_{n}{x}": q for n, (p, s) in {"m": (first, middle), "n": (middle, last)}.items()
                               for x, q in zip("xyz", v.cross(p, s))})
    return found.select(
        *keys, tuple_id,
        F.when(have["a"] & have["b"], v.length(first)).alias("distance"),
        F.when(have["a"] & have["b"] & have["c"], v.angle_between(v.scale(first, -1.0), middle)).alias("angle"),
        F.when(have["a"] & have["b"] & have["c"] & have["d"],
               v.torsion(middle, v.columns("_m"), v.columns("_n"))).alias("dihedral"))


def secondary_composition(residues: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """Residues per state and structure; fixed columns, so no extra pass to find the states."""
    return residues.groupBy(*keys).agg(*[
        F.count_if(F.col("ss") == kind).alias(f"num_{kind.lower()}") for kind in ("Helix", "Sheet", "Turn", "Coil")])


def quality_report(summary: DataFrame, composition: DataFrame, expectations: DataFrame,
                   keys: Sequence[str] = KEY) -> DataFrame:
    """Plausibility checks per structure.

    ``expectations`` has ``min_atoms``, ``max_atoms``, ``file_helix``, ``file_sheet`` (residues the
    file states).  Derived shares only have to reach the order of magnitude of the stated ones.  Every structure of
    ``summary`` has a row; a verdict is null where what it needs is missing.
    """
    total = F.col("num_residues")
    return (summary.join(composition, list(keys), "left").join(expectations, list(keys), "left")
            .select(*keys,
                    F.col("num_atoms").between(F.col("min_atoms"), F.col("max_atoms")).alias("atoms_ok"),
                    (F.col("num_bonds") > F.col("num_atoms") * 0.8).alias("bonds_ok"),
                    ((F.col("file_helix") <= total * 0.2) | (F.col("num_helix") > total * 0.15)).alias("helix_ok"),
                    ((F.col("file_sheet") <= total * 0.15) | (F.col("num_sheet") > total * 0.10)).alias("sheet_ok")))


def attribution_report(structures: DataFrame) -> DataFrame:
    """Distinct attribution texts over a set of structures, with how many structures need each."""
    return (structures.where(F.col("attribution") != "")
            .groupBy("attribution").agg(F.count(F.lit(1)).alias("num_structures")))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY, idx: str = "atom_idx",
              tolerance: float = 1e-3) -> DataFrame:
    """Compare one entry read from two formats atom by atom."""
    attributes = ["element", "name", "res_name", "chain_id", "res_seq"]
    left = a.select(*keys, idx, "x", "y", "z", *attributes, F.lit(True).alias("_in_a"))
    right = b.select(*keys, idx, *[F.col(c).alias(f"{c}_r") for c in ("x", "y", "z", *attributes)],
                     F.lit(True).alias("_in_b"))
    same = F.lit(True)
    for c in attributes:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_r"))
    close = v.distance(v.columns(), v.columns(suffix="_r")) <= tolerance
    status = (F.when(F.col("_in_b").isNull(), "only_a").when(F.col("_in_a").isNull(), "only_b")
              .when(~close, "moved").when(~same, "differs").otherwise("equal"))
    return left.join(right, [*keys, idx], "full_outer").select(*keys, idx, status.alias("status"))


def reconcile_strict(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of either side that the other has not, counted as often as they differ in number; none if equal."""
    left, right = a.select(*columns), b.select(*columns)
    return (left.exceptAll(right).withColumn("status", F.lit("only_a"))
            .unionByName(right.exceptAll(left).withColumn("status", F.lit("only_b"))))


def digests(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """Number of rows and two sums of row hashes of each structure: equal for equal multisets of rows, in any order."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")).alias(f"h{seed}") for seed in (1, 2)])


def reconcile_by_digest(a: DataFrame, b: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEY) -> DataFrame:
    """:func:`reconcile_strict` within each structure; rows are only compared in structures whose digests differ.

    Equal structures cost one partial aggregate a side instead of shuffling all their rows.
    """
    one = digests(a, columns, keys)
    two = digests(b, columns, keys).withColumnsRenamed({c: f"{c}_b" for c in ("n", "h1", "h2")})
    same = F.col("n").eqNullSafe(F.col("n_b")) & F.col("h1").eqNullSafe(F.col("h1_b")) & F.col("h2").eqNullSafe(F.col("h2_b"))
    differ = stage(one.join(two, list(keys), "full_outer").where(~same).select(*keys), "differing-structures")
    names = [*keys, *[c for c in columns if c not in keys]]
    return reconcile_strict(a.join(differ, list(keys), "left_semi"), b.join(differ, list(keys), "left_semi"), names)
