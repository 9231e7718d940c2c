"""Queries of sections D, J and E: joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import appearance, chemistry, identifiers, selection as sel
from ..operators import assemble, binding, density, exports, grid, measures, neighbours, secondary, trajectory
from ..session import stage
from ..sources import manifest
from . import fixtures as fx
from .projecting import FILE_STATES, ORIGIN, origins
from .registry import q, qq, query, r, rr

ID = ["structure_id", "atom_idx"]

BONDABLE = """
    SELECT n.* FROM numbered n JOIN res_rows USING (structure_id, residue_idx) WHERE NOT (num_atoms = 1 AND is_hetatm)"""
BONDS = """
    SELECT a.structure_id, a.atom_idx AS atom_a, b.atom_idx AS atom_b, 1 AS bond_order
    FROM bondable a JOIN bondable b ON a.structure_id = b.structure_id AND a.atom_idx < b.atom_idx
      AND abs(a.x - b.x) <= 5.7 AND abs(a.y - b.y) <= 5.7 AND abs(a.z - b.z) <= 5.7
    WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)
      BETWEEN 0.16 AND (a.covalent_radius + b.covalent_radius + 0.45) * (a.covalent_radius + b.covalent_radius + 0.45)"""
BOND_VIEWS = {"bondable": BONDABLE, "bonds": BONDS}


def bonds(spark: SparkSession, sf: str, atoms: DataFrame | None = None) -> DataFrame:
    """Bonds of the numbered atoms, which are staged once where the caller needs them too."""
    return neighbours.bonds(neighbours.without_lone_ions(fx.numbered(spark, sf) if atoms is None else atoms))


@query("d1_bonds", "SELECT * FROM bonds", "numbered", "res_rows", extra=BOND_VIEWS)
def derive_bonds(spark: SparkSession, sf: str) -> DataFrame:
    return bonds(spark, sf)


@query("d2_within", """
    SELECT DISTINCT a.structure_id, a.atom_idx FROM atoms a JOIN (SELECT * FROM atoms WHERE element = 30) s
      ON a.structure_id = s.structure_id
    WHERE (a.x-s.x)*(a.x-s.x) + (a.y-s.y)*(a.y-s.y) + (a.z-s.z)*(a.z-s.z) <= 16""", "atoms")
def within(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.atoms(spark, sf)
    return neighbours.within(atoms, atoms.where(sel.element("Zn")), 4.0).select(*ID)


@query("c12_within_combination", """
    SELECT a.structure_id, a.atom_idx FROM atoms a LEFT JOIN (
      SELECT DISTINCT a.structure_id, a.atom_idx FROM atoms a JOIN atoms s ON a.structure_id = s.structure_id AND s.element = 30
      WHERE (a.x-s.x)*(a.x-s.x) + (a.y-s.y)*(a.y-s.y) + (a.z-s.z)*(a.z-s.z) <= 36) n USING (structure_id, atom_idx)
    WHERE (n.atom_idx IS NOT NULL AND a.element <> 30 AND a.chain_id = 'A') OR NOT (n.atom_idx IS NOT NULL OR a.b_factor > 20)""", "atoms")
def within_combination(spark: SparkSession, sf: str) -> DataFrame:
    """Near a metal and in chain A, or neither near a metal nor mobile."""
    atoms = fx.atoms(spark, sf)
    flagged = neighbours.with_within(atoms, atoms.where(sel.element("Zn")), 6.0, "near")
    near = F.col("near")
    return flagged.where((near & ~sel.element("Zn") & sel.chain("A")) | ~(near | sel.b_above(20))).select(*ID)


@query("j1_enrich", """
    SELECT structure_id, atom_idx, vdw_radius, covalent_radius, mass, residue_class, letter FROM enriched""", "enriched")
def enrich(spark: SparkSession, sf: str) -> DataFrame:
    return fx.enriched(spark, sf).select(*ID, "vdw_radius", "covalent_radius", "mass", "residue_class", "letter")


@query("j2_range_states", "SELECT * FROM states", "res_rows", "ranges", extra={"states": FILE_STATES})
def range_states(spark: SparkSession, sf: str) -> DataFrame:
    residues = assemble.residue_table(fx.numbered(spark, sf))
    return assemble.apply_ranges(residues, fx.ranges(spark, sf)).select("structure_id", "residue_idx", "ss")


# backbone with estimated hydrogens, written with windows
BACKBONE = {
    "chain_bb": """
        SELECT structure_id, residue_idx, chain_idx, min(res_name) AS res_name,
          max(x) FILTER (name = 'N') AS nx, max(y) FILTER (name = 'N') AS ny, max(z) FILTER (name = 'N') AS nz,
          max(x) FILTER (name = 'CA') AS ax, max(y) FILTER (name = 'CA') AS ay, max(z) FILTER (name = 'CA') AS az,
          max(x) FILTER (name = 'C') AS cx, max(y) FILTER (name = 'C') AS cy, max(z) FILTER (name = 'C') AS cz,
          max(x) FILTER (name = 'O') AS ox, max(y) FILTER (name = 'O') AS oy, max(z) FILTER (name = 'O') AS oz
        FROM backbone_atoms GROUP BY ALL""",
    "linked": """
        SELECT *, ox IS NOT NULL AS complete, lag(residue_idx) OVER w AS p_idx, lag(chain_idx) OVER w AS p_chain,
          lag(ox) OVER w IS NOT NULL AS p_complete, lag(cx) OVER w AS pcx, lag(cy) OVER w AS pcy, lag(cz) OVER w AS pcz,
          lag(ox) OVER w AS pox, lag(oy) OVER w AS poy, lag(oz) OVER w AS poz
        FROM chain_bb WINDOW w AS (PARTITION BY structure_id ORDER BY residue_idx)""",
    "donors": """
        SELECT *, nx + (pcx - pox) / len AS hx, ny + (pcy - poy) / len AS hy, nz + (pcz - poz) / len AS hz
        FROM (SELECT *, sqrt((pcx-pox)*(pcx-pox) + (pcy-poy)*(pcy-poy) + (pcz-poz)*(pcz-poz)) AS len FROM linked)
        WHERE complete AND p_complete AND p_idx = residue_idx - 1 AND p_chain = chain_idx AND res_name <> 'PRO'
          AND sqrt((pcx-nx)*(pcx-nx) + (pcy-ny)*(pcy-ny) + (pcz-nz)*(pcz-nz)) <= 2.5""",
    "pairs": """
        SELECT d.structure_id, d.residue_idx AS nh, a.residue_idx AS co, d.chain_idx = a.chain_idx AS same_chain,
          sqrt((a.ox-nx)*(a.ox-nx) + (a.oy-ny)*(a.oy-ny) + (a.oz-nz)*(a.oz-nz)) AS r_on,
          sqrt((a.cx-hx)*(a.cx-hx) + (a.cy-hy)*(a.cy-hy) + (a.cz-hz)*(a.cz-hz)) AS r_ch,
          sqrt((a.ox-hx)*(a.ox-hx) + (a.oy-hy)*(a.oy-hy) + (a.oz-hz)*(a.oz-hz)) AS r_oh,
          sqrt((a.cx-nx)*(a.cx-nx) + (a.cy-ny)*(a.cy-ny) + (a.cz-nz)*(a.cz-nz)) AS r_cn
        FROM (SELECT structure_id, residue_idx, chain_idx, ax, ay, az, nx, ny, nz, hx, hy, hz FROM donors) d
        JOIN (SELECT structure_id, residue_idx, chain_idx, ax, ay, az, cx, cy, cz, ox, oy, oz FROM chain_bb WHERE ox IS NOT NULL) a
          ON a.structure_id = d.structure_id AND abs(a.residue_idx - d.residue_idx) >= 2
        WHERE (a.ax-d.ax)*(a.ax-d.ax) + (a.ay-d.ay)*(a.ay-d.ay) + (a.az-d.az)*(a.az-d.az) <= 81""",
    "hbonds": """
        SELECT * FROM (SELECT structure_id, nh, co, same_chain, CASE WHEN least(r_on, r_ch, r_oh, r_cn) < 0.5 THEN -9.9
          ELSE 27.888 * (1 / r_on + 1 / r_ch - 1 / r_oh - 1 / r_cn) END AS energy FROM pairs) WHERE energy < -0.5""",
}


def backbone(spark: SparkSession, sf: str) -> DataFrame:
    return secondary.gather_backbone(fx.backbone_atoms(spark, sf))


@query("j3_hydrogen_bonds", f"SELECT structure_id, nh, co, same_chain, {q('energy', 4)} AS energy FROM hbonds",
       "backbone_atoms", extra=BACKBONE)
def hydrogen_bonds(spark: SparkSession, sf: str) -> DataFrame:
    found = secondary.hydrogen_bonds(stage(secondary.estimate_amide_h(backbone(spark, sf)), "backbone"))
    return found.select("structure_id", "nh", "co", "same_chain", r("energy", 4).alias("energy"))


def hb(table: str, co: str, nh: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} e WHERE e.structure_id = p.structure_id AND e.co = {co} AND e.nh = {nh})"


def bridge_views(edges: str) -> dict[str, str]:
    """Bridges from pair candidates and eight probes, the long way."""
    return {
        "candidates": f"""
            SELECT DISTINCT structure_id, least(co + di, nh + dj) AS i, greatest(co + di, nh + dj) AS j
            FROM {edges} CROSS JOIN (VALUES (-1), (0), (1)) AS a(di) CROSS JOIN (VALUES (-1), (0), (1)) AS b(dj)
            WHERE abs(co + di - nh - dj) >= 3""",
        "bridged": f"""
            SELECT * FROM (SELECT structure_id, i, j,
              ({hb(edges, 'i - 1', 'j')} AND {hb(edges, 'j', 'i + 1')}) OR ({hb(edges, 'j - 1', 'i')} AND {hb(edges, 'i', 'j + 1')}) AS parallel,
              ({hb(edges, 'i', 'j')} AND {hb(edges, 'j', 'i')}) OR ({hb(edges, 'i - 1', 'j + 1')} AND {hb(edges, 'j - 1', 'i + 1')}) AS antiparallel
            FROM candidates p) WHERE parallel OR antiparallel""",
    }


@query("j4_bridges", "SELECT structure_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, parallel, antiparallel FROM bridged",
       "bond_edges", extra=bridge_views("bond_edges"))
def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return secondary.bridges(fx.bond_edges(spark, sf))


CELL = 10.0
NEAREST = f"""
    SELECT structure_id, tick, mol_id, partner_id, d2 FROM (
      SELECT a.structure_id, a.tick, a.mol_id, b.mol_id AS partner_id,
        (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2,
        row_number() OVER (PARTITION BY a.structure_id, a.tick, a.mol_id ORDER BY
          (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.mol_id) AS n
      FROM snapshots a JOIN snapshots b ON a.structure_id = b.structure_id AND a.tick = b.tick AND a.mol_id <> b.mol_id
        AND abs(floor(a.x / {CELL}) - floor(b.x / {CELL})) <= 1 AND abs(floor(a.y / {CELL}) - floor(b.y / {CELL})) <= 1
        AND abs(floor(a.z / {CELL}) - floor(b.z / {CELL})) <= 1) WHERE n = 1"""
CONTACTS = """
    SELECT s.structure_id, s.tick, s.mol_id, n.partner_id, n.d2, s.radius + p.radius AS radius_sum, s.roll,
      coalesce(n.d2 <= (s.radius + p.radius) * (s.radius + p.radius), false) AS in_contact
    FROM snapshots s LEFT JOIN nearest n USING (structure_id, tick, mol_id)
    LEFT JOIN snapshots p ON p.structure_id = s.structure_id AND p.tick = s.tick AND p.mol_id = n.partner_id"""
CONTACT_VIEWS = {"nearest": NEAREST, "contacts": CONTACTS}


def contacts(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.contacts(stage(fx.snapshots(spark, sf), "snapshots"), CELL)


@query("j5_nearest_partner", f"""
    SELECT structure_id, tick, mol_id, partner_id, d2, {q('radius_sum')} AS radius_sum, roll, in_contact FROM contacts""",
       "snapshots", extra=CONTACT_VIEWS)
def nearest_partner(spark: SparkSession, sf: str) -> DataFrame:
    return contacts(spark, sf).withColumn("radius_sum", r("radius_sum"))


J6_CELL = 4.0


def _ring(a: str) -> str:
    return f"abs(floor(p.{a} / {J6_CELL}) - floor(t.{a} / {J6_CELL}))"


@query("j6_nearest_attribute", f"""
    SELECT p.structure_id, p.point_id, f.d2, f.atom_idx, f.element FROM points p LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY ring, d2, atom_idx) AS n FROM (
        SELECT p.point_id, t.atom_idx, t.element, greatest(1, {_ring('x')}, {_ring('y')}, {_ring('z')}) AS ring,
          (p.x-t.x)*(p.x-t.x) + (p.y-t.y)*(p.y-t.y) + (p.z-t.z)*(p.z-t.z) AS d2
        FROM points p JOIN atoms t ON p.structure_id = t.structure_id)) f ON f.point_id = p.point_id AND f.n = 1""",
       "points", "atoms")
def nearest_attribute(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest_attribute(fx.points(spark, sf), fx.atoms(spark, sf), "element", J6_CELL)


@query("j7_selected_bonds", """
    SELECT b.* FROM bonds b JOIN numbered m ON m.structure_id = b.structure_id AND m.atom_idx = atom_a AND m.element <> 1
    JOIN numbered n ON n.structure_id = b.structure_id AND n.atom_idx = atom_b AND n.element <> 1""",
       "numbered", "res_rows", extra=BOND_VIEWS)
def selected_bonds(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.numbered(spark, sf)
    return exports.bonds_of(bonds(spark, sf, atoms), atoms.where(~sel.element("H")))


@query("j8_work_list", """
    SELECT DISTINCT source, key AS identifier,
      CASE source WHEN 'archive' THEN 'rcsb-' ELSE 'alphafold-' END || key || '.cif' AS storage_key FROM keyed
    WHERE valid AND CASE source WHEN 'archive' THEN 'rcsb-' ELSE 'alphafold-' END || key || '.cif' NOT IN
      (SELECT string_split(path, '/')[-1] FROM landed WHERE length > 0)""", "keyed", "landed")
def work_list(spark: SparkSession, sf: str) -> DataFrame:
    files = manifest.with_freshness(fx.landed(spark, sf), F.lit("2000-01-01").cast("timestamp"), 0)
    fresh = files.where("is_fresh").select(F.regexp_extract("path", "([^/]+)$", 1).alias("storage_key"))
    return manifest.work_list(fx.manifest(spark, sf), fresh).drop("url")


@query("j9_compatibility", """
    SELECT coalesce(s.id, t.id) AS id, coalesce(s.n, 0) = coalesce(t.n, 0) AND coalesce(s.n, 0) > 0 AS compatible,
      CASE WHEN coalesce(s.n, 0) = 0 THEN 'no structure' WHEN coalesce(t.n, 0) = 0 THEN 'no trajectory'
        WHEN s.n <> t.n THEN 'trajectory has ' || t.n || ' atoms, structure ' || s.n ELSE '' END AS reason
    FROM (SELECT structure_id AS id, count(*) AS n FROM atoms WHERE structure_id % 10 <> 3 GROUP BY 1) s
    FULL JOIN (SELECT structure_id AS id, count(*) FILTER (structure_id % 2 = 0 OR NOT is_hetatm) AS n FROM atoms
               WHERE structure_id % 10 <> 4 GROUP BY 1) t ON s.id = t.id""", "atoms")
def compatibility(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.atoms(spark, sf).withColumnRenamed("structure_id", "id")
    structures = atoms.where("id % 10 <> 3").groupBy("id").agg(F.count(F.lit(1)).alias("num_atoms"))
    series = atoms.where("id % 10 <> 4").groupBy("id").agg(
        F.count_if((F.col("id") % 2 == 0) | ~F.col("is_hetatm")).alias("num_atoms"))
    return trajectory.compatibility(structures, series)


@query("j10_reconcile", """
    SELECT structure_id, atom_idx, CASE WHEN structure_id % 9 = 1 AND atom_idx % 50 = 7 THEN 'only_a'
        WHEN structure_id % 9 = 2 AND atom_idx % 50 = 8 THEN 'only_b' WHEN atom_idx % 41 = 5 THEN 'moved'
        WHEN atom_idx % 43 = 6 THEN 'differs' ELSE 'equal' END AS status FROM atoms""", "atoms")
def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.atoms(spark, sf)
    first = atoms.where("NOT (structure_id % 9 = 2 AND atom_idx % 50 = 8)")
    second = (atoms.where("NOT (structure_id % 9 = 1 AND atom_idx % 50 = 7)")
              .withColumn("x", F.when(F.col("atom_idx") % 41 == 5, F.col("x") + 0.5).otherwise(F.col("x")))
              .withColumn("name", F.when(F.col("atom_idx") % 43 == 6, "??").otherwise(F.col("name"))))
    return measures.reconcile(first, second)


@query("j10_reconcile_strict", """
    SELECT structure_id, atom_idx, x, name, status FROM (
      SELECT structure_id, atom_idx, x, name, 'only_a' AS status FROM atoms WHERE structure_id % 3 = 0 AND (atom_idx % 41 = 5 OR atom_idx % 43 = 6)
        AND NOT (structure_id % 9 = 3 AND atom_idx % 50 = 8)
      UNION ALL SELECT structure_id, atom_idx, CASE WHEN atom_idx % 41 = 5 THEN x + 0.5 ELSE x END, CASE WHEN atom_idx % 43 = 6 THEN '??' ELSE name END, 'only_b'
      FROM atoms WHERE structure_id % 3 = 0 AND (atom_idx % 41 = 5 OR atom_idx % 43 = 6 OR (structure_id % 9 = 3 AND atom_idx % 50 = 8))
      UNION ALL SELECT structure_id, atom_idx, x, name, 'only_b' FROM atoms WHERE structure_id % 9 = 6 AND atom_idx = 3)""", "atoms")
def reconcile_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that only one of two tables of an entry has, a row given twice included."""
    atoms = fx.atoms(spark, sf).select("structure_id", "atom_idx", "x", "name")
    changed, third = F.col("structure_id") % 3 == 0, F.col("structure_id")
    first = atoms.where("NOT (structure_id % 9 = 3 AND atom_idx % 50 = 8)")
    second = (atoms.withColumn("x", F.when(changed & (F.col("atom_idx") % 41 == 5), F.col("x") + 0.5).otherwise(F.col("x")))
              .withColumn("name", F.when(changed & (F.col("atom_idx") % 43 == 6), "??").otherwise(F.col("name"))))
    second = second.unionByName(atoms.where((third % 9 == 6) & (F.col("atom_idx") == 3)))
    return measures.reconcile_by_digest(first, second, ["atom_idx", "x", "name"])


@query("j11_shortest_distance", f"""
    SELECT a.structure_id, {q('sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)))')} AS distance
    FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id
    WHERE a.element = 30 AND a.b_factor > 60 AND b.element = 16 AND b.b_factor > 80 GROUP BY a.structure_id""", "atoms")
def shortest_distance(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.atoms(spark, sf)
    found = neighbours.shortest_distance(atoms.where(sel.element("Zn") & sel.b_above(60)),
                                         atoms.where(sel.element("S") & sel.b_above(80)), usual=3.0)
    return found.select("structure_id", r("distance").alias("distance"))


def _d(a: str, b: str) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz")


MEASURED = {
    "tuples": """SELECT structure_id, atom_idx AS tuple_id, atom_idx AS a, (atom_idx * 7 + 1) % n AS b,
                 (atom_idx * 13 + 2) % n AS c, (atom_idx * 29 + 3) % n AS d
                 FROM atoms JOIN (SELECT structure_id, max(atom_idx) + 2 AS n FROM atoms GROUP BY 1) USING (structure_id)""",
    "placed": """
        SELECT t.*, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS "by", b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz,
          d.x AS dx, d.y AS dy, d.z AS dz, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz,
          c.x - b.x AS vx, c.y - b.y AS vy, c.z - b.z AS vz, d.x - c.x AS wx, d.y - c.y AS wy, d.z - c.z AS wz
        FROM tuples t LEFT JOIN atoms a ON a.structure_id = t.structure_id AND a.atom_idx = t.a
        LEFT JOIN atoms b ON b.structure_id = t.structure_id AND b.atom_idx = t.b
        LEFT JOIN atoms c ON c.structure_id = t.structure_id AND c.atom_idx = t.c
        LEFT JOIN atoms d ON d.structure_id = t.structure_id AND d.atom_idx = t.d""",
    "normals": """
        SELECT *, uy*vz - uz*vy AS mx, uz*vx - ux*vz AS my, ux*vy - uy*vx AS mz,
          vy*wz - vz*wy AS nx, vz*wx - vx*wz AS ny, vx*wy - vy*wx AS nz, sqrt(vx*vx + vy*vy + vz*vz) AS vl FROM placed""",
}
ANGLE = """CASE WHEN ux*ux+uy*uy+uz*uz >= 1e-8 AND vx*vx+vy*vy+vz*vz >= 1e-8 THEN degrees(acos(greatest(-1.0, least(1.0,
    -(ux*vx+uy*vy+uz*vz) / sqrt((ux*ux+uy*uy+uz*uz)*(vx*vx+vy*vy+vz*vz)))))) END"""
TORSION = """CASE WHEN greatest(abs(mx), abs(my), abs(mz)) <= 1e-4 OR greatest(abs(nx), abs(ny), abs(nz)) <= 1e-4 THEN 0
    ELSE degrees(atan2((vx*(my*nz-mz*ny) + vy*(mz*nx-mx*nz) + vz*(mx*ny-my*nx)) / vl + 0.0::DOUBLE, mx*nx + my*ny + mz*nz)) END"""


@query("j12_measure_tuples", f"""
    SELECT structure_id, tuple_id, {q('sqrt(ux*ux + uy*uy + uz*uz)', 4)} AS distance, {q(ANGLE, 4)} AS angle,
      {q(f'CASE WHEN ux IS NOT NULL AND vx IS NOT NULL AND wx IS NOT NULL THEN {TORSION} END', 4)} AS dihedral
    FROM normals""", "atoms", extra=MEASURED)
def measure_tuples(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.atoms(spark, sf)
    sizes = atoms.groupBy("structure_id").agg((F.max("atom_idx") + 2).alias("n"))
    tuples = atoms.join(sizes, "structure_id").selectExpr(
        "structure_id", "atom_idx AS tuple_id", "atom_idx AS a", "(atom_idx * 7 + 1) % n AS b",
        "(atom_idx * 13 + 2) % n AS c", "(atom_idx * 29 + 3) % n AS d")
    found = measures.measure_tuples(tuples, atoms)
    return found.select("structure_id", "tuple_id", *rr(["distance", "angle", "dihedral"], 4))


# --------------------------------------------------------------------------- aggregations

@query("e1_bounds", """
    SELECT structure_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
      min(b_factor) AS min_b, max(b_factor) AS max_b FROM atoms GROUP BY 1""", "atoms")
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return measures.bounds(fx.atoms(spark, sf))


ODD = "(element = 8 AND chain_id = 'A')"


def odd_atoms():
    return sel.element("O") & sel.chain("A")


@query("e2_selection_bounds", f"""
    SELECT structure_id, {', '.join(f"{f}({c}) FILTER {ODD} AS {f}_{n}" for c, n in (('x', 'x'), ('y', 'y'), ('z', 'z'), ('b_factor', 'b')) for f in ('min', 'max'))}
    FROM atoms GROUP BY 1""", "atoms")
def selection_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return measures.bounds(fx.atoms(spark, sf), odd_atoms())


@query("e3_centroid", f"""
    SELECT structure_id, {', '.join(f"{q(f'coalesce(avg({a}) FILTER {ODD}, 0)')} AS centre_{a}" for a in 'xyz')}
    FROM atoms GROUP BY 1""", "atoms")
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return measures.centroid(fx.atoms(spark, sf), odd_atoms()).select(
        "structure_id", *rr(["centre_x", "centre_y", "centre_z"]))


@query("e4_total_mass", f"SELECT structure_id, {q('sum(mass)', 4)} AS total_mass FROM enriched GROUP BY 1", "enriched")
def total_mass(spark: SparkSession, sf: str) -> DataFrame:
    return measures.total_mass(fx.enriched(spark, sf)).select("structure_id", r("total_mass", 4).alias("total_mass"))


@query("e5_centre_of_mass", f"""
    SELECT structure_id, {', '.join(f"{q(f'sum(mass * {a}) / sum(mass)')} AS com_{a}" for a in 'xyz')} FROM enriched GROUP BY 1""",
       "enriched")
def centre_of_mass(spark: SparkSession, sf: str) -> DataFrame:
    return measures.centre_of_mass(fx.enriched(spark, sf)).select("structure_id", *rr(["com_x", "com_y", "com_z"]))


@query("e6_radius_of_gyration", f"""
    SELECT structure_id, {q('sqrt(sum(mass * ((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) / sum(mass))')} AS radius_of_gyration
    FROM enriched JOIN (SELECT structure_id, sum(mass*x)/sum(mass) AS cx, sum(mass*y)/sum(mass) AS cy, sum(mass*z)/sum(mass) AS cz
                        FROM enriched GROUP BY 1) USING (structure_id) GROUP BY 1""", "enriched")
def radius_of_gyration(spark: SparkSession, sf: str) -> DataFrame:
    return measures.radius_of_gyration(fx.enriched(spark, sf)).select(
        "structure_id", r("radius_of_gyration").alias("radius_of_gyration"))


RMSD_PAIR = """
    SELECT structure_id, atom_idx, element, x, y, z, CASE WHEN structure_id % 7 = 3 AND atom_idx = 11 THEN NULL ELSE x + b_factor / 100 END AS x2,
      y - 0.5 AS y2, z + CASE WHEN element = 8 THEN 1 ELSE 0 END AS z2 FROM atoms"""


def _rmsd(mask: str) -> str:
    return (f"CASE WHEN structure_id % 7 <> 3 THEN {q(f'sqrt(avg((x-x2)*(x-x2) + (y-y2)*(y-y2) + (z-z2)*(z-z2)) FILTER ({mask}))')} END")


def rmsd_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    atoms = fx.atoms(spark, sf)
    moved = atoms.where("NOT (structure_id % 7 = 3 AND atom_idx = 11)").withColumns({
        "x": F.col("x") + F.col("b_factor") / 100, "y": F.col("y") - 0.5,
        "z": F.col("z") + F.when(F.col("element") == 8, 1.0).otherwise(0.0)})
    return atoms, moved


@query("e7_rmsd", f"SELECT structure_id, {_rmsd('true')} AS rmsd FROM pair GROUP BY structure_id", "atoms", extra={"pair": RMSD_PAIR})
def rmsd(spark: SparkSession, sf: str) -> DataFrame:
    a, b = rmsd_sets(spark, sf)
    return measures.rmsd(a, b).select("structure_id", r("rmsd").alias("rmsd"))


@query("e8_rmsd_masked", f"SELECT structure_id, {_rmsd('element = 8 AND structure_id % 5 <> 1')} AS rmsd FROM pair GROUP BY structure_id",
       "atoms", extra={"pair": RMSD_PAIR})
def rmsd_masked(spark: SparkSession, sf: str) -> DataFrame:
    a, b = rmsd_sets(spark, sf)
    masked = measures.rmsd(a, b, where=sel.element("O") & (F.col("structure_id") % 5 != 1))
    return masked.select("structure_id", r("rmsd").alias("rmsd"))


CHAINS = """
    SELECT structure_id, chain_idx, min(chain_id) AS chain_id, min(residue_idx) AS first_residue, count(*) AS num_residues,
      min(first_atom) AS first_atom, CAST(sum(num_atoms) AS BIGINT) AS num_atoms,
      CASE WHEN count_if(residue_class = 'AminoAcid') > 0 AND count_if(residue_class = 'AminoAcid') >= count_if(residue_class = 'DeoxyNucleotide')
             THEN 'Protein' WHEN count_if(residue_class = 'DeoxyNucleotide') > 0 THEN 'Dna'
           WHEN count_if(residue_class = 'Water') > 0 AND count_if(residue_class = 'Other') = 0 THEN 'Water'
           WHEN count_if(residue_class = 'Other') > 0 THEN 'Ligand' ELSE 'Unknown' END AS kind
    FROM res_rows GROUP BY 1, 2"""


@query("e9_chain_kind", "SELECT structure_id, chain_idx, chain_id, kind FROM chains", "res_rows", extra={"chains": CHAINS})
def chain_kind(spark: SparkSession, sf: str) -> DataFrame:
    chains = assemble.chain_table(assemble.residue_table(fx.numbered(spark, sf)))
    return chains.select("structure_id", "chain_idx", "chain_id", "kind")


@query("e10_chain_sequence", """
    SELECT structure_id, chain_idx, string_agg(letter, '' ORDER BY residue_idx) AS sequence FROM res_rows GROUP BY 1, 2""", "res_rows")
def chain_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.chain_sequences(assemble.residue_table(fx.numbered(spark, sf)))


@query("e11_structure_summary", """
    SELECT structure_id, count(*) AS num_atoms, CAST(max(residue_idx) + 1 AS BIGINT) AS num_residues,
      CAST(max(chain_idx) + 1 AS BIGINT) AS num_chains, coalesce(any_value(n), 0) AS num_bonds
    FROM numbered LEFT JOIN (SELECT structure_id, count(*) AS n FROM bonds GROUP BY 1) USING (structure_id) GROUP BY 1""",
       "numbered", "res_rows", extra=BOND_VIEWS)
def structure_summary(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.numbered(spark, sf)
    return assemble.structure_summary(atoms, bonds(spark, sf, atoms))


@query("e12_span_rollup", """
    SELECT structure_id, chain_idx, first_residue, num_residues, first_atom, num_atoms FROM chains""", "res_rows",
       extra={"chains": CHAINS})
def span_rollup(spark: SparkSession, sf: str) -> DataFrame:
    chains = assemble.chain_table(assemble.residue_table(fx.numbered(spark, sf)))
    return chains.select("structure_id", "chain_idx", "first_residue", "num_residues", "first_atom", "num_atoms")


COMPOSITION = """
    SELECT structure_id, count_if(ss = 'Helix') AS num_helix, count_if(ss = 'Sheet') AS num_sheet, count_if(ss = 'Turn') AS num_turn,
      count_if(ss = 'Coil') AS num_coil FROM states GROUP BY 1"""


@query("e13_secondary_composition", COMPOSITION, "res_rows", "ranges", extra={"states": FILE_STATES})
def secondary_composition(spark: SparkSession, sf: str) -> DataFrame:
    residues = assemble.residue_table(fx.numbered(spark, sf))
    return measures.secondary_composition(assemble.apply_ranges(residues, fx.ranges(spark, sf)))


VOXEL = 2.5
FIELD = {
    "used": "SELECT *, vdw_radius AS r FROM enriched WHERE NOT is_water AND element <> 1",
    "extent": """
        SELECT structure_id, max(r) * 2.5 AS reach, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
          min(z) AS z0, max(z) AS z1 FROM used GROUP BY 1""",
    "lattice": f"""MATERIALIZED 
        SELECT structure_id, reach, voxel, x0 - reach AS ox, y0 - reach AS oy, z0 - reach AS oz,
          CAST(ceil((x1 - x0 + 2 * reach) / voxel) + 1 AS INTEGER) AS nx, CAST(ceil((y1 - y0 + 2 * reach) / voxel) + 1 AS INTEGER) AS ny,
          CAST(ceil((z1 - z0 + 2 * reach) / voxel) + 1 AS INTEGER) AS nz
        FROM (SELECT *, {VOXEL}::DOUBLE AS voxel FROM extent)""",
    "spread": """
        SELECT u.structure_id, ix, iy, iz, reach, r,
          (ox + ix * voxel - x) * (ox + ix * voxel - x) + (oy + iy * voxel - y) * (oy + iy * voxel - y)
            + (oz + iz * voxel - z) * (oz + iz * voxel - z) AS d2
        FROM used u JOIN lattice USING (structure_id),
          unnest(generate_series(greatest(0, CAST(ceil((x - reach - ox) / voxel) AS INTEGER)), least(nx - 1, CAST(floor((x + reach - ox) / voxel) AS INTEGER)))) AS gx(ix),
          unnest(generate_series(greatest(0, CAST(ceil((y - reach - oy) / voxel) AS INTEGER)), least(ny - 1, CAST(floor((y + reach - oy) / voxel) AS INTEGER)))) AS gy(iy),
          unnest(generate_series(greatest(0, CAST(ceil((z - reach - oz) / voxel) AS INTEGER)), least(nz - 1, CAST(floor((z + reach - oz) / voxel) AS INTEGER)))) AS gz(iz)""",
    "field": """MATERIALIZED 
        SELECT structure_id, ix, iy, iz, sum(exp(-2.3 * (d2 / (r * r) - 1))) AS density
        FROM spread WHERE d2 <= reach * reach GROUP BY 1, 2, 3, 4""",
}


def field_atoms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Atoms that add to the field, which need no order, and the lattice of each structure."""
    atoms = density.contributing(chemistry.enrich(fx.unordered_atoms(spark, sf)))
    return atoms, density.voxel_grid(atoms, VOXEL)


def field(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    atoms, lattice = field_atoms(spark, sf)
    return density.density_field(atoms, lattice), lattice


@query("e14_density_field", f"""
    SELECT structure_id, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, CAST(iz AS BIGINT) AS iz, {q('density', 5)} AS density
    FROM field""", "enriched", extra=FIELD)
def density_field(spark: SparkSession, sf: str) -> DataFrame:
    voxels, _ = field(spark, sf)
    return voxels.select("structure_id", *[F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz"],
                         r("density", 5).alias("density"))


@query("e15_inside_volume", f"""
    SELECT structure_id, count_if(density >= 0.5) AS inside_voxels, {q('count_if(density >= 0.5) * any_value(voxel) ** 3', 4)} AS volume
    FROM field JOIN lattice USING (structure_id) GROUP BY 1""", "enriched", extra=FIELD)
def inside_volume(spark: SparkSession, sf: str) -> DataFrame:
    voxels, lattice = field(spark, sf)
    return density.inside_volume(voxels, lattice).select("structure_id", "inside_voxels", r("volume", 4).alias("volume"))


@query("f15_iso_crossings", f"""
    SELECT structure_id, ax, ay, az, dx, dy, dz, {q('t', 4)} AS t, {q('ox + voxel * (ax + t * dx)', 4)} AS x,
      {q('oy + voxel * (ay + t * dy)', 4)} AS y, {q('oz + voxel * (az + t * dz)', 4)} AS z
    FROM (SELECT *, (0.5 - lo) / (hi - lo) AS t FROM (
      SELECT structure_id, least(ix, jx) AS ax, least(iy, jy) AS ay, least(iz, jz) AS az, dx, dy, dz,
        CASE WHEN up THEN density ELSE other END AS lo, CASE WHEN up THEN other ELSE density END AS hi
      FROM (SELECT l.*, coalesce(f.density, 0) AS other FROM looks l LEFT JOIN field f ON f.structure_id = l.structure_id
              AND f.ix = jx AND f.iy = jy AND f.iz = jz) WHERE other < 0.5)) JOIN lattice USING (structure_id)""", "enriched",
       extra={**FIELD, "looks": """
        SELECT i.structure_id, i.ix, i.iy, i.iz, i.density, dx, dy, dz, up,
          CASE WHEN up THEN i.ix + dx ELSE i.ix - dx END AS jx, CASE WHEN up THEN i.iy + dy ELSE i.iy - dy END AS jy,
          CASE WHEN up THEN i.iz + dz ELSE i.iz - dz END AS jz
        FROM field i JOIN lattice l ON l.structure_id = i.structure_id,
          (VALUES (1,0,0), (0,1,0), (0,0,1), (1,1,0), (1,0,1), (0,1,1), (1,1,1)) AS v(dx, dy, dz), (VALUES (true), (false)) AS w(up)
        WHERE i.density >= 0.5
          AND CASE WHEN up THEN i.ix + dx < nx AND i.iy + dy < ny AND i.iz + dz < nz
                   ELSE i.ix - dx >= 0 AND i.iy - dy >= 0 AND i.iz - dz >= 0 END"""})
def iso_crossings(spark: SparkSession, sf: str) -> DataFrame:
    found = density.crossings(*field_atoms(spark, sf))
    return found.select("structure_id", "ax", "ay", "az", "dx", "dy", "dz", *rr(["t", "x", "y", "z"], 4))


@query("e16_displacement_statistics", f"""
    SELECT structure_id, axis, {q('avg(step)')} AS mean_step, {q('avg(step * step)')} AS mean_square,
      {q('avg(CASE WHEN abs(step) <= sqrt(200.0) THEN 1.0 ELSE 0.0 END)')} AS within_sigma, {q('avg(step * step) / (2 * 0.5)')} AS diffusion
    FROM (UNPIVOT (SELECT structure_id, x - lag(x) OVER w AS x, y - lag(y) OVER w AS y, z - lag(z) OVER w AS z FROM snapshots
            WINDOW w AS (PARTITION BY structure_id, mol_id ORDER BY tick)) ON x, y, z INTO NAME axis VALUE step)
    GROUP BY 1, 2""", "snapshots")
def displacement_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = binding.displacement_statistics(fx.snapshots(spark, sf), dt=0.5, diffusion=200.0)
    return stats.select("structure_id", "axis", *rr(["mean_step", "mean_square", "within_sigma", "diffusion"]))


@query("e17_quality_report", """
    SELECT s_suppkey AS structure_id, num_atoms BETWEEN 300 + s_nationkey AND 480 + s_nationkey AS atoms_ok,
      coalesce(num_bonds, 0) > num_atoms * 0.8 AS bonds_ok,
      s_nationkey * 8 <= num_residues * 0.2 OR num_helix > num_residues * 0.15 AS helix_ok,
      s_nationkey * 6 <= num_residues * 0.15 OR num_sheet > num_residues * 0.10 AS sheet_ok
    FROM supplier JOIN (SELECT structure_id, count(*) AS num_atoms, max(residue_idx) + 1 AS num_residues FROM numbered GROUP BY 1) n
      ON n.structure_id = s_suppkey JOIN composition c ON c.structure_id = s_suppkey
    LEFT JOIN (SELECT structure_id, count(*) AS num_bonds FROM bonds GROUP BY 1) b ON b.structure_id = s_suppkey""",
       "numbered", "res_rows", "ranges", extra={**BOND_VIEWS, "states": FILE_STATES, "composition": COMPOSITION})
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    expected = fx.table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS structure_id", "300 + s_nationkey AS min_atoms", "480 + s_nationkey AS max_atoms",
        "s_nationkey * 8 AS file_helix", "s_nationkey * 6 AS file_sheet")
    atoms = fx.numbered(spark, sf)
    summary = assemble.structure_summary(atoms, bonds(spark, sf, atoms))
    states = assemble.apply_ranges(assemble.residue_table(atoms), fx.ranges(spark, sf))
    return measures.quality_report(summary, measures.secondary_composition(states), expected)


@query("e18_attribution_report", f"""
    SELECT attribution, count(*) AS num_structures FROM (SELECT CASE {ORIGIN} WHEN 'prediction' THEN '{identifiers.tables.PREDICTION_ATTRIBUTION}'
      WHEN 'archive' THEN '{identifiers.tables.ARCHIVE_ATTRIBUTION}' ELSE '' END AS attribution FROM orders) WHERE attribution <> '' GROUP BY 1""")
def attribution_report(spark: SparkSession, sf: str) -> DataFrame:
    texts = origins(spark, sf).withColumn("attribution", identifiers.attribution(F.col("source"), F.col("detected")))
    return measures.attribution_report(texts)
