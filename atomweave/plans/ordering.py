"""Queries of sections F, G, H, T and S: windows, exports, sets, trajectories, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import appearance, chemistry, selection as sel
from ..operators import assemble, backbone, binding, exports, secondary, trajectory
from ..session import fresh_path, stage
from ..streaming import binding as stream
from . import fixtures as fx
from .joining import (ANGLE, BACKBONE, BOND_VIEWS, CONTACT_VIEWS, TORSION, backbone as backbone_rows, bonds, bridge_views,
                      contacts)
from .projecting import bands_sql
from .registry import q, qq, query, r, rr

ID = ["structure_id", "atom_idx"]


@query("f1_run_numbering", """
    SELECT structure_id, CAST(line_no AS INTEGER) AS source_idx, atom_idx, residue_idx, chain_idx FROM numbered""", "numbered")
def run_numbering(spark: SparkSession, sf: str) -> DataFrame:
    return fx.numbered(spark, sf).select("structure_id", F.col("line_no").alias("source_idx"), "atom_idx", "residue_idx", "chain_idx")


@query("f2_centre_on_origin", f"""
    SELECT structure_id, atom_idx, {', '.join(q(f'{a} - (min({a}) OVER w + max({a}) OVER w) / 2') + f' AS {a}' for a in 'xyz')}
    FROM atoms WINDOW w AS (PARTITION BY structure_id)""", "atoms")
def centre_on_origin(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.centre_on_origin(fx.atoms(spark, sf)).select(*ID, *rr(["x", "y", "z"]))


@query("f3_backbone_gather", f"""
    SELECT structure_id, residue_idx, chain_idx, res_name, {qq(['ax', 'ay', 'az', 'ox', 'oy', 'oz'], 4)}, ox IS NOT NULL AS complete
    FROM chain_bb""", "backbone_atoms", extra=BACKBONE)
def backbone_gather(spark: SparkSession, sf: str) -> DataFrame:
    flat = [r(f"{atom}.{a}", 4).alias(f"{name}{a}") for atom, name in (("ca", "a"), ("o", "o")) for a in "xyz"]
    return backbone_rows(spark, sf).select("structure_id", "residue_idx", "chain_idx", "res_name", *flat, "complete")


@query("f4_amide_hydrogen", f"SELECT structure_id, residue_idx, {qq(['hx', 'hy', 'hz'], 4)} FROM donors", "backbone_atoms",
       extra=BACKBONE)
def amide_hydrogen(spark: SparkSession, sf: str) -> DataFrame:
    found = secondary.estimate_amide_h(backbone_rows(spark, sf)).where("h IS NOT NULL")
    return found.select("structure_id", "residue_idx", *[r(f"h.{a}", 4).alias(f"h{a}") for a in "xyz"])


def _torsion(points: list[str], condition: str) -> str:
    """Torsion of four points given by column prefixes, written out for SQL."""
    def minus(a: str, b: str, c: str) -> str:
        return f"({a}{c} - {b}{c})"
    a, b, c, d = points
    text = TORSION
    for axis in "xyz":
        text = text.replace(f"u{axis}", f"@u{axis}").replace(f"v{axis}", f"@v{axis}").replace(f"w{axis}", f"@w{axis}")
    u = {x: minus(b, a, x) for x in "xyz"}
    v = {x: minus(c, b, x) for x in "xyz"}
    w = {x: minus(d, c, x) for x in "xyz"}
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    for axis, (p, s) in cross.items():
        text = text.replace(f"m{axis}", f"({u[p]}*{v[s]} - {u[s]}*{v[p]})").replace(
            f"n{axis}", f"({v[p]}*{w[s]} - {v[s]}*{w[p]})")
    for axis in "xyz":
        text = text.replace(f"@v{axis}", v[axis]).replace(f"@w{axis}", w[axis]).replace(f"@u{axis}", u[axis])
    return f"CASE WHEN {condition} THEN {text.replace('vl', 'sqrt(' + ' + '.join(f'{v[x]}*{v[x]}' for x in 'xyz') + ')')} END"


TORSION_ROWS = """
    SELECT structure_id, residue_idx, chain_idx, nx AS N0x, ny AS N0y, nz AS N0z, ax AS A0x, ay AS A0y, az AS A0z,
      cx AS C0x, cy AS C0y, cz AS C0z, lag(chain_idx) OVER w AS before, lead(chain_idx) OVER w AS after,
      lag(ax) OVER w AS APx, lag(ay) OVER w AS APy, lag(az) OVER w AS APz, lag(cx) OVER w AS CPx, lag(cy) OVER w AS CPy,
      lag(cz) OVER w AS CPz, lead(nx) OVER w AS NFx, lead(ny) OVER w AS NFy, lead(nz) OVER w AS NFz
    FROM chain_bb WINDOW w AS (PARTITION BY structure_id ORDER BY residue_idx)"""


@query("f5_torsion_series", f"""
    SELECT structure_id, residue_idx, chain_idx, {q(_torsion(['CP', 'N0', 'A0', 'C0'], 'before = chain_idx'), 3)} AS phi,
      {q(_torsion(['N0', 'A0', 'C0', 'NF'], 'after = chain_idx'), 3)} AS psi,
      {q('abs(' + _torsion(['AP', 'CP', 'N0', 'A0'], 'before = chain_idx') + ')', 3)} AS omega FROM rows_t""", "backbone_atoms",
       extra={**BACKBONE, "rows_t": TORSION_ROWS})
def torsion_series(spark: SparkSession, sf: str) -> DataFrame:
    found = secondary.torsions(backbone_rows(spark, sf)).withColumn("omega", F.abs("omega"))
    return found.select("structure_id", "residue_idx", "chain_idx", *rr(["phi", "psi", "omega"], 3))


@query("f6_two_best_acceptors", f"SELECT structure_id, nh, co, {q('energy')} AS energy, CAST(rank AS INTEGER) AS rank FROM best", "best")
def two_best_acceptors(spark: SparkSession, sf: str) -> DataFrame:
    best = secondary.best_two(fx.bond_edges(spark, sf))
    return best.select("structure_id", "nh", "co", r("energy").alias("energy"), "rank")


TURNS = "SELECT DISTINCT structure_id, nh - co AS n, co AS i FROM {} WHERE same_chain AND nh - co IN (3, 4, 5)"


@query("f7_turns", """
    SELECT t.structure_id, CAST(t.n AS INTEGER) AS n, CAST(t.i AS INTEGER) AS i,
      EXISTS (SELECT 1 FROM turns p WHERE p.structure_id = t.structure_id AND p.n = t.n AND p.i = t.i - 1) AS starts_helix
    FROM turns t""", "bond_edges", extra={"turns": TURNS.format("bond_edges")})
def turn_patterns(spark: SparkSession, sf: str) -> DataFrame:
    turns = secondary.turns(fx.bond_edges(spark, sf))
    starts = secondary.helix_starts(turns).withColumn("starts_helix", F.lit(True))
    return (turns.join(starts, ["structure_id", "n", "i"], "left")
            .select("structure_id", "n", "i", F.coalesce("starts_helix", F.lit(False)).alias("starts_helix")))


def state_views(edges: str) -> dict[str, str]:
    """States marked in order of precedence, from turns and bridges."""
    return {
        "turns": TURNS.format(edges),
        "starts": """SELECT t.structure_id, t.n, t.i FROM turns t JOIN turns p ON p.structure_id = t.structure_id AND p.n = t.n
                     AND p.i = t.i - 1""",
        **bridge_views(edges),
        "marks": """
            SELECT structure_id, unnest(generate_series(i, i + n - 1)) AS residue_idx, CASE n WHEN 4 THEN 1 ELSE 3 END AS level FROM starts
            UNION ALL SELECT structure_id, unnest(generate_series(i + 1, i + n - 1)), 4 FROM turns
            UNION ALL SELECT structure_id, i, 2 FROM bridged UNION ALL SELECT structure_id, j, 2 FROM bridged""",
    }


STATE = "CASE min(level) WHEN 1 THEN 'Helix' WHEN 2 THEN 'Sheet' WHEN 3 THEN 'Helix' WHEN 4 THEN 'Turn' ELSE 'Coil' END"
CHAIN_BEST = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, nh ORDER BY energy, co) AS rank FROM hbonds) WHERE rank <= 2"""


@query("f8_secondary_states", f"""
    SELECT r.structure_id, r.residue_idx, {STATE} AS ss FROM chain_bb r LEFT JOIN marks m USING (structure_id, residue_idx) GROUP BY 1, 2""",
       "backbone_atoms", extra={**BACKBONE, "chain_best": CHAIN_BEST, **state_views("chain_best")})
def secondary_states(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.backbone_atoms(spark, sf)
    residues = atoms.select("structure_id", "residue_idx").distinct()
    return secondary.compute(atoms, residues).select("structure_id", "residue_idx", "ss")


@query("f8_states_with_bridges", f"""
    SELECT r.structure_id, r.residue_idx, {STATE} AS ss FROM
      (SELECT DISTINCT l_suppkey AS structure_id, unnest(generate_series(0, 199)) AS residue_idx FROM lineitem) r
    LEFT JOIN marks m USING (structure_id, residue_idx) GROUP BY 1, 2""", "best", extra=state_views("best"))
def states_with_bridges(spark: SparkSession, sf: str) -> DataFrame:
    edges = fx.bond_edges(spark, sf)
    residues = (fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("structure_id")).distinct()
                .withColumn("residue_idx", F.explode(F.sequence(F.lit(0), F.lit(199)))))
    whole = residues.withColumn("complete", F.lit(True))
    return secondary.assign(residues, whole, secondary.best_two(edges)).select("structure_id", "residue_idx", "ss")


GUIDES = {
    "anchors": "SELECT *, ax AS x, ay AS y, az AS z FROM chain_bb",
    "gaps": """
        SELECT *, CASE WHEN lag(x) OVER w IS NOT NULL AND (x-lag(x) OVER w)*(x-lag(x) OVER w) + (y-lag(y) OVER w)*(y-lag(y) OVER w)
          + (z-lag(z) OVER w)*(z-lag(z) OVER w) > 25 THEN 1 ELSE 0 END AS gap
        FROM anchors WINDOW w AS (PARTITION BY structure_id, chain_idx ORDER BY residue_idx)""",
    "cut": """
        SELECT *, sum(gap) OVER (PARTITION BY structure_id, chain_idx ORDER BY residue_idx ROWS UNBOUNDED PRECEDING) AS segment FROM gaps""",
    "guides": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY structure_id, chain_idx, segment ORDER BY residue_idx) - 1 AS seq,
          count(*) OVER (PARTITION BY structure_id, chain_idx, segment) AS num_points FROM cut) WHERE num_points >= 2""",
}
SEGMENT = ["structure_id", "chain_idx", "segment"]


def guides(spark: SparkSession, sf: str) -> DataFrame:
    """Guide points; every thirtieth customer's residue is left out so that chains have gaps."""
    atoms = fx.backbone_atoms(spark, sf)
    chains = atoms.select("structure_id", "chain_idx").distinct().withColumn("kind", F.lit("Protein"))
    return backbone.segments(backbone.anchors(atoms), chains)


@query("f9_backbone_segments", """
    SELECT structure_id, chain_idx, residue_idx, CAST(segment AS BIGINT) AS segment, seq, num_points FROM guides""", "backbone_atoms",
       extra={**BACKBONE, **GUIDES})
def backbone_segments(spark: SparkSession, sf: str) -> DataFrame:
    return guides(spark, sf).select(*SEGMENT, "residue_idx", "seq", "num_points")


def _catmull(a: str) -> str:
    p0, p1, p2, p3 = (f"{p}{a}" for p in ("p0", "p1", "p2", "p3"))
    return (f"0.5 * (2 * {p1} + ({p2} - {p0}) * t + (2 * {p0} - 5 * {p1} + 4 * {p2} - {p3}) * t * t "
            f"+ (3 * {p1} - {p0} - 3 * {p2} + {p3}) * t * t * t)")


def _tangent(a: str) -> str:
    p0, p1, p2, p3 = (f"{p}{a}" for p in ("p0", "p1", "p2", "p3"))
    return (f"0.5 * (({p2} - {p0}) + 2 * (2 * {p0} - 5 * {p1} + 4 * {p2} - {p3}) * t "
            f"+ 3 * (3 * {p1} - {p0} - 3 * {p2} + {p3}) * t * t)")


SPANS = ", ".join(
    f"coalesce(lag({a}) OVER w, {a}) AS p0{a}, {a} AS p1{a}, lead({a}) OVER w AS p2{a}, "
    f"coalesce(lead({a}, 2) OVER w, lead({a}) OVER w) AS p3{a}" for a in "xyz")


@query("f10_curve_resampling", f"""
    SELECT structure_id, chain_idx, CAST(segment AS BIGINT) AS segment, seq * 4 + step AS point, {', '.join(q(f'({_catmull(a)}) + 0.0000013', 4) + f' AS {a}' for a in 'xyz')},
      {', '.join(q(f'({_tangent(a)}) / sqrt(' + ' + '.join(f'({_tangent(b)}) * ({_tangent(b)})' for b in 'xyz') + ')', 4) + f' AS forward_{a}' for a in 'xyz')},
      CASE WHEN t < 0.5 THEN residue_idx ELSE next_residue END AS residue_idx, {q('(seq + t) / (num_points - 1)')} AS alpha
    FROM (SELECT *, step / 4.0::DOUBLE AS t FROM (SELECT *, {SPANS}, lead(residue_idx) OVER w AS next_residue FROM guides
            WINDOW w AS (PARTITION BY structure_id, chain_idx, segment ORDER BY seq)),
          unnest(generate_series(0, CASE WHEN seq = num_points - 2 THEN 4 ELSE 3 END)) AS g(step) WHERE seq < num_points - 1)""",
       "backbone_atoms", extra={**BACKBONE, **GUIDES})
def curve_resampling(spark: SparkSession, sf: str) -> DataFrame:
    points = backbone.resample(guides(spark, sf), steps=4)
    return points.select(*SEGMENT, "point", *[r(F.col(a) + 0.0000013, 4).alias(a) for a in "xyz"],
                         *rr(["forward_x", "forward_y", "forward_z"], 4), "residue_idx",
                         r("alpha").alias("alpha"))


P_BIND, P_UNBIND, DT = 2.0, 0.3, 0.5
EVENTS = {
    **CONTACT_VIEWS,
    "events_b": f"""
        SELECT *, coalesce(radius_sum > 0 AND d2 <= radius_sum * radius_sum AND roll < 1 - exp(-{P_BIND} * {DT}), false) AS b,
          roll < 1 - exp(-{P_UNBIND} * {DT}) AS u FROM contacts""",
    "ticks": """
        SELECT *, row_number() OVER (PARTITION BY structure_id, mol_id ORDER BY tick) AS n FROM events_b""",
    "walk": """
        SELECT structure_id, mol_id, tick, n, b AS bound, CASE WHEN b THEN partner_id END AS bound_to FROM ticks WHERE n = 1
        UNION ALL
        SELECT t.structure_id, t.mol_id, t.tick, t.n, CASE WHEN w.bound THEN NOT t.u ELSE t.b END,
          CASE WHEN w.bound THEN CASE WHEN NOT t.u THEN w.bound_to END ELSE CASE WHEN t.b THEN t.partner_id END END
        FROM walk w JOIN ticks t ON t.structure_id = w.structure_id AND t.mol_id = w.mol_id AND t.n = w.n + 1""",
}


def decided(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """What would happen to each molecule at each tick; staged with the columns that are read."""
    found = binding.decisions(contacts(spark, sf), P_BIND, P_UNBIND, DT)
    return stage(found.select("structure_id", "mol_id", "tick", *more, "bind", "unbind"), "decisions")


@query("f11_binding_episodes", "SELECT structure_id, mol_id, tick, bound FROM walk", "snapshots", extra=EVENTS)
def binding_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return binding.binding_states(decided(spark, sf)).select("structure_id", "mol_id", "tick", "bound")


@query("e19_bound_counts", "SELECT structure_id, tick, count_if(bound) AS num_bound FROM walk GROUP BY 1, 2", "snapshots", extra=EVENTS)
def bound_counts(spark: SparkSession, sf: str) -> DataFrame:
    return binding.bound_counts(binding.binding_states(decided(spark, sf)))


@query("e20_band_population", f"""
    SELECT structure_id, tick, {bands_sql(10, 15, 22)} AS band, count(*) AS num_molecules FROM snapshots GROUP BY ALL""", "snapshots")
def band_population(spark: SparkSession, sf: str) -> DataFrame:
    return binding.band_population(binding.with_bands(fx.snapshots(spark, sf), (20, 18, 20), 10, 15, 22))


@query("f12_side_vectors", """
    SELECT structure_id, chain_idx, CAST(segment AS BIGINT) AS segment, seq, """ + qq(["rx", "ry", "rz"], 4) + """ FROM turned""", "backbone_atoms",
       extra={**BACKBONE, **GUIDES, "walked": """
        SELECT *, ox - cx AS kx, oy - cy AS ky, oz - cz AS kz,
          coalesce(lead(x) OVER w - x, x - lag(x) OVER w) AS fx, coalesce(lead(y) OVER w - y, y - lag(y) OVER w) AS fy,
          coalesce(lead(z) OVER w - z, z - lag(z) OVER w) AS fz
        FROM guides WINDOW w AS (PARTITION BY structure_id, chain_idx, segment ORDER BY seq)""", "crossed": """
        SELECT structure_id, chain_idx, segment, seq, ux, uy, uz, sx / sl AS sx, sy / sl AS sy, sz / sl AS sz FROM (
          SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS sl FROM (
            SELECT *, uy * kz - uz * ky AS sx, uz * kx - ux * kz AS sy, ux * ky - uy * kx AS sz FROM (
              SELECT *, fx / fl AS ux, fy / fl AS uy, fz / fl AS uz FROM (SELECT *, sqrt(fx * fx + fy * fy + fz * fz) AS fl FROM walked))))""",
              "turned": """
        SELECT structure_id, chain_idx, segment, seq, rx / rl AS rx, ry / rl AS ry, rz / rl AS rz FROM (
          SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS rl FROM (
            SELECT *, coalesce(sx, 0 - uz * ux) AS rx, coalesce(sy, 0 - uz * uy) AS ry, coalesce(sz, 1 - uz * uz) AS rz
            FROM crossed WHERE seq = 0))
        UNION ALL
        SELECT structure_id, chain_idx, segment, seq, g * rx / rl, g * ry / rl, g * rz / rl FROM (
          SELECT *, CASE WHEN rx * px + ry * py + rz * pz < 0 THEN -1 ELSE 1 END AS g, sqrt(rx * rx + ry * ry + rz * rz) AS rl FROM (
            SELECT c.*, t.rx AS px, t.ry AS py, t.rz AS pz,
              coalesce(c.sx, t.rx - c.ux * (t.rx * c.ux + t.ry * c.uy + t.rz * c.uz)) AS rx,
              coalesce(c.sy, t.ry - c.uy * (t.rx * c.ux + t.ry * c.uy + t.rz * c.uz)) AS ry,
              coalesce(c.sz, t.rz - c.uz * (t.rx * c.ux + t.ry * c.uy + t.rz * c.uz)) AS rz
            FROM turned t JOIN crossed c ON c.structure_id = t.structure_id AND c.chain_idx = t.chain_idx AND c.segment = t.segment
              AND c.seq = t.seq + 1))"""})
def side_vectors(spark: SparkSession, sf: str) -> DataFrame:
    oriented = backbone.orient(guides(spark, sf))
    return oriented.select(*SEGMENT, "seq", *[r(f"right.{a}", 4).alias(f"r{a}") for a in "xyz"])


@query("f13_smoothing", f"""
    SELECT user_id, seq, {q('CASE WHEN num_rows < 3 THEN value ELSE (w1 + w2 + value + w4 + w5) / 5 END')} AS value_smooth FROM (
      SELECT *, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS w1, coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS w2,
        coalesce(lead(value, 1) OVER w, tail) AS w4, coalesce(lead(value, 2) OVER w, tail) AS w5
      FROM (SELECT *, last_value(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail
            FROM series) WINDOW w AS (PARTITION BY user_id ORDER BY seq))""", "series")
def smoothing(spark: SparkSession, sf: str) -> DataFrame:
    smooth = backbone.smooth(fx.series(spark, sf), ["user_id"], "seq", "num_rows", ["value"])
    return smooth.select("user_id", "seq", r("value_smooth").alias("value_smooth"))


@query("f14_run_end_taper", f"""
    SELECT s.user_id, s.seq, {q('CASE WHEN s.flag AND head IS NOT NULL THEN 0.05 + 1.55 * (head - s.seq) / 7 END')} AS taper
    FROM series s LEFT JOIN (SELECT a.user_id, a.seq, max(e.seq) AS head FROM series a JOIN
      (SELECT *, lead(flag) OVER (PARTITION BY user_id ORDER BY seq) AS next FROM series) e
      ON e.user_id = a.user_id AND e.flag AND NOT coalesce(e.next, false) AND e.seq BETWEEN a.seq AND a.seq + 7 GROUP BY 1, 2) h
    ON h.user_id = s.user_id AND h.seq = s.seq""", "series")
def run_end_taper(spark: SparkSession, sf: str) -> DataFrame:
    tapered = backbone.taper(fx.series(spark, sf), ["user_id"], "seq", "flag")
    return tapered.select("user_id", "seq", r("taper").alias("taper"))


# --------------------------------------------------------------------------- exports and sets

@query("g1_nearest_k_full_detail", f"""
    SELECT structure_id, tick, mol_id, CASE WHEN band = 'Full' AND n > 2 THEN 'Backbone' ELSE band END AS band FROM (
      SELECT *, row_number() OVER (PARTITION BY structure_id, tick, band ORDER BY d2, mol_id) AS n FROM (
        SELECT *, {bands_sql(10, 15, 22)} AS band, (x-20)*(x-20) + (y-18)*(y-18) + (z-20)*(z-20) AS d2 FROM snapshots))""", "snapshots")
def nearest_k_full_detail(spark: SparkSession, sf: str) -> DataFrame:
    banded = binding.with_bands(fx.snapshots(spark, sf), (20, 18, 20), 10, 15, 22)
    return binding.limit_full_detail(banded, 2).select("structure_id", "tick", "mol_id", "band")


@query("g2_even_thinning", """
    SELECT structure_id, atom_idx, n AS num_before_limit FROM (
      SELECT *, row_number() OVER (PARTITION BY structure_id ORDER BY atom_idx) - 1 AS r, count(*) OVER (PARTITION BY structure_id) AS n
      FROM enriched WHERE NOT is_water) WHERE n <= 150 OR r IN (SELECT (i * n) // 150 FROM generate_series(0, 149) AS g(i))""", "enriched")
def even_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return exports.thin_atoms(fx.enriched(spark, sf).where(~sel.water()), 150).select(*ID, "num_before_limit")


@query("g3_point_export", f"""
    SELECT structure_id, atom_idx, x * 10 AS px, y * 10 AS py, z * 10 AS pz, {q('vdw_radius * 0.25 * 10')} AS radius,
      printf('#%02X%02X%02X', red, green, blue) AS colour FROM enriched JOIN (SELECT atomic_number, red, green, blue FROM elements)
      ON atomic_number = element WHERE NOT is_water""", "enriched")
def point_export(spark: SparkSession, sf: str) -> DataFrame:
    atoms = chemistry.with_elements(fx.enriched(spark, sf).where(sel.drawn("BallAndStick")), ("red", "green", "blue"))
    colour = appearance.element_colour(F.col("red"), F.col("green"), F.col("blue"))
    return exports.point_table(atoms, 10.0, appearance.RADIUS_FACTORS["BallAndStick"], colour).withColumn("radius", r("radius"))


@query("g4_bond_export", f"""
    SELECT structure_id, atom_a, atom_b, half, CASE half WHEN 1 THEN ca ELSE cb END AS colour,
      {', '.join(f"CASE half WHEN 1 THEN m_{x} * 10 ELSE (m_{x} + n_{x}) * 5 END AS start_{x}, CASE half WHEN 1 THEN (m_{x} + n_{x}) * 5 ELSE n_{x} * 10 END AS end_{x}" for x in 'xyz')}
    FROM (SELECT b.*, m.element AS ca, n.element AS cb, {', '.join(f'm.{x} AS m_{x}, n.{x} AS n_{x}' for x in 'xyz')} FROM bonds b
      JOIN numbered m ON m.structure_id = b.structure_id AND m.atom_idx = atom_a
      JOIN numbered n ON n.structure_id = b.structure_id AND n.atom_idx = atom_b) CROSS JOIN (VALUES (1), (2)) AS h(half)""",
       "numbered", "res_rows", extra=BOND_VIEWS)
def bond_export(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.numbered(spark, sf)
    return exports.bond_table(bonds(spark, sf, atoms), atoms.withColumn("colour", F.col("element")), 10.0)


@query("h1_selection_algebra", """
    SELECT structure_id, atom_idx FROM enriched WHERE NOT ((element = 6 OR chain_id = 'A') AND NOT is_hetatm)""", "enriched")
def selection_algebra(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.enriched(spark, sf)

    def chosen(predicate) -> DataFrame:
        return atoms.where(predicate).select(*ID)

    either = exports.union_of(chosen(sel.element("C")), chosen(sel.chain("A")))
    both = exports.intersection_of(either, chosen(~sel.hetero()))
    return exports.complement_of(atoms.select(*ID), both)


@query("h2_canonical_pairs", """
    SELECT DISTINCT structure_id, least(nh, co) AS low, greatest(nh, co) AS high FROM bond_edges WHERE abs(nh - co) >= 3""", "bond_edges")
def canonical_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return exports.canonical_pairs(fx.bond_edges(spark, sf), "nh", "co", min_gap=3)


# --------------------------------------------------------------------------- trajectories

def whole_frames(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.only_complete(fx.frames(spark, sf), fx.frame_sizes(spark, sf))


SAMPLED = {"asked": """
    SELECT r.*, greatest(0, least(t, last)) AS at_t, last FROM requests r
    JOIN (SELECT traj_id, max(frame) AS last FROM whole GROUP BY 1) USING (traj_id)"""}


@query("t1_blended_sampling", f"""
    SELECT q.traj_id, q.request_id, CAST(a.atom_idx AS INTEGER) AS atom_idx,
      {', '.join(q(f'a.{x} + (b.{x} - a.{x}) * (at_t - floor(at_t))') + f' AS {x}' for x in 'xyz')}
    FROM asked q JOIN whole a ON a.traj_id = q.traj_id AND a.frame = floor(at_t)
    JOIN whole b ON b.traj_id = q.traj_id AND b.frame = least(floor(at_t) + 1, last) AND b.atom_idx = a.atom_idx""",
       "whole", "requests", extra=SAMPLED)
def blended_sampling(spark: SparkSession, sf: str) -> DataFrame:
    sampled = trajectory.sample(fx.requests(spark, sf), whole_frames(spark, sf))
    return sampled.select("traj_id", "request_id", "atom_idx", *rr(["x", "y", "z"]))


@query("t2_nearest_frame", """
    SELECT q.traj_id, q.request_id, CAST(a.frame AS BIGINT) AS frame, a.atom_idx, a.x, a.y, a.z
    FROM asked q JOIN whole a ON a.traj_id = q.traj_id AND a.frame = floor(at_t + 0.5)""", "whole", "requests", extra=SAMPLED)
def nearest_frame(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.sample_nearest(fx.requests(spark, sf), whole_frames(spark, sf))


@query("t3_frame_clock", f"""
    SELECT event_id, {q('ft')} AS frame_time, {q('ft / (n - 1)', 8)} AS normalised, {q('greatest(0, least(1, ft / (n - 1) * 1.5)) * (n - 1)')} AS back
    FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN CASE WHEN value * 2.5 >= n - 1 THEN fmod(value * 2.5, n - 1) ELSE value * 2.5 END
                    ELSE least(value * 2.5, n - 1) END AS ft FROM (SELECT *, (user_id % 30 + 2)::DOUBLE AS n FROM events))""")
def frame_clock(spark: SparkSession, sf: str) -> DataFrame:
    clock = fx.table(spark, sf, "events").selectExpr("event_id", "value", "user_id % 2 = 0 AS loop", "user_id % 30 + 2 AS n")
    timed = clock.withColumn("frame_time", trajectory.frame_time(F.col("value"), 2.5, F.col("n"), F.col("loop")))
    share = trajectory.normalised_time(F.col("frame_time"), F.col("n"))
    return timed.select("event_id", r("frame_time").alias("frame_time"), r(share, 8).alias("normalised"),
                        r(trajectory.time_of_share(share * 1.5, F.col("n"))).alias("back"))


@query("t4_frame_lookup", "SELECT traj_id, frame, atom_idx, x, y, z FROM frames WHERE frame = 7 AND atom_idx = 3", "frames")
def frame_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.lookup(fx.frames(spark, sf), 7, 3)


@query("t5_trajectory_summary", f"""
    SELECT traj_id, count(DISTINCT frame) AS num_frames, 20::BIGINT AS num_atoms, {q('0.002::DOUBLE * (count(DISTINCT frame) - 1)')} AS duration_ps
    FROM whole GROUP BY 1""", "whole")
def trajectory_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = trajectory.summary(fx.frames(spark, sf), fx.frame_sizes(spark, sf), 0.002)
    return found.withColumn("duration_ps", r("duration_ps"))


@query("t6_frame_bounds", f"""
    SELECT traj_id, frame, {', '.join(f'min({a}) AS min_{a}, max({a}) AS max_{a}' for a in 'xyz')} FROM frames GROUP BY 1, 2""", "frames")
def frame_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.frame_bounds(fx.frames(spark, sf))


@query("t7_frame_series", f"""
    SELECT f.traj_id, f.frame, {q('sqrt(avg((f.x-p.x)*(f.x-p.x) + (f.y-p.y)*(f.y-p.y) + (f.z-p.z)*(f.z-p.z)))')} AS rmsd,
      {q('sqrt(var_pop(f.x) + var_pop(f.y) + var_pop(f.z))')} AS gyration
    FROM whole f JOIN whole p ON p.traj_id = f.traj_id AND p.atom_idx = f.atom_idx AND p.frame = 0 GROUP BY 1, 2""", "whole")
def frame_series(spark: SparkSession, sf: str) -> DataFrame:
    return trajectory.frame_series(whole_frames(spark, sf)).select("traj_id", "frame", *rr(["rmsd", "gyration"]))


@query("t8_box_lengths", """
    SELECT DISTINCT traj_id, CAST(frame AS BIGINT) AS frame, 60.0::DOUBLE + frame AS a, 70.0::DOUBLE + frame AS b, 80.0::DOUBLE + frame AS c
    FROM whole WHERE traj_id % 10 <> 9 AND frame % 2 = 0 AND frame < 20""", "whole")
def box_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten of every second frame of a trajectory; each of its files is read as far as it can hold them."""
    from .reading import FILE_FRAMES, open_trajectories
    stride, most = 2, 10  # the stride divides FILE_FRAMES, so a file's frames are the trajectory's
    cells = open_trajectories(spark, sf, "cells", stride=stride, maxFrames=most)
    frame = F.col("part") * FILE_FRAMES + F.col("frame")
    return cells.where(frame < stride * most).select("traj_id", frame.alias("frame"), "a", "b", "c")


# --------------------------------------------------------------------------- streaming

@query("s1_binding_stream", "SELECT structure_id, mol_id, tick, bound, bound_to FROM walk", "snapshots", extra=EVENTS)
def binding_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Contact rows land in spans of later and later ticks; each span is processed when it has landed."""
    rows = decided(spark, sf, "partner_id")
    landed, target = fresh_path(spark, "contact-stream"), fresh_path(spark, "binding-states")
    checkpoint = fresh_path(spark, "binding-checkpoint")
    for low, high in ((None, 10), (10, 20), (20, None)):
        part = rows if low is None else rows.where(F.col("tick") >= low)
        part = part if high is None else part.where(F.col("tick") < high)
        part.write.mode("append").parquet(landed)
        stream.run_available(spark, landed, rows.schema, target, checkpoint)
    states = spark.read.schema(stream.OUTPUT).parquet(target)
    return states.select("structure_id", "mol_id", "tick", "bound", "bound_to")
