"""Queries of sections B and C: row expressions and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import appearance, chemistry, dynamics, identifiers, selection as sel, tables
from ..operators import assemble, neighbours, secondary
from . import fixtures as fx
from .registry import q, query, r

ID = ["structure_id", "atom_idx"]

SYMBOL_TEXT = "[' c ', 'Ca', 'CL1', 'fe', 'X', 'Zn', '', 'QQ', ' n', 'Uuo', 'hg', 'D'][{} % 12 + 1]"


@query("b1_symbol_to_number", f"""
    SELECT p_partkey, coalesce(a.atomic_number, b.atomic_number, 0) AS element
    FROM (SELECT p_partkey, upper(trim(CASE WHEN p_partkey % 2 = 0 THEN {SYMBOL_TEXT.format('p_size')} ELSE p_name END)) AS s FROM part) p
    LEFT JOIN elements a ON a.atomic_number > 0 AND upper(a.symbol) = substr(s, 1, 2)
    LEFT JOIN elements b ON b.atomic_number > 0 AND upper(b.symbol) = substr(s, 1, 1)""", "elements")
def symbol_to_number(spark: SparkSession, sf: str) -> DataFrame:
    texts = fx.table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_partkey % 2 = 0 THEN element_at(array(' c ', 'Ca', 'CL1', 'fe', 'X', 'Zn', '', 'QQ', "
        "' n', 'Uuo', 'hg', 'D'), CAST(p_size % 12 + 1 AS INT)) ELSE p_name END AS symbol")
    return chemistry.with_number_from_symbol(texts, "symbol").select("p_partkey", "element")


@query("b2_name_to_number", """
    SELECT l_orderkey, l_partkey, l_linenumber, hetatm, l_quantity, l_extendedprice,
      coalesce(CASE WHEN NOT lead AND (hetatm OR length(n) < 2) THEN a.atomic_number END, b.atomic_number, 0) AS element
    FROM (SELECT *, regexp_matches(n, '^[\\s0-9]') AND length(n) >= 2 AS lead FROM
           (SELECT *, l_returnflag = 'R' AS hetatm,
              [' CA ', 'FE  ', 'HG11', '1HB ', ' N', 'ZN', 'C', ' SG ', 'CL', 'MG  '][l_partkey % 10 + 1] AS n FROM lineitem))
    LEFT JOIN elements a ON a.atomic_number > 0 AND upper(a.symbol) = trim(substr(n, 1, 2))
    LEFT JOIN elements b ON b.atomic_number > 0 AND upper(b.symbol) = CASE WHEN lead THEN substr(n, 2, 1) ELSE substr(n, 1, 1) END""",
       "elements")
def name_to_number(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag = 'R' AS hetatm",
        "element_at(array(' CA ', 'FE  ', 'HG11', '1HB ', ' N', 'ZN', 'C', ' SG ', 'CL', 'MG  '), "
        "CAST(l_partkey % 10 + 1 AS INT)) AS name")
    return chemistry.with_number_from_name(names, "name", "hetatm", "element").drop("name")


@query("b3_atom_flags", """
    SELECT structure_id, atom_idx, is_hetatm, is_backbone, is_anchor, is_secondary_altloc, is_water,
      CAST(is_hetatm AS INTEGER) + 2 * CAST(is_backbone AS INTEGER) + 4 * CAST(is_anchor AS INTEGER)
      + 8 * CAST(is_secondary_altloc AS INTEGER) + 16 * CAST(is_water AS INTEGER) AS flags FROM enriched""", "enriched")
def atom_flags(spark: SparkSession, sf: str) -> DataFrame:
    return fx.enriched(spark, sf).select(*ID, *chemistry.FLAG_BITS, "flags")


@query("b4_drawn_radius", f"""
    SELECT structure_id, atom_idx, representation, {q('vdw_radius * factor')} AS radius FROM enriched CROSS JOIN
      (VALUES ('SpaceFilling', 1.0::DOUBLE), ('BallAndStick', 0.25::DOUBLE), ('Cartoon', 0.35::DOUBLE)) AS v(representation, factor)""",
       "enriched")
def drawn_radius(spark: SparkSession, sf: str) -> DataFrame:
    kinds = fx.enriched(spark, sf).withColumn(
        "representation", F.explode(F.array(*map(F.lit, ("SpaceFilling", "BallAndStick", "Cartoon")))))
    return kinds.select(*ID, "representation", r(F.col("vdw_radius") * appearance.radius_factor(
        F.col("representation"))).alias("radius"))


@query("b5_element_colour", """
    SELECT structure_id, atom_idx, printf('#%02X%02X%02X', red, green, blue) AS colour, '#FFFFFF' AS uniform
    FROM atoms JOIN elements ON atomic_number = element""", "atoms", "elements")
def element_colour(spark: SparkSession, sf: str) -> DataFrame:
    coloured = chemistry.with_elements(fx.atoms(spark, sf), ("red", "green", "blue"))
    return coloured.select(*ID, appearance.element_colour(F.col("red"), F.col("green"), F.col("blue")).alias("colour"),
                           F.lit("#FFFFFF").alias("uniform"))


@query("b6_chain_hue", f"""
    SELECT structure_id, chain_idx, {q('(t - floor(t)) * 360')} AS hue
    FROM (SELECT DISTINCT structure_id, chain_idx, chain_idx * {tables.GOLDEN_CONJUGATE}::DOUBLE AS t FROM numbered)""",
       "numbered")
def chain_hue(spark: SparkSession, sf: str) -> DataFrame:
    chains = fx.numbered(spark, sf).select("structure_id", "chain_idx").distinct()
    return chains.select("structure_id", "chain_idx", r(appearance.chain_hue(F.col("chain_idx"))).alias("hue"))


@query("b7_secondary_colour", """
    SELECT ordinal, CASE kind WHEN 'Helix' THEN '#E8355C' WHEN 'Sheet' THEN '#FFC107' WHEN 'Turn' THEN '#64B5F6'
      ELSE '#BDBDBD' END AS colour FROM (SELECT ordinal, CASE WHEN ordinal % 9 = 0 THEN 'Coil' ELSE kind END AS kind FROM ranges)""",
       "ranges")
def secondary_colour(spark: SparkSession, sf: str) -> DataFrame:
    kinds = fx.ranges(spark, sf).withColumn("kind", F.when(F.col("ordinal") % 9 == 0, "Coil").otherwise(F.col("kind")))
    return kinds.select("ordinal", appearance.secondary_colour(F.col("kind")).alias("colour"))


@query("b8_confidence_band", """
    SELECT structure_id, atom_idx, CASE WHEN b_factor > 90 THEN 'very_high' WHEN b_factor > 70 THEN 'confident'
      WHEN b_factor > 50 THEN 'low' ELSE 'very_low' END AS band FROM atoms""", "atoms")
def confidence_band(spark: SparkSession, sf: str) -> DataFrame:
    return fx.atoms(spark, sf).select(*ID, appearance.confidence_band(F.col("b_factor")).alias("band"))


@query("b9_b_factor_share", f"""
    SELECT structure_id, atom_idx, {q('CASE WHEN hi - lo > 1e-4 THEN (b_factor - lo) / (hi - lo) ELSE 0.5 END')} AS b_share
    FROM (SELECT *, min(b_factor) OVER (PARTITION BY structure_id) AS lo, max(b_factor) OVER (PARTITION BY structure_id) AS hi
          FROM atoms)""", "atoms")
def b_factor_share(spark: SparkSession, sf: str) -> DataFrame:
    return appearance.with_b_factor_share(fx.atoms(spark, sf)).select(*ID, r("b_share").alias("b_share"))


_HYDROPATHY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in tables.HYDROPATHY.items())


@query("b10_hydropathy", f"""
    SELECT p_partkey, {q('h')} AS hydropathy, {q('(h + 4.5) / 9')} AS share FROM
      (SELECT p_partkey, CAST(CASE chr(65 + CAST(p_partkey % 26 AS INTEGER)) {_HYDROPATHY} ELSE 0 END AS DOUBLE) AS h FROM part)""")
def hydropathy(spark: SparkSession, sf: str) -> DataFrame:
    letters = fx.table(spark, sf, "part").selectExpr("p_partkey", "chr(65 + CAST(p_partkey % 26 AS INT)) AS letter")
    value = appearance.hydropathy(F.col("letter"))
    return letters.select("p_partkey", r(value).alias("hydropathy"), r(appearance.hydropathy_share(value)).alias("share"))


@query("b11_unit_conversion", "SELECT structure_id, atom_idx, x * 10 AS x, y * 10 AS y, z * 10 AS z FROM atoms", "atoms")
def unit_conversion(spark: SparkSession, sf: str) -> DataFrame:
    return fx.atoms(spark, sf).select(*ID, *[(F.col(a) * F.lit(10.0)).alias(a) for a in "xyz"])


@query("b12_valid_entry_id", """
    SELECT source, request_id, regexp_matches(upper(identifier), '^([1-9][A-Z0-9]{3}|PDB_[A-Z0-9]{8})$') AS valid,
      regexp_matches(upper(trim(identifier)), '^([1-9][A-Z0-9]{3}|PDB_[A-Z0-9]{8})$') AS valid_trimmed FROM manifest""", "manifest")
def valid_entry_id(spark: SparkSession, sf: str) -> DataFrame:
    return fx.manifest(spark, sf).select("source", "request_id", identifiers.valid_entry_id(F.col("identifier")).alias("valid"),
                                         identifiers.valid_entry_id(F.trim("identifier")).alias("valid_trimmed"))


@query("b13_valid_accession", """
    SELECT source, request_id, regexp_matches(upper(trim(identifier)),
      '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$') AS valid FROM manifest""", "manifest")
def valid_accession(spark: SparkSession, sf: str) -> DataFrame:
    return fx.manifest(spark, sf).select("source", "request_id",
                                         identifiers.valid_accession(F.trim("identifier")).alias("valid"))


@query("b14_request_manifest", f"""
    SELECT source, request_id, key AS identifier, CASE WHEN valid THEN CASE source WHEN 'archive'
        THEN '{tables.ARCHIVE_DOWNLOAD_BASE}' || key || '.cif' ELSE '{tables.PREDICTION_API_BASE}' || key END END AS url,
      CASE WHEN valid THEN CASE source WHEN 'archive' THEN 'rcsb-' ELSE 'alphafold-' END || key || '.cif' END AS storage_key
    FROM keyed""", "keyed")
def request_manifest(spark: SparkSession, sf: str) -> DataFrame:
    source, identifier = F.col("source"), F.col("identifier")
    return fx.manifest(spark, sf).select(
        "source", "request_id", identifiers.normalise(identifier).alias("identifier"),
        identifiers.request_url(source, identifier).alias("url"),
        identifiers.storage_key(source, identifier).alias("storage_key"))


ORIGIN = "CASE WHEN o_custkey % 5 = 0 OR o_orderstatus = 'F' THEN 'prediction' WHEN o_orderstatus = 'O' THEN 'archive' ELSE 'local' END"


def origins(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE o_orderstatus WHEN 'F' THEN 'prediction' WHEN 'O' THEN 'archive' ELSE 'local' END AS source",
        "o_custkey % 5 = 0 AS detected")


@query("b15_attribution", f"""
    SELECT o_orderkey, {ORIGIN} AS provenance, CASE {ORIGIN} WHEN 'prediction' THEN '{tables.PREDICTION_ATTRIBUTION}'
      WHEN 'archive' THEN '{tables.ARCHIVE_ATTRIBUTION}' ELSE '' END AS attribution FROM orders""")
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    return origins(spark, sf).select(
        "o_orderkey", identifiers.provenance(F.col("source"), F.col("detected")).alias("provenance"),
        identifiers.attribution(F.col("source"), F.col("detected")).alias("attribution"))


RESPONSES = "[200, 404, 500, 204, 302, 200][CAST(event_id % 6 AS INTEGER) + 1]"


@query("b16_fetch_outcome", f"""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'no_connection' WHEN status = 404 THEN 'not_found'
      WHEN status < 200 OR status >= 300 THEN 'bad_status' WHEN size = 0 THEN 'empty_body' ELSE 'ok' END AS outcome
    FROM (SELECT event_id, event_type, {RESPONSES} AS status,
                 CASE WHEN event_id % 5 = 0 THEN 0 ELSE length(props) END AS size FROM events)""")
def fetch_outcome(spark: SparkSession, sf: str) -> DataFrame:
    log = fx.table(spark, sf, "events").selectExpr(
        "event_id", "event_type <> 'error' AS connected",
        "element_at(array(200, 404, 500, 204, 302, 200), CAST(event_id % 6 AS INT) + 1) AS status",
        "CASE WHEN event_id % 5 = 0 THEN 0 ELSE length(props) END AS size")
    return log.select("event_id", identifiers.fetch_outcome(F.col("connected"), F.col("status"), F.col("size")).alias("outcome"))


@query("b17_periodic_wrap", f"""
    SELECT structure_id, atom_idx, {', '.join(f"CASE WHEN {a} < lo OR {a} > hi THEN lo + fmod(fmod({a} - lo, hi - lo) + (hi - lo), hi - lo) ELSE {a} END AS {a}" for a in 'xyz')},
      y AS kept
    FROM (SELECT *, 10.0::DOUBLE AS lo, 17.5::DOUBLE AS hi FROM atoms)""", "atoms")
def periodic_wrap(spark: SparkSession, sf: str) -> DataFrame:
    low, high = F.lit(10.0), F.lit(17.5)
    return fx.atoms(spark, sf).select(*ID, *[dynamics.wrap(F.col(a), low, high).alias(a) for a in "xyz"],
                                      dynamics.wrap(F.col("y"), low, low).alias("kept"))


def _bounces() -> str:
    text = "SELECT *, x AS v, y - 15 AS s FROM atoms"
    for _ in range(16):  # x is at most 40, so no more than 11 bounces between 10 and 12.5
        text = (f"SELECT * EXCLUDE (v, s), CASE WHEN v < 10 THEN 20 - v WHEN v > 12.5 THEN 25 - v ELSE v END AS v, "
                f"CASE WHEN v < 10 THEN abs(s) WHEN v > 12.5 THEN -abs(s) ELSE s END AS s FROM ({text})")
    return text


@query("b18_wall_reflection", f"""
    SELECT structure_id, atom_idx, CAST(greatest(10, least(12.5, v)) AS DOUBLE) AS x, {q('s')} AS speed FROM ({_bounces()})""", "atoms")
def wall_reflection(spark: SparkSession, sf: str) -> DataFrame:
    position, speed = dynamics.reflect(F.col("x"), F.col("y") - 15, F.lit(10.0), F.lit(12.5))
    return fx.atoms(spark, sf).select(*ID, position.alias("x"), r(speed).alias("speed"))


D2 = "((x - 20) * (x - 20) + (y - 18) * (y - 18) + (z - 20) * (z - 20))"


def bands_sql(first: int, second: int, third: int) -> str:
    return (f"CASE WHEN {D2} <= {first ** 2} THEN 'Full' WHEN {D2} <= {second ** 2} THEN 'Backbone' "
            f"WHEN {D2} <= {third ** 2} THEN 'Blob' ELSE 'Hidden' END")


def viewer_distance2() -> Column:
    terms = [(F.col(a) - at) * (F.col(a) - at) for a, at in zip("xyz", (20.0, 18.0, 20.0))]
    return reduce(lambda a, b: a + b, terms)


@query("b19_distance_band", f"""
    SELECT structure_id, atom_idx, {bands_sql(10, 15, 22)} AS band, {bands_sql(15, 15, 22)} AS repaired FROM atoms""", "atoms")
def distance_band(spark: SparkSession, sf: str) -> DataFrame:
    d2 = viewer_distance2()
    return fx.atoms(spark, sf).select(*ID, dynamics.detail_band(d2, 10, 15, 22).alias("band"),
                                      dynamics.detail_band(d2, 15, 5, 22).alias("repaired"))


@query("b20_step_decisions", f"""
    SELECT structure_id, tick, mol_id, {q('1 - exp(-rate * 0.5)')} AS probability,
      radius > 0 AND rate > 0 AND {D2} <= (radius * 10) * (radius * 10) AND roll < 1 - exp(-rate * 0.5) AS binds,
      rate > 0 AND roll < 1 - exp(-rate * 0.5) AS unbinds
    FROM (SELECT *, (species % 4)::DOUBLE AS rate FROM snapshots)""", "snapshots")
def step_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rate = (F.col("species") % 4).cast("double")
    return fx.snapshots(spark, sf).select(
        "structure_id", "tick", "mol_id", r(dynamics.step_probability(rate, 0.5)).alias("probability"),
        dynamics.binds(viewer_distance2(), F.col("radius") * 10, rate, 0.5, F.col("roll")).alias("binds"),
        dynamics.unbinds(rate, F.lit(0.5), F.col("roll")).alias("unbinds"))


@query("b21_iso_radius", f"""
    SELECT structure_id, atom_idx, {q('CASE WHEN b >= 0 OR iso <= 0 THEN vdw_radius WHEN 1 + ln(iso) / b > 0 THEN vdw_radius * sqrt(1 + ln(iso) / b) ELSE 0 END')} AS radius
    FROM (SELECT *, CASE WHEN atom_idx % 10 = 0 THEN 1.0::DOUBLE ELSE -2.3::DOUBLE END AS b, b_factor / 10 AS iso FROM enriched)""",
       "enriched")
def iso_radius(spark: SparkSession, sf: str) -> DataFrame:
    sharp = F.when(F.col("atom_idx") % 10 == 0, F.lit(1.0)).otherwise(F.lit(-2.3))
    return fx.enriched(spark, sf).select(*ID, r(appearance.iso_radius(
        F.col("vdw_radius"), sharp, F.col("b_factor") / 10)).alias("radius"))


FILE_STATES = """
    SELECT r.structure_id, r.residue_idx, coalesce(max_by(g.kind, g.ordinal), 'Coil') AS ss
    FROM res_rows r LEFT JOIN ranges g ON g.structure_id = r.structure_id AND g.chain_id = r.chain_id
      AND r.res_seq BETWEEN g.first_seq AND g.last_seq GROUP BY ALL"""


@query("b22_secondary_policy", """
    SELECT f.structure_id, f.residue_idx, CASE f.structure_id % 3 WHEN 0 THEN f.ss WHEN 1 THEN own
      ELSE CASE WHEN h.structure_id IS NOT NULL THEN f.ss ELSE own END END AS ss
    FROM (SELECT *, CASE residue_idx % 3 WHEN 0 THEN 'Helix' WHEN 1 THEN 'Turn' ELSE 'Coil' END AS own FROM states) f
    LEFT JOIN (SELECT DISTINCT structure_id FROM ranges) h ON h.structure_id = f.structure_id""",
       "res_rows", "ranges", extra={"states": FILE_STATES})
def secondary_policy(spark: SparkSession, sf: str) -> DataFrame:
    residues = assemble.residue_table(fx.numbered(spark, sf))
    ranges = fx.ranges(spark, sf)
    from_file = assemble.apply_ranges(residues, ranges)
    computed = residues.where("residue_idx % 3 < 2").select(
        "structure_id", "residue_idx", F.when(F.col("residue_idx") % 3 == 0, "Helix").otherwise("Turn").alias("ss"))
    policy = F.element_at(F.array(F.lit("FromFile"), F.lit("Compute"), F.lit("FromFileElseCompute")),
                          (F.col("structure_id") % 3 + 1).cast("int"))
    annotated = ranges.groupBy("structure_id").agg(F.lit(True).alias("has_ranges"))
    structures = (residues.select("structure_id").distinct().join(annotated, "structure_id", "left")
                  .withColumn("policy", policy).withColumn("has_ranges", F.coalesce("has_ranges", F.lit(False))))
    return assemble.secondary_structure_by_policy(from_file, computed, structures)


# --------------------------------------------------------------------------- selections

def _selected(name: str, condition: str, build) -> None:
    """Register a selection query: the predicate in one filter, the atoms it keeps as result."""
    @query(name, f"SELECT structure_id, atom_idx FROM enriched WHERE {condition}", "enriched")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return fx.enriched(spark, sf).where(build()).select(*ID)


_selected("c1_load_filter", "NOT is_water AND NOT is_secondary_altloc AND element NOT IN (1, 2)",
          lambda: sel.load_filter(discard_hydrogen=True))
_selected("c2_all_or_none", "true", lambda: sel.everything() & ~sel.nothing())
_selected("c3_polymer_classes", "residue_class IN ('AminoAcid', 'DeoxyNucleotide', 'Nucleotide')",
          lambda: sel.protein() | sel.dna() | sel.rna() | sel.nucleic())
_selected("c4_atom_kinds", "is_water OR is_backbone OR (is_hetatm AND element = 8)",
          lambda: sel.water() | sel.backbone() | (sel.hetero() & sel.element("O")))
_selected("c5_ligand_sidechain", "(is_hetatm AND NOT is_water) OR (residue_class = 'AminoAcid' AND NOT is_backbone)",
          lambda: sel.ligand() | sel.sidechain())
_selected("c6_chain", "chain_id IN ('A', 'C')", lambda: sel.chain("a+C"))
_selected("c7_residue_ranges", "res_seq BETWEEN 1 AND 50 OR res_seq = 60 OR res_seq BETWEEN -5 AND 0",
          lambda: sel.resi("1-50+60,-5-0"))
_selected("c8_names", "res_name IN ('ALA', 'HEM') AND name IN ('CA', 'N')", lambda: sel.resn("ala+HEM") & sel.name("CA,n"))
_selected("c9_element", "element IN (6, 30)", lambda: sel.element("C+Zn"))
_selected("c11_b_factor", "b_factor > 40 AND b_factor < 80", lambda: sel.b_above(40) & sel.b_below(80))
_selected("c12_boolean_combination",
          "(chain_id = 'A' OR (chain_id = 'B' AND name = 'CA')) AND NOT (residue_class = 'AminoAcid' AND is_backbone)",
          lambda: (sel.chain("A") | (sel.chain("B") & sel.name("CA"))) & ~(sel.protein() & sel.backbone()))


@query("c10_secondary_selection", """
    SELECT n.structure_id, n.atom_idx FROM numbered n JOIN states s ON s.structure_id = n.structure_id
      AND s.residue_idx = n.residue_idx WHERE ss IN ('Helix', 'Coil')""", "numbered", "res_rows", "ranges",
       extra={"states": FILE_STATES})
def secondary_selection(spark: SparkSession, sf: str) -> DataFrame:
    atoms = fx.numbered(spark, sf)
    states = assemble.apply_ranges(assemble.residue_table(atoms), fx.ranges(spark, sf))
    with_ss = atoms.join(states.select("structure_id", "residue_idx", "ss"), ["structure_id", "residue_idx"])
    return with_ss.where(sel.ss("H+C")).select(*ID)


@query("c13_index_lists", """
    SELECT * EXCLUDE (n), CAST(sum(n) OVER (PARTITION BY structure_id) AS BIGINT) AS num_selected FROM (
      SELECT structure_id, CAST(floor(atom_idx / 4096) AS BIGINT) AS chunk, string_agg(atom_idx, ',' ORDER BY atom_idx) AS atoms,
        count(*) AS n FROM enriched WHERE element = 8 GROUP BY ALL)""", "enriched")
def index_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = sel.index_lists(fx.enriched(spark, sf).where(sel.element("O")))
    return lists.select("structure_id", "chunk", F.concat_ws(",", F.transform(
        "atom_indices", lambda i: i.cast("string"))).alias("atoms"), "num_selected")


REPRESENTATIONS = ("SpaceFilling", "BallAndStick", "Backbone", "AlphaTrace", "Cartoon", "Surface")


@query("c14_representation_filter", """
    SELECT structure_id, atom_idx, representation, drawn, CASE WHEN representation = 'Surface' THEN shown ELSE drawn END AS exported
    FROM (SELECT *, NOT is_water AND element <> 1 AS shown, NOT is_water AND element <> 1 AND CASE representation
        WHEN 'Backbone' THEN is_backbone OR is_hetatm WHEN 'AlphaTrace' THEN is_anchor OR is_hetatm WHEN 'Cartoon' THEN is_hetatm
        WHEN 'Surface' THEN false ELSE true END AS drawn
      FROM enriched CROSS JOIN (VALUES ('SpaceFilling'), ('BallAndStick'), ('Backbone'), ('AlphaTrace'), ('Cartoon'), ('Surface'))
        AS v(representation))""", "enriched")
def representation_filter(spark: SparkSession, sf: str) -> DataFrame:
    kinds = fx.enriched(spark, sf).withColumn("representation", F.explode(F.array(*map(F.lit, REPRESENTATIONS))))
    kind = F.col("representation")
    return kinds.select(*ID, "representation", sel.drawn(kind, show_hydrogen=False).alias("drawn"),
                        sel.drawn(kind, show_hydrogen=False, points=True).alias("exported"))
