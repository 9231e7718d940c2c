"""Fixed reference values, stated as plain text in natural order.

Everything in the first section is a lookup value that results must agree on (element data,
residue names, colour scales, hydropathy).  The second section turns them into small constant
DataFrames.  These are the only tables the library broadcasts: 119 elements and fewer than one
hundred residue names, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --------------------------------------------------------------------------- fixed values

# Element symbols by atomic number; 0 is "unknown".
ELEMENT_SYMBOLS = """
X
H He
Li Be B C N O F Ne
Na Mg Al Si P S Cl Ar
K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr
Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe
Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn
Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og
""".split()

# Van-der-Waals radius (Å) by atomic number (Bondi 1964, Alvarez 2013).
ELEMENT_VDW_RADII = """
1.80
1.20 1.40
1.82 1.53 1.92 1.70 1.55 1.52 1.47 1.54
2.27 1.73 1.84 2.10 1.80 1.80 1.75 1.88
2.75 2.31 2.11 1.87 1.79 1.89 1.97 1.94 1.92 1.84 1.86 2.10 1.87 2.11 1.85 1.90 1.85 2.02
3.03 2.49 2.32 2.23 2.18 2.17 2.16 2.13 2.10 2.10 2.11 2.18 1.93 2.17 2.06 2.06 1.98 2.16
3.43 2.68 2.43 2.42 2.40 2.39 2.38 2.36 2.35 2.34 2.33 2.31 2.30 2.29 2.27 2.26 2.24 2.23 2.22 2.18
2.16 2.16 2.13 2.13 2.14 2.23 2.14 2.43 2.40 2.40 2.40 2.40
3.48 2.83 2.47 2.45 2.43 2.41 2.39 2.43 2.44 2.45 2.44 2.45 2.45 2.45 2.46 2.46 2.46 2.46 2.46 2.46
2.46 2.46 2.46 2.46 2.46 2.46 2.46 2.46 2.46 2.46 2.46 2.46
""".split()

# Covalent radius (Å) by atomic number (Cordero 2008).
ELEMENT_COVALENT_RADII = """
1.50
0.31 0.28
1.28 0.96 0.84 0.76 0.71 0.66 0.57 0.58
1.66 1.41 1.21 1.11 1.07 1.05 1.02 1.06
2.03 1.76 1.70 1.60 1.53 1.39 1.39 1.32 1.26 1.24 1.32 1.22 1.22 1.20 1.19 1.20 1.20 1.16
2.20 1.95 1.90 1.75 1.64 1.54 1.47 1.46 1.42 1.39 1.45 1.44 1.42 1.39 1.39 1.38 1.39 1.40
2.44 2.15 2.07 2.04 2.03 2.01 1.99 1.98 1.98 1.96 1.94 1.92 1.92 1.89 1.90 1.87 1.87 1.75 1.70 1.62
1.51 1.44 1.41 1.36 1.36 1.32 1.45 1.46 1.48 1.40 1.50 1.50
2.60 2.21 2.15 2.06 2.00 1.96 1.90 1.87 1.80 1.69 1.68 1.68 1.65 1.67 1.73 1.76 1.61 1.57 1.49 1.43
1.41 1.34 1.29 1.28 1.21 1.22 1.36 1.43 1.62 1.75 1.65 1.57
""".split()

# Standard atomic weight (u) by atomic number.
ELEMENT_MASSES = """
0.000
1.008 4.003
6.940 9.012 10.810 12.011 14.007 15.999 18.998 20.180
22.990 24.305 26.982 28.085 30.974 32.060 35.450 39.950
39.098 40.078 44.956 47.867 50.942 51.996 54.938 55.845 58.933 58.693 63.546 65.380 69.723 72.630 74.922
78.971 79.904 83.798
85.468 87.620 88.906 91.224 92.906 95.950 98.000 101.070 102.906 106.420 107.868 112.414 114.818 118.710
121.760 127.600 126.904 131.293
132.905 137.327 138.905 140.116 140.908 144.242 145.000 150.360 151.964 157.250 158.925 162.500 164.930
167.259 168.934 173.045 174.967 178.486 180.948 183.840 186.207 190.230 192.217 195.084 196.967 200.592
204.380 207.200 208.980 209.000 210.000 222.000
223.000 226.000 227.000 232.038 231.036 238.029 237.000 244.000 243.000 247.000 247.000 251.000 252.000
257.000 258.000 259.000 266.000 267.000 268.000 269.000 270.000 269.000 278.000 281.000 282.000 285.000
286.000 289.000 290.000 293.000 294.000 294.000
""".split()

# CPK colour (red,green,blue 0..255) by atomic number, Jmol scheme.
ELEMENT_COLOURS = """
255,105,180
255,255,255 217,255,255
204,128,255 194,255,0 255,181,181 144,144,144 48,80,248 255,13,13 144,224,80 179,227,245
171,92,242 138,255,0 191,166,166 240,200,160 255,128,0 255,255,48 31,240,31 128,209,227
143,64,212 61,255,0 230,230,230 191,194,199 166,166,171 138,153,199 156,122,199 224,102,51 240,144,160
80,208,80 200,128,51 125,128,176 194,143,143 102,143,143 189,128,227 255,161,0 166,41,41 92,184,209
112,46,176 0,255,0 148,255,255 148,224,224 115,194,201 84,181,181 59,158,158 36,143,143 10,125,140
0,105,133 192,192,192 255,217,143 166,117,115 102,128,128 158,99,181 212,122,0 148,0,148 66,158,176
87,23,143 0,201,0 112,212,255 255,255,199 217,255,199 199,255,199 163,255,199 143,255,199 97,255,199
69,255,199 48,255,199 31,255,199 0,255,156 0,230,117 0,212,82 0,191,56 0,171,36 77,194,255 77,166,255
33,148,214 38,125,171 38,102,150 22,84,135 208,208,224 255,209,35 184,184,208 166,84,77 87,89,97
158,79,181 171,92,0 117,79,69 66,130,150
66,0,102 0,125,0 112,171,250 0,186,255 0,161,255 0,143,255 0,128,255 0,107,255 84,92,242 120,92,227
138,79,227 161,54,212 179,31,212 179,31,186 179,13,166 189,13,135 199,0,102 204,0,89 209,0,79 217,0,69
224,0,56 230,0,46 235,0,38 240,0,33 241,0,30 242,0,28 242,0,26 243,0,24 244,0,22 245,0,20 246,0,18
247,0,16
""".split()

# Residue names with their one-letter code, by class.
RESIDUE_NAMES = {
    "AminoAcid": """
        ALA:A ARG:R ASN:N ASP:D CYS:C GLN:Q GLU:E GLY:G HIS:H ILE:I LEU:L LYS:K MET:M PHE:F PRO:P SER:S
        THR:T TRP:W TYR:Y VAL:V SEC:U PYL:O MSE:M HSD:H HSE:H HSP:H HID:H HIE:H HIP:H CYX:C CYM:C ASH:D
        GLH:E LYN:K ASX:B GLX:Z UNK:X PCA:E HYP:P SEP:S TPO:T PTR:Y MLY:K
    """,
    "DeoxyNucleotide": "DA:A DC:C DG:G DT:T DU:U DI:I ADE:A CYT:C GUA:G THY:T",
    "Nucleotide": "A:A C:C G:G U:U I:I RA:A RC:C RG:G RU:U URA:U PSU:U 5MC:C 7MG:G",
    "Water": "HOH:X DOD:X WAT:X H2O:X SOL:X TIP:X TIP3:X",
}

# Backbone and anchor atom names.
PROTEIN_BACKBONE = "N CA C O OXT".split()
NUCLEIC_BACKBONE = "P OP1 OP2 O1P O2P O5' C5' C4' C3' O3' C2' C1' O4'".split()
PROTEIN_ANCHORS = ["CA"]
NUCLEIC_ANCHORS = ["C1'", "P"]

# Kyte-Doolittle hydropathy by one-letter code; every other letter is 0.
HYDROPATHY = {
    "I": 4.5, "V": 4.2, "L": 3.8, "F": 2.8, "C": 2.5, "M": 1.9, "A": 1.8, "G": -0.4, "T": -0.7, "S": -0.8,
    "W": -0.9, "Y": -1.3, "P": -1.6, "H": -3.2, "E": -3.5, "Q": -3.5, "D": -3.5, "N": -3.5, "K": -3.9, "R": -4.5,
}

# Secondary-structure colours and the confidence scale (lower bounds are exclusive).
SECONDARY_COLOURS = {"Helix": "#E8355C", "Sheet": "#FFC107", "Turn": "#64B5F6", "Coil": "#BDBDBD"}
CONFIDENCE_BANDS = [(90.0, "very_high", "#0053D6"), (70.0, "confident", "#65CBF3"), (50.0, "low", "#FFDB13")]
CONFIDENCE_FLOOR = ("very_low", "#FF7D45")

# Conjugate golden ratio used for chain hues.
GOLDEN_CONJUGATE = 0.6180339887498949

# Attribution texts that have to accompany data from the two public archives.
PREDICTION_ATTRIBUTION = (
    "Strukturdaten aus der AlphaFold Protein Structure Database (DeepMind / EMBL-EBI), lizenziert unter CC-BY-4.0."
)
ARCHIVE_ATTRIBUTION = "Strukturdaten aus der RCSB Protein Data Bank (rcsb.org)."

# Base addresses of the two archives.
ARCHIVE_DOWNLOAD_BASE = "https://files.rcsb.org/download/"
PREDICTION_API_BASE = "https://alphafold.ebi.ac.uk/api/prediction/"

# --------------------------------------------------------------------------- constant tables

MAX_ATOMIC_NUMBER = len(ELEMENT_SYMBOLS) - 1
MAX_COVALENT_RADIUS = max(float(r) for r in ELEMENT_COVALENT_RADII)
MAX_VDW_RADIUS = max(float(r) for r in ELEMENT_VDW_RADII)

ATOMIC_NUMBERS = {symbol.upper(): z for z, symbol in enumerate(ELEMENT_SYMBOLS) if z > 0}


def element_rows() -> list[tuple]:
    """(atomic number, symbol, vdw, covalent, mass, red, green, blue) for every element."""
    rows = []
    for z, symbol in enumerate(ELEMENT_SYMBOLS):
        red, green, blue = (int(v) for v in ELEMENT_COLOURS[z].split(","))
        rows.append((z, symbol, float(ELEMENT_VDW_RADII[z]), float(ELEMENT_COVALENT_RADII[z]),
                     float(ELEMENT_MASSES[z]), red, green, blue))
    return rows


def residue_rows() -> list[tuple]:
    """(residue name, class, one-letter code) for every known residue name."""
    return [(name, klass, letter)
            for klass, text in RESIDUE_NAMES.items()
            for name, letter in (entry.split(":") for entry in text.split())]


def sql_values(rows: list[tuple], double_suffix: str = "D") -> str:
    """Rows as the body of a SQL VALUES list (constant relation, no Python data transfer)."""
    def literal(value):
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        if isinstance(value, float):
            return repr(value) + double_suffix
        return str(value)
    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def elements(spark: SparkSession) -> DataFrame:
    """Element table: 119 rows, hence always safe to broadcast."""
    return spark.sql(
        f"SELECT * FROM VALUES {sql_values(element_rows())} "
        "AS t(atomic_number, symbol, vdw_radius, covalent_radius, mass, red, green, blue)")


def residue_names(spark: SparkSession) -> DataFrame:
    """Residue table: fewer than one hundred rows, hence always safe to broadcast."""
    return spark.sql(
        f"SELECT * FROM VALUES {sql_values(residue_rows())} AS t(residue_name, residue_class, letter)")
