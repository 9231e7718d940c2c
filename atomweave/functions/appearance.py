"""Radii, colour classes and scales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables

RADIUS_FACTORS = {"SpaceFilling": 1.0, "BallAndStick": 0.25, "Backbone": 0.35, "AlphaTrace": 0.35, "Cartoon": 0.35}


def radius_factor(representation: Column) -> Column:
    """Share of the van-der-Waals radius drawn in a representation."""
    result = F.when(representation == "SpaceFilling", F.lit(1.0))
    for name, factor in RADIUS_FACTORS.items():
        result = result.when(representation == name, F.lit(factor))
    return result.otherwise(F.lit(1.0))


def element_colour(red: Column, green: Column, blue: Column) -> Column:
    """CPK colour of an element as ``#RRGGBB``."""
    return F.format_string("#%02X%02X%02X", red, green, blue)


def chain_hue(chain_idx: Column) -> Column:
    """Hue in degrees, spread by the golden ratio so that any number of chains stays distinguishable."""
    turned = chain_idx * F.lit(tables.GOLDEN_CONJUGATE)
    return (turned - F.floor(turned)) * F.lit(360.0)


def secondary_colour(ss: Column) -> Column:
    result = None
    for kind, colour in tables.SECONDARY_COLOURS.items():
        result = F.when(ss == kind, F.lit(colour)) if result is None else result.when(ss == kind, F.lit(colour))
    return result.otherwise(F.lit(tables.SECONDARY_COLOURS["Coil"]))


def confidence_band(value: Column) -> Column:
    """Band name of a prediction confidence value."""
    result = None
    for bound, band, _ in tables.CONFIDENCE_BANDS:
        result = F.when(value > bound, F.lit(band)) if result is None else result.when(value > bound, F.lit(band))
    return result.otherwise(F.lit(tables.CONFIDENCE_FLOOR[0]))


def normalised_b_factor(value: Column, low: Column, high: Column) -> Column:
    """Position of a B-factor in the range of its structure; 0.5 when there is no range."""
    span = high - low
    return F.when(span > 1e-4, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / span))).otherwise(0.5)


def hydropathy(letter: Column) -> Column:
    """Kyte-Doolittle value of a one-letter code, 0 for letters outside the scale."""
    result = None
    for code, value in tables.HYDROPATHY.items():
        result = F.when(letter == code, F.lit(value)) if result is None else result.when(letter == code, F.lit(value))
    return result.otherwise(F.lit(0.0))


def hydropathy_share(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value + 4.5) / 9.0))


def iso_radius(radius: Column, sharpness: Column | float, iso: Column | float) -> Column:
    """Distance at which the Gaussian of one atom falls to ``iso``."""
    b = sharpness if isinstance(sharpness, Column) else F.lit(float(sharpness))
    level = iso if isinstance(iso, Column) else F.lit(float(iso))
    factor = 1.0 + F.ln(level) / b
    return (F.when((b >= 0) | (level <= 0), radius)
            .when(factor > 0, radius * F.sqrt(factor)).otherwise(F.lit(0.0)))


def with_b_factor_share(atoms: DataFrame, keys=("structure_id",)) -> DataFrame:
    """Add ``b_share``: the B-factor normalised to the range of its structure.

    The range is a partial/final aggregate joined back, so no structure is gathered in one task.
    """
    ranges = atoms.groupBy(*keys).agg(F.min("b_factor").alias("_low"), F.max("b_factor").alias("_high"))
    return (atoms.join(ranges, list(keys))
            .withColumn("b_share", normalised_b_factor(F.col("b_factor"), F.col("_low"), F.col("_high")))
            .drop("_low", "_high"))
