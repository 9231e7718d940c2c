"""Archive identifiers: validation, request address, storage key, attribution, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables

# Accepted forms of identifiers (fixed patterns of the two archives).
ENTRY_PATTERN = "^([1-9][A-Z0-9]{3}|PDB_[A-Z0-9]{8})\\z"
ACCESSION_PATTERN = "^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})\\z"

SOURCE_SLUGS = {"archive": "rcsb", "prediction": "alphafold"}


def valid_entry_id(identifier: Column) -> Column:
    return F.upper(identifier).rlike(ENTRY_PATTERN)


def valid_accession(accession: Column) -> Column:
    return F.upper(accession).rlike(ACCESSION_PATTERN)


def valid_identifier(source: Column, identifier: Column) -> Column:
    return (F.when(source == "archive", valid_entry_id(identifier))
            .when(source == "prediction", valid_accession(identifier)).otherwise(F.lit(False)))


def normalise(identifier: Column) -> Column:
    """Upper case without surrounding white space of any kind."""
    return F.upper(F.regexp_replace(identifier, r"^\s+|\s+$", ""))


def request_url(source: Column, identifier: Column) -> Column:
    """Address to ask for an identifier; null when it is not valid."""
    key = normalise(identifier)
    address = (F.when(source == "archive", F.concat(F.lit(tables.ARCHIVE_DOWNLOAD_BASE), key, F.lit(".cif")))
               .when(source == "prediction", F.concat(F.lit(tables.PREDICTION_API_BASE), key)))
    return F.when(valid_identifier(source, key), address)


def storage_key(source: Column, identifier: Column) -> Column:
    """File name under which a structure is landed; null when the identifier is not valid."""
    key = normalise(identifier)
    slug = F.when(source == "archive", F.lit(SOURCE_SLUGS["archive"])).when(
        source == "prediction", F.lit(SOURCE_SLUGS["prediction"]))
    return F.when(valid_identifier(source, key), F.concat(slug, F.lit("-"), key, F.lit(".cif")))


def attribution(requested_source: Column, detected_prediction: Column) -> Column:
    """Text a structure has to carry; a file recognised as a prediction keeps that origin."""
    prediction = detected_prediction | (requested_source == "prediction")
    return (F.when(F.coalesce(prediction, F.lit(False)), F.lit(tables.PREDICTION_ATTRIBUTION))
            .when(requested_source == "archive", F.lit(tables.ARCHIVE_ATTRIBUTION))
            .otherwise(F.lit("")))


def provenance(requested_source: Column, detected_prediction: Column) -> Column:
    prediction = detected_prediction | (requested_source == "prediction")
    return (F.when(F.coalesce(prediction, F.lit(False)), F.lit("prediction"))
            .when(requested_source == "archive", F.lit("archive")).otherwise(F.lit("local")))


def fetch_outcome(connected: Column, status: Column, body_length: Column) -> Column:
    """Class of a logged response."""
    return (F.when(~F.coalesce(connected, F.lit(False)), F.lit("no_connection"))
            .when(status == 404, F.lit("not_found"))
            .when((status < 200) | (status >= 300), F.lit("bad_status"))
            .when(F.coalesce(body_length, F.lit(0)) == 0, F.lit("empty_body"))
            .otherwise(F.lit("ok")))


def prediction_file_url(body: Column) -> Column:
    """File address in the first entry of a prediction response: mmCIF preferred, PDB otherwise."""
    entries = F.from_json(body, "array<struct<cifUrl:string,pdbUrl:string>>")
    first = F.get(entries, F.lit(0))
    return F.coalesce(F.nullif(first["cifUrl"], F.lit("")), F.nullif(first["pdbUrl"], F.lit("")))
