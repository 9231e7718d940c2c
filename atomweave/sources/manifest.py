"""Landed files and the list of what is still to be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identifiers


def landed_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, time and size of files; the content column is not selected and never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
            .select("path", "modificationTime", "length"))


def with_freshness(files: DataFrame, now: Column, max_age_days: int) -> DataFrame:
    """Add ``is_fresh``: not empty and younger than the limit; a limit of zero or less never expires."""
    age = F.unix_micros(now) - F.unix_micros(F.col("modificationTime").cast("timestamp"))
    young = F.lit(True) if max_age_days <= 0 else age < F.lit(max_age_days * 86_400_000_000)
    return files.withColumn("is_fresh", (F.col("length") > 0) & F.coalesce(young, F.lit(False)))


def inventory(files: DataFrame) -> DataFrame:
    """Number of files, usable files and bytes."""
    return files.agg(F.count(F.lit(1)).alias("num_files"), F.count_if("is_fresh").alias("num_fresh"),
                     F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def work_list(requests: DataFrame, fresh: DataFrame) -> DataFrame:
    """Valid requests ``(source, identifier)`` without a fresh landed file ``(storage_key)``."""
    source, identifier = F.col("source"), F.col("identifier")
    wanted = (requests.select("source", identifiers.normalise(identifier).alias("identifier"),
                              identifiers.storage_key(source, identifier).alias("storage_key"),
                              identifiers.request_url(source, identifier).alias("url"))
              .where(F.col("storage_key").isNotNull()).distinct())
    return wanted.join(fresh.select("storage_key"), "storage_key", "left_anti")
