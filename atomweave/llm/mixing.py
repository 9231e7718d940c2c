"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a line of tokens: its documents in a shuffled but fixed order, cut into blocks of equal
token count.  The schedule is a sequence of slots; slot ``i`` has the point ``frac(i * golden ratio)``,
and the source whose cumulative weight interval holds the point owns the slot.  The slots of a source
are ranked and its k-th slot takes its k-th block, beginning again at the first block when all are
taken, up to the source's target.  All is joins and windows over bounded blocks; texts are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans
from ..session import stage
from .common import query, table, word_count

#: The golden ratio as an odd multiplier modulo 2**32.
GOLDEN = 2654435769
#: Rows of one source that are ordered together by one task.
BUCKET_ROWS = 2_000
#: Bins that join schedule points to weight intervals.
BINS = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Target per source from one row per source (``source``, ``source_size``).

    Sources by code point, null last, take ``weights`` in turn.  ``share`` of all sizes is dealt by
    weight; a source stops at ``most`` times its size and the excess is dealt again by weight.  With the
    sources sorted by size over weight, those that stop are a prefix of the order, so the common level
    of the others follows from running sums.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, here and below
    number = (F.row_number().over(by_name) - 1).cast("int")
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("source_no") % len(weights) + 1)
    ranked = (sizes.withColumn("source_no", number).withColumn("_weight", choice)
              .withColumn("_cap", F.col("source_size") * float(most))
              .withColumn("_budget", F.sum("source_size").over(everything) * float(share)))
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(ahead)
    levels = ranked.withColumn("_level", level)
    free = F.when(F.col("_cap") > F.col("_level") * F.col("_weight"), F.col("_level"))
    common = F.first(free, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding,
                                                                    Window.unboundedFollowing))
    return (levels.withColumn("_common", common)
            .select("source", "source_no", "source_size", F.when(F.col("_common").isNull(), F.col("_cap"))
                    .otherwise(F.least("_cap", F.col("_weight") * F.col("_common"))).alias("target")))


def token_lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Start of every row on the token line of its source.

    The shuffled order is cut into buckets by the leading part of the shuffle key, so many that each
    holds a bounded number of rows however large the source; bucket totals give the offsets.
    """
    known = rows.join(sources.select(F.col("source").alias("_source"), "source_no", "_count"),
                      F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = F.ceil(F.col("_count") / BUCKET_ROWS)
    known = known.withColumn("_bucket", F.floor(F.col("_shuffle") / float(2 ** 60) * buckets))
    before = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (known.groupBy("source_no", "_bucket").agg(F.sum("size").alias("_sum"))
               .select("source_no", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy("source_no", "_bucket").orderBy("_shuffle", "_row")
    upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (known.withColumn("_upto", upto).join(offsets, ["source_no", "_bucket"])
            .withColumn("start", F.col("_base") + F.col("_upto") - F.col("size"))
            .drop("_bucket", "_upto", "_base", "_count"))


def point(slot: Column) -> Column:
    """``frac(slot * golden ratio)`` in exact integer arithmetic, as an integer below 2**32."""
    low, high = slot % 65536, F.floor(slot / 65536) % 65536
    return ((high * GOLDEN % 65536) * 65536 + low * GOLDEN) % F.lit(2 ** 32)


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots with their source, rank within the source, and the tokens they take from its line.

    A source needs ``quota`` slots: whole rounds over its blocks, then the blocks of the rest; the last
    one may be cut short, so that exactly the target is taken.  Twice as many points as slots are laid,
    which gives every interval its quota (no gap between n golden points exceeds 1.9 / n); points
    beyond a quota are void.
    """
    spark = sources.sparkSession
    whole = F.floor("target").cast("long")
    needs = (sources.where((F.col("source_size") > 0) & (whole > 0))
             .withColumn("_blocks", F.ceil(F.col("source_size") / block).cast("long"))
             .withColumn("_rest", whole % F.col("source_size"))
             .withColumn("_rounds", F.floor(whole / F.col("source_size")).cast("long"))
             .withColumn("quota", F.col("_rounds") * F.col("_blocks") + F.ceil(F.col("_rest") / block).cast("long")))
    order = Window.orderBy("source_no")
    total = F.sum("quota").over(Window.partitionBy())
    unit = float(2 ** 32)
    weighted = needs.withColumn("_upto", F.sum("quota").over(order)).withColumn("_all", total).select(
        "source_no", "source_size", "_blocks", "_rest", "_rounds", "quota",
        F.floor((F.col("_upto") - F.col("quota")) / F.col("_all") * unit).alias("_from"),
        F.floor(F.col("_upto") / F.col("_all") * unit).alias("_to"))
    slots = needs.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]  # one number
    width = 2 ** 32 // BINS
    binned = weighted.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col("_from") / width), F.floor((F.greatest("_to", F.col("_from") + 1) - 1) / width))))
    points = (spark.range(2 * slots + 16).withColumnRenamed("id", "slot")
              .withColumn("_point", point(F.col("slot")))
              .withColumn("_bin", F.floor(F.col("_point") / width)))
    owned = (points.join(binned, "_bin")
             .where((F.col("_point") >= F.col("_from")) & (F.col("_point") < F.col("_to"))))
    ranked = scans.row_index(owned, ["source_no"], "slot", ["slot"], "rank")
    position = F.col("rank") % F.col("_blocks")
    taken_round = F.floor(F.col("rank") / F.col("_blocks"))
    limit = F.when(taken_round < F.col("_rounds"), F.col("source_size")).otherwise(F.col("_rest"))
    return (ranked.where(F.col("rank") < F.col("quota"))
            .select("slot", "source_no", "rank", position.alias("block_no"), taken_round.cast("int").alias("round"),
                    F.least((position + 1) * block, limit).alias("_end")))


def mix(rows: DataFrame, row: Column, source: Column, size: Column, shuffle: Column,
        weights: tuple[float, ...], share: float = 1.5, most: float = 2.0,
        block: int = 512) -> tuple[DataFrame, DataFrame]:
    """Mix ``rows`` to the weights; returns the rows with their sources' targets, and the pieces taken.

    ``row`` is carried through as ``row`` (a struct or any value), ``shuffle`` is an integer from 0 to
    2**60 - 1 that orders the rows of a source; equal values are ordered by ``row``, and rows equal in
    both are interchangeable.  The first table has one line per row: ``row``, ``row_no``, ``source``,
    ``size``, ``source_size``, ``target``.  The second has one line per piece: ``slot`` (place in the
    mix), ``round``, ``row_no``, ``first`` and ``tokens`` (which tokens of the row are taken).

    Null sources are a source of their own, null sizes count as nothing; rows and sources of size
    nothing are never taken.  Columns of ``rows`` that are not named here are ignored.
    """
    lines = stage(rows.select(row.alias("row"), source.alias("source"),
                              F.coalesce(size.cast("long"), F.lit(0)).alias("size"), shuffle.alias("_shuffle"))
                  .withColumn("row_no", F.monotonically_increasing_id()), "mix-sizes")
    totals = lines.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_count"))
    goals = stage(targets(totals.drop("_count"), weights, share, most), "mix-targets")
    counted = goals.join(totals.select(F.col("source").alias("_source"), "_count"),
                         F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = token_lines(lines.withColumn("_row", F.col("row")).drop("row"), counted)
    end = F.col("start") + F.col("size")
    parts = (placed.where("size > 0")
             .select("source_no", "row_no", "start", end.alias("_stop"),
                     F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block_no")))
    first = F.greatest(F.col("start"), F.col("block_no") * block)
    pieces = (parts.withColumn("_first", first).join(schedule(goals, block), ["source_no", "block_no"])
              .withColumn("tokens", F.least("_stop", "_end") - F.col("_first")).where("tokens > 0")
              .select("slot", "round", "row_no", (F.col("_first") - F.col("start")).alias("first"), "tokens"))
    named = lines.join(goals.withColumnRenamed("source", "_source"),
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return named.select("row", "row_no", "source", "size", "source_size", "target"), pieces


def taken(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """Tokens taken per row, repeats counted."""
    sums = pieces.groupBy("row_no").agg(F.sum("tokens").alias("_taken"))
    return rows.join(sums, "row_no", "left").withColumn("taken", F.coalesce("_taken", F.lit(0))).drop("_taken")


def shuffle_key(*values: Column) -> Column:
    """60 bits of a hash that other engines know as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(",", *[v.cast("string") for v in values])), 1, 15), 16, 10).cast("long")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no FROM s),
w AS (SELECT *, ([3, 1, 2])[(source_no % 3)::INT + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM n),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source_no
                                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
c AS (SELECT min_by(level, (cap / weight, source_no)) AS common FROM l WHERE cap > level * weight),
t AS (SELECT source, source_no, source_size,
             CASE WHEN common IS NULL THEN cap ELSE least(cap, weight * common) END AS target FROM l, c),
p AS (SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS whole,
             (sum(size) OVER (PARTITION BY t.source_no ORDER BY key, doc_id) - size)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (whole // source_size) * size
                 + greatest(0, least(start + size, whole % source_size) - start) END::BIGINT AS taken
FROM p
"""


def op7_rows(docs: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    return mix(docs, row, F.col("source"), word_count(F.col("text")), shuffle_key(F.col("doc_id")), (3, 1, 2))


@query("op7_mixing", MIX_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed from their sources at 3 : 1 : 2, 150 % of all words, no source over 200 %."""
    rows, pieces = op7_rows(table(spark, sf_dir, "documents"), F.col("doc_id"))
    return taken(rows, pieces).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as op7's mix takes them, with their columns unchanged.

    Documents stay whole: a row comes once for every round that takes at least half of its words, which
    moves a source by no more than half a document from its target.  Rows without words are never taken.
    The rounds are drawn from the pieces of the schedule; equal rows are interchangeable.
    """
    keyed = stage(docs.select(F.struct(*docs.columns).alias("_doc"))
                  .withColumn("_no", F.monotonically_increasing_id()), "mix-input")
    rows, pieces = mix(keyed, F.col("_no"), F.col("_doc.source"), word_count(F.col("_doc.text")),
                       shuffle_key(F.col("_doc.doc_id"), F.crc32("_doc.text")), (3, 1, 2))
    times = taken(rows, pieces).select(F.col("row").alias("_no"), F.when(F.col("size") > 0, F.floor(
        (2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(0).cast("int").alias("_times"))
    return (keyed.join(times.where("_times > 0"), "_no")
            .withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*"))
