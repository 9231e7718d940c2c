"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

Texts with the same shingle set form a class, and everything after works on classes, so exact copies
cost nothing.  A class has one signature: a first permutation scatters its shingles over a circle, a
second one gives the circle its values, and coordinate k is the least value seen with the circle
shifted by k places.  All coordinates of a shingle lie next to each other in the second permutation,
so a signature is a minimum over slices.

Classes that agree on a band of the signature meet in a bucket.  No bucket is multiplied out:

1. A bucket has a pivot, the member that meets the most others in all its buckets, so that a family of
   edited copies mostly has one pivot, near its original.  Every member is verified against the pivot,
   which also gives the shingles it has and the pivot has not.  Verified links give components.
2. Let x and y be in one bucket, but not in one component.  What they share is at most the smaller of
   their parts shared with the pivot, and the shingles they share beyond the pivot.  So the pair is only
   verified if it shares enough shingles beyond the pivot (found by a join on the rarest of those: who
   needs k of m shared ones has one among the m - k + 1 rarest), or if the parts shared with the pivot could be enough alone (which takes a y smaller than
   the pivot, and an x close to a link with it).
3. The links of both steps give the final components.

So every pair that meets in a bucket is decided: by a verification, by a bound, or by being connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from . import words
from .common import bounded_batches, query, table
from .graph import components

#: 40 bands of 4 coordinates miss a pair at similarity 0.75 with a chance of 3e-7, closer pairs more rarely.
BANDS, ROWS = 40, 4
CIRCLE = 1 << 21
PERCENT = 75


def _circle() -> np.ndarray:
    """The second permutation, continued beyond its end, as overlapping slices of one signature each."""
    values = np.random.RandomState(7).permutation(np.arange(CIRCLE, dtype=np.uint32))
    whole = np.append(values, values[:BANDS * ROWS])
    return np.lib.stride_tricks.sliding_window_view(whole, BANDS * ROWS)


def signature(circle: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """All coordinates for one non-empty set of shingle hashes."""
    places = (words.mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(43)).astype(np.int64)
    least = circle[places[:8192]].min(axis=0)
    for first in range(8192, len(places), 8192):
        np.minimum(least, circle[places[first:first + 8192]].min(axis=0), out=least)
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; different bands never share keys on purpose."""
    key = np.arange(BANDS, dtype=np.uint64)
    for part in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(1))
    return key.view(np.int64)


def _set_id(shingles: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    again = words.mix(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    return np.array([shingles.sum(dtype=np.uint64) + np.uint64(len(shingles)),
                     again.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(shingles, initial=np.uint64(0))],
                    dtype=np.uint64).tobytes()


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    circle = _circle()
    for batch in batches:
        for first in range(0, batch.num_rows, 2000):
            part = batch.slice(first, 2000)
            counts, names, keys = [], [], []
            for shingles in words.shingle_sets(part.column(1)):
                counts.append(len(shingles))
                names.append(_set_id(shingles))
                keys.append(_band_keys(signature(circle, shingles)) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "set_id", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of every text again, for verification."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            found = list(words.shingle_sets(part.column(0)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(s) for s in found], pa.binary()), part.column(0)], ["set_id", "text"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intersection sizes of pairs of texts, and the shingles that only the second has."""
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            both, beyond = [], []
            for a, b in zip(words.shingle_sets(part.column(2)), words.shingle_sets(part.column(3)), strict=True):
                only = b[~np.isin(b, a, assume_unique=True, kind="sort")]
                both.append(len(b) - len(only))
                beyond.append(only.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(both, pa.int64()), pa.array(beyond, pa.list_(pa.int64()))],
                ["u", "v", "n_both", "beyond"])


def _compared(pairs: DataFrame, texts: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with sizes, intersection, the second's own shingles, and whether they are linked."""
    read = known.join(texts, "set_id").select("node", "text")
    joined = (pairs.join(read.withColumnsRenamed({"node": "u", "text": "a"}), "u")
              .join(read.withColumnsRenamed({"node": "v", "text": "b"}), "v").select("u", "v", "a", "b"))
    sizes = known.select("node", "n_shingles")
    return (joined.mapInArrow(_verify, "u long, v long, n_both long, beyond array<long>")
            .join(sizes.withColumnsRenamed({"node": "u", "n_shingles": "n_u"}), "u")
            .join(sizes.withColumnsRenamed({"node": "v", "n_shingles": "n_v"}), "v")
            .withColumn("linked", _enough(F.col("n_both"), F.col("n_u"), F.col("n_v"), percent)))


def _enough(both: Column, one: Column, two: Column, percent: int) -> Column:
    """Whether sets of these sizes that share ``both`` reach the threshold."""
    return both * (100 + percent) >= (one + two) * percent


def near_duplicates(docs: DataFrame, key: Column, text: Column, percent: int = PERCENT) -> DataFrame:
    """Component of every row: ``id``, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``.

    ``key`` is the row's id, of any type with an order; rows may repeat and ids may be null: a component's id is its smallest
    non-null id, and null where no row of it has one.  ``kept`` is true for the rows whose id is the
    component's.  A null or wordless text has no shingles, is linked with nothing and is its own
    component.  Other columns of ``docs`` are ignored.
    """
    named = docs.select(key.alias("id"), text.alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    signed = stage(named.mapInArrow(
        _sign, f"id {kind}, n_shingles long, set_id binary, bands array<long>"), "signatures")
    classes = stage(signed.where("n_shingles > 0").groupBy("set_id")
                    .agg(F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles"),
                         F.first("bands").alias("bands"))
                    .withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = (spread.groupBy("bucket").agg(F.min("node").alias("_first"), F.max("node").alias("_last"),
                                           F.count(F.lit(1)).alias("met"))
              .where("_first < _last").select("bucket", "met"))
    members = stage(spread.join(shared, "bucket"), "bucket-members")
    linked = _links(named, classes, members, percent)
    found = components(linked)
    least = classes.select("node", "set_id", "least").join(found, "node", "left")
    named = (least.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("component_id")))
    of_set = (least.withColumn("root", F.coalesce("root", "node")).join(named, "root")
              .select("set_id", "component_id"))
    empty = F.col("n_shingles") == 0
    return (signed.drop("bands").join(of_set.withColumnRenamed("set_id", "_set"),
                                      (F.col("set_id") == F.col("_set")) & ~empty, "left")
            .withColumn("component_id", F.when(empty, F.col("id")).otherwise(F.col("component_id")))
            .select("id", "n_shingles", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")))


def _links(rows: DataFrame, classes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links that connect all that is similar within buckets."""
    meetings = members.groupBy("node").agg(F.sum("met").alias("met"))
    known = stage(classes.join(meetings, "node").select("node", "set_id", "n_shingles", "least", "met"), "met-classes")
    wanted = known.select(F.col("least").alias("_id"))
    texts = stage(rows.join(wanted, F.col("id").eqNullSafe(F.col("_id")), "left_semi").select("text")
                  .mapInArrow(_sets, "set_id binary, text string").dropDuplicates(["set_id"]), "texts")
    known = known.drop("least")

    pivots = (members.drop("met").join(known.select("node", "met"), "node").groupBy("bucket")
              .agg(F.max_by("node", F.struct("met", "node")).alias("pivot")))
    star = (members.join(pivots, "bucket").where("node != pivot")
            .select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct())
    first = stage(_compared(star, texts, known, percent), "pivot-links")
    roots = components(first.where("linked").select("u", "v"))

    group = first.select("u", F.col("v").alias("node"), "n_u", F.col("n_v").alias("n"), F.col("n_both").alias("part"),
                         "linked", "beyond").join(roots, "node", "left")
    group = group.withColumn("root", F.coalesce("root", "node"))
    open_ = group.groupBy("u").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min("n").alias("n_least"))
    group = stage(group.join(open_.where("_a < _b").select("u", "n_least"), "u"), "unsettled")

    def other(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.withColumnsRenamed({c: f"{c}_2" for c in df.columns if c not in keys})

    parts = F.least("part", "part_2")
    differ = (F.col("node") < F.col("node_2")) & (F.col("root") != F.col("root_2"))
    # a pair has to share so many shingles beyond the pivot, whatever the partner
    least_partner = F.greatest("n_least", F.ceil(F.col("n") * percent / 100))
    short = F.ceil((F.col("n") + least_partner) * percent / (100 + percent)) - F.col("part")
    spread = group.select("u", "node", "n", "root", F.greatest(F.lit(1), short).alias("need"),
                          F.explode("beyond").alias("shingle"))
    mixed = (spread.groupBy("u", "shingle").agg(F.count(F.lit(1)).alias("often"), F.min("root").alias("_a"),
                                                F.max("root").alias("_b"))
             .where("_a < _b").select("u", "shingle", "often"))
    own = Window.partitionBy("u", "node")
    spread = (spread.join(mixed, ["u", "shingle"])
              .withColumn("_all", F.count(F.lit(1)).over(own))
              .withColumn("_at", F.row_number().over(own.orderBy("often", "shingle"))))
    rare = stage(spread.where("_at <= _all - need + 1").select("u", "shingle", "node", "n", "root"), "rare-beyond")
    sizes_fit = (F.col("n") * 100 >= F.col("n_2") * percent) & (F.col("n_2") * 100 >= F.col("n") * percent)
    met = (rare.join(other(rare, ["u", "shingle"]), ["u", "shingle"]).where(differ & sizes_fit)
           .select("u", "node", "node_2").distinct())
    side = group.select("u", "node", "n", "part", "beyond")
    more = F.size(F.array_intersect("beyond", "beyond_2"))
    by_shingle = (met.join(side, ["u", "node"]).join(other(side, ["u"]), ["u", "node_2"])
                  .where(_enough(parts + more, F.col("n"), F.col("n_2"), percent)))
    # the largest size of a partner for which the part shared with the pivot could do
    group = group.drop("beyond").withColumn("_most", F.floor(F.col("part") * (100 + percent) / percent) - F.col("n"))
    near = group.where(~F.col("linked") & (F.col("_most") >= F.col("n_least")) & (F.col("n_least") < F.col("n_u")))
    sized = near.withColumn("n_2", F.explode(F.sequence("n_least", F.least("_most", F.col("n_u") - 1))))
    by_size = (sized.join(group.select("u", F.col("node").alias("node_2"), F.col("n").alias("n_2"),
                                       F.col("part").alias("part_2"), F.col("root").alias("root_2")), ["u", "n_2"])
               .where((F.col("root") != F.col("root_2")) & _enough(parts, F.col("n"), F.col("n_2"), percent)))
    pairs = (by_shingle.select("node", "node_2").union(by_size.select("node", "node_2"))
             .select(F.least("node", "node_2").alias("u"), F.greatest("node", "node_2").alias("v")).distinct())
    second = _compared(pairs, texts, known, percent).where("linked").select("u", "v")
    return stage(first.where("linked").select("u", "v").union(second), "all-links")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
l AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.v FROM r JOIN l ON r.seen = l.u)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.sh
"""


def one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` (with ``doc_id`` and ``text``), one of each near-duplicate component.

    The row with the smallest id stays; rows that repeat both its id and its text are one row.  Rows
    without words all stay.
    """
    def key(df: DataFrame) -> Column:
        return F.struct(df["doc_id"].alias("doc_id"), F.xxhash64(df["text"]).alias("hash"))

    found = stage(near_duplicates(docs, key(docs), docs["text"], percent), "components")
    gone = found.where(~F.col("kept")).select(F.col("id.doc_id").alias("_id"), F.col("id.hash").alias("_hash")).distinct()
    rest = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")
    again = found.where("kept AND n_shingles > 0").groupBy("id").count().where("count > 1").select("id")
    if again.isEmpty():
        return rest
    repeated = again.select(F.col("id.doc_id").alias("_id"), F.col("id.hash").alias("_hash"))
    same = rest["doc_id"].eqNullSafe(repeated["_id"]) & (F.xxhash64(rest["text"]) == repeated["_hash"])
    return rest.join(repeated, same, "left_anti").union(
        rest.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


@query("op5_neardup", NEAR_SQL)
def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    bounded_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return found.withColumnRenamed("id", "doc_id")
