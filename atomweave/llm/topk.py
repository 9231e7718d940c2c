"""Exact top-k search by inner product with block-at-a-time pruning.

The vectors are put in order of their ids and packed into blocks, each a forward index: the ids and the
integer components of a range of documents, with the largest and smallest value of every component (the
terms).  A query's bound for a block is the sum over its components of the largest product the block
allows.  Per query, the blocks of a run (16 blocks) are scored in the order of their bounds, until the next
bound is below the k-th score found so far: a task keeps the best lists of the query chunks it has met, so the
threshold is carried from run to run, and a chunk's list leaves the task once for all its runs.

Queries and blocks meet by an equi-join on a salt: blocks are dealt over the salts, chunks of queries are
copied to every salt.  A task streams pairs of a query chunk and a run of blocks; nothing is collected or broadcast.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import query, shuffle_partitions, table

#: Vectors of a block, blocks that travel together, queries of a chunk.
BLOCK, RUN, CHUNK = 256, 16, 512
#: Query chunks whose best lists a task keeps; beyond that the longest unused goes out and may start anew.
KEPT_CHUNKS = 1024
#: A score or a bound that may reach this raises an error.
LONG = 2.0 ** 63
PACKED = "dim int, part long, ids binary, vectors binary"
#: Id and score of an empty place.
NOBODY, NOTHING = np.iinfo(np.int64).max, -np.iinfo(np.int64).max


def integer_vectors(rows: DataFrame, key: Column, vector: Column, scale: int) -> DataFrame:
    """``id``, ``dim`` and ``vector`` with components ``floor(scale * x)``; unusable vectors are left out.

    A null id, and a vector that is null, empty or holds a null or non-finite component, is unusable.
    A component beyond the range of a long raises an error.
    """
    return (rows.select(key.cast("long").alias("id"), vector.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
            .where(~F.exists("v", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))))
            .select("id", F.size("v").alias("dim"),
                    F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")))


def _pack(most: int):
    """Arrow function that packs sorted rows (dim, id, vector) into runs of at most ``most`` vectors."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = 0, [], None

        def packed(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
            ids = np.array([r[1] for r in rows], "<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]], pa.int32()), pa.array([number], pa.int64()), pa.array([ids.tobytes()]),
                 pa.array([np.stack([r[2] for r in rows]).tobytes()])], ["dim", "part", "ids", "vectors"])

        for batch in batches:
            flat = batch.column(2).flatten().to_numpy()
            at = np.concatenate(([0], np.cumsum(batch.column(0).to_numpy())))
            for i, (dim, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                vector = flat[at[i]:at[i + 1]].astype("<i8")
                if last and last[1] == key and np.array_equal(last[2], vector):
                    continue  # an equal row, be it the last of the run before
                if held and (len(held) >= most or held[0][0] != dim):
                    yield packed(held)
                    number, held = number + 1, []
                last = (dim, key, vector)
                held.append(last)
        if held:
            yield packed(held)
    return work


def pack(vectors: DataFrame, most: int) -> DataFrame:
    """Runs of vectors in the order of their ids."""
    return (vectors.select("dim", "id", "vector").repartitionByRange(shuffle_partitions(vectors.sparkSession), "dim", "id")
            .sortWithinPartitions("dim", "id", "vector").mapInArrow(_pack(most), PACKED))


def _matrix(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<i8").reshape(-1, dim)


def no_scores(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of n queries that have met no row yet."""
    return np.full((n, k), NOBODY, np.int64), np.full((n, k), NOTHING, np.int64)


def best(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int,
         block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one run for every query: places of queries, ids, scores."""
    found, scores = improved(queries, rows, no_scores(len(queries[0]), k), block)
    at = np.nonzero(scores != NOTHING)
    return at[0], found[at], scores[at]


def improved(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray],
             so_far: tuple[np.ndarray, np.ndarray], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The best rows for every query, ids and scores, of those ``so_far`` and one run.

    Exact: products are made in doubles where they stay below 2**53, else in 64-bit integers; where the sum of
    a product's absolute parts may reach 2**63, an error is raised.
    """
    query_ids, q = queries
    ids, d = rows
    (found, known), k = so_far, so_far[0].shape[1]
    sizes = np.abs(q.astype(np.float64)), np.abs(d.astype(np.float64))
    safe = sizes[0].max(initial=0) * sizes[1].max(initial=0) * q.shape[1] < 2 ** 53
    safe = safe and np.abs(known[known != NOTHING].astype(np.float64)).max(initial=0) < 2 ** 53
    if not safe and (sizes[0] @ sizes[1].max(axis=0, initial=0)).max(initial=0) >= LONG * (1 - 1e-12):
        raise ValueError("an inner product of these vectors may be beyond the range of a long")
    kind = np.float64 if safe else np.int64
    q, d = q.astype(kind), d.astype(kind)
    starts = np.arange(0, len(d), block)
    high, low = np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    least = -np.inf if safe else NOTHING
    scores = np.where(known == NOTHING, least, known).astype(kind)
    found = found.copy()
    lines = np.arange(len(q))
    for turn in range(len(starts)):
        next_block = order[:, turn]
        open_ = bounds[lines, next_block] >= scores[:, -1]  # an equal score may have a smaller id
        for b in np.unique(next_block[open_]).tolist():
            who = np.flatnonzero(open_ & (next_block == b))
            own = ids[starts[b]:starts[b] + block]
            product = q[who] @ d[starts[b]:starts[b] + block].T
            product[query_ids[who][:, None] == own[None, :]] = least
            if product.shape[1] > k:  # the k-th largest, then whatever reaches it
                keep = np.argpartition(-product, k - 1, axis=1)[:, :k]
                floor = np.take_along_axis(product, keep, axis=1).min(axis=1)
                tied = (product >= floor[:, None]).sum(axis=1) > k
                for i in np.flatnonzero(tied).tolist():  # ties: the smaller ids
                    keep[i] = np.lexsort((own, -product[i]))[:k]
                product, own_ids = np.take_along_axis(product, keep, axis=1), own[keep]
            else:
                own_ids = np.broadcast_to(own, product.shape)
            all_scores = np.concatenate((scores[who], product), axis=1)
            all_ids = np.concatenate((found[who], np.where(product == least, NOBODY, own_ids)), axis=1)
            rank = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[who] = np.take_along_axis(all_scores, rank, axis=1)
            found[who] = np.take_along_axis(all_ids, rank, axis=1)
    return found, np.where(scores == least, NOTHING, np.where(scores == least, 0, scores).astype(np.int64))


def _score(k: int):
    """Arrow function from pairs of a query chunk and a run to the best rows; a chunk's list goes out at the end."""
    def out(asked: np.ndarray, found: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        at = np.nonzero(scores != NOTHING)
        return pa.RecordBatch.from_arrays([pa.array(asked[at[0]]), pa.array(found[at]), pa.array(scores[at])],
                                          ["query_id", "vec_id", "score"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[tuple, tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                dim, q_ids, q, d_ids, d, number = (batch.column(c)[i].as_py() for c in range(6))
                asked = _matrix(q_ids, q, dim)
                key = (dim, number, q_ids)
                so_far = held.pop(key)[1] if key in held else no_scores(len(asked[0]), k)
                held[key] = asked[0], improved(asked, _matrix(d_ids, d, dim), so_far)
                if len(held) > KEPT_CHUNKS:
                    old, lists = held.popitem(last=False)[1]
                    yield out(old, *lists)
        for old, lists in held.values():
            yield out(old, *lists)
    return work


def search(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """The ``k`` best other vectors of every vector that ``asked`` (a condition on ``id``) picks.

    Returns ``query_id``, ``rank``, ``vec_id``, ``score``; fewer rows where there are fewer candidates;
    ties go to the smaller id.  Vectors of different lengths are never compared.  Rows with the query's id
    are its own and are no candidates.  Equal rows count once; rows that share an id but not the vector
    are candidates each, and as queries ask each and keep the best scores of all.
    """
    spark = vectors.sparkSession
    salts = 2 * shuffle_partitions(spark)
    ready = stage(vectors, "integer-vectors")
    runs = stage(pack(ready, BLOCK * RUN), "vector-runs").withColumn("_salt", F.pmod(F.xxhash64("ids", "part"), salts))
    chunks = stage(pack(ready.where(asked), CHUNK), "query-chunks").select(
        "dim", F.col("part").alias("number"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")).alias("_salt"))
    # not broadcast by a guess: the planner takes the size of the chunks before their copies are made
    pairs = chunks.hint("merge").join(runs, ["dim", "_salt"]).select("dim", "q_ids", "q", "ids", "vectors", "number")
    scored = pairs.mapInArrow(_score(k), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (scored.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op3_topk", TOPK_SQL)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of every 50th vector."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("embedding"), 256)
    return search(vectors, F.col("id") % 50 == 0, 5)
