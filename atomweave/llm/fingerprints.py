"""Document fingerprints by locally consistent parsing.

A text's bytes are the symbols of level 0.  On each level runs of one symbol are first joined; then
deterministic coin tossing labels every symbol: the label is the lowest bit in which the symbol differs
from its left neighbour, with that bit's value, and labels are tossed again until few values are left.
Neighbours never share a label, so local maxima are close together; a phrase begins at each, and the
hash of its symbols is the symbol's name on the next level.  Where phrases begin depends on a few
neighbours only, so equal substrings get equal phrases inside, wherever they stand.

The fingerprint is a sketch of the phrase names of all levels from 9 bytes or so upwards: 64 bins, each
with 16 bits of the least name in it.  Likeness is the share of equal bins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, query, shuffle_partitions, table
from .words import buffers, chunks, mix

SLOTS, FIRST_LEVEL, PIECE = 64, 2, 1 << 18
EMPTY = np.uint64(2 ** 64 - 1)


def _toss_table(labels: int) -> np.ndarray:
    """Label of a symbol below ``labels`` by its left neighbour."""
    own, left = np.meshgrid(np.arange(labels), np.arange(labels), indexing="ij")
    differs = own ^ left
    bit = np.bitwise_count(((differs & -differs) - 1) & 0xFF)
    bit[differs == 0] = 0
    return (2 * bit + ((own >> bit) & 1)).astype(np.uint8)


_WORDS, _SMALL, _LEAST = _toss_table(128), _toss_table(16), _toss_table(8)


def _labels(symbols: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Labels below 8 for symbols that differ from their left neighbours; ``fresh`` marks texts' first symbols."""
    left = np.empty_like(symbols)
    left[1:], left[:1] = symbols[:-1], 0
    left[fresh] = symbols[fresh] ^ np.uint64(1)
    left ^= symbols
    left &= -left
    bit = np.bitwise_count(left - np.uint64(1))
    label = 2 * bit + ((symbols >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for toss in (_WORDS, _SMALL, _LEAST):
        before = np.empty_like(label)
        before[1:], before[:1] = label[:-1], 0
        before[fresh] = label[fresh] ^ 1
        label = toss[label, before]
    return label


def _level(symbols: np.ndarray, owner: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and owners of the next level."""
    change = np.empty(len(symbols), bool)
    change[:1] = True
    np.not_equal(owner[1:], owner[:-1], out=change[1:])
    differs = np.not_equal(symbols[1:], symbols[:-1])
    differs |= change[1:]
    starts = np.flatnonzero(np.append(True, differs))
    symbols = symbols.astype(np.uint64, copy=False)  # whatever the batch holds: equal texts get equal names
    if len(starts) < len(symbols):
        length = np.diff(np.append(starts, len(symbols)))
        symbols, owner, change = symbols[starts], owner[starts], change[starts]
        run = length > 1
        symbols[run] = mix(symbols[run] ^ mix(length[run].astype(np.uint64) + np.uint64(0xA5A5)))
    fresh = np.flatnonzero(change)
    label = _labels(symbols, fresh)
    peak = change.copy()
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    for edge in (np.minimum(fresh + 1, len(peak) - 1), np.append(fresh[1:], len(peak)) - 1):
        peak[edge] = change[edge]  # no phrase of one symbol at a text's start, nor one begun by its last symbol
    start = np.flatnonzero(peak)
    length = np.diff(np.append(start, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(start, length)
    value = mix(symbols.astype(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(value, start) + np.uint64(level * 1000003)), owner[start]


def sketches(texts: pa.Array) -> np.ndarray:
    """Least phrase name per bin (rows of 64, all ones where a bin is empty) of every text, null as empty."""
    offsets, data = buffers(texts)
    out = np.full((len(offsets) - 1, SLOTS), EMPTY, np.uint64)
    for first, last in chunks(offsets, PIECE):
        at = offsets[first:last + 1]
        symbols = data[at[0]:at[-1]]
        owner = np.repeat(np.arange(last - first, dtype=np.int32), np.diff(at))
        flat, level = out[first:last].reshape(-1), 0
        while len(symbols):
            symbols, owner = _level(symbols, owner, level)
            level += 1
            edge = np.empty(len(owner), bool)
            edge[:1], edge[1:] = True, owner[1:] != owner[:-1]
            single = edge & np.append(edge[1:], True)
            counted = slice(None) if level >= FIRST_LEVEL else single
            names, whose = symbols[counted], owner[counted]
            np.minimum.at(flat, whose.astype(np.int64) * SLOTS + (names & np.uint64(SLOTS - 1)).astype(np.int64),
                          names >> np.uint64(6))
            symbols, owner = symbols[~single], owner[~single]
    return out


def spelled(sketch: np.ndarray) -> list[str]:
    """Four hex digits per bin; dashes where it is empty."""
    short = (mix(sketch) & np.uint64(0xFFFF)).astype(">u2").tobytes().hex()
    width = SLOTS * 4
    out = [short[i * width:(i + 1) * width] for i in range(len(sketch))]
    for i in np.flatnonzero((sketch == EMPTY).any(axis=1)).tolist():
        out[i] = "".join("----" if gone else out[i][4 * k:4 * k + 4] for k, gone in enumerate(sketch[i] == EMPTY))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those not empty in both; two empty texts are alike."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def fingerprint(rows: DataFrame, key: Column, text: Column) -> DataFrame:
    """``id`` and ``fingerprint`` of every row; null texts are empty.  Other columns are ignored."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spelled(sketches(batch.column(1))))],
                                             ["id", "fingerprint"])

    named = rows.select(key.alias("id"), text.alias("text"))
    return named.mapInArrow(work, f"id {named.schema['id'].dataType.simpleString()}, fingerprint string")


def descending_neighbours(rows: DataFrame, key: Column, text: Column, buckets: int | None = None) -> DataFrame:
    """Rows as ``bucket``, ``copied``, ``id``, ``text`` such that a row's next one (descending id, then from
    the start again) follows it within its bucket.

    Buckets are ranges of ids between quantiles.  The first row of each bucket is copied to the end of the
    bucket before it, marked as a copy.  Null ids come last; equal ids are ordered by text.  Texts are
    shuffled once.
    """
    spark = rows.sparkSession
    buckets = buckets or 4 * shuffle_partitions(spark)
    ids = rows.select(key.cast("long").alias("id"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(ids.agg(F.percentile_approx("id", shares, 10000)).first()[0] or []))  # below 1 per bucket
    literal = F.lit(cuts) if cuts else F.array().cast("array<long>")

    def bucket(value: Column) -> Column:
        return F.when(value.isNull(), len(cuts) + 1).otherwise(F.size(F.filter(literal, lambda c: c > value)))

    everything = Window.orderBy("bucket")  # one row per bucket
    heads = (ids.groupBy(bucket(F.col("id")).alias("bucket")).agg(F.max("id").alias("_head"))
             .withColumn("_last", F.max("bucket").over(Window.partitionBy()))
             .select("_head", F.coalesce(F.lag("bucket").over(everything), "_last").alias("_goes")))
    marked = (rows.select(key.cast("long").alias("id"), text.alias("text"))
              .join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("_head")), "left"))
    own = F.struct(bucket(F.col("id")).alias("bucket"), F.lit(False).alias("copied"))
    copy = F.struct(F.col("_goes").alias("bucket"), F.lit(True).alias("copied"))
    placed = marked.withColumn("_p", F.explode(F.when(F.col("_goes").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return (placed.select("_p.bucket", "_p.copied", "id", "text").repartition(buckets, "bucket")
            .sortWithinPartitions("bucket", "copied", F.col("id").desc_nulls_last(), "text"))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of every row, of its edited text, and their likeness; reads a row with its next one."""
    held: tuple[int, int | None, str, np.ndarray] | None = None
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            sketch = sketches(part.column(3))
            rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(),
                            [t or "" for t in part.column(3).to_pylist()], sketch, strict=True))
            done = []
            for bucket, copied, key, text, own in rows:
                if held is not None and held[0] == bucket:
                    done.append((held[1], held[2], text, held[3], own))
                held = None if copied else (bucket, key, text, own)
            if not done:
                continue
            edited = [text[:len(text) - len(text) // 3] + after[:len(text) // 3] for _, text, after, _, _ in done]
            ours, next_ = np.stack([d[3] for d in done]), np.stack([d[4] for d in done])
            theirs = sketches(pa.array(edited, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int64()), pa.array([len(d[1]) for d in done], pa.int64()),
                 pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(spelled(ours)),
                 pa.array(spelled(theirs)), pa.array(likeness(ours, theirs)), pa.array(likeness(ours, next_))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(rows: DataFrame, key: Column, text: Column, buckets: int | None = None) -> DataFrame:
    """Fingerprints of all texts and of their edited texts (last third from the next text)."""
    return descending_neighbours(rows, key, text, buckets).mapInArrow(
        _edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")


@query("op4_fingerprints")
def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    bounded_batches(spark)
    return edited_fingerprints(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
