"""Byte-level BPE: encode whole texts by a rank table, and decode ids back to bytes.

A text is split by the tokenizer's pattern; every distinct piece of a portion of texts is encoded once by
folding ranked merges over its bytes, and texts are put together from the encoded pieces.  Texts never
leave the task that reads them: there is no shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, query, table

#: Encoded pieces a worker keeps; when full, it starts anew.
KEPT = 200_000
#: Up to this many bytes the cheapest merge is searched by a scan, beyond by a heap.
SHORT = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of every token in a rank file (base64 token, rank)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def pair_table(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """For every token id the ids it can be followed by in a merge, with the merged token's id."""
    nothing: dict[int, int] = {}
    follow = [nothing] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                if follow[left] is nothing:
                    follow[left] = {}
                follow[left][right] = rank
    return follow


def merge(piece: bytes, ranks: dict[bytes, int], follow: list[dict[int, int]]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank is joined, the leftmost of equals first, to the end."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) > SHORT:
        return _merge_long(piece, ranks)
    none = len(follow)
    ids = [ranks[piece[i:i + 1]] for i in range(len(piece))]
    costs = [follow[a].get(b, none) for a, b in zip(ids, ids[1:])]
    while costs:
        least = min(costs)
        if least == none:
            break
        at = costs.index(least)
        ids[at] = least
        del ids[at + 1], costs[at]
        if at < len(costs):
            costs[at] = follow[least].get(ids[at + 1], none)
        if at:
            costs[at - 1] = follow[ids[at - 1]].get(least, none)
    return ids


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap over linked parts, for pieces of any length."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, at, stop = heapq.heappop(heap)
        other = after[at] if alive[at] else n
        if other >= n or end[other] != stop:
            continue  # one of the parts has grown since
        end[at], after[at], alive[other] = stop, after[other], False
        if after[at] < n:
            before[after[at]] = at
            far = end[after[at]]
            if (rank := ranks.get(piece[at:far])) is not None:
                heapq.heappush(heap, (rank, at, far))
        if before[at] >= 0 and (rank := ranks.get(piece[before[at]:stop])) is not None:
            heapq.heappush(heap, (rank, before[at], stop))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at:end[at]]])
        at = after[at]
    return out


class Codec:
    """Encodes and decodes with one rank table; keeps a bounded number of encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.follow, self.split = ranks, pair_table(ranks), regex.compile(pattern).findall
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found, known = self.split(text), self.known
        for piece in set(found).difference(known):
            if len(known) >= KEPT:
                known = self.known = {p: known[p] for p in set(found) if p in known}
            known[piece] = np.array(merge(piece.encode(), self.ranks, self.follow), "<u4").tobytes()
        return b"".join([known[p] for p in found])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of all ids, one after the other."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _codec(shared: dict, pattern: str) -> Codec:
    """The worker's codec for a pattern; it stays in the worker's copy of the broadcast value."""
    if ("codec", pattern) not in shared:
        shared["codec", pattern] = Codec(shared["ranks"], pattern)
    return shared["codec", pattern]


def encode(rows: DataFrame, key: Column, text: Column, path: str, pattern: str) -> DataFrame:
    """``id`` and ``ids`` (little-endian unsigned 32-bit integers) of every row; a null text is empty.

    The rank table (a file of fixed size, here about 50,000 tokens) is read on the driver and sent to the
    workers.  Special tokens are ordinary text.  Other columns are ignored.
    """
    ranks = rows.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ids = [codec.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary())],
                                                 ["id", "ids"])

    named = rows.select(key.alias("id"), text.alias("text"))
    return named.mapInArrow(work, f"id {named.schema['id'].dataType.simpleString()}, ids binary")


def decode(rows: DataFrame, key: Column, ids: Column, path: str) -> DataFrame:
    """``id`` and ``bytes`` of every row of ids; null ids are empty, an unknown id raises an error."""
    ranks = rows.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, public_tokenizers.PATTERN)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out = [codec.decode(i or b"") for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    named = rows.select(key.alias("id"), ids.alias("ids"))
    return named.mapInArrow(work, f"id {named.schema['id'].dataType.simpleString()}, bytes binary")


def fold_words(words: DataFrame, word: Column, path: str, buckets: int = 8192) -> DataFrame:
    """``word`` and ``ids`` of every row of distinct words by higher-order functions alone.

    The rank table is one literal: an array of small maps, one per hash value, as a map is searched from
    end to end.  ``aggregate`` folds merges over the array of byte pieces; each step joins the leftmost
    pair of least rank.  Cost grows with the square of a word's length.
    """
    ranks = read_ranks(path)
    spark = words.sparkSession
    table_rows = spark.createDataFrame([(bytearray(t), r) for t, r in ranks.items()], "t binary, r int")
    slots = (table_rows.groupBy(F.pmod(F.xxhash64("t"), F.lit(buckets)).alias("b"))
             .agg(F.map_from_entries(F.collect_list(F.struct("t", "r"))).alias("m"))).collect()
    maps = {row["b"]: row["m"] for row in slots}
    literal = F.array(*[F.create_map(*[F.lit(x) for t, r in maps.get(b, {}).items() for x in (bytes(t), r)])
                        if b in maps else F.create_map().cast("map<binary,int>") for b in range(buckets)])
    none = F.lit(2 ** 31 - 1)

    def rank(piece: Column) -> Column:
        slot = F.element_at(literal, (F.pmod(F.xxhash64(piece), F.lit(buckets)) + 1).cast("int"))
        return F.coalesce(F.try_element_at(slot, piece), none)

    def step(parts: Column, _: Column) -> Column:
        costs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1),
                            lambda i: rank(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))))
        at = F.array_position(costs, F.array_min(costs)).cast("int")
        joined = F.concat(F.slice(parts, 1, at - 1),
                          F.array(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1))),
                          F.slice(parts, at + 2, F.size(parts)))
        return F.when((F.size(parts) > 1) & (F.array_min(costs) < none), joined).otherwise(parts)

    data = F.encode(word, "UTF-8")
    single = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.substring(data, i, 1))
    merged = F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), single, step)
    return words.select(word.alias("word"), F.transform(merged, rank).alias("ids"))


def digests(rows: DataFrame, key: Column, text: Column, path: str, pattern: str) -> DataFrame:
    """``id``, ``n_tokens`` and the SHA-256 of the ids and of the bytes decoded from them, in one pass."""
    ranks = rows.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            counts, coded, decoded = [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py() or "")
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    named = rows.select(key.alias("id"), text.alias("text"))
    return named.mapInArrow(work, f"id {named.schema['id'].dataType.simpleString()}, n_tokens long, "
                                  "ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``docs`` with ``n_tokens``, ``ids`` (see :func:`encode`) and ``decoded_sha256`` in place of ``text``.

    The digest is that of the bytes decoded from the ids.  Columns of ``docs`` that have one of these names stay as
    ``input_<name>``.
    """
    names = ("n_tokens", "ids", "decoded_sha256")
    others = [F.col(f"`{c}`").alias(f"input_{c}" if c in names else c) for c in docs.columns if c != "text"]
    ranks = docs.sparkSession.sparkContext.broadcast({"ranks": read_ranks(path)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            coded = [codec.encode(value.as_py() or "") for value in batch.column(1)]
            decoded = [hashlib.sha256(codec.decode(ids)).hexdigest() for ids in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(ids) // 4 for ids in coded], pa.int64()), pa.array(coded, pa.binary()),
                 pa.array(decoded, pa.string())], ["id", *names])

    named = docs.select(F.struct(*others).alias("id"), "text")
    found = named.mapInArrow(work, f"id {named.schema['id'].dataType.simpleString()}, n_tokens long, ids binary, decoded_sha256 string")
    return found.select("id.*", *names)


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    bounded_batches(spark)
    found = digests(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"),
                    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")
