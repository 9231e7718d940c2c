"""Term statistics by language and source, and how far sources diverge from their language.

Terms are counted where the texts are read.  A term of at most 8 bytes is packed into one 64-bit word, one of
at most 16 bytes into two; words are sorted by radix (16 bits a pass) and equal runs are counted.  Longer terms
go to buckets of equal length that are sorted by bytes.  Only counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import bounded_batches, query, table
from .spans import Spans, spans
from .words import buffers, chunks

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
#: A worker hands on its counts when it has so many.
HELD = 500_000
#: Terms of a block when sources are compared; a block has as many terms as there are sources, if that is more.
BLOCK_TERMS = 512
#: Sources compared at a time within a block.
TILE = 128

COUNTS = "lang string, source string, term string, n long, docs long"


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by unsigned keys, the least significant first, 16 bits a pass."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 64, 16):
            digit = (key >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(found: Spans, chosen: np.ndarray, word: int) -> np.ndarray:
    """The ``word``-th eight bytes of the chosen runs as big-endian 64-bit words, filled up with zero bytes."""
    padded = np.append(found.data, np.zeros(16, np.uint8))
    eight = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    used = np.clip(found.length[chosen] - 8 * word, 0, 8)
    values = eight[np.minimum(found.at[chosen] + 8 * word, len(eight) - 1)].astype(np.uint64)
    shift = (8 * (8 - used)).astype(np.uint64)
    return np.where(used > 0, (values >> (shift % np.uint64(64))) << (shift % np.uint64(64)), np.uint64(0))


def buckets(found: Spans, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length bucket: its runs in the order of group, term and text, and marks where group or term change."""
    short, middle = found.length <= 8, (found.length > 8) & (found.length <= 16)
    for chosen, words in ((np.flatnonzero(short), 1), (np.flatnonzero(middle), 2)):
        if len(chosen):
            keys = [packed(found, chosen, w) for w in reversed(range(words))] + [group[chosen].astype(np.uint64)]
            order = radix_order(keys)
            yield chosen[order], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    long = np.flatnonzero(found.length > 16)
    by_length = long[np.argsort(found.length[long], kind="stable")]
    for chosen in np.split(by_length, np.flatnonzero(np.diff(found.length[by_length])) + 1):
        if len(chosen):
            size = int(found.length[chosen[0]])
            terms = found.data[found.at[chosen][:, None] + np.arange(size)].view(f"S{size}").ravel()
            order = np.argsort(terms, kind="stable")
            order = order[np.argsort(group[chosen][order], kind="stable")]
            yield chosen[order], ((terms[order][1:] != terms[order][:-1])
                                  | (group[chosen][order][1:] != group[chosen][order][:-1]))


def counted(found: Spans, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every pair of a group and a term: one of its runs, how many there are, and in how many texts."""
    reps, counts, texts = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for order, changes in buckets(found, group):
        first = np.flatnonzero(np.append(True, changes))
        owner = found.owner[order]
        fresh = np.append(True, changes | (owner[1:] != owner[:-1]))  # runs of a text stand together: the sort is stable
        reps.append(order[first])
        counts.append(np.diff(np.append(first, len(order))))
        texts.append(np.add.reduceat(fresh.astype(np.int64), first))
    return np.concatenate(reps), np.concatenate(counts), np.concatenate(texts)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, lang, source) to :data:`COUNTS`, summed as far as memory for :data:`HELD` rows goes."""
    held: list[pa.Table] = []
    names = [part.strip().split(" ")[0] for part in COUNTS.split(",")]

    def folded() -> pa.Table:
        whole = pa.concat_tables(held).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")])
        return whole.select(names[:3] + ["n_sum", "docs_sum"]).rename_columns(names)

    for batch in batches:
        offsets, data = buffers(batch.column(0))
        lang, source = (batch.column(k).dictionary_encode() for k in (1, 2))
        pair = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
        for first, last in chunks(offsets):
            found = spans(offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]], LETTERS)
            group = pair[first:last][found.owner]
            reps, counts, texts = counted(found, group)
            if not len(reps):
                continue
            own = group[reps]
            held.append(pa.table({
                "lang": lang.dictionary.take(pa.array(own // len(source.dictionary))).cast(pa.string()),
                "source": source.dictionary.take(pa.array(own % len(source.dictionary))).cast(pa.string()),
                "term": found.strings().take(pa.array(reps)).cast(pa.binary()).cast(pa.string()), "n": counts, "docs": texts}))
            if sum(len(t) for t in held) > 2 * HELD:
                held = [folded()]
                if len(held[0]) > HELD:
                    yield from held.pop().to_batches(max_chunksize=10_000)
    if held:
        yield from folded().to_batches(max_chunksize=10_000)


def term_counts(rows: DataFrame, text: Column, lang: Column, source: Column) -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and number of texts ``docs``, one row each; nulls read as ''.

    A term is a longest run of A-Z, a-z and non-ASCII characters, A-Z lower-cased.  An empty table or texts without
    a letter give no rows; equal rows count as often as they stand there; other columns are ignored.  A text of
    more than half a megabyte is counted on its own and needs some 60 bytes of a worker's memory a byte.
    """
    named = rows.select(*[F.coalesce(c, F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    return named.mapInArrow(count_batches, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def weight(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact for any counts."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return (F.call_function("div", wide, (total + 2 * terms).cast("decimal(20,0)")) + 1).cast("long")


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def compare_sources(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums over the terms of a block for each pair of sources; terms missing in a source have its ``p0``."""
    names = sources.column("source").combine_chunks()
    order = np.argsort(np.array(names.to_pylist(), dtype=object)) if len(names) else np.empty(0, np.int64)
    names, p0 = names.take(pa.array(order)), sources.column("p0").to_numpy()[order]
    place = {name: i for i, name in enumerate(names.to_pylist())}
    own = terms.column("source").combine_chunks().dictionary_encode()
    column = np.array([place[s] for s in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()] if len(own) else np.empty(0, np.int64)
    kinds = terms.column("term").combine_chunks().dictionary_encode()
    row, p = kinds.indices.to_numpy().astype(np.int64), terms.column("p").to_numpy()

    def dense(first: int) -> np.ndarray:
        last = min(first + TILE, len(names))
        cells = np.repeat(p0[first:last][:, None], len(kinds.dictionary), axis=1)
        here = (column >= first) & (column < last)
        cells[column[here] - first, row[here]] = p[here]
        return cells

    left, right, sums = [], [], []
    for a in range(0, len(names), TILE):
        one = dense(a)
        for b in range(a, len(names), TILE):
            other = one if a == b else dense(b)
            for i, line in enumerate(one):
                rest = other[i + 1:] if a == b else other
                gap = rest - line
                sums.append((gap * gap // (rest + line)).sum(axis=1))
                right.append(np.arange(b + i + 1 if a == b else b, b + len(other)))
                left.append(np.full(len(rest), a + i))
    take = lambda parts: names.take(pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
    values = np.concatenate(sums) if sums else np.empty(0, np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()] * len(values), pa.string()), "source": take(left).cast(pa.string()),
                     "item": take(right).cast(pa.string()), "value": pa.array(values, pa.int64())})


def divergence(rows: DataFrame, text: Column, lang: Column, source: Column, least_docs: int = 10,
               top: int = 10) -> DataFrame:
    """How far each source of a language is from its other sources and from the language as a whole.

    Kept are the terms in at least ``least_docs`` texts of their language.  ``part`` 'pair' has a row for each other
    source of the language (``item``), 'term' one for each of the ``top`` terms that the source uses more than
    its language does.  ``value`` is (p - q)^2 / (p + q), floored, summed over all kept terms for pairs; ``rank``
    counts from 1 by value, ties by item.

    Nulls read as ''; a source without terms takes part; a language without kept terms gives pairs with value 0;
    an empty table gives no rows.  Terms are dealt out in blocks, whose sums by pair are added up: no rows of two
    sources are joined, and no task holds more of a language than a block and its list of sources.
    """
    counts = stage(term_counts(rows, text, lang, source), "term-counts")
    groups = rows.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    kept = (counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"))
            .where(F.col("docs") >= least_docs).drop("docs"))
    rows_kept = stage(counts.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    per_source = rows_kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = (rows_kept.groupBy("lang", "term").agg(F.first("of_lang").alias("n"))
                .groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms")))
    sources = (groups.join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
               .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")]))
    sources = stage(sources, "sources")
    many = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"), F.first("terms").alias("terms"))
    blocks = many.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / F.greatest(F.lit(BLOCK_TERMS), "sources"))).cast("int").alias("blocks"))
    known = sources.join(blocks, "lang")
    weighed = rows_kept.join(known, ["lang", "source"]).withColumn("p", weight(F.col("n"), F.col("total"), F.col("terms")))

    terms = weighed.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    empty = F.when(F.col("total") + F.col("terms") > 0, weight(F.lit(0), F.col("total"), F.col("terms"))).otherwise(F.lit(1))
    copies = known.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", empty.alias("p0"))
    sums = (terms.groupBy("lang", "block").cogroup(copies.groupBy("lang", "block"))
            .applyInArrow(compare_sources, "lang string, source string, item string, value long")
            .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    pairs = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "value").select("lang", "e.*", "value")
    ordered = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ordered).alias("rank"))

    q = weight(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
    more = (weighed.withColumn("q", q).where(F.col("p") > F.col("q"))
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
            .withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top))
    return pairs.union(more)


DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
places AS (
  SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
by_doc AS (SELECT d, lang, source, term, count(*) AS n FROM places GROUP BY ALL),
counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n, count(*) AS docs FROM by_doc GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 10),
by_source AS (SELECT c.lang, c.source, c.term, c.n FROM counts c JOIN kept k ON c.lang = k.lang AND c.term = k.term),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM by_source GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total, coalesce(l.v, 0)::HUGEINT AS v, coalesce(l.total, 0)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source
       LEFT JOIN langs l ON g.lang = l.lang),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(s.n, 0) + 2)) // (g.total + 2 * g.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 2)) // (g.lang_total + 2 * g.v))::BIGINT AS q
  FROM groups g JOIN kept k ON g.lang = k.lang
       LEFT JOIN by_source s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query("op11_divergence", DIVERGENCE_SQL)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the other sources and against the language."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return divergence(docs, F.col("text"), F.col("lang"), F.col("source"))
