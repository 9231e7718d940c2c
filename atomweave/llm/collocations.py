"""Phrases of two to four words that stand together more often than their parts explain.

Pass one finds which n-grams can be frequent at all.  N-grams are hashed; the leading bits name a hash partition,
32 more bits the key within it.  Workers send key lists with counts; each partition folds them into one
Misra-Gries summary whose capacity exceeds its mass divided by the threshold, so every frequent n-gram survives.
The survivors are marked in a bit table of fixed size.  Pass two reads the texts again and counts the n-grams whose
bits are set exactly, by their words; what the summaries or equal hashes let through falls to the threshold there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import bounded_batches, query, shuffle_partitions, table
from .spans import spans
from .words import buffers, chunks, mix, word_hashes

ORDERS = 4
WORDS = np.ones(256, dtype=bool)
WORDS[[9, 32, *b".,;:!?", 10, 11, 12, 13]] = False
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that are counted at a time, and counts that a worker holds before it sends them on.
PORTION, HELD = 1 << 20, 1_500_000
#: Different phrases that a worker holds in pass two; twice as many counts are folded at a time.
PHRASES = 800_000
#: Bytes of text for each hash partition; 2 ** LEAST_BITS to 2 ** MOST_BITS partitions.
PART_BYTES, LEAST_BITS, MOST_BITS = 1 << 22, 6, 24
#: A summary has so many times the capacity that its mass divided by the threshold asks for: the more, the fewer
#: n-grams below the threshold survive.
ROOM = 8
#: The bit table of survivors has 2 ** TABLE_BITS bits (32 MB) at any size of the input.
TABLE_BITS = 28
#: Keys of a list that is sent on; counters stop there, far above any threshold.
LIST, FULL = 16_384, (1 << 31) - 1


class Grams:
    """The n-grams of a portion of texts, order by order: distinct n-grams are numbered, so keys are exact."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, langs: list[str], lang: np.ndarray):
        found = spans(offsets, data, WORDS)
        breaks = np.cumsum(BREAKS[data], dtype=np.int64)
        self.piece = (breaks[found.start] + found.owner) if len(found.start) else np.empty(0, np.int64)
        coded = found.strings().dictionary_encode()
        self.vocabulary, self.langs = coded.dictionary, langs
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.lang = lang[found.owner]
        words = pa.LargeStringArray.from_buffers(len(self.vocabulary), *self.vocabulary.buffers()[1:]) if len(self.vocabulary) else pa.array([], pa.large_string())
        at, own = buffers(words)
        self.word_hash = word_hashes(at, own)[0] if len(words) else np.empty(0, np.uint64)
        self.lang_hash = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
        self.order = 0

    def step(self, allowed: np.ndarray | None = None) -> bool:
        """Number the n-grams that are one word longer; with ``allowed`` (a flag for each n-gram numbered last) only
        those whose two parts of all but one word are allowed.  False if there are none."""
        if self.order == 0:
            places, key = np.arange(len(self.word)), self.lang * max(1, len(self.vocabulary)) + self.word
        else:
            places = self.places[:-1][np.diff(self.places) == 1] if len(self.places) else self.places
            places = places[self.piece[places] == self.piece[np.minimum(places + self.order, len(self.piece) - 1)]]
            places = places[places + self.order < len(self.piece)]
            if allowed is not None and len(places):
                places = places[allowed[self.number[places]] & allowed[self.number[places + 1]]]
            key = self.number[places] * len(self.first) + self.first_number[places + self.order]
        self.order += 1
        if not len(places):
            return False
        sort = np.argsort(key)
        fresh = np.append(True, np.diff(key[sort]) != 0)
        starts = np.flatnonzero(fresh)
        before = self.hash[self.number[places[sort[starts]]]] if self.order > 1 else self.lang_hash[self.lang[places[sort[starts]]]]
        self.at = places[sort[starts]]
        self.count = np.diff(np.append(starts, len(places)))
        last = self.word_hash[self.word[self.at + self.order - 1]]
        self.number = np.zeros(len(self.word), np.int64)
        self.number[places[sort]] = np.cumsum(fresh) - 1
        self.hash = mix(before * _FACTOR + last + np.uint64(self.order))
        self.places = places
        if self.order == 1:
            self.first_number, self.first = self.number, self.at
        return True

    def phrases(self, chosen: np.ndarray) -> pa.Array:
        """The words of the n-grams numbered last, joined by spaces."""
        at = self.at[chosen]
        words = [self.vocabulary.take(pa.array(self.word[at + k])) for k in range(self.order)]
        joined = words[0] if self.order == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))
        return joined.cast(pa.binary()).cast(pa.string())


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[Grams]:
    """The n-grams of (text, lang) in portions of :data:`PORTION` bytes, one text at least."""
    for batch in batches:
        offsets, data = buffers(batch.column(0))
        lang = batch.column(1).dictionary_encode()
        names, code = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64)
        for first, last in chunks(offsets, PORTION):
            yield Grams(offsets[first:last + 1] - offsets[first], data[offsets[first]:offsets[last]], names, code[first:last])


def key_lists(bits: int):
    """Arrow function: the n-grams' keys by hash partition, after the mass of each partition (``list`` 0)."""
    def send(hashes: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        low = np.concatenate(hashes) >> np.uint64(32 - bits)
        order = np.argsort(low)
        low, count = low[order], np.concatenate(counts)[order]
        first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        low, count = low[first], np.add.reduceat(count, first)
        part = (low >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(edges[1:], len(part))
        key, rows = low.astype(np.uint32), []
        for a, b, mass in zip(edges.tolist(), ends.tolist(), np.add.reduceat(count, edges).tolist(), strict=True):
            rows.append((int(part[a]), 0, mass, None, None, None))
            for n, at in enumerate(range(a, b, LIST), 1):
                own = count[at:min(b, at + LIST)]
                many = np.flatnonzero(own > 1)
                rows.append((int(part[a]), n, 0, key[at:min(b, at + LIST)].tobytes(), many.astype(np.uint16).tobytes(),
                             np.minimum(own[many], FULL).astype(np.uint32).tobytes()))
            if len(rows) >= 500:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          ["part", "list", "mass", "keys", "many", "counts"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, size = [], [], 0
        for grams in portions(batches):
            while grams.order < ORDERS and grams.step():
                hashes.append(grams.hash)
                counts.append(grams.count)
                size += len(grams.hash)
            if size > HELD:
                yield from send(hashes, counts)
                hashes, counts, size = [], [], 0
        if size:
            yield from send(hashes, counts)
    return read


KEYS = "part long, list int, mass long, keys binary, many binary, counts binary"


class Summary:
    """Misra-Gries summary of one hash partition: at most ``capacity`` counters, each too low by ``lost`` at most.

    ``lost`` stays below mass / capacity: lowering all counters by s, until ``capacity`` are left, takes away
    s * (capacity + 1) of the mass at least.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost, self.waiting, self.size = capacity, 0, [], 0
        self.packed = np.empty(0, np.uint64)  # key << 32 | counter, sorted

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append(keys.astype(np.uint64) << np.uint64(32) | counts.astype(np.uint64))
        self.size += len(keys)
        if self.size > max(LIST, self.capacity):
            self.fold()

    def fold(self) -> None:
        both = np.concatenate((self.packed, *self.waiting))
        both.sort()
        self.waiting, self.size = [], 0
        if not len(both):
            return
        keys = both >> np.uint64(32)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counters = np.minimum(np.add.reduceat(both & np.uint64(0xFFFFFFFF), first), FULL)
        keys = keys[first]
        if len(keys) > self.capacity:
            cut = np.partition(counters, len(counters) - self.capacity - 1)[len(counters) - self.capacity - 1]
            self.lost += int(cut)
            kept = counters > cut
            keys, counters = keys[kept], counters[kept] - cut
        self.packed = keys << np.uint64(32) | counters

    def survivors(self, threshold: int) -> np.ndarray:
        """Keys that may occur ``threshold`` times."""
        self.fold()
        return (self.packed >> np.uint64(32))[(self.packed & np.uint64(0xFFFFFFFF)) + np.uint64(self.lost) >= threshold]


def marks(bits: int, threshold: int):
    """Arrow function: rows of :func:`key_lists`, sorted by partition and list, to each partition's stretch of the bit table."""
    width = 1 << (TABLE_BITS - bits)

    def stretch(part: int, summary: Summary) -> pa.RecordBatch:
        own = np.zeros(width, dtype=bool)
        own[(summary.survivors(threshold) >> np.uint64(32 - (TABLE_BITS - bits))).astype(np.int64)] = True
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["part", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != part:
                    if summary is not None:
                        yield stretch(part, summary)
                    part, mass, summary = row[0], 0, None
                if row[1] == 0:  # the mass of all lists comes before the lists
                    mass += row[2]
                    continue
                summary = summary or Summary(ROOM * mass // threshold + 1)
                counts = np.ones(len(row[3]) // 4, np.uint32)
                counts[np.frombuffer(row[4], np.uint16)] = np.frombuffer(row[5], np.uint32)
                summary.add(np.frombuffer(row[3], np.uint32), counts)
        if summary is not None:
            yield stretch(part, summary)
    return merge


def part_bits(rows: DataFrame) -> int:
    """Leading bits of a hash that name its partition, from the bytes of all texts."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, int(-(-size // PART_BYTES)).bit_length()))


def dealt(lists: DataFrame, bits: int, *order: str) -> DataFrame:
    """Lists of one hash partition one after the other."""
    tasks = min(1 << bits, max(shuffle_partitions(lists.sparkSession), 1))
    return lists.repartition(tasks, "part").sortWithinPartitions("part", *order)


def survivor_table(rows: DataFrame, threshold: int, bits: int) -> np.ndarray:
    """Pass one over (text, lang): the bit table of n-grams that may occur ``threshold`` times."""
    lists = dealt(rows.mapInArrow(key_lists(bits), KEYS), bits, "list")
    found = np.zeros((1 << TABLE_BITS) // 8, np.uint8)
    step = len(found) >> bits
    for row in lists.mapInArrow(marks(bits, threshold), "part long, bits binary").collect():  # the table's 32 MB, at any size
        found[row.part * step:(row.part + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return found


NAMES = ["lang", "phrase", "n"]


def folded(held: list[pa.Table], *more: str) -> pa.Table:
    """Counts of equal phrases added up."""
    return pa.concat_tables(held).group_by([*more, *NAMES[:2]]).aggregate([("n", "sum")]).rename_columns([*more, *NAMES])


COUNTS = "part long, lang array<string>, phrase array<string>, n array<long>"


def exact_counts(table_of_bits, bits: int):
    """Arrow function from (text, lang) to the counts of the n-grams whose bits are set, and those of all their parts, one
    list for each hash partition; a null phrase counts all words of the language."""
    def lists(found: pa.Table) -> pa.RecordBatch:
        found = found.sort_by("part").combine_chunks()
        part = found.column("part").to_numpy()
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = pa.array(np.append(edges, len(part)), pa.int32())
        columns = [pa.ListArray.from_arrays(ends, found.column(c).combine_chunks()) for c in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(part[edges]), *columns], names=["part", *NAMES])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = np.frombuffer(table_of_bits.value, np.uint8), []
        for grams in portions(batches):
            if len(grams.word):
                langs = pa.array(grams.langs, pa.string())
                total = np.bincount(grams.lang, minlength=len(grams.langs))
                held.append(pa.table({"part": np.zeros(len(langs), np.int64), "lang": langs, "phrase": pa.nulls(len(langs), pa.string()), "n": total}))
            allowed = None
            while grams.order < ORDERS and grams.step(allowed):
                place = (grams.hash >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                allowed = (table[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
                chosen = np.flatnonzero(allowed)
                held.append(pa.table({"part": (grams.hash[chosen] >> np.uint64(64 - bits)).astype(np.int64),
                                      "lang": langs.take(pa.array(grams.lang[grams.at[chosen]])), "phrase": grams.phrases(chosen), "n": grams.count[chosen]}))
            if sum(len(t) for t in held) > 2 * PHRASES:
                held = [folded(held, "part")]
                if len(held[0]) > PHRASES:
                    yield lists(held.pop())
        if held:
            yield lists(folded(held, "part"))
    return count


def added_up(threshold: int):
    """Arrow function: lists of :func:`exact_counts`, sorted by partition, to the phrases that occur ``threshold`` times."""
    def out(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        whole = folded(held)
        kept = pc.or_(pc.greater_equal(whole.column("n"), threshold), pc.is_null(whole.column("phrase")))
        yield from whole.filter(kept).to_batches(max_chunksize=10_000)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for i, own in enumerate(batch.column(0).to_pylist()):
                if own != part and held:
                    yield from out(held)
                    held = []
                part = own
                held.append(pa.table({c: batch.column(k)[i].values for k, c in enumerate(NAMES, 1)}))
                if sum(len(t) for t in held) > 2 * PHRASES:
                    held = [folded(held)]
        if held:
            yield from out(held)
    return add


def phrase_counts(rows: DataFrame, text: Column, lang: Column, threshold: int) -> DataFrame:
    """``lang``, ``phrase``, ``n`` of all phrases of one to four words that occur ``threshold`` times in a language, exactly;
    and with a null phrase the number of words of each language.

    Null texts are empty, a null language is 'und'; words keep their case but for A-Z; an empty table gives no rows.
    """
    named = rows.select(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(lang, F.lit("und")).alias("lang"))
    bits = part_bits(named)
    table_of_bits = rows.sparkSession.sparkContext.broadcast(survivor_table(named, threshold, bits).tobytes())
    lists = dealt(named.mapInArrow(exact_counts(table_of_bits, bits), COUNTS), bits)
    return lists.mapInArrow(added_up(threshold), "lang string, phrase string, n long")


def collocations(rows: DataFrame, text: Column, lang: Column, threshold: int = 30, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of two to four words of each language by how tightly they hold together.

    A phrase with ``a`` occurrences, cut after its first k words into parts with ``l`` and ``r``, scores
    floor(2000000 a / (l + r)); its weakest cut counts, ties to the smallest k.  Phrases with fewer than
    ``threshold`` occurrences, and those inside a longer phrase that has at least 80 of 100 of their
    occurrences, are left out.  Ties in score go by occurrences, then by bytes of the phrase.

    Null texts are empty, a null language is 'und', equal rows count each; a language without such a phrase and an
    empty table give no rows.  A text of over two megabytes is counted on its own and needs some 150 bytes of a
    worker's memory a byte.
    """
    counts = stage(phrase_counts(rows, text, lang, threshold), "phrases")
    frequent = counts.where(F.col("phrase").isNotNull())
    words = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "))) + 1
    longer = frequent.withColumn("words", words).where("words > 1").withColumnRenamed("n", "a")
    cut = lambda k: F.when(F.col("words") > k, F.struct(
        F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"), F.expr(f"substring_index(phrase, ' ', {k} - words)").alias("right")))
    cuts = longer.select("lang", "phrase", "a", F.explode(F.array_compact(F.array(cut(1), cut(2), cut(3)))).alias("c")).select("lang", "phrase", "a", "c.*")
    side = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    known = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)"), (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    worst = known.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("m"))

    inner = lambda i, m: F.when(F.col("words") >= i + m + (1 if i == 0 else 0), F.expr(f"substring_index(substring_index(phrase, ' ', {i + m}), ' ', -{m})"))
    parts = [inner(i, m) for m, starts in ((2, 3), (3, 2)) for i in range(starts)]
    covers = (longer.where("words > 2").select("lang", "a", F.explode(F.array_compact(F.array(*parts))).alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("a").alias("cover")))
    kept = worst.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * F.col("cover") < 80 * F.col("a")))
    best = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    totals = counts.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("n"))
    return (ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"),
                                               "n", F.col("m.score").alias("score")))


COLLOCATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
cut AS (SELECT d, lang, string_split_regex(t, '[.,;:!?\x0A-\x0D]') AS pieces FROM docs),
pieces AS (SELECT d, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS p FROM cut),
lists AS (SELECT d, lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
words AS (SELECT d, lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM lists),
grams AS (
  SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4
  FROM words WINDOW s AS (PARTITION BY d, p ORDER BY i)),
phrases AS (
  SELECT lang, w1 AS phrase, 1 AS m, count(*) AS n FROM grams GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2, 2, count(*) FROM grams WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM grams WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM grams WHERE w4 IS NOT NULL GROUP BY ALL),
frequent AS (SELECT *, string_split(phrase, ' ') AS ws FROM phrases WHERE n >= 30),
cuts AS (
  SELECT f.lang, f.phrase, f.n AS a, k, array_to_string(f.ws[1:k], ' ') AS lhs, array_to_string(f.ws[k + 1:f.m], ' ') AS rhs
  FROM frequent f, (VALUES (1), (2), (3)) AS c(k) WHERE k < f.m),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.n AS l, y.n AS r, (2000000::HUGEINT * c.a // (x.n + y.n))::BIGINT AS score,
         row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 2000000::HUGEINT * c.a // (x.n + y.n), k) AS place
  FROM cuts c JOIN frequent x ON x.lang = c.lang AND x.phrase = c.lhs JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rhs),
inside AS (
  SELECT f.lang, array_to_string(f.ws[i:i + len - 1], ' ') AS phrase, max(f.n) AS cover
  FROM frequent f, (VALUES (1, 2), (2, 2), (3, 2), (1, 3), (2, 3)) AS s(i, len) WHERE i + len - 1 <= f.m AND len < f.m GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN inside o ON s.lang = o.lang AND s.phrase = o.phrase
  WHERE place = 1 AND (cover IS NULL OR 100 * cover < 80 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATION_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tightest phrases of each language."""
    bounded_batches(spark)
    return collocations(table(spark, sf_dir, "documents"), F.col("text"), F.col("lang"))
