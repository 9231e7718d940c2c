"""Small awkward tables: nulls, empty and long texts, ties, repeated rows, and clashing extra columns."""

import random

from pyspark.sql import functions as F

EXTRA = "id long, size long, shard int, slot long, taken long, node long, bucket int, u long, v long, label string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def sentence(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(words))


def edited(text: str, seed: int, edits: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = "x%d" % rng.randrange(10 ** 6)
    return " ".join(words)


def documents(spark):
    base = sentence(1, 120)
    texts = [None, "", "   \n\t", "one", "One\vtwo", "a b c d e", "A  B C\nd E", "a b c d e f", "é ü ñ 日本 🎉",
             "word " * 3000, "x" * 70000 + " tail", base, base, base.upper(), sentence(2, 300)]
    texts += [edited(base, i, i % 9) for i in range(30)]
    texts += [sentence(100 + i, 40) for i in range(15)]
    rows = [(i * 3, t, None if i % 7 == 0 else ("en", "fr")[i % 2], None if i % 5 == 0 else "s%d" % (i % 3), 0)
            for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[1], (None, base, None, None, None), (None, "nobody", None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [part.strip().split(" ") for part in EXTRA.split(",")]
    return frame.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in names]).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def shingles(text):
    found = words(text)
    if not found:
        return frozenset()
    return frozenset([tuple(found)] if len(found) < 5 else [tuple(found[i:i + 5]) for i in range(len(found) - 4)])


def save(frame, folder, name):
    frame.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
