"""Source divergence, collocations and licences on awkward texts, against brute force."""

import random
import re
from collections import Counter, defaultdict

import nasty
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atomweave.llm import collocations, divergence, licenses, spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG_WORD = "pneumonoultramicroscopic" * 3


def texts_with_terms():
    """Rows of (text, lang, source): terms of all lengths, ties, a source without terms, a language without kept terms."""
    rng = random.Random(3)
    pool = ["a", "bc", "eightlet", "ninelette", "sixteen" * 2 + "xy", "seventeenletters" + "z", "é" * 4, "é" * 5, "日本" * 4, LONG_WORD, "Über"]
    rows = []
    for i in range(160):
        own = pool[i % 3:] if i % 2 else pool
        rows.append(("-".join(rng.choice(own) for _ in range(rng.randrange(12))) + "!", ("en", "fr")[i % 2], "s%d" % (i % 5)))
    rows += [(None, None, None), ("", "en", None), ("12 34", "en", "none"), ("solo words", "zz", "s1"), ("solo", "zz", "s2")]
    rows += [rows[3]] * 12
    return rows


def brute_divergence(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)

        def weights(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own = {s: weights(counts[lang, s]) for s in sources}
        q = weights(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            terms = [(-f(own[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and own[s][t] > q[t]]
            out |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def test_divergence(spark, monkeypatch):
    rows = texts_with_terms()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", F.lit(1).alias("n"), F.lit("x").alias("term")).repartition(4)
    for sizes in ((512, 128), (2, 2)):
        monkeypatch.setattr(divergence, "BLOCK_TERMS", sizes[0])
        monkeypatch.setattr(divergence, "TILE", sizes[1])
        got = divergence.divergence(docs, F.col("text"), F.col("lang"), F.col("source")).collect()
        assert {tuple(r) for r in got} == brute_divergence(rows) and len(got) == len({tuple(r) for r in got})
    assert divergence.divergence(docs.limit(0), F.col("text"), F.col("lang"), F.col("source")).count() == 0


def test_divergence_of_awkward_documents(spark, tmp_path):
    docs = nasty.documents(spark)
    got = divergence.op11_divergence(spark, nasty.save(docs, tmp_path, "documents")).collect()
    assert {tuple(r) for r in got} == brute_divergence([(r.text, r.lang, r.source) for r in docs.collect()])


def test_weights_are_exact_beyond_64_bits(spark):
    n, total, terms = 9 * 10 ** 15, 2 * 10 ** 16 + 1, 12345
    row = spark.range(1).select(divergence.weight(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (n + 2) // (total + 2 * terms)


def test_packing_and_radix_sort(spark):
    words = sorted({w for t, _, _ in texts_with_terms() for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")})
    random.Random(1).shuffle(words)
    data = np.frombuffer(" ".join(words * 3).encode(), np.uint8)
    found = spans.spans(np.array([0, len(data)]), data, divergence.LETTERS)
    reps, counts, docs = divergence.counted(found, np.zeros(len(found.start), np.int64))
    got = {found.strings()[i].as_py().decode(): n for i, n in zip(reps.tolist(), counts.tolist(), strict=True)}
    assert got == Counter(w.translate(LOWER) for w in words * 3) and set(docs.tolist()) == {1}
    keys = [np.random.RandomState(k).randint(0, 2 ** 63, 1000).astype(np.uint64) // np.uint64(10 ** 15) for k in (1, 2)]
    assert divergence.radix_order(keys).tolist() == np.lexsort(keys).tolist()


def brute_collocations(rows, threshold=30, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for m in range(1, 5):
                counts[lang or "und"].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, own in counts.items():
        frequent = {g: n for g, n in own.items() if n >= threshold}
        ranked = []
        for g, a in frequent.items():
            if len(g) < 2:
                continue
            longer = [n for h, n in frequent.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))]
            if any(100 * n >= 80 * a for n in longer):
                continue
            score, k = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, i, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def phrase_rows():
    rng = random.Random(8)
    stock = ["red green blue black", "New  York\tCity", "of the", "of the order", "ähnlich öfter", "x\x0by z", "é,é", "Point. Break"]
    rows = [(" ".join(rng.choice(stock + ["a", "b", "c", "d"]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None])) for _ in range(200)]
    return rows + [(None, "en"), ("", None), ("  ..  ", "xx"), ("of " * 500, "fr"), ("w" * 70000 + " tail", "en")] + [rows[0]] * 20


@pytest.mark.parametrize("held", [3_000_000, 40])
def test_collocations(spark, monkeypatch, held):
    monkeypatch.setattr(collocations, "HELD", held)
    monkeypatch.setattr(collocations, "PHRASES", held)
    monkeypatch.setattr(collocations, "PORTION", 1 << 12)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").select("*", F.lit(1).alias("n"), F.lit("x").alias("phrase")).repartition(5)
    got = collocations.collocations(docs, F.col("text"), F.col("lang")).collect()
    want = brute_collocations(rows)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    few = collocations.collocations(docs, F.col("text"), F.col("lang"), top=3).collect()
    assert {tuple(r) for r in few} == {r for r in want if r[1] <= 3}
    assert collocations.collocations(docs.limit(0), F.col("text"), F.col("lang")).count() == 0


def test_summaries_lose_no_frequent_key():
    rng = np.random.RandomState(4)
    for threshold in (3, 10, 30):
        keys = np.concatenate([rng.randint(0, 40, 2000), rng.randint(40, 100_000, 20_000)]).astype(np.uint32)
        rng.shuffle(keys)
        exact = Counter(keys.tolist())
        summary = collocations.Summary(len(keys) // threshold + 1)
        for part in np.array_split(keys, 300):
            own, counts = np.unique(part, return_counts=True)
            summary.add(own, counts)
            summary.fold()
            assert len(summary.packed) <= summary.capacity
        kept = set(summary.survivors(threshold).tolist())
        assert {k for k, n in exact.items() if n >= threshold} <= kept and summary.lost < threshold


def test_key_lists_fold_to_one_summary_each():
    """Pass one over a small text: the marked bits hold every frequent n-gram."""
    texts = pa.array(["a b a b a b c", "a b c d", None and "", "b c"] * 20, pa.string())
    batch = pa.RecordBatch.from_arrays([texts.fill_null(""), pa.array(["en"] * len(texts))], ["text", "lang"])
    lists = list(collocations.key_lists(6)(iter([batch])))
    rows = sorted((r for b in lists for r in zip(*[c.to_pylist() for c in b.columns], strict=True)), key=lambda r: r[:2])
    assert sum(r[2] for r in rows) == sum(max(0, n - m + 1) for m in range(1, 5) for n in (7, 4, 2) for _ in range(20))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LICENSED = [
    None, "", "CC BY", "cc-by", "cc.BY cc by", "General\nPublic  License and general public licenses", "All rights reserved. all RIGHTS reserved",
    "nothing", "éCC BY", "CC by é", "cc by" + " x" * 5000 + " all rights reserved", "GNU General Public License", "All rights\nreserved",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nCC BY", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0",
    "SPDX-License-Identifier: MIT OR", "SPDX-License-Identifier: (MIT", "SPDX-License-Identifier: Foo-1.0", 'license = "MIT"', "License: see below",
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0."]


def brute_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
              for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(LICENSED)] + [(None, "CC BY", None), (3, "cc-by", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, findings string").repartition(3)
    got = licenses.op13_licenses(spark, nasty.save(docs, tmp_path, "documents")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(",")))) and (r.score > 0) == (r.labels != "")
    labels = {text: (by_id[i].labels, by_id[i].score) for i, text, _ in rows[:len(LICENSED)]}
    assert labels[LICENSED[13]] == ("apache,bsd,cc-by,mit", 0.25)
    assert labels[LICENSED[14]] == ("gpl", 0.5)
    assert labels["SPDX-License-Identifier: MIT OR"] == labels["SPDX-License-Identifier: (MIT"] == labels["License: see below"] == ("", 0.0)
    assert labels["SPDX-License-Identifier: Foo-1.0"] == ("unlisted", 1.0)
    assert labels['license = "MIT"'] == labels["Released under the MIT License."] == ("mit", 0.25)
    assert labels["Licensed under CC BY-NC 4.0."] == ("cc-by,cc-by-nc", 0.75)
    assert licenses.licenses(docs.limit(0), F.col("doc_id"), F.col("text")).count() == 0


def test_licenses_of_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = licenses.op13_licenses(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])


def recursive(tokens):
    """The same grammar by recursive descent: strictness, and how many tokens were read; None if there is no expression."""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def operand():
        nonlocal at
        if peek() == "(":
            at += 1
            value = either()
            if value is None or peek() != ")":
                return None
            at += 1
            return value
        if peek() in (None, ")", "and", "or", "with"):
            return None
        at += 1
        return licenses.STEPS[licenses.label_of(tokens[at - 1])]

    def chain(one, word, join):
        nonlocal at
        value = one()
        while value is not None and peek() == word:
            at += 1
            other = one()
            value = None if other is None else join(value, other)
        return value

    def both():
        return chain(operand, "and", max)

    def either():
        return chain(both, "or", min)

    return either()


def test_expressions_against_recursive_descent():
    rng = random.Random(6)
    names = ["mit", "gpl-2.0", "mpl-2.0", "foo", "cc-by-sa-4.0"]

    def build(depth):
        if depth == 0 or rng.random() < 0.3:
            return [rng.choice(names)]
        inner = build(depth - 1) + [rng.choice(["and", "or"])] + build(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.4 else inner

    for _ in range(300):
        tokens = build(4)
        value = licenses.evaluate(licenses.postfix(tokens))
        assert value[0] == recursive(tokens)
        again = licenses.evaluate(licenses.postfix(value[2].replace("(", "( ").replace(")", " )").split()))
        assert again == value  # the canonical form means the same
    assert licenses.postfix(["mit", "foo"]) == ["mit"] and licenses.postfix([")"]) == [] and licenses.postfix([]) == []
    assert licenses.evaluate(licenses.postfix("mit with gpl with foo".split())) is None
