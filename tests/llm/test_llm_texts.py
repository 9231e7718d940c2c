"""Near-duplicates, language ID, tokens, fingerprints and the pipeline on awkward texts, against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import nasty
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from atomweave.llm import bpe, fingerprints, graph, langid, neardup, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def roots(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(texts):
    """Component of each place in a list of texts, by comparing all pairs."""
    sets = [nasty.shingles(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b
             and 100 * len(a & b) >= 75 * len(a | b)]
    return roots(links, range(len(texts)))


def test_word_hashing_equals_sets(spark):
    texts = [r.text for r in nasty.documents(spark).collect()] + ["\x1c a", "x" * 70000 + "y tail", "b " * 10 + "q"]
    found = list(words.shingle_sets(pa.array(texts)))
    sets = [nasty.shingles(t) for t in texts]
    assert [len(f) for f in found] == [len(s) for s in sets]
    for i in range(len(texts)):
        for j in range(i):
            assert words.shared(found[i], found[j]) == len(sets[i] & sets[j])


def test_neardup(spark, tmp_path):
    docs = nasty.documents(spark)
    rows = docs.where("doc_id IS NOT NULL").collect()
    got = neardup.op5_neardup(spark, nasty.save(docs, tmp_path, "documents")).collect()
    assert len(got) == docs.count()
    root = brute_components([r.text for r in rows])
    members = {}
    for i, r in enumerate(rows):
        members.setdefault(root[i], []).append(r.doc_id)
    want = {}
    for i, r in enumerate(rows):
        size = len(nasty.shingles(r.text))
        want[r.doc_id] = (size, min(members[root[i]]) if size else r.doc_id)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert {r.component_id for r in got if r.doc_id is None} == {want[33][1], None}  # a copy, and one alone


def test_neardup_family_with_many_edits(spark):
    """Edited copies at all distances from one original, also copies of copies and of other sizes."""
    rng, base = random.Random(5), nasty.sentence(1, 150)
    texts = [base] + [nasty.edited(base, i, i % 14) for i in range(150)]
    texts += [nasty.edited(rng.choice(texts), 1000 + i, rng.randrange(8)) for i in range(100)]
    texts += [" ".join(t.split(" ")[:rng.randrange(90, 150)]) for t in rng.sample(texts, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in neardup.near_duplicates(docs, F.col("doc_id"), F.col("text")).collect()}
    assert got == brute_components(texts)


def test_neardup_of_nothing(spark):
    assert neardup.near_duplicates(nasty.empty(spark), F.col("doc_id"), F.col("text")).count() == 0
    assert neardup.one_per_group(nasty.empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)] + [(600, 600)]
    frame = spark.createDataFrame(links, "u long, v long")
    nodes = {n for link in links for n in link}
    got = graph.components(frame).collect()
    assert {r.node: r.root for r in got} == roots(links, nodes) and len(got) == len(nodes)


def test_langid(spark, tmp_path):
    docs = nasty.documents(spark)
    got = langid.op8_langid(spark, nasty.save(docs, tmp_path, "documents")).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))


def test_langid_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op8_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.97


def test_langid_limits(spark):
    docs = nasty.documents(spark)
    with pytest.raises(ValueError):
        langid.fit(docs.limit(0), F.col("text"), F.col("lang"), F.xxhash64("doc_id"))
    with pytest.raises(ValueError):
        langid.fit(docs, F.col("text"), F.col("lang"), F.xxhash64("doc_id"), most_labels=1)
    net = langid.fit(docs, F.col("text"), F.col("lang"), F.xxhash64("doc_id", "text"), per_label=2)
    assert net.labels == ["en", "fr"]
    assert langid.identify(docs.limit(0), net, F.col("doc_id"), F.col("text")).count() == 0
    assert langid.accepted(docs, net).columns == docs.columns


def test_langid_without_labels(spark, tmp_path):
    docs = nasty.documents(spark)
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    for name, rows in (("none", docs.limit(0)), ("unlabelled", blank), ("no-texts", docs.withColumn("text", F.lit(None).cast("string")))):
        folder = nasty.save(rows, tmp_path / name, "documents")
        got = langid.op8_langid(spark, folder).collect()
        assert len(got) == rows.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in got)
        assert corpus_pipeline.run(spark, folder).count() == 0


def test_langid_of_many_labels(spark, monkeypatch):
    monkeypatch.setattr(langid, "SCORES", 3000)  # so that scores come in several portions
    words = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(3)) for i in range(450)]
    docs = spark.createDataFrame([(i, f"{w} " * 20 + str(j), w) for i, w in enumerate(words) for j in range(3)], "doc_id long, text string, lang string")
    order = F.xxhash64("doc_id", "text")
    drawn = langid.sample(docs, F.col("text"), F.col("lang"), order, 1500)
    assert drawn.count() == 1350
    net = langid.fit_any(docs, F.col("text"), F.col("lang"), order, windows=900)
    assert net.labels == sorted(words)
    found = langid.identify(docs, net, F.col("doc_id"), F.col("text")).collect()
    assert len(found) == 1350 and {r.lang_pred for r in found} <= set(words)


def test_bpe(spark, tmp_path):
    odd = ["ab" * 2000 + " " * 500, "it's we'll I'D 12 ½Ⅷ²", "\x1c\x1d \x85\xa0　x ​ y", "é नमस्ते ١٢٣",
           "\n\n  \n x  y\t\tz   ", "<|endoftext|> x", "a" * 3000]
    docs = nasty.documents(spark)
    docs = docs.unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"),
                            allowMissingColumns=True)
    got = bpe.op9_bpe(spark, nasty.save(docs, tmp_path, "documents")).collect()
    assert len(got) == docs.count()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is not None:
            ids = encoding.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    coded = bpe.encode(docs, F.col("doc_id"), F.col("text"), RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, F.col("id"), F.col("ids"), RANKS).where("id IS NOT NULL").collect()
    assert all(bytes(r.bytes).decode() == texts[r.id] for r in back)
    assert bpe.digests(docs.limit(0), F.col("doc_id"), F.col("text"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_folds_agree(spark):
    ranks = bpe.read_ranks(RANKS)
    follow = bpe.pair_table(ranks)
    rng = random.Random(4)
    pieces = ["the", " tokenization", "zzzzzz", " éàü", "日本語", "x"] + [
        "".join(rng.choice("abcdeéñ 0") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    want = {p: bpe.merge(p.encode(), ranks, follow) for p in pieces}
    assert all(bpe._merge_long(p.encode(), ranks) == ids for p, ids in want.items() if p.encode() not in ranks)
    frame = spark.createDataFrame([(p,) for p in pieces], "word string").coalesce(1)
    assert {r.word: r.ids for r in bpe.fold_words(frame, F.col("word"), RANKS, 64).collect()} == want


def test_fingerprints(spark, tmp_path):
    docs = nasty.documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, nasty.save(docs, tmp_path, "documents")).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(got) == len(rows)
    prints, edited = {}, {}
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edit = text[:len(text) - len(text) // 3] + after[:len(text) // 3]
        r = got[key]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if len(nasty.words(text)) > 100 and len(set(nasty.words(text))) > 50:
            assert r.near_edited > 0.2
        edited[key] = edit
    alone = fingerprints.sketches(pa.array([edited[k] for k in edited]))
    assert fingerprints.spelled(alone) == [got[k].edited_fingerprint for k in edited]


def test_fingerprints_of_repeated_and_null_ids(spark):
    docs = nasty.documents(spark)
    found = fingerprints.edited_fingerprints(docs, F.col("doc_id"), F.col("text"), 3).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in docs.collect())
    assert fingerprints.edited_fingerprints(docs.limit(0), F.col("doc_id"), F.col("text")).count() == 0
    one = docs.where("doc_id = 33").limit(1)
    r = fingerprints.edited_fingerprints(one, F.col("doc_id"), F.col("text")).first()
    assert r.near_next == 1.0


def test_fingerprints_do_not_depend_on_offset():
    text = nasty.sentence(3, 400)
    found = fingerprints.sketches(pa.array([text, "Some words before. " + text, text[200:], nasty.sentence(4, 400), "", None]))
    near = [fingerprints.likeness(found[:1], found[i:i + 1])[0] for i in range(6)]
    assert near[0] == 1 and near[1] > 0.9 and near[2] > 0.75 and near[3] < 0.1 and near[4] == near[5] == 0
    assert fingerprints.likeness(found[4:5], found[5:])[0] == 1


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, redone row by row."""
    rng = random.Random(9)
    real = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source if r.doc_id % 9 else None, r.n_chars) for r in real]
    rows += [(1000 + i, nasty.edited(rng.choice(real).text, i, 1), "en", "src1", 0) for i in range(20)]
    rows += [(2000, None, None, "src1", 0), (2001, "", "en", "src2", 0), (2002, "123 !!", "fr", None, 6), rows[4], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    folder = nasty.save(docs, tmp_path, "documents")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    net = langid.fit_documents(docs)
    scores = {r.id: r for r in langid.identify(docs, net, F.col("doc_id"), F.col("text")).collect()}
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "") and scores[r[0]].score >= 0.4]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {2000, 2001, 2002}

    kept = sorted(set(kept))
    root = brute_components([r[1] for r in kept])
    kept = [r for i, r in enumerate(kept) if root[i] == i]
    sizes = Counter()
    for r in kept:
        sizes[r[3]] += len(nasty.words(r[1]))
    got = corpus_pipeline.run(spark, folder).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    by_id, times, mixed = {r[0]: r for r in kept}, Counter(r.doc_id for r in got), Counter()
    assert set(times) <= set(by_id) and max(times.values()) <= 2
    for r in got:
        text = by_id[r.doc_id][1]
        ids = encoding.encode_ordinary(text)
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids)
        assert (r.lang, r.source) == by_id[r.doc_id][2:4]
        mixed[r.source] += len(nasty.words(text))
    from test_llm_rows import level
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    longest = max(len(nasty.words(r[1])) for r in kept)
    for source, target in level(sizes, weights, 1.5, 2.0).items():
        assert abs(mixed[source] - target) <= longest / 2 + 1


def test_pipeline_contract(spark):
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs.limit(20), "").columns == docs.columns
