"""Methods written out once more as plain loops, and cases that once went wrong."""

import hashlib
import json
import math
import random
from collections import Counter

import nasty
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from atomweave.llm import bpe, chat, fingerprints, langid, topk, urls, warc

MASK = (1 << 64) - 1


# ------------------------------------------------------------------ language ID: the network by loops

def network(labels=("a", "b", "c"), seed=3):
    rng = np.random.RandomState(seed)
    tables = [rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    n = langid.FILTERS * len(langid.WIDTHS)
    return langid.Network(list(labels), tables, rng.normal(0, 1, n).astype(np.float32), rng.normal(0, 1, (n, len(labels))).astype(np.float32),
                          rng.normal(0, 1, len(labels)).astype(np.float32))


def hidden_of(net, window):
    out = []
    for table, width in zip(net.tables, langid.WIDTHS, strict=True):
        for f in range(langid.FILTERS):
            out.append(max(sum(float(table[k][window[p + k]][f]) for k in range(width)) for p in range(len(window) - width + 1)))
    return [max(0.0, v + float(b)) for v, b in zip(out, net.bias, strict=True)]


def scores_of(net, window):
    hidden = hidden_of(net, window)
    return [sum(h * float(net.out[i][c]) for i, h in enumerate(hidden)) + float(net.out_bias[c]) for c in range(len(net.labels))]


def shares(scores):
    top = max(scores)
    parts = [math.exp(s - top) for s in scores]
    return [p / sum(parts) for p in parts]


def test_prediction_by_loops():
    net = network()
    texts = ["kurz", "Ein längerer Text, " * 20, "x" * langid.WINDOW, "y" * (langid.WINDOW + 1), "日本語"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    got = [r for b in langid.predictor(net)(iter([batch])) for r in b.to_pylist()]
    for text, r in zip(texts, got, strict=True):
        data = text.encode()
        total = [0.0] * len(net.labels)
        for at in range(0, len(data), langid.WINDOW):
            window = data[at:at + langid.WINDOW]
            for c, s in enumerate(scores_of(net, window.ljust(langid.WINDOW, b"\0"))):
                total[c] += s * len(window)
        want = shares([t / len(data) for t in total])
        assert r["label"] == net.labels[want.index(max(want))] and r["share"] == pytest.approx(max(want), rel=1e-3)


def test_gradient_step_by_differences():
    """One step of training moves each weight against the slope of the loss, found by finite differences."""
    rng = np.random.RandomState(5)
    windows, classes = rng.randint(97, 103, (6, 12)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    before, after = langid.train(windows, classes, ["a", "b"], rounds=0), langid.train(windows, classes, ["a", "b"], rounds=1)

    def loss():
        return sum(-math.log(shares(scores_of(before, w))[c]) for w, c in zip(windows.tolist(), classes.tolist(), strict=True)) / len(windows)

    weights = [(before.out, after.out), (before.out_bias, after.out_bias), (before.bias, after.bias), *zip(before.tables, after.tables, strict=True)]
    checked = 0
    for old, new in weights:
        flat, moved = old.reshape(-1), new.reshape(-1)
        for i in rng.permutation(np.flatnonzero(flat != moved))[:12].tolist():
            kept = flat[i]
            flat[i] = kept + 1e-2
            up = loss()
            flat[i] = kept - 1e-2
            slope, flat[i] = (up - loss()) / 2e-2, kept
            if abs(slope) > 5e-3:  # the first step of Adam is 0.01 against the sign
                assert moved[i] - kept == pytest.approx(-0.01 * math.copysign(1, slope), rel=1e-3)
                checked += 1
    assert checked > 25


def test_thinned_sample_is_the_sample(spark):
    rows = spark.range(30000).select("id", F.when(F.col("id") % 1000 == 0, "rare").otherwise("often").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    text, label, order = F.col("text"), F.col("lang"), F.xxhash64("id")
    counts = langid.label_counts(rows, text, label, order)
    plain = langid.sample(rows, text, label, order, 100)
    thin = langid.sample(rows, text, label, order, 100, counts)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, thin.collect()))
    assert Counter(r.label for r in thin.collect()) == {"often": 100, "rare": 30}
    plan = thin._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")  # the window stands above the thinning, and nothing is dealt out below it


def test_more_labels_than_windows(spark, monkeypatch):
    monkeypatch.setattr(langid, "SENT", 3)
    rows = spark.range(400).select("id", F.concat(F.lit("l"), F.floor(F.sqrt("id"))).alias("lang"), F.lit("some text").alias("text"))
    net = langid.fit_any(rows, F.col("text"), F.col("lang"), F.xxhash64("id"), windows=5)
    assert net.labels == ["l15", "l16", "l17", "l18", "l19"]


# ------------------------------------------------------------------ fingerprints: the parser by its definition

def mix(x):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> shift)) * factor & MASK
    return x ^ (x >> 33)


def toss(values):
    out = []
    for i, v in enumerate(values):
        differs = v ^ (values[i - 1] if i else v ^ 1)
        bit = (differs & -differs).bit_length() - 1
        out.append(2 * bit + (v >> bit & 1))
    return out


def plain_sketch(text):
    bins, symbols, level = [None] * fingerprints.SLOTS, list((text or "").encode()), 0
    while symbols:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        symbols = [s if n == 1 else mix(s ^ mix(n + 0xA5A5)) for s, n in runs]
        labels = symbols
        for _ in range(4):
            labels = toss(labels)
        starts = [0] + [i for i in range(2, len(symbols) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
        names = []
        for a, b in zip(starts, [*starts[1:], len(symbols)], strict=True):
            total = sum(mix((s + (k + 1) * 0x9E3779B97F4A7C15) & MASK) for k, s in enumerate(symbols[a:b]))
            names.append(mix((total + level * 1000003) & MASK))
        level += 1
        for name in names if level >= fingerprints.FIRST_LEVEL or len(names) == 1 else []:
            slot = name % fingerprints.SLOTS
            bins[slot] = name >> 6 if bins[slot] is None else min(bins[slot], name >> 6)
        symbols = names if len(names) > 1 else []
    return bins


def plain_likeness(a, b):
    used = [(x, y) for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_fingerprints_by_definition(spark, tmp_path):
    docs = nasty.documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, nasty.save(docs, tmp_path, "documents")).collect()}
    order, own = sorted(texts, reverse=True), {k: plain_sketch(t) for k, t in texts.items()}
    spell = lambda bins: "".join("----" if b is None else f"{mix(b) & 0xFFFF:04x}" for b in bins)
    for i, key in enumerate(order):
        text, follower = texts[key], order[(i + 1) % len(order)]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + texts[follower][:cut]
        theirs, r = plain_sketch(edited), got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (spell(own[key]), spell(theirs))
        assert r.near_edited == pytest.approx(plain_likeness(own[key], theirs)) and r.near_next == pytest.approx(plain_likeness(own[key], own[follower]))


def test_fingerprints_do_not_depend_on_the_batch():
    text = "abcdefghijklmnopqrstuvwxyz0123456789" * 4
    alone = fingerprints.spelled(fingerprints.sketches(pa.array([text])))
    assert fingerprints.spelled(fingerprints.sketches(pa.array(["aabbcc", text, "xx"])))[1:2] == alone


# ------------------------------------------------------------------ URL trees by a loop

def test_trees_by_loop(spark):
    rng = random.Random(2)
    trees = urls.Trees(-0.3, [([{1: (urls.FEATURES[0], 3)}, {2: (urls.FEATURES[1], 5), 3: (urls.FEATURES[2], 1)}], {4: 0.5, 5: -0.25, 6: 1.0}),
                              ([{1: (urls.FEATURES[1], 2)}, {}], {2: 0.125, 3: -2.0})])
    rows = [tuple(rng.randrange(9) for _ in urls.FEATURES) for _ in range(80)]
    frame = spark.createDataFrame(rows, ", ".join(f"{name} int" for name in urls.FEATURES))

    def margin(row):
        total = trees.prior
        for levels, values in trees.trees:
            leaf = 1
            for level in levels:
                if leaf in level:
                    feature, cut = level[leaf]
                    leaf = 2 * leaf + (row[feature] > cut)
                else:
                    leaf *= 2
            total += values.get(leaf, 0.0)
        return total

    for r in frame.select("*", trees.margin().alias("margin")).collect():
        assert r.margin == pytest.approx(margin(r.asDict()))


def test_url_verdicts_on_held_out_rules(spark):
    """Trees learned from three quarters of the URLs that a rule decides, asked about the last quarter."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    split = pages.select(F.col("page_id").alias("id"), F.col("url").alias("_url"), urls.host_of(F.col("url")).alias("_host"), urls.path_of(F.col("url")).alias("_path"))
    rule, verdict = urls.rule_for(F.col("_host"), F.col("_path"), urls.RULES)
    features = urls.lexical(split.withColumns({"rule": rule, "_verdict": verdict})).where("_verdict IS NOT NULL")
    features = features.withColumn("_y", (F.col("_verdict") == "block").cast("int"))
    held = F.pmod(F.xxhash64("id"), F.lit(4)) == 0
    for suffix, name in (("_suffix", "suffix"), ("_site", "site")):
        rates = urls.suffix_rate(features.where(~held), suffix, name)
        features = features.join(rates, suffix, "left").withColumn(name, F.coalesce(name, F.lit(urls.BINS // 2)))
    model = urls.boost(features.where(~held))
    right = ((model.margin() >= 0) == (F.col("_y") == 1)).cast("int")
    share, blocked, total = features.where(held).agg(F.avg(right), F.avg("_y"), F.count("*")).first()
    print(f"held-out URLs {total}, right {share:.3f}, blocked {blocked:.3f}")
    assert total > 50 and share >= max(blocked, 1 - blocked) - 0.02


# ------------------------------------------------------------------ top-k at the border of a long

def test_topk_refuses_what_no_long_holds():
    ids = np.arange(4)
    huge = np.full((4, 2), 2 ** 40, np.int64)
    with pytest.raises(ValueError, match="range of a long"):
        topk.best((ids[:1], huge[:1]), (ids, huge), 2)
    near = np.array([[2 ** 31, 2 ** 31 - 2], [2 ** 31, 2 ** 31 - 1], [-2 ** 31, -2 ** 31], [1, 1]], np.int64)
    at, found, scores = topk.best((ids[:1], near[:1]), (ids, near), 3)
    assert list(zip(found.tolist(), scores.tolist())) == [(1, 2 ** 62 + (2 ** 31 - 2) * (2 ** 31 - 1)), (3, 2 ** 32 - 2), (2, -2 ** 62 - (2 ** 31 - 2) * 2 ** 31)]


@pytest.mark.parametrize("kept", [1, 1024])
def test_topk_lists_are_carried_on(spark, monkeypatch, kept):
    for name, value in (("CHUNK", 2), ("BLOCK", 2), ("RUN", 2), ("KEPT_CHUNKS", kept)):
        monkeypatch.setattr(topk, name, value)
    rows = [(i, [i * 7 % 23 - 9, i * 5 % 19 - 8, i % 3]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, vector array<long>").withColumn("dim", F.lit(3))
    got = {}
    for r in topk.search(frame, F.col("id") % 5 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == {q: sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != q)[:5] for q, v in rows if q % 5 == 0}


# ------------------------------------------------------------------ archives, chats, tokens

def test_warc_urls_with_line_ends(spark, tmp_path):
    odd = ["\u0085", " ", " ", "\0", "\t", "\x0b", "\x0c", "\x1c", "\r\n", " "]
    pages = [(i, f"http://a/{c}Content-Length:5{c}WARC-Type: metadata", "x" * 50) for i, c in enumerate(odd)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.op2_warc(spark, nasty.save(frame, tmp_path, "pages")).collect()
    digest = hashlib.sha1(b"x" * 50).hexdigest()
    assert sorted(tuple(r)[:5] for r in got) == [(i, 50, digest, "response", None) for i in range(len(odd))]
    assert len({r.request_id for r in got}) == len(odd)
    empty = frame.limit(0)
    assert warc.op2_warc(spark, nasty.save(empty, tmp_path / "none", "pages")).count() == 0


def test_chat_arguments_with_half_a_character(spark):
    calls = spark.createDataFrame([(1, "a", None, "answer", '{"text":"\\ud800","turn":1}'), (2, None, None, "answer", '{"text":"\\ud83d\\ude00","turn":2}'),
                                   (3, None, "a", "answer", None)], "record int, id string, after string, name string, arguments string")
    results = spark.createDataFrame([(4, None, "no call"), (5, "a", "fine"), (6, None, None)], "record int, id string, content string")
    got = {r.record: r for r in chat.link(calls, results, chat.SCHEMAS).collect()}
    assert (got[1].status, got[1].wrong) == ("invalid", "$: lone surrogate") and got[2].wrong is None and got[3].wrong == "$: not JSON"
    assert json.loads(got[2].message)["tool_calls"][0]["function"]["arguments"] == '{"text":"😀","turn":2}'
    assert [got[k].status for k in (2, 4, 5, 6)] == ["unanswered", "orphan", "linked", "orphan"]
    assert [got[k].place for k in (1, 5, 4, 6)] == [0, 1, None, None]


def test_chat_with_nulls_everywhere(spark, tmp_path):
    rows = [(None, 1, "user", "hi"), (1, None, "user", "hi"), (1, 1, None, "hi"), (1, 2, "assistant", None), (None, None, None, None), (2, 1, "assistant", "first")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.op6_chat(spark, nasty.save(frame, tmp_path, "conversations")).collect()
    assert len(got) == len(rows)
    by_key = {(r.conv_id, r.turn): r for r in got}
    assert (by_key[1, 2].kind, by_key[1, 2].status, by_key[1, 2].call_id) == ("result", "linked", "call_1_1")
    assert by_key[2, 1].status == "orphan" and by_key[None, None].call_id is None


def test_tokenized_keeps_clashing_columns(spark):
    import public_tokenizers
    docs = spark.createDataFrame([(1, "Hello", 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_tokens long, ids string")
    got = sorted(bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect())
    assert [(r.doc_id, r.input_n_tokens, r.input_ids) for r in got] == [(1, 7, "x"), (2, 8, "y")]
    assert [r.decoded_sha256 for r in got] == [hashlib.sha256(t).hexdigest() for t in (b"Hello", b"")]
