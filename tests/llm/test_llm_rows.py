"""Sharding, mixing, URL filter, top-k, WARC and chat on awkward rows, against brute force."""

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import compare
import nasty
import numpy as np
import pytest
from pyspark.sql import functions as F

from atomweave.llm import chat, mixing, queries, sharding, topk, urls, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, database, name):
    problem, count, *_ = compare.check(spark, SF, name, queries.QUERIES[name], queries.ORACLE[name], database)
    assert problem is None and count > 0


def test_sharding(spark, tmp_path):
    docs = nasty.documents(spark)
    got = sharding.op1_sharding(spark, nasty.save(docs, tmp_path, "documents")).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    by_shard = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r)
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        assert abs(sum(r.size for r in rows) - total / 24) <= largest
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in ordered]
    assert ids == sorted(ids)


def test_sharding_of_nothing(spark):
    key, size = F.col("doc_id"), F.lit(0)
    assert sharding.by_bytes(nasty.empty(spark), 4, key, size, [key]).count() == 0
    rows = sharding.by_bytes(nasty.documents(spark), 4, key, size, [key]).collect()
    assert {r.shard for r in rows} == {0} and sorted(r.slot for r in rows) == list(range(len(rows)))


def test_sharding_bytes_are_even_for_equal_rows(spark):
    rows = spark.range(1000).select(F.lit(7).cast("long").alias("k"))
    got = Counter(r.shard for r in sharding.by_bytes(rows, 10, F.col("k"), F.lit(3), [F.col("k")]).collect())
    assert set(got.values()) == {100}


def level(sizes, weights, share, most):
    """Targets by dealing again and again until none is above its cap."""
    target, left, free = {}, share * sum(sizes.values()), set(sizes)
    while free:
        unit = left / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * unit >= most * sizes[s]]
        if not over:
            return target | {s: weights[s] * unit for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark, tmp_path):
    docs = nasty.documents(spark)
    folder = nasty.save(docs, tmp_path, "documents")
    got = mixing.op7_mixing(spark, folder).collect()
    assert len(got) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(nasty.words(r.text))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    want = level(sizes, weights, 1.5, 2.0)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and any(math.isclose(r.target, t) for t in want.values())
    rows, pieces = mixing.op7_rows(docs, F.struct("doc_id", "source"))
    taken = Counter()
    for r in mixing.taken(rows, pieces).collect():
        taken[r.source] += r.taken
        assert math.isclose(r.target, want[r.source]) and r.source_size == sizes[r.source]
    for source in sizes:
        assert 0 <= want[source] - taken[source] < 1
    again = mixing.op7_mixing(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mixing_schedule_is_spread(spark):
    sources = spark.createDataFrame([("a", 0, 600_000, 600_000.0), ("b", 1, 300_000, 300_000.0), ("c", 2, 9, 18.0),
                                     ("d", 3, 0, 0.0)], "source string, source_no int, source_size long, target double")
    slots = mixing.schedule(sources, 100).orderBy("slot").collect()
    count = Counter(r.source_no for r in slots)
    assert count == {0: 6000, 1: 3000, 2: 2}
    early = Counter(r.source_no for r in slots[:900])
    assert abs(early[0] - 600) <= 4 and abs(early[1] - 300) <= 4
    for no in (0, 1):
        assert sorted(r.rank for r in slots if r.source_no == no) == list(range(count[no]))


def test_mixing_of_nothing(spark):
    rows, pieces = mixing.op7_rows(nasty.empty(spark), F.col("doc_id"))
    assert rows.count() == 0 and pieces.count() == 0
    blank = nasty.documents(spark).withColumn("text", F.lit(""))
    rows, pieces = mixing.op7_rows(blank, F.col("doc_id"))
    assert {r.taken for r in mixing.taken(rows, pieces).collect()} == {0} and pieces.count() == 0


URLS = [None, "", "no scheme", "http://ORG/x", "http://a.Org/", "https://example.org/es/1", "https://www.example.org/en/12",
        "http://example.org/en/2", "http://notexample.org/es/", "ftp://x.com/fr/a?b=://c#d", "http://com/de/", "http://x.com/de",
        "http://x.com?/de/", "://com/fr/", "http://a.net/p?q=1&r=2", "http://a.net/p?q=1&r=2", "http://" + "a" * 5000 + ".com/fr/"]


def brute_url(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(rule), rule, verdict) for verdict, rule in urls.RULES for name, _, tail in [rule.partition("/")]
            if (host == name or host.endswith("." + name)) and path.startswith("/" + tail)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_urls(spark, tmp_path):
    rows = [(i, u, None, 1, "x") for i, u in enumerate(URLS)] + [(None, "http://q.org/1", None, 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, length int, rule string")
    got = urls.op10_urls(spark, nasty.save(pages, tmp_path, "pages")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = brute_url("http://q.org/1" if r.page_id is None else URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
        assert r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0), F.col("page_id"), F.col("url"), urls.RULES).count() == 0


def test_url_trees_learn(spark):
    rows = spark.range(4000).select((F.col("id") % 16).cast("int").alias("length"), (F.col("id") % 7).cast("int").alias("depth"),
                                    *[F.lit(0).alias(n) for n in ("digits", "entropy", "params", "suffix", "site")])
    truth = (F.col("length") > 6) & (F.col("depth") <= 3) | (F.col("length") <= 2)
    labelled = rows.withColumn("_y", truth.cast("int"))
    model = urls.boost(labelled.where("id IS NULL OR true") if "id" in labelled.columns else labelled)
    right = labelled.where((model.margin() > 0).cast("int") == F.col("_y")).count()
    assert right > 3900


def test_entropy(spark):
    texts = ["", "a", "ab", "aabb", "hello world", "éé日本"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", urls.entropy(F.col("t")).alias("e")).collect()
    for r in got:
        share = [n / len(r.t) for n in Counter(r.t).values()]
        assert math.isclose(r.e, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)


def test_topk(spark, tmp_path):
    rng = np.random.RandomState(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(800, None), (801, []), (802, [1.0, None]), (803, [float("nan")] * 8), (804, [float("inf")] * 8),
             (850, [1.0, 2.0]), (900, [3.0, 4.0]), (None, rows[0][1]), (100, rows[100][1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id long, dim int")
    got = topk.op3_topk(spark, nasty.save(frame.repartition(4), tmp_path, "embeddings")).collect()
    good = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for i, q in good:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, d)), j) for j, d in good if j != i and len(d) == len(q))
            want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:5])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    none = topk.integer_vectors(frame.limit(0), F.col("vec_id"), F.col("embedding"), 256)
    assert topk.search(none, F.col("id") % 50 == 0, 5).count() == 0


def test_topk_repeats_across_borders(spark, monkeypatch):
    rows = [(i, [i * 7 % 11, i * 5 % 13]) for i in range(12) for _ in range(3)]
    frame = spark.createDataFrame(rows, "id long, vector array<long>").withColumn("dim", F.lit(2))
    want = {i: sorted((-sum(a * b for a, b in zip(q, d)), j) for j, d in dict(rows).items() if j != i)[:5] for i, q in dict(rows).items()}
    for name, value in (("CHUNK", 1), ("BLOCK", 1), ("RUN", 1)):
        monkeypatch.setattr(topk, name, value)
    got = defaultdict(list)
    for r in topk.search(frame, F.col("id") >= 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    assert got == want


def test_topk_of_large_numbers_is_exact():
    ids, rows = np.arange(40), np.random.RandomState(1).randint(-2 ** 30, 2 ** 30, (40, 4)).astype(np.int64)
    at, found, scores = topk.best((ids[:3], rows[:3]), (ids, rows), 5, block=8)
    for q in range(3):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q], r)), j) for j, r in enumerate(rows) if j != q)[:5]
        assert [(-s, j) for s, j in zip(scores[at == q].tolist(), found[at == q].tolist())] == want


def test_warc(spark, tmp_path):
    cut = "x" * 500 + warc.END + warc.CUT + "WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" + warc.CUT + "é" * 700
    pages = [(1, "http://a/b", None), (2, None, ""), (3, "http://x/ y\r\nz", "short"), (4, "u", cut), (5, "u2", cut),
             (6, "u", "a" * 2000), (7, "v", "a" * 2000), (8, "w", "\r\n\r\n" * 400), (9, "w", "é" * 500), (10, "w", "é" * 500),
             (11, "w", "é" * 499 + "a"), (12, "w", "é" * 499 + "a"), (13, "", "short"), (13, "", "short")]
    frame = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, id long, digest string")
    got = warc.op2_warc(spark, nasty.save(frame.repartition(3), tmp_path, "pages")).collect()
    want = Counter()
    for key, _, html in pages:
        data = (html or "").encode()
        same = max(k for k, _, h in pages if (h or "").encode() == data)
        late = len(data) >= 1000 and same != key
        want[(key, len(data), hashlib.sha1(data).hexdigest(), "revisit" if late else "response", same if late else None)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want and all(r.request_id for r in got)
    folder = str(tmp_path / "plain")
    warc.write(warc.with_roles(frame, F.col("page_id"), F.col("url"), F.col("html")), folder, "none")
    records = warc.read(spark, folder)
    assert records.count() == 3 * len(pages)
    assert records.where((F.octet_length("block") != F.col("length")) | ~F.col("complete")).count() == 0
    nested = warc.transactions(records)
    assert nested.where("request IS NULL OR metadata IS NULL").count() == 0


def warc_rows(spark, folder, pages):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    return Counter(tuple(r)[:5] for r in warc.op2_warc(spark, nasty.save(frame.coalesce(1), folder, "pages")).collect())


def test_warc_version_lines_in_a_row(spark, tmp_path):
    pages = [(1, "a", "x" * 20 + warc.CUT * 2 + "y"), (2, "b", warc.CUT * 5), (3, "c", warc.CUT + "Content-Length: x" + warc.END),
             (4, "http://d/" + warc.VERSION, "short"), (5, warc.VERSION, warc.CUT * 3 + warc.VERSION), (6, "f", "plain"),
             (7, "g", warc.CUT + "Content-Length: 99999999999" + warc.END + warc.CUT * 2), (8, "h", warc.CUT * 30000)]
    want = Counter((key, len(html), hashlib.sha1(html.encode()).hexdigest(), "response", None) for key, _, html in pages)
    assert warc_rows(spark, tmp_path, pages) == want


def test_warc_null_page_ids(spark, tmp_path):
    large, alone, both = "l" * 2000, "n" * 1500, "b" * 1000
    pages = [(None, "a", "short"), (None, None, None), (None, "c", large), (3, "c", large), (4, "d", large), (None, "e", alone),
             (None, "f", both), (None, "f", both), (None, "g", both), (5, "h", "short")]
    refers = {large: 4}
    want = Counter()
    for key, _, html in pages:
        data, first = (html or "").encode(), refers.get(html, key)
        want[(key, len(data), hashlib.sha1(data).hexdigest(), "response" if first == key else "revisit",
              None if first == key else first)] += 1
    assert warc_rows(spark, tmp_path, pages) == want


def test_chat(spark):
    calls = spark.createDataFrame([
        (1, "a", None, "answer", '{"turn": 1, "text": "x"}', 9), (2, "b", "a", "answer", '{"text":"","turn":1}', 9),
        (3, "c", "b", "answer", "not json", 9), (4, "d", "d", "answer", None, 9), (5, "e", "gone", "none", "{}", 9),
        (6, None, "a", "answer", '{"text":"z","turn":2.5}', 9), (7, "g", "h", "answer", '{"text":"z","turn":1,"turn":2}', 9),
        (8, "h", "g", "configure", '{"style":"é\\u00e9","more":1}', 9), (1, "a", None, "answer", '{"turn": 1, "text": "x"}', 9),
        (9, "i", "c", "configure", '{"style":"' + "s" * 300 + '"}', 9)],
        "record int, id string, after string, name string, arguments string, depth int")
    results = spark.createDataFrame([(20, "a", "done"), (21, "a", None), (22, "zz", "lost"), (23, None, "x")],
                                    "record int, id string, content string")
    got = defaultdict(list)
    for r in chat.link(calls, results, chat.SCHEMAS).collect():
        got[r.record].append(r)
        json.loads(r.message)
    assert [len(got[i]) for i in (1, 2, 20, 21, 22, 23)] == [2, 1, 1, 1, 1, 1]
    place = {i: got[i][0].place for i in got}
    assert place == {1: 0, 2: 2, 3: 4, 9: 6, 4: None, 5: 0, 6: None, 7: None, 8: None, 20: 1, 21: 1, 22: None, 23: None}
    status = {i: got[i][0].status for i in got}
    assert status == {1: "linked", 2: "invalid", 3: "invalid", 4: "invalid", 5: "invalid", 6: "invalid", 7: "invalid",
                      8: "invalid", 9: "invalid", 20: "linked", 21: "linked", 22: "orphan", 23: "orphan"}
    assert got[2][0].wrong == "$.text: wrong length" and got[8][0].wrong == "$.more: unknown"
    assert json.loads(got[1][0].message)["tool_calls"][0]["function"]["arguments"] == '{"text":"x","turn":1}'
    assert chat.link(calls.limit(0), results.limit(0), chat.SCHEMAS).count() == 0


def test_chat_turns_in_a_row_and_gaps(spark, tmp_path, monkeypatch):
    roles = {1: "system", 2: "user", 3: "assistant", 4: "assistant", 5: "assistant", 6: "user", 40: "user", 43: "assistant",
             90: "assistant", 95: "user", 96: "user", 97: "assistant"}
    turns = [(c, t, r, "x") for c in (7, 8) for t, r in roles.items()]
    turns += [(9, 3, "assistant", "first"), (9, 9, "user", "x"), (9, 9, "user", "x"), (9, 9, "assistant", "x"), (9, None, "user", "x")]
    folder = nasty.save(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), tmp_path, "conversations")
    for width in (4, 1024):
        monkeypatch.setattr(chat, "TURNS", width)
        got = Counter((r.conv_id, r.turn, r.kind, r.call_id, r.place, r.status) for r in chat.op6_chat(spark, folder).collect())
        want, answered = Counter(), {2, 40, 96}
        for c in (7, 8):
            call, place = None, -2
            for t, r in sorted(roles.items()):
                asks = r != "assistant"
                call, place = (t, place + 2) if asks else (call, place)
                status = "linked" if not asks or t in answered else "unanswered"
                want[(c, t, "call" if asks else "result", f"call_{c}_{call}", place + (not asks), status)] += 1
        want += Counter({(9, 3, "result", None, None, "orphan"): 1, (9, 9, "call", "call_9_9", 0, "unanswered"): 2,
                         (9, 9, "result", None, None, "orphan"): 1, (9, None, "call", None, None, "invalid"): 1})  # its arguments lack the turn
        assert got == want


def test_chat_long_chain(spark):
    calls = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"))
    assert {int(r.id): r.depth for r in chat.depths(calls).collect()} == {i: i for i in range(1000)}


def test_warc_of_many_records(spark, tmp_path):
    """Records around the borders of a reader's buffers."""
    pages = spark.range(30000).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"),
                                      F.expr("concat(id, repeat('\\r\\n', cast(id % 97 as int)), repeat('W', cast(id % 31 as int)))").alias("html"))
    for compression in ("none", "gzip"):
        folder = str(tmp_path / compression)
        warc.write(warc.with_roles(pages, F.col("page_id"), F.col("url"), F.col("html")).coalesce(2), folder, compression)
        records = warc.read(spark, folder)
        assert records.count() == 90000 and records.where("NOT complete").count() == 0
