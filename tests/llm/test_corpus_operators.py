"""Language model, near-duplicates, neighbours, archives, mixing, URL filters and the pipeline."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from timeweave.llm import ann_forest, components, mixing, ngram_lm, simhash, url_filters, warc

LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocab = ["Alpha", "beta", "gamma", "delta,", "eps", "zeta", "Éta", "theta", "iota."]
    return [" ".join(r.choices(vocab, weights=range(1, 10), k=r.randrange(1, 60))) for _ in range(n)] + [None, "", " \n ", "rare words never seen " * 3, "x" * 50000]


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(spark, order):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = ngram_lm.held_out()
    model = ngram_lm.train(docs.where(~held), order, shards=3)
    got = {r.doc_id: r for r in ngram_lm.score(docs, model, held).collect()}
    tok = lambda t: [w.decode() for w in (t or "").encode().translate(LOW).split()] + ["\n"]
    cnt = [None] + [Counter() for _ in range(order)]
    raw = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            ts = ["\t"] * (order - 1) + tok(t)
            for k in range(order - 1, len(ts)):
                cnt[order][tuple(ts[k - order + 1 : k + 1])] += 1
                raw[ts[k]] += 1
    for k in range(order - 1, 0, -1):
        for g, n in cnt[k + 1].items():
            cnt[k][g[1:]] += n if k > 1 and g[1] == "\t" else 1
    disc, ctx = [None], [None]
    for k in range(1, order + 1):
        cc = Counter(cnt[k].values())
        disc.append((0, *ngram_lm.discounts(*(cc[j] for j in (1, 2, 3, 4)))))
        of = defaultdict(lambda: [0, 0, 0, 0])
        for g, n in cnt[k].items():
            of[g[:-1]][0] += n
            of[g[:-1]][min(n, 3)] += 1
        ctx.append(of)

    def p(g):
        if not g:
            return 1 / (len(cnt[1]) + 1)
        lower, e = p(g[1:]), ctx[len(g)].get(g[:-1])
        if not e:
            return lower
        n, d = cnt[len(g)].get(g, 0), disc[len(g)]
        return (max(n - d[min(n, 3)], 0) + sum(d[j] * e[j] for j in (1, 2, 3)) * lower) / e[0]

    total = sum(raw.values())
    vocab = [g[0] for g in cnt[1]]
    assert abs(sum(p(("beta",) * (order - 1) + (w,)) for w in [*vocab, "unknown"]) - 1) < 1e-9
    for i, t in rows:
        ts = ["\t"] * (order - 1) + tok(t)
        g = got[i]
        assert g.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(ts) - order + 1, sum(raw[w] > 0 for w in ts[order - 1 :]), total)
        assert abs(g.score - sum(math.log10(p(tuple(ts[k - order + 1 : k + 1]))) for k in range(order - 1, len(ts)))) < 1e-8
        assert abs(g.base_score - sum(math.log10((raw[w] + 1) / (total + len(raw) + 1)) for w in ts[order - 1 :])) < 1e-8


def test_a_model_of_many_shards_holds_no_file_open(spark):
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    few, many = (ngram_lm.train(docs, 2, shards=k) for k in (2, 120))
    text = np.frombuffer(" ".join(t or "" for t in corpus()).encode(), np.uint8)
    rows, toks = ngram_lm.tokens(text, np.array([0, len(text)]))
    want, _ = ngram_lm.token_scores(ngram_lm.Arrays(few), rows, toks)
    arrays, before = ngram_lm.Arrays(many), len(os.listdir("/proc/self/fd"))
    got, _ = ngram_lm.token_scores(arrays, rows, toks)
    assert (got == want).all() and len({k for _, k in arrays.opened}) > 30
    # a shard's arrays were some ten files, each with a handle that stayed open
    assert len(os.listdir("/proc/self/fd")) - before < 20
    kept = {name.rsplit("-", 1)[0] for name in os.listdir(many.folder.removeprefix("file:"))}
    assert kept == {"1-ngrams", "2-ngrams", "2-contexts"}


def test_language_model_without_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = ngram_lm.train(docs.limit(0), 2, shards=2)
    assert ngram_lm.score(docs, model, F.lit(True)).first().score == 0


def plain_fingerprint(text):
    w = (text or "").encode().translate(LOW).split()
    if not w:
        return 0
    g = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, distance=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    u = sorted(set(fps))
    for i, a in enumerate(u):
        for b in u[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for i, f in zip(ids, fps):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


def test_simhash_components(spark):
    r = random.Random(5)
    base = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=200)) for _ in range(12)]
    rows = []
    for b in base:
        for _ in range(r.randrange(1, 8)):
            w = b.split()
            for _ in range(r.randrange(3)):
                w[r.randrange(200)] = "Z"
            rows.append(" ".join(w))
    rows += [None, "", "  ", "one", "ONE", "two words", base[0].upper(), base[0].upper()]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(simhash.components(docs).collect())
    fps = [plain_fingerprint(t) for t in rows]
    assert [g.fp % 2**64 for g in got] == fps
    assert [g.component_id for g in got] == plain_components(range(len(rows)), fps)
    kept = simhash.drop_near_duplicates(docs.union(docs.limit(9)))
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(plain_components(range(len(rows)), fps)))
    assert simhash.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_of_crowded_buckets(spark, bucket):
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))) for _ in range(150)} | {r.getrandbits(64) for _ in range(50)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    e = simhash.links(df, 2, bucket).collect()
    assert all(((x.u ^ x.v) % 2**64).bit_count() <= 2 for x in e)
    cc = {x.node: x.root for x in components.connected_components(spark.createDataFrame([(x.u, x.v) for x in e], "u long, v long")).collect()}
    want = dict(zip(signed, plain_components(signed, [f % 2**64 for f in signed])))
    assert {f: cc.get(f, f) for f in signed} == want


def test_threshold_plans_keep_the_pigeonhole_sum():
    r = np.random.default_rng(1)
    x = (r.random((500, 64)) < r.uniform(0.2, 0.8, 64)).astype(float)
    for n in (500, 10**6, 10**9):
        parts = simhash.plan(n, x.T @ x * (n / 500), 2)
        groups = sum(len(g) for g, _ in parts)
        assert groups <= 64 and all(t >= 0 for _, t in parts)
        # any two bits flipped leave one probed partition within its threshold
        for _ in range(300):
            flipped = set(r.choice(64, 2, replace=False).tolist())
            assert any(len(flipped & set(g)) <= t for g, t in parts)


def test_forest_recall_and_edges(spark):
    r = np.random.default_rng(5)
    centers = r.normal(size=(30, 24))
    x = (centers[r.integers(0, 30, 3000)] + 0.7 * r.normal(size=(3000, 24))).astype(np.float32)
    x[100:140] = x[100]  # equal vectors
    rows = [(i, [float(v) for v in x[i]], "mine") for i in range(3000)] + [(3000, None, ""), (3050, [0.0] * 24, ""), (3100, [float("nan")] * 24, ""), (3150, [1.0, None], ""), (None, [1.0] * 24, ""), (150, [float(v) for v in x[150]], "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, h1 string").repartition(3)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    # also with parts so small that a tree is cut often, and a sample of a part of the rows
    for forest in (ann_forest.Forest(), ann_forest.Forest(gather=3.0, sample=1000, part_rows=500)):
        found = defaultdict(list)
        for q in sorted(ann_forest.nearest(df, F.col("vec_id") % 50 == 0, 5, forest).collect(), key=lambda q: (q.query_id, q["rank"])):
            found[q.query_id].append((q.vec_id, q.score))
            assert 0 <= q.level <= 8 and q.gathered > 0
        hit = 0
        for q in range(0, 3000, 50):
            s = u @ u[q]
            s[q] = -9
            want = sorted(range(3000), key=lambda i: (-round(s[i], 12), i))[:5]  # noqa: B023
            assert len(found[q]) == 5 and q not in [v for v, _ in found[q]]
            assert all(abs(sc - s[v]) < 1e-9 for v, sc in found[q])
            hit += len({v for v, _ in found[q]} & set(want))
        assert set(found) == set(range(0, 3000, 50)) and hit / 300 >= 0.9
        assert [v for v, _ in found[100]] == [101, 102, 103, 104, 105]
    few = ann_forest.nearest(df.where("vec_id in (50, 51)"), F.col("vec_id") % 50 == 0, 5).collect()
    assert [(q.query_id, q["rank"], q.vec_id) for q in few] == [(50, 1, 51)]
    assert ann_forest.nearest(df.limit(0), F.lit(True)).count() == 0


def test_forest_scales_before_it_squares(spark):
    rows = [(0, [1e200, 1e-200, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 1e-200, 0.0]), (3, [1e200, 1e200, 0.0]), (4, [1.0, 2.0]), (4, [5.0, 5.0, 5.0]), (5, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann_forest.nearest(df, F.col("vec_id").isin(0, 5), 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 1.0), (0, 3, 0.707107), (0, 4, 0.57735), (0, 2, 0.0), (5, 4, 1.0)]


def test_forest_ascends_to_longer_prefixes_of_near_vectors():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(4000, 64)), r.normal(size=64) + 0.01 * r.normal(size=(4000, 64))])
    router = ann_forest.Router(x, len(x), ann_forest.Forest(), 64)
    far, near = router.ascend(ann_forest.unit(x[:50])), router.ascend(ann_forest.unit(x[-50:]))
    assert {k for k, _, _ in far} <= {1, 2} and all(k > 2 for k, _, _ in near)
    # strings of one prefix lie side by side, and every part that may hold one is asked
    t = ann_forest.hash_strings(ann_forest.unit(x), router.turns[0])
    for _, _, ranges in far[:5]:
        (low, high) = ranges[0]
        assert all(a <= b for a, b in zip(low, high, strict=True)) and sum(((t >= a) & (t <= b)).sum() for a, b in zip(low, high, strict=True)) > 0


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (2, None, None), (4, "http://c/\r\nX: y", ""), (7, "u", "é" * 5000), (7, "u", "é" * 5000), (8, "u", "z" * 300000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.error) for r in warc.archive_and_read(pages).collect())
    d = lambda t: (len((t or "").encode()), warc.b32_sha1((t or "").encode()))
    want = [(1, *d("<p>x</p>"), "response", None, None), (2, *d(""), "response", None, None), (3, *d("<p>x</p>"), "revisit", 1, None), (4, *d(""), "revisit", 2, None), (7, *d("é" * 5000), "response", None, None), (7, *d("é" * 5000), "revisit", 7, None), (8, *d("z" * 300000), "response", None, None)]
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3], x[4] or 0))
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_warc_reader_validates():
    dictionary = b"common header words " * 50
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    good = warc.record("urn:x-page:1", "response", "http://a/", b"body", None, "2024-01-01T00:00:00Z")
    head = warc.dictionary_frame(dictionary)
    assert [r["error"] for r in warc.records(head + z.compress(good) * 2)] == [None, None]
    assert next(warc.records(head + z.compress(good)))["payload"] == b"body"
    plain = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    raw_head = b"\x5d\x2a\x4d\x18" + len(dictionary).to_bytes(4, "little") + dictionary
    assert next(warc.records(raw_head + plain.compress(good)))["error"] is None
    errors = [next(warc.records(head + z.compress(x)))["error"] for x in (good[:-1], good.replace(b"body", b"b0dy"), good.replace(b"WARC-Date", b"X-Date"), b"junk", good.replace(b"Content-Length: 4", b"Content-Length: 5"))]
    assert all(errors) and len(set(errors)) >= 4
    assert [bool(r["error"]) for r in warc.records(head + z.compress(good) + z.compress(good)[:-9])] == [False, True]


def test_warc_reader_goes_on_after_a_bad_frame():
    z = zstandard.ZstdCompressor(write_checksum=True)
    good = [z.compress(warc.record(f"urn:x-page:{i}", "response", "http://a/", b"body", None, "2024-01-01T00:00:00Z")) for i in range(4)]
    flipped = good[1][:-1] + bytes([good[1][-1] ^ 1])
    got = [(r["record_id"], bool(r["error"])) for r in warc.records(good[0] + flipped + good[2] + good[3])]
    assert got == [("urn:x-page:0", False), (None, True), ("urn:x-page:2", False), ("urn:x-page:3", False)]
    got = [(r["record_id"], bool(r["error"])) for r in warc.records(good[0] + b"no frame at all" + good[2])]
    assert got == [("urn:x-page:0", False), (None, True), ("urn:x-page:2", False)]


def test_url_filter_ties_and_addresses(spark):
    caps = spark.createDataFrame([(1, "http://a.example/", "x"), (2, "http://[2001:DB8::1]:80/p", "x"), (3, "http://1.2.3.4/", "x"), (4, "nothing", "x"), (5, None, "x")], "id long, url string, host string").withColumn("fetched", F.lit("2024-06-01").cast("timestamp"))
    day = F.lit("2024-01-01").cast("timestamp")
    entries = spark.createDataFrame([("ab", "block", "a.example"), ("a", "block", "a.example"), ("v6", "block", "[2001:db8::1]"), ("tail", "block", "3.4")], "list string, kind string, domain string").withColumn("action", F.lit("add")).withColumn("at", day)
    got = {r.id: (r.host, r.list) for r in url_filters.filter_captures(caps, entries, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert got == {1: ("a.example", "a"), 2: ("[2001:db8::1]", "v6"), 3: ("1.2.3.4", None), 4: (None, None), 5: (None, None)}
    assert url_filters.filter_captures(caps.limit(0), entries, day).count() == 0


def test_mix_keeps_clashing_columns_and_repeated_ids(spark):
    rows = [(1, f"word{i} " * 40, "a", i, "u", {"k": i}) for i in range(20)] + [(1, "word0 " * 40, "a", 0, "u", {"k": 0}), (2, "x y z", None, 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, words_of_row int, doc_id_of_row string, row_key map<string,int>")
    mixed = mixing.mix_documents(docs)
    once, again = sorted(map(repr, mixed.collect())), sorted(map(repr, mixing.mix_documents(docs.repartition(5)).collect()))
    assert mixed.columns == docs.columns and once == again
    assert {r.words_of_row for r in mixed.collect()} == {*range(20), 5}


def test_running_sums(spark):
    df = spark.createDataFrame([(i % 7, i, 1 + i % 3) for i in range(500)], "a int, b int, n long")
    got = {(r.a, r.b): r.before for r in mixing.running(df, ["a", "b"], before="n").collect()}
    at = 0
    for a, b, n in sorted((i % 7, i, 1 + i % 3) for i in range(500)):
        assert got[a, b] == at
        at += n


def test_mixture_targets_and_bounds(spark):
    r = random.Random(6)
    rows = [(i, " ".join("w" * 1 for _ in range(r.randrange(0, 400))), r.choice(["a", "b", "c", None, "big", "big", "big"])) for i in range(300)] + [(300, None, "a"), (301, "x " * 5000, "b"), (5, "dup dup", "a"), (5, "dup dup", "a"), (None, "no id", "c"), (400, "", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, target = 1.5 * sum(size.values()), {}
    left = set(names)
    while True:
        free = total - sum(2 * size[s] for s in names if s not in left)
        over = {s for s in left if free * weight[s] / sum(weight[x] for x in left) > 2 * size[s]}
        if not over:
            break
        left -= over
    for s in names:
        target[s] = free * weight[s] / sum(weight[x] for x in left) if s in left else 2 * size[s]
    taken = Counter()
    for g in got:
        assert 0 <= g.taken <= 2 * g.size and abs(g.target - target[g.source]) < 1e-6 and g.source_size == size[g.source]
        taken[g.source] += g.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mixture(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mixture(docs.limit(0)).count() == 0


def test_schedule_spreads_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 64, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    mix = mixing.Mix(block=32)
    sized = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    per = mixing.targets(sized, mix)
    slots = mixing.schedule(per, mix).orderBy("slot").collect()
    share = {r.s: r.target for r in per.collect()}
    for lo in range(0, len(slots) - 100, 50):
        n = Counter(x.s for x in slots[lo : lo + 100])
        assert all(abs(n[s] - 100 * share[s] / sum(share.values())) <= 4 for s in share)


def test_url_filter_against_plain_rules(spark):
    from datetime import datetime, timedelta

    r = random.Random(11)
    day = lambda k: datetime(2024, 1, 1) + timedelta(days=k)
    domains = ["a.com", "x.a.com", "b.org", "y.b.org", "com"]
    entries = [(lst, kind, r.choice(domains), r.choice(["add", "remove"]), day(r.randrange(300))) for lst, kind in (("spam", "block"), ("adult", "block"), ("good", "allow")) for _ in range(12)] + [("spam", "block", None, "add", day(1)), ("spam", "block", "a.com", "add", None)]
    caps = [(i, r.choice(["http://x.a.com/p?q", "https://u@B.org:80/", "http://z.y.b.org.", "ftp://q.a.com#f", "nothing", None]), day(r.randrange(400)) if i % 9 else None) for i in range(150)]
    got = url_filters.filter_captures(spark.createDataFrame(caps, "id long, url string, fetched timestamp"), spark.createDataFrame(entries, "list string, kind string, domain string, action string, at timestamp"), F.lit("2026-01-01").cast("timestamp"))
    out = {x.id: x for x in got.collect()}
    host = {"http://x.a.com/p?q": "x.a.com", "https://u@B.org:80/": "b.org", "http://z.y.b.org.": "z.y.b.org", "ftp://q.a.com#f": "q.a.com"}
    for i, url, t in caps:
        h, best = host.get(url), None
        if h and t:
            for lst, kind in (("spam", "block"), ("adult", "block"), ("good", "allow")):
                for d in domains:
                    if h == d or h.endswith("." + d):
                        known = [(at, a) for l2, _, d2, a, at in entries if (l2, d2) == (lst, d) and at is not None and at <= t]
                        if known and max(known)[1] == "add":
                            k = (-len(d), kind, lst)
                            best = min(best, (k, lst, d)) if best else (k, lst, d)
        assert (out[i].host, out[i].verdict, out[i].list, out[i].domain) == (h, best[0][1] if best else "none", best and best[1], best and best[2]), (i, url, t)
    assert len(out) == len(caps)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(13)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(500)]
    good = [" ".join(r.choices(words, k=120)) for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate([*good, good[3], None, "", "too short", "again and again " * 90, good[5] + ' token = "0123456789abcdef0123456789abcdef"'])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({x.doc_id for x in docs.collect()})
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert set(range(30)) <= seen[0] and not seen[0] & {31, 32, 33, 34} and 30 not in seen[1] and seen[2] == seen[1]
    assert docs.where(F.col("text").contains("0123456789abcdef")).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(x.n_tokens == len(x.ids) for x in out)
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


@pytest.mark.parametrize("bucket", [4, 32])
def test_near_copies_of_the_pipeline(spark, bucket):
    import corpus_pipeline
    from timeweave.llm import near_copies

    r = random.Random(21)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for k in range(40):
        base = [word() for _ in range(300)]
        rows.append(" ".join(base))
        # edits at 1 to 6 places change 5 shingles each: similarity (296 - 5 e) / (296 + 5 e), 0.816 and more
        for e in range(1, 7 if k else 40):
            w = list(base)
            for at in r.sample(range(5, 295, 10), min(e, 6) if k else 2):
                w[at] = word()
            rows.append(" ".join(w))
        rows.append(" ".join(base[:100] + [word() for _ in range(200)]))
    rows += [None, "", "one", "ONE", "two words", "two  Words"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    want = sorted(set(root))
    stage = corpus_pipeline.near_dedup(spark, docs, "") if bucket == 32 else near_copies.drop(docs.union(docs.limit(50)), bucket=bucket)
    assert sorted(x.doc_id for x in stage.collect()) == want
    assert near_copies.drop(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    from timeweave.llm import near_copies

    texts = ["one two three four five six", "seven eight nine ten eleven twelve", "one two three four five six", None, ""]
    docs = spark.createDataFrame([(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[0], "a"), (2, texts[2], "c"), (None, texts[0], "d"), (3, texts[3], "e"), (4, texts[4], "f")], "doc_id long, text string, row_key string")
    got = [(r.doc_id or 0, r.text, r.row_key) for r in near_copies.drop(docs).collect()]
    assert sorted(got, key=lambda r: (r[0], r[1] or "", r[2])) == sorted([(0, texts[0], "d"), (1, texts[0], "a"), (1, texts[1], "b"), (3, None, "e")], key=lambda r: (r[0], r[1] or "", r[2]))


def test_majority_of_hashes():
    from timeweave.llm import simhash

    r = np.random.default_rng(4)
    row, h = np.sort(r.integers(0, 9, 300)), r.integers(0, 2**64, 300, dtype=np.uint64)
    row[row == 4] = 5
    for k, fp in enumerate(simhash.majority(row, h, 10).tolist()):
        own = [int(x) for x in h[row == k]]
        assert fp == sum((2 * sum(x >> b & 1 for x in own) > len(own)) << b for b in range(64))


def test_equal_scores_of_multiples_go_by_id(spark):
    """A hundred lengths of one direction, more than are scored exactly, beside other directions and a mirror image."""
    base = np.array([1.0, -2.0, 3.0, 0.0, 5.0, 7.0])
    rows = [(k, (base * k).tolist()) for k in range(1, 101)] + [(200 + k, np.random.default_rng(k).standard_normal(6).tolist()) for k in range(60)] + [(0, (-base).tolist()), (-5, (base * 0.5).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann_forest.nearest(frame, F.col("vec_id").isin(50, 1, 0), k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert [got[50][k][0] for k in range(1, 6)] == [-5, 1, 2, 3, 4] and [got[1][k][0] for k in range(1, 6)] == [-5, 2, 3, 4, 5]
    assert all(abs(got[50][k][1] - 1) < 1e-12 for k in range(1, 6)) and got[0][1][1] < 1
