"""Whitening, language mixtures and spelling variants against plain versions, held-out data and hand-made cases."""

import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.llm import languages, queries, spelling, whitening

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- whitening


@pytest.mark.parametrize("n, rank", [(1, 1), (2, 1), (3, 3), (40, 40), (40, 2), (90, 90)])
def test_leading_components(n, rank):
    r = np.random.default_rng(n + rank)
    a = r.standard_normal((n, rank))
    a = a @ a.T
    values, q = whitening.leading_components(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][: len(values)]
    assert np.abs(values - want).max() < 1e-13 * want[0] * n
    assert np.abs(a @ q - q * values).max() < 1e-13 * want[0] * n
    assert np.abs(q.T @ q - np.eye(q.shape[1])).max() < 1e-13


@pytest.mark.parametrize("diagonal", [[1, 1, 1, 1, 1, 1], [3, 3, 3, 1, 1], [1, 2, 3, 4, 5], [7, 7, 0, 0, 0]])
def test_equal_eigenvalues(diagonal):
    a = np.diag(np.array(diagonal, float))
    turn, _ = np.linalg.qr(np.random.default_rng(5).standard_normal(a.shape))
    for m in (a, turn @ a @ turn.T):
        values, q = whitening.leading_components(m, 4)
        assert np.allclose(values, sorted(diagonal)[::-1][:4], atol=1e-12)
        assert np.abs(m @ q - q * values).max() < 1e-12 and np.abs(q.T @ q - np.eye(4)).max() < 1e-12


def test_sturm_counts():
    r = np.random.default_rng(3)
    d, e = r.standard_normal(30), r.standard_normal(29)
    e[10] = 0
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1)
    x = np.linspace(-4, 4, 101)
    assert (whitening.counts_below(d, e, x) == [(np.linalg.eigvalsh(t) < v).sum() for v in x]).all()


def plain_whitening(vectors, k=4):
    x = np.array(sorted({tuple(math.floor(256 * float(v)) for v in row) for row in vectors}), np.int64)
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    mean = np.array([float(Fraction(v, n)) for v in s])
    v = np.cov((x - mean).T, bias=True)
    e, q = np.linalg.eigh(v)
    return n, s, mean, e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def test_whitening_of_the_table(spark):
    got = queries.op11_whitening(spark, SF).collect()
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    n, s, mean, e, q, trace = plain_whitening([v for _, v in rows])
    own = dict(rows)
    assert len(got) == 4 * len(rows) and {r.component for r in got} == {1, 2, 3, 4}
    signs = {}
    for r in got:
        x = np.array([math.floor(256 * float(v)) for v in own[r.vec_id]])
        w = (x - mean) @ q[:, r.component - 1] / math.sqrt(e[r.component - 1])
        sign = signs.setdefault(r.component, math.copysign(1, w * r.whitened) if abs(w) > 0.1 else None) or 1
        if signs[r.component] is None:
            del signs[r.component]
        assert abs(r.whitened - sign * w) < 1e-9 or abs(w) <= 0.1
        assert r.n == n and r.deviation == sum((n * int(a) - b) ** 2 for a, b in zip(x, s, strict=True))
        assert abs(r.explained / (e[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-9


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, n long, x string, v string, component int"
    frame = lambda rows: spark.createDataFrame([(i, v, 0, "x", "v", 9) for i, v in rows], schema)
    run = lambda rows: whitening.apply(frame(rows), whitening.fit(frame(rows))).collect()
    assert run([]) == []
    assert run([(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 2.0])]) == []
    assert run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector: no component
    got = run([(None, [0.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [float("nan"), 0.0])])
    assert [(r.id, r.component, r.n) for r in sorted(got, key=lambda r: (r.id or 0, r.whitened))] == [(None, 1, 3), (1, 1, 3), (1, 1, 3), (2, 1, 3)]
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-12 for r in got)
    big = run([(1, [float(1 << 40), 0.0]), (2, [0.0, 1.0]), (3, [5.0, -float(1 << 40)])])
    assert {r.deviation for r in big} == {None} and len(big) == 6 and max(r.identity_error for r in big) < 1e-9
    with pytest.raises(ValueError):
        whitening.fit(spark.createDataFrame([([0.0] * (whitening.DIMENSIONS + 1),)], "embedding array<double>"))


def test_whole_number_products_beyond_doubles():
    y = np.array([[1 << 40, 3], [-(1 << 40) + 1, 5]], np.int64)
    assert whitening._products(y).tolist() == [[(1 << 80) + ((1 << 40) - 1) ** 2, 3 * (1 << 40) + 5 * (1 - (1 << 40))], [3 * (1 << 40) + 5 * (1 - (1 << 40)), 34]]


# ---------------------------------------------------------------- languages

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "ru", "no"], "bb": ["sch", "ein", "ung", "ber", "ach", "oft"], "cc": ["ção", "lha", "dos", "que", "ém", "vez"]}


def made_text(lang, words, r):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randrange(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def learned(spark):
    r = random.Random(2)
    rows = [(lang, made_text(lang, 60, r)) for lang in SYLLABLES for _ in range(30)] + [(None, "zzz qqq"), ("aa", None)]
    return languages.train(spark.createDataFrame(rows, "lang string, text string"))


def found_languages(spark, model, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("own")).withColumn("held_out", F.lit(1)).withColumn("lang", F.lit(2))
    return {r.doc_id: r for r in languages.predict(docs, model, F.lit(False)).collect()}


def test_mixtures(spark, learned):
    r = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        names = r.sample(sorted(SYLLABLES), 1 + i % 3)
        shares = {n: 80 + 60 * k for k, n in enumerate(names)}
        rows.append((i, ". ".join(made_text(n, m, r) for n, m in shares.items())))
        want[i] = shares
    got = found_languages(spark, learned, rows)
    for i, shares in want.items():
        total = sum(shares.values())
        assert {x.lang for x in got[i].languages} == set(shares), i
        assert all(abs(x.share - shares[x.lang] / total) < 0.06 for x in got[i].languages)
        assert got[i].lang_pred == max(shares, key=shares.get) and abs(sum(x.share for x in got[i].languages) - 1) < 1e-9


def test_proportions_are_the_likeliest():
    """EM's proportions of two languages against a search over all shares."""
    r = np.random.default_rng(1)
    p = r.random((80, 3))
    first, n, row = np.array([0, 30]), np.array([30, 50]), np.repeat([0, 1], [30, 50])
    pi, value = languages.proportions(p, first, n, row, np.array([[1.0, 1, 0], [1, 1, 0]]), rounds=3000, close=1e-12)
    for k, (a, b) in enumerate([(0, 30), (30, 80)]):
        shares = np.linspace(0, 1, 20001)
        all_values = np.log(np.outer(p[a:b, 0], shares) + np.outer(p[a:b, 1], 1 - shares)).sum(axis=0)
        assert abs(all_values.max() - value[k]) < 1e-6 and abs(shares[all_values.argmax()] - pi[k, 0]) < 1e-2


def test_language_edges(spark, learned):
    r = random.Random(4)
    long = made_text("bb", 200_000, r)
    rows = [(1, None), (2, ""), (3, "123 -- ́́"), (4, long), (5, "ka" * 40_000), (None, "kalomi taru"), (5, "ka" * 40_000), (6, "schung ퟿ einber"), (7, "数据 ученье")]
    docs = [(i, t) for i, t in rows]
    got = spark.createDataFrame(docs, "doc_id long, text string")
    out = languages.predict(got, learned, F.lit(True)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [(by[i].lang_pred, by[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert (by[4].lang_pred, by[5].lang_pred, by[None].lang_pred, by[6].lang_pred) == ("bb", "aa", "aa", "bb") and by[7].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in out)
    none = languages.train(got.limit(0).withColumn("lang", F.lit("x")))
    assert {r.lang_pred for r in languages.predict(got, none, F.lit(True)).collect()} == {"und"}
    assert languages.predict(got.limit(0), learned, F.lit(True)).count() == 0


def test_letters_by_code_points():
    rows = ["Éa-ß", "", "x", "日本 áb"]
    raw = [t.encode() for t in rows]
    z, own = languages.letters_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(b) for b in raw]))
    at = np.flatnonzero(z)
    assert [chr(z[i]) for i in at] == list("éaßx日本áb") and own[at].tolist() == [0, 0, 0, 2, 3, 3, 3, 3, 3]
    first = languages.words_of(z, languages.grams(z)[0])
    assert first.tolist() == [True, False, True, True, True, False, True, False, False]


def test_held_out_languages(spark):
    """Of documents that the model has not seen, nearly all get the language that the table names."""
    sf = "/root/testdata/sf0.01"
    got = queries.op12_language_mixture(spark, sf).collect()
    langs = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    held = [r for r in got if r.held_out]
    assert len(got) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    right = [r.lang_pred == langs[r.doc_id] for r in held]
    assert sum(right) / len(right) > 0.97
    assert sum(r.n_languages == 1 for r in got) / len(got) > 0.95


# ---------------------------------------------------------------- spelling


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in w)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return n


def plain_variants(n, ratio=5):
    holes = {}
    for w in n:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(v, set()).add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        ns = {x for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in holes[v] if x != w and near(w, x)}
        top = min(ns, key=lambda x: (-n[x], x), default=None)
        out[w] = (top if top is not None and n[top] >= ratio * n[w] else None, len(ns))
    root = lambda w: w if out[w][0] is None else root(out[w][0])
    return {w: (n[w], k, f, n[f] if f else None, root(w)) for w, (f, k) in out.items()}


def test_spelling_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = plain_variants({w: k for w, k in plain_words(rows).items() if len(w) >= 6 and k >= 5})
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.op13_spelling_variants(spark, sf).collect()}
    assert got == want and any(r[2] for r in want.values())


@pytest.mark.parametrize("longest, frequent", [(2, 10), (3, 0), (4, 3), (6, 1), (6, 5), (6, 10**9)])
def test_pairs_with_any_dictionary(spark, longest, frequent):
    """Short, weak and repetitive words; grams of any length; ties of forms."""
    r = random.Random(longest * 100 + frequent)
    words = {"".join(r.choices("abé", k=r.randrange(0, 9))): r.randrange(1, 400) for _ in range(260)}
    words |= {"aaaaaaaa": 7, "aaaaaaa": 1, "a": 3, "": 2, "é": 3, "kanten": 1, "kante": 40, "xkanten": 40, "kanton": 40}
    frame = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("gram", F.lit(1)).withColumn("p", F.lit("x"))
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(frame, 5, longest, frequent).collect()}
    assert got == plain_variants(words)


def test_bound_of_affected_grams(spark):
    """Any edit of any word keeps at least all grams but the bound, at their place or moved by one."""
    r = random.Random(9)
    base = ["".join(r.choices("abc", k=r.randrange(6, 11))) for _ in range(25)]
    edits = {w: [w[:i] + ch + w[i:] for i in range(len(w) + 1) for ch in "abc"] + [w[:i] + w[i + 1 :] for i in range(len(w))] + [w[:i] + ch + w[i + 1 :] for i in range(len(w)) for ch in "abc"] for w in base}
    every = sorted({*base, *(x for xs in edits.values() for x in xs)})
    frame = spark.createDataFrame([(w, 1) for w in every], "word string, n long")
    parts = {r.word: r for r in spelling.decompose(frame, spelling.frequent_grams(frame, 5, 400), 5).collect()}
    for w, xs in edits.items():
        mine = parts[w]
        for x in xs:
            other = {(g.gram, g.p) for g in parts[x].grams}
            lost = sum((g.gram, g.p) not in other and (g.gram, g.p + len(x) - len(w)) not in other for g in mine.grams)
            assert lost <= mine.affected


def test_spelling_edges(spark):
    schema = "doc_id long, text string, word string, n int, w string, h int, id string"
    frame = lambda rows: spark.createDataFrame([(i, t, "w", 1, "w", 2, "i") for i, t in rows], schema)
    assert spelling.variants(spelling.vocabulary(frame([]))).count() == 0
    rows = [(1, None), (2, ""), (3, "12 ½ ..."), (None, "Kanten " * 7), (5, "ÀÉkanten×÷ " * 6), (5, "ÀÉkanten×÷ " * 6), (6, "kanten-KANTEN_känten " * 40_000), (7, "k" * 300_000 + " ")]
    want = {w: k for w, k in plain_words(rows).items() if len(w) >= 6 and k >= 5}
    got = {r.word: r.n for r in spelling.vocabulary(frame(rows)).collect()}
    assert got == want


def test_extra_columns_and_empty_tables_of_earlier_operators(spark):
    """Columns that clash with the operators' own names, and tables without rows."""
    import public_tokenizers

    from timeweave.llm import bpe, ngram_lm, quality, simhash, toxicity

    docs = spark.createDataFrame([(1, "a b c d " * 20, "x", 1, 2, 3, 4, 5, 6), (2, None, "y", 1, 2, 3, 4, 5, 6)], "doc_id long, text string, kept string, n_words int, fp int, held_out int, score int, ids int, root int")
    tokens = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    known = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    yes = F.lit(True)
    for rows, n in ((docs, 2), (docs.limit(0), 0)):
        assert quality.compression_bands(rows).count() == n
        assert bpe.digests(rows, *tokens).count() == n
        assert simhash.components(rows).count() == n
        assert ngram_lm.score(rows, ngram_lm.train(rows, 2, shards=2), yes).count() == n
        assert toxicity.score(rows, toxicity.train(rows, known, yes), yes).count() == n
