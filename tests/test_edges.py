"""Edges that the given tables hold only at larger sizes: operators against plain versions, queries against their SQL."""

import math
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from timeweave.functions import numbers, text
from timeweave.operators import clean, folds, intervals, story

S = 1_000_000


def test_silence_has_a_level_and_makes_runs(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, None), (1, 3, 100.0)], "source_id long, h long, power double")
    got = {r.h: r.db for r in rows.select("h", numbers.decibels(F.col("power")).alias("db")).collect()}
    assert got[0] == -math.inf and got[1] == 0.0 and got[2] is None and got[3] == 20.0
    levels = rows.select("source_id", F.col("h").alias("start_us"), (F.col("h") + 1).alias("end_us"), numbers.decibels(F.col("power")).alias("db"))
    assert [(r.start_us, r.end_us) for r in intervals.flag_runs(levels, F.col("db") < 15, 2).collect()] == [(0, 2)]


def test_levels_equal_sql_below_one_and_before_1970(spark, tmp_path):
    from timeweave import queries

    # 0.2 and 1.4: their mean power is 1 less a rounding, so SQL's level is -0.0
    duckdb.execute(f"""copy (select i as event_id, make_timestamp(us) as ts, u as user_id, 'view' as event_type, v::double as value, '' as props
        from (values (1, 5, 1, 0.2), (2, 6, 1, 1.4), (3, -1, 2, 1.0), (4, -3600000001, 2, 3.5), (5, 1, 3, 0.0), (6, 1, null, null), (7, 9, 4, 1.0)) t(i, us, u, v)) to '{tmp_path}/events.parquet' (format parquet)""")
    con = duckdb.connect()
    con.execute(f"set timezone = 'UTC'; create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute(queries.ORACLES["b37_level_windows"]).fetchall()
    got = [tuple(r) for r in queries.QUERIES["b37_level_windows"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and "-0.0" in repr(want)


def test_word_edges_and_ends_are_those_of_sql(spark):
    texts = ["queê", "aque", "ßque", "que.", "que\n", "a-que", "QUE", "que_"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for p in (r"^que\b", r"\bque\b", r"\bque$", r"que[^a-z]$", r"[$e]$"):
        got = {r.x for r in df.where(F.col("x").rlike(text.sql_pattern(p))).collect()}
        want = {x for x in texts if duckdb.execute("select regexp_matches(?, ?)", [x, p]).fetchone()[0]}
        assert got == want, p
    assert text.sql_pattern(r"[a$]\$") == r"[a$]\$"


def test_edges_of_words_are_looked_at_on_one_side_where_that_will_do(spark):
    import re

    from timeweave.operators import commercial

    both = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    assert text.sql_pattern(r"\bque\b|\bqual\b") == r"(?<!\w)(?:que(?!\w)|qual(?!\w))" and text.sql_pattern(r"\b[.a]\b") == f"{both}[.a]{both}"
    # no edge of a cue's word has to be looked at from both sides, but for those beside marks
    assert sum(text.sql_pattern(p).count(both) for _, p in commercial.CUES) <= 3
    plain = lambda p: p.replace(r"\b", both)
    texts = ["por 10,50 reais", "pre\u00e7o x 9", "a 5 x 3 vezes", "xcompre", "\u00dfcompre ja", "www.a-b.com.br", "a_b@c.de", "produtos, produto1", "use o abc", "alivia a dor", "de cento e dez por noventa"]
    for _, p in commercial.CUES:
        for t in texts:
            assert [m.span() for m in re.finditer(text.sql_pattern(p), t, re.A)] == [m.span() for m in re.finditer(plain(p), t, re.A)], (p, t)
    # a cue beside a letter that is no ASCII letter stands at a word's edge, as in SQL
    df = spark.createDataFrame([("\u00dfcompre",)], "text string")
    assert [r.signal for r in commercial.cue_hits(df, []).collect()] == ["sales_cta"]


def test_laughter_before_a_sharp_s_is_a_word(spark):
    s = spark.createDataFrame([(1, 0, 9 * S, "so que ele caiu da escada ße")], "source_id long, start_us long, end_us long, text string")
    c = spark.createDataFrame([(1, "c", 0, 9 * S, True)], "source_id long, clip_id string, start_us long, end_us long, hinted boolean")
    r = story.humor_integrity(c, s).first()
    assert (r.status, r.blockers) == ("incomplete", "punchline_not_grounded")


def test_phrases_with_a_common_first_word_make_no_pairs(spark):
    n = 3_000
    s = spark.createDataFrame([(1, f"s{k}", ["a", f"x{k}"] * 40) for k in range(n)], "source_id long, segment_id string, tokens array<string>")
    p = spark.createDataFrame([(1, f"p{k}", ["a", f"x{k}"]) for k in range(n)] + [(1, "long", ["x7", "a", "x7"]), (1, "one", ["x8"]), (1, "none", [])], "source_id long, phrase_id string, phrase array<string>")
    began = time.time()
    got = {(r.phrase_id, r.segment_id, r.first_at) for r in clean.phrase_locate(p, s).collect()}
    assert got == {(f"p{k}", f"s{k}", 1) for k in range(n)} | {("long", "s7", 2), ("one", "s8", 2)}
    assert time.time() - began < 30  # 360 million comparisons otherwise


def test_alignment_by_diagonals_equals_cells_one_by_one():
    r = np.random.default_rng(1)
    for n, m in ((0, 0), (0, 3), (3, 0), (1, 1), (1, 4), (4, 1), (5, 9), (40, 33)):
        pair = r.random((n, m)) * 2
        cost = np.zeros((n + 1, m + 1))
        cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
        for i in range(n):
            for j in range(m):
                cost[i + 1, j + 1] = min(cost[i, j] + pair[i, j], cost[i, j + 1] + 1, cost[i + 1, j] + 1)
        assert (folds.aligned_cost(pair) == cost).all()


def _plain_steps(tx, ty, mx, my):
    drift = np.abs(mx[:, None] - my[None, :])
    pair = np.where(tx[:, None] == ty[None, :], np.minimum(0.2, drift * 0.05), 1.2 + np.minimum(0.8, drift * 0.3))
    cost, i, j, out = folds.aligned_cost(pair), len(tx), len(ty), []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + pair[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append(("equal" if tx[i] == ty[j] else "replace", i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(("delete", i, None))
        else:
            j -= 1
            out.append(("insert", None, j))
    return out[::-1]


def test_regions_of_any_length_are_aligned(spark):
    r = np.random.default_rng(8)
    rows: tuple[list, list] = ([], [])
    want = {}
    for region, sizes in (("long", (760, 700)), ("short", (9, 14)), ("gone", (5, 0)), ("new", (0, 3))):
        tokens = [r.integers(0, 40, n) for n in sizes]
        tokens[1][: sizes[1] // 2] = np.resize(tokens[0], sizes[1] // 2) if sizes[0] else 0
        middles = [np.sort(r.integers(0, 60 * S, n)) for n in sizes]
        for side in (0, 1):
            rows[side].extend((1, region, f"{k:04d}", f"W{t}!", int(m), int(m) + 1000) for k, (t, m) in enumerate(zip(tokens[side], middles[side], strict=True)))
        seconds = [(m + m + 1000) / 2e6 for m in middles]
        want[region] = [(kind, None if i is None else f"{i:04d}", None if j is None else f"{j:04d}") for kind, i, j in _plain_steps(*tokens, *seconds)]
        # a long region is settled again stretch by stretch: the same way
        if min(sizes):
            a = folds._Alignment(*(x[:, None] for x in (*tokens, *seconds)))
            plain, long = (list(f(*(np.array([n]) for n in sizes))) for f in (a.run, a.run_long))
            assert [tuple(x.item() for x in step) for step in plain] == [tuple(x.item() for x in step) for step in long]
    a, b = (spark.createDataFrame(x, "source_id long, region_id string, word_id string, word string, start_us long, end_us long") for x in rows)
    got: dict[str, list] = {}
    for x in folds.hypothesis_diff(a, b).collect():
        got.setdefault(x.region_id, []).append((x.kind, x.a_id, x.b_id))
    assert got == want


def test_largest_matching_in_blocks_equals_augmenting_paths(spark):
    r = np.random.default_rng(5)
    for n, m, share in ((0, 4, 1.0), (4, 0, 1.0), (30, 25, 0.05), (60, 60, 0.03), (200, 180, 0.012)):
        e = r.random((n, m)) < share
        partner: dict[int, int] = {}

        def place(i, tried):
            for j in np.flatnonzero(e[i]).tolist():
                if j not in tried:
                    tried.add(j)
                    if j not in partner or place(partner[j], tried):
                        partner[j] = i
                        return True
            return False

        want = sum(place(i, set()) for i in range(n))
        row, end = np.nonzero(e)
        assert folds.largest_matching(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), end.astype(np.int32), m) == want
    # a chain of 3,000 boxes, each next to two: deeper than recursion goes
    n = 3_000
    ends = np.array([j for i in range(n) for j in ((i, i + 1) if i < n - 1 else (0,))], np.int32)
    assert folds.largest_matching(np.concatenate([np.arange(0, 2 * n, 2), [2 * n - 1]]), ends, n) == n
    a, b = r.random((70, 4)) * [0.5, 0.5, 0.3, 0.3] + [0, 0, 0.1, 0.1], r.random((90, 4)) * [0.5, 0.5, 0.3, 0.3] + [0, 0, 0.1, 0.1]
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    want = both >= 0.5 * (a[:, 2:].prod(axis=1)[:, None] + b[:, 2:].prod(axis=1)[None, :] - both)
    first, ends = folds.box_edges(a, b, 0.5, cells=200)
    assert [sorted(ends[x:y].tolist()) for x, y in zip(first[:-1], first[1:], strict=True)] == [np.flatnonzero(w).tolist() for w in want]


def test_boxes_are_matched_without_their_pairs():
    r = np.random.default_rng(11)
    boxes = lambda n: r.random((n, 4)) * [0.5, 0.5, 0.3, 0.3] + [0, 0, 0.1, 0.1]
    cases = [(boxes(n), boxes(m)) for n, m in ((0, 5), (5, 0), (1, 1), (60, 50), (150, 170), (300, 300))]
    # few different boxes, many of each; some of no size, some not finite
    cases += [(boxes(12)[r.integers(0, 12, 200)], boxes(12)[r.integers(0, 12, 190)]) for _ in range(6)]
    some = boxes(40)
    cases += [(some + [0, 0, 0, 0], some[::-1] + [0.02, 0, 0, 0]), (np.concatenate([some, some * [1, 1, 0, 0]]), some * [1, 1, 0, 1])]
    for a, b in cases:
        want = folds.largest_matching(*folds.box_edges(a, b, 0.5), len(b))
        assert folds.BoxMatching(a, b, 0.5, cells=500).size() == want
    a, b = cases[4]
    odd = np.array([[math.nan, 0, 1, 1], [0, 0, math.inf, 1]])
    assert folds.BoxMatching(np.concatenate([a, odd]), np.concatenate([b, odd]), 0.5).size() == folds.largest_matching(*folds.box_edges(a, b, 0.5), len(b))


def test_a_frame_of_many_pairs_takes_no_memory_for_them():
    import tracemalloc

    # 9,000 by 9,000 boxes that nearly all meet: over 40 million pairs, 160 MB of edges
    r = np.random.default_rng(12)
    a, b = (np.concatenate([r.random((9_000, 2)) * 0.1, 1 + r.random((9_000, 2)) * 0.1], axis=1) for _ in range(2))
    tracemalloc.start()
    assert folds.BoxMatching(a, b, 0.5).size() == 9_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20, most


def test_trajectory_equals_the_best_of_all_paths(spark):
    r = np.random.default_rng(4)
    rows = [(1, w, s, round(float(u), 2)) for w in range(5) for s, u in zip("ABC", r.random(3)) if r.random() < 0.8 or s == "A"]
    options = {w: {s: u for _, w2, s, u in rows if w2 == w} for w in range(5)}
    paths = [[]]
    for w in range(5):
        paths = [[*p, s] for p in paths for s in options[w]]
    total = lambda p: sum(options[w][s] for w, s in enumerate(p)) + sum(0.28 if a == b else -0.36 for a, b in zip(p[:-1], p[1:]))
    got = folds.trajectory_states(spark.createDataFrame(rows, "source_id long, window_no long, state string, utility double")).orderBy("window_no").collect()
    assert abs(total([x.state for x in got]) - max(map(total, paths))) < 1e-9


def test_sentences_of_a_text_without_ends_take_one_pass(spark):
    """A run of 400,000 letters that nothing ends: tried from each of its places, it would take minutes."""
    import time

    from timeweave.operators import evidence

    df = spark.createDataFrame([(1, "First. " + "word " * 80_000 + "\nLast one! no end")], "doc_id long, text string")
    start = time.time()
    assert [r.sentence for r in evidence.sentences(df, "doc_id").orderBy("rank").collect()] == ["First.", "Last one!"]
    assert time.time() - start < 20
