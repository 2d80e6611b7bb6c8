"""Golden cases for folds, streams and files."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from timeweave.functions import numbers, text
from timeweave.operators import clean, folds, identity, intervals, rank
from timeweave.sources import io
from timeweave.streaming import streams

S = 1_000_000


def words(spark, rows):
    return spark.createDataFrame([(1, f"w{i:02}", w, int(a * S), int(b * S), sp, "seg") for i, (w, a, b, sp) in enumerate(rows)], "source_id long, word_id string, word string, start_us long, end_us long, speaker string, segment_id string")


def test_regroup_words_breaks_on_pause_length_and_sentence(spark):
    w = words(spark, [("a", 0, 1, "x"), ("b.", 1, 2, "x"), ("c", 2, 3, "x"), ("d", 4, 5, "x"), ("e", 5, 9, "x"), ("f", 9, 20, "x")])
    got = [(r.text, r.n) for r in folds.regroup_words(w).orderBy("group_no").collect()]
    assert got == [("a b.", 2), ("c", 1), ("d e", 2), ("f", 1)]


def test_caption_groups_break_on_speaker_and_caps(spark):
    w = words(spark, [("one", 0, 0.3, "x"), ("two", 0.3, 0.6, "x"), ("three", 0.6, 0.9, "y"), ("x" * 36, 0.9, 1.2, "y"), ("z", 1.2, 1.2, "y"), ("end", 1.2, 1.5, "y")])
    assert [r.text for r in folds.caption_groups(w).orderBy("group_no").collect()] == ["one two", "three", "x" * 36, "end"]


def test_review_regions_two_rules_for_the_end(spark):
    w = spark.createDataFrame([(1, 5 * S, 20 * S), (1, 6 * S, 7 * S), (1, 60 * S, 61 * S)], "source_id long, start_us long, end_us long")
    d = spark.createDataFrame([(1, 62 * S)], "source_id long, duration_us long")
    got = lambda keep: [(r.start_us // S, r.end_us // S) for r in folds.review_regions(w, d, keep_longest=keep).orderBy("start_us").collect()]
    assert got(False) == [(3, 9), (58, 62)] and got(True) == [(3, 22), (58, 62)]


def test_dedup_groups_need_all_members_alike(spark):
    c = spark.createDataFrame([(1, 10, 0, 9), (1, 11, 1, 9), (1, 12, 2, 9)], "source_id long, moment_id long, start_us long, end_us long")
    p = spark.createDataFrame([(1, 10, 11), (1, 11, 12)], "source_id long, a long, b long")
    got = {r.moment_id: r.group_id for r in rank.greedy_groups(p, c).collect()}
    assert got == {10: 10, 11: 10, 12: 12}  # a bridge without its ends alike makes two groups


def test_shortlist_novelty_only_breaks_near_ties(spark):
    c = spark.createDataFrame([(1, 1, 0, 0.9, "t", "f"), (1, 2, 1, 0.89, "t", "f"), (1, 3, 2, 0.85, "u", "g"), (1, 4, 3, 0.6, "v", "h"), (1, 5, 4, 0.4, "w", "i")], "source_id long, moment_id long, start_us long, score double, topic string, format string")
    got = [r.moment_id for r in rank.diverse_shortlist(c).orderBy("rank").collect()]
    assert got == [1, 3, 2, 4]


def test_budgeted_windows(spark):
    o = spark.createDataFrame([(1, 1, "a", 0, 10), (1, 2, "a", 5, 12), (1, 3, "b", 20, 40), (1, 4, "c", 50, 55)], "source_id long, id long, priority string, start_us long, end_us long")
    got = {r.id: r.state for r in folds.budgeted_windows(o, most=2, budget_us=25).collect()}
    assert got == {1: "taken", 2: "overlaps", 3: "time_budget", 4: "taken"}


def test_trajectory_prefers_staying(spark):
    o = [(1, k, s, u) for k, us in enumerate([(0.5, 0.4), (0.3, 0.5), (0.6, 0.1)]) for s, u in zip("AB", us)]
    df = spark.createDataFrame(o, "source_id long, window_no long, state string, utility double")
    assert [r.state for r in folds.trajectory_states(df).orderBy("window_no").collect()] == ["A", "A", "A"]
    assert [r.state for r in folds.trajectory_states(df, 0.0, 0.0, 0.0).orderBy("window_no").collect()] == ["A", "B", "A"]


def test_boxes_are_matched_as_many_as_can_be(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 1, 0.4, 0.0, 1.0, 1.0), (1, 2, 0.0, 0.0, 1.0, 1.0)], "source_id long, frame_id long, x double, y double, w double, h double")
    p = spark.createDataFrame([(1, 1, 0.2, 0.0, 1.0, 1.0), (1, 1, -0.2, 0.0, 1.0, 1.0), (1, 3, 0.0, 0.0, 1.0, 1.0)], t.schema)
    got = {r.frame_id: (r.tp, r.fp, r.fn) for r in folds.match_boxes(t, p).collect()}
    assert got == {1: (2, 0, 0), 2: (0, 0, 1), 3: (0, 1, 0)}


def test_hypotheses_are_aligned_by_word_and_time(spark):
    a = words(spark, [("go", 0, 1, "x"), ("go", 1, 2, "x"), ("home", 2, 3, "x")])
    b = words(spark, [("Go", 1, 2, "x"), ("Home!", 2, 3, "x"), ("now", 3, 4, "x")])
    a, b = (x.withColumn("region_id", F.lit("r")) for x in (a, b))
    got = [(r.kind, r.a_id, r.b_id) for r in folds.hypothesis_diff(a, b).collect()]
    assert got == [("delete", "w00", None), ("equal", "w01", "w00"), ("equal", "w02", "w01"), ("insert", None, "w02")]
    assert folds.hypothesis_diff(a, b, most=2).first().kind == "abstained"


def test_questions_and_answers(spark):
    rows = [("q1", 0, 5, "host", True), ("a1", 5, 9, "guest", False), ("i", 9, 10, "host", False), ("a2", 10, 20, "guest", False), ("q2", 20, 22, "host", True), ("q3", 60, 61, "host", True)]
    s = spark.createDataFrame([(1, i, a * S, b * S, sp, q) for i, a, b, sp, q in rows], "source_id long, segment_id string, start_us long, end_us long, speaker string, is_question boolean")
    got = {r.question_id: (r.answer_ids, r.stop) for r in folds.pair_questions(s).collect()}
    assert got == {"q1": (["a1", "a2"], "next_question"), "q2": ([], "unanswered_pause"), "q3": ([], "unanswered_end")}


def test_decisions_log(spark):
    c = spark.createDataFrame([(1, k, k * 10, k * 10 + 9) for k in range(5)], "source_id long, moment_id long, start_us long, end_us long")
    log = [(1, 1, "approve", [0], None, None), (1, 2, "approve", [1], None, None), (1, 3, "merge", [1, 2], None, None), (1, 4, "commercial", [0], None, None), (1, 5, "approve", [0], None, None), (1, 6, "shrink", [3], 31, 35), (1, 7, "shrink", [4], 0, 45), (1, 8, "approve", [77], None, None)]
    d = spark.createDataFrame(log, "source_id long, seq long, action string, candidate_ids array<long>, start_us long, end_us long")
    assert [(r.seq, r.start_us, r.end_us) for r in folds.apply_decisions(d, c).orderBy("seq").collect()] == [(3, 10, 29), (6, 31, 35)]


def test_tracks_keep_excursions_and_split_at_gaps(spark):
    p = [(1, 1, t * S, 0.5 if t == 3 else 0.0, 0.0) for t in range(7)] + [(1, 1, 60 * S, 0.0, 0.0), (1, 1, 61 * S, 0.0, 0.0), (1, 1, 62 * S, 0.0, 0.0)]
    df = spark.createDataFrame(p, "source_id long, track_id long, time_us long, x double, y double")
    got = sorted(r.time_us // S for r in folds.simplify_tracks(df, 0.1, 10 * S).collect())
    assert {0, 3, 6, 60, 62} <= set(got) and 61 not in got


def test_reidentification_never_joins_simultaneous_tracks(spark):
    rows = [(1, 1, 0, 10, [1.0, 0.0]), (1, 2, 20, 30, [1.0, 0.01]), (1, 3, 25, 35, [1.0, 0.0]), (1, 4, 50, 60, [0.0, 1.0])]
    t = spark.createDataFrame(rows, "source_id long, track_id long, start_us long, end_us long, unit array<double>")
    got = {r.track_id: (r.person_no, r.why) for r in folds.reid_cluster(t).collect()}
    assert got[1] == (0, "seed") and got[2] == (0, "merged") and got[3] == (1, "seed") and got[4][0] == 2


def test_results_do_not_depend_on_partitions(spark):
    w = words(spark, [(f"w{i}", i * 0.5, i * 0.5 + 0.4, "xy"[i // 7 % 2]) for i in range(60)])
    for f in (folds.regroup_words, folds.caption_groups, intervals.speaker_islands, clean.word_issues):
        frame = (lambda x: x.withColumn("confidence", F.lit(0.5))) if f is clean.word_issues else (lambda x: x)
        assert sorted(map(str, f(frame(w)).collect())) == sorted(map(str, f(frame(w.repartition(7, "word_id"))).collect()))


def test_left_interval_join_keeps_rows_once(spark):
    a = spark.createDataFrame([(1, 1, 0, 3000 * S), (1, 2, 5, 5), (2, 3, 0, 10)], "source_id long, id long, start_us long, end_us long")
    b = spark.createDataFrame([(1, 1, 10 * S, 2000 * S), (1, 2, 2999 * S, 4000 * S)], a.schema)
    got = sorted((r.id, r.b_id or 0) for r in intervals.interval_join(a, b, "left").collect())
    assert got == [(1, 1), (1, 2), (2, 0), (3, 0)]


def test_templates_are_bounded_medians(spark):
    t = spark.createDataFrame([(1, k, [float(k), 1.0]) for k in range(100)], "person long, track_id long, unit array<double>")
    assert len(identity.templates(t, ["person"]).first().unit) == 2


def test_native_functions(spark):
    row = spark.range(1).select(numbers.stamp(F.lit(3_723_004_600)).alias("s"), numbers.mean_of(F.lit(1.0), F.lit(None).cast("double")).alias("m"), numbers.ratio(F.lit(1), F.lit(0)).alias("r"), text.fold(F.lit("ÀÉç")).alias("f"), text.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("j"), text.video_id(F.lit("https://youtu.be/abcdefghijk?t=1")).alias("v")).first()
    assert tuple(row) == ("01:02:03,005", 1.0, None, "aec", 0.5, "abcdefghijk")


@pytest.fixture
def progress(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("r", s, t0 + timedelta(seconds=10 * k * (1 + (s == "b"))), float(k), 20.0, "running") for s in "ab" for k in range(15)]
    df = spark.createDataFrame(rows, streams.PROGRESS)
    df.write.json(f"{tmp_path}/in")
    return df, f"{tmp_path}/in"


def test_progress_stream_equals_its_batch_twin(spark, progress, tmp_path):
    df, path = progress
    q = streams.progress_latest(streams.progress_stream(spark, path)).writeStream.outputMode("update").format("memory").queryName("tw_progress").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.stage, r.current, round(r.eta_seconds, 6)) for r in spark.table("tw_progress").collect())
    want = sorted((r.stage, r.current, round(r.eta_seconds, 6)) for r in streams.progress_latest_batch(df).collect())
    assert got == want == [("a", 14.0, 60.0), ("b", 14.0, 120.0)]


def test_levels_stream_equals_batch(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1) + timedelta(seconds=k), float(k % 5)) for k in range(100)] + [(1, datetime(2024, 1, 2), 0.0)]
    spark.createDataFrame(rows, "source_id long, ts timestamp, value double").write.json(f"{tmp_path}/levels")
    s = spark.readStream.schema("source_id long, ts timestamp, value double").json(f"{tmp_path}/levels")
    q = streams.stream_levels(s).writeStream.outputMode("append").format("memory").queryName("tw_levels").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("tw_levels").where("start < '2024-01-02'").collect()
    assert len(got) == 10 and sum(r.n for r in got) == 100


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text('{"x": 1}\n{"x": 2}\nbroken\n')
    (tmp_path / "a" / "two.json").write_text('{"x": 3}\n')
    good, bad = io.read_jsonl(spark, f"{tmp_path}/a/one.json", "x long")
    assert [r.x for r in good.collect()] == [1, 2] and [r.line for r in bad.collect()] == ["broken"]
    import hashlib

    digest = hashlib.sha256((tmp_path / "a" / "two.json").read_bytes()).hexdigest()
    manifest = spark.createDataFrame([("one.json", "0" * 64), ("two.json", digest), ("three.json", digest)], io.MANIFEST)
    rows, wrong = io.read_collections(spark, f"{tmp_path}/a", manifest, "x long")
    assert [r.x for r in rows.collect()] == [3] and sorted((r.file, r.reason) for r in wrong.collect()) == [("one.json", "digest_differs"), ("three.json", "missing")]
    for folder, x in (("p", 1), ("q", 2)):
        (tmp_path / "b" / folder).mkdir(parents=True)
        (tmp_path / "b" / folder / "same.json").write_text(f'{{"x": {x}}}\n')
    held = io.digests(spark, f"{tmp_path}/b").collect()
    manifest = spark.createDataFrame([(r.path, r.sha256 if r.path.startswith("p") else "0" * 64) for r in held], io.MANIFEST)
    rows, wrong = io.read_collections(spark, f"{tmp_path}/b", manifest, "x long")
    assert [r.x for r in rows.collect()] == [1] and [(r.file, r.reason) for r in wrong.collect()] == [("q/same.json", "digest_differs")]
    io.write_chunked(spark.range(30).withColumn("v", F.col("id")), f"{tmp_path}/chunks", ["id"], 10)
    assert spark.read.json(f"{tmp_path}/chunks").count() == 30
    io.write_label_sheet(spark.createDataFrame([("i1", None), ("i2", "yes")], "item string, label string"), f"{tmp_path}/sheet")
    assert io.read_labels(spark, f"{tmp_path}/sheet", "item string, label string").where("label is null").count() == 1
    with pytest.raises(Exception):
        io.write_label_sheet(spark.range(1).selectExpr("cast(id as string) item"), f"{tmp_path}/sheet")


def test_left_join_keeps_rows_with_nulls_once(spark):
    a = spark.createDataFrame([(1, 0, 10, None), (1, 20, 30, "x"), (1, 40, 50, None), (1, 40, 50, None)], "source_id long, start_us long, end_us long, note string")
    b = spark.createDataFrame([(1, 5, 8)], "source_id long, start_us long, end_us long")
    got = sorted(((r.start_us, r.b_start_us) for r in intervals.interval_join(a, b, "left").collect()), key=lambda x: x[0])
    assert got == [(0, 5), (20, None), (40, None), (40, None)]


def test_impact_of_a_stage_over_many_paths(spark):
    from timeweave.operators import audit

    # 25 diamonds in a row: 2 ** 25 ways from the first stage to the last
    edges = [e for i in range(25) for e in ((f"a{i}", f"s{i}"), (f"b{i}", f"s{i}"), (f"s{i + 1}", f"a{i}"), (f"s{i + 1}", f"b{i}"))] + [("s3", "s9")]
    stages = spark.createDataFrame([("s0", "failed"), ("b24", "failed"), ("x", "ok")], "stage string, status string")
    got = {r.stage: r.causes for r in audit.stage_impact(stages, spark.createDataFrame(edges, "stage string, needs string")).collect()}
    assert len(got) == 76 and got["s25"] == "b24,s0" and got["s24"] == "s0"


def test_phrases_at_a_segments_end(spark):
    s = spark.createDataFrame([(1, "a", ["of", "the"]), (1, "b", ["out", "of", "of", "the"]), (1, "c", ["the"])], "source_id long, segment_id string, tokens array<string>")
    p = spark.createDataFrame([(1, "p", ["of", "the"])], "source_id long, phrase_id string, phrase array<string>")
    assert sorted((r.segment_id, r.first_at) for r in clean.phrase_locate(p, s).collect()) == [("a", 1), ("b", 3)]


def test_commercial_cues_and_blocks(spark):
    from timeweave.operators import commercial

    t = lambda *rows: spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id long, text string")
    kinds = {r.id: (r.content_type, r.eligibility) for r in commercial.classify_content(t("compre agora na loja com desconto", "não compre agora com desconto", "o anúncio dizia: compre com desconto", "um carro azul", "", None, "oferecido por uma marca")).collect()}
    assert kinds == {0: ("advertisement", "excluded"), 1: ("editorial_content", "eligible"), 2: ("advertisement", "review"), 3: ("editorial_product_discussion", "eligible"), 4: ("uncertain", "review"), 5: ("uncertain", "review"), 6: ("sponsor_read", "excluded")}
    hits = {(r.signal, r.start_char, r.end_char, r.hit) for r in commercial.cue_hits(t("Olá: Promoção! só hoje, 10 mil pés"), ["id"]).collect()}
    assert ("discount", 5, 13, "Promoção") in hits and ("urgency", 15, 22, "só hoje") in hits and not [h for h in hits if h[0] == "price"]
    rows = [(1, "a", 0, 4, "o sofá por apenas 300 reais na loja", "A"), (1, "b", 5, 9, "parcelas em 10 vezes, aproveite", "A"), (1, "c", 30, 34, "fim de papo", "A"), (2, "a", 0, 4, "por apenas 300 reais na loja", "A"), (2, "b", 5, 9, "parcelas em 10 vezes", "B"), (3, "a", 0, 4, "por apenas 300 reais na loja", "A"), (3, "b", 9, 12, "parcelas em 10 vezes", "A")]
    s = spark.createDataFrame([(a, b, x * 1_000_000, y * 1_000_000, z, w) for a, b, x, y, z, w in rows], "source_id long, segment_id string, start_us long, end_us long, text string, speaker string")
    got = {r.source_id: (r.segment_ids, r.state) for r in commercial.commercial_blocks(s).collect()}
    # one voice: excluded; two voices: to review; too far apart: no block
    assert got == {1: ("a,b", "excluded"), 2: ("a,b", "review")}


def test_story_and_humour(spark):
    from timeweave.operators import story

    rows = [("a", 0, 8, "um dia eu fui ao estúdio da banda"), ("b", 9, 17, "mas tive um problema com a banda"), ("c", 18, 26, "a banda ensaiou de novo"), ("d", 27, 35, "no fim deu certo o disco da banda.")]
    s = spark.createDataFrame([(1, "t", i, a * 1_000_000, b * 1_000_000, "A", x) for i, a, b, x in rows], "source_id long, topic_id string, segment_id string, start_us long, end_us long, speaker string, text string")
    qas = spark.createDataFrame([], "source_id long, question_start_us long, answer_end_us long, answer_segment_id string")
    r = story.story_arcs(s, qas).first()
    assert (r.kind, r.setup_id, r.conflict_id, r.payoff_id, r.middle_ids, r.score) == ("complete_story", "a", "b", "d", "b,c", 0.95)
    assert story.story_arcs(s.withColumn("speaker", F.when(F.col("segment_id") == "d", "B").otherwise("A")), qas).first().kind == "partial_story"
    clips = spark.createDataFrame([(1, "k", 0, 10_000_000, True)], "source_id long, clip_id string, start_us long, end_us long, hinted boolean")
    t = spark.createDataFrame([(1, "x", 0, 5_000_000, "até que ele caiu da cadeira azul"), (1, "y", 12_000_000, 14_000_000, "[risos]")], "source_id long, segment_id string, start_us long, end_us long, text string")
    h = story.humor_integrity(clips, t).first()
    assert (h.status, h.classification, h.blockers) == ("incomplete", "punchline_candidate", "reaction_after_clip")
    b = story.humor_bounds(clips, t).first()
    # the silence before the laughter is longer than five seconds
    assert (b.proposed_start_us, b.proposed_end_us, b.unsafe) == (0, 10_000_000, True)
