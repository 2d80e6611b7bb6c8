"""Who speaks on screen: votes, reigns of frames, runs over bucket edges, and a moment of each state."""

from pyspark.sql import functions as F

from timeweave.operators import intervals
from timeweave.operators import speaking as op

S = 1_000_000
CAND = "source_id long, window_id string, speaker string, person_id string, start_us long, end_us long, overlap boolean, correlation double, lower_bound double, upper_bound double, lag_us long, sample_count int, track_stability double, visibility double, face_fraction double"


def turns(spark, rows):
    return spark.createDataFrame([(1, sp, int(a * S), int(b * S)) for sp, a, b in rows], "source_id long, speaker string, start_us long, end_us long")


def window(i, sp, person, a, b, score=0.9, **over):
    row = {"overlap": False, "lower": 0.5, "upper": 0.95, "lag": 0, "n": 20, "stable": None, "visible": None, "face": None} | over
    return (1, i, sp, person, int(a * S), int(b * S), row["overlap"], score, row["lower"], row["upper"], row["lag"], row["n"], row["stable"], row["visible"], row["face"])


def consensus(spark, cands, ts):
    return {r.speaker: r for r in op.speaker_consensus(spark.createDataFrame(cands, CAND), turns(spark, ts)).collect()}


def test_votes_and_vetoes(spark):
    ts = [("A", 0, 10), ("A", 20, 30), ("B", 40, 50), ("B", 60, 70), ("C", 80, 82), ("D", 100, 110), ("D", 120, 130)]
    got = consensus(spark, [
        window("a1", "A", "p", 0, 2), window("a2", "A", "p", 3, 6), window("a2", "A", "p", 3, 6), window("a3", "A", "q", 20, 21, -0.9, lower=None, upper=-0.1),
        window("b1", "B", "p", 40, 42), window("b2", "B", "q", 60, 62, 0.95), window("b3", "B", "p", 44, 46, 0.9, lower=-0.1),
        window("c1", "C", "q", 80, 82), window("d1", "D", "r", 100, 102), window("d2", "D", "r", 120, 122), window("d3", "D", "r", 104, 106, -0.9, lower=None, upper=-0.5), window("d4", "D", "r", 124, 126, -0.8, lower=None, upper=None),
    ], ts)
    a = got["A"]
    assert (a.person_id, a.n_for, a.n_against, a.reason, a.confidence) == ("p", 2, 0, None, 0.9) and abs(a.weight - 4.5) < 1e-9
    assert (got["B"].person_id, got["B"].reason) == (None, "ambiguous_global_affinity")
    assert (got["C"].person_id, got["C"].n_for, got["C"].reason) == (None, 1, "insufficient_independent_evidence")
    assert (got["D"].person_id, got["D"].n_for, got["D"].n_against) == (None, 2, 2)


def test_mixed_windows_and_two_voices_of_one_person(spark):
    ts = [("A", 0, 10), ("B", 9, 20)]
    both = [window(f"a{k}", "A", "p", k, k + 1) for k in (0, 2, 8.5)] + [window(f"b{k}", "B", "p", k, k + 1) for k in (11, 13)]
    got = consensus(spark, both, ts)
    assert {r.reason for r in got.values()} == {"simultaneous_speaker_person_conflict"} and got["A"].n_for == 2  # a8.5 meets B
    assert consensus(spark, both, [("A", 0, 9), ("B", 9, 20)])["A"].person_id == "p"
    assert op.speaker_consensus(spark.createDataFrame([], CAND), turns(spark, [])).count() == 0


def test_reigns_of_frames(spark):
    frames = spark.createDataFrame([(1, int(t * S)) for t in (1.0, 1.4, 5.0, 5.0, 599.9, 600.3)] + [(1, None)], "source_id long, time_us long")
    seen = spark.createDataFrame([(1, S, "p", True), (1, S, "q", False)], "source_id long, time_us long, person_id string, face_visible boolean")
    scenes = spark.createDataFrame([(1, "x", 0, int(5.2 * S)), (1, "y", int(5.2 * S), 900 * S)], "source_id long, scene_id string, start_us long, end_us long")
    got = {r.time_us / S: r for r in op.frame_reigns(frames, seen, scenes).collect()}
    assert {t: (r.start_us / S, r.end_us / S, r.scene_id) for t, r in got.items()} == {1.0: (0.4, 1.2, "x"), 1.4: (1.2, 2.0, "x"), 5.0: (4.4, 5.2, "x"), 599.9: (599.3, 600.1, "y"), 600.3: (600.1, 600.9, "y")}
    assert (sorted(got[1.0].people), got[1.0].faces, got[5.0].people) == (["p", "q"], ["p"], [])


def test_runs_join_over_bucket_edges(spark):
    cells = spark.createDataFrame([(1, a, b, v) for a, b, v in [(0, 5, "x"), (5, 10, "x"), (10, 20, "x"), (20, 24, "x"), (24, 30, None), (30, 33, None), (34, 40, None), (40, 50, "x")]], "source_id long, start_us long, end_us long, v string")
    got = sorted((r.start_us, r.end_us, r.v) for r in intervals.coalesce_runs(cells, ["source_id"], ["v"], 10).collect())
    assert got == [(0, 24, "x"), (24, 33, None), (34, 40, None), (40, 50, "x")]


def test_moments_of_each_state(spark):
    ts = turns(spark, [("A", 0, 4), ("B", 3, 6), ("A", 10, 12), ("A", 20, 22), ("A", 30, 31), ("B", 40, 41)])
    frames = spark.createDataFrame([(1, int(t * S)) for t in (1.0, 3.5, 10.5, 20.5, 40.5)], "source_id long, time_us long")
    seen = spark.createDataFrame([(1, S, "p", True), (1, int(3.5 * S), "p", True), (1, int(10.5 * S), "q", True), (1, int(20.5 * S), "p", True), (1, int(40.5 * S), "q", True)], "source_id long, time_us long, person_id string, face_visible boolean")
    scenes = spark.createDataFrame([(1, "x", 0, 100 * S)], "source_id long, scene_id string, start_us long, end_us long")
    cands = spark.createDataFrame([window("w1", "A", "p", 0, 2), window("w2", "A", "p", 30, 31)], CAND)
    manual = spark.createDataFrame([(1, "B", "q", 40 * S, 41 * S)], "source_id long, speaker string, person_id string, start_us long, end_us long")
    known = spark.createDataFrame([(1, "A", "p", 0.9, None), (1, "B", None, None, "insufficient_independent_evidence")], "source_id long, speaker string, person_id string, confidence double, reason string")
    lags = spark.createDataFrame([(1, "A", True)], "source_id long, speaker string, consistent boolean")
    cells = op.active_speaker(ts, frames, seen, scenes, cands, manual, known, lags)
    rows = cells.collect()
    at = lambda sp, t: next(r for r in rows if r.speaker == sp and r.start_us <= t * S < r.end_us)
    state = lambda r: (r.state, r.active_state, r.person_id, r.active_person, r.reason)
    assert state(at("A", 1)) == ("KNOWN_PERSON", "CONFIRMED", "p", "p", "contemporary_mouth_audio_and_temporal_consensus")
    assert state(at("A", 3.5)) == ("MULTIPLE_SPEAKERS", "UNCERTAIN", "p", None, "simultaneous_audio_ambiguous")
    assert state(at("A", 10.5)) == ("OFFSCREEN_SPEAKER", "OFFSCREEN", None, None, "mapped_person_offscreen")
    assert state(at("A", 20.5)) == ("KNOWN_PERSON", "PROBABLE", "p", None, "no_contemporary_bounded_mouth_audio_evidence")
    assert state(at("A", 30.5)) == ("INSUFFICIENT_EVIDENCE", "UNCERTAIN", None, None, "mapped_person_not_visually_available")
    assert state(at("B", 40.5)) == ("KNOWN_PERSON", "CONFIRMED", "q", "q", "user_verified")
    assert state(at("B", 5)) == ("INSUFFICIENT_EVIDENCE", "UNCERTAIN", None, None, "insufficient_consensus")
    runs = op.active_speaker_intervals(cells)
    length = lambda df: df.agg(F.sum(F.col("end_us") - F.col("start_us"))).first()[0]
    assert length(runs) == length(cells) == 13 * S and runs.count() < len(rows)
    (m,) = op.active_speaker_metrics(cells, ts).collect()
    assert m.speech_us == 12 * S and abs(m.known_share + m.unknown_share - 1) < 0.2 and m.ambiguous_us == S and m.age_p50_us <= op.GAP_US


def test_cells_of_speech_hold_no_steps_of_silence(spark):
    """One turn of two seconds in a bucket of ten minutes, and one over a bucket's edge: only steps of speech are made, and cells end where they did."""
    rows = spark.createDataFrame([(1, "a", 250_000, 2_250_000), (1, "b", 1_000_000, 1_000_000 + 200), (2, "a", 599_900_000, 600_600_000), (3, "a", 100, 200)], "source_id long, speaker string, start_us long, end_us long")
    frames = spark.createDataFrame([(1, 300_000, 300_000_000)], "source_id long, start_us long, end_us long")
    cells = op.speech_cells(rows, frames)
    got = sorted((x.source_id, x.start_us, x.end_us, ",".join(x.speakers)) for x in cells.collect())
    a = [(1, 250_000, 300_000, "a"), (1, 300_000, 500_000, "a"), (1, 500_000, 1_000_000, "a"), (1, 1_000_000, 1_000_200, "a,b"), (1, 1_000_200, 1_500_000, "a"), (1, 1_500_000, 2_000_000, "a"), (1, 2_000_000, 2_250_000, "a")]
    assert got == [*a, (2, 599_900_000, 600_000_000, "a"), (2, 600_000_000, 600_500_000, "a"), (2, 600_500_000, 600_600_000, "a"), (3, 100, 200, "a")]
    # a bucket as long as 63 years would have two thousand million steps
    wide = op.speech_cells(rows, frames, width=10**15)
    assert sorted((x.source_id, x.start_us, x.end_us) for x in wide.where("source_id <> 2").collect()) == [x[:3] for x in a] + [(3, 100, 200)]
