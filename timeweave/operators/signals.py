"""Audio and video evidence for who speaks, outcomes of re-identification, and bindings of a transcript's hypotheses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import independent_windows

# What a candidate of a window must reach, and what it is told if it doesn't.
GATES = (
    ("correlation", 0.55, "CORRELATION_BELOW_MINIMUM", None),
    ("sample_count", 8, "INSUFFICIENT_MOUTH_SAMPLES", None),
    ("track_stability", 0.5, "UNSTABLE_TRACK", 1.0),
    ("visibility", 0.6, "INSUFFICIENT_VISUAL_COVERAGE", 1.0),
    ("face_fraction", 0.6, "INSUFFICIENT_FACE_OBSERVATION", 1.0),
)
MAX_LAG_US, MIN_MARGIN = 120_000, 0.1


def screened(candidates: DataFrame) -> DataFrame:
    """Adds reasons (why a candidate's signal does not count) and qualified: none, no overlap of voices, and enough above the best other candidate of its window.

    candidates: source_id, window_id, person_id, overlap, correlation, lower_bound, lag_us, and the columns of GATES; null is not measured.
    """
    below = [F.when(F.coalesce(F.col(c), F.lit(otherwise).cast("double")).isNull() | (F.coalesce(F.col(c), F.lit(otherwise).cast("double")) < least), why) for c, least, why, otherwise in GATES]
    lag = [F.when(F.coalesce("lower_bound", F.lit(0.0)) <= 0, "NO_BOUNDED_POSITIVE_SYNC"), F.when(F.col("lag_us").isNull(), "LAG_NOT_MEASURED").when(F.abs("lag_us") > MAX_LAG_US, "SYNC_OFFSET_OUTSIDE_BOUND")]
    w = Window.partitionBy("source_id", "window_id")
    order = w.orderBy(F.col("correlation").desc_nulls_last(), "person_id")
    first, second = F.first("correlation").over(order), F.max(F.when(F.col("place") == 2, F.col("correlation"))).over(w)
    c = candidates.withColumn("reasons", F.array_compact(F.array(*below, *lag))).withColumn("place", F.row_number().over(order)).withColumn("best", first).withColumn("next", second)
    rival = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("best"))
    clear = rival.isNull() | (F.round(F.col("correlation") - rival, 6) >= MIN_MARGIN)
    return c.withColumn("qualified", F.coalesce((F.size("reasons") == 0) & ~F.col("overlap") & clear, F.lit(False))).drop("place", "best", "next")


def window_screen(windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, window_id, status, n_candidates, n_qualified: why a window gave a signal or none. windows: verified, overlap, too_short, few_samples, no_sync (booleans)."""
    per = screened(candidates).groupBy("source_id", "window_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("qualified").alias("n_qualified"))
    j = windows.join(per, ["source_id", "window_id"], "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0))).withColumn("n_qualified", F.coalesce("n_qualified", F.lit(0)))
    rules = [(F.col("verified"), "user_verified"), (F.col("overlap"), "audio_overlap"), (F.col("n_qualified") > 0, "qualified_local_signal_pending_independent_consensus"), (F.col("n_candidates") > 0, "measured_signal_below_acceptance_gates"), (F.col("too_short"), "audio_window_too_short"), (F.col("few_samples"), "insufficient_mouth_samples"), (F.col("no_sync"), "measured_without_reliable_sync")]
    return j.select("source_id", "window_id", reduce(lambda c, r: c.when(*r), rules, F).otherwise("mouth_signal_unavailable").alias("status"), "n_candidates", "n_qualified")


def lag_consistency(candidates: DataFrame, mapping: DataFrame, least_us: int = 500_000, least: int = 2, deviation_us: int = 100_000) -> DataFrame:
    """Of each speaker's qualified windows with the person mapped to them, those that don't overlap: how many, their median lag, the largest distance from it, and whether they agree. candidates also have speaker, start_us, end_us."""
    own = screened(candidates).where("qualified").join(mapping.select("source_id", "speaker", "person_id"), ["source_id", "speaker", "person_id"]).where(F.col("end_us") - F.col("start_us") >= least_us)
    alone = independent_windows(own.select("source_id", "speaker", F.col("window_id").alias("id"), "start_us", "end_us"), least_us, ("source_id", "speaker"))
    kept = alone.select("source_id", "speaker", F.col("id").alias("window_id")).join(own, ["source_id", "speaker", "window_id"])
    middle = kept.groupBy("source_id", "speaker").agg(F.median("lag_us").alias("median_lag_us"))
    g = kept.join(middle, ["source_id", "speaker"]).groupBy("source_id", "speaker", "median_lag_us").agg(F.count(F.lit(1)).alias("windows"), F.max(F.abs(F.col("lag_us") - F.col("median_lag_us"))).alias("spread_us"), F.max(F.abs("lag_us")).alias("largest"))
    j = mapping.select("source_id", "speaker").distinct().join(g, ["source_id", "speaker"], "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    ok = (F.col("windows") >= least) & (F.col("largest") <= MAX_LAG_US) & (F.col("spread_us") <= deviation_us)
    return j.select("source_id", "speaker", "windows", "median_lag_us", "spread_us", F.when(F.col("windows") == 0, "not_measured").when(F.col("windows") < least, "insufficient_samples").otherwise("measured").alias("status"), F.coalesce(ok, F.lit(False)).alias("consistent"))


def reid_outcomes(tracks: DataFrame, decisions: DataFrame, base: float = 0.55) -> DataFrame:
    """track_id, outcome (merged, seed, unmapped) and gates: of a track that no decision merged, what its best candidate failed by.

    tracks: track_id, person_id. decisions: track_id, accepted, candidate_id, similarity, threshold, margin, required_margin, cluster_min, conflict.
    """
    merged = decisions.groupBy("track_id").agg(F.bool_or("accepted").alias("merged"))
    best = decisions.where("candidate_id is not null").groupBy("track_id").agg(F.min_by(F.struct("similarity", "threshold", "margin", "required_margin", "cluster_min", "conflict"), F.struct(-F.col("similarity"), "candidate_id")).alias("b"))
    j = tracks.join(merged, "track_id", "left").join(best, "track_id", "left").withColumn("merged", F.coalesce("merged", F.lit(False)))
    fails = [F.when(F.col("b.similarity") < F.col("b.threshold"), "score_below_threshold"), F.when(F.col("b.margin") < F.col("b.required_margin"), "margin_below_required"), F.when(F.col("b.cluster_min") < base, "cluster_inconsistency"), F.when(F.col("b.conflict"), "temporal_conflict")]
    gates = F.when(~F.col("merged") & F.col("b").isNotNull(), F.array_compact(F.array(*fails))).otherwise(F.array().cast("array<string>"))
    return j.select("track_id", F.when(F.col("merged"), "merged").when(F.col("person_id").isNotNull(), "seed").otherwise("unmapped").alias("outcome"), gates.alias("gates"))


def dossier_audit(hypotheses: DataFrame, words: DataFrame, segments: DataFrame, quotes: DataFrame) -> DataFrame:
    """source_id, code, n: references of hypotheses that don't resolve, words and segments that name another hypothesis, quoted words that differ from the canonical ones.

    hypotheses: source_id, hypothesis_id, word_ids, segment_ids. words: word_id, word, start_us, end_us, hypothesis_id. segments: segment_id, hypothesis_ids. quotes: source_id, word_id, word, start_us, end_us.
    """
    w = hypotheses.select("source_id", "hypothesis_id", F.explode("word_ids").alias("word_id")).join(words.select("source_id", "word_id", F.col("hypothesis_id").alias("named"), F.lit(True).alias("known")), ["source_id", "word_id"], "left")
    s = hypotheses.select("source_id", "hypothesis_id", F.explode("segment_ids").alias("segment_id")).join(segments.select("source_id", "segment_id", "hypothesis_ids", F.lit(True).alias("known")), ["source_id", "segment_id"], "left")
    q = quotes.select("source_id", "word_id", F.struct("word", "start_us", "end_us").alias("said")).join(words.select("source_id", "word_id", F.struct("word", "start_us", "end_us").alias("canonical")), ["source_id", "word_id"], "left")
    code = lambda df, c, name: df.where(c).select("source_id", F.lit(name).alias("code"))
    lost = F.col("known").isNull()
    found = [
        code(w, lost, "hypothesis_reference_unresolved"), code(s, lost, "hypothesis_reference_unresolved"), code(w, ~lost & ~F.col("named").eqNullSafe(F.col("hypothesis_id")), "hypothesis_word_binding_disagreement"),
        code(s, ~lost & ~F.coalesce(F.array_contains("hypothesis_ids", F.col("hypothesis_id")), F.lit(False)), "hypothesis_segment_binding_disagreement"), code(q, ~F.col("said").eqNullSafe(F.col("canonical")), "source_review_original_word_disagreement"),
    ]
    return reduce(DataFrame.unionByName, found).groupBy("source_id", "code").agg(F.count(F.lit(1)).alias("n"))
