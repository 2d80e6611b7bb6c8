"""Who speaks on screen: which person each voice belongs to over all windows of evidence, and what every moment of speech then shows.

A voice's person is a matter of many independent windows; that the person speaks just now needs evidence of just now. So a mapped
and visible face alone is probable, and what can't be told keeps its reason. Nothing is gathered by source: speech is
cut into cells inside time buckets, frames hold for a bounded time, and runs of equal state are joined over the edges of buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BUCKET_US, SECOND, coalesce_runs, independent_windows, interval_join, stab_join, union_duration
from .lineage import cut
from .signals import screened

# What windows must reach to vote, and what a voice's person must reach.
LEAST_WINDOW_US, UP, DOWN, WINDOWS, SHARE, SURE = 500_000, 0.55, -0.2, 2, 0.67, 0.7
GAP_US, STEP_US = 600_000, 500_000


def _unit(c: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(1.0))))


def pair_votes(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """source_id, speaker, person_id, n_windows, n_for, n_against, n_weak, weight, support_us, mean of each pair that has independent windows.

    candidates: source_id, window_id, speaker, person_id, start_us, end_us, overlap, correlation, lower_bound, upper_bound, track_stability, visibility, face_fraction.
    Windows in which another voice speaks don't count; doubtful bounds don't count for; against counts only if the upper bound is negative or not known.
    """
    c = candidates.where("source_id is not null and speaker is not null and person_id is not null and correlation is not null and not coalesce(overlap, false)")
    c = c.where(~((F.col("lower_bound") <= 0) & (F.col("correlation") >= 0)) | F.col("lower_bound").isNull())
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("correlation") * F.coalesce(F.col("track_stability").cast("double"), F.lit(1.0))))
    c = c.select("source_id", "window_id", "speaker", "person_id", "start_us", "end_us", F.round(score, 6).alias("score"), F.round(_unit("face_fraction") * _unit("visibility"), 6).alias("visual"), (F.col("upper_bound").isNull() | (F.col("upper_bound") < 0)).alias("denies"))
    # a pair has one row a window: of repeated ones the earliest
    one = ["source_id", "speaker", "person_id", "window_id"]
    c = c.groupBy(*one).agg(F.min(F.struct("start_us", "end_us", "score", "visual", "denies")).alias("x")).select(*one, "x.*")
    w = c.select("source_id", "window_id", "speaker", "start_us", "end_us").distinct()
    met = interval_join(w, turns.select("source_id", "speaker", "start_us", "end_us"))
    mixed = met.where(F.col("b_speaker") != F.col("speaker")).select("source_id", "window_id", "speaker").distinct()
    own = met.where(F.col("b_speaker") == F.col("speaker")).select("source_id", "window_id", "speaker", F.greatest("start_us", "b_start_us").alias("start_us"), F.least("end_us", "b_end_us").alias("end_us"))
    spoken = union_duration(own, ("source_id", "window_id", "speaker")).withColumnRenamed("union_us", "spoken_us")
    key = ["source_id", "speaker", "person_id"]
    clear = c.join(mixed, ["source_id", "window_id", "speaker"], "left_anti")
    taken = independent_windows(clear.select(*key, F.col("window_id").alias("id"), "start_us", "end_us"), LEAST_WINDOW_US, tuple(key))
    e = taken.select(*key, F.col("id").alias("window_id")).join(clear, [*key, "window_id"]).join(spoken, ["source_id", "window_id", "speaker"], "left").withColumn("s", F.coalesce("spoken_us", F.lit(0)))
    up, down = (F.col("score") >= UP) & (F.col("s") >= LEAST_WINDOW_US), F.col("score") <= DOWN
    against = down & F.col("denies")
    vote = F.when(up, F.col("s") / 1e6 * F.col("score") * F.col("visual")).when(against, F.col("s") / 1e6 * F.col("score")).otherwise(0.0)
    return e.groupBy(*key).agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(up).alias("n_for"), F.count_if(against).alias("n_against"), F.count_if(down & ~F.col("denies")).alias("n_weak"), F.round(F.greatest(F.lit(0.0), F.sum(vote)), 6).alias("weight"), F.coalesce(F.sum(F.when(up, F.col("s"))), F.lit(0)).alias("support_us"), F.round(F.avg(F.when(up, F.col("score"))), 6).alias("mean"))


def speaker_consensus(candidates: DataFrame, turns: DataFrame) -> DataFrame:
    """source_id, speaker, person_id, confidence, share, n_for, n_against, weight, reason of every voice that has turns; person_id is null where reason says why.

    The best pair is accepted with enough windows and share, more for than against, and if it is best alone. Voices that
    would be one person while both speak lose it.
    """
    votes = pair_votes(candidates, turns)
    w = Window.partitionBy("source_id", "speaker")
    order = w.orderBy(F.col("weight").desc(), "person_id")
    v = votes.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("weight").over(order)).withColumn("total", F.sum("weight").over(w)).withColumn("pairs", F.count(F.lit(1)).over(w))
    v = v.where("place = 1").withColumn("share", F.when(F.col("total") > 0, F.round(F.col("weight") / F.col("total"), 6)).otherwise(0.0))
    ok = (F.col("n_for") >= WINDOWS) & (F.col("share") >= SHARE) & (F.col("n_against") < F.col("n_for")) & (F.col("weight") > 0) & (F.col("next").isNull() | (F.col("weight") > F.col("next")))
    v = v.withColumn("ok", ok).withColumn("why", F.when(ok, F.lit(None)).when((F.col("pairs") > 1) & (F.col("share") < SHARE), "ambiguous_global_affinity").otherwise("insufficient_independent_evidence"))
    v = cut(v)
    said = turns.where("speaker is not null").select("source_id", "speaker", "start_us", "end_us").join(v.where("ok").select("source_id", "speaker", "person_id"), ["source_id", "speaker"])
    both = interval_join(said, said).where("person_id = b_person_id and speaker < b_speaker")
    clash = both.select("source_id", F.explode(F.array("speaker", "b_speaker")).alias("speaker")).distinct().withColumn("clash", F.lit(True))
    j = turns.where("speaker is not null").select("source_id", "speaker").distinct().join(v, ["source_id", "speaker"], "left").join(clash, ["source_id", "speaker"], "left")
    stays = F.coalesce(F.col("ok"), F.lit(False)) & F.col("clash").isNull()
    reason = F.when(F.col("clash"), "simultaneous_speaker_person_conflict").when(F.col("ok").isNull(), "insufficient_independent_evidence").otherwise(F.col("why"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("source_id", "speaker", F.when(stays, F.col("person_id")).alias("person_id"), F.when(stays, F.round(F.least(F.lit(1.0), F.col("share") * F.col("mean")), 6)).alias("confidence"), zero("share").cast("double").alias("share"), zero("n_for").cast("long").alias("n_for"), zero("n_against").cast("long").alias("n_against"), zero("weight").cast("double").alias("weight"), reason.alias("reason"))


def frame_reigns(frames: DataFrame, sightings: DataFrame, scenes: DataFrame, gap_us: int = GAP_US, width: int = BUCKET_US) -> DataFrame:
    """source_id, time_us, start_us, end_us, scene_id, people, faces: how long each frame is the nearest one: half way to its neighbours, gap_us at most, inside its scene.

    frames: source_id, time_us. sightings: source_id, time_us, person_id, face_visible. Frames outside all scenes have none to end at. Repeated frames are one.
    """
    f = frames.where("source_id is not null and time_us is not null").select("source_id", "time_us").distinct()
    # only neighbours within twice the gap shorten a reign: those at the end of one bucket go to the next one too, and the other way round
    b = F.floor(F.col("time_us") / width)
    near = F.array_distinct(F.array(b, F.floor((F.col("time_us") + 2 * gap_us) / width), F.floor((F.col("time_us") - 2 * gap_us) / width)))
    w = Window.partitionBy("source_id", "bucket").orderBy("time_us")
    f = f.withColumn("own", b).withColumn("bucket", F.explode(near)).withColumn("before", F.lag("time_us").over(w)).withColumn("after", F.lead("time_us").over(w)).where("own = bucket")
    half = lambda a, c: F.floor((F.col(a) + F.col(c)) / 2)
    f = f.select("source_id", "time_us", F.greatest(F.col("time_us") - gap_us, F.coalesce(half("before", "time_us"), F.col("time_us") - gap_us)).alias("start_us"), F.least(F.col("time_us") + gap_us, F.coalesce(half("time_us", "after"), F.col("time_us") + gap_us)).alias("end_us"))
    s = stab_join(f.select("source_id", "time_us"), scenes.select("source_id", "scene_id", "start_us", "end_us")).groupBy("source_id", "time_us").agg(F.min(F.struct("b_start_us", "b_end_us", "b_scene_id")).alias("s"))
    seen = sightings.where("person_id is not null").groupBy("source_id", "time_us").agg(F.collect_set("person_id").alias("people"), F.collect_set(F.when(F.col("face_visible"), F.col("person_id"))).alias("faces"))
    j = f.join(s, ["source_id", "time_us"], "left").join(seen, ["source_id", "time_us"], "left")
    none = F.array().cast("array<string>")
    return j.select("source_id", "time_us", F.greatest("start_us", F.coalesce("s.b_start_us", "start_us")).alias("start_us"), F.least("end_us", F.coalesce("s.b_end_us", "end_us")).alias("end_us"), F.col("s.b_scene_id").alias("scene_id"), F.coalesce("people", none).alias("people"), F.coalesce("faces", none).alias("faces")).where("end_us > start_us")


def speech_cells(turns: DataFrame, *others: DataFrame, step_us: int = STEP_US, width: int = BUCKET_US) -> DataFrame:
    """source_id, start_us, end_us, speakers: all speech cut at every boundary of turns and of the other interval tables, at steps, and at the edges of buckets."""
    t = turns.where("source_id is not null and speaker is not null and end_us > start_us").select("source_id", "speaker", "start_us", "end_us")
    per = t.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_us") / width), F.floor((F.col("end_us") - 1) / width))))
    used = per.select("source_id", "bucket").distinct()
    # steps count from the bucket's edge; only those inside speech begin a cell of it, the others would be no more than rows to hold
    edge = F.col("bucket") * width
    first = edge + F.ceil((F.greatest("start_us", edge) - edge) / step_us) * step_us
    last = F.least("end_us", edge + width) - 1
    steps = per.select("source_id", "bucket", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step_us)))).alias("t"))
    ends = reduce(DataFrame.unionByName, [x.select("source_id", F.explode(F.array("start_us", "end_us")).alias("t")) for x in (t, *others)])
    ends = ends.where("t is not null").withColumn("bucket", F.floor(F.col("t") / width)).join(used, ["source_id", "bucket"], "left_semi")
    # of equal points all but the last begin empty cells: sorting drops them, no table of all distinct points is held
    lead = F.lead("t").over(Window.partitionBy("source_id", "bucket").orderBy("t"))
    cells = steps.unionByName(ends).select("source_id", "bucket", F.col("t").alias("start_us"), F.coalesce(lead, (F.col("bucket") + 1) * width).alias("end_us")).where("end_us > start_us")
    alive = per.withColumnsRenamed({"source_id": "s", "bucket": "b", "start_us": "t0", "end_us": "t1"})
    j = cells.join(alive, (F.col("source_id") == F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("t0") <= F.col("start_us")) & (F.col("start_us") < F.col("t1")))
    return j.groupBy("source_id", "start_us", "end_us").agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))


def _at(cells: DataFrame, intervals: DataFrame, key: list[str], *aggs: Column) -> DataFrame:
    """Aggregates of the intervals that hold each cell's start, for cells that have any; key: the cell's columns, those both share are equal."""
    shared = [k for k in key if k in intervals.columns and k != "source_id" and k not in ("start_us", "end_us")]
    j = stab_join(cells.select(*key), intervals, "start_us")
    for k in shared:
        j = j.where(F.col(k) == F.col(f"b_{k}"))
    return j.groupBy(*key).agg(*aggs)


def active_speaker(turns: DataFrame, frames: DataFrame, sightings: DataFrame, scenes: DataFrame, candidates: DataFrame, manual: DataFrame, consensus: DataFrame, lags: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """A row for each voice of each cell of speech: source_id, start_us, end_us, speaker, overlap, person_id, active_person, confidence, method, state, active_state, visual_state, reason, unresolved, observed_us, age_us.

    candidates as for pair_votes and signals.screened (window_id, person_id, lag_us ...). manual: source_id, speaker, person_id, start_us, end_us, what a person has
    verified. consensus: speaker_consensus. lags: source_id, speaker, consistent.
    """
    reigns = cut(frame_reigns(frames, sightings, scenes, gap_us))
    # a window that another voice's turn enters is mixed, wherever the two overlap
    windows = candidates.select("source_id", "window_id", "speaker", "start_us", "end_us").distinct()
    mixed = interval_join(windows, turns.select("source_id", "speaker", "start_us", "end_us")).where(F.col("b_speaker") != F.col("speaker")).select("source_id", "window_id", F.lit(True).alias("mixed")).distinct()
    judged = candidates.join(mixed, ["source_id", "window_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False)) | F.coalesce("mixed", F.lit(False))).drop("mixed")
    local = cut(screened(judged).where("qualified").select("source_id", "speaker", "window_id", "start_us", "end_us", "person_id", "correlation", "lag_us"))
    cells = speech_cells(turns, windows, manual, reigns)
    known = sightings.where("person_id is not null").select(F.col("source_id").alias("known_in"), F.col("person_id").alias("known_id")).distinct()
    rows = cut(cells.select("source_id", "start_us", "end_us", F.size("speakers").alias("n"), F.explode("speakers").alias("speaker")))
    spot, voice = ["source_id", "start_us"], ["source_id", "start_us", "speaker"]
    frame = _at(cells, reigns, spot, F.min(F.struct("b_time_us", "b_people", "b_faces", "b_scene_id")).alias("frame"))
    told = _at(rows, manual.select("source_id", "speaker", "person_id", "start_us", "end_us"), voice, F.array_sort(F.collect_set("b_person_id")).alias("told"))
    heard = _at(rows, windows.select("source_id", "speaker", "start_us", "end_us"), voice, F.count(F.lit(1)).alias("heard"))
    m = consensus.select("source_id", "speaker", F.col("person_id").alias("prior"), F.col("confidence").alias("prior_confidence"), F.col("reason").alias("prior_reason"))
    j = rows.join(frame, spot, "left").join(told, voice, "left").join(heard, voice, "left").join(m, ["source_id", "speaker"], "left").join(lags.select("source_id", "speaker", "consistent"), ["source_id", "speaker"], "left")
    one, many = F.size("told") == 1, F.size("told") > 1
    j = j.withColumn("mapped", F.when(one, F.col("told")[0]).when(many, F.lit(None)).otherwise(F.col("prior"))).withColumn("prior_confidence", F.when(one, 1.0).when(many, F.lit(None)).otherwise(F.col("prior_confidence")))
    j = j.withColumn("method", F.when(one, "user_verified").when(many, "conflicting_manual_mapping").when(F.col("prior").isNotNull(), "consensus_continuity").otherwise("unresolved"))
    j = j.join(known, (F.col("source_id") == F.col("known_in")) & (F.col("mapped") == F.col("known_id")), "left").drop("known_in")
    valid = F.coalesce(F.array_contains("frame.b_faces", F.col("mapped")), F.lit(False))
    j = j.withColumn("valid", valid)
    conflict = F.when(many, "conflicting_manual_mapping").when(F.col("prior_reason") == "simultaneous_speaker_person_conflict", F.col("prior_reason"))
    # a person who is seen nowhere counts as no mapping, a mapped one who is not visible now as not available
    unresolved = F.when(F.col("known_id").isNull(), F.coalesce(conflict, F.lit("insufficient_consensus"))).when(~F.col("valid"), "mapped_person_not_visually_available")
    j = j.withColumn("unresolved", unresolved).withColumn("person_id", F.when(F.col("unresolved").isNull(), F.col("mapped")))
    j = cut(j)
    # the best qualified window of just now, and whether the face was there when the sound left the mouth
    need = j.where("person_id is not null and n = 1")
    best = _at(need.select(*voice, "person_id"), local, [*voice, "person_id"], F.max_by(F.struct("b_window_id", "b_lag_us"), F.struct("b_correlation", "b_window_id")).alias("best"))
    mouth = need.join(best.drop("person_id"), voice).select(*voice, "person_id", F.col("frame.b_scene_id").alias("scene"), (F.floor((F.col("start_us") + F.col("end_us")) / 2) - F.col("best.b_lag_us")).alias("time_us"))
    there = stab_join(mouth, reigns.drop("time_us")).where(F.col("scene").eqNullSafe(F.col("b_scene_id")) & F.array_contains("b_faces", F.col("person_id"))).select(*voice, F.lit(True).alias("there")).distinct()
    j = j.join(best.select(*voice, F.lit(True).alias("local")), voice, "left").join(there, voice, "left")
    verified, human, person = F.coalesce(F.col("there"), F.lit(False)), (F.col("method") == "user_verified") & F.col("valid") & F.col("person_id").isNotNull(), F.col("person_id").isNotNull()
    stable = F.coalesce(F.col("consistent"), F.lit(False))
    alone = F.col("n") == 1
    confirmed = F.coalesce(person & (human | (alone & verified & stable & (F.col("prior_confidence") >= SURE))), F.lit(False))
    framed = F.col("frame").isNotNull()
    off = framed & ((F.size("frame.b_people") == 0) | F.coalesce(F.col("unresolved") == "mapped_person_not_visually_available", F.lit(False)))
    state = F.when(~alone, "MULTIPLE_SPEAKERS").when(person, "KNOWN_PERSON").when(~framed, "INSUFFICIENT_EVIDENCE").when(off, "OFFSCREEN_SPEAKER").when(F.col("heard").isNotNull() | F.col("prior").isNotNull(), "UNKNOWN_PERSON").otherwise("NO_CLEAR_SPEAKER")
    j = j.withColumn("confirmed", confirmed).withColumn("state", state)
    active = F.when(F.col("confirmed"), "CONFIRMED").when(F.col("state") == "OFFSCREEN_SPEAKER", "OFFSCREEN").when(person & alone, "PROBABLE").otherwise("UNCERTAIN")
    visual = F.when(~framed, "NO_CONTEMPORARY_FRAME").when(F.col("valid"), "MAPPED_FACE_VISIBLE").when(F.size("frame.b_people") > 0, "VISIBLE_OTHER_PERSON_OR_WIDE_SHOT").otherwise("NO_FACE_RESOLVED")
    j = j.withColumn("active_state", active)
    unsynced = F.when(F.col("local"), "no_same_shot_face_at_lag_adjusted_time").otherwise("no_contemporary_bounded_mouth_audio_evidence")
    why = F.when(human, "user_verified").when(F.col("confirmed"), "contemporary_mouth_audio_and_temporal_consensus").when(~alone, "simultaneous_audio_ambiguous").when(person & ~verified, unsynced).when(person & ~stable, "insufficient_or_inconsistent_temporal_consensus").when(F.col("active_state") == "PROBABLE", "global_identity_prior_not_local_speech").when(F.col("active_state") == "OFFSCREEN", "mapped_person_offscreen").otherwise(F.coalesce("unresolved", "state"))
    age = F.abs(F.floor((F.col("start_us") + F.col("end_us")) / 2) - F.col("frame.b_time_us"))
    return j.select("source_id", "start_us", "end_us", "speaker", (~alone).alias("overlap"), "person_id", F.when(F.col("confirmed"), F.col("person_id")).alias("active_person"), F.when(person, F.col("prior_confidence")).alias("confidence"), F.when(person, F.col("method")).otherwise("unresolved").alias("method"), "state", "active_state", visual.alias("visual_state"), why.alias("reason"), "unresolved", F.col("frame.b_time_us").alias("observed_us"), age.alias("age_us"))


STATE = ["overlap", "person_id", "active_person", "confidence", "method", "state", "active_state", "visual_state", "reason", "unresolved"]


def active_speaker_intervals(cells: DataFrame) -> DataFrame:
    """active_speaker's cells of one voice that touch and agree in STATE, as one interval each."""
    return coalesce_runs(cells, ["source_id", "speaker"], STATE)


def active_speaker_metrics(cells: DataFrame, turns: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Of each source: seconds of speech, shares of it (null without speech) with a known, confirmed, probable, offscreen or no person, ambiguous seconds, and quantiles of the age of the nearest frame (the value at place int((n - 1) q) of n)."""
    speech = union_duration(turns.where("speaker is not null")).withColumnRenamed("union_us", "speech_us")
    # cells are cut at the same places for all voices: a moment counts once however many speak
    flags = {"known": F.col("person_id").isNotNull(), "confirmed": F.col("active_state") == "CONFIRMED", "probable": F.col("active_state") == "PROBABLE", "offscreen": F.col("state") == "OFFSCREEN_SPEAKER", "unknown": F.col("person_id").isNull(), "ambiguous": F.col("overlap") & F.col("active_person").isNull(), "unframed": F.col("visual_state") == "NO_CONTEMPORARY_FRAME"}
    per = cells.groupBy("source_id", "start_us", "end_us").agg(*(F.bool_or(c).alias(k) for k, c in flags.items()))
    sums = per.groupBy("source_id").agg(*(F.sum(F.when(F.col(k), F.col("end_us") - F.col("start_us")).otherwise(0)).alias(f"{k}_us") for k in flags))
    # ages are whole microseconds up to the gap: equal ones are counted before they are put in order
    ages = cells.where("age_us is not null").groupBy("source_id", "age_us").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("source_id").orderBy("age_us")
    ages = ages.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy("source_id")))
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q), F.col("age_us"))).alias(f"age_p{int(q * 100)}_us") for q in quantiles]
    q = ages.groupBy("source_id").agg(*at)
    j = speech.join(sums, "source_id", "left").join(q, "source_id", "left")
    share = lambda k: F.round(F.try_divide(F.coalesce(F.col(f"{k}_us"), F.lit(0)).cast("double"), F.nullif(F.col("speech_us"), F.lit(0)).cast("double")), 6).alias(f"{k}_share")
    return j.select("source_id", "speech_us", *(share(k) for k in ("known", "confirmed", "probable", "offscreen", "unknown")), F.coalesce("ambiguous_us", F.lit(0)).alias("ambiguous_us"), F.coalesce("unframed_us", F.lit(0)).alias("unframed_us"), *(f"age_p{int(x * 100)}_us" for x in quantiles))


# ---------------------------------------------------------------- diagnostics


def window_codes(candidates: DataFrame, manual: DataFrame, consensus: DataFrame) -> DataFrame:
    """source_id, speaker, window_id, start_us, end_us, code: why each window of evidence helps or does not. manual windows are those with the same voice and times."""
    person = consensus.select("source_id", "speaker", F.col("person_id").alias("mapped"))
    told = manual.select("source_id", "speaker", "start_us", "end_us", F.lit(True).alias("told")).distinct()
    w = candidates.where("speaker is not null").join(person, ["source_id", "speaker"], "left").groupBy("source_id", "speaker", "window_id", "start_us", "end_us").agg(
        F.bool_or(F.coalesce("overlap", F.lit(False))).alias("overlap"),
        F.count("person_id").alias("n"),
        F.bool_or(F.coalesce(F.col("person_id").isNotNull() & (F.col("lower_bound") > 0), F.lit(False))).alias("bounded"),
        F.bool_and(F.col("person_id").isNull() | F.col("correlation").isNull() | (F.col("correlation") < UP)).alias("low"),
        F.bool_or(F.coalesce(F.col("person_id") == F.col("mapped"), F.lit(False))).alias("local"),
        F.max("mapped").alias("mapped"),
    )
    code = F.when(F.col("told"), "USER_VERIFIED").when(F.col("overlap"), "OVERLAPPING_AUDIO").when(F.col("n") == 0, "NO_MOUTH_AUDIO_CANDIDATE").when(~F.col("bounded"), "NO_BOUNDED_POSITIVE_SYNC")
    code = code.when(F.col("mapped").isNull() & F.col("low"), "CORRELATION_BELOW_CONSENSUS_MINIMUM").when(F.col("mapped").isNull(), "NO_ACCEPTED_GLOBAL_MAPPING").when(~F.col("local"), "MAPPED_PERSON_NOT_IN_LOCAL_CANDIDATES").otherwise("BOUNDED_SYNC_CANDIDATE")
    return w.join(told, ["source_id", "speaker", "start_us", "end_us"], "left").select("source_id", "speaker", "window_id", "start_us", "end_us", code.alias("code"))


def review_windows(codes: DataFrame, most: int = 16) -> DataFrame:
    """The first windows of each voice (by time) that are no bounded candidate: those to look at."""
    order = Window.partitionBy("source_id", "speaker").orderBy("start_us", "end_us", "window_id")
    return codes.where("code <> 'BOUNDED_SYNC_CANDIDATE'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def speaker_diagnostics(turns: DataFrame, sightings: DataFrame, candidates: DataFrame, consensus: DataFrame, cells: DataFrame, lags: DataFrame) -> DataFrame:
    """source_id, speaker, reasons (why the voice's person is not known or not sure, sorted), speech_us, seen, faces, mouths, people, tracks, confirmed, probable, offscreen (cells of each).

    sightings: source_id, time_us, person_id, track_id, face_visible, mouth, embedded. lags: source_id, speaker, status, consistent. A sighting counts once however many turns of the voice hold it.
    """
    key = ["source_id", "speaker"]
    said = turns.where("speaker is not null and end_us > start_us").select(*key, "start_us", "end_us")
    own = ["time_us", "person_id", "track_id"]
    once = stab_join(sightings.select("source_id", *own, *(F.coalesce(x, F.lit(False)).alias(x) for x in ("face_visible", "mouth", "embedded"))), said).groupBy("source_id", F.col("b_speaker").alias("speaker"), *own).agg(*(F.bool_or(x).alias(x) for x in ("face_visible", "mouth", "embedded")))
    face = F.col("face_visible")
    seen = once.groupBy(*key).agg(F.count(F.lit(1)).alias("seen"), F.count_if(face).alias("faces"), F.count_if(face & F.col("mouth")).alias("mouths"), F.count_if(face & F.col("embedded")).alias("embedded"), F.countDistinct("person_id").alias("people"), F.countDistinct("track_id").alias("tracks"))
    w = candidates.where("speaker is not null").groupBy(*key).agg(F.bool_or(F.coalesce("overlap", F.lit(False))).alias("mixed"), F.bool_or(F.coalesce(F.col("track_stability") < 0.5, F.lit(False))).alias("shaky"))
    state = F.col("active_state")
    c = cells.groupBy(*key).agg(F.count_if(state == "CONFIRMED").alias("confirmed"), F.count_if(state == "PROBABLE").alias("probable"), F.count_if(state == "OFFSCREEN").alias("offscreen"))
    j = consensus.select(*key, "person_id", "reason").join(union_duration(said, ("source_id", "speaker")).withColumnRenamed("union_us", "speech_us"), key, "left")
    for other in (seen, w, c, lags.select(*key, "status", "consistent")):
        j = j.join(other, key, "left")
    counts = ("seen", "faces", "mouths", "embedded", "people", "tracks", "confirmed", "probable", "offscreen")
    j = j.withColumns({x: F.coalesce(x, F.lit(0)) for x in counts}).withColumn("consistent", F.coalesce("consistent", F.lit(False)))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    torn = is_(F.col("reason").isin("ambiguous_global_affinity", "simultaneous_speaker_person_conflict"))
    rules = [
        (F.col("seen") == 0, "NO_VISUAL_OVERLAP"), (F.col("faces") == 0, "INSUFFICIENT_FACE_OBSERVATION"), (F.col("mouths") == 0, "MOUTH_SIGNAL_UNAVAILABLE"), (F.col("embedded") == 0, "EMBEDDING_UNAVAILABLE"), (F.col("tracks") > 2 * F.col("people"), "TRACK_FRAGMENTATION"),
        (is_(F.col("reason") == "ambiguous_global_affinity"), "MULTIPLE_CANDIDATES"), (is_(F.col("reason") == "simultaneous_speaker_person_conflict"), "SIMULTANEOUS_CONFLICT"), (is_(F.col("mixed")), "OVERLAPPING_AUDIO_UNATTRIBUTABLE"), (F.col("offscreen") > 0, "OFFSCREEN_SPEAKER"), (is_(F.col("shaky")), "SHOT_INSTABILITY"),
        (F.col("person_id").isNull() & ~torn, "LOW_AFFINITY"), (is_(F.col("status") == "measured") & ~F.col("consistent"), "AUDIO_VIDEO_LAG_INCONSISTENT"), (F.col("person_id").isNotNull() & ~F.col("consistent"), "CONTEMPORARY_SYNC_NOT_VERIFIED"), (F.col("probable") > 0, "GLOBAL_IDENTITY_NOT_CURRENT_SPEECH"),
    ]
    return j.select(*key, F.array_sort(F.array_compact(F.array(*(F.when(c, r) for c, r in rules)))).alias("reasons"), F.coalesce("speech_us", F.lit(0)).alias("speech_us"), "seen", "faces", "mouths", "people", "tracks", "confirmed", "probable", "offscreen")
