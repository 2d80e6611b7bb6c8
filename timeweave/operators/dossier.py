"""Clips with everything that is known about them, the people in them, and what reviewers propose or sign."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mean_of
from ..functions.text import sql_pattern
from .intervals import SECOND, interval_join
from .timeline import tagged, tagged_words


def flat_clips(clips: DataFrame) -> DataFrame:
    """Clips and their alternates (an array of start_us, end_us) as rows: alternate 0 is the clip itself."""
    own = F.array(F.struct("start_us", "end_us"))
    every = F.concat(own, F.coalesce("alternates", F.slice(own, 1, 0)))
    each = clips.select("source_id", "clip_id", F.posexplode(every).alias("alternate", "span"))
    return each.select("source_id", "clip_id", "alternate", "span.start_us", "span.end_us")


def clip_dossier(clips: DataFrame, words: DataFrame, segments: DataFrame, turns: DataFrame, scenes: DataFrame, topics: DataFrame, people: DataFrame, levels: DataFrame) -> DataFrame:
    """One row for each clip and alternate: its words, segments, speakers, people, scenes and topics, two segments of context on each side, the share of doubtful words, and the loudness weighted by overlap.

    segments have pos, their place in the source. words have confidence. people: person_id seen in [start_us, end_us). levels: rms_dbfs in windows.
    All collections meet the clips in one interval join; context is joined by place.
    """
    flat = flat_clips(clips)
    rows = [tagged(segments, "segment", "segment_id").unionByName(tagged(turns, "turn", None, "speaker")), tagged(scenes, "scene", "scene_id"), tagged(topics, "topic", "topic_id"), tagged(people, "person", "person_id")]
    spoken = tagged_words(words.select("source_id", "word_id", "word", "start_us", "end_us")).drop("said_us")
    spoken = spoken.join(words.select("source_id", F.col("word_id").alias("id"), (F.coalesce(F.col("confidence"), F.lit(0.0)) < 0.6).cast("double").alias("value")), ["source_id", "id"])
    loud = levels.select("source_id", "start_us", "end_us", F.lit("level").alias("kind"), F.col("rms_dbfs").alias("value"))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*rows, spoken, loud])
    j = interval_join(flat, whole)
    k = F.col("b_kind")
    shared = (F.least("end_us", "b_end_us") - F.greatest("start_us", "b_start_us")).cast("double")
    weight = F.sum(F.when((k == "level") & F.col("b_value").isNotNull(), shared))
    names = lambda kind, col: F.array_join(F.array_sort(F.collect_set(F.when(k == kind, F.col(col)))), ",")
    key = ["source_id", "clip_id", "alternate"]
    g = j.groupBy(*key).agg(F.count_if(k == "word").alias("n_words"), F.round(F.avg(F.when(k == "word", F.col("b_value"))), 6).alias("doubtful_share"), names("segment", "b_id").alias("segment_ids"), names("turn", "b_speaker").alias("speakers"), names("person", "b_id").alias("people"), names("scene", "b_id").alias("scenes"), names("topic", "b_id").alias("topics"), F.round(F.try_divide(F.sum(F.when(k == "level", shared * F.col("b_value"))), weight), 4).alias("rms_dbfs"))
    at = interval_join(flat, segments.select("source_id", "start_us", "end_us", "pos")).groupBy(*key).agg(F.min("b_pos").alias("first"), F.max("b_pos").alias("last"))
    near = at.select(*key, "first", F.explode(F.array(*(F.col("first") - d for d in (2, 1)), *(F.col("last") + d for d in (1, 2)))).alias("pos")).join(segments.select("source_id", "pos", "segment_id"), ["source_id", "pos"])
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "segment_id")))), lambda x: x["segment_id"]), ",")
    context = near.groupBy(*key).agg(side(F.col("pos") < F.col("first")).alias("before"), side(F.col("pos") > F.col("first")).alias("after"))
    out = flat.join(g, key, "left").join(context, key, "left")
    return out.fillna({"n_words": 0} | dict.fromkeys(("segment_ids", "speakers", "people", "scenes", "topics", "before", "after"), ""))


def graphic_zones(clips: DataFrame, graphics: DataFrame) -> DataFrame:
    """source_id, clip_id, position of captions, n_regions: persistent lower thirds and tickers push them up, banners down, both make them move. graphics: kind, persistent, y_start, y_end in [start_us, end_us)."""
    j = interval_join(clips.select("source_id", "clip_id", "start_us", "end_us"), graphics, "left")
    low = F.col("b_persistent") & F.col("b_kind").isin("lower_third", "ticker") & (F.col("b_y_start") > 0.4)
    top = F.col("b_persistent") & (F.col("b_kind") == "banner") & (F.col("b_y_end") < 0.35)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = j.groupBy("source_id", "clip_id").agg(some(low).alias("low"), some(top).alias("top"), F.count("b_kind").alias("n_regions"))
    return g.select("source_id", "clip_id", F.when(F.col("low") & F.col("top"), "dynamic_safe_zone").when(F.col("low"), "upper_middle").otherwise("lower_middle").alias("position"), "n_regions")


def participants(people: DataFrame, speakers: DataFrame, mapping: DataFrame, names: DataFrame | None = None, background: bool = True, least_speech: float = 3.0, least_seen: float = 8.0, least_observations: int = 12, least_shots: int = 2) -> DataFrame:
    """Who takes part: every person with the voices mapped to them, and every voice without a person; role by questions and answers, significance from what is known, status and category.

    Who speaks long enough is an editorial participant; others who are seen are visual, incidental or background people, and stay only with background.
    people: source_id, person_id, seen_s, observations, shots. speakers: source_id, speaker, speech_s, questions, answers. mapping: source_id, speaker, person_id. names: source_id, speaker,
    possible_name, what a voice is introduced as; of a person's voices the first that has one counts.
    """
    none = speakers.select("source_id", "speaker").limit(0).withColumn("possible_name", F.lit(None).cast("string"))
    voices = speakers.join(mapping.where("person_id is not null"), ["source_id", "speaker"], "left").join(none if names is None else names.where("possible_name is not null").select("source_id", "speaker", "possible_name"), ["source_id", "speaker"], "left")
    own = voices.where("person_id is not null").groupBy("source_id", "person_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.sum("speech_s").alias("speech_s"), F.sum("questions").alias("questions"), F.sum("answers").alias("answers"), F.min(F.when(F.col("possible_name").isNotNull(), F.struct("speaker", "possible_name")))["possible_name"].alias("possible_name"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("questions", "answers")}
    known = people.join(own, ["source_id", "person_id"], "left").withColumns({"speakers": F.coalesce("speakers", F.lit("")), **zero})
    alone = voices.where("person_id is null").select("source_id", F.lit(None).cast("string").alias("person_id"), F.col("speaker").alias("speakers"), "speech_s", "questions", "answers", "possible_name")
    p = known.unionByName(alone, allowMissingColumns=True)
    heard, seen = F.coalesce(F.col("speech_s") >= least_speech, F.lit(False)), F.coalesce(F.col("seen_s") >= 1, F.lit(False))
    host = (F.col("questions") >= 3) & (F.col("questions") >= F.greatest(F.lit(2), F.col("answers") * 2))
    guest = (F.col("answers") >= 3) & (F.col("answers") >= F.greatest(F.lit(2), F.col("questions") * 2))
    part = lambda weight, c, n: F.coalesce(weight * F.least(F.lit(1.0), c / n), F.lit(0.0))
    parts = [part(0.35, F.col("speech_s"), 60), part(0.25, F.col("seen_s"), 60), part(0.15, F.col("shots"), 3), part(0.15, F.col("questions") + F.col("answers"), 3), F.when(F.col("possible_name").isNotNull(), 0.1).otherwise(0.0)]
    clear = F.coalesce((F.col("seen_s") >= least_seen) & (F.col("observations") >= least_observations) & ((F.col("shots") >= least_shots) | (F.col("seen_s") >= 4 * least_seen)), F.lit(False))
    p = p.withColumn("significance", F.round(reduce(lambda a, b: a + b, parts), 3)).withColumn("role", F.when(host, "likely_host").when(guest, "likely_guest").otherwise("unknown")).withColumn("clearly_seen", clear)
    status = F.when(heard, "confirmed_editorial_participant").when(F.col("person_id").isNull(), "insufficient_evidence").when(F.col("clearly_seen"), "likely_visual_participant").when(seen, "background_person").otherwise("insufficient_evidence")
    category = F.when(heard & (F.col("significance") >= 0.65), "main_participant").when(heard, "editorial_participant").when(F.col("clearly_seen"), "visual_participant").when(seen, "incidental_person").otherwise("background_person")
    out = p if background else p.where(heard)
    return out.select("source_id", "person_id", "speakers", "speech_s", "questions", "answers", "possible_name", "role", "significance", "clearly_seen", status.alias("status"), category.alias("category"))


def shot_features(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """Type and score of each shot from its frames (people, face_height, sharpness, black): the number of people, of one the median face height; the score is the mean of what is known."""
    middle = frames.agg(F.median("sharpness").alias("usual"))
    f = frames.withColumn("end_us", F.col("time_us") + 1).withColumnRenamed("time_us", "start_us")
    g = interval_join(shots.select("source_id", "shot_id", "start_us", "end_us"), f, "left").groupBy("source_id", "shot_id").agg(F.count("b_people").alias("n_frames"), F.max(F.size("b_people")).alias("most"), F.median("b_face_height").alias("face"), F.avg((F.col("b_face_height").isNotNull()).cast("double")).alias("face_share"), F.median("b_sharpness").alias("sharp"), F.bool_and("b_black").alias("black"))
    n, h = F.col("most"), F.col("face")
    kind = F.when(F.col("n_frames") == 0, "unknown").when(n >= 3, "group").when(n == 2, "two_shot").when(n == 1, F.when(h.isNull(), "unknown").when(h >= 0.42, "close_up").when(h >= 0.28, "medium_close_up").when(h >= 0.12, "medium").otherwise("wide")).when(F.col("black"), "empty").otherwise("unknown")
    g = g.crossJoin(F.broadcast(middle))  # one row
    sharp = F.least(F.lit(1.0), F.try_divide(F.col("sharp"), F.col("usual")))
    share = F.when(F.col("n_frames") > 0, F.col("face_share"))
    return g.select("source_id", "shot_id", kind.alias("shot_type"), F.round(share, 6).alias("face_share"), F.round(sharp, 6).alias("sharpness"), F.round(mean_of(share, sharp), 6).alias("score"))


def boundary_proposals(clips: DataFrame, segments: DataFrame, gap_us: int = 5 * SECOND) -> DataFrame:
    """source_id, clip_id, kind, start_us, end_us, added: the edges of a clip's own segments; the segment before if the clip opens in the middle of a thought, the one after if it doesn't end; within the gap, a known topic and the clip's limits.

    clips: first_pos, last_pos, least_us, most_us, clean_opening, clean_ending. segments: pos, segment_id, start_us, end_us, text, topic_id.
    """
    at = lambda name: segments.select("source_id", *(F.col(x).alias(f"{name}_{x}") for x in ("pos", "segment_id", "start_us", "end_us", "text", "topic_id")))
    inside = clips.select("source_id", "clip_id", F.explode(F.sequence("first_pos", "last_pos")).alias("pos")).join(segments, ["source_id", "pos"])
    topics = inside.groupBy("source_id", "clip_id").agg(F.collect_set("topic_id").alias("topics"), F.count(F.lit(1)).alias("n"))
    j = clips.join(topics, ["source_id", "clip_id"]).where(F.col("n") == F.col("last_pos") - F.col("first_pos") + 1)
    for name, pos in (("f", F.col("first_pos")), ("l", F.col("last_pos")), ("p", F.col("first_pos") - 1), ("n", F.col("last_pos") + 1)):
        s = at(name).withColumnRenamed("source_id", f"{name}_source")
        j = j.join(s, (F.col("source_id") == F.col(f"{name}_source")) & (pos == F.col(f"{name}_pos")), "left")
    hanging = F.lower("f_text").rlike(sql_pattern(r"^(?:que|e|mas|porque|assim|ent[aã]o|a[ií]|inclusive)\b")) | (F.col("clean_opening") == F.lit(False))
    loose = F.coalesce(F.col("clean_ending") == F.lit(False), F.lit(False)) | ~F.rtrim("l_text").rlike(sql_pattern(r"[.!?]$")) | F.rtrim("l_text").rlike(sql_pattern(r"\.\.\.$"))
    may = lambda gap, topic: gap.between(0, gap_us) & F.coalesce(F.array_contains("topics", topic), F.lit(False))
    before = may(F.col("f_start_us") - F.col("p_end_us"), F.col("p_topic_id")) & F.coalesce(hanging, F.lit(False))
    after = may(F.col("n_start_us") - F.col("l_end_us"), F.col("n_topic_id")) & F.coalesce(loose, F.lit(False))
    made = lambda kind, c, a, b, added: F.when(c, F.struct(F.lit(kind).alias("kind"), F.col(a).alias("start_us"), F.col(b).alias("end_us"), added.alias("added")))
    none = F.lit(None).cast("string")
    found = F.array_compact(F.array(made("canonical_segment_edges", F.lit(True), "f_start_us", "l_end_us", none), made("inspect_preceding_context", before, "p_start_us", "l_end_us", F.col("p_segment_id")), made("inspect_following_continuation", after, "f_start_us", "n_end_us", F.col("n_segment_id"))))
    each = j.select("source_id", "clip_id", "least_us", "most_us", F.explode(found).alias("x")).select("source_id", "clip_id", "x.*", "least_us", "most_us")
    return each.where((F.col("end_us") - F.col("start_us")).between(F.col("least_us"), F.col("most_us"))).drop("least_us", "most_us")


def apply_caption_review(captions: DataFrame, sheet: DataFrame, critical: tuple[str, ...]) -> DataFrame:
    """source_id, clip_id, caption_id, error, local_start_us, local_end_us: a clip's captions in its own time if every one of them is signed and sound, else what is wrong with each and no times.

    captions: source_id, clip_id, caption_id, clip_start_us, clip_end_us, issues (array). sheet: clip_id, caption_id, decision, listened, reviewer, text, start_us, end_us, resolved (array).
    """
    s = sheet.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("clip_id", "caption_id"))).dropDuplicates(["clip_id", "caption_id"]).withColumn("signed", F.lit(True))
    j = captions.withColumn("asked", F.lit(True)).join(s, ["clip_id", "caption_id"], "full_outer")
    order = Window.partitionBy("clip_id").orderBy("clip_start_us", "caption_id")
    j = j.withColumn("before", F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    text = F.trim(F.coalesce("text", F.lit("")))
    yes = lambda c, v: F.coalesce(F.upper(F.trim(F.col(c))) == v, F.lit(False))
    open_issues = F.array_except(F.array_intersect("issues", F.array(*map(F.lit, critical))), F.coalesce("resolved", F.array().cast("array<string>")))
    inside = (F.col("start_us") >= F.col("clip_start_us")) & (F.col("start_us") < F.col("end_us")) & (F.col("end_us") <= F.col("clip_end_us")) & (F.col("before").isNull() | (F.col("start_us") >= F.col("before")))
    rules = [(F.col("asked").isNull(), "unknown_caption"), (F.col("signed").isNull(), "not_in_sheet"), (F.col("copies") > 1, "duplicate"), (~yes("decision", "APPROVED") | ~yes("listened", "YES") | (F.trim(F.coalesce("reviewer", F.lit(""))) == ""), "not_approved_or_not_heard"), ((text == "") | (F.length(text) > 400) | text.contains("-->"), "invalid_text"), (~F.coalesce(inside, F.lit(False)), "outside_or_out_of_order"), (F.size(open_issues) > 0, "critical_issue_open")]
    error = reduce(lambda c, r: c.when(r[0], r[1]), rules, F)
    j = j.withColumn("error", error.otherwise(None))
    sound = F.bool_and(F.col("error").isNull()).over(Window.partitionBy("clip_id"))
    local = lambda c: F.when(F.col("sound"), F.col(c) - F.col("clip_start_us"))
    return j.withColumn("sound", sound).select("clip_id", "caption_id", "error", local("start_us").alias("local_start_us"), local("end_us").alias("local_end_us"))


def run_metrics(tables: dict[str, tuple[DataFrame, dict[str, Column]]], sources: DataFrame) -> DataFrame:
    """source_id, metric, value in long form over many collections; null where a source has no row of a collection."""
    wide = sources.select("source_id")
    for name, (df, metrics) in tables.items():
        wide = wide.join(df.groupBy("source_id").agg(*(c.cast("double").alias(f"{name}.{k}") for k, c in metrics.items())), "source_id", "left")
    cols = [f"{n}.{k}" for n, (_, m) in tables.items() for k in m]
    return wide.unpivot("source_id", [F.col(f"`{c}`") for c in cols], "metric", "value").withColumn("value", F.round("value", 6))
