"""Timelines: every stretch of a source with what is said, shown and meant in it.

Collections (scenes, topics, turns, links, words) become one tagged table, so a timeline costs one interval join and one
aggregation by stretch, however many collections there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .intervals import elementary_grid, interval_join, nearest_join, split_long, union_duration

_TAGGED = ("source_id", "start_us", "end_us", "kind", "id", "speaker", "text")


def tagged(df: DataFrame, kind: str, id_col: str | None = None, speaker: str | None = None, text: str | None = None) -> DataFrame:
    """A collection's rows in the common form."""
    of = lambda x: F.col(x).cast("string") if x else F.lit(None).cast("string")
    return df.select("source_id", "start_us", "end_us", F.lit(kind).alias("kind"), of(id_col).alias("id"), of(speaker).alias("speaker"), of(text).alias("text"))


def tagged_words(words: DataFrame) -> DataFrame:
    """A word belongs to the stretch that holds its midpoint."""
    mid = F.expr("(start_us + end_us) div 2")
    return words.select("source_id", mid.alias("start_us"), (mid + 1).alias("end_us"), F.lit("word").alias("kind"), F.col("word_id").alias("id"), F.lit(None).cast("string").alias("speaker"), F.col("word").alias("text"), F.col("start_us").alias("said_us"))


def first_of(kind: str) -> Column:
    """The id of the first of a kind, by start."""
    return F.min_by(F.when(F.col("b_kind") == kind, F.col("b_id")), F.when(F.col("b_kind") == kind, F.struct("b_start_us", "b_id")))


def ids_of(kind: str) -> Column:
    """The ids of a kind in order of start, joined by commas."""
    found = F.sort_array(F.collect_list(F.when(F.col("b_kind") == kind, F.struct("b_start_us", "b_id"))))
    return F.array_join(F.transform(found, lambda x: x["b_id"]), ",")


def _in_stretches(cells: DataFrame, collections: list[DataFrame], *aggs: Column) -> DataFrame:
    """cells (source_id, start_us, end_us) with aggregates over everything that overlaps them; cells without anything stay."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), collections)
    if "said_us" not in whole.columns:
        whole = whole.withColumn("said_us", F.lit(None).cast("long"))
    found = interval_join(cells, whole.where("end_us > start_us"))
    per = found.groupBy("source_id", "start_us", "end_us").agg(*aggs)
    return cells.join(per, ["source_id", "start_us", "end_us"], "left")


def _spoken() -> tuple[Column, Column]:
    """The words of a stretch in order, and how many."""
    w = F.sort_array(F.collect_list(F.when(F.col("b_kind") == "word", F.struct("b_said_us", "b_id", "b_text"))))
    return F.array_join(F.transform(w, lambda x: x["b_text"]), " ").alias("text"), F.count_if(F.col("b_kind") == "word").alias("n_words")


def _speakers() -> Column:
    return F.array_sort(F.collect_set(F.when(F.col("b_kind") == "turn", F.col("b_speaker")))).alias("speakers")


def build_timeline(durations: DataFrame, segments: DataFrame, scenes: DataFrame, topics: DataFrame, turns: DataFrame, links: DataFrame, words: DataFrame, frames: DataFrame, tolerance_us: int = 750_000) -> DataFrame:
    """Every stretch between neighbouring boundaries of any collection.

    scene_id and topic_id: the first by start. speaker: the only voice, else null. The nearest frame to the middle counts
    within the tolerance and in the same scene; links name the person of a voice. Two linked people on two voices make a
    split screen, one on one voice the focus, else the number of visible people decides the layout.
    """
    parts = [segments, scenes, topics, turns, links]
    bounds = reduce(DataFrame.union, [x.select("source_id", "start_us", "end_us") for x in parts])
    cells = elementary_grid(bounds, sources=durations).select("source_id", "start_us", "end_us")
    all_rows = [tagged(segments, "segment", "segment_id"), tagged(scenes, "scene", "scene_id"), tagged(topics, "topic", "topic_id"), tagged(turns, "turn", None, "speaker"), tagged(links, "link", "person_id", "speaker"), tagged_words(words)]
    linked = F.collect_set(F.when(F.col("b_kind") == "link", F.struct(F.col("b_speaker").alias("speaker"), F.col("b_id").alias("person_id")))).alias("linked")
    lit = _in_stretches(cells, all_rows, first_of("scene").alias("scene_id"), first_of("topic").alias("topic_id"), _speakers(), linked, *_spoken(), ids_of("segment").alias("segment_ids"))
    seen = frames.select("source_id", "time_us", F.struct("scene_id", "people").alias("shown"))
    mid = lit.withColumn("mid_us", F.expr("(start_us + end_us) div 2")).withColumn("lo_us", F.lit(-(1 << 62))).withColumn("hi_us", F.lit(1 << 62)).withColumnRenamed("mid_us", "time_us")
    near = nearest_join(mid, seen, "shown", tolerance_us)
    valid = F.coalesce(F.col("scene_id").isNull() | (F.col("shown.scene_id") == F.col("scene_id")), F.lit(False)) & F.col("sample_us").isNotNull()
    none = F.array().cast("array<string>")
    near = near.withColumn("visible", F.when(valid, F.col("shown.people")).otherwise(none)).withColumn("observed_us", F.when(valid, F.col("sample_us")))
    near = near.withColumn("speakers", F.coalesce("speakers", none))
    people = F.array_sort(F.array_distinct(F.transform(F.filter("linked", lambda x: F.array_contains(F.col("speakers"), x["speaker"]) & F.array_contains(F.col("visible"), x["person_id"])), lambda x: x["person_id"])))
    near = near.withColumn("people", F.coalesce(people, none))
    voices, n, shown = F.size("speakers"), F.size("people"), F.size("visible")
    split = (voices > 1) & (n >= 2)
    single = (voices == 1) & (n == 1)
    layout = F.when(split, "split_screen_candidate").when(single & (shown == 1), "single_focus").when(single, "speaker_follow").when(shown == 2, "two_person_scene").when(shown > 2, "group_scene").otherwise("unknown")
    return near.select("source_id", "start_us", "end_us", "scene_id", "topic_id", F.when(voices == 1, F.col("speakers")[0]).alias("speaker"), "speakers", F.when(split | single, F.col("people")[0]).alias("primary_person"), F.when(split, F.try_element_at("people", F.lit(2))).alias("secondary_person"), "visible", "observed_us", (voices > 1).alias("speech_overlap"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_words", F.lit(0)).alias("n_words"), F.coalesce("segment_ids", F.lit("")).alias("segment_ids"), layout.alias("layout"))


def enrich_moments(moments: DataFrame, timeline: DataFrame) -> DataFrame:
    """Speakers and primary people of the stretches that a moment overlaps, and its layout: two voices and two people make a split screen, anyone the speaker's."""
    t = timeline.select("source_id", "start_us", "end_us", "speakers", "primary_person", "visible")
    found = interval_join(moments.select("source_id", "moment_id", "start_us", "end_us"), t)
    per = found.groupBy("source_id", "moment_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("b_speakers")))).alias("speakers"), F.array_sort(F.collect_set("b_primary_person")).alias("people"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("b_visible")))).alias("seen"), F.count(F.lit(1)).alias("n_windows"))
    none = F.array().cast("array<string>")
    j = moments.select("source_id", "moment_id").join(per, ["source_id", "moment_id"], "left").select("source_id", "moment_id", *(F.coalesce(x, none).alias(x) for x in ("speakers", "people", "seen")), F.coalesce("n_windows", F.lit(0)).alias("n_windows"))
    return j.withColumn("layout", F.when((F.size("speakers") == 2) & (F.size("people") == 2), "split_screen_candidate").when(F.size("people") > 0, "speaker_follow").otherwise("unknown"))


def master_timeline(windows: DataFrame, words: DataFrame, segments: DataFrame, firsts: dict[str, tuple[DataFrame, str]], turns: DataFrame) -> DataFrame:
    """Windows with their words (by midpoint), segments, speakers, an overlap flag, and of each further collection the first that overlaps: firsts maps a name to its rows and their id column."""
    rows = [tagged_words(words), tagged(segments, "segment", "segment_id"), tagged(turns, "turn", None, "speaker"), *(tagged(df, name, id_col) for name, (df, id_col) in firsts.items())]
    lit = _in_stretches(windows.select("source_id", "start_us", "end_us").distinct(), rows, *_spoken(), ids_of("segment").alias("segment_ids"), _speakers(), *(first_of(x).alias(f"{x}_id") for x in firsts))
    empty = {"text": "", "n_words": 0, "segment_ids": ""}
    out = windows.join(lit, ["source_id", "start_us", "end_us"]).fillna(empty)
    return out.withColumn("speech_overlap", F.coalesce(F.size("speakers") > 1, F.lit(False))).withColumn("speakers", F.coalesce(F.array_join("speakers", ","), F.lit("")))


def camera_windows(durations: DataFrame, shots: DataFrame, active: DataFrame, frames: DataFrame, longest_us: int = 1_000_000, tolerance_us: int = 600_000) -> DataFrame:
    """Windows between shot, speaker and frame edges, none longer than `longest_us`, each with its shot, nearest frame and focus.

    shots: shot_id, shot_type. active: speaker, person_id, confidence, state. frames: people, an array of (person_id, safe).
    Without a frame near the middle and inside the shot the focus is null. Only a confirmed, visible person who speaks alone
    is the focus; screens, logos and the like have none. The first window after a shot's edge keeps the full frame.
    """
    frame_times = frames.select("source_id", "time_us").distinct()
    after = F.lead("time_us").over(Window.partitionBy("source_id").orderBy("time_us"))
    mids = frame_times.select("source_id", F.floor((F.col("time_us") + after) / 2).cast("long").alias("start_us")).where("start_us is not null")
    bounds = shots.select("source_id", "start_us", "end_us").union(active.select("source_id", "start_us", "end_us"))
    bounds = bounds.union(mids.select("source_id", "start_us", F.col("start_us").alias("end_us")))
    cells = split_long(elementary_grid(bounds, sources=durations), longest_us).select("source_id", "start_us", "end_us")
    mid = cells.withColumn("mid_us", F.expr("(start_us + end_us) div 2")).select("source_id", F.col("mid_us").alias("start_us"), (F.col("mid_us") + 1).alias("end_us"), F.struct("start_us", "end_us").alias("cell"))
    rows = tagged(shots, "shot", "shot_id", None, "shot_type").withColumn("shot", F.struct("start_us", "end_us")).unionByName(tagged(active.where("state is null or state = 'CONFIRMED'"), "active", "person_id", "speaker"), allowMissingColumns=True).unionByName(tagged(active, "voice", None, "speaker"), allowMissingColumns=True)
    found = interval_join(mid, rows)
    shot = F.min_by(F.struct(F.col("b_id").alias("shot_id"), F.col("b_text").alias("shot_type"), "b_shot.start_us", "b_shot.end_us"), F.when(F.col("b_kind") == "shot", F.struct("b_start_us", "b_id")))
    per = found.groupBy("source_id", "cell").agg(shot.alias("shot"), F.array_sort(F.collect_set(F.when(F.col("b_kind") == "active", F.col("b_id")))).alias("speaking"), F.count_distinct(F.when(F.col("b_kind") == "voice", F.col("b_speaker"))).alias("voices"))
    lit = mid.select("source_id", "cell").join(per, ["source_id", "cell"], "left")
    lit = lit.select("source_id", "cell.start_us", "cell.end_us", "shot", "speaking", F.coalesce("voices", F.lit(0)).alias("voices")).withColumn("time_us", F.expr("(start_us + end_us) div 2"))
    lit = lit.withColumn("lo_us", F.coalesce("shot.start_us", "start_us")).withColumn("hi_us", F.coalesce("shot.end_us", "end_us"))
    near = nearest_join(lit, frames.select("source_id", "time_us", "people"), "people", tolerance_us)
    none = F.array().cast("array<string>")
    visible = F.coalesce(F.array_sort(F.transform("people", lambda p: p["person_id"])), none)
    near = near.withColumn("visible", visible).withColumn("known", F.coalesce(F.array_intersect("speaking", "visible"), none)).withColumn("overlap", F.col("voices") > 1)
    w = Window.partitionBy("source_id").orderBy("start_us")
    reset = F.row_number().over(w) > 1
    reset = reset & ~F.lag("shot.shot_id").over(w).eqNullSafe(F.col("shot.shot_id"))
    no_person = F.coalesce(F.col("shot.shot_type").isin("broll", "b_roll", "screen", "screen_capture", "logo", "empty", "title_card"), F.lit(False))
    person = F.when((F.size("known") == 1) & ~F.col("overlap"), F.col("known")[0])
    near = near.withColumn("reset", reset).withColumn("one", person)
    safe = F.coalesce(F.exists("people", lambda p: (p["person_id"] == F.col("one")) & p["safe"]), F.lit(False))
    both = (F.size("known") == 2) & F.coalesce(F.forall(F.filter("people", lambda p: F.array_contains(F.col("known"), p["person_id"])), lambda p: p["safe"]), F.lit(False))
    n = F.size("visible")
    layout = F.when(no_person | F.col("reset"), "full_frame").when(F.col("overlap") & both, "split_candidate").when(F.col("one").isNotNull() & safe, "single_person").when(n == 2, "two_person").when(n > 2, "group").otherwise("full_frame")
    return near.select("source_id", "start_us", "end_us", F.col("shot.shot_id").alias("shot_id"), F.col("sample_us").alias("observed_us"), "visible", F.when(~no_person, F.col("one")).alias("active_person"), "overlap", F.col("reset").alias("boundary_reset"), (safe & ~no_person & ~F.col("reset")).alias("safe"), layout.alias("layout"))


def camera_coverage(windows: DataFrame, durations: DataFrame) -> DataFrame:
    """Shares of each source's duration: with any window, resolved focus, an editorial layout, the full frame, a safe crop; switches a minute inside one shot."""
    flags = {"timeline": F.lit(True), "resolved": F.col("active_person").isNotNull(), "editorial": F.col("layout") != "full_frame", "full_frame": F.col("layout") == "full_frame", "fallback": (F.col("layout") == "full_frame") & F.col("active_person").isNull(), "safe": F.col("safe")}
    each = windows.select("source_id", "start_us", "end_us", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))).alias("part"))
    shares = union_duration(each, ("source_id", "part")).groupBy("source_id").pivot("part", list(flags)).agg(F.sum("union_us"))
    w = Window.partitionBy("source_id").orderBy("start_us")
    same_shot = F.lag("shot_id").over(w).eqNullSafe(F.col("shot_id")) & (F.row_number().over(w) > 1)
    change = ~F.lag("layout").over(w).eqNullSafe(F.col("layout")) | ~F.lag("active_person").over(w).eqNullSafe(F.col("active_person"))
    switches = windows.withColumn("switch", (same_shot & change).cast("int")).groupBy("source_id").agg(F.sum("switch").alias("switches"))
    j = durations.join(shares, "source_id").join(switches, "source_id")
    share = lambda k: F.least(F.lit(1.0), F.coalesce(ratio(F.col(k), F.col("duration_us")), F.lit(0.0)))
    return j.select("source_id", *(share(k).alias(f"{k}_share") for k in flags), "switches", ratio(F.col("switches") * 60_000_000, F.col("duration_us")).alias("switches_per_minute"))
