"""Timelines of conversations: stretches, camera windows, moments and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timeline as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_CELLS = "select * from (select source_id, t as start_us, lead(t) over (partition by source_id order by t) as end_us from ends) where end_us is not null"
_IN = "x.source_id = c.source_id and x.start_us < c.end_us and c.start_us < x.end_us and x.end_us > x.start_us"
_WORDS_IN = "x.source_id = c.source_id and (x.start_us + x.end_us) // 2 >= c.start_us and (x.start_us + x.end_us) // 2 < c.end_us"
_TIMELINE = f"""bounds as (select source_id, start_us, end_us from segments union all select source_id, start_us, end_us from scene_cells union all select source_id, start_us, end_us from topic_cells union all select source_id, start_us, end_us from voices union all select source_id, start_us, end_us from speaker_links),
 ends as (select distinct b.source_id, greatest(0, least(t, duration_us)) as t from (select source_id, unnest([start_us, end_us]) as t from bounds) b join spans using (source_id) union select source_id, unnest([0, duration_us]) from spans),
 cells as ({_CELLS}), lit as (select c.*, (c.start_us + c.end_us) // 2 as mid, (select arg_min(scene_id, start_us) from scene_cells x where {_IN}) as scene_id, (select arg_min(topic_id, start_us) from topic_cells x where {_IN}) as topic_id,
  coalesce((select list(distinct speaker order by speaker) from voices x where {_IN}), []) as speakers, coalesce((select list(distinct {{'s': speaker, 'p': person_id}}) from speaker_links x where {_IN}), []) as linked,
  coalesce((select string_agg(word, ' ' order by start_us, word_id) from words x where {_WORDS_IN}), '') as text, (select count(*) from words x where {_WORDS_IN}) as n_words, coalesce((select string_agg(segment_id, ',' order by start_us, segment_id) from segments x where {_IN}), '') as segment_ids from cells c),
 sides as (select *, (select max({{'t': time_us, 'scene_id': scene_id, 'people': people}}) from pictures p where p.source_id = lit.source_id and p.time_us < mid) as a, (select min({{'t': time_us, 'scene_id': scene_id, 'people': people}}) from pictures p where p.source_id = lit.source_id and p.time_us >= mid) as b from lit),
 near as (select *, case when mid - a.t <= 750000 and (b is null or b.t - mid > 750000 or mid - a.t <= b.t - mid) then a when b.t - mid <= 750000 then b end as f from sides),
 seen as (select *, f is not null and (scene_id is null or f.scene_id = scene_id) as valid from near),
 who as (select *, case when valid then f.people else [] end as visible, list_sort(list_distinct(list_transform(list_filter(linked, lambda x: list_contains(speakers, x.s) and valid and list_contains(f.people, x.p)), lambda x: x.p))) as people from seen),
 timeline as (select source_id, start_us, end_us, scene_id, topic_id, speakers, visible, case when len(speakers) > 1 and len(people) >= 2 or len(speakers) = 1 and len(people) = 1 then people[1] end as primary_person, case when len(speakers) > 1 and len(people) >= 2 then people[2] end as secondary_person,
  case when valid then f.t end as observed_us, text, n_words, segment_ids, case when len(speakers) > 1 and len(people) >= 2 then 'split_screen_candidate' when len(speakers) = 1 and len(people) = 1 then case when len(visible) = 1 then 'single_focus' else 'speaker_follow' end when len(visible) = 2 then 'two_person_scene' when len(visible) > 2 then 'group_scene' else 'unknown' end as layout from who)"""
_TIMELINE_OF = ("segments", "words", "scene_cells", "topic_cells", "voices", "pictures", "speaker_links", "spans")


def _timeline(spark, sf_dir):
    return op.build_timeline(d.spans(spark, sf_dir), d.segments(spark, sf_dir), d.scene_cells(spark, sf_dir), d.topic_cells(spark, sf_dir), d.voices(spark, sf_dir), d.speaker_links(spark, sf_dir), d.words(spark, sf_dir), d.pictures(spark, sf_dir))


@query(f""", {_TIMELINE} select source_id, start_us, end_us, scene_id, topic_id, case when len(speakers) = 1 then speakers[1] end as speaker, array_to_string(speakers, ',') as speakers, primary_person, secondary_person, array_to_string(visible, ',') as visible, observed_us, len(speakers) > 1 as speech_overlap, text, n_words, segment_ids, layout from timeline""", *_TIMELINE_OF)
def a7_build_timeline(spark, sf_dir):
    t = _timeline(spark, sf_dir)
    return t.withColumn("speakers", F.array_join("speakers", ",")).withColumn("visible", F.array_join("visible", ","))


_MOMENTS = "moments as (select source_id, segment_id as moment_id, start_us, end_us + 8000000 as end_us from segments)"


@query(f""", {_TIMELINE}, {_MOMENTS}, hit as (select m.source_id, m.moment_id, t.* exclude (source_id) from moments m left join timeline t on t.source_id = m.source_id and t.start_us < m.end_us and m.start_us < t.end_us),
 per as (select source_id, moment_id, coalesce(list_sort(list_distinct(flatten(list(speakers) filter (speakers is not null)))), []) as speakers, coalesce(list(distinct primary_person order by primary_person) filter (primary_person is not null), []) as people, coalesce(list_sort(list_distinct(flatten(list(visible) filter (visible is not null)))), []) as seen, count(start_us) as n_windows from hit group by 1, 2)
 select source_id, moment_id, array_to_string(speakers, ',') as speakers, array_to_string(people, ',') as people, array_to_string(seen, ',') as seen, n_windows, case when len(speakers) = 2 and len(people) = 2 then 'split_screen_candidate' when len(people) > 0 then 'speaker_follow' else 'unknown' end as layout from per""", *_TIMELINE_OF)
def j31_enrich_moments(spark, sf_dir):
    m = d.segments(spark, sf_dir).select("source_id", F.col("segment_id").alias("moment_id"), "start_us", (F.col("end_us") + 8_000_000).alias("end_us"))
    e = op.enrich_moments(m, _timeline(spark, sf_dir))
    return e.select("source_id", "moment_id", *(F.array_join(x, ",").alias(x) for x in ("speakers", "people", "seen")), "n_windows", "layout")


_QUESTIONS = "questions as (select source_id, segment_id as question_id, start_us, end_us from segments where speaker = 'user'), stories as (select source_id, source_id || '-Y' || (turn // 4) as story_id, min(start_us) as start_us, max(end_us) as end_us from segments group by 1, 2)"
_FIRST = lambda t: f"(select arg_min({t}_id, start_us) from {{0}} x where {_IN})"


@query(f""", {_QUESTIONS}, c as (select source_id, w as window_id, w * 4000000 as start_us, (w + 1) * 4000000 as end_us from (select source_id, unnest(range(0, max(end_us) // 4000000 + 1)) as w from segments group by 1))
 select c.source_id, window_id, start_us, end_us, coalesce((select string_agg(word, ' ' order by start_us, word_id) from words x where {_WORDS_IN}), '') as text, (select count(*) from words x where {_WORDS_IN}) as n_words, coalesce((select string_agg(segment_id, ',' order by start_us, segment_id) from segments x where {_IN}), '') as segment_ids,
 coalesce((select string_agg(distinct speaker, ',' order by speaker) from voices x where {_IN}), '') as speakers, coalesce((select count(distinct speaker) > 1 from voices x where {_IN}), false) as speech_overlap,
 {_FIRST("scene").format("scene_cells")} as scene_id, {_FIRST("topic").format("topic_cells")} as topic_id, {_FIRST("question").format("questions")} as question_id, {_FIRST("story").format("stories")} as story_id from c""", "words", "scene_cells", "topic_cells", "voices")
def j26_master_timeline(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    g = s.groupBy("source_id").agg(F.max("end_us").alias("e")).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("e div 4000000"))).alias("window_id"))
    windows = g.select("source_id", "window_id", (F.col("window_id") * 4_000_000).alias("start_us"), ((F.col("window_id") + 1) * 4_000_000).alias("end_us"))
    questions = s.where("speaker = 'user'").withColumnRenamed("segment_id", "question_id")
    stories = s.groupBy("source_id", F.concat("source_id", F.lit("-Y"), F.expr("turn div 4")).alias("story_id")).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))
    firsts = {"scene": (d.scene_cells(spark, sf_dir), "scene_id"), "topic": (d.topic_cells(spark, sf_dir), "topic_id"), "question": (questions, "question_id"), "story": (stories, "story_id")}
    return op.master_timeline(windows, d.words(spark, sf_dir), s, firsts, d.voices(spark, sf_dir))


_CAMERA = f"""shots as (select source_id, scene_id as shot_id, case when (start_us // 10000000) % 4 = 3 then 'screen' else 'interview' end as shot_type, start_us, end_us from scene_cells),
 active as (select source_id, speaker, case when speaker = 'user' then 'p0' else 'p1' end as person_id, case when turn % 5 = 4 then 'PROBABLE' else 'CONFIRMED' end as state, start_us, end_us + 1500000 as end_us from segments),
 shown as (select source_id, time_us, list_transform(people, lambda p: {{'person_id': p, 'safe': p <> 'p1' or (time_us // 10000000) % 3 <> 0}}) as people from pictures),
 mids as (select source_id, (time_us + lead(time_us) over (partition by source_id order by time_us)) // 2 as t from (select distinct source_id, time_us from shown)),
 ends as (select distinct b.source_id, greatest(0, least(t, duration_us)) as t from (select source_id, unnest([start_us, end_us]) as t from shots union all select source_id, unnest([start_us, end_us]) from active union all select * from mids where t is not null) b join spans using (source_id) union select source_id, unnest([0, duration_us]) from spans),
 whole as ({_CELLS}), parts as (select *, (end_us - start_us + 999999) // 1000000 as n from whole), cells as (select source_id, start_us + ((end_us - start_us) * k) // n as start_us, start_us + ((end_us - start_us) * (k + 1)) // n as end_us from (select *, unnest(range(n)) as k from parts)),
 m as (select *, (start_us + end_us) // 2 as mid from cells), stood as (select m.*, (select arg_min({{'shot_id': shot_id, 'shot_type': shot_type, 's': start_us, 'e': end_us}}, start_us) from shots x where x.source_id = m.source_id and x.start_us <= mid and mid < x.end_us) as shot,
  coalesce((select list(distinct person_id order by person_id) from active x where x.source_id = m.source_id and x.start_us <= mid and mid < x.end_us and state = 'CONFIRMED'), []) as speaking, (select count(distinct speaker) from active x where x.source_id = m.source_id and x.start_us <= mid and mid < x.end_us) as voices from m),
 sides as (select *, coalesce(shot.s, start_us) as lo, coalesce(shot.e, end_us) as hi, (select max({{'t': time_us, 'people': people}}) from shown p where p.source_id = stood.source_id and p.time_us < mid) as a, (select min({{'t': time_us, 'people': people}}) from shown p where p.source_id = stood.source_id and p.time_us >= mid) as b from stood),
 ok as (select *, case when a.t >= lo and a.t < hi and mid - a.t <= 600000 then a end as a2, case when b.t >= lo and b.t < hi and b.t - mid <= 600000 then b end as b2 from sides),
 near as (select *, case when a2 is null or b2.t - mid < mid - a2.t then b2 else a2 end as f from ok),
 who as (select *, coalesce(list_sort(list_transform(f.people, lambda p: p.person_id)), []) as visible, list_filter(speaking, lambda x: list_contains(coalesce(list_transform(f.people, lambda p: p.person_id), []), x)) as known, row_number() over w > 1 and lag(shot.shot_id) over w is distinct from shot.shot_id as reset, coalesce(shot.shot_type = 'screen', false) as no_person from near window w as (partition by source_id order by start_us)),
 one as (select *, case when len(known) = 1 and voices <= 1 then known[1] end as one from who),
 good as (select *, one is not null and len(list_filter(f.people, lambda p: p.person_id = one and p.safe)) > 0 as safe, len(known) = 2 and len(list_filter(f.people, lambda p: list_contains(known, p.person_id) and not p.safe)) = 0 as both_safe from one),
 camera as (select source_id, start_us, end_us, shot.shot_id as shot_id, f.t as observed_us, visible, case when not no_person then one end as active_person, voices > 1 as overlap, reset as boundary_reset, safe and not no_person and not reset as safe,
  case when no_person or reset then 'full_frame' when voices > 1 and both_safe then 'split_candidate' when one is not null and safe then 'single_person' when len(visible) = 2 then 'two_person' when len(visible) > 2 then 'group' else 'full_frame' end as layout from good)"""
_CAMERA_OF = ("segments", "scene_cells", "pictures", "spans")


def _camera(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    shots = d.scene_cells(spark, sf_dir).select("source_id", F.col("scene_id").alias("shot_id"), F.when(F.expr("(start_us div 10000000) % 4 = 3"), "screen").otherwise("interview").alias("shot_type"), "start_us", "end_us")
    active = s.select("source_id", "speaker", F.when(F.col("speaker") == "user", "p0").otherwise("p1").alias("person_id"), F.when(F.col("turn") % 5 == 4, "PROBABLE").otherwise("CONFIRMED").alias("state"), "start_us", (F.col("end_us") + 1_500_000).alias("end_us"))
    safe = lambda p: (p != "p1") | F.expr("(time_us div 10000000) % 3 <> 0")
    shown = d.pictures(spark, sf_dir).select("source_id", "time_us", F.transform("people", lambda p: F.struct(p.alias("person_id"), safe(p).alias("safe"))).alias("people"))
    return op.camera_windows(d.spans(spark, sf_dir), shots, active, shown)


@query(f", {_CAMERA} select * exclude (visible), array_to_string(visible, ',') as visible from camera", *_CAMERA_OF)
def a8_camera_windows(spark, sf_dir):
    return _camera(spark, sf_dir).withColumn("visible", F.array_join("visible", ","))


_SHARE = lambda k, c: f"least(1.0, coalesce(round(sum(case when {c} then end_us - start_us end)::double / any_value(duration_us), 6), 0)) as {k}_share"


@query(f""", {_CAMERA}, marked as (select *, row_number() over w > 1 and lag(shot_id) over w is not distinct from shot_id and (lag(layout) over w is distinct from layout or lag(active_person) over w is distinct from active_person) as switch from camera window w as (partition by source_id order by start_us))
 select source_id, {_SHARE('timeline', 'true')}, {_SHARE('resolved', 'active_person is not null')}, {_SHARE('editorial', "layout <> 'full_frame'")}, {_SHARE('full_frame', "layout = 'full_frame'")}, {_SHARE('fallback', "layout = 'full_frame' and active_person is null")}, {_SHARE('safe', 'safe')},
 count(*) filter (switch) as switches, round(count(*) filter (switch) * 60000000.0::double / any_value(duration_us), 6) as switches_per_minute from marked join spans using (source_id) group by 1""", *_CAMERA_OF)
def b21_camera_coverage(spark, sf_dir):
    return op.camera_coverage(_camera(spark, sf_dir), d.spans(spark, sf_dir))
