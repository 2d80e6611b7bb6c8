"""Who speaks on screen, over conversations: turns of which every third runs into the next, four frames a turn, and windows of mouth and voice made from the length of the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import speaking as op
from ..operators.lineage import cut
from ..operators.signals import lag_consistency
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_DATA = """t as (select source_id, speaker, start_us, end_us + case when turn % 3 = 0 then 3000000 else 0 end as end_us from segments),
 cand as (select source_id, segment_id as window_id, speaker, 'p' || k as person_id, start_us, end_us, turn % 13 = 12 as overlap, case when n % 29 = 28 then null else round(case when (speaker = 'user') = (k = 0) then 0.55 + (n % 45) / 100.0::double else (n % 90) / 100.0::double - 0.45 end, 2) end as correlation, round((n % 70) / 100.0::double - 0.05, 2) as lower_bound, case when n % 5 = 0 then null else round((n % 60) / 100.0::double - 0.1, 2) end as upper_bound,
  ((n + k) % 26 - 13) * 10000 as lag_us, 6 + n % 20 as sample_count, case when k = 0 then round(0.45 + (turn % 6) / 10.0::double, 2) end as track_stability, case when n % 4 > 0 then round(0.5 + (n % 6) / 10.0::double, 2) end as visibility, case when turn % 2 = 0 then 0.7::double end as face_fraction from (select *, length(text) as n from segments), range(2) r(k)),
 manual as (select source_id, speaker, 'p' || k as person_id, start_us, end_us from segments, range(2) r(k) where (turn + source_id) % 17 = 5 and k = 1 or (turn + source_id) % 17 = 6),
 shots as (select source_id, f.time_us + start_us as time_us, turn, k from segments, (values (0, 1000000), (1, 3500000), (2, 4400000), (3, 7000000)) f(k, time_us)),
 seen as (select source_id, time_us, 'p' || p as person_id, (turn + k + p) % 3 <> 0 as face_visible from shots, range(2) q(p) where (turn + p * k) % 4 <> 1)"""


def _data(spark, sf_dir):
    """turns, candidates, manual, frames, sightings, scenes."""
    s, n, turn = d.segments(spark, sf_dir), F.length("text"), F.col("turn")
    turns = s.select("source_id", "speaker", "start_us", (F.col("end_us") + F.when(turn % 3 == 0, 3_000_000).otherwise(0)).alias("end_us"))
    k = F.col("k")
    two = s.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    person = F.concat(F.lit("p"), "k")
    fits = (F.col("speaker") == "user") == (k == 0)
    cand = two.select("source_id", F.col("segment_id").alias("window_id"), "speaker", person.alias("person_id"), "start_us", "end_us", (turn % 13 == 12).alias("overlap"), F.when(n % 29 != 28, F.round(F.when(fits, 0.55 + n % 45 / 100.0).otherwise(n % 90 / 100.0 - 0.45), 2)).alias("correlation"), F.round(n % 70 / 100.0 - 0.05, 2).alias("lower_bound"), F.when(n % 5 != 0, F.round(n % 60 / 100.0 - 0.1, 2)).alias("upper_bound"), (((n + k) % 26 - 13) * 10_000).cast("long").alias("lag_us"), (6 + n % 20).alias("sample_count"), F.when(k == 0, F.round(0.45 + turn % 6 / 10.0, 2)).alias("track_stability"), F.when(n % 4 > 0, F.round(0.5 + n % 6 / 10.0, 2)).alias("visibility"), F.when(turn % 2 == 0, 0.7).alias("face_fraction"))
    at = (turn + F.col("source_id")) % 17
    manual = two.where((at == 5) & (k == 1) | (at == 6)).select("source_id", "speaker", person.alias("person_id"), "start_us", "end_us")
    shots = s.select("source_id", "turn", F.posexplode(F.transform(F.array(*map(F.lit, (1_000_000, 3_500_000, 4_400_000, 7_000_000))), lambda x: x + F.col("start_us"))).alias("k", "time_us"))
    seen = shots.withColumn("p", F.explode(F.array(F.lit(0), F.lit(1)))).where("(turn + p * k) % 4 <> 1").select("source_id", "time_us", F.concat(F.lit("p"), "p").alias("person_id"), ((turn + k + F.col("p")) % 3 != 0).alias("face_visible"))
    return turns, cand, manual, shots.select("source_id", "time_us"), seen, d.scene_cells(spark, sf_dir)


_CONSENSUS = f"""{_DATA}, mixed as (select distinct c.source_id, c.window_id from cand c join t on t.source_id = c.source_id and t.speaker <> c.speaker and t.start_us < c.end_us and t.end_us > c.start_us),
 ev as (select c.*, round(greatest(-1, least(1, correlation * coalesce(track_stability, 1))), 6) as score, round(least(1, greatest(0, coalesce(face_fraction, 1))) * least(1, greatest(0, coalesce(visibility, 1))), 6) as visual, coalesce(upper_bound < 0, true) as denies, coalesce((select sum(least(t.end_us, c.end_us) - greatest(t.start_us, c.start_us)) from t where t.source_id = c.source_id and t.speaker = c.speaker and t.start_us < c.end_us and t.end_us > c.start_us), 0) as s
  from cand c where correlation is not null and not overlap and not coalesce(lower_bound <= 0 and correlation >= 0, false) and end_us - start_us >= 500000 and not exists (select 1 from mixed m where m.source_id = c.source_id and m.window_id = c.window_id)),
 votes as (select source_id, speaker, person_id, count(*) as n_windows, count(*) filter (score >= 0.55 and s >= 500000) as n_for, count(*) filter (score <= -0.2 and denies) as n_against, count(*) filter (score <= -0.2 and not denies) as n_weak, round(greatest(0, sum(case when score >= 0.55 and s >= 500000 then s / 1e6::double * score * visual when score <= -0.2 and denies then s / 1e6::double * score else 0 end)), 6) as weight, coalesce(sum(s) filter (score >= 0.55 and s >= 500000), 0)::bigint as support_us, round(avg(score) filter (score >= 0.55 and s >= 500000), 6) as mean from ev group by 1, 2, 3),
 ranked as (select *, row_number() over w as place, lead(weight) over w as next, sum(weight) over (partition by source_id, speaker) as total, count(*) over (partition by source_id, speaker) as pairs from votes window w as (partition by source_id, speaker order by weight desc, person_id)),
 top as (select *, case when total > 0 then round(weight / total, 6) else 0 end as share from ranked where place = 1), ok as (select *, n_for >= 2 and share >= 0.67 and n_against < n_for and weight > 0 and (next is null or weight > next) as ok from top),
 clash as (select distinct a.source_id, a.speaker from ok a join ok b on a.source_id = b.source_id and a.person_id = b.person_id and a.speaker <> b.speaker join t x on x.source_id = a.source_id and x.speaker = a.speaker join t y on y.source_id = b.source_id and y.speaker = b.speaker and x.start_us < y.end_us and y.start_us < x.end_us where a.ok and b.ok),
 consensus as (select v.source_id, v.speaker, case when coalesce(ok, false) and c.speaker is null then person_id end as person_id, case when coalesce(ok, false) and c.speaker is null then round(least(1, share * mean), 6) end as confidence, coalesce(share, 0)::double as share, coalesce(n_for, 0) as n_for, coalesce(n_against, 0) as n_against, coalesce(weight, 0)::double as weight,
  case when c.speaker is not null then 'simultaneous_speaker_person_conflict' when ok is null then 'insufficient_independent_evidence' when ok then null when pairs > 1 and share < 0.67 then 'ambiguous_global_affinity' else 'insufficient_independent_evidence' end as reason from (select distinct source_id, speaker from t) v left join ok using (source_id, speaker) left join clash c on c.source_id = v.source_id and c.speaker = v.speaker)"""


@query(f", {_CONSENSUS} select * from consensus", "segments")
def b28_speaker_consensus(spark, sf_dir):
    turns, cand, *_ = _data(spark, sf_dir)
    return op.speaker_consensus(cand, turns)


_REASONS = "list_filter([case when correlation is null or correlation < 0.55 then 'a' end, case when sample_count < 8 then 'b' end, case when coalesce(track_stability, 1) < 0.5 then 'c' end, case when coalesce(visibility, 1) < 0.6 then 'd' end, case when coalesce(face_fraction, 1) < 0.6 then 'e' end, case when coalesce(lower_bound, 0) <= 0 then 'f' end, case when abs(lag_us) > 120000 then 'g' end], lambda x: x is not null)"
_CLEAR = "coalesce(len({r}) = 0 and not {o} and ((select max(b.correlation) from cand b where b.source_id = a.source_id and b.window_id = a.window_id and b.person_id <> a.person_id) is null or round(a.correlation - (select max(b.correlation) from cand b where b.source_id = a.source_id and b.window_id = a.window_id and b.person_id <> a.person_id), 6) >= 0.1), false)".format
_CELLS = f"""{_CONSENSUS}, cr as (select a.*, {_REASONS} as reasons, exists (select 1 from mixed m where m.source_id = a.source_id and m.window_id = a.window_id) as mix from cand a),
 q as (select a.*, {_CLEAR(r='reasons', o='a.overlap')} as fine, {_CLEAR(r='reasons', o='(a.overlap or mix)')} as local from cr a),
 md as (select q.source_id, q.speaker, median(lag_us) as m from q join consensus c using (source_id, speaker, person_id) where fine and end_us - start_us >= 500000 group by 1, 2),
 lag as (select q.source_id, q.speaker, count(*) >= 2 and max(abs(lag_us)) <= 120000 and max(abs(lag_us - m)) <= 100000 as consistent from q join consensus c using (source_id, speaker, person_id) join md on md.source_id = q.source_id and md.speaker = q.speaker where fine and end_us - start_us >= 500000 group by 1, 2),
 f0 as (select source_id, time_us, lag(time_us) over (partition by source_id order by time_us) as before, lead(time_us) over (partition by source_id order by time_us) as after from (select distinct source_id, time_us from shots)),
 f1 as (select f0.source_id, f0.time_us, sc.scene_id, greatest(time_us - 600000, coalesce((before + time_us) // 2, time_us - 600000), coalesce(sc.start_us, time_us - 600000)) as start_us, least(time_us + 600000, coalesce((time_us + after) // 2, time_us + 600000), coalesce(sc.end_us, time_us + 600000)) as end_us from f0 left join scene_cells sc on sc.source_id = f0.source_id and sc.start_us <= f0.time_us and f0.time_us < sc.end_us),
 reign as (select f1.*, coalesce((select list(distinct person_id) from seen where seen.source_id = f1.source_id and seen.time_us = f1.time_us), []) as people, coalesce((select list(distinct person_id) from seen where seen.source_id = f1.source_id and seen.time_us = f1.time_us and face_visible), []) as faces from f1 where end_us > start_us),
 bounds as (select source_id, start_us, end_us from t union all select source_id, start_us, end_us from cand union all select source_id, start_us, end_us from manual union all select source_id, start_us, end_us from reign),
 points as (select source_id, unnest([start_us, end_us]) as x from bounds union select source_id, unnest(range(0, 600000000, 500000)) from (select distinct source_id from t)),
 grid as (select source_id, x as start_us, lead(x) over (partition by source_id order by x) as end_us from points),
 cell as (select g.source_id, g.start_us, g.end_us, g.start_us + (g.end_us - g.start_us) // 2 as mid, list_sort(list(distinct t.speaker)) as speakers from grid g join t on t.source_id = g.source_id and t.start_us <= g.start_us and g.start_us < t.end_us group by 1, 2, 3),
 vc as (select c.*, unnest(speakers) as speaker, len(speakers) as n from cell c),
 j0 as (select vc.*, r.time_us as observed_us, r.people, r.faces, r.scene_id, (select list(distinct m.person_id) from manual m where m.source_id = vc.source_id and m.speaker = vc.speaker and m.start_us <= vc.start_us and vc.start_us < m.end_us) as told, exists (select 1 from cand c where c.source_id = vc.source_id and c.speaker = vc.speaker and c.start_us <= vc.start_us and vc.start_us < c.end_us) as heard, s.person_id as prior, s.confidence as prior_confidence, s.reason as prior_reason, coalesce(lag.consistent, false) as stable
  from vc left join reign r on r.source_id = vc.source_id and r.start_us <= vc.start_us and vc.start_us < r.end_us left join consensus s on s.source_id = vc.source_id and s.speaker = vc.speaker left join lag on lag.source_id = vc.source_id and lag.speaker = vc.speaker),
 j1 as (select * exclude (prior_confidence), case when len(told) = 1 then told[1] when len(told) > 1 then null else prior end as mapped, case when len(told) = 1 then 1.0 when len(told) > 1 then null else prior_confidence end as pc, case when len(told) = 1 then 'user_verified' when len(told) > 1 then 'conflicting_manual_mapping' when prior is not null then 'consensus_continuity' else 'unresolved' end as method0 from j0),
 j2 as (select *, coalesce(list_contains(faces, mapped), false) as valid, exists (select 1 from seen where seen.source_id = j1.source_id and seen.person_id = mapped) as known from j1),
 j3 as (select *, case when not known then coalesce(case when len(told) > 1 then 'conflicting_manual_mapping' when prior_reason = 'simultaneous_speaker_person_conflict' then prior_reason end, 'insufficient_consensus') when not valid then 'mapped_person_not_visually_available' end as unresolved from j2),
 j4 as (select *, case when unresolved is null then mapped end as person_id from j3),
 j5 as (select *, case when person_id is not null and n = 1 then (select arg_max(q.lag_us, (q.correlation, q.window_id)) from q where q.local and q.source_id = j4.source_id and q.speaker = j4.speaker and q.person_id = j4.person_id and q.start_us <= j4.start_us and j4.start_us < q.end_us) end as lag_us from j4),
 j6 as (select *, exists (select 1 from reign r where r.source_id = j5.source_id and r.start_us <= mid - lag_us and mid - lag_us < r.end_us and r.scene_id is not distinct from j5.scene_id and list_contains(r.faces, j5.person_id)) as there from j5),
 j7 as (select *, coalesce(person_id is not null and (method0 = 'user_verified' and valid or n = 1 and there and stable and pc >= 0.7), false) as confirmed, case when n > 1 then 'MULTIPLE_SPEAKERS' when person_id is not null then 'KNOWN_PERSON' when observed_us is null then 'INSUFFICIENT_EVIDENCE' when len(people) = 0 or coalesce(unresolved = 'mapped_person_not_visually_available', false) then 'OFFSCREEN_SPEAKER' when heard or prior is not null then 'UNKNOWN_PERSON' else 'NO_CLEAR_SPEAKER' end as state from j6),
 j8 as (select *, case when confirmed then 'CONFIRMED' when state = 'OFFSCREEN_SPEAKER' then 'OFFSCREEN' when person_id is not null and n = 1 then 'PROBABLE' else 'UNCERTAIN' end as active_state from j7),
 cells as (select source_id, start_us, end_us, speaker, n > 1 as overlap, person_id, case when confirmed then person_id end as active_person, case when person_id is not null then pc end as confidence, case when person_id is not null then method0 else 'unresolved' end as method, state, active_state, case when observed_us is null then 'NO_CONTEMPORARY_FRAME' when valid then 'MAPPED_FACE_VISIBLE' when len(people) > 0 then 'VISIBLE_OTHER_PERSON_OR_WIDE_SHOT' else 'NO_FACE_RESOLVED' end as visual_state,
  case when method0 = 'user_verified' and valid and person_id is not null then 'user_verified' when confirmed then 'contemporary_mouth_audio_and_temporal_consensus' when n > 1 then 'simultaneous_audio_ambiguous' when person_id is not null and not there then case when lag_us is not null then 'no_same_shot_face_at_lag_adjusted_time' else 'no_contemporary_bounded_mouth_audio_evidence' end when person_id is not null and not stable then 'insufficient_or_inconsistent_temporal_consensus' when active_state = 'PROBABLE' then 'global_identity_prior_not_local_speech' when active_state = 'OFFSCREEN' then 'mapped_person_offscreen' else coalesce(unresolved, state) end as reason, unresolved, observed_us, abs(mid - observed_us) as age_us from j8)"""


def _all(spark, sf_dir):
    """cells, turns, candidates, manual, sightings, consensus, lags."""
    turns, cand, manual, frames, seen, scenes = _data(spark, sf_dir)
    consensus = cut(op.speaker_consensus(cand, turns))
    lags = lag_consistency(cand, consensus.select("source_id", "speaker", "person_id").where("person_id is not null"))
    return op.active_speaker(turns, frames, seen, scenes, cand, manual, consensus, lags), turns, cand, manual, seen, consensus, lags


def _cells(spark, sf_dir):
    return _all(spark, sf_dir)[:2]


_STATE = ", ".join(op.STATE)
_SAME = " and ".join(f"{x} is not distinct from lag({x}) over w" for x in op.STATE)


@query(f""", {_CELLS}, mark as (select *, case when start_us = lag(end_us) over w and {_SAME} then 0 else 1 end as fresh from cells window w as (partition by source_id, speaker order by start_us)), run as (select *, sum(fresh) over (partition by source_id, speaker order by start_us) as run from mark)
 select source_id, speaker, {_STATE}, min(start_us) as start_us, max(end_us) as end_us from run group by source_id, speaker, run, {_STATE}""", "segments", "scene_cells")
def b28_active_speaker_intervals(spark, sf_dir):
    return op.active_speaker_intervals(_cells(spark, sf_dir)[0])


@query(f""", {_CELLS}, sp as (select source_id, sum(greatest(0, end_us - greatest(start_us, coalesce(before, start_us))))::bigint as speech_us from (select *, max(end_us) over (partition by source_id order by start_us, end_us rows between unbounded preceding and 1 preceding) as before from t) group by 1),
 m as (select source_id, start_us, end_us, bool_or(person_id is not null) as known, bool_or(active_state = 'CONFIRMED') as confirmed, bool_or(active_state = 'PROBABLE') as probable, bool_or(state = 'OFFSCREEN_SPEAKER') as offscreen, bool_or(person_id is null) as unknown, bool_or(overlap and active_person is null) as ambiguous, bool_or(visual_state = 'NO_CONTEMPORARY_FRAME') as unframed from cells group by 1, 2, 3),
 u as (select source_id, {', '.join(f"coalesce(sum(end_us - start_us) filter ({k}), 0)::bigint as {k}_us" for k in ('known', 'confirmed', 'probable', 'offscreen', 'unknown', 'ambiguous', 'unframed'))} from m group by 1),
 a as (select source_id, list_sort(list(age_us)) as ages from cells where age_us is not null group by 1)
 select sp.source_id, speech_us, {', '.join(f"round({k}_us / nullif(speech_us, 0)::double, 6) as {k}_share" for k in ('known', 'confirmed', 'probable', 'offscreen', 'unknown'))}, ambiguous_us, unframed_us, {', '.join(f"ages[1 + floor((len(ages) - 1) * {q})::int] as age_p{int(q * 100)}_us" for q in (0.25, 0.5, 0.75, 0.95))} from sp left join u using (source_id) left join a using (source_id)""", "segments", "scene_cells")
def b28_active_speaker_metrics(spark, sf_dir):
    cells, turns = _cells(spark, sf_dir)
    return op.active_speaker_metrics(cells, turns)


@query(f""", {_CELLS}, obs as (select seen.*, person_id || '-' || (time_us // 5000000 % 3) as track_id, time_us // 100000 % 4 <> 1 as mouth, time_us // 1000000 % 2 = 0 as embedded from seen),
 once as (select t.source_id, t.speaker, o.time_us, o.person_id, o.track_id, bool_or(o.face_visible) as face, bool_or(o.mouth) as mouth, bool_or(o.embedded) as embedded from t join obs o on o.source_id = t.source_id and o.time_us >= t.start_us and o.time_us < t.end_us group by 1, 2, 3, 4, 5),
 s as (select source_id, speaker, count(*) as seen, count(*) filter (face) as faces, count(*) filter (face and mouth) as mouths, count(*) filter (face and embedded) as embedded, count(distinct person_id) as people, count(distinct track_id) as tracks from once group by 1, 2),
 w as (select source_id, speaker, bool_or(overlap) as mixed, bool_or(coalesce(track_stability < 0.5, false)) as shaky from cand group by 1, 2), ct as (select source_id, speaker, count(*) filter (active_state = 'CONFIRMED') as confirmed, count(*) filter (active_state = 'PROBABLE') as probable, count(*) filter (active_state = 'OFFSCREEN') as offscreen from cells group by 1, 2),
 sp as (select source_id, speaker, sum(greatest(0, end_us - greatest(start_us, coalesce(before, start_us))))::bigint as speech_us from (select *, max(end_us) over (partition by source_id, speaker order by start_us, end_us rows between unbounded preceding and 1 preceding) as before from t) group by 1, 2),
 lg as (select q.source_id, q.speaker, count(*) as n from q join consensus c using (source_id, speaker, person_id) where fine and end_us - start_us >= 500000 group by 1, 2),
 j as (select c.source_id, c.speaker, c.person_id, c.reason, speech_us, coalesce(seen, 0) as seen, coalesce(faces, 0) as faces, coalesce(mouths, 0) as mouths, coalesce(embedded, 0) as embedded, coalesce(people, 0) as people, coalesce(tracks, 0) as tracks, coalesce(confirmed, 0) as confirmed, coalesce(probable, 0) as probable, coalesce(offscreen, 0) as offscreen, mixed, shaky, coalesce(lg.n, 0) >= 2 as measured, coalesce(lag.consistent, false) as consistent from consensus c left join s using (source_id, speaker) left join w using (source_id, speaker) left join ct using (source_id, speaker) left join sp using (source_id, speaker) left join lg using (source_id, speaker) left join lag using (source_id, speaker))
 select source_id, speaker, array_to_string(list_sort(list_filter([case when seen = 0 then 'NO_VISUAL_OVERLAP' end, case when faces = 0 then 'INSUFFICIENT_FACE_OBSERVATION' end, case when mouths = 0 then 'MOUTH_SIGNAL_UNAVAILABLE' end, case when embedded = 0 then 'EMBEDDING_UNAVAILABLE' end, case when tracks > 2 * people then 'TRACK_FRAGMENTATION' end, case when reason = 'ambiguous_global_affinity' then 'MULTIPLE_CANDIDATES' end, case when reason = 'simultaneous_speaker_person_conflict' then 'SIMULTANEOUS_CONFLICT' end, case when mixed then 'OVERLAPPING_AUDIO_UNATTRIBUTABLE' end, case when offscreen > 0 then 'OFFSCREEN_SPEAKER' end, case when shaky then 'SHOT_INSTABILITY' end,
  case when person_id is null and coalesce(reason, '') not in ('ambiguous_global_affinity', 'simultaneous_speaker_person_conflict') then 'LOW_AFFINITY' end, case when measured and not consistent then 'AUDIO_VIDEO_LAG_INCONSISTENT' end, case when person_id is not null and not consistent then 'CONTEMPORARY_SYNC_NOT_VERIFIED' end, case when probable > 0 then 'GLOBAL_IDENTITY_NOT_CURRENT_SPEECH' end], lambda x: x is not null)), ',') as reasons, speech_us, seen, faces, mouths, people, tracks, confirmed, probable, offscreen from j""", "segments", "scene_cells")
def b30_speaker_diagnostics(spark, sf_dir):
    cells, turns, cand, _, seen, consensus, lags = _all(spark, sf_dir)
    track = F.concat_ws("-", "person_id", F.expr("time_us div 5000000 % 3"))
    obs = seen.select("source_id", "time_us", "person_id", track.alias("track_id"), "face_visible", F.expr("time_us div 100000 % 4 <> 1").alias("mouth"), F.expr("time_us div 1000000 % 2 = 0").alias("embedded"))
    return op.speaker_diagnostics(turns, obs, cand, consensus, cells, lags).withColumn("reasons", F.array_join("reasons", ","))


@query(f""", {_CONSENSUS}, g as (select c.source_id, c.speaker, c.window_id, c.start_us, c.end_us, bool_or(overlap) as overlap, bool_or(coalesce(lower_bound > 0, false)) as bounded, bool_and(correlation is null or correlation < 0.55) as low, bool_or(coalesce(c.person_id = s.person_id, false)) as local, max(s.person_id) as mapped from cand c left join consensus s on s.source_id = c.source_id and s.speaker = c.speaker group by 1, 2, 3, 4, 5),
 k as (select *, case when exists (select 1 from manual m where m.source_id = g.source_id and m.speaker = g.speaker and m.start_us = g.start_us and m.end_us = g.end_us) then 'USER_VERIFIED' when overlap then 'OVERLAPPING_AUDIO' when not bounded then 'NO_BOUNDED_POSITIVE_SYNC' when mapped is null and low then 'CORRELATION_BELOW_CONSENSUS_MINIMUM' when mapped is null then 'NO_ACCEPTED_GLOBAL_MAPPING' when not local then 'MAPPED_PERSON_NOT_IN_LOCAL_CANDIDATES' else 'BOUNDED_SYNC_CANDIDATE' end as code from g)
 select * from (select source_id, speaker, window_id, start_us, end_us, code, row_number() over (partition by source_id, speaker order by start_us, end_us, window_id)::int as place from k where code <> 'BOUNDED_SYNC_CANDIDATE') where place <= 16""", "segments")
def b30_review_windows(spark, sf_dir):
    turns, cand, manual, *_ = _data(spark, sf_dir)
    return op.review_windows(op.window_codes(cand, manual, op.speaker_consensus(cand, turns)))
