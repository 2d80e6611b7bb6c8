"""Clips of conversations with all that is known about them, participants, shots, proposals and signed captions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dossier as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_CLIPS = """clips as (select source_id, segment_id as clip_id, 0 as alternate, start_us + 1000000 as start_us, start_us + 14000000 as end_us from segments union all select source_id, segment_id, 1, start_us - 3000000, start_us + 5000000 from segments where turn % 3 = 0),
 seen as (select source_id, p as person_id, time_us - 2000000 as start_us, time_us + 2000000 as end_us from (select source_id, time_us, unnest(people) as p from pictures)), loud as (select source_id, turn * 10000000 as start_us, turn * 10000000 + 10000000 as end_us, case when turn % 6 = 5 then null else -20.0 - length(text) % 17 end as rms from segments)"""


def _clips(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    alternate = F.when(F.col("turn") % 3 == 0, F.array(F.struct((F.col("start_us") - 3_000_000).alias("start_us"), (F.col("start_us") + 5_000_000).alias("end_us"))))
    return s.select("source_id", F.col("segment_id").alias("clip_id"), (F.col("start_us") + 1_000_000).alias("start_us"), (F.col("start_us") + 14_000_000).alias("end_us"), alternate.alias("alternates"))


_SET = lambda col, table: f"coalesce((select string_agg(distinct {col}, ',' order by {col}) from {table} x where x.source_id = c.source_id and x.start_us < c.end_us and c.start_us < x.end_us and x.end_us > x.start_us), '')"
_MID = "(x.start_us + x.end_us) // 2"


@query(f""", {_CLIPS}, w as (select c.*, (select {{'n': count(*), 's': round(avg((coalesce(confidence, 0) < 0.6)::int), 6)}} from words x where x.source_id = c.source_id and {_MID} >= c.start_us and {_MID} < c.end_us) as w, (select {{'a': min(turn), 'b': max(turn)}} from segments x where x.source_id = c.source_id and x.start_us < c.end_us and c.start_us < x.end_us and x.end_us > x.start_us) as t from clips c)
 select source_id, clip_id, alternate, start_us, end_us, w.n as n_words, w.s as doubtful_share, {_SET('segment_id', 'segments')} as segment_ids, {_SET('speaker', 'voices')} as speakers, {_SET('person_id', 'seen')} as people, {_SET('scene_id', 'scene_cells')} as scenes, {_SET('topic_id', 'topic_cells')} as topics,
 (select round(sum((least(c.end_us, x.end_us) - greatest(c.start_us, x.start_us))::double * rms) / sum((least(c.end_us, x.end_us) - greatest(c.start_us, x.start_us))::double) filter (rms is not null), 4) from loud x where x.source_id = c.source_id and x.start_us < c.end_us and c.start_us < x.end_us) as rms_dbfs,
 coalesce((select string_agg(segment_id, ',' order by turn) from segments x where x.source_id = c.source_id and x.turn between t.a - 2 and t.a - 1), '') as before, coalesce((select string_agg(segment_id, ',' order by turn) from segments x where x.source_id = c.source_id and x.turn between t.b + 1 and t.b + 2), '') as after from w c""", "words", "voices", "scene_cells", "topic_cells", "pictures")
def j27_clip_dossier(spark, sf_dir):
    s = d.segments(spark, sf_dir).withColumn("pos", F.col("turn"))
    seen = d.pictures(spark, sf_dir).select("source_id", F.explode("people").alias("person_id"), (F.col("time_us") - 2_000_000).alias("start_us"), (F.col("time_us") + 2_000_000).alias("end_us"))
    loud = s.select("source_id", (F.col("turn") * 10_000_000).alias("start_us"), (F.col("turn") * 10_000_000 + 10_000_000).alias("end_us"), F.when(F.col("turn") % 6 != 5, -20.0 - F.length("text") % 17).alias("rms_dbfs"))
    return op.clip_dossier(_clips(spark, sf_dir), d.words(spark, sf_dir), s, d.voices(spark, sf_dir), d.scene_cells(spark, sf_dir), d.topic_cells(spark, sf_dir), seen, loud)


_KINDS = ("lower_third", "banner", "ticker", "logo")


@query(f""", {_CLIPS}, g as (select source_id, start_us + 4000000 as start_us, start_us + 8000000 as end_us, {list(_KINDS)}[(turn % 4 + 1)::int] as kind, length(text) % 3 > 0 as persistent, (length(text) % 10) / 10.0::double as y0, (length(text) % 7) / 20.0::double as y1 from segments)
 select c.source_id, c.clip_id, case when coalesce(bool_or(persistent and kind in ('lower_third', 'ticker') and y0 > 0.4), false) and coalesce(bool_or(persistent and kind = 'banner' and y1 < 0.35), false) then 'dynamic_safe_zone' when bool_or(persistent and kind in ('lower_third', 'ticker') and y0 > 0.4) then 'upper_middle' else 'lower_middle' end as position, count(kind) as n_regions
 from clips c left join g on g.source_id = c.source_id and g.start_us < c.end_us and c.start_us < g.end_us where alternate = 0 group by 1, 2""", "segments", "pictures")
def j32_graphic_zones(spark, sf_dir):
    s, n = d.segments(spark, sf_dir), F.length("text")
    kind = F.array(*map(F.lit, _KINDS))[(F.col("turn") % 4).cast("int")]
    g = s.select("source_id", (F.col("start_us") + 4_000_000).alias("start_us"), (F.col("start_us") + 8_000_000).alias("end_us"), kind.alias("kind"), (n % 3 > 0).alias("persistent"), (n % 10 / 10.0).alias("y_start"), (n % 7 / 20.0).alias("y_end"))
    return op.graphic_zones(_clips(spark, sf_dir), g)


@query(""", p as (select source_id, p as person_id, count(*) * case p when 'p2' then 3.0 else 10.0 end::double as seen_s, count(*) as observations, count(distinct scene_id) as shots from (select source_id, scene_id, unnest(people) as p from pictures) group by 1, 2),
 v as (select source_id, speaker, sum(end_us - start_us) / 1e6::double as speech_s, case when speaker = 'user' then count(*) else 0 end as questions, case when speaker <> 'user' then count(*) else 0 end as answers, case when source_id % 3 = 0 then 'Nome ' || speaker end as possible_name from segments group by 1, 2),
 m as (select source_id, speaker, case when speaker = 'user' then 'p0' when source_id % 2 = 0 then 'p1' end as person_id from v), j as (select v.*, m.person_id from v join m using (source_id, speaker)),
 o as (select source_id, person_id, string_agg(speaker, ',' order by speaker) as speakers, sum(speech_s) as speech_s, sum(questions)::bigint as questions, sum(answers)::bigint as answers, arg_min(possible_name, speaker) filter (possible_name is not null) as possible_name from j where person_id is not null group by 1, 2),
 a as (select p.source_id, p.person_id, coalesce(speakers, '') as speakers, speech_s, coalesce(questions, 0) as questions, coalesce(answers, 0) as answers, possible_name, p.seen_s, p.observations, p.shots from p left join o using (source_id, person_id) union all select source_id, null, speaker, speech_s, questions, answers, possible_name, null, null, null from j where person_id is null),
 s as (select *, coalesce(speech_s, 0) >= 3 as heard, coalesce(seen_s >= 8 and observations >= 12 and (shots >= 2 or seen_s >= 32), false) as clearly_seen, round(coalesce(0.35 * least(1, speech_s / 60), 0) + coalesce(0.25 * least(1, seen_s / 60), 0) + coalesce(0.15 * least(1, shots / 3.0::double), 0) + 0.15 * least(1, (questions + answers) / 3.0::double) + case when possible_name is not null then 0.1 else 0 end, 3) as significance from a)
 select source_id, person_id, speakers, round(speech_s, 6) as speech_s, questions, answers, possible_name, case when questions >= 3 and questions >= greatest(2, answers * 2) then 'likely_host' when answers >= 3 and answers >= greatest(2, questions * 2) then 'likely_guest' else 'unknown' end as role, significance, clearly_seen,
 case when heard then 'confirmed_editorial_participant' when person_id is null then 'insufficient_evidence' when clearly_seen then 'likely_visual_participant' when coalesce(seen_s >= 1, false) then 'background_person' else 'insufficient_evidence' end as status, case when heard and significance >= 0.65 then 'main_participant' when heard then 'editorial_participant' when clearly_seen then 'visual_participant' when coalesce(seen_s >= 1, false) then 'incidental_person' else 'background_person' end as category from s""", "segments", "pictures")
def b31_participants(spark, sf_dir):
    people = d.pictures(spark, sf_dir).select("source_id", "scene_id", F.explode("people").alias("person_id")).groupBy("source_id", "person_id").agg((F.count(F.lit(1)) * F.when(F.col("person_id") == "p2", 3.0).otherwise(10.0)).alias("seen_s"), F.count(F.lit(1)).alias("observations"), F.countDistinct("scene_id").alias("shots"))
    v = d.segments(spark, sf_dir).groupBy("source_id", "speaker").agg((F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("speech_s"), F.count(F.lit(1)).alias("n")).withColumn("questions", F.when(F.col("speaker") == "user", F.col("n")).otherwise(0)).withColumn("answers", F.when(F.col("speaker") != "user", F.col("n")).otherwise(0)).drop("n")
    m = v.select("source_id", "speaker", F.when(F.col("speaker") == "user", "p0").when(F.col("source_id") % 2 == 0, "p1").alias("person_id"))
    names = v.where("source_id % 3 = 0").select("source_id", "speaker", F.concat(F.lit("Nome "), "speaker").alias("possible_name"))
    return op.participants(people, v, m, names).withColumn("speech_s", F.round("speech_s", 6))


@query(""", f as (select source_id, start_us + 2000000 as t, ['p0', 'p1', 'p2'][1:(length(text) % 4)::int] as people, case when length(text) % 5 > 0 then length(text) % 50 / 100.0::double end as face, case when turn % 4 <> 3 then (length(text) % 90 + 10)::double end as sharp, length(text) % 4 = 0 as black from segments),
 g as (select s.source_id, s.scene_id as shot_id, count(f.t) as n, max(len(people)) as most, median(face) as face, avg((face is not null)::int) as share0, median(sharp) as sharp, bool_and(black) as black from scene_cells s left join f on f.source_id = s.source_id and t >= s.start_us and t < s.end_us group by 1, 2), h as (select *, case when n > 0 then share0 end as share, least(1.0::double, sharp / nullif((select median(sharp) from f), 0)) as sh from g)
 select source_id, shot_id, case when n = 0 then 'unknown' when most >= 3 then 'group' when most = 2 then 'two_shot' when most = 1 then case when face is null then 'unknown' when face >= 0.42 then 'close_up' when face >= 0.28 then 'medium_close_up' when face >= 0.12 then 'medium' else 'wide' end when black then 'empty' else 'unknown' end as shot_type, round(share, 6) as face_share, round(sh, 6) as sharpness, round((coalesce(share, 0) + coalesce(sh, 0)) / nullif((share is not null)::int + (sh is not null)::int, 0), 6) as score from h""", "scene_cells")
def b15_shot_features(spark, sf_dir):
    s, n = d.segments(spark, sf_dir), F.length("text")
    people = F.slice(F.array(*map(F.lit, ("p0", "p1", "p2"))), F.lit(1), (n % 4).cast("int"))
    f = s.select("source_id", (F.col("start_us") + 2_000_000).alias("time_us"), people.alias("people"), F.when(n % 5 > 0, n % 50 / 100.0).alias("face_height"), F.when(F.col("turn") % 4 != 3, (n % 90 + 10).cast("double")).alias("sharpness"), (n % 4 == 0).alias("black"))
    return op.shot_features(d.scene_cells(spark, sf_dir).withColumnRenamed("scene_id", "shot_id"), f)


@query(r""", x as (select *, source_id || '-T' || (turn // 5) as topic_id, case turn % 4 when 0 then 'mas ' || text when 1 then text || '.' when 2 then text || '...' else text end as said from segments), c as (select source_id, segment_id as clip_id, turn as a, turn + 1 as b, case turn % 3 when 0 then false end as opening, case turn % 5 when 0 then false end as ending from x),
 k as (select c.*, f.start_us as fs, f.said as ft, l.end_us as le, l.said as lt, p.start_us as ps, p.end_us as pe, p.segment_id as pid, p.topic_id as pt, n.start_us as ns, n.end_us as ne, n.segment_id as nid, n.topic_id as nt, [f.topic_id, l.topic_id] as topics from c join x f on f.source_id = c.source_id and f.turn = a join x l on l.source_id = c.source_id and l.turn = b left join x p on p.source_id = c.source_id and p.turn = a - 1 left join x n on n.source_id = c.source_id and n.turn = b + 1),
 u as (select source_id, clip_id, 'canonical_segment_edges' as kind, fs as start_us, le as end_us, null as added from k union all select source_id, clip_id, 'inspect_preceding_context', ps, le, pid from k where fs - pe between 0 and 5000000 and list_contains(topics, pt) and (regexp_matches(lower(ft), '^(?:que|e|mas|porque|assim|ent[aã]o|a[ií]|inclusive)\b') or coalesce(opening = false, false)) union all select source_id, clip_id, 'inspect_following_continuation', fs, ne, nid from k where ns - le between 0 and 5000000 and list_contains(topics, nt) and (coalesce(ending = false, false) or not regexp_matches(rtrim(lt), '[.!?]$') or regexp_matches(rtrim(lt), '\.\.\.$')))
 select * from u where end_us - start_us between 8000000 and 28000000""", "segments")
def c16_boundary_proposals(spark, sf_dir):
    turn = F.col("turn")
    said = F.when(turn % 4 == 0, F.concat(F.lit("mas "), "text")).when(turn % 4 == 1, F.concat("text", F.lit("."))).when(turn % 4 == 2, F.concat("text", F.lit("..."))).otherwise(F.col("text"))
    s = d.segments(spark, sf_dir).withColumn("topic_id", F.concat("source_id", F.lit("-T"), F.expr("turn div 5"))).withColumn("text", said).withColumn("pos", turn)
    c = s.select("source_id", F.col("segment_id").alias("clip_id"), turn.alias("first_pos"), (turn + 1).alias("last_pos"), F.lit(8_000_000).alias("least_us"), F.lit(28_000_000).alias("most_us"), F.when(turn % 3 == 0, False).alias("clean_opening"), F.when(turn % 5 == 0, False).alias("clean_ending"))
    return op.boundary_proposals(c, s)


@query(""", cap as (select source_id || '-' || (turn // 4) as clip_id, segment_id as caption_id, turn, (turn // 4) * 40000000 as c0, (turn // 4) * 40000000 + 40000000 as c1, case turn % 3 when 0 then ['overlap', 'short'] else ['drift'] end as issues, turn % 19 <> 18 as in_sheet from segments),
 sh as (select source_id || '-' || (turn // 4) as clip_id, segment_id as caption_id, case when length(text) % 23 = 0 then 'REJECTED' else ' approved' end as decision, case when length(text) % 29 = 0 then 'no' else 'yes' end as listened, 'r1' as reviewer, text, start_us, case when length(text) % 31 = 0 then start_us else end_us end as end_us, case turn % 9 when 0 then [] else ['overlap'] end as resolved from segments where turn % 19 <> 18),
 j as (select clip_id, caption_id, c0, c1, s.*  exclude (clip_id, caption_id), issues, s.decision is null as unsigned, max(s.end_us) over (partition by clip_id order by c0, caption_id rows between unbounded preceding and 1 preceding) as before from cap left join sh s using (clip_id, caption_id)),
 e as (select *, case when unsigned then 'not_in_sheet' when upper(trim(decision)) <> 'APPROVED' or upper(trim(listened)) <> 'YES' then 'not_approved_or_not_heard' when trim(text) = '' or length(trim(text)) > 400 or contains(text, '-->') then 'invalid_text' when not (start_us >= c0 and start_us < end_us and end_us <= c1 and (before is null or start_us >= before)) then 'outside_or_out_of_order' when len(list_filter(issues, lambda x: x in ('overlap', 'interrupted') and not list_contains(resolved, x))) > 0 then 'critical_issue_open' end as error from j), f as (select *, bool_and(error is null) over (partition by clip_id) as sound from e)
 select clip_id, caption_id, error, case when sound then start_us - c0 end as local_start_us, case when sound then end_us - c0 end as local_end_us from f""", "segments")
def c24_apply_caption_review(spark, sf_dir):
    s, turn, n = d.segments(spark, sf_dir), F.col("turn"), F.length("text")
    key = [F.concat("source_id", F.lit("-"), F.expr("turn div 4")).alias("clip_id"), F.col("segment_id").alias("caption_id")]
    words = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    caps = s.select(*key, F.expr("(turn div 4) * 40000000").alias("clip_start_us"), F.expr("(turn div 4) * 40000000 + 40000000").alias("clip_end_us"), F.when(turn % 3 == 0, words("overlap", "short")).otherwise(words("drift")).alias("issues"))
    sheet = s.where("turn % 19 <> 18").select(*key, F.when(n % 23 == 0, "REJECTED").otherwise(" approved").alias("decision"), F.when(n % 29 == 0, "no").otherwise("yes").alias("listened"), F.lit("r1").alias("reviewer"), "text", "start_us", F.when(n % 31 == 0, F.col("start_us")).otherwise(F.col("end_us")).alias("end_us"), F.when(turn % 9 == 0, words()).otherwise(words("overlap")).alias("resolved"))
    return op.apply_caption_review(caps, sheet, ("overlap", "interrupted"))


@query(""", w as (select source_id, count(*)::double as a, round(avg((confidence < 0.6)::int), 6) as b from words group by 1), s as (select source_id, count(*)::double as a, count(distinct speaker)::double as b, median(end_us - start_us)::double as c from segments group by 1), p as (select source_id, count(*)::double as a from pictures where len(people) > 2 group by 1), k as (select source_id, w.a as wa, w.b as wb, s.a as sa, s.b as sb, s.c as sc, p.a as pa from spans left join w using (source_id) left join s using (source_id) left join p using (source_id))
 select source_id, unnest(['words.n', 'words.doubtful_share', 'segments.n', 'segments.speakers', 'segments.median_us', 'groups.n']) as metric, unnest([wa, wb, sa, sb, sc, pa]) as value from k""", "words", "pictures", "spans")
def b40_run_metrics(spark, sf_dir):
    one = F.count(F.lit(1))
    tables = {"words": (d.words(spark, sf_dir), {"n": one, "doubtful_share": F.avg((F.col("confidence") < 0.6).cast("int"))}), "segments": (d.segments(spark, sf_dir), {"n": one, "speakers": F.countDistinct("speaker"), "median_us": F.median(F.col("end_us") - F.col("start_us"))}), "groups": (d.pictures(spark, sf_dir).where("size(people) > 2"), {"n": one})}
    return op.run_metrics(tables, d.spans(spark, sf_dir))
