"""Interval algebra over events, conversations and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import decibels
from ..operators import intervals as op
from ..sources import derived as d
from ..sources.derived import with_tables
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


def _kind(i, kind):
    return i.where(F.col("kind") == kind).select("source_id", "id", "start_us", "end_us")


@query("select a.source_id, a.id, b.id as other_id, least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us) as overlap_us from intervals a join intervals b on a.source_id = b.source_id and a.kind = 'view' and b.kind = 'click' and a.start_us < b.end_us and b.start_us < a.end_us", "intervals")
def j1_interval_join(spark, sf_dir):
    i = d.intervals(spark, sf_dir)
    j = op.interval_join(_kind(i, "view"), _kind(i, "click"))
    return j.select("source_id", "id", F.col("b_id").alias("other_id"), op.overlap_us(F.col("start_us"), F.col("end_us"), F.col("b_start_us"), F.col("b_end_us")).alias("overlap_us"))


@query("select s.source_id, s.id, i.id as interval_id from samples s join intervals i on s.source_id = i.source_id and i.kind <> 'click' and i.start_us <= s.time_us and s.time_us < i.end_us", "samples", "intervals")
def j2_stab_join(spark, sf_dir):
    i = d.intervals(spark, sf_dir).where("kind <> 'click'").select("source_id", "id", "start_us", "end_us")
    return op.stab_join(d.samples(spark, sf_dir), i).select("source_id", "id", F.col("b_id").alias("interval_id"))


@query("""select s.source_id, s.id, coalesce((select max_by(v.scene_id, (v.start_us, v.scene_id)) from scenes v where v.source_id = s.source_id and v.start_us <= s.time_us),
    (select min_by(v.scene_id, (v.start_us, v.scene_id)) from scenes v where v.source_id = s.source_id)) as scene_id from samples s""", "samples", "scenes")
def j3_asof_prev(spark, sf_dir):
    return op.asof_prev(d.samples(spark, sf_dir), d.scenes(spark, sf_dir), "scene_id").select("source_id", "id", "scene_id")


@query("""select id, source_id, case when p is null or (n is not null and n.t - m < m - p.t) then n.t else p.t end as sample_us, case when p is null or (n is not null and n.t - m < m - p.t) then n.v else p.v end as value from (
  select id, source_id, m, case when p.t >= lo and p.t < hi and abs(p.t - m) <= 7200000000 then p end as p, case when n.t >= lo and n.t < hi and abs(n.t - m) <= 7200000000 then n end as n from (
    select v.id, v.source_id, v.time_us as m, v.time_us - 3600000000 as lo, v.time_us + 5400000000 as hi,
      (select max({'t': s.time_us, 'v': s.value}) from samples s where s.source_id = v.source_id and s.time_us < v.time_us) as p,
      (select min({'t': s.time_us, 'v': s.value}) from samples s where s.source_id = v.source_id and s.time_us >= v.time_us) as n
    from (select user_id as source_id, event_id as id, epoch_us(ts) as time_us from events where event_type = 'view') v))""", "samples")
def j4_nearest_join(spark, sf_dir):
    p = d.samples(spark, sf_dir, "view").drop("value").withColumn("lo_us", F.col("time_us") - 3_600_000_000).withColumn("hi_us", F.col("time_us") + 5_400_000_000)
    return op.nearest_join(p, d.samples(spark, sf_dir), "value", 7_200_000_000).select("source_id", "id", "sample_us", "value")


@query("select w.word_id, w.source_id, (w.start_us + w.end_us) // 2 // 7000000 as window_id from words w", "words")
def j5_midpoint_assign(spark, sf_dir):
    w = d.words(spark, sf_dir)
    windows = w.select("source_id", F.explode(F.sequence(F.expr("start_us div 7000000"), F.expr("end_us div 7000000"))).alias("window_id")).distinct().select("source_id", "window_id", (F.col("window_id") * 7_000_000).alias("start_us"), ((F.col("window_id") + 1) * 7_000_000).alias("end_us"))
    return op.midpoint_assign(w, windows).select("word_id", "source_id", F.col("b_window_id").alias("window_id"))


_TURNS = "turns as (select source_id, kind as speaker, start_us, end_us from intervals where kind <> 'view')"


@query(f""", {_TURNS}, per as (select i.source_id, i.id, i.end_us - i.start_us as len, t.speaker, sum(least(i.end_us, t.end_us) - greatest(i.start_us, t.start_us))::bigint as us, min(t.start_us) as first
  from intervals i join turns t on i.kind = 'view' and i.source_id = t.source_id and i.start_us < t.end_us and t.start_us < i.end_us group by all),
ranked as (select source_id, id, len, list(speaker order by us desc, first, speaker) as who, list(us order by us desc, first, speaker) as us from per group by all)
select i.source_id, i.id as word_id, case when us[1] / len >= 0.5 and coalesce(us[2], 0) < 0.5 * us[1] then who[1] end as speaker, round(us[1] / len, 6) as coverage, array_to_string(who, ',') as candidates
from intervals i left join ranked r using (source_id, id) where i.kind = 'view'""", "intervals")
def j6_assign_speaker(spark, sf_dir):
    i = d.intervals(spark, sf_dir)
    w = _kind(i, "view").withColumnRenamed("id", "word_id")
    return op.assign_speaker(w, i.where("kind <> 'view'")).withColumn("candidates", F.array_join("candidates", ","))


@query("""select source_id, sum(greatest(0, end_us - greatest(start_us, coalesce(prev, start_us))))::bigint as union_us from (select *, max(end_us) over (partition by source_id order by start_us, end_us rows between unbounded preceding and 1 preceding) as prev from intervals) group by 1""", "intervals")
def a1_union_duration(spark, sf_dir):
    return op.union_duration(d.intervals(spark, sf_dir))


@query("""select g.source_id, g.start_us, g.end_us, g.speakers from (
  with ends as (select distinct source_id, unnest([start_us, end_us]) as t from intervals), cells as (select * from (select source_id, t as start_us, lead(t) over (partition by source_id order by t) as end_us from ends) where end_us is not null),
  alive as (select c.source_id, c.start_us, c.end_us, string_agg(distinct i.speaker, ',' order by i.speaker) as speakers, count(distinct i.speaker) as n from cells c join intervals i on c.source_id = i.source_id and i.start_us <= c.start_us and c.start_us < i.end_us group by all having n > 1),
  marked as (select *, case when lag(end_us) over w = start_us and lag(speakers) over w = speakers then 0 else 1 end as fresh from alive window w as (partition by source_id order by start_us)),
  runs as (select *, sum(fresh) over (partition by source_id order by start_us) as r from marked)
  select source_id, r, speakers, min(start_us) as start_us, max(end_us) as end_us from runs group by all) g""", "intervals")
def a2_overlap_intervals(spark, sf_dir):
    return op.overlap_intervals(d.intervals(spark, sf_dir))


@query("""select source_id, min(start_us) as start_us, max(end_us) as end_us, count(*) as members from (select *, sum(fresh) over (partition by source_id order by start_us, end_us rows unbounded preceding) as g from (
  select *, case when start_us <= max(end_us) over (partition by source_id order by start_us, end_us rows between unbounded preceding and 1 preceding) + 600000000 then 0 else 1 end as fresh from intervals)) group by source_id, g""", "intervals")
def a3_merge_islands(spark, sf_dir):
    return op.merge_islands(d.intervals(spark, sf_dir), 600 * op.SECOND)


@query("""select source_id, p as start_us, start_us as end_us from (select *, coalesce(max(end_us) over (partition by source_id order by start_us, end_us rows between unbounded preceding and 1 preceding), 0) as p from (
  select source_id, start_us, end_us from intervals union all select source_id, duration_us, duration_us from durations)) where start_us > p""", "intervals", "durations")
def a4_gaps(spark, sf_dir):
    return op.gaps(d.intervals(spark, sf_dir), d.durations(spark, sf_dir))


_CELLS = "select * from (select source_id, t as start_us, lead(t) over (partition by source_id order by t) as end_us from ends) where end_us is not null"


@query(f", ends as (select distinct source_id, unnest([start_us, end_us]) as t from intervals union select source_id, unnest([0, duration_us]) from durations) {_CELLS}", "intervals", "durations")
def a5_elementary_grid(spark, sf_dir):
    return op.elementary_grid(d.intervals(spark, sf_dir), sources=d.durations(spark, sf_dir))


@query(f""", few as (select * from scenes), base as (select source_id, min(start_us) as b, max(end_us) as e from few group by 1),
frames as (select s.source_id, s.time_us from samples s join base on s.source_id = base.source_id and time_us >= b and time_us < e), mids as (select source_id, (time_us + lead(time_us) over (partition by source_id order by time_us)) // 2 as t from (select distinct * from frames)),
ends as (select distinct source_id, unnest([start_us, end_us]) as t from few union select * from mids where t is not null), cells as ({_CELLS}), parts as (select *, (end_us - start_us + 3599999999) // 3600000000 as n from cells)
select source_id, start_us + ((end_us - start_us) * k) // n as start_us, start_us + ((end_us - start_us) * (k + 1)) // n as end_us from (select *, unnest(range(n)) as k from parts)""", "scenes", "samples")
def a6_camera_grid(spark, sf_dir):
    few = d.scenes(spark, sf_dir)
    base = few.groupBy("source_id").agg(F.min("start_us").alias("b"), F.max("end_us").alias("e"))
    frames = d.samples(spark, sf_dir).join(base, "source_id").where("time_us >= b and time_us < e").select("source_id", "time_us").distinct()
    nxt = F.lead("time_us").over(op.Window.partitionBy("source_id").orderBy("time_us"))
    mids = frames.select("source_id", (F.col("time_us") + nxt).alias("t")).where("t is not null").select("source_id", F.expr("t div 2").alias("start_us"), F.expr("t div 2").alias("end_us"))
    return op.split_long(op.elementary_grid(few, mids), 3600 * op.SECOND)


@query("""select source_id, min(start_us) as start_us, max(end_us) as end_us, any_value(speaker) as speaker, count(*) as n_words, string_agg(word, ' ' order by start_us, word_id) as text from (select *, sum(fresh) over (partition by source_id order by start_us, word_id rows unbounded preceding) as run from (
  select *, case when speaker is not distinct from lag(speaker) over w and segment_id is not distinct from lag(segment_id) over w and row_number() over w > 1 then 0 else 1 end as fresh from words window w as (partition by source_id order by start_us, word_id))) group by source_id, run""", "words")
def a9_speaker_islands(spark, sf_dir):
    return op.speaker_islands(d.words(spark, sf_dir)).drop("run")


@query(f""", span as (select source_id, max(start_us) + 20000000 as duration_us from segments group by 1),
fall as (select source_id, p as start_us, start_us as end_us, 'FALLBACK' as kind from (select *, coalesce(max(end_us) over (partition by source_id order by start_us, end_us rows between unbounded preceding and 1 preceding), 0) as p from (select source_id, start_us, end_us from segments union all select source_id, duration_us, duration_us from span)) where start_us > p),
base as (select source_id, start_us, end_us, 'SCENE' as kind from segments union all select * from fall), shots as (select source_id, start_us + 2500000 as start_us, end_us + 500000 as end_us from segments where speaker = 'user'),
ends as (select distinct b.source_id, greatest(0, least(t, duration_us)) as t from (select source_id, unnest([start_us, end_us]) as t from base union select source_id, unnest([start_us, end_us]) from shots union select source_id, unnest([0, duration_us]) from span) b join span using (source_id)),
cells as ({_CELLS}), parts as (select c.*, b.kind, (c.end_us - c.start_us + 2999999) // 3000000 as n from cells c join base b on c.source_id = b.source_id and b.start_us <= c.start_us and c.start_us < b.end_us)
select source_id, kind, start_us + ((end_us - start_us) * k) // n as start_us, start_us + ((end_us - start_us) * (k + 1)) // n as end_us from (select *, unnest(range(n)) as k from parts)""", "segments")
def a14_scene_windows(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    span = s.groupBy("source_id").agg((F.max("start_us") + 20_000_000).alias("duration_us"))
    shots = s.where("speaker = 'user'").select("source_id", (F.col("start_us") + 2_500_000).alias("start_us"), (F.col("end_us") + 500_000).alias("end_us"))
    return op.scene_windows(s, shots, span)


def _evidence(policy: str, tail: str):
    sql = f""", ends as (select source_id, segment_id, start_us as t from segments union select source_id, segment_id, end_us from segments union select source_id, segment_id, start_us + 4100000 from segments where start_us + 4100000 < end_us),
piece as (select * from (select source_id, segment_id, t as a, lead(t) over (partition by source_id, segment_id order by t) as b from ends) where b is not null), n as (select *, (b - a) // 3000000 as f, (b - a) % 3000000 as r from piece),
w as (select source_id, segment_id, a + k * 3000000 as start_us, a + (k + 1) * 3000000 as end_us, f, r, k, a, b from (select *, unnest(range(f)) as k from n))
{tail}"""
    name = f"a15_evidence_windows_{policy}"

    def f(spark, sf_dir):
        s = d.segments(spark, sf_dir).withColumnRenamed("segment_id", "turn_id")
        edges = s.select("source_id", (F.col("start_us") + 4_100_000).alias("time_us"))
        return op.evidence_windows(s, edges, policy=policy).select("source_id", F.col("turn_id").alias("segment_id"), "start_us", "end_us")

    QUERIES[name], ORACLES[name] = f, with_tables("segments", body=sql)


_REST = "select source_id, segment_id, b - r as start_us, b as end_us from n where r >= 1000000"
_evidence("drop", f"select source_id, segment_id, start_us, end_us from w union all {_REST}")
_evidence("anchor", f"select source_id, segment_id, start_us, end_us from w union all {_REST} union all select source_id, segment_id, b - 3000000, b from n where r > 0 and r < 1000000 and f > 0")
_evidence("balanced", f"""select source_id, segment_id, start_us, end_us from w where not (r > 0 and r < 1000000 and k = f - 1) union all {_REST}
 union all select source_id, segment_id, b - r - 3000000, b - (r + 3000000) // 2 from n where r > 0 and r < 1000000 and f > 0 union all select source_id, segment_id, b - (r + 3000000) // 2, b from n where r > 0 and r < 1000000 and f > 0""")


@query("""select source_id, shot_id, start_us, end_us, state, around from (select *, lag(state) over w as around, lead(state) over w as after from (select user_id as source_id, user_id % 3 as shot_id, epoch_us(ts) as start_us, epoch_us(ts) + round(value * 60e6)::bigint as end_us, event_type as state from events where value > 0) window w as (partition by source_id, shot_id order by start_us))
 where around = after and state <> around and end_us - start_us <= 900000000""")
def a18_aba_interruptions(spark, sf_dir):
    i = d.intervals(spark, sf_dir).select("source_id", (F.col("source_id") % 3).alias("shot_id"), "start_us", "end_us", F.col("kind").alias("state"))
    return op.aba_interruptions(i, 900 * op.SECOND)


@query(""", rows as (select source_id, start_us, end_us, id, row_number() over (partition by source_id order by start_us, end_us, id) as k from intervals where end_us - start_us >= 120000000),
 taken as (with recursive t as (select source_id, start_us, end_us, id, k from rows where k = 1 union all select n.source_id, n.start_us, n.end_us, n.id, n.k from t join lateral (select * from rows r where r.source_id = t.source_id and r.start_us >= t.end_us order by r.k limit 1) n on true) select * from t) select source_id, start_us, end_us, id from taken""", "intervals")
def a19_independent_windows(spark, sf_dir):
    return op.independent_windows(d.intervals(spark, sf_dir), 120 * op.SECOND)


@query("select source_id as clip_id, id, start_us, end_us, sum(end_us - start_us) over (partition by source_id order by start_us rows unbounded preceding)::bigint - (end_us - start_us) as clip_start_us, sum(end_us - start_us) over (partition by source_id order by start_us rows unbounded preceding)::bigint as clip_end_us from intervals", "intervals")
def a20_relative_time(spark, sf_dir):
    i = d.intervals(spark, sf_dir).select(F.col("source_id").alias("clip_id"), "id", "start_us", "end_us")
    return op.relative_time(i)


_LEVELS = "levels as (select user_id as source_id, epoch_us(ts) // 3600000000 as h, round(10 * log10(avg(value * value)), 4) as db, max(abs(value)) as peak, round(avg((abs(value) >= 10)::int), 6) as clipped from events group by 1, 2)"


def _levels(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    # whole hours as SQL's // counts them: towards zero, in whole numbers
    h = F.call_function("div", d.micros("ts"), F.lit(3_600_000_000))
    return e.groupBy(F.col("user_id").alias("source_id"), h.alias("h")).agg(decibels(F.avg(F.col("value") * F.col("value"))).alias("db"), F.max(F.abs("value")).alias("peak"), F.round(F.avg((F.abs("value") >= 10).cast("int")), 6).alias("clipped"))


@query(f"with {_LEVELS} select * from levels")
def b37_level_windows(spark, sf_dir):
    return _levels(spark, sf_dir)


@query(f"""with {_LEVELS}, quiet as (select *, h - row_number() over (partition by source_id order by h) as g from levels where db < 15) select source_id, min(h) * 3600000000 as start_us, (max(h) + 1) * 3600000000 as end_us from quiet group by source_id, g having count(*) >= 2""")
def a21_silence_runs(spark, sf_dir):
    lv = _levels(spark, sf_dir).select("source_id", (F.col("h") * 3_600_000_000).alias("start_us"), ((F.col("h") + 1) * 3_600_000_000).alias("end_us"), "db")
    return op.flag_runs(lv, F.col("db") < 15, 7_200_000_000)


@query("""select d.source_id, coalesce(n_gaps, 0) as n_gaps, coalesce(n_overlaps, 0) as n_overlaps, coalesce(n_long, 0) as n_long, coalesce(n_gaps + n_overlaps + n_long = 0 and lo = 0 and hi = duration_us, false) as tiles from (select source_id, max(start_us) + 10000000 as duration_us from segments group by 1) d left join (
 select source_id, count(*) filter (start_us > prev) as n_gaps, count(*) filter (start_us < prev) as n_overlaps, count(*) filter (end_us - start_us > 8000000) as n_long, min(start_us) as lo, max(end_us) as hi from (select *, lag(end_us) over (partition by source_id order by start_us, end_us) as prev from segments) group by 1) using (source_id)""", "segments")
def a22_tiling_audit(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    return op.tiling_audit(s, s.groupBy("source_id").agg((F.max("start_us") + 10_000_000).alias("duration_us")), 8_000_000)


@query("""select source_id, w, coalesce(n, 0) as n from (select source_id, unnest(range(0, hi + 1)) as w from (select source_id, max(start_us // 60000000) as hi from segments group by 1)) left join (select source_id, start_us // 60000000 as w, count(*) as n from segments group by 1, 2) using (source_id, w)""", "segments")
def b7_scene_density(spark, sf_dir):
    s = d.segments(spark, sf_dir).select("source_id", F.expr("start_us div 60000000").alias("w"))
    every = s.groupBy("source_id").agg(F.max("w").alias("hi")).select("source_id", F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("w"))
    return every.join(s.groupBy("source_id", "w").agg(F.count(F.lit(1)).alias("n")), ["source_id", "w"], "left").fillna(0, ["n"])


@query("""select source_id, kind, round(sum(value * o) / sum(o), 6) as level, sum(o)::bigint as covered_us from (select c.source_id, c.id, c.kind, l.value, least(c.end_us, l.end_us) - greatest(c.start_us, l.start_us) as o from intervals c join intervals l on c.source_id = l.source_id and c.kind in ('view', 'click') and l.kind = 'error' and c.start_us < l.end_us and l.start_us < c.end_us) group by 1, 2""", "intervals")
def b35_clip_audio_quality(spark, sf_dir):
    i = d.intervals(spark, sf_dir)
    j = op.interval_join(i.where("kind in ('view', 'click')").select("source_id", "id", "kind", "start_us", "end_us"), i.where("kind = 'error'").select("source_id", "start_us", "end_us", "value"))
    o = op.overlap_us(F.col("start_us"), F.col("end_us"), F.col("b_start_us"), F.col("b_end_us"))
    return j.groupBy("source_id", "kind").agg(F.round(F.sum(F.col("b_value") * o) / F.sum(o), 6).alias("level"), F.sum(o).alias("covered_us"))


@query("select distinct source_id, t from (select source_id, start_us as t from segments union select source_id, end_us from segments)", "segments")
def u1_union(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    return s.select("source_id", F.col("start_us").alias("t")).union(s.select("source_id", "end_us")).distinct()


@query("select o_custkey as key from orders except select c_custkey from customer where c_custkey % 3 = 0")
def u2_except(spark, sf_dir):
    return d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct().join(d.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0"), F.col("key") == F.col("c_custkey"), "left_anti")


@query("select o_custkey as key from orders intersect select c_custkey from customer where c_custkey % 3 = 0")
def u3_intersect(spark, sf_dir):
    return d.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).intersect(d.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey"))
