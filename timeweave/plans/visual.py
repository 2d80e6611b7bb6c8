"""Scenes, coverage and gates over events, orders and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..operators import intervals, visual as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


@query("""select source_id, scene_id, unnest(list_distinct(case when end_us - start_us <= 600000000 then [start_us, start_us + (end_us - start_us) // 2, end_us - 1] else [start_us + floor((end_us - start_us) * 0.2::double)::bigint, end_us - floor((end_us - start_us) * 0.2::double)::bigint] end)) as time_us from scenes""", "scenes")
def a16_sample_points(spark, sf_dir):
    return op.sample_points(d.scenes(spark, sf_dir), 600_000_000)


@query("""select distinct s.source_id, s.scene_id as shot_id, p as person_id, lag(s.scene_id) over (partition by s.source_id, p order by s.start_us, s.scene_id) as previous from (select distinct scene_id, source_id, start_us, (scene_id + k) % 4 as p from scenes, range(2) t(k)) s""", "scenes")
def b16_shot_links(spark, sf_dir):
    s = d.scenes(spark, sf_dir).withColumnRenamed("scene_id", "shot_id")
    seen = s.select("source_id", "shot_id", F.explode(F.array(F.col("shot_id") % 4, (F.col("shot_id") + 1) % 4)).alias("person_id"))
    return op.shot_links(s, seen)


@query("select source_id, count(*) as n, round(median(end_us - start_us), 1) as p50, min(end_us - start_us) as shortest, max(end_us - start_us) as longest, count(*) filter (end_us - start_us < 3600000000) as n_micro from scenes group by 1", "scenes")
def b18_shot_metrics(spark, sf_dir):
    return op.shot_metrics(d.scenes(spark, sf_dir), 3_600_000_000)


_UNION = "select source_id, kind as part, sum(greatest(0, end_us - greatest(start_us, coalesce(p, start_us))))::bigint as u from (select *, max(end_us) over (partition by source_id, kind order by start_us, end_us rows between unbounded preceding and 1 preceding) as p from intervals) group by 1, 2"
_SPANS = "spans as (select source_id, max(end_us) - min(start_us) as duration_us from intervals group by 1)"


@query(f", {_SPANS}, u as ({_UNION}) select s.source_id, k.part, u.u as covered_us, round(u.u / nullif(duration_us, 0), 6) as share from spans s cross join (select unnest(['view', 'click']) as part) k left join u on u.source_id = s.source_id and u.part = k.part", "intervals")
def b19_coverage_report(spark, sf_dir):
    i = d.intervals(spark, sf_dir)
    spans = i.groupBy("source_id").agg((F.max("end_us") - F.min("start_us")).alias("duration_us"))
    return op.coverage({k: i.where(F.col("kind") == k) for k in ("view", "click")}, spans)


@query("""select kind as reason, sum(end_us - start_us)::bigint as us, round(sum(end_us - start_us) / sum(sum(end_us - start_us)) over (), 6) as share from intervals where kind <> 'view' group by 1""", "intervals")
def b22_fallback_seconds(spark, sf_dir):
    r = d.intervals(spark, sf_dir).where("kind <> 'view'").groupBy(F.col("kind").alias("reason")).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    return r.withColumn("share", ratio(F.col("us"), F.sum("us").over(Window.partitionBy())))


_BLOCKS = "blocks as (select source_id, moment_id as block_id, start_us, end_us, case when format = 'F' then 'excluded' else 'review' end as state from candidates where moment_id % 10 = 0), own as (select * from candidates where moment_id % 10 <> 0)"


@query(f""", {_BLOCKS}, j as (select c.source_id, c.moment_id, b.block_id, b.state, row_number() over (partition by c.source_id, c.moment_id order by b.state = 'excluded' desc, least(c.end_us, b.end_us) - greatest(c.start_us, b.start_us) desc, b.block_id) as k, count(*) over (partition by c.source_id, c.moment_id) as n from own c join blocks b on c.source_id = b.source_id and c.start_us < b.end_us and b.start_us < c.end_us)
 select o.source_id, o.moment_id, coalesce(j.state, 'eligible') as state, j.block_id, coalesce(j.n, 0) as n_blocks from own o left join j on o.source_id = j.source_id and o.moment_id = j.moment_id and k = 1""", "candidates")
def j14_commercial_overlay(spark, sf_dir):
    c = d.candidates(spark, sf_dir)
    blocks = c.where("moment_id % 10 = 0").select("source_id", F.col("moment_id").alias("block_id"), "start_us", "end_us", F.when(F.col("format") == "F", "excluded").otherwise("review").alias("state"))
    return op.commercial_overlay(c.where("moment_id % 10 <> 0"), blocks)


@query("""with p as (select user_id as source_id, event_id as id, epoch_us(ts) as t from events where event_type = 'view'), kf as (select user_id as source_id, epoch_us(ts) as t, value as v from events where event_type = 'click'),
 j as (select p.*, (select max({'t': t, 'v': v}) from kf where kf.source_id = p.source_id and kf.t <= p.t) as a, (select min({'t': t, 'v': v}) from kf where kf.source_id = p.source_id and kf.t >= p.t) as b from p)
 select source_id, id, round(case when a is null then b.v when b is null or a.t = b.t then a.v else a.v + ((t - a.t)::double / (b.t - a.t)::double) * (b.v - a.v) end, 6) as value from j""")
def w5_interpolate_keyframes(spark, sf_dir):
    return op.interpolate(d.samples(spark, sf_dir, "view"), d.samples(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("""select source_id, moment_id, array_to_string(list_sort(list_distinct(list_filter([case when n_lines = 0 then 'no_evidence' end, case when score < 0.3 then 'low_score' end, case when format = 'P' then 'pending' end], lambda x: x is not null))), ',') as reasons, n_lines > 0 and score >= 0.3 and format <> 'P' as ready from candidates""", "candidates")
def c25_review_plan(spark, sf_dir):
    why = F.array_compact(F.array(F.when(F.col("n_lines") == 0, "no_evidence"), F.when(F.col("score") < 0.3, "low_score"), F.when(F.col("format") == "P", "pending")))
    c = d.candidates(spark, sf_dir).withColumn("why", F.array_sort(why))
    return c.select("source_id", "moment_id", F.array_join("why", ",").alias("reasons"), (F.size("why") == 0).alias("ready"))


@query("""select conv_id as source_id, count(*) filter (role = 'user') as asked, count(*) filter (role <> 'user' and prev = 'user') as answered, round(count(*) filter (role <> 'user' and prev = 'user') / nullif(count(*) filter (role = 'user'), 0), 6) as coverage, round(median(case when role <> 'user' and prev = 'user' then length(text) end), 1) as median_answer from (select *, lag(role) over (partition by conv_id order by turn) as prev from conversations) group by 1""")
def b5_qa_metrics(spark, sf_dir):
    c = d.table(spark, sf_dir, "conversations").withColumn("prev", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    asked, answered = F.count_if(F.col("role") == "user"), F.count_if((F.col("role") != "user") & (F.col("prev") == "user"))
    return c.groupBy(F.col("conv_id").alias("source_id")).agg(asked.alias("asked"), answered.alias("answered"), ratio(answered, asked).alias("coverage"), F.round(F.median(F.when((F.col("role") != "user") & (F.col("prev") == "user"), F.length("text"))), 1).alias("median_answer"))


@query("""with a as (select event_type as kind, user_id % 3 as other, event_id, row_number() over (partition by event_type order by ts, event_id) as r from events) select kind, event_id as id, pick from (select *, row_number() over (order by r, kind) as pick from a) where pick <= 24""")
def t8_review_pairs(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), "ts")
    r = e.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("ts", "id"))).where("r <= 24")
    return r.withColumn("pick", F.row_number().over(Window.orderBy("r", "kind")).cast("long")).where("pick <= 24").select("kind", "id", "pick")


@query("""select source_id, kind, id from (select *, row_number() over (partition by source_id, kind order by value > 10 desc, start_us, id) as k from intervals) where k <= 8""", "intervals")
def t9_speaker_review_windows(spark, sf_dir):
    w = Window.partitionBy("source_id", "kind").orderBy((F.col("value") > 10).desc(), "start_us", "id")
    return d.intervals(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 8").select("source_id", "kind", "id")


@query("""select id, round(0.5 - s * w / 2, 6) as x, round(0.5 - s * h / 2, 6) as y, round(s * w, 6) as width, round(s * h, 6) as height from (select *, least(1 / w, 1 / h) as s from (select event_id as id, round(value % 3, 3) + 0.5 as w, round(value * 7 % 3, 3) + 0.5 as h from events))""")
def f12_contain_box(spark, sf_dir):
    v = F.col("value")
    b = d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.round(v % 3, 3) + 0.5).alias("w"), (F.round(v * 7 % 3, 3) + 0.5).alias("h"))
    s = F.least(1 / F.col("w"), 1 / F.col("h"))
    return b.withColumn("s", s).select("id", F.round(0.5 - F.col("s") * F.col("w") / 2, 6).alias("x"), F.round(0.5 - F.col("s") * F.col("h") / 2, 6).alias("y"), F.round(F.col("s") * F.col("w"), 6).alias("width"), F.round(F.col("s") * F.col("h"), 6).alias("height"))


@query(""", w as (select * from intervals where kind in ('view', 'click')), ends as (select distinct source_id, unnest([start_us, end_us]) as t from w), cells as (select * from (select source_id, t as start_us, lead(t) over (partition by source_id order by t) as end_us from ends) where end_us is not null),
 lit as (select c.source_id, c.start_us, c.end_us, count(*) filter (w.kind = 'view') as v, count(*) filter (w.kind = 'click') as k from cells c join w on w.source_id = c.source_id and w.start_us <= c.start_us and c.start_us < w.end_us group by all)
 select source_id, sum(case when v > 0 and k > 0 then end_us - start_us else 0 end)::bigint as both_us, sum(case when v > 0 and k = 0 then end_us - start_us else 0 end)::bigint as view_us, sum(case when v = 0 and k > 0 then end_us - start_us else 0 end)::bigint as click_us from lit group by 1""", "intervals")
def e5_binding_seconds(spark, sf_dir):
    w = d.intervals(spark, sf_dir).where("kind in ('view', 'click')").select("source_id", "kind", "start_us", "end_us")
    lit = intervals.stab_join(intervals.elementary_grid(w), w, "start_us").groupBy("source_id", "start_us", "end_us").agg(F.count_if(F.col("b_kind") == "view").alias("v"), F.count_if(F.col("b_kind") == "click").alias("k"))
    us = lambda c: F.sum(F.when(c, F.col("end_us") - F.col("start_us")).otherwise(0)).cast("long")
    v, k = F.col("v") > 0, F.col("k") > 0
    return lit.groupBy("source_id").agg(us(v & k).alias("both_us"), us(v & ~k).alias("view_us"), us(~v & k).alias("click_us"))
