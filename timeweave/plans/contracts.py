"""Contracts between collections, gates, counts and rollups over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.numbers import ratio
from ..operators import audit, identity, intervals
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


def _t(spark, sf_dir, name):
    return d.table(spark, sf_dir, name)


@query("select word_id, case when confidence * 1.3 - 0.1 between 0 and 1 then confidence * 1.3 - 0.1 end as confidence, confidence * 1.3 - 0.1 as raw from words", "words")
def n3_sanitize_confidence(spark, sf_dir):
    raw = F.col("confidence") * 1.3 - 0.1
    return d.words(spark, sf_dir).select("word_id", numbers.unit_or_null(raw).alias("confidence"), raw.alias("raw"))


@query("select id, start_us >= 0 and start_us < end_us - 300000000 as ok from intervals", "intervals")
def n5_valid_interval(spark, sf_dir):
    return d.intervals(spark, sf_dir).select("id", numbers.valid_interval(F.col("start_us"), F.col("end_us") - 300_000_000).alias("ok"))


_GAP = "g as (select vec_id, label, case when vec_id % 13 = 0 then 'too_small' when embedding[1] < -0.2 then 'blurred' when len(embedding) < 2 then 'no_vector' end as reason, vec_id % 3 = 0 as micro from embeddings)"


def _gaps(spark, sf_dir):
    why = F.when(F.col("vec_id") % 13 == 0, "too_small").when(F.get("embedding", F.lit(0)) < -0.2, "blurred").when(F.size("embedding") < 2, "no_vector")
    return _t(spark, sf_dir, "embeddings").select("vec_id", "label", why.alias("reason"), (F.col("vec_id") % 3 == 0).alias("micro"))


@query(f"with {_GAP} select vec_id as track_id, coalesce(reason, 'usable') as category from g")
def n16_embedding_gap_category(spark, sf_dir):
    return _gaps(spark, sf_dir).select(F.col("vec_id").alias("track_id"), F.coalesce("reason", F.lit("usable")).alias("category"))


@query(f"with {_GAP} select coalesce(reason, 'usable') as category, count(*) filter (micro) as n_micro, count(*) filter (not micro) as n_stable, round(count(*) / sum(count(*)) over (), 6) as share from g group by 1")
def b14_embedding_gap_audit(spark, sf_dir):
    g = _gaps(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("usable")).alias("category")).agg(F.count_if("micro").alias("n_micro"), F.count_if(~F.col("micro")).alias("n_stable"), F.count(F.lit(1)).alias("n"))
    return g.select("category", "n_micro", "n_stable", ratio(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share"))


_COLLECTIONS = "c as (select conv_id || '-' || turn as id, 1 as precedence, 'turns' as origin, text from conversations where turn % 2 = 0 union all select conv_id || '-' || turn, 2, 'review', 'R:' || text from conversations where turn % 3 = 0), links as (select distinct conv_id || '-' || (turn + 1) as id from conversations where turn % 4 = 0)"


def _collections(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    name = lambda k=0: F.concat_ws("-", "conv_id", F.col("turn") + k)
    one = c.where("turn % 2 = 0").select(name().alias("id"), F.lit(1).alias("precedence"), F.lit("turns").alias("origin"), "text")
    two = c.where("turn % 3 = 0").select(name().alias("id"), F.lit(2).alias("precedence"), F.lit("review").alias("origin"), F.concat(F.lit("R:"), "text").alias("text"))
    return one.unionByName(two), c.where("turn % 4 = 0").select(name(1).alias("id")).distinct()


@query(f"""with {_COLLECTIONS}, t as (select id, min_by(text, precedence) as text, string_agg(origin, ',' order by precedence) as provenance from c group by 1)
 select coalesce(t.id, l.id) as id, md5(t.text) as text, coalesce(provenance, 'placeholder') as provenance, l.id is not null as linked from t full join links l on t.id = l.id""")
def j9_question_table(spark, sf_dir):
    c, links = _collections(spark, sf_dir)
    t = c.groupBy("id").agg(F.min_by("text", "precedence").alias("text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("precedence", "origin"))), lambda x: x["origin"]), ",").alias("provenance"))
    j = t.join(links.select(F.col("id").alias("l")), F.col("id") == F.col("l"), "full_outer")
    return j.select(F.coalesce("id", "l").alias("id"), F.md5("text").alias("text"), F.coalesce("provenance", F.lit("placeholder")).alias("provenance"), F.col("l").isNotNull().alias("linked"))


@query(f"with {_COLLECTIONS} select l.id, case when count(c.id) = 0 then 'unresolved' when count(distinct c.origin) > 1 then 'ambiguous' else 'resolved' end as status from links l left join c on l.id = c.id group by 1")
def j10_audit_references(spark, sf_dir):
    c, links = _collections(spark, sf_dir)
    j = links.join(c.select(F.col("id").alias("c"), "origin"), F.col("id") == F.col("c"), "left")
    return j.groupBy("id").agg(F.when(F.count("c") == 0, "unresolved").when(F.countDistinct("origin") > 1, "ambiguous").otherwise("resolved").alias("status"))


@query("""with a as (select event_id as id, sha256(user_id || '|' || epoch_us(ts) || '|' || event_type) as anchor from events where event_id % 2 = 0), b as (select event_id as id, sha256(user_id || '|' || epoch_us(ts) || '|' || case when event_id % 10 = 4 then 'other' else event_type end) as anchor from events where event_id % 3 <> 1)
 select a.id, b.id as other_id, b.id is not null as matched from a left join b using (anchor)""")
def j20_anchor_match(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("us", d.micros("ts"))
    anchor = lambda kind: F.sha2(F.concat_ws("|", "user_id", "us", kind), 256)
    a = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), anchor(F.col("event_type")).alias("anchor"))
    b = e.where("event_id % 3 <> 1").select(F.col("event_id").alias("other_id"), anchor(F.when(F.col("event_id") % 10 == 4, "other").otherwise(F.col("event_type"))).alias("anchor"))
    return a.join(b, "anchor", "left").select("id", "other_id", F.col("other_id").isNotNull().alias("matched"))


@query("""with m as (select distinct user_id as track_id, case when user_id % 4 = 0 then 'abstain' else 'P' || user_id % 7 end as person from events), o as (select event_id as id, user_id as track_id, case when event_id % 3 = 0 then 'R' || event_id % 5 end as raw from events)
 select id, case when person = 'abstain' then null else coalesce(person, raw) end as person_id, case when person = 'abstain' then 'abstained' when person is not null then 'mapped' else 'raw' end as basis from o left join m on o.track_id = m.track_id and o.id % 5 <> 2""")
def j25_performer_appearances(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    m = e.select(F.col("user_id").alias("track"), F.when(F.col("user_id") % 4 == 0, "abstain").otherwise(F.concat(F.lit("P"), F.col("user_id") % 7)).alias("person")).distinct()
    o = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("track_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("R"), F.col("event_id") % 5)).alias("raw"))
    j = o.join(m, (F.col("track_id") == F.col("track")) & (F.col("id") % 5 != 2), "left")
    gone = F.coalesce(F.col("person") == "abstain", F.lit(False))
    return j.select("id", F.when(~gone, F.coalesce("person", "raw")).alias("person_id"), F.when(gone, "abstained").when(F.col("person").isNotNull(), "mapped").otherwise("raw").alias("basis"))


@query("""select i.source_id, i.id as clip_id, s.id as sample_id, s.time_us - i.start_us as clip_us, s.time_us - lag(s.time_us) over (partition by i.source_id, i.id order by s.time_us, s.id) > 60000000 as after_gap from intervals i join samples s on s.source_id = i.source_id and i.kind = 'view' and i.start_us <= s.time_us and s.time_us < i.end_us""", "intervals", "samples")
def j30_clip_tracks(spark, sf_dir):
    v = d.intervals(spark, sf_dir).where("kind = 'view'").select("source_id", "id", "start_us", "end_us")
    j = intervals.stab_join(d.samples(spark, sf_dir), v)
    w = Window.partitionBy("source_id", "b_id").orderBy("time_us", "id")
    return j.select("source_id", F.col("b_id").alias("clip_id"), F.col("id").alias("sample_id"), (F.col("time_us") - F.col("b_start_us")).alias("clip_us"), (F.col("time_us") - F.lag("time_us").over(w) > 60_000_000).alias("after_gap"))


_SIGHTS = """o as (select user_id as source_id, f * 1000000 as time_us, user_id || '-' || event_type || '-' || (f // 40) as track_id, event_id % 3 <> 0 as face, event_id % 4 <> 0 as body, event_id % 5 = 0 as embedded, event_type from (select *, epoch_us(ts) // 7200000000 - 236676 as f from events)),
 d as (select source_id, max(time_us) + 1000000 as duration_us from o group by 1)"""


@query(f"""with {_SIGHTS}, u as (select source_id, track_id, time_us, bool_or(face) as face, bool_or(body) as body, bool_or(embedded) as embedded from o group by 1, 2, 3), g as (select *, time_us - lag(time_us) over (partition by source_id, track_id order by time_us) as gap from u),
 t as (select source_id, track_id, min(time_us) as first, count(*) < 3 or coalesce(sum(gap) filter (gap <= 1200000), 0) < 1000000 as micro, bool_or(face) as face, bool_or(body) as body, bool_or(embedded) as embedded from g group by 1, 2),
 p as (select t.source_id, least((duration_us - 1) // 60000000, first // 60000000) as bin, count(*) as n, count(*) filter (micro) as micro, count(*) filter (face and not body) as face_only, count(*) filter (not face) as body_only, count(*) filter (face and body) as face_body, count(*) filter (not embedded) as missing from t join d using (source_id) group by 1, 2),
 c as (select o.source_id, least((duration_us - 1) // 60000000, time_us // 60000000) as bin, count(*) as cuts from o join d using (source_id) where event_type = 'view' and time_us > 0 group by 1, 2), b as (select source_id, duration_us, unnest(range((duration_us - 1) // 60000000 + 1)) as bin from d)
 select source_id, bin * 60000000 as start_us, least(duration_us, (bin + 1) * 60000000) as end_us, {', '.join(f"round(coalesce({k}, 0) * 60 / greatest(1.0::double, (least(duration_us, (bin + 1) * 60000000) - bin * 60000000) / 1e6::double), 6) as {n}_per_minute" for k, n in (('n', 'created'), ('micro', 'micro')))}, coalesce(face_only, 0) as face_only, coalesce(body_only, 0) as body_only, coalesce(face_body, 0) as face_body, round(missing / n::double, 6) as missing_rate, coalesce(cuts, 0) as cuts from b left join p using (source_id, bin) left join c using (source_id, bin)""")
def b8_tracking_profile(spark, sf_dir):
    f = d.micros("ts")
    e = _t(spark, sf_dir, "events").withColumn("us", f).withColumn("f", F.expr("us div 7200000000 - 236676"))
    i = F.col("event_id")
    o = e.select(F.col("user_id").alias("source_id"), (F.col("f") * 1_000_000).alias("time_us"), F.concat_ws("-", "user_id", "event_type", F.expr("f div 40")).alias("track_id"), (i % 3 != 0).alias("face_visible"), (i % 4 != 0).alias("body_visible"), (i % 5 == 0).alias("embedded"), "event_type")
    spans = o.groupBy("source_id").agg((F.max("time_us") + 1_000_000).alias("duration_us"))
    shots = o.where("event_type = 'view'").select("source_id", F.col("time_us").alias("start_us"))
    return identity.tracking_profile(o, shots, spans)


@query("""with n as (select o_custkey % 50 as scene_id, o_orderpriority as person, count(*) as n, min(o_orderkey) as first from orders group by 1, 2) select scene_id, count(*) as n_people, max_by(person, (n, -first)) as predominant, case when count(*) = 1 then 'single' when count(*) <= 3 then 'group' else 'crowd' end as kind from n group by 1""")
def b17_scene_enrichment(spark, sf_dir):
    n = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("scene_id"), F.col("o_orderpriority").alias("person")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    k = F.count(F.lit(1))
    return n.groupBy("scene_id").agg(k.alias("n_people"), F.max_by("person", F.struct("n", -F.col("first"))).alias("predominant"), F.when(k == 1, "single").when(k <= 3, "group").otherwise("crowd").alias("kind"))


@query("""select i.source_id, i.id, count(s.id) as n_samples, round(avg(s.value), 6) as sharpness, round(avg((s.value < 5)::int), 6) as low_share from intervals i left join samples s on s.source_id = i.source_id and i.start_us <= s.time_us and s.time_us < i.end_us where i.kind = 'view' group by 1, 2""", "intervals", "samples")
def b36_clip_technical_quality(spark, sf_dir):
    v = d.intervals(spark, sf_dir).where("kind = 'view'").select("source_id", "id", "start_us", "end_us")
    j = intervals.stab_join(d.samples(spark, sf_dir), v).groupBy(F.col("source_id").alias("s"), "b_id").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.avg("value"), 6).alias("sharpness"), F.round(F.avg((F.col("value") < 5).cast("int")), 6).alias("low_share"))
    return v.join(j, (F.col("source_id") == F.col("s")) & (F.col("id") == F.col("b_id")), "left").select("source_id", "id", F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "sharpness", "low_share")


@query("""with a as (select 'orders' as field, count(distinct o_orderkey) as v from orders union all select 'customers', count(distinct o_custkey) from orders), b as (select 'orders' as field, count(distinct l_orderkey) as v from lineitem union all select 'customers', count(*) from customer) select field, a.v as reported, b.v as canonical, a.v = b.v as agrees from a join b using (field)""")
def b42_report_metrics(spark, sf_dir):
    o, li, c = (_t(spark, sf_dir, x) for x in ("orders", "lineitem", "customer"))
    row = lambda df, name, v, to: df.agg(v.alias(to)).select(F.lit(name).alias("field"), to)
    a = row(o, "orders", F.countDistinct("o_orderkey"), "reported").unionByName(row(o, "customers", F.countDistinct("o_custkey"), "reported"))
    b = row(li, "orders", F.countDistinct("l_orderkey"), "canonical").unionByName(row(c, "customers", F.count(F.lit(1)), "canonical"))
    return a.join(b, "field").withColumn("agrees", F.col("reported") == F.col("canonical"))


@query("""with s as (select event_type as stage, case when count(*) filter (value > 19) > 0 then 'failed' when avg(value) > 5 then 'degraded' else 'ok' end as status from events group by 1), i as (select event_id as id, event_type as stage, 'E' || (value::int % 4) as code from events)
 select i.id, i.code, i.stage, case when s.status = 'failed' then 'stage_failed' when i.code in ('E0', 'E1') then 'input' when s.status = 'degraded' then 'stage_degraded' else 'unknown' end as category from i left join s using (stage)""")
def b45_root_causes(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    s = e.groupBy("event_type").agg(F.when(F.count_if(F.col("value") > 19) > 0, "failed").when(F.avg("value") > 5, "degraded").otherwise("ok").alias("status"))
    i = e.select(F.col("event_id").alias("id"), "event_type", F.concat(F.lit("E"), F.rint("value").cast("int") % 4).alias("code"))
    return i.join(s, "event_type", "left").select("id", "code", F.col("event_type").alias("stage"), F.when(F.col("status") == "failed", "stage_failed").when(F.col("code").isin("E0", "E1"), "input").when(F.col("status") == "degraded", "stage_degraded").otherwise("unknown").alias("category"))


@query("""select count(*) as n_events, count(distinct user_id) as n_tracks, (select count(*) from (select user_id from events group by 1 having count(*) >= 60)) as n_valid, (select count(*) from (select user_id from events group by 1 having count(*) < 60)) as n_micro, count(distinct event_id % 97) as n_reappearing from events""")
def b47_reconcile_counters(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_events"), F.count(F.lit(1)).alias("n_tracks"), F.count_if(F.col("n") >= 60).alias("n_valid"), F.count_if(F.col("n") < 60).alias("n_micro"))
    return per.crossJoin(e.agg(F.countDistinct(F.col("event_id") % 97).alias("n_reappearing")))  # two single rows


@query("""select source_id, count(*) as n, count(distinct time_us) as n_times, max(step) as largest_gap_us, count(*) filter (value > 15) as n_invalid from (select *, time_us - lag(time_us) over (partition by source_id order by time_us, id) as step from samples) group by 1""", "samples")
def b49_mouth_sample_stats(spark, sf_dir):
    w = Window.partitionBy("source_id").orderBy("time_us", "id")
    s = d.samples(spark, sf_dir).withColumn("step", F.col("time_us") - F.lag("time_us").over(w))
    return s.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("time_us").alias("n_times"), F.max("step").alias("largest_gap_us"), F.count_if(F.col("value") > 15).alias("n_invalid"))


@query(""", u as (select source_id, topic, max(score) as score, count(*) as n, min(moment_id) as id from candidates group by 1, 2) select source_id, row_number() over (partition by source_id order by case when score >= 0.9 then 0 when score >= 0.5 then 1 else 2 end, score desc, id)::int as place, id, case when score >= 0.9 then 'now' when score >= 0.5 then 'later' else 'last' end as class from u""", "candidates")
def t12_review_queue(spark, sf_dir):
    u = d.candidates(spark, sf_dir).groupBy("source_id", "topic").agg(F.max("score").alias("score"), F.min("moment_id").alias("id"))
    order = F.when(F.col("score") >= 0.9, 0).when(F.col("score") >= 0.5, 1).otherwise(2)
    w = Window.partitionBy("source_id").orderBy(order, F.col("score").desc(), "id")
    return u.select("source_id", F.row_number().over(w).alias("place"), "id", F.when(F.col("score") >= 0.9, "now").when(F.col("score") >= 0.5, "later").otherwise("last").alias("class"))


@query("""with l as (select label as truth, (label + (vec_id % 11 = 0)::int) % 10 as a, (label + (vec_id % 17 = 0)::int) % 10 as b from embeddings), p as (select (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by truth)) as t, (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by truth, a)) as ta, (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by a)) as pa, (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by truth, b)) as tb, (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by b)) as pb)
 select (t - ta)::bigint as old_splits, (pa - ta)::bigint as old_merges, (t - tb)::bigint as new_splits, (pb - tb)::bigint as new_merges, t - tb < t - ta and pb - tb <= pa - ta as accepted from p""")
def e2_identity_ab(spark, sf_dir):
    v = _t(spark, sf_dir, "embeddings")
    run = lambda k: audit.pairwise_identity(v.select(F.col("label").alias("truth"), ((F.col("label") + (F.col("vec_id") % k == 0).cast("int")) % 10).alias("predicted")))
    old = run(11).select(F.col("false_splits").alias("old_splits"), F.col("false_merges").alias("old_merges"))
    new = run(17).select(F.col("false_splits").alias("new_splits"), F.col("false_merges").alias("new_merges"))
    return old.crossJoin(new).withColumn("accepted", (F.col("new_splits") < F.col("old_splits")) & (F.col("new_merges") <= F.col("old_merges")))  # two single rows


@query("""with st as (select user_id as source_id, event_type as stage, case when count(*) % 5 = 0 then 'failed' when count(*) % 5 = 1 then 'skipped' when count(*) % 5 = 2 then null else 'ok' end as status, case when count(*) % 2 = 1 then 'not_measured_disabled' end as capability from events where not (user_id % 4 = 3 and event_type = 'view') group by 1, 2),
 cn as (select user_id as source_id, count(*) as expected, case when user_id % 3 = 0 then null else count(*) + user_id % 2 end as received from events group by 1), rw as (select user_id as source_id, row_number() over (partition by user_id order by event_id) as row_no, case when event_id % 4 = 0 then ' ' else event_id::varchar end as id from events), gt as (select distinct user_id as source_id, case when user_id % 2 = 0 then 'P0_FAIL' else 'PASS' end as status, case user_id % 3 when 0 then ['visual_tracking_unavailable'] when 1 then ['x', 'visual_tracking_unavailable'] else [] end as missing from events),
 e as (select source_id, 'upstream_stage_not_usable' as code, 'stage_status.' || stage as path, 'ok_or_evidence_backed_partial' as expected, coalesce(status, 'none') as received from st where not coalesce(status in ('ok', 'partial', 'degraded'), false) and not coalesce(status = 'skipped' and capability = 'not_measured_disabled', false)
  union all select s.source_id, 'mandatory_stage_status_missing', 'stage_status.' || m, 'explicit_completed_stage', 'missing' from (select distinct source_id from st) s, (select unnest(['view', 'click']) as m) where not exists (select 1 from st where st.source_id = s.source_id and st.stage = m)
  union all select source_id, 'count_disagreement', 'captions', expected::varchar, coalesce(received::varchar, 'none') from cn where expected is distinct from received union all select source_id, 'row_missing_id', 'moments[' || row_no || ']', 'nonempty_id', 'missing' from rw where trim(id) = ''
  union all select source_id, 'quality_gate_p0', 'quality_gate.status', 'non_blocking', 'P0_FAIL' from gt where status = 'P0_FAIL' and not (len(missing) > 0 and list_has_all(['visual_tracking_unavailable', 'active_speaker_unavailable', 'camera_timeline_unavailable'], missing)))
 select source_id, place::int as place, code, path, expected, received from (select *, row_number() over (partition by source_id order by path, code) as place from e) where place <= 32""")
def j29_contract_audit(spark, sf_dir):
    e, n, u = _t(spark, sf_dir, "events").withColumnRenamed("user_id", "source_id"), F.count(F.lit(1)), F.col("source_id")
    k = F.col("n") % 5
    st = e.where("not (source_id % 4 = 3 and event_type = 'view')").groupBy("source_id", F.col("event_type").alias("stage")).agg(n.alias("n")).select("source_id", "stage", F.when(k == 0, "failed").when(k == 1, "skipped").when(k > 2, "ok").alias("status"), F.when(F.col("n") % 2 == 1, "not_measured_disabled").alias("capability"))
    cn = e.groupBy("source_id").agg(n.alias("expected")).select("source_id", F.lit("captions").alias("name"), "expected", F.when(u % 3 != 0, F.col("expected") + u % 2).alias("received"))
    rw = e.select("source_id", F.lit("moments").alias("name"), F.row_number().over(Window.partitionBy("source_id").orderBy("event_id")).alias("row_no"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_id").cast("string")).alias("id"))
    one = F.lit("visual_tracking_unavailable")
    gt = e.select("source_id").distinct().select("source_id", F.when(u % 2 == 0, "P0_FAIL").otherwise("PASS").alias("status"), F.when(u % 3 == 0, F.array(one)).when(u % 3 == 1, F.array(F.lit("x"), one)).otherwise(F.array().cast("array<string>")).alias("missing"))
    return audit.contract_audit(st, cn, rw, gt, ("view", "click"), ("visual_tracking_unavailable", "active_speaker_unavailable", "camera_timeline_unavailable"))
