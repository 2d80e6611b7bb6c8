"""Audits and evaluation over the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import audit as op
from ..operators import identity
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


@query("""with l as (select l_orderkey as k from lineitem union all select -1 - l_linenumber from lineitem where l_quantity = 1), j as (select k, o_orderkey as p from l left join orders on k = o_orderkey)
 select 'order' as namespace, count(*) as n_refs, count(p) as n_resolved, count(distinct k) filter (p is null) as n_dangling, round(count(p) / count(*), 6) as coverage from j""")
def j7_reference_audit(spark, sf_dir):
    line = d.table(spark, sf_dir, "lineitem")
    refs = line.select(F.col("l_orderkey").alias("k")).unionByName(line.where("l_quantity = 1").select((-1 - F.col("l_linenumber")).cast("long").alias("k")))
    return op.reference_audit(refs, d.table(spark, sf_dir, "orders"), "k", "o_orderkey", "order")


@query("""select o_orderkey as id, n is not null as touched, coalesce(why, '') as evidence from orders left join (select l_orderkey, count(*) as n, string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) as why from lineitem where l_returnflag = 'R' group by 1) on o_orderkey = l_orderkey""")
def j8_propagate_flag(spark, sf_dir):
    hit = d.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("why"))
    return d.table(spark, sf_dir, "orders").join(hit, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("id"), F.col("why").isNotNull().alias("touched"), F.coalesce("why", F.lit("")).alias("evidence"))


_RUN = "select event_type || '-' || user_id % 20 as metric, round(avg(case when user_id % 20 <> 7 then value end), 6) as value, case when user_id % 20 = 3 then '{s}' else 'full' end as scope from events where day(ts) {op} 15 group by 1, user_id % 20"


@query(f"""with old as ({_RUN.format(s='part', op='<=')}), new as ({_RUN.format(s='full', op='>')}) select coalesce(o.metric, n.metric) as metric, o.value as old, n.value as new, case when o.scope = n.scope then round(n.value - o.value, 6) end as delta,
 case when o.scope is null then 'added' when n.scope is null then 'removed' when o.scope <> n.scope then 'scope_differs' when o.value is null or n.value is null then 'not_numeric' else 'compared' end as status from old o full join new n on o.metric = n.metric""")
def j15_compare_runs(spark, sf_dir):
    u = F.col("user_id") % 20
    e = d.table(spark, sf_dir, "events")
    half = lambda c, s: e.where(c).groupBy(F.concat_ws("-", "event_type", u).alias("metric"), u.alias("u")).agg(F.round(F.avg(F.when(u != 7, F.col("value"))), 6).alias("value")).withColumn("scope", F.when(F.col("u") == 3, s).otherwise("full"))
    return op.compare_runs(half("day(ts) <= 15", "part"), half("day(ts) > 15", "full"))


_STAGES = "stages as (select distinct user_id as stage from events), failed as (select user_id as stage from events group by 1 having count(*) filter (event_type = 'error') > 0.2 * count(*)), edges as (select stage, stage // 2 as needs from stages where stage > 0 union select stage, stage // 3 from stages where stage > 2)"


@query(f"with recursive {_STAGES}, reach as (select stage as cause, stage from failed union select r.cause, e.stage from reach r join edges e on e.needs = r.stage) select stage, string_agg(cause, ',' order by cause) as causes from (select distinct stage, cause::varchar as cause from reach) group by 1")
def b44_stage_impact(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    stages = e.groupBy(F.col("user_id").alias("stage")).agg(F.when(F.count_if(F.col("event_type") == "error") > 0.2 * F.count(F.lit(1)), "failed").otherwise("ok").alias("status"))
    edges = stages.where("stage > 0").select("stage", F.expr("stage div 2").alias("needs")).union(stages.where("stage > 2").select("stage", F.expr("stage div 3"))).distinct()
    return op.stage_impact(stages.withColumn("stage", F.col("stage").cast("string")), edges.select(F.col("stage").cast("string"), F.col("needs").cast("string"))).withColumn("stage", F.col("stage").cast("long"))


_EVAL = "e as (select l.doc_id, l.quality as truth, case when doc_id % 9 = 4 then null when d.n_chars > 1500 then 1 else 0 end as predicted from labels l join documents d using (doc_id))"


def _eval(spark, sf_dir):
    j = d.table(spark, sf_dir, "labels").join(d.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("doc_id"), F.col("quality").alias("truth"), F.when(F.col("doc_id") % 9 == 4, None).when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"))


@query(f"with {_EVAL}, c as (select count(*) filter (predicted = 1 and truth = 1) as tp, count(*) filter (predicted = 1 and truth = 0) as fp, count(*) filter (predicted = 0 and truth = 1) as fn, count(*) filter (predicted = 0 and truth = 0) as tn, count(*) filter (predicted is null) as abstained from e) select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) as f1 from c")
def e3_speaker_eval(spark, sf_dir):
    return op.binary_eval(_eval(spark, sf_dir))


@query("with l as (select label as truth, (label + case when vec_id % 11 = 0 then 1 else 0 end) % 10 as predicted from embeddings), p as (select (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by truth, predicted))::bigint as tp, (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by truth))::bigint as t, (select sum(n * (n - 1) // 2) from (select count(*) as n from l group by predicted))::bigint as q) select tp, q - tp as false_merges, t - tp as false_splits, round(tp / q, 6) as precision, round(tp / t, 6) as recall from p")
def e1_pairwise_identity_eval(spark, sf_dir):
    v = d.table(spark, sf_dir, "embeddings")
    return op.pairwise_identity(v.select(F.col("label").alias("truth"), ((F.col("label") + (F.col("vec_id") % 11 == 0).cast("int")) % 10).alias("predicted")))


_SECONDS = "r as (select event_id as id, event_type as stage, user_id % 4 as fingerprint, case when value > 18 then 'failed' else 'ok' end as status, event_id % 5 = 0 as cached, value as elapsed, ts as done from events)"


def _seconds(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), (F.col("user_id") % 4).alias("fingerprint"), F.when(F.col("value") > 18, "failed").otherwise("ok").alias("status"), (F.col("event_id") % 5 == 0).alias("cached"), F.col("value").alias("elapsed"), F.col("ts").alias("at"))


@query(f"with {_SECONDS} select stage, fingerprint, count(*) as n, round(median(elapsed), 6) as median, min(elapsed) as lo, max(elapsed) as hi from r where status = 'ok' and not cached and elapsed is not null group by 1, 2 having count(*) >= 3")
def b38_stage_estimates(spark, sf_dir):
    return op.stage_estimates(_seconds(spark, sf_dir))


@query(f"with {_SECONDS} select stage, count(*) as n, round(quantile_cont(elapsed, 0.5), 6) as p50, round(quantile_cont(elapsed, 0.95), 6) as p95 from (select *, row_number() over (partition by stage order by done desc, id desc) as k from r) where k <= 512 group by 1")
def b39_latency_report(spark, sf_dir):
    return op.latency_report(_seconds(spark, sf_dir))


@query(f"with {_SECONDS} select stage, id, elapsed from (select *, row_number() over (partition by stage order by done desc, id desc) as k from r) where k <= 50")
def s9_append_runtime_history(spark, sf_dir):
    w = Window.partitionBy("stage").orderBy(F.col("at").desc(), F.col("id").desc())
    return _seconds(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k <= 50").select("stage", "id", "elapsed")


@query(f"with {_SECONDS} select stage, count(*) as n, count(elapsed) as observed, round(sum(elapsed), 6) as seconds, round(sum(case when elapsed > 0 then fingerprint end) / nullif(sum(case when fingerprint is not null then elapsed end), 0), 6) as rate from r group by 1")
def b6_inference_costs(spark, sf_dir):
    e, f = F.col("elapsed"), F.col("fingerprint")
    rate = F.round(F.try_divide(F.sum(F.when(e > 0, f)), F.sum(F.when(f.isNotNull(), e))), 6)
    return _seconds(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count(e).alias("observed"), F.round(F.sum(e), 6).alias("seconds"), rate.alias("rate"))


@query("""select source, chunk, count(*) as records, sum(strlen(text))::bigint as bytes, min(pos) as first, max(pos) as last, sha256(string_agg(sha256(text), '' order by pos)) as digest from (select *, (pos - 1) // 50 as chunk from (select *, row_number() over (partition by source order by doc_id) as pos from documents)) group by 1, 2""")
def s5_chunk_manifest(spark, sf_dir):
    m = op.chunk_manifest(d.table(spark, sf_dir, "documents"), "source", ["doc_id"], "text", 50)
    return m.select("source", "chunk", "records", "bytes", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "digest")


@query("""with h as (select sha256(text) as sha256, doc_id % 5 as origin, source || '/' || doc_id as path from documents where text is not null) select sha256, min_by(path, (origin, path)) as path, min(origin) as origin, count(*) as copies from h group by 1""")
def s11_content_catalog(spark, sf_dir):
    x = d.table(spark, sf_dir, "documents").withColumn("origin", F.col("doc_id") % 5).withColumn("path", F.concat_ws("/", "source", "doc_id"))
    return op.content_catalog(x, "text", "origin", "path")


@query("""with new as (select doc_id, md5(text) as input, lang as params from documents where doc_id % 7 <> 0), old as (select doc_id, md5(case when doc_id % 5 = 0 then text || 'x' else text end) as input, case when doc_id % 3 = 0 then 'xx' else lang end as params from documents where doc_id % 11 <> 0)
 select * from (select coalesce(n.doc_id, o.doc_id) as doc_id, case when o.doc_id is null then 'new' when n.doc_id is null then 'removed' else array_to_string(list_filter([case when n.input is distinct from o.input then 'input' end, case when n.params is distinct from o.params then 'params' end], lambda x: x is not null), ',') end as why from new n full join old o on n.doc_id = o.doc_id) where why <> ''""")
def s12_changed_sources(spark, sf_dir):
    x = d.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    new = x.where(i % 7 != 0).select("doc_id", F.md5("text").alias("input"), F.col("lang").alias("params"))
    old = x.where(i % 11 != 0).select("doc_id", F.md5(F.when(i % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("input"), F.when(i % 3 == 0, "xx").otherwise(F.col("lang")).alias("params"))
    return op.changed_sources(new, old, "doc_id", ["input", "params"])


@query("select regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, count(*) as n, sum(strlen(html))::bigint as bytes, max(page_id) as latest from pages group by 1")
def s10_project_inventory(spark, sf_dir):
    return d.table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("bytes"), F.max("page_id").alias("latest"))


# ---------------------------------------------------------------- identities over embeddings


def _tracks(spark, sf_dir):
    v = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), (F.col("vec_id") % 5).alias("source_id"), F.col("label").alias("person"), "embedding")
    return identity.unit_vectors(v, "embedding")


@query("select vec_id as track_id, len(embedding) as dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings where len(embedding) between 2 and 4096")
def n14_unit_vector(spark, sf_dir):
    return _tracks(spark, sf_dir).select("track_id", F.size("embedding").cast("long").alias("dim"), F.round("norm", 5).alias("norm"))


_UNIT = "t as (select vec_id as track_id, vec_id % 5 as source_id, label as person, list_transform(embedding, lambda x: x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double)))) as unit from embeddings)"


@query(f"""with {_UNIT}, r as (select *, row_number() over (partition by source_id, person order by track_id) - 1 as pos, count(*) over (partition by source_id, person) as n from t), p as (select * from r where n <= 32 or pos = 0 or pos * 32 // n <> (pos - 1) * 32 // n)
 select source_id, person, i::int as i, round(m / sqrt(sum(m * m) over (partition by source_id, person)), 4) as m from (select source_id, person, i, median(x) as m from (select source_id, person, unnest(range(len(unit))) as i, unnest(unit) as x from p) group by 1, 2, 3)""")
def b11_embedding_template(spark, sf_dir):
    t = identity.templates(_tracks(spark, sf_dir), ["source_id", "person"])
    return t.select("source_id", "person", F.posexplode("unit").alias("i", "m")).withColumn("m", F.round("m", 4))


@query(f"""with {_UNIT}, g as (select source_id, person, min(track_id) as track_id from t group by 1, 2), u as (select g.source_id, g.person as person_id, t.unit from g join t using (track_id)), s as (select t.track_id, u.person_id, round(list_sum(list_transform(range(1, 65), lambda i: t.unit[i] * u.unit[i])), 4) as score from t join u on t.source_id = u.source_id)
 select track_id, person_id, score, margin from (select *, row_number() over w as rank, round(score - lead(score) over w, 4) as margin from s window w as (partition by track_id order by score desc, person_id)) where rank = 1""")
def j17_face_knn(spark, sf_dir):
    t = _tracks(spark, sf_dir)
    first = t.groupBy("source_id", "person").agg(F.min_by("unit", "track_id").alias("unit")).withColumnRenamed("person", "person_id")
    g = first.select(F.col("source_id").alias("g_source"), "person_id", F.col("unit").alias("g_unit"))
    j = t.join(g, F.col("source_id") == F.col("g_source")).withColumn("score", F.round(numbers.dot(F.col("unit"), F.col("g_unit")), 4))
    w = Window.partitionBy("track_id").orderBy(F.col("score").desc(), "person_id")
    return j.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.round(F.col("score") - F.lead("score").over(w), 4)).where("rank = 1").select("track_id", "person_id", "score", "margin")


_OBS = "o as (select event_id as id, user_id % 5 as source_id, user_id as track_id, epoch_us(ts) as time_us, value from events)"


def _observations(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("source_id"), F.col("user_id").alias("track_id"), d.micros("ts").alias("time_us"), "value")


@query(f"with {_OBS} select source_id, track_id, min(time_us) as first_us, max(time_us) as last_us, coalesce(sum(step) filter (step <= 36000000000), 0)::bigint as visual_us, count(distinct time_us) as instants from (select *, time_us - lag(time_us) over (partition by source_id, track_id order by time_us) as step from o) group by 1, 2")
def b9_tracklet_rollup(spark, sf_dir):
    return identity.tracklet_rollup(_observations(spark, sf_dir), 36_000_000_000)


@query(f"with {_OBS} select track_id, round(quantile_cont(value, 0.25), 6) as p25, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75, round(quantile_cont(value, 0.95), 6) as p95 from o group by 1")
def b10_track_quantiles(spark, sf_dir):
    return _observations(spark, sf_dir).groupBy("track_id").agg(*(F.round(F.percentile("value", q), 6).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75, 0.95)))


@query(f"""with recursive {_OBS}, s as (select *, sum(fresh) over (partition by track_id order by time_us, id) as stretch, row_number() over (partition by track_id order by time_us, id) as k from (select *, case when time_us - lag(time_us) over (partition by track_id order by time_us, id) <= 18000000000 then 0 else 1 end as fresh from o)),
 e as (select track_id, k, stretch, id, value as smooth from s where k = 1 union all select s.track_id, s.k, s.stretch, s.id, case when s.fresh = 1 then s.value else 0.35::double * s.value + (1 - 0.35::double) * e.smooth end from e join s on s.track_id = e.track_id and s.k = e.k + 1)
 select track_id, stretch::bigint as stretch, id, floor(smooth * 1000 + 0.123)::bigint as smooth from e""")
def w3_motion_ewma(spark, sf_dir):
    m = identity.motion_ewma(_observations(spark, sf_dir), gap_us=18_000_000_000)
    return m.select("track_id", "stretch", "id", F.floor(F.col("smooth") * 1000 + 0.123).cast("long").alias("smooth"))


@query("select vec_id as track_id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * before[i]::double)), 4) as dot from (select *, lag(embedding) over (partition by label order by vec_id) as before from embeddings) where list_sum(list_transform(range(1, 65), lambda i: embedding[i]::double * before[i]::double)) < 0.3")
def w6_probable_id_switches(spark, sf_dir):
    w = Window.partitionBy("label").orderBy("vec_id")
    v = d.table(spark, sf_dir, "embeddings").withColumn("before", F.lag("embedding").over(w)).withColumn("dot", numbers.dot(F.col("embedding"), F.col("before")))
    return v.where("dot < 0.3").select(F.col("vec_id").alias("track_id"), F.round("dot", 4).alias("dot"))


@query("""with i as (select user_id % 5 as source_id, user_id as person_id, event_id as track_id, epoch_us(ts) as start_us, epoch_us(ts) + round(value * 60e6)::bigint as end_us from events where value > 0)
 select a.source_id, a.person_id, a.track_id as a, b.track_id as b from i a join i b on a.source_id = b.source_id and a.person_id = b.person_id and a.track_id < b.track_id and a.start_us < b.end_us and b.start_us < a.end_us""")
def j16_identity_conflicts(spark, sf_dir):
    i = d.intervals(spark, sf_dir).select((F.col("source_id") % 5).alias("source_id"), F.col("source_id").alias("person_id"), F.col("id").alias("track_id"), "start_us", "end_us")
    return identity.identity_conflicts(i)


_HOURS = "h as (select user_id % 5 as source_id, event_type as kind, epoch_us(ts) // 21600000000 as step, round(avg(value), 6) as value from events group by 1, 2, 3)"


@query(f"""with {_HOURS}, c as (select a.source_id, lag, count(*) as n, round(corr(a.value, b.value), 4) as r from (select *, unnest([-2, -1, 0, 1, 2]) as lag from h where kind = 'view') a join h b on b.kind = 'click' and a.source_id = b.source_id and a.step + lag = b.step group by 1, 2)
 select source_id, lag, n, r from c where n >= 8 and r is not null qualify row_number() over (partition by source_id order by r desc, lag) = 1""")
def b24_lagged_correlation(spark, sf_dir):
    h = d.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("source_id"), F.col("event_type").alias("kind"), F.floor(d.micros("ts") / 21_600_000_000).alias("step")).agg(F.round(F.avg("value"), 6).alias("value"))
    return identity.lagged_correlation(h.where("kind = 'view'"), h.where("kind = 'click'"), [-2, -1, 0, 1, 2])


@query("""with w as (select user_id % 5 as source_id, event_type as speaker, user_id % 3 as person_id, epoch_us(ts) as start_us, epoch_us(ts) + round(value * 60e6)::bigint as end_us, round(value % 2 - 1, 6) as score from events where value > 0),
 p as (select source_id, speaker, person_id, count(*) filter (score >= 0.55) as n_for, count(*) filter (score <= -0.2) as n_against, round(sum(case when score >= 0.55 or score <= -0.2 then (end_us - start_us) / 1e6 * score else 0 end), 4) as weight from w group by 1, 2, 3),
 q as (select *, sum(n_for) over g as total, row_number() over (partition by source_id, speaker order by weight desc, person_id) as rank, max(weight) over g as best from p window g as (partition by source_id, speaker)), r as (select *, count(*) filter (weight = best) over (partition by source_id, speaker) as ties from q)
 select source_id, speaker, case when n_for >= 2 and n_for >= 0.67 * total and ties = 1 and weight > 0 then person_id end as person_id, n_for, n_against, weight from r where rank = 1""")
def b26_speaker_person_affinity(spark, sf_dir):
    i = d.intervals(spark, sf_dir)
    return identity.speaker_affinity(i.select((F.col("source_id") % 5).alias("source_id"), "speaker", (F.col("source_id") % 3).alias("person_id"), "start_us", "end_us", F.round(F.col("value") % 2 - 1, 6).alias("score")))


# ---------------------------------------------------------------- numbers and boxes

_BOX = "b as (select event_id as id, round(value % 1, 3) as x, round(value * 3 % 1, 3) as y, round(value * 7 % 1, 3) as w, round(value * 11 % 1, 3) as h from events)"


def _boxes(spark, sf_dir):
    v = F.col("value")
    return d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(v % 1, 3).alias("x"), F.round(v * 3 % 1, 3).alias("y"), F.round(v * 7 % 1, 3).alias("w"), F.round(v * 11 % 1, 3).alias("h"))


@query(f"with {_BOX} select id, x >= -1e-6 and y >= -1e-6 and w > 0 and h > 0 and x + w <= 1 + 1e-6 and y + h <= 1 + 1e-6 as ok from b")
def n13_valid_box(spark, sf_dir):
    return _boxes(spark, sf_dir).select("id", numbers.valid_box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("ok"))


@query(f"with {_BOX}, j as (select *, greatest(0, least(x + w, 0.75) - greatest(x, 0.25)) * greatest(0, least(y + h, 0.75) - greatest(y, 0.25)) as i from b) select id, round(coalesce(i / nullif(w * h + 0.25 - i, 0), 0), 6) as iou from j")
def f5_iou(spark, sf_dir):
    c = lambda v: F.lit(v)
    return _boxes(spark, sf_dir).select("id", F.round(numbers.iou(F.col("x"), F.col("y"), F.col("w"), F.col("h"), c(0.25), c(0.25), c(0.5), c(0.5)), 6).alias("iou"))


@query(f"with {_BOX} select id, coalesce(nullif(concat_ws('-', case when h - 0.5 > 0.1 then 'down' when h - 0.5 < -0.1 then 'up' end, case when w - 0.5 > 0.1 then 'right' when w - 0.5 < -0.1 then 'left' end), ''), 'still') as direction from b")
def f9_direction(spark, sf_dir):
    return _boxes(spark, sf_dir).select("id", numbers.direction(F.col("w") - 0.5, F.col("h") - 0.5, 0.1).alias("direction"))


@query("with v as (select event_id as id, case when event_id % 13 = 0 then 'nan'::double when event_id % 17 = 0 then 'inf'::double else value / 10 end as v from events) select id, case when not isnan(v) and not isinf(v) then v end as finite, case when not isnan(v) and not isinf(v) and v between 0 and 1 then v end as score from v")
def n1_finite_or_null(spark, sf_dir):
    i = F.col("event_id")
    v = F.when(i % 13 == 0, float("nan")).when(i % 17 == 0, float("inf")).otherwise(F.col("value") / 10)
    return d.table(spark, sf_dir, "events").withColumn("v", v).select(i.alias("id"), numbers.finite_or_null(F.col("v")).alias("finite"), numbers.unit_or_null(F.col("v")).alias("score"))


@query("""select event_id as id, lpad((ms // 3600000)::varchar, greatest(2, length((ms // 3600000)::varchar))::int, '0') || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || '.' || lpad((ms % 1000)::varchar, 3, '0') as stamp from (select event_id, (round(value * 1e9)::bigint + 500) // 1000 as ms from events)""")
def f4_stamp(spark, sf_dir):
    return d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), numbers.stamp(F.round(F.col("value") * 1e9).cast("long"), ".").alias("stamp"))


# ---------------------------------------------------------------- two detectors

_BOXES = """b0 as (select vec_id, vec_id % 97 as i, r as k, case r when 0 then 'baseline' else 'candidate' end as run from embeddings, range(2) t(r)),
 boxes as (select run, i as instance_id, (vec_id + 3 * k) % 7 <> 0 as matched, case when i % 11 = 4 - k then null when i % 10 = 3 and k = 0 then 'P' || (vec_id % 2) else 'P' || (i % (13 + 26 * k)) end as person_id from b0 where not ((vec_id + 3 * k) % 7 = 0 and i % 3 > 0) union all select run, null, null, 'X' from b0 where vec_id % 9 = 2 * k and vec_id % (2 + k) = 0),
 names as (select distinct vec_id % 97 as instance_id, case vec_id % 97 % 17 when 16 then 'Unknown ' when 15 then null else 'L' || (vec_id % 97 % 13) end as label from embeddings), bound as (select run, 'L' || (vec_id % 13) as label, 'P' || ((vec_id + case when vec_id % 29 = 0 then 1 else 0 end) % (13 + 26 * k)) as person_id from b0 where vec_id < 60)"""


def _boxes_of_runs(spark, sf_dir):
    v = d.table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    i, k, vec = F.col("vec_id") % 97, F.col("k"), F.col("vec_id")
    run = F.when(k == 0, "baseline").otherwise("candidate").alias("run")
    miss = (vec + 3 * k) % 7 == 0
    person = F.when(i % 11 == 4 - k, F.lit(None)).when((i % 10 == 3) & (k == 0), F.concat(F.lit("P"), vec % 2)).otherwise(F.concat(F.lit("P"), i % (13 + 26 * k)))
    hits = v.where(~(miss & (i % 3 > 0))).select(run, i.alias("instance_id"), (~miss).alias("matched"), person.alias("person_id"))
    extra = v.where((vec % 9 == 2 * k) & (vec % (2 + k) == 0)).select(run, F.lit(None).cast("long").alias("instance_id"), F.lit(None).cast("boolean").alias("matched"), F.lit("X").alias("person_id"))
    names = v.select(i.alias("instance_id"), F.when(i % 17 == 16, "Unknown ").when(i % 17 == 15, F.lit(None)).otherwise(F.concat(F.lit("L"), i % 13)).alias("label")).distinct()
    bound = v.where("vec_id < 60").select(run, F.concat(F.lit("L"), vec % 13).alias("label"), F.concat(F.lit("P"), (vec + F.when(vec % 29 == 0, 1).otherwise(0)) % (13 + 26 * k)).alias("person_id"))
    return hits.union(extra), names, bound


_RUNS = f"""with {_BOXES}, body as (select run, count(*) filter (instance_id is not null and matched) as true_positive, count(*) filter (instance_id is null) as false_positive, count(*) filter (instance_id is not null and not matched) as false_negative from boxes group by 1),
 own as (select run, instance_id, label, case when bool_and(matched and person_id is not null) and min(person_id) = max(person_id) then min(person_id) end as person_id from boxes join names using (instance_id) where lower(trim(label)) not in ('', 'unknown', '?', 'uncertain') group by 1, 2, 3),
 pr as (select a.run, count(*) filter (a.label <> b.label and a.person_id = b.person_id) as false_merge, count(*) filter (a.label = b.label and a.person_id <> b.person_id) as false_split from own a join own b on a.run = b.run and a.instance_id < b.instance_id where a.person_id is not null and b.person_id is not null group by 1),
 tot as (select run, count(*) as instances, count(*) filter (person_id is null) as abstentions from own group by 1), cl as (select run, person_id, list(distinct label) as labels from own where person_id is not null group by 1, 2),
 bd as (select b.run, count(*) as bindings, count(*) filter (labels is not null and labels <> [b.label]) as false_bindings, count(*) filter (labels is null) as binding_abstentions from bound b left join cl on cl.run = b.run and cl.person_id = b.person_id group by 1),
 runs as (select run, true_positive, false_positive, false_negative, round(true_positive / nullif(true_positive + false_positive, 0)::double, 6) as precision, round(true_positive / nullif(true_positive + false_negative, 0)::double, 6) as recall, coalesce(instances, 0) as instances, case when instances >= 2 then coalesce(false_merge, 0) end as false_merge, case when instances >= 2 then coalesce(false_split, 0) end as false_split, case when instances >= 2 then abstentions end as abstentions, bindings, false_bindings, binding_abstentions from body left join tot using (run) left join pr using (run) left join bd using (run))"""


@query(f"{_RUNS} select * from runs")
def e4_detector_runs(spark, sf_dir):
    return op.detector_runs(*_boxes_of_runs(spark, sf_dir))


_KEYS = ("false_merge", "false_split", "abstentions", "false_bindings", "binding_abstentions", "false_positive", "false_negative")


@query(f"{_RUNS} select case when {' and '.join(f'{m}.{k} is not null' for m in 'ab' for k in _KEYS)} then b.false_merge = 0 and b.false_bindings = 0 and {' and '.join(f'b.{k} <= a.{k}' for k in _KEYS)} and ({' or '.join(f'b.{k} < a.{k}' for k in _KEYS)}) end as accepted, {', '.join(f'b.{k}' for k in _KEYS)} from runs a, runs b where a.run = 'baseline' and b.run = 'candidate'")
def e4_detector_ab(spark, sf_dir):
    return op.detector_ab(op.detector_runs(*_boxes_of_runs(spark, sf_dir)), "baseline", "candidate")
