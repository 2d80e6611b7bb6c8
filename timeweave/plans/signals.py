"""Windows of evidence, lags, outcomes of re-identification and bindings of hypotheses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import signals as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_N = "length(text)"
_CANDS = f"""cand as (select source_id, segment_id as window_id, speaker, 'p' || k as person_id, turn % 13 = 12 as overlap, start_us, end_us, case when {_N} % 19 = 18 then null else round(((turn * 37 + {_N} * 11 + k * 29) % 60 + 40) / 100.0::double, 2) end as correlation, round(((turn * 37 + {_N} * 11 + k * 29) % 60 - 10) / 100.0::double, 2) as lower_bound, case when {_N} % 17 = 16 then null else (({_N} + k) % 30 - 15) * 10000 end as lag_us, {_N} % 40 as sample_count, case when k = 0 then round(((turn + 3) % 10) / 10.0::double + 0.2, 2) end as track_stability, round(({_N} % 9) / 10.0::double + 0.3, 2) as visibility, case when turn % 2 = 0 then 0.7::double end as face_fraction from segments, range(2) r(k) where turn % 6 <> 5),
 scr0 as (select *, list_filter([case when correlation is null or correlation < 0.55 then 'CORRELATION_BELOW_MINIMUM' end, case when sample_count < 8 then 'INSUFFICIENT_MOUTH_SAMPLES' end, case when coalesce(track_stability, 1) < 0.5 then 'UNSTABLE_TRACK' end, case when coalesce(visibility, 1) < 0.6 then 'INSUFFICIENT_VISUAL_COVERAGE' end, case when coalesce(face_fraction, 1) < 0.6 then 'INSUFFICIENT_FACE_OBSERVATION' end, case when coalesce(lower_bound, 0) <= 0 then 'NO_BOUNDED_POSITIVE_SYNC' end, case when lag_us is null then 'LAG_NOT_MEASURED' when abs(lag_us) > 120000 then 'SYNC_OFFSET_OUTSIDE_BOUND' end], lambda x: x is not null) as reasons from cand),
 scr as (select a.*, coalesce(len(a.reasons) = 0 and not a.overlap and ((select max(b.correlation) from scr0 b where b.source_id = a.source_id and b.window_id = a.window_id and b.person_id <> a.person_id) is null or round(a.correlation - (select max(b.correlation) from scr0 b where b.source_id = a.source_id and b.window_id = a.window_id and b.person_id <> a.person_id), 6) >= 0.1), false) as qualified from scr0 a)"""


def _candidates(spark, sf_dir):
    s, n, turn = d.segments(spark, sf_dir), F.length("text"), F.col("turn")
    s = s.where("turn % 6 <> 5").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    x = (turn * 37 + n * 11 + F.col("k") * 29) % 60
    return s.select("source_id", F.col("segment_id").alias("window_id"), "speaker", F.concat(F.lit("p"), "k").alias("person_id"), (turn % 13 == 12).alias("overlap"), "start_us", "end_us", F.when(n % 19 != 18, F.round((x + 40) / 100.0, 2)).alias("correlation"), F.round((x - 10) / 100.0, 2).alias("lower_bound"), F.when(n % 17 != 16, ((n + F.col("k")) % 30 - 15) * 10_000).alias("lag_us"), (n % 40).alias("sample_count"), F.when(F.col("k") == 0, F.round((turn + 3) % 10 / 10.0 + 0.2, 2)).alias("track_stability"), F.round(n % 9 / 10.0 + 0.3, 2).alias("visibility"), F.when(turn % 2 == 0, 0.7).alias("face_fraction"))


@query(f", {_CANDS} select source_id, window_id, person_id, array_to_string(reasons, ',') as reasons, qualified from scr", "segments")
def b27_local_sync(spark, sf_dir):
    return op.screened(_candidates(spark, sf_dir)).select("source_id", "window_id", "person_id", F.array_join("reasons", ",").alias("reasons"), "qualified")


@query(f""", {_CANDS}, per as (select source_id, window_id, count(*) as n, count(*) filter (qualified) as q from scr group by 1, 2)
 select s.source_id, s.segment_id as window_id, case when turn % 23 = 22 then 'user_verified' when turn % 13 = 12 then 'audio_overlap' when coalesce(q, 0) > 0 then 'qualified_local_signal_pending_independent_consensus' when coalesce(n, 0) > 0 then 'measured_signal_below_acceptance_gates' when length(text) < 100 then 'audio_window_too_short' when length(text) % 3 = 0 then 'insufficient_mouth_samples' when length(text) % 3 = 1 then 'measured_without_reliable_sync' else 'mouth_signal_unavailable' end as status, coalesce(n, 0) as n_candidates, coalesce(q, 0) as n_qualified from segments s left join per on per.source_id = s.source_id and per.window_id = s.segment_id""", "segments")
def b25_window_screen(spark, sf_dir):
    n = F.length("text")
    w = d.segments(spark, sf_dir).select("source_id", F.col("segment_id").alias("window_id"), (F.col("turn") % 23 == 22).alias("verified"), (F.col("turn") % 13 == 12).alias("overlap"), (n < 100).alias("too_short"), (n % 3 == 0).alias("few_samples"), (n % 3 == 1).alias("no_sync"))
    return op.window_screen(w, _candidates(spark, sf_dir))


@query(f""", {_CANDS}, map as (select distinct source_id, speaker, case when speaker = 'user' then 'p0' else 'p1' end as person_id from segments), own as (select scr.* from scr join map using (source_id, speaker, person_id) where qualified and end_us - start_us >= 500000),
 md as (select source_id, speaker, median(lag_us) as m from own group by 1, 2), g as (select source_id, speaker, m, count(*) as n, max(abs(lag_us - m)) as spread, max(abs(lag_us)) as largest from own join md using (source_id, speaker) group by 1, 2, 3)
 select map.source_id, map.speaker, coalesce(n, 0) as windows, m::double as median_lag_us, spread::double as spread_us, case when n is null then 'not_measured' when n < 2 then 'insufficient_samples' else 'measured' end as status, coalesce(n >= 2 and largest <= 120000 and spread <= 100000, false) as consistent from map left join g using (source_id, speaker)""", "segments")
def b27_lag_consistency(spark, sf_dir):
    m = d.segments(spark, sf_dir).select("source_id", "speaker", F.when(F.col("speaker") == "user", "p0").otherwise("p1").alias("person_id")).distinct()
    return op.lag_consistency(_candidates(spark, sf_dir), m)


_DECIDED = """t as (select vec_id as track_id, case when vec_id % 7 <> 6 then label end as person_id from embeddings), dc as (select vec_id as track_id, vec_id % 5 = 0 and k = 1 as accepted, case when vec_id % 11 <> 10 then label + k end as candidate_id, round(((vec_id * 13 + k * 31) % 100) / 100.0::double, 2) as similarity, case when k = 0 then 0.55::double else 0.8::double end as threshold, round((vec_id % 20) / 100.0::double, 2) as margin, 0.08::double as required_margin, case when vec_id % 3 > 0 then round((vec_id * 7 % 100) / 100.0::double, 2) end as cluster_min, vec_id % 9 = 1 as conflict from embeddings, range(2) r(k))"""


@query(f"""with {_DECIDED}, a as (select track_id, bool_or(accepted) as merged from dc group by 1), b as (select * from (select *, row_number() over (partition by track_id order by similarity desc, candidate_id) as r from dc where candidate_id is not null) where r = 1)
 select t.track_id, case when merged then 'merged' when person_id is not null then 'seed' else 'unmapped' end as outcome, case when not merged and b.track_id is not null then array_to_string(list_filter([case when similarity < threshold then 'score_below_threshold' end, case when margin < required_margin then 'margin_below_required' end, case when cluster_min < 0.55 then 'cluster_inconsistency' end, case when conflict then 'temporal_conflict' end], lambda x: x is not null), ',') else '' end as gates from t left join a using (track_id) left join b using (track_id)""")
def b13_reid_outcomes(spark, sf_dir):
    v = d.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    t = v.select(F.col("vec_id").alias("track_id"), F.when(F.col("vec_id") % 7 != 6, F.col("label")).alias("person_id"))
    i, k = F.col("vec_id"), F.col("k")
    dc = v.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(i.alias("track_id"), ((i % 5 == 0) & (k == 1)).alias("accepted"), F.when(i % 11 != 10, F.col("label") + k).alias("candidate_id"), F.round((i * 13 + k * 31) % 100 / 100.0, 2).alias("similarity"), F.when(k == 0, 0.55).otherwise(0.8).alias("threshold"), F.round(i % 20 / 100.0, 2).alias("margin"), F.lit(0.08).alias("required_margin"), F.when(i % 3 > 0, F.round(i * 7 % 100 / 100.0, 2)).alias("cluster_min"), (i % 9 == 1).alias("conflict"))
    return op.reid_outcomes(t, dc).withColumn("gates", F.array_join("gates", ","))


@query(""", wd as (select *, case when k % 17 = 3 then 'other' else 'H' || segment_id end as hyp from words), h as (select source_id, 'H' || segment_id as hyp, list(word_id || case when k % 41 = 40 then 'x' else '' end) as wids, [segment_id || case when any_value(turn) % 9 = 8 then 'x' else '' end] as sids from words join (select segment_id, turn from segments) using (segment_id) group by source_id, segment_id),
 w as (select h.source_id, h.hyp, x.word_id as known, x.hyp as named from (select source_id, hyp, unnest(wids) as wid from h) h left join wd x on x.source_id = h.source_id and x.word_id = h.wid), sg as (select source_id, segment_id, case when turn % 7 = 6 then ['other'] else ['H' || segment_id, 'more'] end as hyps from segments), s as (select h.source_id, h.hyp, g.segment_id as known, g.hyps from (select source_id, hyp, unnest(sids) as sid from h) h left join sg g on g.source_id = h.source_id and g.segment_id = h.sid),
 q as (select source_id, k % 2 = 1 as off from words where k % 10 = 0 or k % 10 = 5), e as (select source_id, 'hypothesis_reference_unresolved' as code from w where known is null union all select source_id, 'hypothesis_reference_unresolved' from s where known is null union all select source_id, 'hypothesis_word_binding_disagreement' from w where known is not null and named is distinct from hyp union all select source_id, 'hypothesis_segment_binding_disagreement' from s where known is not null and not list_contains(hyps, hyp) union all select source_id, 'source_review_original_word_disagreement' from q where off)
 select source_id, code, count(*) as n from e group by 1, 2""", "words")
def j28_dossier_audit(spark, sf_dir):
    w, s = d.words(spark, sf_dir), d.segments(spark, sf_dir)
    words = w.withColumn("hypothesis_id", F.when(F.col("k") % 17 == 3, "other").otherwise(F.concat(F.lit("H"), "segment_id")))
    mark = lambda c: F.when(c, "x").otherwise("")
    h = w.join(s.select("source_id", "segment_id", "turn"), ["source_id", "segment_id"]).groupBy("source_id", "segment_id").agg(F.collect_list(F.concat("word_id", mark(F.col("k") % 41 == 40))).alias("word_ids"), F.first("turn").alias("turn"))
    h = h.select("source_id", F.concat(F.lit("H"), "segment_id").alias("hypothesis_id"), "word_ids", F.array(F.concat("segment_id", mark(F.col("turn") % 9 == 8))).alias("segment_ids"))
    own = F.when(F.col("turn") % 7 == 6, F.array(F.lit("other"))).otherwise(F.array(F.concat(F.lit("H"), "segment_id"), F.lit("more")))
    q = w.where("k % 10 in (0, 5)").select("source_id", "word_id", F.when(F.col("k") % 2 == 1, F.concat("word", F.lit("!"))).otherwise(F.col("word")).alias("word"), "start_us", "end_us")
    return op.dossier_audit(h, words, s.select("source_id", "segment_id", own.alias("hypothesis_ids")), q)
