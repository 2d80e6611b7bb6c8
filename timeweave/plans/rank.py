"""Ranking and selection over orders as clip candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import mean_of, ratio
from ..operators import rank as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_PARTS = "parts as (select l_orderkey as id, avg(case when l_linenumber % 5 <> 0 then l_discount end) as a, avg(case when l_linenumber % 3 <> 0 then l_tax end) as b, max(case when l_linenumber = 2 then l_quantity / 50 end) as q, count(*) as n from lineitem group by 1)"


def _parts(spark, sf_dir):
    when = lambda c, x: F.when(c, F.col(x))
    line = F.col("l_linenumber")
    return d.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.avg(when(line % 5 != 0, "l_discount")).alias("a"), F.avg(when(line % 3 != 0, "l_tax")).alias("b"), F.max(F.when(line == 2, F.col("l_quantity") / 50)).alias("q"), F.count(F.lit(1)).alias("n"))


@query(f"""with {_PARTS}, w as (select *, (case when a is null then 0 else 3 end + case when b is null then 0 else 2 end + case when q is null then 0 else 1 end)::double as have from parts)
 select id, round(coalesce(greatest(0, least(1, (coalesce(a * 3, 0) + coalesce(b * 2, 0) + coalesce(q, 0)) / nullif(have, 0) - case when n > 5 then 0.05 else 0 end - 0.08 * (1 - have / 6))), 0), 6) as score, round(have / 6, 6) as coverage from w""")
def t1_rank_candidates(spark, sf_dir):
    score, coverage = op.rank_score({"a": (F.col("a"), 3.0), "b": (F.col("b"), 2.0), "q": (F.col("q"), 1.0)}, [(F.col("n") > 5, 0.05)])
    return _parts(spark, sf_dir).select("id", F.round(F.coalesce(score, F.lit(0.0)), 6).alias("score"), F.round(coverage, 6).alias("coverage"))


@query(f"with {_PARTS} select id, round((coalesce(a, 0) + coalesce(b, 0) + coalesce(q, 0)) / nullif((a is not null)::int + (b is not null)::int + (q is not null)::int, 0), 6) as mean from parts")
def f10_null_skipping_mean(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", F.round(mean_of(F.col("a"), F.col("b"), F.col("q")), 6).alias("mean"))


@query("select moment_id, s between 8 and 180 or (format = 'F' and s between 8 and 300) as allowed, case when s between 30 and 90 then 1.0 when s between 15 and 120 then 0.75 when s between 8 and 180 or (format = 'F' and s between 8 and 300) then 0.35 else 0.0 end::double as fit from (select *, (end_us - start_us) / 1000000 * 3 as s from candidates)", "candidates")
def n19_duration_gate(spark, sf_dir):
    ok, fit = op.duration_gate((F.col("end_us") - F.col("start_us")) / 1_000_000 * 3, F.col("format") == "F")
    return d.candidates(spark, sf_dir).select("moment_id", ok.alias("allowed"), fit.alias("fit"))


_EVIDENCE = "ev as (select *, range(start_us // 15000000, (end_us - 1) // 15000000 + 1) as evidence from candidates)"
_SAME = """select a.source_id, a.moment_id as a, b.moment_id as b from ev a join ev b on a.source_id = b.source_id and a.moment_id < b.moment_id and a.start_us < b.end_us and b.start_us < a.end_us
 where (least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us)) / (greatest(a.end_us, b.end_us) - least(a.start_us, b.start_us)) >= 0.8
 or ((least(a.end_us, b.end_us) - greatest(a.start_us, b.start_us)) / least(a.end_us - a.start_us, b.end_us - b.start_us) >= 0.8 and len(list_intersect(a.evidence, b.evidence)) / least(len(a.evidence), len(b.evidence)) >= 0.8)"""


@query(f", {_EVIDENCE} {_SAME}", "candidates")
def t2_equivalent_pairs(spark, sf_dir):
    return op.equivalent_pairs(d.candidates(spark, sf_dir))


@query()
def t2_dedup_candidates(spark, sf_dir):
    c = d.candidates(spark, sf_dir)
    return op.greedy_groups(op.equivalent_pairs(c), c)


@query(""", c as (select source_id, moment_id, score, topic, format, start_us // 600000000 as part from candidates where score >= 0.5),
 r as (select distinct source_id, 0 as k, []::bigint[] as ids, []::varchar[] as topics, []::varchar[] as formats, []::bigint[] as parts, null::bigint as moment_id, null::double as score from c union all
 select source_id, k + 1, list_append(ids, b.m), list_append(topics, b.topic), list_append(formats, b.format), list_append(parts, b.part), b.m, b.s from (select source_id, k, ids, topics, formats, parts, max({'f': (not list_contains(topics, topic))::int + (not list_contains(formats, format))::int + (not list_contains(parts, part))::int, 's': s, 'neg': -m, 'm': m, 'topic': topic, 'format': format, 'part': part}) as b
  from (select r.source_id, r.k, r.ids, r.topics, r.formats, r.parts, c.moment_id as m, c.score as s, c.topic, c.format, c.part, max(c.score) over (partition by r.source_id) as best from r join c on c.source_id = r.source_id where r.k < 12 and not list_contains(r.ids, c.moment_id) and len(list_filter(r.topics, lambda t: t = c.topic)) < 2) where s >= best - 0.08::double group by all))
 select source_id, moment_id, k::bigint as rank, score from r where k > 0""", "candidates")
def t3_shortlist(spark, sf_dir):
    return op.diverse_shortlist(d.candidates(spark, sf_dir))


@query("select * from (select source_id, row_number() over (partition by source_id order by score desc, moment_id)::int as rank, moment_id, score from candidates) where rank <= 12", "candidates")
def t14_top_lists(spark, sf_dir):
    return op.top_per(d.candidates(spark, sf_dir), ["source_id"], [F.col("score").desc(), F.col("moment_id")], 12).select("source_id", "rank", "moment_id", "score")


@query("select topic, moment_id, pick::int as pick from (select *, row_number() over (order by turn, topic) as pick from (select *, row_number() over (partition by topic order by score desc, moment_id) as turn from candidates)) where pick <= 96", "candidates")
def t7_stratified_tracks(spark, sf_dir):
    return op.stratified(d.candidates(spark, sf_dir), "topic", [F.col("score").desc(), F.col("moment_id")], 96).select("topic", "moment_id", "pick")


@query("""select source_id, slot, moment_id from (select *, row_number() over (partition by source_id, slot order by score desc, moment_id) as k from (select *, (case when pos = 1 then 0 when pos = n then 9 else 1 + (pos - 2) * 8 // greatest(n - 2, 1) end)::int as slot from (
 select *, row_number() over (partition by source_id order by start_us, moment_id) as pos, count(*) over (partition by source_id) as n from candidates))) where k = 1""", "candidates")
def t11_spread_pick(spark, sf_dir):
    return op.spread_pick(d.candidates(spark, sf_dir), "source_id", [F.col("start_us"), F.col("moment_id")], [F.col("score").desc(), F.col("moment_id")], 10).select("source_id", "slot", "moment_id")


@query("select moment_id, least(1, score + 0.12 + case when format = 'F' then 0.1 when format = 'O' then 0.05 else 0 end) as pre_score from (select *, row_number() over (partition by source_id order by score desc, moment_id) as r from candidates) where r <= 120", "candidates")
def t15_global_review_input(spark, sf_dir):
    best = op.top_per(d.candidates(spark, sf_dir), ["source_id"], [F.col("score").desc(), F.col("moment_id")], 120)
    bonus = F.when(F.col("format") == "F", 0.1).when(F.col("format") == "O", 0.05).otherwise(0.0)
    return best.select("moment_id", F.least(F.lit(1.0), F.col("score") + 0.12 + bonus).alias("pre_score"))


@query("select label, count(*) as n from (select unnest(list_distinct([topic, format, case when n_lines = 0 then 'no_lines' else topic end])) as label from candidates) group by 1", "candidates")
def b41_exclusion_counts(spark, sf_dir):
    c = d.candidates(spark, sf_dir).withColumn("labels", F.array("topic", "format", F.when(F.col("n_lines") == 0, "no_lines").otherwise(F.col("topic"))))
    return op.exclusion_counts(c, "labels")


@query("select topic, sum(end_us - start_us)::bigint as us, round(sum(end_us - start_us) / sum(sum(end_us - start_us)) over (), 6) as share, round(count(*) filter (format = 'F') / count(*), 6) as final_share from candidates group by 1", "candidates")
def b34_topic_quality(spark, sf_dir):
    n = F.count(F.lit(1))
    t = d.candidates(spark, sf_dir).groupBy("topic").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"), ratio(F.count_if(F.col("format") == "F"), n).alias("final_share"))
    return t.select("topic", "us", ratio(F.col("us"), F.sum("us").over(Window.partitionBy())).alias("share"), "final_share")


@query("select source_id, moment_id, coalesce(lag(end_us) over w <= start_us, true) as clear, start_us - lag(start_us) over w as since from candidates window w as (partition by source_id order by start_us, moment_id)", "candidates")
def t13_recovery_queue(spark, sf_dir):
    w = Window.partitionBy("source_id").orderBy("start_us", "moment_id")
    return d.candidates(spark, sf_dir).select("source_id", "moment_id", F.coalesce(F.lag("end_us").over(w) <= F.col("start_us"), F.lit(True)).alias("clear"), (F.col("start_us") - F.lag("start_us").over(w)).alias("since"))


@query("""select source_id, case when max(score) >= 0.9 then 'selected' when count(*) < 5 then 'insufficient_evidence' when max(end_us - start_us) < 60000000 then 'video_too_short' else 'no_eligible_cuts' end as state, count(*) filter (score >= 0.9) as n_selected from candidates group by 1""", "candidates")
def n21_editorial_outcome(spark, sf_dir):
    state = F.when(F.max("score") >= 0.9, "selected").when(F.count(F.lit(1)) < 5, "insufficient_evidence").when(F.max(F.col("end_us") - F.col("start_us")) < 60_000_000, "video_too_short").otherwise("no_eligible_cuts")
    return d.candidates(spark, sf_dir).groupBy("source_id").agg(state.alias("state"), F.count_if(F.col("score") >= 0.9).alias("n_selected"))


# the shortlist's twin picks one row at a time
ORACLES["t3_shortlist"] = ORACLES["t3_shortlist"].replace("with ", "with recursive ", 1)
