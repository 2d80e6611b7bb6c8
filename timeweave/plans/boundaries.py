"""Edges of clips over conversations whose turns begin and end with phrases, chosen by the turn and its length."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boundaries as op
from ..sources import derived as d
from .commercial import _class, _CUES, _FOLD
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

HEADS = ("", "mas ", "ele disse ", "Hoje ", "bom, ", "", "isso ", "mudando de assunto ", "", "e ", "(inaudível) ", "", "Amanhã ")
TAILS = (".", "", ".", "...", ".", " porque", "?", ".", ". compre agora na loja com desconto de 20 reais", ".", ".")
_H, _T = len(HEADS), len(TAILS)
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"

_DATA = f"""said as (select source_id, segment_id, source_id || '|' || segment_id as id, turn, length(text) as n, start_us, case when length(text) % 9 = 4 then start_us + 11000000 else end_us end as end_us, case when turn % 5 < 3 then 'A' else speaker end as speaker, case when length(text) % 37 = 36 then '' else ({_LIST(HEADS)})[((turn * 3 + length(text)) % {_H} + 1)::int] || rtrim(text, '.!? ' || chr(10)) || ({_LIST(TAILS)})[((turn + length(text)) % {_T} + 1)::int] end as text from segments),
 topic as (select source_id, turn // 5 as k, min(start_us) as t0, max(end_us) as t1 from said group by 1, 2),
 moments as (select s.source_id, s.source_id || '-M' || s.turn as moment_id, s.start_us + 1000000 as start_us, s.start_us + 12000000 as end_us, case when s.turn % 5 = 4 then [] when s.turn % 7 = 6 then ['lost'] when nx.segment_id is null then [s.segment_id] else [s.segment_id, nx.segment_id] end as segment_ids, (['required', 'helpful', 'none', 'unresolved', 'none', 'none'])[(s.n % 6 + 1)::int] as context, case when s.turn % 3 <> 2 then t0 end as topic_start_us, case when s.turn % 3 <> 2 then t1 end as topic_end_us
  from said s left join said nx on nx.source_id = s.source_id and nx.turn = s.turn + 1 join topic t on t.source_id = s.source_id and t.k = s.turn // 5),
 stories as (select source_id, source_id || '-M' || turn as moment_id, start_us - 10000000 as story_start_us, start_us + 30000000 as story_end_us, source_id % 2 = 0 as supported from said where turn % 4 = 1),
 questions as (select s.source_id, s.segment_id as question_id, s.start_us as question_start_us, s.end_us as question_end_us, a.start_us as answer_start_us, a.end_us as answer_end_us, s.n % 4 <> 0 as complete, case when s.n % 11 = 0 then ['lost', s.segment_id] when a.segment_id is null then [s.segment_id] else [s.segment_id, a.segment_id] end as segment_ids from said s left join said a on a.source_id = s.source_id and a.turn = s.turn + 1 where s.turn % 3 = 0)"""


def _tables(spark, sf_dir):
    """moments, segments, stories, questions."""
    s, n, turn = d.segments(spark, sf_dir), F.length("text"), F.col("turn")
    pick = lambda xs, i: F.array(*map(F.lit, xs))[(i % len(xs)).cast("int")]
    text = F.when(n % 37 == 36, "").otherwise(F.concat(pick(HEADS, turn * 3 + n), F.regexp_replace("text", r"[.!? \n]+\z", ""), pick(TAILS, turn + n)))
    s = s.select("source_id", "segment_id", "turn", n.alias("n"), "start_us", F.when(n % 9 == 4, F.col("start_us") + 11_000_000).otherwise(F.col("end_us")).alias("end_us"), F.when(turn % 5 < 3, "A").otherwise(F.col("speaker")).alias("speaker"), text.alias("text"))
    topic = s.groupBy("source_id", F.expr("turn div 5").alias("k")).agg(F.min("start_us").alias("t0"), F.max("end_us").alias("t1"))
    nxt = s.select("source_id", (F.col("turn") - 1).alias("turn"), F.col("segment_id").alias("a_id"), F.col("start_us").alias("a0"), F.col("end_us").alias("a1"))
    two = s.join(nxt, ["source_id", "turn"], "left")
    both, n, turn = F.when(F.col("a_id").isNull(), F.array("segment_id")).otherwise(F.array("segment_id", "a_id")), F.col("n"), F.col("turn")
    moment = F.concat("source_id", F.lit("-M"), "turn").alias("moment_id")
    ids = F.when(turn % 5 == 4, F.array().cast("array<string>")).when(turn % 7 == 6, F.array(F.lit("lost"))).otherwise(both)
    topical = lambda c: F.when(turn % 3 != 2, F.col(c))
    m = two.withColumn("k", F.expr("turn div 5")).join(topic, ["source_id", "k"])
    m = m.select("source_id", moment, (F.col("start_us") + 1_000_000).alias("start_us"), (F.col("start_us") + 12_000_000).alias("end_us"), ids.alias("segment_ids"), pick(("required", "helpful", "none", "unresolved", "none", "none"), n).alias("context"), topical("t0").alias("topic_start_us"), topical("t1").alias("topic_end_us"))
    stories = s.where("turn % 4 = 1").select("source_id", moment, (F.col("start_us") - 10_000_000).alias("story_start_us"), (F.col("start_us") + 30_000_000).alias("story_end_us"), (F.col("source_id") % 2 == 0).alias("supported"))
    questions = two.where("turn % 3 = 0").select("source_id", F.col("segment_id").alias("question_id"), F.col("start_us").alias("question_start_us"), F.col("end_us").alias("question_end_us"), F.col("a0").alias("answer_start_us"), F.col("a1").alias("answer_end_us"), (n % 4 != 0).alias("complete"), F.when(n % 11 == 0, F.array(F.lit("lost"), "segment_id")).otherwise(both).alias("segment_ids"))
    return m, s, stories, questions


_HAS = lambda p, x="low": f"regexp_matches({x}, '{p}')"
_PLACES = f"""{_DATA}, {_CUES}, {_class('said', 'k')}, l as (select *, trim(text) as tt, trim({_FOLD}) as low, row_number() over w as pos, start_us - lag(end_us) over w as gap from said window w as (partition by source_id order by start_us, end_us, segment_id)),
 pl as (select l.*, eligibility = 'excluded' as ad, {_HAS(op.CHANGE, 'l.low')} as change, {_HAS(op.UNHEARD, 'l.low')} as unheard, {_HAS(op.REFERS, 'l.low')} as refers, tt = '' as mute, {_HAS(op.DONE, 'tt')} as done from l join kclass using (id)),
 pv as (select a.*, (select arg_max({{'e': b.end_us, 'speaker': b.speaker, 'done': b.done}}, b.pos) from pl b where b.source_id = a.source_id and b.pos between a.pos - 3 and a.pos - 1 and b.end_us <= a.start_us) as ended from pl a),
 places as (select *, list_filter([case when mute then 'missing_text' end, case when {_HAS(op.CONTINUES)} then 'missing_antecedent_or_continuation' end, case when {_HAS(op.PREAMBLE)} then 'generic_preamble' end, case when ended is not null and ended.speaker = speaker and start_us - ended.e < 1000000 and not ended.done then 'mid_sentence' end], lambda x: x is not null) as opening, case when done and not {_HAS(op.TRAILS, 'tt')} and not {_HAS(op.HANGS)} then [] else ['incomplete_sentence_or_handoff'] end as ending from pv)"""

_BOUNDS = f"""{_PLACES}, c0 as (select m.*, coalesce((select min(pos) from places p where p.source_id = m.source_id and list_contains(m.segment_ids, p.segment_id)), (select min(pos) from places p where p.source_id = m.source_id and p.start_us < m.end_us and m.start_us < p.end_us)) as first, coalesce((select max(pos) from places p where p.source_id = m.source_id and list_contains(m.segment_ids, p.segment_id)), (select max(pos) from places p where p.source_id = m.source_id and p.start_us < m.end_us and m.start_us < p.end_us)) as last from moments m),
 c1 as (select c0.*, f.start_us as cs, l.end_us as ce, case when (f.refers or context in ('required', 'helpful')) and f.start_us - b.start_us <= 30000000 then first - 1 else first end as f1 from c0 left join places f on f.source_id = c0.source_id and f.pos = first left join places l on l.source_id = c0.source_id and l.pos = last left join places b on b.source_id = c0.source_id and b.pos = first - 1),
 st as (select c1.source_id, c1.moment_id, min(p.pos) as s1, max(p.pos) as s2 from c1 join stories t on t.source_id = c1.source_id and t.moment_id = c1.moment_id join places p on p.source_id = c1.source_id and p.start_us >= story_start_us and p.end_us <= story_end_us where supported and story_start_us <= cs and ce <= story_end_us and story_end_us - story_start_us <= 180000000 group by 1, 2),
 qp as (select q.*, (select min(pos) from places p where p.source_id = q.source_id and list_contains(q.segment_ids, p.segment_id)) as q1, (select max(pos) from places p where p.source_id = q.source_id and list_contains(q.segment_ids, p.segment_id)) as q2, (select count(*) from places p where p.source_id = q.source_id and list_contains(q.segment_ids, p.segment_id)) as found from questions q),
 qa as (select c1.source_id, c1.moment_id, min(q1) as q1, max(q2) as q2, list_sort(list(question_id)) as question_ids from c1 join qp on qp.source_id = c1.source_id where complete and answer_start_us is not null and found = len(qp.segment_ids) and abs(question_start_us - cs) <= 40000000 and (greatest(0, least(ce, answer_end_us) - greatest(cs, answer_start_us)) >= 0.25 * greatest(ce - cs, 1) or question_start_us < ce and cs < question_end_us) group by 1, 2),
 c2 as (select c1.*, list_min(list_filter([f1, s1, q1], lambda x: x is not null)) as p1, list_max(list_filter([last, s2, q2], lambda x: x is not null)) as p20, question_ids from c1 left join st using (source_id, moment_id) left join qa using (source_id, moment_id)),
 c3 as (select c2.*, case when not e.done and n.end_us - ce <= 30000000 then p20 + 1 else p20 end as p2 from c2 left join places e on e.source_id = c2.source_id and e.pos = p20 left join places n on n.source_id = c2.source_id and n.pos = p20 + 1),
 c4 as (select c3.*, (select start_us from places p where p.source_id = c3.source_id and p.pos = p1) as xs, (select end_us from places p where p.source_id = c3.source_id and p.pos = p2) as ye, (select {{'ad': bool_or(ad), 'change': bool_or(change and pos > p1), 'gap': bool_or(gap > 5000000 and pos > p1)}} from places p where p.source_id = c3.source_id and p.pos between p1 and p2) as r from c3),
 c5 as (select *, list_sort(list_filter([case when xs < topic_start_us or ye > topic_end_us then 'topic_boundary_crossed' end, case when r.ad then 'commercial_boundary_crossed' end, case when r.change then 'explicit_topic_transition_crossed' end, case when r.gap then 'context_gap_requires_review' end, case when ye - xs > 180000000 then 'duration_budget_exceeded' end, case when xs > start_us or ye < end_us then 'source_ids_do_not_cover_original' end], lambda x: x is not null)) as risks from c4),
 c6 as (select * exclude (start_us, end_us, question_ids), start_us as own_start, end_us as own_end, case when len(risks) = 0 and first is not null then xs else start_us end as start_us, case when len(risks) = 0 and first is not null then ye else end_us end as end_us, case when len(risks) = 0 and first is not null then coalesce(question_ids, []) else [] end as question_ids from c5),
 c7 as (select c6.*, (select arg_min({{'s': p.start_us, 'mute': p.mute, 'unheard': p.unheard, 'why': p.opening}}, p.pos) from places p where p.source_id = c6.source_id and p.start_us < c6.end_us and c6.start_us < p.end_us) as h, (select arg_max({{'e': p.end_us, 'mute': p.mute, 'unheard': p.unheard, 'why': p.ending}}, p.pos) from places p where p.source_id = c6.source_id and p.start_us < c6.end_us and c6.start_us < p.end_us) as t, (select list(p.segment_id order by p.pos) from places p where p.source_id = c6.source_id and p.start_us < c6.end_us and c6.start_us < p.end_us) as chosen,
  (select {{'a': bool_or(question_start_us < c6.start_us), 'b': bool_or(coalesce(answer_end_us, question_end_us) > c6.end_us or not coalesce(complete, false)), 'n': count(*)}} from questions q where q.source_id = c6.source_id and q.question_start_us < c6.end_us and c6.start_us < coalesce(answer_end_us, question_end_us)) as q from c6),
 c8 as (select *, (case when h is null then ['missing_text'] when h.unheard then ['asr_text_unresolved'] when h.mute then ['missing_text'] when h.s < start_us then ['source_segment_truncated'] else h.why end) || (case when q.a then ['question_before_clip'] else [] end) as opening, (case when t is null then ['missing_text'] when t.unheard then ['asr_text_unresolved'] when t.mute then ['missing_text'] when t.e > end_us then ['source_segment_truncated'] else t.why end) || (case when q.b then ['answer_or_payoff_unresolved'] else [] end) as ending from c7),
 c9 as (select *, case when first is null then ['missing_segment_evidence'] else list_sort(list_distinct(risks || opening || ending || list_filter([case when q.n > 0 and (q.a or q.b) then 'question_answer_unit_incomplete' end, case when end_us - start_us < 8000000 then 'below_hard_min_without_complete_unit_proof' end, case when context in ('required', 'unresolved') and start_us >= own_start then 'context_requirement_unresolved' end], lambda x: x is not null))) end as blockers from c8)"""


@query(f", {_PLACES} select source_id, segment_id, pos, array_to_string(opening, ',') as opening, array_to_string(ending, ',') as ending from places", "segments")
def n18_edge_quality(spark, sf_dir):
    found = op.edge_quality(_tables(spark, sf_dir)[1])
    return found.select("source_id", "segment_id", F.col("pos").cast("long").alias("pos"), F.array_join("opening", ",").alias("opening"), F.array_join("ending", ",").alias("ending"))


@query(f""", {_BOUNDS} select source_id, moment_id, start_us, end_us, xs as proposed_start_us, ye as proposed_end_us, case when len(blockers) > 0 then 'pending' when start_us < own_start or end_us > own_end then 'expand' else 'cut' end as decision, array_to_string(risks, ',') as risks, array_to_string(blockers, ',') as blockers,
 case when first is null then null when q.a then false when h is null or h.unheard or h.mute then null else len(opening) = 0 end as clean_opening, case when first is null then null when q.b then false when t is null or t.unheard or t.mute then null else len(ending) = 0 end as clean_ending, case when first is null then '' else array_to_string(coalesce(chosen, []), ',') end as segment_ids, array_to_string(question_ids, ',') as question_ids, greatest(0, own_start - start_us) as added_before_us, greatest(0, end_us - own_end) as added_after_us from c9""", "segments")
def c14_optimize_boundaries(spark, sf_dir):
    found = op.optimize_boundaries(*_tables(spark, sf_dir))
    return found.withColumns({x: F.array_join(x, ",") for x in ("risks", "blockers", "segment_ids", "question_ids")})
