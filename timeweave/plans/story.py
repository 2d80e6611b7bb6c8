"""Stories and humour over conversations whose turns begin with a phrase, chosen by the turn and its length."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import story as op
from ..sources import derived as d
from .commercial import _class, _CUES, _FOLD
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

PHRASES = ("um dia eu fui ao estúdio da banda", "mas tive um problema com o disco", "no final deu certo o disco da banda", "quando eu comecei no rádio", "só que a dificuldade era grande", "consegui gravar o disco no estúdio", "mudando de assunto", "", "[risos] que história", "até que ele caiu da cadeira azul", "pera aí", "retomando o disco da banda no estúdio", "eu tentei tocar o disco", "deu certo? não sei", "[inaudível]")
_N = len(PHRASES)
_TALES = f"tales as (select source_id, segment_id, segment_id as id, turn, start_us, end_us, speaker, source_id || '-T' || (turn // 5) as topic_id, [{', '.join(repr(p) for p in PHRASES)}][((turn * 7 + length(text)) % {_N} + 1)::int] || ' ' || text as text from segments)"


def tales(spark, sf_dir):
    phrase = F.array(*map(F.lit, PHRASES))[((F.col("turn") * 7 + F.length("text")) % _N).cast("int")]
    return d.segments(spark, sf_dir).withColumn("topic_id", F.concat("source_id", F.lit("-T"), F.expr("turn div 5"))).withColumn("text", F.concat(phrase, F.lit(" "), F.col("text")))


_GENERIC = ", ".join(f"'{w}'" for w in op.GENERIC)
_HAS = lambda p, x="low": f"regexp_matches({x}, '{p}')"
_LOW = f"low as (select *, {_FOLD} as low from tales)"
_OUTCOME = f"({_HAS(op.OUTCOME)} and not {_HAS(op.OPEN_OUTCOME)} and not contains(low, '?') and not {_HAS(op.UNFINISHED)})"
_ARCS = f"""{_TALES}, {_LOW}, {_CUES},
 r as (select source_id, topic_id, list({{'start_us': start_us, 'segment_id': segment_id, 'end_us': end_us, 'speaker': speaker, 'is_setup': {_HAS(op.SETUP)}, 'is_tension': {_HAS(op.TENSION)}, 'is_outcome': {_OUTCOME}, 'acts': {_HAS(op.ACTION)}, 'shifts': {_HAS(op.TOPIC_SHIFT)}, 'terms': list_distinct(list_filter(regexp_extract_all(low, '[a-z0-9_]+'), lambda w: length(w) > 3 and w not in ({_GENERIC})))}} order by start_us, segment_id) as rows, max(end_us) as to_us, min(start_us) as from_us, string_agg(text, ' ' order by start_us, segment_id) as text, source_id || '|' || topic_id as id, arg_max(text, start_us) as last_text from low group by source_id, topic_id having count(*) >= 3),
 qa as (select a.source_id, a.start_us as q, b.end_us as a, b.segment_id as answer_id from segments a join segments b on a.source_id = b.source_id and b.turn = a.turn + 1 where a.speaker = 'user' and length(b.text) % 3 = 0),
 r1 as (select r.*, (select arg_min(answer_id, q) from qa where qa.source_id = r.source_id and q >= from_us and a <= to_us and q < a and q < to_us and a > from_us) as answer_id, list_filter(rows, lambda x: x.is_setup)[1] as setup from r),
 r2 as (select *, list_filter(rows, lambda x: x.is_tension and x.start_us > setup.start_us)[1] as conflict from r1),
 r3 as (select *, list_filter(rows, lambda x: x.is_outcome and x.start_us > conflict.start_us)[1] as payoff from r2),
 r4 as (select *, list_filter(rows, lambda x: x.start_us >= setup.start_us and x.start_us <= payoff.start_us) as span from r3),
 r5 as (select *, coalesce(payoff is not null and setup.acts and setup.speaker is not null and conflict.speaker = setup.speaker and payoff.speaker = setup.speaker and list_has_any(payoff.terms, flatten(list_transform(list_filter(span, lambda x: x.start_us < payoff.start_us and x.speaker = setup.speaker), lambda x: x.terms))) and payoff.end_us - setup.start_us <= 360000000
  and len(list_filter(range(1, len(span)), lambda k: span[k + 1].start_us - span[k].end_us > 15000000)) = 0 and len(list_filter(span, lambda x: x.speaker is null or x.shifts or (x.speaker <> setup.speaker and x.end_us - x.start_us > 12000000))) = 0, false) as marked from r4),
 r6 as (select *, case when marked then 'complete_story' when answer_id is not null then 'qa_arc' when conflict is not null then 'partial_story' when setup is not null then 'anecdote' else 'discussion_segment' end as kind0 from r5),
 r7 as (select * exclude (setup, conflict, payoff), case when kind0 not in ('discussion_segment', 'qa_arc') then setup end as setup, case when kind0 not in ('discussion_segment', 'qa_arc') then conflict end as conflict, case when marked then payoff when answer_id is not null then list_filter(rows, lambda x: x.segment_id = answer_id)[1] end as payoff from r6),
 r8 as (select *, case when setup is null then [] else list_filter(rows, lambda x: x.start_us >= setup.end_us and (payoff is null or x.end_us <= payoff.start_us) and x.speaker is not distinct from setup.speaker) end as middle from r7),
 r9 as (select *, marked and len(middle) > 0 as told, case when marked and len(middle) = 0 then 'partial_story' else kind0 end as kind, rows[-1] as ending, coalesce(setup.start_us, from_us) as start_us from r8),
 {_class('r', 'k')},
 arcs as (select r9.source_id, topic_id, kind, start_us, ending.end_us as end_us, setup.segment_id as setup_id, conflict.segment_id as conflict_id, payoff.segment_id as payoff_id, array_to_string(list_transform(middle, lambda x: x.segment_id), ',') as middle_ids, ending.segment_id as ending_id,
  case when told or answer_id is not null then round(least(1.0, 0.55 + 0.1 * (setup is not null)::int + 0.15 * (case when answer_id is not null and not told then len(list_filter(rows[2:len(rows) - 1], lambda x: payoff is null or x.start_us < payoff.start_us)) > 0 else len(middle) > 0 end)::int + 0.15 * regexp_matches(rtrim(translate(last_text, '\n', ' ')), '[.?!]$')::int)::double, 6) end as score
  from r9 join kclass using (id) where eligibility <> 'excluded' and ending.end_us - start_us >= 8000000)"""


def _qas(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    a = s.where(F.length("text") % 3 == 0).select("source_id", (F.col("turn") - 1).alias("turn"), F.col("end_us").alias("answer_end_us"), F.col("segment_id").alias("answer_segment_id"))
    return s.where("speaker = 'user'").select("source_id", "turn", F.col("start_us").alias("question_start_us")).join(a, ["source_id", "turn"])


@query(f", {_ARCS} select * from arcs", "segments")
def c10_story_arcs(spark, sf_dir):
    return op.story_arcs(tales(spark, sf_dir), _qas(spark, sf_dir))


@query(f""", {_ARCS} select source_id, count(*) as n_arcs, count(*) filter (kind = 'complete_story') as complete, count(*) filter (kind = 'qa_arc') as answered, count(*) filter (kind in ('partial_story', 'anecdote')) as partial, count(*) filter (kind = 'discussion_segment') as discussions, count(*) filter (score is null) as without_score from arcs group by 1""", "segments")
def b43_recovery_report(spark, sf_dir):
    a, k = op.story_arcs(tales(spark, sf_dir), _qas(spark, sf_dir)), F.col("kind")
    return a.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_arcs"), F.count_if(k == "complete_story").alias("complete"), F.count_if(k == "qa_arc").alias("answered"), F.count_if(k.isin("partial_story", "anecdote")).alias("partial"), F.count_if(k == "discussion_segment").alias("discussions"), F.count_if(F.col("score").isNull()).alias("without_score"))


_QA_TERMS = lambda x: f"list_sort(list_distinct(list_transform(list_filter(regexp_extract_all({x}, '[a-z0-9]+'), lambda y: length(y) >= 3 and y not in ({', '.join(repr(w) for w in t.STOP_WORDS)})), lambda y: case {' '.join(f'when regexp_matches(y, {p!r}) then {r!r}' for r, p in t.FAMILIES)} else y end)))"


@query(f""", {_TALES}, {_LOW}, w as (select *, turn as pos, lag(end_us) over (partition by source_id order by turn) as ended from low), b as (select *, coalesce(max(case when start_us < ended then pos end) over (partition by source_id order by pos), -1) as broken from w),
 own as (select source_id, topic_id as arc_id, arg_min(speaker, turn) as speaker, max(turn) as last_pos, max(end_us) as last_end_us from low group by 1, 2), said as (select o.source_id, o.arc_id, {_QA_TERMS("string_agg(l.low, ' ')")} as terms from own o join low l on l.source_id = o.source_id and l.topic_id = o.arc_id and l.speaker = o.speaker group by 1, 2),
 j as (select o.source_id, o.arc_id, b.segment_id, b.pos, list_sort(list_filter({_QA_TERMS('b.low')}, lambda x: list_contains(s.terms, x))) as shared from own o join said s using (source_id, arc_id) join b on b.source_id = o.source_id and b.speaker = o.speaker and {_HAS(op.RESUMPTION, 'b.low')} and not {_HAS(op.TOPIC_SHIFT, 'b.low')} and pos > last_pos and pos <= last_pos + 256 and b.end_us - last_end_us <= 600000000 and broken <= last_pos)
 select source_id, arc_id, segment_id, rank::int as rank, array_to_string(shared, ',') as shared from (select *, row_number() over (partition by source_id, arc_id order by pos) as rank from j where len(shared) >= 2) where rank <= 2""", "segments")
def j13_arc_resumptions(spark, sf_dir):
    s = tales(spark, sf_dir)
    own = s.groupBy("source_id", F.col("topic_id").alias("arc_id")).agg(F.min_by("speaker", "turn").alias("speaker"), F.max("turn").alias("last_pos"), F.max("end_us").alias("last_end_us"))
    said = s.withColumnRenamed("topic_id", "arc_id").join(own.select("source_id", "arc_id", "speaker"), ["source_id", "arc_id", "speaker"]).groupBy("source_id", "arc_id").agg(t.qa_terms(F.array_join(F.collect_list("text"), " ")).alias("terms"))
    found = op.arc_resumptions(own.join(said, ["source_id", "arc_id"]), s.withColumn("pos", F.col("turn")))
    return found.withColumn("shared", F.array_join("shared", ","))


_MADE = """made as (select source_id, topic_id as arc_id, ['complete_story', 'partial_story', 'anecdote', 'discussion_segment'][(count(*) % 4 + 1)::int] as kind, list(segment_id order by turn) as ids, min(turn) as t0 from tales group by 1, 2),
 comp as (select *, case when t0 % 10 = 5 then [ids[1] || 'x'] else ids[1:1] end as setup, ids[2:greatest(len(ids) - 1, 1)] as development, case when t0 % 3 = 0 then [] else ids[-1:] end as payoff, ids[-1:] as ending from made)"""


def _made(spark, sf_dir):
    g = tales(spark, sf_dir).groupBy("source_id", F.col("topic_id").alias("arc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "segment_id"))), lambda x: x["segment_id"]).alias("ids"), F.min("turn").alias("t0"))
    none = F.array().cast("array<string>")
    kind = F.array(*map(F.lit, ("complete_story", "partial_story", "anecdote", "discussion_segment")))[(F.size("ids") % 4).cast("int")]
    first, last = F.slice("ids", 1, 1), F.slice("ids", -1, 1)
    setup = F.when(F.col("t0") % 10 == 5, F.array(F.concat(F.col("ids")[0], F.lit("x")))).otherwise(first)
    return g.select("source_id", "arc_id", kind.alias("kind"), "ids", "t0", setup.alias("setup"), F.slice("ids", 2, F.greatest(F.size("ids") - 2, F.lit(0))).alias("development"), F.when(F.col("t0") % 3 == 0, none).otherwise(last).alias("payoff"), last.alias("ending"))


@query(f""", {_TALES}, {_MADE}, p as (select source_id, arc_id, 'setup' as key, 0 as turn, unnest(setup) as sid, unnest(range(len(setup))) as k from comp union all select source_id, arc_id, 'development', 1, unnest(development), unnest(range(len(development))) from comp union all select source_id, arc_id, 'payoff', 2, unnest(payoff), unnest(range(len(payoff))) from comp),
 q as (select p.*, s.start_us, s.end_us, s.segment_id is not null as known, trim(coalesce(s.text, '')) <> '' as worded from p left join tales s on s.source_id = p.source_id and s.segment_id = p.sid),
 f as (select *, known and row_number() over (partition by source_id, arc_id, sid order by turn, k) = 1 as first from q), v as (select * from f where first), c as (select source_id, arc_id, count(*) filter (end_us < start_us) + count(*) filter (start_us < ended) as clashes from (select *, lag(end_us) over (partition by source_id, arc_id order by turn, k) as ended from v) group by 1, 2),
 g as (select source_id, arc_id, {', '.join(f"count(*) filter (key = '{k}') as n_{k}, count(*) filter (key = '{k}' and not known) as l_{k}, count(*) filter (key = '{k}' and known and not worded) as m_{k}, min(start_us) filter (key = '{k}') as lo_{k}, max(start_us) filter (key = '{k}') as hi_{k}" for k in ('setup', 'development', 'payoff'))} from q group by 1, 2),
 h as (select comp.source_id, comp.arc_id, coalesce(c.clashes, 0) as conflicts, list_filter([{', '.join(f"case when coalesce(n_{k}, 0) = 0 then 'no_{k}' when l_{k} > 0 then 'missing_{k}_reference' when m_{k} > 0 then 'unavailable_{k}_source_text' end" for k in ('setup', 'development', 'payoff'))}, case when coalesce(c.clashes, 0) > 0 then 'canonical_interval_conflict' end, case when n_setup > 0 and n_development > 0 and n_payoff > 0 and not coalesce(hi_setup < lo_development and hi_development < lo_payoff, false) then 'components_not_ordered' end], lambda x: x is not null) as reasons from comp left join g using (source_id, arc_id) left join c using (source_id, arc_id))
 select source_id, arc_id, array_to_string(reasons, ',') as reasons, conflicts, len(reasons) = 0 as supported from h""", "segments")
def b48_story_support(spark, sf_dir):
    return op.story_support(_made(spark, sf_dir).withColumn("evidence", F.col("ids")), tales(spark, sf_dir))


@query(f""", {_TALES}, {_MADE}, clip as (select *, ids[(1 + t0 % 2)::int:(len(ids) - (t0 // 5) % 2)::int] as selected from comp), x as (select *, kind in ('complete_story', 'partial_story', 'anecdote') and list_has_any(selected, ids) as story from clip),
 b as (select *, case when story then list_filter([case when kind <> 'complete_story' or len(setup) = 0 or len(development) = 0 or len(payoff) = 0 then 'story_payoff_not_grounded' end, {', '.join(f"case when not list_has_all(selected, {k}) then 'missing_story_{k}' end" for k in ('setup', 'development', 'payoff'))}, case when kind = 'complete_story' and not list_has_all(selected, ending) then 'missing_story_ending' end], lambda x: x is not null) else [] end as blockers from x)
 select source_id, arc_id, array_to_string(blockers, ',') as blockers, case when not story then 'not_applicable' when len(blockers) > 0 then 'incomplete' else 'complete_candidate' end as status from b""", "segments")
def c12_narrative_integrity(spark, sf_dir):
    start = (F.col("t0") % 2 + 1).cast("int")
    clips = _made(spark, sf_dir).withColumn("evidence", F.col("ids")).withColumn("selected", F.slice("ids", start, F.greatest(F.size("ids") - F.expr("cast((t0 div 5) % 2 as int)") - start + 1, F.lit(0))))
    return op.narrative_integrity(clips).select("source_id", "arc_id", F.array_join("blockers", ",").alias("blockers"), "status")


_CLIPS = "clips as (select source_id, segment_id as clip_id, start_us + (turn % 3) * 1000000 as start_us, end_us + 10000000 as end_us, turn % 2 = 0 as hinted from tales where end_us + 10000000 > start_us + (turn % 3) * 1000000)"


def _clips(spark, sf_dir):
    return tales(spark, sf_dir).select("source_id", F.col("segment_id").alias("clip_id"), (F.col("start_us") + F.col("turn") % 3 * 1_000_000).alias("start_us"), (F.col("end_us") + 10_000_000).alias("end_us"), (F.col("turn") % 2 == 0).alias("hinted")).where("end_us > start_us")


@query(f""", {_TALES}, {_LOW}, {_CLIPS}, s as (select source_id, start_us, end_us, {_HAS(op.LAUGHTER)} as laugh, {_HAS(op.PUNCHLINE)} and {_HAS('[a-z0-9_]', f"regexp_replace(regexp_replace(low, '{op.LAUGHTER}', '', 'g'), '{op.ASR_GAP}', '', 'g')")} as punch,
  {_HAS(op.PUNCHLINE)} and not {_HAS(op.ASR_GAP)} and not {_HAS(op.TEASER)} and len(regexp_extract_all(regexp_replace(regexp_replace(low, '{op.LAUGHTER}', '', 'g'), '{op.PUNCHLINE}', '', 'g'), '[a-z0-9_]+')) >= 2 and not {_HAS(op.HANGING)} as payoff, {_HAS(op.INTERRUPT)} as cut, {_HAS(op.JOKE_SETUP)} as setup, {_HAS(op.ASR_GAP)} as gap from low where end_us > start_us),
 j as (select c.source_id, c.clip_id, c.hinted, c.start_us as c0, c.end_us as c1, s.* exclude (source_id), s.end_us > c.start_us and s.start_us < c.end_us as ins, s.start_us >= c.end_us and s.start_us <= c.end_us + 16000000 as aft, s.start_us >= c.start_us - 5000000 and s.end_us <= c.start_us as bef from clips c left join s on s.source_id = c.source_id),
 g as (select source_id, clip_id, hinted, bool_or(ins and laugh) as laughs, bool_or(aft and laugh) as laughs_after, bool_or(aft and punch) as punch_after, bool_or(ins and payoff) as payoffs, bool_or(bef and setup) as setup_before, bool_or(ins and setup) as setups, bool_or(ins and cut) as cuts, max(start_us) filter (ins and cut) as last_cut, max(end_us) filter (ins and payoff) as last_payoff, bool_or(ins and (start_us < c0 or end_us > c1)) as truncated, bool_or(ins and gap) as gaps from j group by 1, 2, 3),
 b as (select *, list_filter([case when laughs_after then 'reaction_after_clip' end, case when (hinted or laughs or laughs_after) and punch_after then 'potential_punchline_after_clip' end, case when hinted and not payoffs then 'punchline_not_grounded' end, case when hinted and setup_before and not setups then 'setup_begins_before_clip' end, case when hinted and cuts and not payoffs then 'interruption_before_payoff' end, case when hinted and last_cut >= last_payoff then 'interruption_after_candidate_unresolved' end, case when (hinted or laughs or laughs_after) and truncated then 'humor_source_segment_truncated' end, case when hinted and gaps then 'asr_phrase_unresolved' end], lambda x: x is not null) as blockers from g)
 select source_id, clip_id, case when len(blockers) > 0 then 'incomplete' when laughs then 'observed_reaction' when hinted then 'unresolved' else 'not_applicable' end as status, case when gaps then 'asr_phrase_unresolved' when payoffs and hinted then 'punchline_candidate' when laughs then 'reaction_without_joke_evidence' when hinted then 'unresolved_humor' else 'not_applicable' end as classification, array_to_string(blockers, ',') as blockers from b""", "segments")
def c13_humor_integrity(spark, sf_dir):
    return op.humor_integrity(_clips(spark, sf_dir), tales(spark, sf_dir))


@query(f""", {_TALES}, {_LOW}, {_CLIPS}, s as (select source_id, segment_id, start_us, end_us, {_HAS(op.JOKE_SETUP)} as setup, {_HAS(op.PUNCHLINE)} or {_HAS(op.LAUGHTER)} as laugh, {_HAS(op.SUBJECT_CHANGE)} as change from low where end_us > start_us), u as (select source_id, max(end_us) as upper from low group by 1),
 p as (select c.source_id, c.clip_id, c.start_us as c0, c.end_us as c1, upper, coalesce((select arg_max(start_us, (start_us, end_us, segment_id)) from s where s.source_id = c.source_id and setup and s.start_us >= greatest(c.start_us - 5000000, 0) and s.end_us <= c.start_us), c.start_us) as p0, coalesce((select arg_max(end_us, (start_us, end_us, segment_id)) from s where s.source_id = c.source_id and laugh and s.start_us >= c.end_us and s.end_us <= least(c.end_us + 5000000, upper)), c.end_us) as p1 from clips c join u using (source_id)),
 m as (select p.source_id, p.clip_id, s.*, s.start_us - lag(s.end_us) over (partition by p.source_id, p.clip_id order by s.start_us, s.end_us, s.segment_id) as gap, upper from p join s on s.source_id = p.source_id and s.end_us > p0 and s.start_us < p1),
 un as (select source_id, clip_id, bool_or(change or coalesce(gap > 5000000, false) or start_us < 0 or end_us > upper) as unsafe from m group by 1, 2)
 select p.source_id, p.clip_id, case when coalesce(unsafe, false) then c0 else p0 end as proposed_start_us, case when coalesce(unsafe, false) then c1 else p1 end as proposed_end_us, coalesce(unsafe, false) as unsafe from p left join un using (source_id, clip_id)""", "segments")
def c13_humor_bounds(spark, sf_dir):
    return op.humor_bounds(_clips(spark, sf_dir), tales(spark, sf_dir))
