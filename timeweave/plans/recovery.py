"""Recovered stories over conversations: ten of them are a source, its turns begin with phrases of a story in turn, and every fourth turn is another voice's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recovery as op
from ..operators import story as words
from ..sources import derived as d
from .commercial import _class, _CUES, _FOLD
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

PHRASES = ("um dia eu fui ao estúdio da banda", "mas tive um problema com o disco", "continuei no estúdio com a banda", "no final deu certo o disco da banda", "quando eu comecei no rádio", "só que a dificuldade era grande", "consegui gravar tudo", "mudando de assunto", "eu tentei tocar o disco", "", "mas não consegui", "ao terminar estavam aplaudindo")
_N = len(PHRASES)
_LONG = f"""long as (select source_id // 10 as source_id, segment_id, (source_id % 10) * 100000000 + start_us as start_us, (source_id % 10) * 100000000 + end_us + case when turn % 7 = 3 then 14000000 else 0 end as end_us, case when turn % 4 = 3 then 'B' when turn % 16 = 14 then null else 'A' end as speaker, case when turn % 5 = 4 then []::varchar[] else [source_id || '-' || (turn // 3)] end as topics,
 [{', '.join(repr(p) for p in PHRASES)}][((turn + source_id + case when length(text) % 6 = 0 then 5 else 0 end) % {_N} + 1)::int] || ' ' || text as text from segments)"""


def long_talks(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    offset = F.col("source_id") % 10 * 100_000_000
    phrase = F.array(*map(F.lit, PHRASES))[((F.col("turn") + F.col("source_id") + F.when(F.length("text") % 6 == 0, 5).otherwise(0)) % _N).cast("int")]
    topics = F.when(F.col("turn") % 5 == 4, F.array().cast("array<string>")).otherwise(F.array(F.concat_ws("-", "source_id", F.expr("turn div 3"))))
    speaker = F.when(F.col("turn") % 4 == 3, "B").when(F.col("turn") % 16 == 14, F.lit(None)).otherwise("A")
    return s.select(F.expr("source_id div 10").alias("source_id"), "segment_id", (offset + F.col("start_us")).alias("start_us"), (offset + F.col("end_us") + F.when(F.col("turn") % 7 == 3, 14_000_000).otherwise(0)).alias("end_us"), speaker.alias("speaker"), topics.alias("topic_ids"), F.concat(phrase, F.lit(" "), F.col("text")).alias("text"))


_HAS = lambda p, x="low": f"regexp_matches({x}, '{p}')"
_GENERIC = ", ".join(f"'{w}'" for w in words.GENERIC)
_MUSIC = "[" + ", ".join(f"'{w}'" for w in op.MUSIC) + "]"


@query(f""", {_LONG}, {_CUES}, l0 as (select *, {_FOLD} as low from long),
 s as (select *, row_number() over (partition by source_id order by start_us, end_us, segment_id) as i, {_HAS(words.ACTION)} as acts, {_HAS(words.CONFLICT)} as conflicts, {_HAS(words.TOPIC_SHIFT)} as shifts, ({_HAS(words.OUTCOME)} and not {_HAS(words.OPEN_OUTCOME)} and not contains(low, '?') and not {_HAS(words.UNFINISHED)}) as outcome,
  list_distinct(list_filter(regexp_extract_all(low, '[a-z0-9_]+'), lambda w: length(w) > 3 and w not in ({_GENERIC}))) as terms from l0),
 op0 as (select a.source_id, a.i as i0, a.i as i, a.low as said, a.end_us as until from s a where not shifts and speaker is not null union all select o.source_id, o.i0, b.i, o.said || ' ' || b.low, b.end_us from op0 o join s a on a.source_id = o.source_id and a.i = o.i0 join s b on b.source_id = o.source_id and b.i = o.i + 1 where b.i <= o.i0 + 3 and b.speaker = a.speaker and b.start_us < a.start_us + 6000000 and not b.shifts and b.start_us - o.until <= 15000000 and not b.conflicts),
 an as (select source_id, i0, max(i) as i1, arg_max(said, i) as said from op0 group by 1, 2), st as (select an.source_id, i0, i1, a.start_us as from_us, a.speaker as voice, z.start_us as opened_us, a.topics from an join s a on a.source_id = an.source_id and a.i = i0 join s z on z.source_id = an.source_id and z.i = i1 where {_HAS(words.ACTION, 'said')}),
 rd as (select source_id, i0, i0 - 1 as i, null::varchar as stop, null::bigint as until, topics, []::varchar[] as told, false as trouble, false as acted, null::bigint as conflict, null::bigint as conflict_us, null::bigint as payoff from st
  union all select source_id, i0, case when before is null then ri else i end, coalesce(before, case when out then case when good then 'outcome' else 'outcome_continuity_unresolved' end end), case when before is null then r_end else until end, case when before is null and len(rtopics) > 0 then rtopics else topics end, case when before is null and own then list_distinct(told || rterms) else told end,
   trouble or (before is null and own and rconflicts), case when before is null then acted1 else acted end, case when before is null and found then ri else conflict end, case when before is null then c_us else conflict_us end, case when before is null and out and good then ri else payoff end from (
   select *, coalesce(own and r_start > c_us and routcome and acted1, false) as out, list_has_any(rterms, told) or ({_HAS(op.CLOSING, 'rlow')} and {_HAS(op.APPLAUSE, 'rlow')}) or ({_HAS(op.RESOLUTION, 'trim(rlow)')} and trouble) or (len(list_intersect(told, {_MUSIC})) >= 2 and list_has_any(rterms, {_MUSIC}) and {_HAS(op.RECORDED, 'rlow')} and trouble) as good from (
   select *, case when own and conflict is null and rconflicts and r_start > opened_us then r_start else conflict_us end as c_us, own and conflict is null and rconflicts and r_start > opened_us as found, acted or (own and racts) as acted1,
    case when r_end - from_us > 360000000 then 'story_time_window_exhausted' when r_start - until > 15000000 then 'story_pause_exceeds_window' when rshifts then 'topic_change_observed' when i >= i0 and len(rtopics) > 0 and len(topics) > 0 and not list_has_any(rtopics, topics) and not list_has_any(rterms, told) then 'cross_chunk_continuity_unresolved' when rspeaker is null then 'missing_speaker_evidence' when not own and r_end - r_start > 12000000 then 'long_speaker_interruption' end as before from (
   select rd.*, st.from_us, st.opened_us, s.i as ri, s.start_us as r_start, s.end_us as r_end, s.speaker as rspeaker, coalesce(s.speaker = st.voice, false) as own, s.topics as rtopics, s.terms as rterms, s.low as rlow, s.acts as racts, s.conflicts as rconflicts, s.shifts as rshifts, s.outcome as routcome from rd join st using (source_id, i0) join s on s.source_id = rd.source_id and s.i = rd.i + 1 where rd.stop is null)))),
 fin as (select rd.source_id, rd.i0, max(rd.i) as n, arg_max(coalesce(stop, 'outcome_not_observed'), (rd.i, stop is not null)) as stop, max(conflict) as conflict, max(payoff) as payoff from rd group by 1, 2),
 w as (select fin.source_id, fin.i0, n, stop, conflict, payoff, st.i1, st.from_us, st.voice, list(s.segment_id order by s.i) as segment_ids, max_by(s.end_us, s.i) as end_us, sum(s.end_us - s.start_us) filter (s.speaker = voice) as mine, sum(s.end_us - s.start_us) filter (s.speaker is not null) as every, string_agg(s.text, ' ' order by s.i) as text,
   coalesce(list(s.segment_id order by s.i) filter (s.i > st.i1 and s.speaker = voice and s.i is distinct from payoff), []) as development, coalesce(list(s.segment_id order by s.i) filter (s.speaker <> voice), []) as others, max(s.segment_id) filter (s.i = conflict) as conflict_id, max(s.segment_id) filter (s.i = payoff) as payoff_id, list(s.segment_id order by s.i) filter (s.i <= st.i1) as setup0, min_by(list_sort(s.topics), s.i)[1] as topic_id
   from fin join st using (source_id, i0) join s on s.source_id = fin.source_id and s.i between fin.i0 and n where conflict is not null group by 1, 2, 3, 4, 5, 6, 7, 8, 9),
 wx as (select *, source_id || '|' || i0 as id from w where end_us - from_us >= 8000000 and mine >= 0.7 * every), {_class('wx', 'k')},
 kept as (select wx.*, max(end_us) over (partition by source_id order by i0 rows between unbounded preceding and 1 preceding) as covered from wx join kclass using (id) where eligibility <> 'excluded')
 select k.source_id, (row_number() over (partition by k.source_id order by i0) - 1)::int as arc_no, case when payoff is not null and len(development) > 0 then 'complete_story' else 'partial_story' end as kind, from_us as start_us, k.end_us, topic_id, array_to_string(segment_ids, ',') as segment_ids, (select string_agg(segment_id, ',' order by s.i) from s where s.source_id = k.source_id and s.i between i0 and i1) as setup_ids, conflict_id, array_to_string(development, ',') as development_ids, payoff_id, array_to_string(others, ',') as interruption_ids,
  case when payoff is not null and len(development) > 0 then null when stop = 'outcome' then 'outcome_not_observed' else stop end as stop_reason from kept k where covered is null or covered < k.end_us""", "segments")
def c11_recover_arcs(spark, sf_dir):
    found = op.recover_arcs(long_talks(spark, sf_dir))
    return found.withColumns({x: F.array_join(x, ",") for x in ("segment_ids", "setup_ids", "development_ids", "interruption_ids")})


for _name in ORACLES:
    ORACLES[_name] = ORACLES[_name].replace("with ", "with recursive ", 1)
