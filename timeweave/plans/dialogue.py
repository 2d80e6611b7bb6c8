"""Questions and answers over conversations: ten of them are a source, its turns say phrases of scripts in turn or, where the text's length tells, any phrase."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dialogue as op
from ..operators import story
from ..sources import derived as d
from .commercial import _FOLD
from .questions import _KIND
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

PHRASES = ("como começou a gravação do disco?", "o disco e a gravação da banda.", "a gravação começou em casa", "que legal!", "você resolveu o problema do disco?", "sim, resolvi.", "por que a banda parou?", "porque a banda brigou", "e como foi?", "como assim?", "retomando, o disco da banda saiu.", "mudando de assunto", "ah", "quando você diz disco, o que significa?", "", "certo", "e o disco saiu bem.", "quando chegou a banda?", "no dia da gravação...", "tudo bem?")
#: Phrases and voices of four scripts of eight turns.
SCRIPTS = ((0, 1, 3, 2, 3, 16, 10, 11), (4, 15, 5, 6, 7, 7, 16, 18), (0, 9, 1, 2, 16, 13, 16, 17), (4, 8, 1, 3, 15, 5, 16, 12))
VOICES = ("AABBABCA", "ABCABABA", "ABABBABA", "AAABBCCB")
_FLAT, _WHO = [k for s in SCRIPTS for k in s], [v for s in VOICES for v in s]
_N = len(PHRASES)
_TALKS = f"""talks as (select *, case when n % 29 = 4 then null when n % 9 = 0 then ['A', 'B', 'C'][(n % 3 + 1)::int] else {_WHO}[slot] end as speaker, [{', '.join(repr(p) for p in PHRASES)}][(case when n % 9 = 0 then (n + turn) % {_N} else {_FLAT}[slot] end + 1)::int] as text from (select source_id // 10 as source_id, segment_id, turn, length(text) as n, (source_id % 4 * 8 + turn % 8 + 1)::int as slot, (source_id % 10) * 48000000 + turn * 6000000 as start_us, (source_id % 10) * 48000000 + turn * 6000000 + case when length(text) % 7 = 3 then 1500000 when length(text) % 11 = 5 then 6300000 else 5500000 end as end_us from segments))"""


def talks(spark, sf_dir):
    n, turn, source = F.length("text"), F.col("turn"), F.col("source_id")
    offset = source % 10 * 48_000_000 + turn * 6_000_000
    lit = lambda x: F.array(*map(F.lit, x))
    at = (source % 4 * 8 + turn % 8).cast("int")
    speaker = F.when(n % 29 == 4, F.lit(None)).when(n % 9 == 0, lit("ABC")[(n % 3).cast("int")]).otherwise(lit(_WHO)[at])
    text = lit(PHRASES)[F.when(n % 9 == 0, (n + turn) % _N).otherwise(lit(_FLAT)[at]).cast("int")]
    end = offset + F.when(n % 7 == 3, 1_500_000).when(n % 11 == 5, 6_300_000).otherwise(5_500_000)
    return d.segments(spark, sf_dir).select(F.expr("source_id div 10").alias("source_id"), "segment_id", offset.alias("start_us"), end.alias("end_us"), speaker.alias("speaker"), text.alias("text"))


_HAS = lambda p, x="low": f"regexp_matches({x}, '{p}')"
_GENERIC = ", ".join(f"'{w}'" for w in op.GENERIC)
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_FAMILY = f"case {' '.join(f'when regexp_matches(y, {p!r}) then {r!r}' for r, p in t.FAMILIES)} else y end"
_NO = "[]::varchar[]"
_FLAGS = {"reacts": op.REACTION, "clarifies": op.CLARIFY, "means": op.MEANING, "extends": op.EXTEND, "tells": op.TELL, "shifts": story.TOPIC_SHIFT, "resumes": op.RESUME, "joins": op.FRAGMENT, "hands": op.HAND_OFF, "polar": op.POLAR} | {f"reply{k}": p for k, (p, *_) in enumerate(op.REPLIES)}
_FACTS = f"""{_TALKS}, f0 as (select *, trim({_FOLD}) as low, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as words from talks), f1 as (select *, {_KIND.replace('w <=', 'words <=').replace('(v,', '(low,')} as kind from f0),
 f2 as (select *, kind in ('direct_question', 'yes_no_question') as asks, contains(text, '?') as marked, ends_with(text, '.') or ends_with(text, '!') as firm, ends_with(text, '.') or ends_with(text, '?') or ends_with(text, '!') as done, ends_with(text, '...') as trails, low in {_IN(op.TINY)} and end_us - start_us <= 2500000 as tiny, {', '.join(f'{_HAS(p)} as {n}' for n, p in _FLAGS.items())},
  list_distinct(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), lambda y: length(y) >= 3 and y not in ({_GENERIC}))) as plain from f1),
 s as (select *, list_distinct(list_transform(plain, lambda y: {_FAMILY})) as qa, row_number() over (partition by source_id order by start_us, end_us, segment_id) as i, count(*) over (partition by source_id) as cnt, lag(end_us) over (partition by source_id order by start_us, end_us, segment_id) as before_us from f2)"""
_ROW = ("start_us", "end_us", "segment_id", "speaker", "low", "words", "asks", "marked", "firm", "done", "trails", "tiny", *_FLAGS, "plain", "qa")
_REMARK = lambda plain: f"case when r_reacts then 'reaction_cue' when r_clarifies or r_asks and r_means and list_has_any(r_plain, {plain}) then 'clarification_cue' end"
_YES_NO = _KIND.replace("w <=", "pwords <=").replace("(v,", "(prompt,")


def _walk(name: str, seed: str) -> str:
    """The recursion that reads on from `seed`: source_id, i0, i (the last row read), hi, q_end, asker, asked, asked_qa, asked_plain, asked_words, first_id; and {name}_end, where it stands."""
    put = lambda cond, n, v: f"case when {cond} then {v} else {n} end"
    ans, ext, ctx = "what = 'answer'", "what = 'extend'", "what = 'context'"
    return f"""{name} as (select source_id, i0, i, hi, q_end, asker, null::varchar as stop, q_end as until, asked, asked_qa, asked_plain, asked_words, [first_id] as qids, q_end as question_end, '' as context, {_NO} as context_qa, 0::bigint as context_words, {_NO} as aids, null::bigint as a_start, null::bigint as a_end, {_NO} as a_qa, {_NO} as a_plain, {_NO} as speakers, null::varchar as voice, null::varchar as cue, {_NO} as last_qa, null::boolean as last_done, null::boolean as last_trails, {_NO} as rids, false as pending, null::varchar as clarifier from {seed}
 union all select source_id, i0, i + 1, hi, q_end, asker, case when what[1] = '*' then what[2:] end, {put("what[1] <> '*'", 'until', 'r_end_us')}, {put(ext, 'asked', "asked || ' ' || r_low")}, {put(ext, 'asked_qa', 'asked_qa || r_qa')}, {put(ext, 'asked_plain', 'asked_plain || r_plain')}, {put(ext, 'asked_words', 'asked_words + r_words')}, {put(ext, 'qids', 'list_append(qids, r_segment_id)')}, {put(ext, 'question_end', 'r_end_us')}, {put(ctx, 'context', "context || ' ' || r_low")}, {put(ctx, 'context_qa', 'context_qa || r_qa')}, {put(ctx, 'context_words', 'context_words + r_words')},
  {put(ans, 'aids', 'list_append(aids, r_segment_id)')}, {put(ans, 'a_start', 'coalesce(a_start, r_start_us)')}, {put(ans, 'a_end', 'r_end_us')}, {put(ans, 'a_qa', 'a_qa || r_qa')}, {put(ans, 'a_plain', 'a_plain || r_plain')}, {put(ans + ' and not list_contains(speakers, r_speaker)', 'speakers', 'list_append(speakers, r_speaker)')}, {put(ans, 'voice', 'r_speaker')}, {put(ans + ' and len(aids) = 0', 'cue', 'found')}, {put(ans, 'last_qa', 'r_qa')}, {put(ans, 'last_done', 'r_done')}, {put(ans, 'last_trails', 'r_trails')}, {put("what in ('context', 'aside', 'clarify', 'hold')", 'rids', 'list_append(rids, r_segment_id)')}, case when {ans} then false when what = 'hold' then true else pending end, {put("what = 'clarify'", 'clarifier', 'r_speaker')}
 from (select *, case when gap > case when answered then 20000000 else 10000000 end then '*pause_exceeds_search_window' when r_end_us - q_end > 125000000 then '*answer_search_window_exhausted' when asker is null or r_speaker is null then '*missing_speaker_evidence' when r_shifts then '*topic_change_observed'
   when not answered and own then case when clarifier is not null and not asking and near then 'context' when len(qids) < 5 and gap <= 5000000 and (asking and r_extends and (list_has_any(r_qa, asked_qa) or r_tells) or not asking and not r_firm) then 'extend' when remark is not null and short then 'aside' when asking then '*new_question_before_answer' else '*intervention_relevance_unresolved' end
   when not answered then case when asking then case when remark = 'clarification_cue' and short and (clarifier is null or clarifier = r_speaker) then 'clarify' when remark = 'clarification_cue' then '*clarification_before_answer_unresolved' else '*new_question_before_answer' end when r_tiny then 'aside' when clarifier <> r_speaker then '*clarification_speaker_changed' when shared or found is not null then 'answer' else '*answer_relevance_unresolved' end
   when r_speaker = voice then case when asking then '*new_question_during_answer' when r_start_us - a_end > 40000000 then '*pause_exceeds_resume_window' when not (shared or not last_done and r_joins and not r_resumes) or gap > 7000000 and not shared then '*answer_continuation_unresolved' else 'answer' end
   else case when not own and r_hands and shared and not asking then 'answer' when remark is not null and (own or remark = 'clarification_cue' and near) and short then 'hold' when asking then '*new_question_during_answer' when not own then '*third_speaker_intervention_unresolved' else '*intervention_relevance_unresolved' end end as what
 from (select *, r_asks and not (not r_marked and r_reply0 and {_HAS(op.REPLIES[0][1], 'asked')}) as asking, {_REMARK('(asked_plain || a_plain)')} as remark, greatest(r_end_us - r_start_us, 0) <= 12000000 and r_words <= 30 as short, list_has_any(r_qa, asked_qa || a_qa) as near, list_has_any(r_qa, asked_qa || case when answered then last_qa else context_qa end) as shared,
   case when r_polar and (pwords <= 2 or {_YES_NO} = 'yes_no_question') then 'polar_response_cue' {' '.join(f"when r_reply{k} and {_HAS(p, 'prompt')} then '{c}'" for k, (_, p, c) in enumerate(op.REPLIES))} end as found
 from (select w.*, len(aids) > 0 as answered, coalesce(r.speaker = asker, false) as own, r.start_us - until as gap, asked || context as prompt, asked_words + context_words as pwords, {', '.join(f'r.{x} as r_{x}' for x in _ROW)} from {name} w join s r on r.source_id = w.source_id and r.i = w.i + 1 where w.stop is null and w.i < w.hi)))),
 {name}_end as (select * from {name} qualify row_number() over (partition by source_id, i0 order by i desc) = 1)"""


_PAIRS = f"""{_FACTS}, seed as (select source_id, i as i0, i, i + case when asks then 32 else 0 end as hi, end_us as q_end, speaker as asker, low as asked, qa as asked_qa, plain as asked_plain, words as asked_words, segment_id as first_id from s where kind <> 'statement'), {_walk('rd', 'seed')},
 p0 as (select e.*, s.segment_id as question_id, s.kind, s.start_us, s.asks, coalesce(stop, case when s.cnt - i0 > 32 then 'answer_segment_search_limit' end) as halt from rd_end e join s on s.source_id = e.source_id and s.i = e.i0),
 edges as (select w.source_id, w.question_id as why, a.question_id, row_number() over (partition by w.source_id order by w.i0) as k from p0 w join p0 a on a.source_id = w.source_id and a.question_id = w.aids[1] where w.cue = 'causal_response_cue'),
 gone as (select source_id, 0::bigint as k, {_NO} as ids from edges group by 1 union all select g.source_id, e.k, case when list_contains(g.ids, e.why) then g.ids else list_append(g.ids, e.question_id) end from gone g join edges e on e.source_id = g.source_id and e.k = g.k + 1), left_out as (select source_id, arg_max(ids, k) as ids from gone group by 1),
 pairs as (select p0.source_id, question_id, i0, kind, asker as speaker, start_us, qids, question_end, case when not asks then 'not_expected' when len(aids) > 0 then 'linked_candidate' else 'unresolved' end as status, case when not asks then 'answer_not_expected' when asker is null then 'missing_speaker_evidence' when halt is not null then halt when len(aids) = 0 then 'no_subsequent_answer_span' when pending then 'answer_resume_not_observed' end as reason, aids, speakers, a_start, a_end, cue, rids, coalesce(last_done and not last_trails and asks and asker is not null and halt is null and not pending, false) as complete
  from p0 left join left_out l on l.source_id = p0.source_id where not coalesce(list_contains(l.ids, question_id), false))"""
_JOINED = "array_to_string(qids, ',') as question_ids, question_end as question_end_us, status, reason, array_to_string(aids, ',') as answer_ids, array_to_string(speakers, ',') as answer_speakers, a_start as answer_start_us, a_end as answer_end_us, cue, array_to_string(rids, ',') as remark_ids, complete"


def _flat(df):
    return df.withColumns({c: F.array_join(c, ",") for c in ("question_ids", "answer_ids", "answer_speakers", "remark_ids", "context_ids", "reaction_ids") if c in df.columns})


@query(f", {_PAIRS} select source_id, question_id, kind, speaker, start_us, {_JOINED} from pairs", "segments")
def c8_read_answers(spark, sf_dir):
    return _flat(op.read_answers(talks(spark, sf_dir)))


@query(f""", {_PAIRS}, parts as (select p.source_id, p.i0, p.question_id, p.kind, p.speaker, p.qids, max(s.i) as i1, max_by(s.end_us, s.i) as end_us, string_agg(s.low, ' ' order by s.i) as low, sum(s.words) as words, flatten(list(s.qa)) as qa, flatten(list(s.plain)) as plain from pairs p join s on s.source_id = p.source_id and s.i between p.i0 and p.i0 + 32 and list_contains(p.qids, s.segment_id) where p.status = 'unresolved' and p.speaker is not null group by all having count(*) = len(p.qids) and bool_and(coalesce(s.speaker = p.speaker, false))),
 bad as (select p.source_id, p.i0, min(s.i) as i, arg_min(case when s.end_us < s.start_us or s.start_us < s.before_us then 'source_interval_unresolved' else 'answer_search_window_exhausted' end, s.i) as why from parts p join s q on q.source_id = p.source_id and q.i = p.i0 join s on s.source_id = p.source_id and s.i > p.i1 and s.i <= p.i0 + 32 where s.end_us < s.start_us or s.start_us < s.before_us or s.end_us - q.end_us > 125000000 group by 1, 2),
 b as (select p.*, coalesce(bad.i - 1, least(p.i0 + 32, q.cnt)) as hi, coalesce(bad.why, case when q.cnt - p.i0 > 32 then 'answer_segment_search_limit' end) as until from parts p join s q on q.source_id = p.source_id and q.i = p.i0 left join bad on bad.source_id = p.source_id and bad.i0 = p.i0),
 cx as (select source_id, i0, i1 as i, hi, speaker, end_us as at_us, end_us as q_end, low, words, {_NO} as ctx, {_NO} as rx, qa, plain from b
  union all select source_id, i0, i + 1, hi, speaker, r_end_us, case when takes then r_end_us else q_end end, case when takes then low || ' ' || r_low else low end, case when takes then words + r_words else words end, case when takes then list_append(ctx, r_segment_id) else ctx end, case when takes then rx else list_append(rx, r_segment_id) end, case when takes then qa || r_qa else qa end, case when takes then plain || r_plain else plain end
  from (select *, r_speaker = speaker and len(ctx) < 3 and gap <= 5000000 and (not r_asks or r_extends and (list_has_any(r_qa, qa) or r_tells)) and len(list_intersect(r_qa, qa)) >= 2 as takes, r_speaker <> speaker and coalesce({_REMARK('plain')} = 'reaction_cue', false) and r_end_us - r_start_us <= 12000000 and r_words <= 30 and len(rx) < 3 as reaction
   from (select c.*, r.start_us - c.at_us as gap, {', '.join(f'r.{x} as r_{x}' for x in _ROW)} from cx c join s r on r.source_id = c.source_id and r.i = c.i + 1 where c.i < c.hi) where gap between 0 and 10000000 and r_speaker is not null and not r_shifts) where takes or reaction),
 c as (select * from cx qualify row_number() over (partition by source_id, i0 order by i desc) = 1), ck as (select *, {_KIND.replace('w <=', 'words <=').replace('(v,', '(low,')} in ('direct_question', 'yes_no_question') as asks from c where len(ctx) + len(rx) > 0),
 seed2 as (select ck.source_id, ck.i0, ck.i, case when ck.asks then ck.hi else ck.i end as hi, ck.q_end, ck.speaker as asker, ck.low as asked, ck.qa as asked_qa, ck.plain as asked_plain, ck.words as asked_words, s.segment_id as first_id from ck join s on s.source_id = ck.source_id and s.i = ck.i0), {_walk('rr', 'seed2')},
 n0 as (select e.*, b.question_id, b.kind, b.until as beyond, ck.ctx, ck.rx, ck.asks, b.qids || ck.ctx || e.qids[2:] as ids, e.rids || list_filter(ck.rx, lambda x: not list_contains(e.rids, x)) as remarks, case when not ck.asks then 'answer_not_expected' when e.stop is not null then e.stop when len(e.aids) = 0 then 'no_subsequent_answer_span' when e.pending then 'answer_resume_not_observed' end as why from rr_end e join ck on ck.source_id = e.source_id and ck.i0 = e.i0 join b on b.source_id = e.source_id and b.i0 = e.i0),
 seen as (select n0.source_id, n0.i0, s.segment_id, s.i, s.end_us, s.start_us < lag(s.end_us) over (partition by n0.source_id, n0.i0 order by s.i) as clash, list_contains(n0.ids, s.segment_id) as is_q, list_contains(n0.remarks, s.segment_id) as is_r, list_contains(n0.rx, s.segment_id) and trim(s.low, ' .!?,') in {_IN(op.YES_LIKE)} and s.speaker <> n0.speakers[1] as yes from n0 join s on s.source_id = n0.source_id and s.i between n0.i0 and n0.i0 + 33 and list_contains(n0.ids || n0.aids || n0.remarks, s.segment_id)),
 sx as (select source_id, i0, bool_or(coalesce(clash, false)) as clash, bool_or(coalesce(yes, false)) as yes, max_by(end_us, i) filter (is_q) as question_end, coalesce(list(segment_id order by i) filter (is_r), {_NO}) as rids from seen group by 1, 2),
 nw as (select n0.*, sx.question_end as new_end, sx.rids as new_rids, case when asks and len(aids) > 0 then case when kind = 'yes_no_question' and yes then 'polar_reaction_response_ownership_ambiguous' when clash then 'source_reference_or_temporal_overlap_unresolved' end end as fault from n0 join sx on sx.source_id = n0.source_id and sx.i0 = n0.i0),
 j as (select p.source_id, p.question_id, p.kind, p.speaker, p.start_us, coalesce(n.asks and len(n.aids) > 0 and n.fault is null, false) as recovered, coalesce(n.ctx, {_NO}) as ctx, coalesce(n.rx, {_NO}) as rx, coalesce(n.fault, n.why, n.beyond) as tried, p as old, n as new from pairs p left join nw n on n.source_id = p.source_id and n.i0 = p.i0)
 select source_id, question_id, kind, speaker, start_us, {_JOINED}, recovered, array_to_string(ctx, ',') as context_ids, array_to_string(rx, ',') as reaction_ids, tried from (select source_id, question_id, kind, speaker, start_us, recovered, ctx, rx, tried, case when recovered then new.ids else old.qids end as qids, case when recovered then new.new_end else old.question_end end as question_end, case when recovered then 'linked_candidate' else old.status end as status, case when recovered then coalesce(new.why, new.beyond) else old.reason end as reason, case when recovered then new.aids else old.aids end as aids, case when recovered then new.speakers else old.speakers end as speakers, case when recovered then new.a_start else old.a_start end as a_start, case when recovered then new.a_end else old.a_end end as a_end,
  case when recovered then new.cue else old.cue end as cue, case when recovered then new.new_rids else old.rids end as rids, case when recovered then coalesce(new.last_done and not new.last_trails and new.why is null and new.beyond is null, false) else old.complete end as complete from j)""", "segments")
def c9_recover_dialogue(spark, sf_dir):
    s = talks(spark, sf_dir)
    return _flat(op.recover_dialogue(s, op.read_answers(s)))


for _name in ORACLES:
    ORACLES[_name] = ORACLES[_name].replace("with ", "with recursive ", 1)
