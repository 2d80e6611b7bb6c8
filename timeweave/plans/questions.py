"""Audits of questions and answers over conversations, and of contracts in JSON texts put together from the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import questions as op
from ..operators import review as rv
from ..sources import derived as d
from .commercial import _FOLD
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

PHRASES = ("quem veio?", "porque sim", "você foi?", "quem nunca", "quer dizer, qual?", "o que é de", "ninguém sabe...")
_N = len(PHRASES)
_ASKED = f"asked as (select source_id, segment_id, turn, start_us, end_us, speaker, length(text) as n, [{', '.join(repr(p) for p in PHRASES)}][((turn + source_id) % {_N} + 1)::int] || case when turn % 3 = 0 then '' else ' ' || text end as text from segments)"


def _asked(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    phrase = F.array(*map(F.lit, PHRASES))[((F.col("turn") + F.col("source_id")) % _N).cast("int")]
    return s.select("source_id", "segment_id", "turn", "start_us", "end_us", "speaker", F.length("text").alias("n"), F.concat(phrase, F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit(" "), F.col("text")))).alias("text"))


_TABLES = f"""{_ASKED}, qa as (select a.source_id, a.segment_id as question_id, a.turn as place, a.n, case when a.n % 23 = 0 then a.text || 'x' else a.text end as question, case when a.n % 5 <> 0 then b.text end as answer, case when a.n % 17 = 0 then null when a.n % 13 = 0 then [a.segment_id || 'x'] else [a.segment_id] end as question_segment_ids, case when b.segment_id is null then null when a.turn % 8 = 6 then [a.source_id || '-1'] else [b.segment_id] end as answer_segment_ids,
  a.start_us + case when a.n % 9 = 0 then 20000 else 0 end as question_start_us, a.end_us as question_end_us, b.start_us as answer_start_us, b.end_us - case when a.n % 9 = 1 then 20000 else 0 end as answer_end_us, case when a.n % 10 <> 0 then a.speaker end as question_speaker, case when a.n % 15 = 1 then a.speaker else b.speaker end as answer_speaker, case when a.n % 6 <> 0 then a.turn % 8 <> 4 end as answer_expected, case when a.n % 3 > 0 then a.n % 4 = 0 end as question_answer_complete,
  case when a.n % 12 = 0 then 'no_turn_after' end as unresolved_reason, a.n % 2 = 0 as substantive, a.n % 3 as shared_terms from asked a left join asked b on b.source_id = a.source_id and b.turn = a.turn + 1 where a.turn % 2 = 0),
 cq as (select source_id, segment_id as question_id, turn as place, case when n % 8 = 0 then upper(text) else text end as question, start_us as question_start_us, case when n % 14 <> 0 then true end as answer_expected from asked where turn % 2 = 0 and turn % 6 <> 2 or turn % 2 = 1 and turn % 5 = 3),
 ex as (select source_id, question_id, question, case when n % 16 = 0 then 'y' else answer end as answer from qa where place % 4 = 0 union all select source_id, question_id, question, answer from qa where place % 4 = 0 and n % 18 = 0),
 ln as (select source_id, segment_id as question_id from asked where turn % 3 = 0)"""


def _tables(spark, sf_dir):
    """The two collections, the segments, exports and links."""
    a = _asked(spark, sf_dir)
    nxt = a.select("source_id", (F.col("turn") - 1).alias("turn"), F.col("segment_id").alias("b_id"), F.col("start_us").alias("b0"), F.col("end_us").alias("b1"), F.col("speaker").alias("b_speaker"), F.col("text").alias("b_text"))
    n, turn = F.col("n"), F.col("turn")
    j = a.where("turn % 2 = 0").join(nxt, ["source_id", "turn"], "left")
    qids = F.when(n % 17 == 0, F.lit(None)).when(n % 13 == 0, F.array(F.concat("segment_id", F.lit("x")))).otherwise(F.array("segment_id"))
    aids = F.when(F.col("b_id").isNull(), F.lit(None)).when(turn % 8 == 6, F.array(F.concat("source_id", F.lit("-1")))).otherwise(F.array("b_id"))
    cols = {
        "question": F.when(n % 23 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "answer": F.when(n % 5 != 0, F.col("b_text")), "question_segment_ids": qids, "answer_segment_ids": aids, "question_start_us": F.col("start_us") + F.when(n % 9 == 0, 20_000).otherwise(0), "question_end_us": F.col("end_us"), "answer_start_us": F.col("b0"), "answer_end_us": F.col("b1") - F.when(n % 9 == 1, 20_000).otherwise(0),
        "question_speaker": F.when(n % 10 != 0, F.col("speaker")), "answer_speaker": F.when(n % 15 == 1, F.col("speaker")).otherwise(F.col("b_speaker")), "answer_expected": F.when(n % 6 != 0, turn % 8 != 4), "question_answer_complete": F.when(n % 3 > 0, n % 4 == 0), "unresolved_reason": F.when(n % 12 == 0, "no_turn_after"), "substantive": n % 2 == 0, "shared_terms": n % 3,
    }
    qa = j.select("source_id", F.col("segment_id").alias("question_id"), turn.alias("place"), "n", *(c.alias(k) for k, c in cols.items()))
    cq = a.where("turn % 2 = 0 and turn % 6 <> 2 or turn % 2 = 1 and turn % 5 = 3").select("source_id", F.col("segment_id").alias("question_id"), turn.alias("place"), F.when(n % 8 == 0, F.upper("text")).otherwise(F.col("text")).alias("question"), F.col("start_us").alias("question_start_us"), F.when(n % 14 != 0, F.lit(True)).alias("answer_expected"))
    own = qa.where("place % 4 = 0")
    ex = own.select("source_id", "question_id", F.lit(0).alias("place"), "question", F.when(F.col("n") % 16 == 0, "y").otherwise(F.col("answer")).alias("answer")).union(own.where("n % 18 = 0").select("source_id", "question_id", F.lit(1), "question", "answer"))
    return [qa.drop("n"), cq], a, ex, a.where("turn % 3 = 0").select("source_id", F.col("segment_id").alias("question_id"))


_KIND = f"case when not (contains(v, '?') or regexp_matches(v, '{rv.ASKS}')) then 'statement' when regexp_matches(v, '{rv.GREETING}') then 'greeting_question' when regexp_matches(v, '{rv.SELF}') then 'self_question' when regexp_matches(v, '{rv.RHETORICAL}') and w <= 12 then 'rhetorical_question' when regexp_matches(v, '{rv.TAG}') and not regexp_matches(v, '{rv.OPEN_WORD}') then 'tag_question' when w <= 2 and not regexp_matches(v, '{rv.ASK_WORD}') then 'banter' when regexp_matches(v, '{rv.YES_NO}') then 'yes_no_question' else 'direct_question' end"
_SQUEEZE = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\r]+', ' ', 'g'))"


def _side(side: str, who: str) -> str:
    f = lambda x: f"{side}_{x}"
    return f"""{side[0]}e as (select source_id, question_id, unnest({f('segment_ids')}) as sid, unnest(range(len({f('segment_ids')}))) as k from base where {who}),
 {side[0]}g as (select e.source_id, e.question_id, count(*) as n, count(s.segment_id) as found, arg_min(s.start_us, k) as s0, arg_max(s.end_us, k) as s1, bool_or(s.speaker is null) as mute, list(s.speaker) as voices, string_agg(s.text, ' ' order by k) as text from {side[0]}e e left join asked s on s.source_id = e.source_id and s.segment_id = e.sid group by 1, 2),
 {side[0]}w as (select b.source_id, b.question_id, list_filter([case when coalesce(len({f('segment_ids')}), 0) = 0 then '{f("segment_ids_missing")}' end, case when found < n then '{f("segment_missing")}' end, case when found = n and ({f('start_us')} is null or {f('end_us')} is null) then '{f("timestamp_unavailable")}' end, case when found = n and (abs({f('start_us')} - s0) > 10000 or abs({f('end_us')} - s1) > 10000) then '{f("timestamp_mismatch")}' end,
   case when found = n and ({f('speaker')} is null or mute) then '{f("speaker_unavailable")}' end, case when found = n and {f('speaker')} is not null and not mute and len(list_filter(voices, lambda x: x <> {f('speaker')})) > 0 then '{f("speaker_mismatch")}' end, case when found = n and {side} is null then '{f("text_unavailable")}' end, case when found = n and {_SQUEEZE(side)} <> {_SQUEEZE('g.text')} then '{f("text_mismatch")}' end], lambda x: x is not null) as why from base b left join {side[0]}g g using (source_id, question_id) where {who})"""


_CASES = f"""{_TABLES}, ids as (select source_id, question_id from qa union select source_id, question_id from cq union select source_id, question_id from ex union select source_id, question_id from ln),
 base as (select i.source_id, i.question_id, coalesce(qa.question_id, cq.question_id) is not null as recorded, case when qa.question_id is not null then qa.question else cq.question end as question, qa.answer, qa.question_segment_ids, qa.answer_segment_ids, case when qa.question_id is not null then qa.question_start_us else cq.question_start_us end as question_start_us, qa.question_end_us, qa.answer_start_us, qa.answer_end_us, qa.question_speaker, qa.answer_speaker,
   case when qa.question_id is not null then qa.answer_expected else cq.answer_expected end as expected, qa.question_answer_complete as complete, unresolved_reason, substantive, shared_terms, case when qa.question_id is not null and cq.question_id is not null then list_filter([case when qa.answer_expected is distinct from cq.answer_expected then 'answer_expected' end, case when qa.question is distinct from cq.question then 'question' end, case when qa.question_start_us is distinct from cq.question_start_us then 'question_start_us' end], lambda x: x is not null) else [] end as conflicts,
   coalesce(qa.answer, '') <> '' and coalesce(len(qa.answer_segment_ids), 0) > 0 as linked, (select count(*) from ln where ln.source_id = i.source_id and ln.question_id = i.question_id) as n_links, (select count(*) from ex where ex.source_id = i.source_id and ex.question_id = i.question_id) as n_exports,
   exists (select 1 from ex where ex.source_id = i.source_id and ex.question_id = i.question_id and (ex.question is distinct from qa.question or ex.answer is distinct from qa.answer)) as export_clash from ids i left join qa using (source_id, question_id) left join cq using (source_id, question_id)),
 {_side('question', 'recorded')}, {_side('answer', 'linked')},
 sh as (select source_id, answer_segment_ids, list_sort(list(question_id)) as sharers from base where linked group by 1, 2 having count(*) > 1),
 x as (select base.*, trim({_FOLD.replace("text", "question")}) as v, coalesce(sharers, []) as sharers, coalesce(qw.why, []) || coalesce(aw.why, []) as why from base left join sh on linked and sh.source_id = base.source_id and sh.answer_segment_ids = base.answer_segment_ids left join qw on qw.source_id = base.source_id and qw.question_id = base.question_id left join aw on aw.source_id = base.source_id and aw.question_id = base.question_id),
 y as (select *, len(list_filter(regexp_split_to_array(v, '\\s+'), lambda z: z <> '')) as w from x), z as (select *, case when v <> '' then {_KIND} end as kind from y),
 cases as (select source_id, question_id, recorded, conflicts, list_filter([case when kind in ('direct_question', 'yes_no_question') then 'direct_question_candidate' end, case when kind in ('rhetorical_question', 'self_question') then 'rhetorical_question_candidate' end, case when v <> '' and regexp_matches(v, '{op.REFORMULATION}') then 'reformulation_cue' end, case when v <> '' and regexp_matches(v, '{op.OPEN_END}') then 'truncated_phrase_cue' end, case when expected and not linked then 'question_without_observed_answer_span' end, case when not expected then 'answer_not_expected' end], lambda q: q is not null) as categories, case when recorded then linked end as associated, expected, complete,
   list_sort(list_distinct(why || list_filter([case when not recorded then 'question_record_missing' end, case when len(conflicts) > 0 then 'source_record_conflict' end, case when n_exports > 1 then 'duplicate_export_id' end, case when n_links > 0 and n_exports = 0 then 'candidate_reference_not_exported' end, case when export_clash then 'export_record_conflict' end, case when v like 'porque %' and not contains(v, '?') then 'porque_without_question_mark_ambiguous' end, case when kind = 'banter' and contains(v, '?') and regexp_matches(v, '{op.SHORT_ASK}') then 'short_interrogative_classified_as_banter' end, case when v = '' then 'question_text_unavailable' end,
    case when expected and not linked then coalesce(unresolved_reason, 'no_observed_answer_span') end, case when complete then 'heuristic_completeness_not_audio_verified' end, case when complete and not linked then 'complete_without_associated_answer' end, case when linked and substantive and not coalesce(shared_terms > 0, false) then 'substantive_turn_only_relevance' end, case when linked and (question_speaker is null or answer_speaker is null) then 'turn_ownership_unavailable' end, case when linked and question_speaker = answer_speaker then 'same_speaker_association' end, case when linked and answer_start_us < question_end_us then 'answer_precedes_question_end' end, case when len(sharers) > 1 then 'shared_answer_span' end], lambda q: q is not null))) as reasons, sharers, n_links, n_exports from z)"""


def _cases(spark, sf_dir):
    found, segments, exports, links = _tables(spark, sf_dir)
    return op.qa_audit(found, segments, exports, links)


@query(f", {_CASES} select source_id, question_id, recorded, array_to_string(conflicts, ',') as conflicting_fields, array_to_string(categories, ',') as categories, associated, expected, complete, array_to_string(reasons, ',') as reasons, array_to_string(sharers, ',') as shared_with, n_links, n_exports from cases", "segments")
def j11_qa_audit(spark, sf_dir):
    return _cases(spark, sf_dir).withColumns({x: F.array_join(x, ",") for x in ("conflicting_fields", "categories", "reasons", "shared_with")})


@query(f""", {_CASES}, r as (select source_id, 'association' as rate, count(*) filter (recorded and coalesce(expected, true) and associated) as numerator, count(*) filter (recorded and coalesce(expected, true)) as denominator from cases group by 1 union all select source_id, 'heuristic_completion', count(*) filter (associated and complete), count(*) filter (associated) from cases group by 1
  union all select source_id, 'unresolved', count(*) filter (recorded and coalesce(expected, true) and not coalesce(associated, false)), count(*) filter (recorded and coalesce(expected, true)) from cases group by 1 union all select source_id, 'candidate_reference_export_coverage', count(*) filter (n_links > 0 and n_exports > 0), count(*) filter (n_links > 0) from cases group by 1)
 select source_id, rate, numerator, denominator, round(numerator / nullif(denominator, 0)::double, 6) as value from r""", "segments")
def j11_qa_rates(spark, sf_dir):
    return op.qa_rates(_cases(spark, sf_dir))


TOPICS = ('[{"id":1,"evidence_segment_ids":["a"],"speakers":[]},{"id":2,"evidence_segment_ids":"a"}]', '[1,{"speakers":null,"of":URL}]', '{"a":1}', "null", '[{"evidence_segment_ids":[],"speakers":["s"],"deep":{"k":[1,{"x":null}]}}]')
MOMENTS = ('[{"evidence_segment_ids":["x"],"categories":5,"editorial":{"score":1}},{"editorial":[1]}]', "[]", '"text"', '[[1],{"categories":["c"],"editorial":null},true]')
ASKED = ('[{"answer_segment_ids":{},"n":NUMBER}]', '[{"question_segment_ids":["q"]},null]', '[{"evidence_segment_ids":null,"text":URL}]')
SECTIONS = ('[{"topic_ids":"t"}]', "7", '[{"topic_ids":[1],"evidence_segment_ids":false}]', "[]", "null", '[{"title":"x"}]', '[{"topic_ids":[]},{"topic_ids":[2]},3]')
REVIEWS = ('[{"m":1},"x"]', '{"top_moments":[{"m":2},3],"content_angles":{}}', '{"top_moments":"x"}', "7", "null", '{"top_moments":[{"m":URL}],"content_angles":[]}', "{}", "[]")
_PARTS = (("topics", TOPICS), ("moments", MOMENTS), ("questions_answers", ASKED), ("program_sections", SECTIONS), ("editorial_review", REVIEWS))


def _contracts(spark, sf_dir):
    """Free JSON of each page; some of it cut off, some no object."""
    p = d.table(spark, sf_dir, "pages")
    i = F.col("page_id")
    part = lambda options: F.array(*map(F.lit, options))[(i % len(options)).cast("int")]
    text = F.concat(F.lit("{"), *(x for k, (name, options) in enumerate(_PARTS) for x in (F.lit(f'{"," if k else ""}"{name}":'), part(options))), F.lit("}"))
    text = F.replace(F.replace(text, F.lit("URL"), F.concat(F.lit('"'), F.col("url"), F.lit('"'))), F.lit("NUMBER"), i.cast("string"))
    return p.select("page_id", F.when(i % 11 == 10, F.substring(text, F.lit(1), F.length(text) - 1)).when(i % 13 == 12, "[1]").when(i % 17 == 16, F.lit(None)).otherwise(text).alias("text"))


_LIT = lambda xs: "[" + ", ".join("'" + x + "'" for x in xs) + "]"
_JKIND = lambda x: f"case json_type({x}) when 'OBJECT' then 'object' when 'ARRAY' then 'list' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'NULL' then 'null' else case when {x} is null then 'null' else 'number' end end"
_FIELDS = "f(of, field, type, need) as (values " + ", ".join(f"('{n}', '{f}', '{t}', {str(need).lower()})" for n, (always, ifany, objects) in op.CONTRACT.items() for f, t, need in [*((a, "list", True) for a in always), *((a, "list", False) for a in ifany), *((o, "object", True) for o in objects)]) + ")"
_JSON = f"""with made as (select page_id, url, '{{' || {" || ".join(f"'{',' if k else ''}" + f'"{name}":' + f"' || ({_LIT(options)})[(page_id % {len(options)} + 1)::int]" for k, (name, options) in enumerate(_PARTS))} || '}}' as t from pages),
 texts as (select page_id as key, case when page_id % 11 = 10 then left(t, length(t) - 1) when page_id % 13 = 12 then '[1]' when page_id % 17 = 16 then null else t end as t from (select page_id, replace(replace(t, 'URL', '"' || url || '"'), 'NUMBER', page_id::varchar) as t from made)),
 root as (select key, case when json_valid(t) then t::json end as v from texts), good as (select key, v from root where json_type(v) = 'OBJECT'), {_FIELDS},
 coll as (select key, n as collection, case when json_type(json_extract(v, '$.' || n)) = 'NULL' then null else json_extract(v, '$.' || n) end as c from good, (select distinct of as n from f)),
 items as (select key, collection, unnest(json_extract(c, '$[*]')) as x, unnest(range(json_array_length(c)::bigint)) as k from coll where json_type(c) = 'ARRAY'),
 cnt as (select key, collection, count(*) as n, count(*) filter (json_type(x) = 'OBJECT') as good from items group by 1, 2),
 obj as (select key, collection, x, row_number() over (partition by key, collection order by k) - 1 as place from items where json_type(x) = 'OBJECT'),
 fl as (select o.key, collection, place, field, type, need, list_contains(json_keys(x), field) as has, {_JKIND("json_extract(x, '$.' || field)")} as fk from obj o join f on f.of = o.collection),
 sw as (select key, collection, place, list({{'field': field, 'value': case type when 'list' then '[]' else '{{}}' end}}) as swaps from fl where fk <> type and (has or need) group by 1, 2, 3),
 rev as (select key, e, {_JKIND('e')} as kind, case when json_type(e) = 'ARRAY' then e when json_type(e) = 'OBJECT' then json_extract(e, '$.top_moments') end as top, case when json_type(e) = 'OBJECT' then json_extract(e, '$.content_angles') end as angles from (select key, json_extract(v, '$.editorial_review') as e from good)),
 rv as (select *, {_JKIND('top')} as tk, {_JKIND('angles')} as ak from rev), ri as (select key, unnest(json_extract(top, '$[*]')) as x, unnest(range(json_array_length(top)::bigint)) as k from rv where json_type(top) = 'ARRAY'),
 rc as (select key, count(*) as n, count(*) filter (json_type(x) = 'OBJECT') as kept from ri group by 1), rvn as (select rv.*, coalesce(n, 0) as n, coalesce(kept, 0) as kept from rv left join rc using (key))"""


@query(f"""{_JSON}, rows as (select key, collection, place, x, coalesce(swaps, []) as swaps from obj left join sw using (key, collection, place) union all select key, 'editorial_review', row_number() over (partition by key order by k) - 1, x, [] from ri where json_type(x) = 'OBJECT')
 select key, collection, place, '{{' || array_to_string(list_transform(list_sort(list_transform(list_filter(json_keys(x), lambda q: len(list_filter(swaps, lambda s: s.field = q)) = 0), lambda q: {{'field': q, 'value': json_extract(x, '$."' || q || '"')::varchar}}) || swaps), lambda z: '"' || z.field || '":' || z.value), ',') || '}}' as row from rows""")
def n11_sanitize_rows(spark, sf_dir):
    return op.sanitize_contract(_contracts(spark, sf_dir), "page_id", "text")[0]


@query(f"""{_JSON} select key, 'semantic' as path, 'object' as expected, case when v is null then 'invalid' else {_JKIND('v')} end as received, 'replaced_with_empty_contract' as action from root where v is null or json_type(v) <> 'OBJECT'
 union all select key, 'semantic.' || collection, 'list[object]', {_JKIND('c')}, 'kept_' || coalesce(good, 0) || '_valid_objects' from coll left join cnt using (key, collection) where {_JKIND('c')} not in ('list', 'null') or coalesce(good < n, false)
 union all select key, 'semantic.' || collection || '[' || place || '].' || field, case type when 'list' then 'list' else 'object|null' end, fk, case type when 'list' then 'replaced_with_empty_list' else 'replaced_with_empty_object' end from fl where has and fk <> type and not (type = 'object' and fk = 'null')
 union all select key, 'semantic.editorial_review', 'object|null', kind, 'normalized_legacy_list_' || kept || '_rows' from rvn where kind = 'list' union all select key, 'semantic.editorial_review.top_moments', 'list[object]', tk, 'kept_' || kept || '_valid_objects' from rvn where kind = 'object' and (tk not in ('list', 'null') or kept < n)
 union all select key, 'semantic.editorial_review.content_angles', 'list', ak, 'replaced_with_empty_list' from rvn where kind = 'object' and ak not in ('list', 'null') union all select key, 'semantic.editorial_review', 'object|null', kind, 'omitted' from rvn where kind not in ('list', 'object', 'null')""")
def n11_sanitize_diagnostics(spark, sf_dir):
    return op.sanitize_contract(_contracts(spark, sf_dir), "page_id", "text")[1]
