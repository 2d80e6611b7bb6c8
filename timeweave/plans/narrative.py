"""Narrative units, sequences and checks over conversations: pairs of turns are arcs, with the first turn of the pair after the next; whole conversations are discussions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import narrative as op
from ..sources import derived as d
from .commercial import _FOLD
from .registry import Register
from .story import _TALES, tales

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_RAW = """raw as (select source_id, turn // 2 as k, list(segment_id order by turn) as ids from tales group by 1, 2),
 two as (select r.*, source_id || '-P' || k as arc_id, ids as evidence from raw r union all select r.source_id, r.k, r.ids, r.source_id || '-Q' || r.k, r.ids || [n.ids[1]] from raw r join raw n on n.source_id = r.source_id and n.k = r.k + 2),
 arcs as (select source_id, arc_id, 'partial_story' as kind, evidence, ids[1:1] as setup, ids[2:2] as payoff, []::varchar[] as climax, []::varchar[] as development, k % 3 = 0 as supported from two
  union all select source_id, source_id || '-Z', 'discussion_segment', list(segment_id order by turn), [], [], [], list(segment_id order by turn) filter (turn % 8 = 7), false from tales group by source_id),
 segs as (select source_id, segment_id, start_us, end_us, speaker, turn % 6 = 5 as uncertain, case when turn % 3 = 1 then 'ou seja, ' else '' end || text || case when turn % 5 = 0 then '...' else '.' end as text from tales where end_us > start_us),
 cands as (select source_id, source_id || '-C' || (turn // 3) as candidate_id, list(segment_id order by turn) as segment_ids, (turn // 3) % 5 = 1 as excluded, (turn // 3) % 2 = 0 as verified from tales group by source_id, turn // 3)"""

_ROLE = lambda ids, low: f"case {' '.join(f'when len({c}) > 0 and list_has_all({c}, {ids}) then {r!r}' for c, r in op.COMPONENTS)} when regexp_matches({low}, '{op.EXPLANATION}') then 'explanation' else 'context' end"
_FOLDED = lambda x: _FOLD.replace("coalesce(text, '')", x)
_ID = lambda x: f"substr(sha256(to_json({x})::varchar), 1, 16)"

_UNITS = f"""{_TALES}, {_RAW}, pos as (select *, row_number() over (partition by source_id order by start_us, end_us, segment_id) as pos, {_FOLDED('text')} as low from segs),
 ev as (select source_id, arc_id, unnest(list_distinct(evidence)) as segment_id, len(list_distinct(evidence)) as n, setup, payoff, climax, development from arcs),
 m as (select ev.*, p.* exclude (source_id, segment_id), {_ROLE('[ev.segment_id]', 'p.low')} as role, count(*) over (partition by ev.source_id, arc_id) as found from ev join pos p on p.source_id = ev.source_id and p.segment_id = ev.segment_id),
 f as (select *, case when pos = lag(pos) over w + 1 and role = lag(role) over w then 0 else 1 end as fresh from m where found = n window w as (partition by source_id, arc_id order by pos)),
 g as (select *, sum(fresh) over (partition by source_id, arc_id order by pos) as run from f), k as (select *, row_number() over (partition by source_id, arc_id, run order by pos) as i from g),
 fold as (select source_id, arc_id, run, i, 0 as piece, start_us as since, end_us as until, regexp_matches(rtrim(text), '{op.ENDS}') as ends from k where i = 1
  union all select k.source_id, k.arc_id, k.run, k.i, case when k.start_us - until > 8000000 or (until - since >= 60000000 and ends) then piece + 1 else piece end, case when k.start_us - until > 8000000 or (until - since >= 60000000 and ends) then k.start_us else since end, k.end_us, regexp_matches(rtrim(k.text), '{op.ENDS}') from fold join k on k.source_id = fold.source_id and k.arc_id = fold.arc_id and k.run = fold.run and k.i = fold.i + 1),
 p as (select k.source_id, k.arc_id, k.run, piece, list(k.segment_id order by pos) as ids, min(k.start_us) as start_us, max(k.end_us) as end_us, string_agg(text, ' ' order by pos) as literal, list_sort(list_distinct(list(speaker))) as speakers, coalesce(list(k.segment_id order by pos) filter (uncertain), []) as uncertain, arg_max(text, pos) as tail from k join fold using (source_id, arc_id, run, i) group by 1, 2, 3, 4),
 r as (select p.*, a.kind, {_ROLE('ids', _FOLDED('literal'))} as role, 'UNIT_' || {_ID('ids')} as unit_id from p join arcs a using (source_id, arc_id)),
 u as (select source_id, unit_id, list_sort(list_distinct(list(arc_id))) as arc_ids, arg_min(role, arc_id) as role, arg_min(kind, arc_id) as kind, any_value(ids) as ids, any_value(start_us) as start_us, any_value(end_us) as end_us, any_value(literal) as literal, any_value(speakers) as speakers, any_value(uncertain) as uncertain, any_value(rtrim(tail)) as tail from r group by 1, 2),
 c as (select u.source_id, unit_id, list_sort(list(candidate_id)) as candidate_ids, bool_or(excluded) as ad, bool_or(not verified) as open from u join cands c on c.source_id = u.source_id and list_has_any(c.segment_ids, u.ids) group by 1, 2),
 units as (select u.source_id, u.unit_id, arc_ids, ids, start_us, end_us, literal, role, kind, coalesce(candidate_ids, []) as candidate_ids, speakers, uncertain, coalesce(ad, false) as ad,
  list_sort(list_filter(['human_audio_review_pending', 'rights_review_pending', 'preview_not_approved', case when len(uncertain) > 0 then 'source_transcript_uncertain' end, case when ad then 'recorded_commercial_exclusion' end, case when open then 'commercial_review_pending' end, case when not regexp_matches(tail, '{op.ENDS}') or tail like '%...' or tail like '%…' then 'ending_requires_context_review' end, case when end_us - start_us > 90000000 then 'long_source_unit_requires_curator_split' end], lambda x: x is not null)) as blockers from u left join c using (source_id, unit_id)),
 links as (select source_id, [segment_id] as answer_ids, [source_id || '-' || (turn - 5)] as context_ids from tales where turn % 4 = 3 and turn >= 5),
 edge as (select distinct source_id, unit_id, needs from (select source_id, unit_id, lag(unit_id) over (partition by source_id, arc order by start_us, end_us, unit_id) as needs from (select *, unnest(arc_ids) as arc from units)) where needs is not null
  union select a.source_id, a.unit_id, c.unit_id from links l join units a on a.source_id = l.source_id and list_has_any(a.ids, l.answer_ids) join units c on c.source_id = l.source_id and list_has_any(c.ids, l.context_ids) and (c.start_us, c.end_us, c.unit_id) < (a.start_us, a.end_us, a.unit_id))"""


def _tables(spark, sf_dir):
    """arcs, segments, candidates, links."""
    t = tales(spark, sf_dir)
    none = F.array().cast("array<string>")
    ids = lambda g: g.agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "segment_id"))), lambda x: x["segment_id"]).alias("ids"))
    raw = ids(t.groupBy("source_id", F.expr("turn div 2").alias("k")))
    after = raw.select("source_id", (F.col("k") - 2).alias("k"), F.col("ids")[0].alias("next"))
    two = raw.select("source_id", "k", "ids", F.concat("source_id", F.lit("-P"), "k").alias("arc_id"), F.col("ids").alias("evidence")).union(raw.join(after, ["source_id", "k"]).select("source_id", "k", "ids", F.concat("source_id", F.lit("-Q"), "k"), F.concat("ids", F.array("next"))))
    arcs = two.select("source_id", "arc_id", F.lit("partial_story").alias("kind"), "evidence", F.slice("ids", 1, 1).alias("setup"), F.slice("ids", 2, 1).alias("payoff"), none.alias("climax"), none.alias("development"), (F.col("k") % 3 == 0).alias("supported"))
    eighth = ids(t.where("turn % 8 = 7").groupBy("source_id")).withColumnRenamed("ids", "development")
    whole = ids(t.groupBy("source_id")).join(eighth, "source_id", "left").select("source_id", F.concat("source_id", F.lit("-Z")).alias("arc_id"), F.lit("discussion_segment").alias("kind"), F.col("ids").alias("evidence"), none.alias("setup"), none.alias("payoff"), none.alias("climax"), "development", F.lit(False).alias("supported"))
    text = F.concat(F.when(F.col("turn") % 3 == 1, "ou seja, ").otherwise(""), F.col("text"), F.when(F.col("turn") % 5 == 0, "...").otherwise("."))
    segments = t.select("source_id", "segment_id", "start_us", "end_us", "speaker", (F.col("turn") % 6 == 5).alias("uncertain"), text.alias("text"))
    cands = ids(t.groupBy("source_id", F.expr("turn div 3").alias("c"))).select("source_id", F.concat("source_id", F.lit("-C"), "c").alias("candidate_id"), F.col("ids").alias("segment_ids"), (F.col("c") % 5 == 1).alias("excluded"), (F.col("c") % 2 == 0).alias("verified"))
    links = t.where("turn % 4 = 3 and turn >= 5").select("source_id", F.array("segment_id").alias("answer_ids"), F.array(F.concat_ws("-", "source_id", F.col("turn") - 5)).alias("context_ids"))
    return arcs.union(whole), segments, cands, links


_LISTS = ("arc_ids", "segment_ids", "candidate_ids", "speakers", "uncertain", "blockers")


def _flat(df, *names):
    return df.withColumns({x: F.array_join(x, ",") for x in names})


@query(f""", {_UNITS} select source_id, unit_id, array_to_string(arc_ids, ',') as arc_ids, array_to_string(ids, ',') as segment_ids, start_us, end_us, md5(literal) as literal, role,
  case when role in ('explanation', 'context') then case role when 'explanation' then 'literal_explanation_cue_requires_review' else 'source_context_only_not_narrative_completion' end else 'recorded_component_requires_review' end as role_status,
  case when role = 'explanation' then 'explanation_candidate' when kind = 'discussion_segment' then 'discussion_context' else 'narrative_fragment' end as unit_type, array_to_string(candidate_ids, ',') as candidate_ids, array_to_string(speakers, ',') as speakers, array_to_string(uncertain, ',') as uncertain, array_to_string(blockers, ',') as blockers, case when ad then '{op.BLOCKED}' else '{op.READY}' end as eligibility from units""", "segments")
def c23_narrative_units(spark, sf_dir):
    arcs, segments, cands, _ = _tables(spark, sf_dir)
    return _flat(op.narrative_units(arcs, segments, cands), *_LISTS).withColumn("literal", F.md5("literal"))


_SEQUENCES = f"""{_UNITS}, per as (select source_id, unnest(arc_ids) as root, unit_id, ad from units), ready as (select source_id, root from per group by 1, 2 having bool_or(not ad)),
 reach as (select source_id, root, unit_id from per join ready using (source_id, root) union select r.source_id, r.root, e.needs from reach r join edge e on e.source_id = r.source_id and e.unit_id = r.unit_id),
 seqs as (select r.source_id, r.root as arc_id, list(r.unit_id order by start_us, end_us, r.unit_id) as unit_ids, list_sort(list_distinct(flatten(list(blockers)))) as blockers from reach r join units u using (source_id, unit_id) group by 1, 2),
 req as (select r.source_id, r.root as arc_id, list_sort(list_distinct(list(needs))) as required from reach r join edge e using (source_id, unit_id) group by 1, 2),
 seq as (select s.source_id, 'SEQUENCE_' || {_ID('s.unit_ids')} as sequence_id, min(s.arc_id) as arc_id, any_value(unit_ids) as unit_ids, any_value(blockers) as blockers, any_value(coalesce(required, [])) as required from seqs s left join req using (source_id, arc_id) group by 1, 2)"""


def _built(spark, sf_dir):
    arcs, segments, cands, links = _tables(spark, sf_dir)
    units = op.cut(op.narrative_units(arcs, segments, cands))
    edges = op.cut(op.context_edges(units, links))
    return arcs, segments, cands, units, edges


@query(f""", {_SEQUENCES} select q.source_id, sequence_id, q.arc_id, array_to_string(unit_ids, ',') as unit_ids, array_to_string(required, ',') as required, array_to_string(blockers, ',') as blockers, supported as complete, case when supported then 'complete_supported' when kind = 'discussion_segment' then 'discussion_without_narrative' else 'partial_supported' end as completeness from seq q join arcs a using (source_id, arc_id)""", "segments")
def c23_narrative_sequences(spark, sf_dir):
    arcs, _, _, units, edges = _built(spark, sf_dir)
    return _flat(op.narrative_sequences(units, edges, arcs), "unit_ids", "required", "blockers")


@query(f""", {_SEQUENCES},
 nd as (select source_id, unit_id, list_sort(list(needs)) as needs from edge group by 1, 2),
 ou as (select u.source_id, u.unit_id, u.ids, u.start_us, u.end_us, u.literal, candidate_ids, coalesce(needs, []) as needs, ('0x' || substr(unit_id, 6, 2))::int as h from units u left join nd using (source_id, unit_id)),
 x as (select source_id, unit_id, h, case h % 16 when 1 then ids || [ids[1]] when 2 then ids || ['lost'] when 3 then [] else ids end as ids, case when h % 16 = 4 then end_us else start_us end as start_us, case when h % 16 = 5 then end_us + 1 else end_us end as end_us, case when h % 16 = 6 then literal || '!' else literal end as literal, case when h % 16 = 7 then candidate_ids || ['lost'] else candidate_ids end as candidate_ids, case h % 16 when 8 then needs || ['lost'] when 9 then needs || [unit_id] when 10 then needs || (select coalesce(list(e.unit_id), []) from edge e where e.source_id = ou.source_id and e.needs = ou.unit_id) else needs end as needs, h % 16 = 11 as approved from ou),
 xe as (select source_id, unit_id, unnest(needs) as ref from x), lk as (select e.source_id, e.unit_id, e.ref from xe e join x on x.source_id = e.source_id and x.unit_id = e.ref and e.ref <> e.unit_id),
 walk as (select source_id, unit_id as root, ref as node from lk union select w.source_id, w.root, l.ref from walk w join lk l on l.source_id = w.source_id and l.unit_id = w.node),
 xs as (select x.*, unnest(range(1, len(x.ids) + 1)) as k from x), xp as (select xs.*, p.pos, p.start_us as s0, p.end_us as s1, p.text from xs left join pos p on p.source_id = xs.source_id and p.segment_id = xs.ids[k]),
 ok as (select source_id, unit_id, any_value(literal) as literal, any_value(start_us) as start_us, any_value(end_us) as end_us, string_agg(text, ' ' order by k) as text, arg_min(s0, k) as s0, arg_max(s1, k) as s1, list(pos order by k) as places from xp group by 1, 2 having count(pos) = count(*) and count(distinct ids[k]) = count(*)),
 sq as (select q.source_id, sequence_id, ('0x' || substr(sequence_id, 10, 2))::int as h, unit_ids, required, supported, setup, payoff, evidence from seq q join arcs a using (source_id, arc_id)),
 y as (select source_id, sequence_id, case h % 8 when 1 then unit_ids || ['lost'] when 2 then [] else unit_ids end as unit_ids, case when h % 8 = 3 then required || ['more'] else required end as required, supported or h % 8 = 4 as complete, setup, payoff, case when h % 8 = 5 then payoff else evidence[3:3] end as development, h % 8 = 6 as approved from sq),
 yu as (select y.source_id, sequence_id, list_distinct(flatten(list(x.needs))) as needs, list_distinct(flatten(list(x.ids))) as held, any_value(unit_ids) as unit_ids, any_value(required) as required from y join x on x.source_id = y.source_id and list_contains(y.unit_ids, x.unit_id) group by 1, 2 having count(*) = any_value(len(unit_ids))),
 spn as (select y.source_id, sequence_id, part, min(p.start_us) as lo, max(p.end_us) as hi from (select source_id, sequence_id, 0 as part, unnest(setup) as sid from y union all select source_id, sequence_id, 1, unnest(development) from y union all select source_id, sequence_id, 2, unnest(payoff) from y) y join pos p on p.source_id = y.source_id and p.segment_id = sid group by 1, 2, 3),
 errs as (select source_id, 'unit' as what, unit_id as id, unnest(list_filter([case when start_us < 0 or end_us <= start_us then 'invalid_unit_timestamp' end, case when approved then 'unit_approval_unverified' end], lambda v: v is not null)) as rule from x
  union select source_id, 'unit', unit_id, 'invalid_segment_reference' from x where not exists (select 1 from ok where ok.source_id = x.source_id and ok.unit_id = x.unit_id)
  union select source_id, 'unit', min(unit_id), 'duplicate_unit_source' from x group by source_id, ids having count(*) > 1
  union select source_id, 'unit', unit_id, 'unit_literal_source_disagreement' from ok where literal <> text union select source_id, 'unit', unit_id, 'unit_boundary_disagreement' from ok where start_us <> s0 or end_us <> s1
  union select source_id, 'unit', unit_id, 'unit_implicit_distant_montage' from ok where places <> list_sort(places) or places[-1] - places[1] + 1 <> len(places)
  union select source_id, 'unit', unit_id, 'unit_candidate_reference' from x where list_contains(candidate_ids, 'lost') union select source_id, 'unit', unit_id, 'unit_context_reference' from xe where ref = 'lost' or ref = unit_id
  union select source_id, 'unit', root, 'cyclic_unit_context' from walk w where root = node and exists (select 1 from lk l join x a on a.source_id = l.source_id and a.unit_id = l.unit_id join x b on b.source_id = l.source_id and b.unit_id = l.ref where l.source_id = w.source_id and l.unit_id = w.root and (b.start_us, b.end_us, b.unit_id) >= (a.start_us, a.end_us, a.unit_id) and (l.ref = root or exists (select 1 from walk v where v.source_id = w.source_id and v.root = l.ref and v.node = w.root)))
  union select source_id, 'sequence', sequence_id, 'sequence_approval_unverified' from y where approved
  union select source_id, 'sequence', sequence_id, 'sequence_unit_reference' from y where not exists (select 1 from yu where yu.source_id = y.source_id and yu.sequence_id = y.sequence_id)
  union select source_id, 'sequence', sequence_id, 'sequence_missing_required_context' from yu where not list_has_all(unit_ids, needs) or not list_has_all(required, needs) or not list_has_all(needs, required)
  union select y.source_id, 'sequence', sequence_id, 'sequence_completion_unsupported' from y join yu using (source_id, sequence_id) where complete and not (len(setup) > 0 and len(development) > 0 and len(payoff) > 0 and list_has_all(held, setup || development || payoff)
   and coalesce((select a.hi <= b.lo and b.hi <= c.lo from spn a, spn b, spn c where a.part = 0 and b.part = 1 and c.part = 2 and (a.source_id, a.sequence_id) = (y.source_id, y.sequence_id) and (b.source_id, b.sequence_id) = (y.source_id, y.sequence_id) and (c.source_id, c.sequence_id) = (y.source_id, y.sequence_id)), false))
  union select source_id, 'sequence', min(sequence_id), 'duplicate_sequence_source' from y group by source_id, unit_ids having count(*) > 1)
 select * from errs""", "segments")
def c22_narrative_validate(spark, sf_dir):
    """The package of c23, some units and sequences damaged by a rule of their ids."""
    arcs, segments, cands, units, edges = _built(spark, sf_dir)
    h = lambda c, at: F.conv(F.substring(c, at, 2), 16, 10).cast("int")
    mine = edges.groupBy("source_id", "unit_id").agg(F.array_sort(F.collect_set("needs")).alias("needs"))
    after = edges.groupBy("source_id", F.col("needs").alias("unit_id")).agg(F.collect_set("unit_id").alias("after"))
    none, more = F.array().cast("array<string>"), lambda c, *x: F.concat(F.coalesce(c, none), *x)
    k = h(F.col("unit_id"), 6) % 16
    lost = F.array(F.lit("lost"))
    u = units.join(mine, ["source_id", "unit_id"], "left").join(after, ["source_id", "unit_id"], "left").withColumn("needs", F.coalesce("needs", none)).withColumn("k", k)
    ids = F.when(F.col("k") == 1, F.concat("segment_ids", F.slice("segment_ids", 1, 1))).when(F.col("k") == 2, F.concat("segment_ids", lost)).when(F.col("k") == 3, none).otherwise(F.col("segment_ids"))
    needs = F.when(F.col("k") == 8, F.concat("needs", lost)).when(F.col("k") == 9, F.concat("needs", F.array("unit_id"))).when(F.col("k") == 10, more(F.col("needs"), F.coalesce("after", none))).otherwise(F.col("needs"))
    u = u.select("source_id", "unit_id", ids.alias("segment_ids"), F.when(F.col("k") == 4, F.col("end_us")).otherwise(F.col("start_us")).alias("start_us"), F.when(F.col("k") == 5, F.col("end_us") + 1).otherwise(F.col("end_us")).alias("end_us"), F.when(F.col("k") == 6, F.concat("literal", F.lit("!"))).otherwise(F.col("literal")).alias("literal"), F.when(F.col("k") == 7, F.concat("candidate_ids", lost)).otherwise(F.col("candidate_ids")).alias("candidate_ids"), needs.alias("needs"), (F.col("k") == 11).alias("approved"))
    q = op.narrative_sequences(units, edges, arcs).join(arcs.select("source_id", "arc_id", "setup", "payoff", "evidence"), ["source_id", "arc_id"]).withColumn("k", h(F.col("sequence_id"), 10) % 8)
    q = q.select("source_id", "sequence_id", F.when(F.col("k") == 1, F.concat("unit_ids", lost)).when(F.col("k") == 2, none).otherwise(F.col("unit_ids")).alias("unit_ids"), F.when(F.col("k") == 3, F.concat("required", F.array(F.lit("more")))).otherwise(F.col("required")).alias("required"), (F.col("complete") | (F.col("k") == 4)).alias("complete"), "setup", "payoff", F.when(F.col("k") == 5, F.col("payoff")).otherwise(F.slice("evidence", 3, 1)).alias("development"), (F.col("k") == 6).alias("approved"))
    return op.validate_package(u, q, segments, cands)


for _name in ORACLES:
    ORACLES[_name] = ORACLES[_name].replace("with ", "with recursive ", 1)
