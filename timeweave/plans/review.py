"""Review rules over conversations, events, orders and camera windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import review as op
from ..sources import derived as d
from .registry import Register
from .timeline import _camera, _CAMERA, _CAMERA_OF

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

_FOLDED = lambda x: f"translate(lower(coalesce({x}, '')), '{t.ACCENTED}', '{t.PLAIN}')"
_LIST = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_PICK = lambda xs, i: f"[{', '.join('null' if x is None else repr(x) for x in xs)}][(({i}) % {len(xs)} + 1)::int]"


def pick(values, i):
    return F.array(*map(F.lit, values))[(i % len(values)).cast("int")]


LEGACY = (None, "", "não", "útil", "obrigatório", "precisa ver o trecho anterior", "null", "sem contexto", "unresolved", "Helpful ")
EXPLICIT = (None, None, "helpful", "bogus", "none")
_LEGACY = f"l as (select doc_id, {_PICK(EXPLICIT, 'n_chars')} as explicit, {_PICK(LEGACY, 'doc_id')} as legacy, case n_chars % 11 when 3 then true when 4 then false end as flag from documents), v as (select *, trim({_FOLDED('legacy')}) as v from l)"


@query(f"""with {_LEGACY} select doc_id, case when explicit in {_LIST(op.REQUIREMENTS)} then explicit when flag = false or v in {_LIST(op.NO_CONTEXT)} then 'none' when flag or v in {_LIST(op.NEEDED)} then 'required' when v in {_LIST(op.USEFUL)} then 'helpful' when v <> '' and v not in ('null', 'none', 'unresolved') then 'required' else 'unresolved' end as requirement,
 case when legacy is not null and v not in ('', 'null', 'nao', 'nenhum', 'nenhuma', {', '.join(repr(x) for x in op.REQUIREMENTS)}) then legacy end as reason from v""")
def n6_normalize_context(spark, sf_dir):
    b = d.table(spark, sf_dir, "documents")
    flag = F.when(F.col("n_chars") % 11 == 3, True).when(F.col("n_chars") % 11 == 4, False)
    b = b.select("doc_id", pick(EXPLICIT, F.col("n_chars")).alias("explicit"), pick(LEGACY, F.col("doc_id")).alias("legacy"), flag.alias("flag"))
    return b.select("doc_id", op.context_requirement(F.col("explicit"), F.col("legacy"), F.col("flag")).alias("requirement"), op.context_reason(F.lit(None).cast("string"), F.col("legacy")).alias("reason"))


@query(f"""select segment_id, coalesce(given, ends) as complete_sentence, case when standalone in {_LIST(op.STANDALONE)} then standalone else 'needs_context' end as standalone_class, coalesce(review, true) as needs_review, case when speaker = 'user' then 'subjective_llm_judgment' else 'lexical_heuristic' end as confidence_method
 from (select *, case turn % 5 when 0 then true when 1 then false end as given, regexp_matches(rtrim(translate(text, '\n', ' ')), '[.?!]$') as ends, {_PICK(('good', 'superb', None, 'poor'), 'turn')} as standalone, case turn % 3 when 0 then false end as review from segments)""", "segments")
def n7_normalize_moment(spark, sf_dir):
    turn = F.col("turn")
    s = d.segments(spark, sf_dir).withColumn("complete_sentence", F.when(turn % 5 == 0, True).when(turn % 5 == 1, False)).withColumn("standalone_class", pick(("good", "superb", None, "poor"), turn)).withColumn("needs_review", F.when(turn % 3 == 0, False)).withColumn("method", F.when(F.col("speaker") == "user", "ollama"))
    return op.normalize_moments(s).select("segment_id", "complete_sentence", "standalone_class", "needs_review", "confidence_method")


STATUS = ("ok", "failed", "partial", "skipped", "unavailable", "measured", None, "degraded", "cancelled", "odd")
REASON = ("disabled", None, "ocr_disabled", "other")


@query(f"""select event_id as id, case when status in ('failed', 'blocked', 'cancelled') then 'failed' when status = 'unavailable' then 'unavailable_dependency' when lost > 0 and got = 0 then 'failed' when status = 'skipped' and reason in ('ocr_disabled', 'disabled') then 'not_measured_disabled' when status in ('ok', 'measured') and state is distinct from 'not_measured' then 'measured_ok' when status in ('partial', 'degraded') and state is distinct from 'not_measured' then 'measured_partial' else 'unavailable_dependency' end as state
 from (select event_id, {_PICK(STATUS, 'event_id')} as status, {_PICK(REASON, 'user_id')} as reason, user_id % 2 as lost, event_id % 3 as got, case when event_id % 7 = 0 then 'not_measured' end as state from events)""")
def n17_stage_capability(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(i.alias("id"), op.stage_capability(pick(STATUS, i), pick(REASON, u), i % 3, u % 2, F.when(i % 7 == 0, "not_measured")).alias("state"))


@query("select moment_id, case when coalesce(score >= 0.5 and n_lines > 0 and case format when 'F' then true when 'O' then false end, false) then 'READY_FOR_REVIEW' else 'PARTIAL' end as state from candidates", "candidates")
def n20_review_state(spark, sf_dir):
    visual = F.when(F.col("format") == "F", True).when(F.col("format") == "O", False)
    return d.candidates(spark, sf_dir).select("moment_id", op.review_state(F.col("score") >= 0.5, F.col("n_lines") > 0, visual).alias("state"))


PRIOR, WHY, LOCAL = (None, "eligible", "review", "excluded", "review"), (None, "near_commercial_block", "other"), ("eligible", "review", "eligible", "excluded")
EVIDENCE = (None, "measured_ok", "measured_partial", "failed", "measured_ok", None, None)


@query(f"""select moment_id, case when gone or prior = 'excluded' then 'excluded' when prior = 'review' and why in {_LIST(op.PENDING_REVIEWS)} then 'review' when speech = 'excluded' then 'excluded' when prior = 'review' then 'review' when local = 'excluded' then 'excluded' when ev <> 'measured_ok' then 'review' when unmeasured then 'review' else local end as eligibility,
 case when gone then 'excluded_interval_preserved' when prior = 'excluded' then 'upstream_exclusion_preserved' when prior = 'review' and why in {_LIST(op.PENDING_REVIEWS)} then 'upstream_commercial_review_preserved' when speech = 'excluded' then 'canonical_speech_exclusion' when prior = 'review' then 'upstream_commercial_review_preserved' when local = 'excluded' then 'local_exclusion_added' when ev <> 'measured_ok' then 'visual_evidence_state' else 'local_eligible' end as decided_by
 from (select moment_id, moment_id % 17 = 0 as gone, {_PICK(PRIOR, 'moment_id')} as prior, {_PICK(WHY, 'n_lines')} as why, {_PICK(LOCAL, 'moment_id // 5')} as local, case when n_lines = 3 then 'excluded' else 'eligible' end as speech, moment_id % 4 = 1 as unmeasured, {_PICK(EVIDENCE, 'moment_id // 3')} as ev from candidates)""", "candidates")
def n23_final_classification(spark, sf_dir):
    m = F.col("moment_id")
    c = d.candidates(spark, sf_dir).select("moment_id", (m % 17 == 0).alias("in_excluded_interval"), pick(PRIOR, m).alias("prior"), pick(WHY, F.col("n_lines")).alias("prior_reason"), pick(LOCAL, F.expr("moment_id div 5")).alias("local"), F.when(F.col("n_lines") == 3, "excluded").otherwise("eligible").alias("speech"), (m % 4 == 1).alias("unmeasured_visual"), pick(EVIDENCE, F.expr("moment_id div 3")).alias("evidence_state"))
    return op.final_classification(c).select("moment_id", "eligibility", "decided_by")


@query("""with m as (select user_id as source_id, count(*) filter (event_type = 'click') as observations, count(*) filter (event_type = 'signup') as speakers, avg((value < 2)::int) as micro_ratio, count(distinct event_type) as participants, count(*) filter (event_type = 'error') as unresolved, avg(value) / 10 as focus from events group by 1),
 i as (select source_id, list_filter([case when speakers = 0 then 'diarization_unavailable:high' end, case when observations = 0 then 'visual_tracking_unavailable:high' end, case when micro_ratio > 0.5 then 'fragmented_tracking:medium' end, case when participants > 50 then 'participant_explosion:medium' end, case when unresolved > 5 then 'qa_unresolved:medium' end, case when focus < 0.5 then 'unresolved_camera_focus:medium' end, case when unresolved > 0 then 'preview_skipped:info' end], lambda x: x is not null) as issues from m)
 select source_id, array_to_string(issues, ',') as issues, case when len(list_filter(issues, lambda x: ends_with(x, ':high'))) > 0 then 'P0_FAIL' when len(list_filter(issues, lambda x: ends_with(x, ':medium'))) > 0 then 'P1_DEGRADED' when len(issues) > 0 then 'PASS_WITH_WARNINGS' else 'PASS' end as status from i""")
def b20_quality_gate(spark, sf_dir):
    k = lambda x: F.count_if(F.col("event_type") == x)
    m = d.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(k("click").alias("observations"), k("signup").alias("speakers"), F.avg((F.col("value") < 2).cast("int")).alias("micro_ratio"), F.countDistinct("event_type").alias("participants"), k("error").alias("unresolved"), (F.avg("value") / 10).alias("focus"))
    c = F.col
    rules = [("diarization_unavailable", "high", c("speakers") == 0), ("visual_tracking_unavailable", "high", c("observations") == 0), ("fragmented_tracking", "medium", c("micro_ratio") > 0.5), ("participant_explosion", "medium", c("participants") > 50), ("qa_unresolved", "medium", c("unresolved") > 5), ("unresolved_camera_focus", "medium", c("focus") < 0.5), ("preview_skipped", "info", c("unresolved") > 0)]
    return op.quality_gate(m, rules).select("source_id", F.array_join("issues", ",").alias("issues"), "status")


ASKED = ("como vai você?", "quem nunca errou", "você gosta de café?", "o que aconteceu naquele dia?", "né?", "eu me pergunto por que", "ninguém sabe o segredo", "chorei muito", "bom", "", "isso é certo, não é?", "me conta essa história", "nunca jamais com certeza falei isso", "um dia comecei")


@query(f"""with {{segments}}, a as (select segment_id, trim({_FOLDED("phrase || case when turn % 2 = 0 then ' ' || text else '' end")}) as v from (select *, {_PICK(ASKED, 'turn * 3 + length(text)')} as phrase from segments)),
 n as (select *, len(list_filter(regexp_split_to_array(v, '\\s+'), lambda w: w <> '')) as n from a), k as (select *, case when not (contains(v, '?') or regexp_matches(v, '{op.ASKS}')) then 'statement' when regexp_matches(v, '{op.GREETING}') then 'greeting_question' when regexp_matches(v, '{op.SELF}') then 'self_question' when regexp_matches(v, '{op.RHETORICAL}') and n <= 12 then 'rhetorical_question' when regexp_matches(v, '{op.TAG}') and not regexp_matches(v, '{op.OPEN_WORD}') then 'tag_question' when n <= 2 and not regexp_matches(v, '{op.ASK_WORD}') then 'banter' when regexp_matches(v, '{op.YES_NO}') then 'yes_no_question' else 'direct_question' end as question_type from n),
 h as (select *, question_type in ('direct_question', 'yes_no_question') as answer_expected from k), z as (select *, case when question_type in ('greeting_question', 'banter', 'tag_question') then 1 when question_type in ('rhetorical_question', 'self_question') then 2 when regexp_matches(v, '{op.REVEAL}') then 3 when regexp_matches(v, '{op.EMOTION}') then 4 when regexp_matches(v, '{op.CLAIM}') and n >= 5 then 5 when answer_expected then 6 when regexp_matches(v, '{op.STORY}') then 7 when regexp_matches(v, '{op.FILLER}') then 8 else 9 end as r from h)
 select segment_id, question_type, answer_expected, ['generic_question', 'rhetorical_question', 'reveal', 'emotional_statement', 'strong_claim', 'genuine_question', 'story_opening', 'filler', 'unresolved'][r] as hook_type, [0.1, 0.25, 0.8, 0.75, 0.65, 0.6, 0.6, 0.0, null][r]::double as hook_strength from z""".replace("{segments}", f"segments as ({d.SQL['segments']})"))
def c7_classify_question(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    phrase = pick(ASKED, F.col("turn") * 3 + F.length("text"))
    s = s.select("segment_id", F.concat(phrase, F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "text")).otherwise(F.lit(""))).alias("text"))
    return op.classify_question(s).drop("text")


@query(f"""select doc_id, len(list_distinct(e)) >= 3 and len(e) > 2 * len(p) as mismatch from (select doc_id, list_filter(k, lambda x: x in {_LIST(op.ENGLISH_MARKERS)}) as e, list_filter(k, lambda x: x in {_LIST(op.PORTUGUESE_MARKERS)}) as p from (select doc_id, regexp_extract_all({_FOLDED('text')}, '\\b[a-z]+\\b') as k from documents))""")
def n8_language_mismatch(spark, sf_dir):
    from ..operators.evidence import language_mismatch

    return d.table(spark, sf_dir, "documents").select("doc_id", language_mismatch(F.col("text"), op.PORTUGUESE_MARKERS, op.ENGLISH_MARKERS).alias("mismatch"))


_CHOICE = f"""r as (select *, row_number() over (partition by source_id order by score desc, moment_id) as place, row_number() over (partition by source_id, topic order by score desc, moment_id) as in_topic from candidates),
 c as (select moment_id, place <= 12 and in_topic <= 2 and score >= 0.5 as selected, list_filter([case when in_topic > 2 then 'topic_diversity_limit' end, case when place > 12 then 'shortlist_capacity' end, case when score < 0.5 then 'below_minimum_score' end], lambda x: x is not null) as reasons, case when moment_id % 13 = 0 then ['missing_story_payoff'] else [] end as eb, {_PICK(('eligible', 'eligible', 'review', 'excluded', 'eligible', 'eligible', 'eligible'), 'moment_id')} as eligibility, {_PICK(('editorial_content', 'advertisement', 'editorial_content', 'uncertain', 'editorial_content', 'editorial_content', 'editorial_content', 'editorial_content'), 'moment_id // 7')} as content_type, case moment_id % 5 when 1 then false when 2 then true end as opening, case when moment_id % 11 = 4 then false end as ending, case when n_lines = 0 then ['evidence'] else [] end as missing, score from r)"""


@query(f""", {_CHOICE}, a as (select *, list_concat(eb, list_filter([case when content_type in ('advertisement', 'sponsor_read', 'merchandising', 'commercial_promotion', 'event_promotion', 'self_promotion') or eligibility in ('excluded', 'review') then 'commercial_selection_gate' end, case when opening = false then 'clean_opening:false' end, case when ending = false then 'clean_ending:false' end], lambda x: x is not null)) as absolute from c)
 select moment_id, array_to_string(list_sort(list_distinct(list_concat(reasons, absolute, list_transform(missing, lambda x: 'missing_required_score:' || x)))), ',') as blockers, case when selected then 'chosen' when len(reasons) > 0 and list_has_all({list(op.CAPACITY)}, reasons) then 'alternative' when eligibility = 'review' then 'pending' when len(absolute) > 0 then 'excluded' when len(missing) > 0 or score is null then 'pending' else 'excluded' end as disposition from a""", "candidates")
def t4_explain_shortlist(spark, sf_dir):
    from pyspark.sql import Window

    m, none = F.col("moment_id"), F.array().cast("array<string>")
    order = (F.col("score").desc(), F.col("moment_id"))
    c = d.candidates(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("source_id").orderBy(*order))).withColumn("in_topic", F.row_number().over(Window.partitionBy("source_id", "topic").orderBy(*order)))
    reasons = F.array_compact(F.array(F.when(F.col("in_topic") > 2, "topic_diversity_limit"), F.when(F.col("place") > 12, "shortlist_capacity"), F.when(F.col("score") < 0.5, "below_minimum_score")))
    c = c.select("moment_id", "score", ((F.col("place") <= 12) & (F.col("in_topic") <= 2) & (F.col("score") >= 0.5)).alias("selected"), reasons.alias("reasons"), F.when(m % 13 == 0, F.array(F.lit("missing_story_payoff"))).otherwise(none).alias("editorial_blockers"), pick(("eligible", "eligible", "review", "excluded", "eligible", "eligible", "eligible"), m).alias("eligibility"), pick(("editorial_content", "advertisement", "editorial_content", "uncertain", "editorial_content", "editorial_content", "editorial_content", "editorial_content"), F.expr("moment_id div 7")).alias("content_type"), F.when(m % 5 == 1, False).when(m % 5 == 2, True).alias("clean_opening"), F.when(m % 11 == 4, False).alias("clean_ending"), F.when(F.col("n_lines") == 0, F.array(F.lit("evidence"))).otherwise(none).alias("missing"))
    return op.selection_disposition(c).select("moment_id", F.array_join("blockers", ",").alias("blockers"), "disposition")


@query("""with k as (select distinct user_id as source_id, epoch_us(ts) as time_us, round(1 + value / 20, 4) as zoom from events where event_type in ('view', 'click')), d as (select user_id as source_id, max(epoch_us(ts)) - min(epoch_us(ts)) as duration_us from events group by 1),
 s as (select *, time_us - lag(time_us) over w as dt, zoom - lag(zoom) over w as dz from k window w as (partition by source_id order by time_us, zoom)), st as (select *, dz / (dt / 1e6::double) as slope, case when abs(dz) >= 0.015 then sign(dz) end as way from s where dt > 0),
 j as (select *, abs(slope - lag(slope) over (partition by source_id order by time_us, zoom)) as jerk from st), mv as (select *, (lag(way) over w <> way and time_us - lag(time_us) over w < 43201000000)::int as back from j where way is not null window w as (partition by source_id order by time_us, zoom)),
 a as (select source_id, count(*) as moves, coalesce(sum(back), 0)::bigint as reversals from mv group by 1), b as (select source_id, round(coalesce(sum(jerk), 0) / greatest(count(slope) - 1, 1), 6) as jitter from j group by 1), c as (select source_id, max(zoom) as largest from k group by 1)
 select d.source_id, coalesce(largest, 1) as largest, coalesce(moves, 0) as moves, coalesce(reversals, 0) as reversals, round(coalesce(reversals, 0) / greatest(coalesce(moves, 0), 1)::double, 6) as pumping, coalesce(jitter, 0) as jitter, round(coalesce(moves, 0) * 60000000 / nullif(duration_us, 0)::double, 6) as moves_per_minute from d left join c using (source_id) left join a using (source_id) left join b using (source_id)""")
def b23_zoom_diagnostics(spark, sf_dir):
    e = d.table(spark, sf_dir, "events")
    k = e.where("event_type in ('view', 'click')").select(F.col("user_id").alias("source_id"), d.micros("ts").alias("time_us"), F.round(1 + F.col("value") / 20, 4).alias("zoom"))
    span = e.groupBy(F.col("user_id").alias("source_id")).agg((F.max(d.micros("ts")) - F.min(d.micros("ts"))).alias("duration_us"))
    return op.zoom_diagnostics(k, span, 43_200_000_000)


@query(f", {_CAMERA} select source_id, start_us, person_id, case when active_person is not null and not overlap and person_id = active_person then 'SPEAKING' when person_id = 'p2' and person_id is distinct from active_person then 'REACTING' when active_person is not null and not overlap then 'LISTENING' else 'VISIBLE_UNDETERMINED' end as role from (select *, unnest(visible) as person_id from camera)", *_CAMERA_OF)
def b29_person_roles(spark, sf_dir):
    return op.person_roles(_camera(spark, sf_dir).withColumn("reactions", F.array(F.lit("p2"))))


_BOX = "b as (select event_id as id, round(value % 1 * 0.7, 3)::double as x, round(value * 7 % 1 * 0.7, 3)::double as y, round(value % 3 / 6 + 0.05, 3)::double as w, round(value * 3 % 3 / 6 + 0.05, 3)::double as h from events)"


def _boxes(spark, sf_dir):
    v = F.col("value")
    return d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.round(v % 1 * 0.7, 3).alias("x"), F.round(v * 7 % 1 * 0.7, 3).alias("y"), F.round(v % 3 / 6 + 0.05, 3).alias("w"), F.round(v * 3 % 3 / 6 + 0.05, 3).alias("h"))


@query(f"""with {_BOX}, e as (select *, greatest(x, 0.25) as x0, greatest(y, 0.25) as y0, least(x + w, 0.75) as x1, least(y + h, 0.75) as y1, least(1.0::double, 9.0::double / 16 * 1080 / 1920) as cw from b), c as (select *, greatest(0, least(1 - cw, x + w / 2 - cw / 2)) as l from e)
 select id, x < 0.762 and 0.25 < x + w + 0.012 and y < 0.762 and 0.25 < y + h + 0.012 as near, round(greatest(0, x1 - x0) * greatest(0, y1 - y0), 6) as shared, case when x1 > x0 and y1 > y0 then round((x0 - 0.25) / 0.5, 6) end as px, case when x1 > x0 and y1 > y0 then round((y1 - y0) / 0.5, 6) end as ph, round(l, 6) as crop_x, x >= l and x + w <= l + cw as fits from c""")
def f5_boxes(spark, sf_dir):
    b = _boxes(spark, sf_dir)
    box, crop = tuple(F.col(k) for k in "xywh"), tuple(F.lit(v) for v in (0.25, 0.25, 0.5, 0.5))
    p, v = op.project_box(box, crop), op.vertical_crop(F.col("x"), F.col("w"), F.lit(1920.0), F.lit(1080.0))
    return b.select("id", op.rects_intersect(box, crop).alias("near"), F.round(op.rect_overlap(box, crop), 6).alias("shared"), F.round(p["x"], 6).alias("px"), F.round(p["height"], 6).alias("ph"), F.round(v["x"], 6).alias("crop_x"), v["fits"].alias("fits"))


@query(f"""with recursive {{segments}}, k as (select segment_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as t from segments), j as (select segment_id, t, array_to_string(t, ' ') as whole, len(t) as n from k),
 o as (select *, list_min(list_transform(list_filter(range(1, n), lambda i: length(array_to_string(t[1:i], ' ')) <= 38 and length(array_to_string(t[i + 1:n], ' ')) <= 38), lambda i: {{{{'plain': not regexp_matches(t[i], '[.,;:!?]$'), 'apart': abs(length(array_to_string(t[1:i], ' ')) - length(array_to_string(t[i + 1:n], ' '))), 'i': i}}}})).i as best from j),
 f as (select segment_id, t, n, 0 as i, '' as done, '' as line from o where length(whole) > 38 and best is null union all
  select segment_id, t, n, i + 1, case when line <> '' and length(line || ' ' || t[i + 1]) > 38 then done || line || chr(10) else done end, case when line = '' then t[i + 1] when length(line || ' ' || t[i + 1]) > 38 then t[i + 1] else line || ' ' || t[i + 1] end from f where i < n)
 select o.segment_id, case when length(whole) <= 38 then whole when best is not null then array_to_string(o.t[1:best], ' ') || chr(10) || array_to_string(o.t[best + 1:o.n], ' ') else f.done || f.line end as wrapped from o left join f on f.segment_id = o.segment_id and f.i = f.n""".replace("{segments}", f"segments as ({d.SQL['segments']})").replace("{{", "{").replace("}}", "}"))
def f7_wrap_text(spark, sf_dir):
    return d.segments(spark, sf_dir).select("segment_id", op.wrap_text(F.col("text")).alias("wrapped"))
