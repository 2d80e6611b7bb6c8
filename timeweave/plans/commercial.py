"""Commercial evidence over conversations whose turns end in a phrase, chosen by the turn and its length."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import commercial as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

PHRASES = (
    "", "compre agora na loja com desconto de 20 reais", "parcelas em 10 vezes sem juros no pix", "aproveite as últimas ofertas, vendas abertas", "o sofá custa 300 reais", "não compre esse produto", "oferecido por nosso patrocinador",
    "na reportagem a propaganda dizia compre agora por apenas 50 reais", "compre o ingresso para o meu show", "use o colágeno que alivia a dor", "se inscreve no canal e compartilhe", "um salto de 10 mil pés", "visite www.exemplo.com.br",
    "não sou afiliado dessa loja", "recebemos comissão, link de afiliado abaixo", "um dia aconteceu comigo, comente e deixe o like", "ele disse: compartilhe", "loja com parcelas de 10 reais",
)
_N = len(PHRASES)
_PITCHES = f"pitches as (select source_id, segment_id as id, turn, start_us, start_us + 9400000 as end_us, speaker, text || ' ' || [{', '.join(repr(p) for p in PHRASES)}][((turn * 5 + length(text)) % {_N} + 1)::int] as text from segments)"
_FOLD = f"translate(lower(coalesce(text, '')), '{t.ACCENTED}', '{t.PLAIN}')"


def pitches(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    phrase = F.array(*map(F.lit, PHRASES))[((F.col("turn") * 5 + F.length("text")) % _N).cast("int")]
    return s.select("source_id", F.col("segment_id").alias("id"), "turn", "start_us", (F.col("start_us") + 9_400_000).alias("end_us"), "speaker", F.concat("text", F.lit(" "), phrase).alias("text"))


_CUES = "cues(signal, pattern, negatable) as (values " + ", ".join(f"('{s}', '{p}', {str(s in op.NEGATABLE).lower()})" for s, p in op.CUES) + ")"


def _hits(src: str, p: str) -> str:
    """p + hits: id, signal, start, n of the texts of src (id, text)."""
    but = " and ".join(f"not (signal = '{s}' and regexp_matches(hit, '{own}') and regexp_matches(substr(low, start + length(hit) + 1, 60), '{after}'))" for s, own, after in op.EXCEPTIONS)
    return f"""{p}low as (select id, text, {_FOLD} as low from {src}),
 {p}m as (select id, low, signal, negatable, regexp_extract_all(low, pattern) as m, regexp_split_to_array(low, pattern) as parts from {p}low, cues where regexp_matches(low, pattern)),
 {p}each as (select *, unnest(range(1, len(m) + 1)) as i from {p}m),
 {p}place as (select id, low, signal, negatable, i, m[i] as hit, (coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as start from {p}each),
 {p}kept as (select *, row_number() over (partition by id, signal order by i) as k from {p}place where {but}),
 {p}hits as (select id, signal, start, length(hit)::int as n from {p}kept where k <= 3 and not (negatable and regexp_matches(substr(low, greatest(start - 24, 0) + 1, least(start, 24)), '{op.NEGATION}')))"""


def _class(src: str, p: str) -> str:
    """p + class: id, text, low, signals and the columns of classify_content."""
    has = lambda *xs: "(" + " and ".join(f"list_contains(signals, '{x}')" for x in xs) + ")"
    some = lambda *xs: "(" + " or ".join(f"list_contains(signals, '{x}')" for x in xs) + ")"
    health = has("recommendation", "product", "health_claim")
    strong = f"({has('installment', 'urgency')} or {has('price', 'installment', 'store')} or {health} or {has('store', 'discount', 'payment')} or {has('sales_cta')} and {some('price', 'discount', 'domain', 'store', 'contact', 'event')} or {has('guest_invitation')})"
    weak = f"({has('sales_cta')} or {has('recommendation')} and {some('price', 'domain', 'health_claim')})"
    cases = [(has("sponsor"), "sponsor_read", "0.85"), (f"{strong} and {has('event')}", "event_promotion", "least(0.96, 0.7 + 0.04 * n)"), (f"{strong} and regexp_matches(low, '{op.OWN_WORK}')", "self_promotion", "0.8"), (health, "commercial_promotion", "0.85"), (strong, "advertisement", "least(0.96, 0.65 + 0.05 * n)"), (f"regexp_matches(low, '{op.HOUSEKEEPING}')", "housekeeping", "0"), (f"regexp_matches(low, '{op.INTRO}')", "intro_outro", "0"), (weak, "uncertain", "0.35"), (some("product", "price", "sponsorship_mention"), "editorial_product_discussion", "0"), ("trim(low) = ''", "uncertain", "null")]
    kinds = " ".join(f"when {c} then '{k}'" for c, k, _ in cases)
    scores = " ".join(f"when {c} then {s}" for c, _, s in cases)
    commercial = "content_type in (" + ", ".join(f"'{x}'" for x in op.COMMERCIAL_TYPES) + ")"
    return f"""{_hits(src, p)}, {p}sig as (select id, list(distinct signal order by signal) as signals from {p}hits group by 1),
 {p}base as (select l.id, l.text, l.low, coalesce(s.signals, []) as signals, len(coalesce(s.signals, [])) as n from {p}low l left join {p}sig s using (id)),
 {p}typed as (select *, case {kinds} else 'editorial_content' end as content_type, round((case {scores} else 0 end)::double, 6) as commercial_score, regexp_matches(low, '{op.REPORTED}') as reported, {strong} as strong from {p}base),
 {p}elig as (select *, case when {commercial} and reported then 'review' when {commercial} then 'excluded' when content_type = 'uncertain' then 'review' else 'eligible' end as eligibility from {p}typed),
 {p}class as (select *, case when reported and (strong or {has('sponsor')}) then 'reported_offer' when content_type in ('self_promotion', 'event_promotion') then 'guest_promotional_invitation' when {commercial} then 'paid_ad_or_sales_offer' when eligibility = 'review' then 'ambiguous' else 'neutral_mention' end as commercial_kind from {p}elig)"""


@query(f", {_PITCHES}, {_CUES}, {_hits('pitches', 'a')} select h.id, h.signal, h.start as start_char, h.start + h.n as end_char, substr(p.text, h.start + 1, h.n) as hit from ahits h join pitches p using (id)", "segments")
def c1_cue_hits(spark, sf_dir):
    return op.cue_hits(pitches(spark, sf_dir), ["id"])


@query(f", {_PITCHES}, {_CUES}, {_class('pitches', 'a')} select id, array_to_string(signals, ',') as signals, content_type, commercial_score, eligibility, reported, commercial_kind from aclass", "segments")
def c2_classify_commercial(spark, sf_dir):
    c = op.classify_content(pitches(spark, sf_dir))
    return c.select("id", F.array_join("signals", ",").alias("signals"), "content_type", "commercial_score", "eligibility", "reported", "commercial_kind")


_SALE = "[" + ", ".join(f"'{x}'" for x in op.SALE_SIGNALS) + "]"
_BLOCKS = f"""{_PITCHES}, {_CUES}, {_class('pitches', 'a')},
 s as (select p.source_id, p.id, p.start_us, p.end_us, p.text, nullif(p.speaker, 'UNKNOWN') as voice, c.signals, list_filter(c.signals, lambda x: list_contains({_SALE}, x)) as selling, c.eligibility, c.reported, row_number() over (partition by p.source_id order by p.start_us, p.end_us, p.id) as pos from pitches p join aclass c using (id)),
 step as (select *, start_us - lag(end_us) over (partition by source_id order by pos) as gap from s),
 win as (select a.source_id, a.pos, k as n, a.source_id || '|' || a.pos || '|' || k as id, (select string_agg(b.text, ' ' order by b.pos) from s b where b.source_id = a.source_id and b.pos between a.pos and a.pos + k - 1) as text from s a, (select unnest([2, 3, 4]) as k) where (select count(*) from step b where b.source_id = a.source_id and b.pos between a.pos + 1 and a.pos + k - 1 and b.gap <= 1500000) = k - 1),
 {_class('win', 'b')}, shortest as (select w.source_id, w.pos, min(w.n) as n from win w join bclass c using (id) where c.eligibility = 'excluded' group by 1, 2),
 owned as (select t.source_id, t.pos as w, b.pos, b.voice, b.eligibility = 'excluded' as excluded, len(b.selling) > 0 as marked from shortest t join s b on b.source_id = t.source_id and b.pos between t.pos and t.pos + t.n - 1),
 judged as (select source_id, w, count(distinct voice) > 1 and count(*) filter (marked and excluded) = 0 as split from owned group by 1, 2),
 seeds as (select source_id, pos, bool_or(split) as split from (select o.source_id, o.pos, j.split from owned o join judged j using (source_id, w) where o.marked union all select source_id, pos, false from s where eligibility = 'excluded') group by 1, 2),
 run as (select s.*, e.split, s.pos - row_number() over (partition by s.source_id order by s.pos) as island from seeds e join s using (source_id, pos)),
 fresh as (select *, case when start_us > max(end_us) over (partition by source_id, island order by pos rows between unbounded preceding and 1 preceding) + 2000000 then 1 when row_number() over (partition by source_id, island order by pos) = 1 then 1 else 0 end as f from run),
 numbered as (select *, sum(f) over (partition by source_id order by pos) as block_no from fresh),
 blocks as (select source_id, block_no, min(start_us) as start_us, max(end_us) as end_us, list(id order by pos) as ids, string_agg(text, ' ' order by pos) as text, list_distinct(flatten(list(signals))) as signals, coalesce(list(distinct voice) filter (voice is not null), []) as voices, bool_or(split) as split from numbered group by 1, 2),
 led as (select b.*, (select max({{'pos': p.pos, 'id': p.id, 'start_us': p.start_us, 'text': p.text, 'voice': p.voice, 'selling': p.selling, 'eligibility': p.eligibility, 'reported': p.reported}}) from s p where p.source_id = b.source_id and b.start_us - p.end_us between 0 and 1000000) as l from blocks b),
 taken as (select *, coalesce(len(l.selling) >= 2 and l.eligibility <> 'excluded' and not l.reported and not (l.voice is not null and len(voices) > 0 and not list_contains(voices, l.voice)), false) as takes from led),
 final as (select source_id, block_no, case when takes then l.start_us else start_us end as start_us, end_us, case when takes then list_prepend(l.id, ids) else ids end as ids, case when takes then l.text || ' ' || text else text end as text, list_sort(list_distinct(case when takes then list_concat(signals, l.selling) else signals end)) as all_signals, split, source_id || '|' || block_no as id from taken),
 {_class('final', 'c')}"""


@query(f", {_BLOCKS} select f.source_id, f.block_no::bigint as block_no, f.start_us, f.end_us, array_to_string(f.ids, ',') as segment_ids, array_to_string(f.all_signals, ',') as signals, case when f.split then 'review' else c.eligibility end as state from final f join cclass c using (id)", "segments")
def c3_commercial_blocks(spark, sf_dir):
    return op.commercial_blocks(pitches(spark, sf_dir).withColumnRenamed("id", "segment_id"))


def _evidence(spark, sf_dir):
    """Of each turn: its own speech, the next turn's text as seen on the screen, and counts by the turn's number."""
    c = op.classify_content(pitches(spark, sf_dir))
    w = Window.partitionBy("source_id").orderBy("turn")
    none = F.array().cast("array<string>")
    gc = F.when(F.col("turn") % 4 == 1, F.array(F.lit("qr"))).when(F.col("turn") % 4 == 2, F.array(F.lit("lower_third"))).otherwise(none)
    upstream = F.when(F.col("turn") % 11 == 10, "excluded").otherwise(F.col("eligibility"))
    return c.select(F.col("id").alias("candidate_id"), upstream.alias("eligibility"), F.col("eligibility").alias("speech_eligibility"), "reported", F.when(F.col("turn") % 9 == 8, "manual").alias("review_reason"), F.col("signals").alias("audio_signals"), F.coalesce(F.lead("signals").over(w), none).alias("visual_signals"), gc.alias("gc_kinds"), (F.col("turn") % 3 == 1).alias("persistent"), (F.col("turn") % 6).alias("requested"), F.least(F.col("turn") % 6, F.col("turn") % 5).alias("measured"), (F.col("turn") % 2).alias("failed"))


_PROMO = "['discount', 'price', 'sales_cta', 'sponsor', 'qr', 'installment']"
_RISK = f"""{_PITCHES}, {_CUES}, {_class('pitches', 'a')}, ev as (select id as candidate_id, case when turn % 11 = 10 then 'excluded' else eligibility end as eligibility, eligibility as speech_eligibility, reported, case when turn % 9 = 8 then 'manual' end as review_reason, signals as audio, coalesce(lead(signals) over (partition by source_id order by turn), []) as visual, case turn % 4 when 1 then ['qr'] when 2 then ['lower_third'] else [] end as gc, turn % 3 = 1 as persistent, turn % 6 as requested, least(turn % 6, turn % 5) as measured, turn % 2 as failed from pitches join (select id, signals, eligibility, reported from aclass) using (id)),
 pr as (select *, list_filter(visual, lambda x: list_contains({_PROMO}, x)) as promotion, round(measured / nullif(requested, 0)::double, 6) as sampling_coverage, case when failed > 0 and measured > 0 then 'partially_failed' when measured > 0 then 'sampled' else 'not_measured' end as coverage_state, list_filter(audio, lambda x: list_contains({_SALE}, x)) as heard from ev),
 kinds as (select *, case when eligibility = 'excluded' and speech_eligibility = 'excluded' then 1 when eligibility = 'excluded' then 2 when persistent and len(promotion) >= 2 and len(gc) > 0 and list_has_any(audio, ['sales_cta', 'sponsor', 'discount']) and not reported then 3 when eligibility = 'review' or len(promotion) > 0 or list_contains(gc, 'qr') then 4 when coverage_state = 'partially_failed' then 5 when coverage_state = 'sampled' then 6 else 7 end as r from pr),
 risks as (select *, ['confirmed_ad', 'requires_review', 'probable_ad', 'requires_review', 'requires_review', 'measured_no_ad_evidence', 'not_measured'][r] as state, list_sort(list_distinct(list_filter(list_concat(list_transform(promotion, lambda x: 'ocr_' || x), list_transform(heard, lambda x: 'asr_' || x), [case when len(gc) > 0 then 'gc_observed' end, case when persistent then 'repeated_ocr_samples' end, review_reason, ['grounded_commercial_exclusion', 'upstream_exclusion_unconfirmed', 'multimodal_promotion', null, 'ocr_partial_failure', 'no_ad_evidence_in_samples', 'visual_not_measured'][r]]), lambda x: x is not null))) as reasons from kinds)"""


@query(f", {_RISK} select candidate_id, state, array_to_string(reasons, ',') as reasons, coverage_state, sampling_coverage from risks", "segments")
def c4_commercial_risk(spark, sf_dir):
    r = op.commercial_risk(_evidence(spark, sf_dir))
    return r.select("candidate_id", "state", F.array_join("reasons", ",").alias("reasons"), "coverage_state", "sampling_coverage")


@query(f", {_RISK}, ads as (select id as candidate_id from pitches where turn % 5 = 2) select nullif(count(*), 0) as labelled_ads, case when count(*) > 0 and count(*) filter (state is null) = 0 then count(*) filter (state not in ('confirmed_ad', 'probable_ad', 'requires_review')) end as false_negatives, case when count(*) > 0 then count(*) filter (state is null) end as unmeasured from ads left join risks using (candidate_id)", "segments")
def c5_benchmark_commercial(spark, sf_dir):
    labels = pitches(spark, sf_dir).select(F.col("id").alias("candidate_id"), (F.col("turn") % 5 == 2).alias("expected_ad"))
    return op.commercial_benchmark(op.commercial_risk(_evidence(spark, sf_dir)), labels)


_OVER = "o as (select c.source_id, c.moment_id, arg_max(b.state, {'x': (b.state = 'excluded')::int, 'o': least(c.end_us, b.end_us) - greatest(c.start_us, b.start_us), 'id': -b.block_id}) as state from own c join blocks b on c.source_id = b.source_id and c.start_us < b.end_us and b.start_us < c.end_us group by 1, 2)"


@query(f""", blocks as (select source_id, moment_id as block_id, start_us, end_us, case when format = 'F' then 'excluded' else 'review' end as state from candidates where moment_id % 10 = 0), own as (select * from candidates where moment_id % 10 <> 0), {_OVER},
 j as (select own.*, coalesce(o.state, 'eligible') as state, round(case when o.state = 'review' then score * 0.5 else score end, 6) as new_score from own left join o using (source_id, moment_id)),
 r as (select *, case when state <> 'excluded' then row_number() over (partition by source_id order by (state = 'excluded')::int, new_score desc nulls last, moment_id) end as rank from j)
 select source_id, moment_id, state, new_score, rank, coalesce(rank <= 12 and new_score >= 0.5 and state = 'eligible', false) as shortlisted, case when state = 'excluded' then 'commercial_block' when state = 'review' then 'commercial_review' when not coalesce(rank <= 12 and new_score >= 0.5, false) then 'rank_or_score' end as gate_reason from r""", "candidates")
def c6_apply_commercial(spark, sf_dir):
    from ..operators.visual import commercial_overlay

    c = d.candidates(spark, sf_dir)
    blocks = c.where("moment_id % 10 = 0").select("source_id", F.col("moment_id").alias("block_id"), "start_us", "end_us", F.when(F.col("format") == "F", "excluded").otherwise("review").alias("state"))
    own = c.where("moment_id % 10 <> 0")
    a = op.apply_commercial(own, commercial_overlay(own, blocks))
    return a.select("source_id", "moment_id", "state", "new_score", "rank", "shortlisted", "gate_reason")


def _any(pattern: str, negation: str, n: int, p: str, negated: bool = False) -> str:
    """Whether some match in low is (not) preceded by a negation within n characters."""
    at = "(coalesce(list_sum(list_transform(parts[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int"
    return f"coalesce((select bool_or({'' if negated else 'not '}({' or '.join(f'regexp_matches(substr(low, greatest(spot - {n}, 0) + 1, least(spot, {n})), {chr(39)}{x}{chr(39)})' for x in ([negation] if isinstance(negation, str) else negation))})) from (select low, {at} as spot from (select low, m, parts, unnest(range(1, len(m) + 1)) as i from (select {p}.low, regexp_extract_all({p}.low, '{pattern}') as m, regexp_split_to_array({p}.low, '{pattern}') as parts)))), false)"


@query(f""", {_PITCHES}, {_CUES}, {_class('pitches', 'a')}, x as (select c.*, {_any(op.AFFILIATE, op.CONTEXT_NEGATION, 48, 'c')} as affiliate, {_any(op.AFFILIATE, op.CONTEXT_NEGATION, 48, 'c', True)} or {_any(op.MEASUREMENT, op.CONTEXT_NEGATION, 48, 'c', True)} as negated from aclass c),
 q as (select *, reported and (commercial_kind = 'reported_offer' or list_contains(signals, 'sales_cta') or affiliate) as quoted from x),
 n as (select *, case when trim(low) = '' or quoted then 'uncertain' when affiliate then 'affiliate' when list_contains(signals, 'sponsor') then 'sponsorship' when content_type in ({', '.join(repr(x) for x in op.COMMERCIAL_TYPES)}) then 'advertisement' when list_contains(signals, 'sales_cta') then 'call_to_purchase' when list_contains(signals, 'price') then 'factual_price_mention' when list_contains(signals, 'domain') then 'contextual_website_reference' when list_contains(signals, 'product') then 'product_discussion' else 'uncertain' end as classification from q)
 select id, classification, array_to_string(list_filter([case when regexp_matches(low, '{op.MEASUREMENT}') then 'physical_quantity' end, case when quoted then 'reported_offer' end, case when negated then 'negated_mention' end, case when trim(low) = '' then 'no_text' end, case when classification = 'uncertain' and trim(low) <> '' and not quoted then 'no_cue' end], lambda x: x is not null), ',') as flags from n""", "segments")
def n22_commercial_context(spark, sf_dir):
    c = op.commercial_context(pitches(spark, sf_dir))
    return c.select("id", "classification", F.array_join("flags", ",").alias("flags"))


@query(f""", {_PITCHES}, l as (select id, {_FOLD} as low, coalesce(lead({_FOLD}) over (partition by source_id order by turn), '') as after from pitches),
 k as (select id, low, after, list_filter([{', '.join(f"case when {_any(p, [op.SAID, op.NEVER], 100, 'l')} then '{n}' end" for n, p in op.REQUESTS)}], lambda x: x is not null) as requests, list_filter([{', '.join(f"case when regexp_matches(low, '{p}') then '{n}' end" for n, p in op.INTEREST)}], lambda x: x is not null) as interests from l),
 h as (select *, len(requests) >= 2 or len(requests) > 0 and (regexp_matches(low, '{op.CLOSING}') or regexp_matches(after, '{op.CLOSING}')) as house from k), p as (select *, case when house and len(interests) > 0 then 'MIXED_CTA_CONTENT' when house then 'CTA_HOUSEKEEPING' when len(interests) > 0 then 'CONTENT_REVIEW' else 'UNRESOLVED' end as potential from h)
 select id, array_to_string(requests, ',') as requests, array_to_string(interests, ',') as interests, potential, case when potential in ('CONTENT_REVIEW', 'MIXED_CTA_CONTENT') then 'INTERESTING_CANDIDATE' when potential = 'UNRESOLVED' then 'INTEREST_UNRESOLVED' else 'HOUSEKEEPING_REVIEW' end as interest_state from p""", "segments")
def c17_editorial_potential(spark, sf_dir):
    p = pitches(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("source_id").orderBy("turn")))
    e = op.editorial_potential(p, "text", "after")
    return e.select("id", F.array_join("requests", ",").alias("requests"), F.array_join("interests", ",").alias("interests"), "potential", "interest_state")
