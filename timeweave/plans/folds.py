"""Folds per source: rows-only for SQL, with golden tests of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, identity
from ..operators import folds as op
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


def _fold(rows: str, begins: str, state: dict[str, tuple[str, str]], text: str) -> str:
    """Runs by recursion over rows (source_id, i, start_us, end_us, ...): a new run where `begins` holds of the run's state r and the next row o. state: name to its value at a run's first row and at a further one."""
    first = ", ".join(f"{a} as {k}" for k, (a, _) in state.items())
    later = ", ".join(f"case when {begins} then {a} else {b} end as {k}" for k, (a, b) in state.items())
    return f""", o as ({rows}), r as (select source_id, i, 0 as g, start_us as gs, end_us as pe, {first} from o where i = 1 union all
 select o.source_id, o.i, case when {begins} then r.g + 1 else r.g end, case when {begins} then o.start_us else r.gs end, o.end_us, {later} from r join o on o.source_id = r.source_id and o.i = r.i + 1)
 select source_id, g::int as group_no, arg_min(start_us, i) as start_us, arg_max(end_us, i) as end_us, count(*)::int as n, string_agg({text}, ' ' order by i) as text from r join o using (source_id, i) group by source_id, g"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


_WORDS = "select source_id, word, start_us, end_us, speaker, row_number() over (partition by source_id order by start_us, word_id) as i from words"
_ENDED = "(ends_with(r.pw, '.') or ends_with(r.pw, '?') or ends_with(r.pw, '!'))"


@query(_fold(_WORDS, f"(o.start_us - r.pe > 100000 or o.end_us - r.gs > 3000000 or {_ENDED})", {"pw": ("o.word", "o.word")}, "word"), "words")
def a10_regroup_words(spark, sf_dir):
    return op.regroup_words(d.words(spark, sf_dir), 100_000, 3_000_000)


@query(_fold("select source_id, text, start_us, end_us, row_number() over (partition by source_id order by start_us, segment_id) as i from segments", "(o.end_us - r.gs > 60000000 or r.size + length(o.text) + 150 > 3000)", {"size": ("length(o.text) + 150", "r.size + length(o.text) + 150")}, "text"), "segments")
def a12_semantic_chunks(spark, sf_dir):
    return op.semantic_chunks(d.segments(spark, sf_dir), 60_000_000, 3_000)


@query(_fold(_WORDS + " where end_us > start_us", f"(r.n >= 5 or r.chars + length(o.word) > 38 or o.end_us - r.gs > 2800000 or o.start_us - r.pe > 450000 or o.speaker <> r.pv or {_ENDED})", {"pw": ("o.word", "o.word"), "pv": ("o.speaker", "o.speaker"), "n": ("1", "r.n + 1"), "chars": ("length(o.word) + 1", "r.chars + length(o.word) + 1")}, "word"), "words")
def a11_caption_groups(spark, sf_dir):
    return op.caption_groups(d.words(spark, sf_dir))


@query(""", f as (select *, lower(word) as w from words), g as (select source_id, start_us, end_us from (select *, confidence < 0.05 or end_us <= start_us or coalesce(w = lag(w) over x and w = lag(w, 2) over x and w = lag(w, 3) over x, false) as bad from f window x as (partition by source_id order by start_us, word_id)) where bad), d as (select source_id, max(end_us) as duration_us from words group by 1),
 o as (select source_id, greatest(0, start_us - 200000) as a, least(duration_us, end_us + 200000) as b, row_number() over (partition by source_id order by start_us, end_us) as i from g join d using (source_id)),
 r as (select source_id, i, 0 as k, a as gs, b as ge from o where i = 1 union all select o.source_id, o.i, case when o.a <= r.ge and o.b - r.gs <= 30000000 then r.k else r.k + 1 end, case when o.a <= r.ge and o.b - r.gs <= 30000000 then r.gs else o.a end, o.b from r join o on o.source_id = r.source_id and o.i = r.i + 1)
 select source_id, any_value(gs) as start_us, arg_max(ge, i) as end_us, count(*)::int as n from r group by source_id, k""", "words")
def a13_review_regions(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return op.review_regions(clean.flag_words(w, 0.05).where("needs_review"), w.groupBy("source_id").agg(F.max("end_us").alias("duration_us")), 200_000)


@query()
def t5_story_set(spark, sf_dir):
    return op.story_set(d.candidates(spark, sf_dir))


@query(""", o as (select source_id, moment_id as id, start_us, end_us, row_number() over (partition by source_id order by topic, start_us, moment_id) as i from candidates), z as (select source_id, 0::bigint as i, null::bigint as id, '' as state, []::struct(a bigint, b bigint)[] as taken, 0::bigint as spent from (select distinct source_id from o)),
 r as (select * from z union all select q.source_id, q.i, q.id, q.state, case when q.state = 'taken' then list_append(q.taken, {'a': q.start_us, 'b': q.end_us}) else q.taken end, case when q.state = 'taken' then q.spent + q.end_us - q.start_us else q.spent end from (select o.*, r.taken, r.spent, case when len(list_filter(r.taken, lambda t: o.start_us < t.b and t.a < o.end_us)) > 0 then 'overlaps' when len(r.taken) >= 16 then 'region_budget' when r.spent + o.end_us - o.start_us > 600000000 then 'time_budget' else 'taken' end as state from r join o on o.source_id = r.source_id and o.i = r.i + 1) q)
 select source_id, id, state from r where i > 0""", "candidates")
def t6_budgeted_windows(spark, sf_dir):
    c = d.candidates(spark, sf_dir)
    return op.budgeted_windows(c.select("source_id", F.col("moment_id").alias("id"), F.col("topic").alias("priority"), "start_us", "end_us"), budget_us=600 * op.SECOND)


@query("""with u as (select user_id as source_id, epoch_us(ts) // 86400000000 as window_no, event_type as state, round(avg(value) / 20, 6) as utility from events group by 1, 2, 3), w as (select source_id, window_no, list({'state': state, 'u': utility} order by state) as o, row_number() over (partition by source_id order by window_no) as i from u group by 1, 2),
 r as (select source_id, i, list_transform(o, lambda x: {'s': x.state, 'v': x.u, 'path': [{'w': window_no, 's': x.state}]}) as vs from w where i = 1 union all
 select source_id, i, list({'s': s, 'v': b.v + u, 'path': list_append(b.path, {'w': window_no, 's': s})} order by s) from (select source_id, i, window_no, s, u, min({'neg': -round(v.v + case when v.s = s then 0.28::double else -0.28::double - 0.08::double end, 9), 'q': v.s, 'v': v.v + case when v.s = s then 0.28::double else -0.28::double - 0.08::double end, 'path': v.path}) as b from (select source_id, i, window_no, x.state as s, x.u as u, unnest(vs) as v from (select w.source_id, w.i, w.window_no, unnest(w.o) as x, r.vs from r join w on w.source_id = r.source_id and w.i = r.i + 1)) group by source_id, i, window_no, s, u) group by source_id, i),
 last as (select source_id, arg_max(vs, i) as vs from r group by 1), best as (select source_id, min({'neg': -round(v.v, 9), 's': v.s, 'path': v.path}).path as path from (select source_id, unnest(vs) as v from last) group by 1) select source_id, p.w as window_no, p.s as state from (select source_id, unnest(path) as p from best)""")
def w4_trajectory_states(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id"), F.floor(d.micros("ts") / 86_400_000_000).alias("window_no"), F.col("event_type").alias("state"))
    return op.trajectory_states(e.agg(F.round(F.avg("value") / 20, 6).alias("utility")))


@query()
def j18_hypothesis_diff(spark, sf_dir):
    w = d.words(spark, sf_dir).withColumnRenamed("segment_id", "region_id")
    other = w.where("k % 9 <> 4").withColumn("word", F.when(F.col("k") % 7 == 2, "other").otherwise(F.col("word")))
    return op.hypothesis_diff(w, other)


@query()
def j19_match_boxes(spark, sf_dir):
    v = F.col("value")
    b = d.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("source_id"), (F.col("event_id") % 100).alias("frame_id"), F.col("event_id").alias("id"), (v % 1 * 0.5).alias("x"), (v * 3 % 1 * 0.5).alias("y"), (v * 7 % 1 * 0.3 + 0.1).alias("w"), (v * 11 % 1 * 0.3 + 0.1).alias("h"))
    return op.match_boxes(b.where("id % 7 <> 3"), b.withColumn("x", F.col("x") + 0.02))


@query()
def b12_reid_cluster(spark, sf_dir):
    v = d.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), (F.col("vec_id") % 5).alias("source_id"), "embedding")
    return op.reid_cluster(identity.unit_vectors(v, "embedding").select("source_id", "track_id", (F.col("track_id") * 1_000_000).alias("start_us"), (F.col("track_id") * 1_000_000 + 2_500_000).alias("end_us"), "unit"), 0.25, 0.02)


@query()
def b46_simplify_tracks(spark, sf_dir):
    e = d.table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("source_id"), F.col("user_id").alias("track_id"), d.micros("ts").alias("time_us"), (F.col("value") / 20).alias("x"), (F.col("value") % 3 / 3).alias("y"))
    return op.simplify_tracks(e, 0.2, 36_000_000_000)


@query(""", o as (select source_id, segment_id, start_us, end_us, speaker, speaker = 'user' and length(text) % 2 = 0 as is_q, row_number() over (partition by source_id order by start_us, segment_id) as i from segments),
 r as (select source_id, segment_id as question_id, speaker, start_us as qs, i as i0, i as j, end_us as last, []::varchar[] as answers, null::varchar as voice, null::bigint as answer_end_us, null::varchar as stop from o where is_q union all
 select source_id, question_id, speaker, qs, i0, j + 1, case when why is null then ne else last end, case when why is null and nv <> speaker then list_append(answers, nid) else answers end, case when why is null and nv <> speaker and voice is null then nv else voice end, case when why is null and nv <> speaker then ne else answer_end_us end, why from (select r.*, o.end_us as ne, o.speaker as nv, o.segment_id as nid, case when o.end_us - qs > 125000000 then 'window' when o.start_us - last > 20000000 then 'pause' when o.speaker = r.speaker and o.is_q then 'next_question' when voice is not null and o.speaker not in (r.speaker, voice) then 'hand_off' end as why from r join o on o.source_id = r.source_id and o.i = r.j + 1 where r.stop is null and r.j - r.i0 < 32))
 select source_id, question_id, array_to_string(answers, ',') as answer_ids, answer_end_us, case when len(answers) = 0 then 'unanswered_' else '' end || coalesce(stop, 'end') as stop from (select *, row_number() over (partition by source_id, question_id order by j desc) as k from r) where k = 1""", "segments")
def c8_pair_questions(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    p = op.pair_questions(s.withColumn("is_question", (F.col("speaker") == "user") & (F.length("text") % 2 == 0)))
    return p.withColumn("answer_ids", F.array_join("answer_ids", ","))


@query(""", l as (select source_id, moment_id as seq, ['approve', 'reject', 'shrink', 'commercial', 'approve', 'expand'][(moment_id % 6 + 1)::int] as action, case when moment_id % 6 = 1 then moment_id - 1 else moment_id end as id, case when moment_id % 6 = 2 then start_us + 1000000 end as s, case when moment_id % 6 = 2 then end_us - 1000000 end as e from candidates),
 k as (select l.*, c.start_us as lo, c.end_us as hi, row_number() over (partition by l.source_id order by seq) as i from l join candidates c on c.source_id = l.source_id and c.moment_id = l.id),
 z as (select distinct source_id, 0::bigint as i, []::struct(seq bigint, id bigint, s bigint, e bigint)[] as stand, []::bigint[] as barred from k),
 r as (select * from z union all select source_id, i, case when ok and puts then list_append(list_filter(stand, lambda x: x.id <> id), {'seq': seq, 'id': id, 's': coalesce(s, lo), 'e': coalesce(e, hi)}) when ok then list_filter(stand, lambda x: x.id <> id) else stand end, case when action = 'commercial' then list_append(barred, id) else barred end
  from (select k.*, r.stand, r.barred, action in ('approve', 'expand', 'shrink') as puts, action in ('reject', 'commercial') or not (list_contains(r.barred, k.id) or coalesce(k.s, k.lo) >= coalesce(k.e, k.hi) or action = 'shrink' and (coalesce(k.s, k.lo) < k.lo or coalesce(k.e, k.hi) > k.hi)) as ok from r join k on k.source_id = r.source_id and k.i = r.i + 1)),
 last as (select source_id, arg_max(stand, i) as stand from r group by 1) select source_id, x.seq as seq, x.id::varchar as candidate_ids, x.s as start_us, x.e as end_us from (select source_id, unnest(stand) as x from last)""", "candidates")
def c21_decisions_apply(spark, sf_dir):
    c = d.candidates(spark, sf_dir)
    seq = F.col("moment_id")
    action = F.element_at(F.array(*map(F.lit, ("approve", "reject", "shrink", "commercial", "approve", "expand"))), (seq % 6 + 1).cast("int"))
    log = c.select("source_id", seq.alias("seq"), action.alias("action"), F.array(F.when(seq % 6 == 1, seq - 1).otherwise(seq)).alias("candidate_ids"), F.when(seq % 6 == 2, F.col("start_us") + 1_000_000).alias("start_us"), F.when(seq % 6 == 2, F.col("end_us") - 1_000_000).alias("end_us"))
    return op.apply_decisions(log, c).withColumn("candidate_ids", F.array_join(F.col("candidate_ids").cast("array<string>"), ","))


for _name in ("a10_regroup_words", "a11_caption_groups", "a12_semantic_chunks", "a13_review_regions", "t6_budgeted_windows", "c8_pair_questions", "c21_decisions_apply", "w4_trajectory_states"):
    ORACLES[_name] = _recursive(ORACLES[_name])
