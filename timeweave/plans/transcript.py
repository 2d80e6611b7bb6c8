"""Transcript queries over conversations as segments and words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import clean
from ..sources import derived as d
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query

# words with some starts moved back, some ends before their starts, and a duration that cuts off the last ones
_ROUGH = "rough as (select source_id, word_id, segment_id, word, confidence, row_number() over (partition by source_id order by start_us, word_id) as pos, start_us - case when k % 3 = 1 then 400000 else 0 end as start_us, end_us - case when k % 7 = 3 then 900000 else 0 end as end_us from words), dur as (select source_id, max(end_us) - 2000000 as duration_us from words group by 1)"


def _rough(spark, sf_dir):
    w = d.words(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("source_id").orderBy("start_us", "word_id"))
    r = w.select("source_id", "word_id", "segment_id", "word", "confidence", pos.alias("pos"), (F.col("start_us") - F.when(F.col("k") % 3 == 1, 400_000).otherwise(0)).alias("start_us"), (F.col("end_us") - F.when(F.col("k") % 7 == 3, 900_000).otherwise(0)).alias("end_us"))
    return r, w.groupBy("source_id").agg((F.max("end_us") - 2_000_000).alias("duration_us"))


@query(f""", {_ROUGH}, v as (select r.*, duration_us, end_us > start_us and start_us < duration_us and start_us >= 0 as ok, least(end_us, duration_us) as fe from rough r join dur using (source_id)),
 p as (select *, greatest(0, start_us, coalesce(max(case when ok then fe end) over (partition by source_id order by pos rows between unbounded preceding and 1 preceding), 0)) as fs from v),
 q as (select *, case when not ok then 'invalid' when fs >= fe then 'covered' when fs <> start_us or fe <> end_us then 'repaired' else 'ok' end as reason from p)
 select source_id, word_id, start_us, end_us, case when reason in ('ok', 'repaired') then fs end as fixed_start, case when reason in ('ok', 'repaired') then fe end as fixed_end, reason from q""", "words")
def n2_repair_word_times(spark, sf_dir):
    return clean.repair_word_times(*_rough(spark, sf_dir))


_FLAGGED = "flagged as (select *, reasons <> '' as needs_review from (select *, array_to_string(list_sort(list_filter([case when confidence < 0.6 then 'low_probability' end, case when end_us <= start_us then 'timestamp' end, case when lower(word) = lag(lower(word), 1) over w and lower(word) = lag(lower(word), 2) over w and lower(word) = lag(lower(word), 3) over w then 'repeated' end], lambda x: x is not null)), '+') as reasons from words window w as (partition by source_id order by start_us, word_id)))"


@query(f", {_FLAGGED} select word_id, reasons, needs_review, (sum(needs_review::int) over (partition by source_id order by start_us, word_id rows between 5 preceding and 5 following))::bigint as near_flags from flagged", "words")
def n4_flag_words(spark, sf_dir):
    return clean.flag_words(d.words(spark, sf_dir)).select("word_id", "reasons", "needs_review", "near_flags")


@query("""select word_id, array_to_string(list_filter([case when coalesce(confidence < 0.3, true) then 'uncertain' end, case when end_us - start_us < 40000 then 'timestamp' end, case when lag(end_us) over w > start_us then 'overlap' end, case when suffix(word, '-') then 'trailing_dash' end], lambda x: x is not null), '+') as issues from words window w as (partition by source_id order by start_us, word_id)""", "words")
def n15_word_issues(spark, sf_dir):
    return clean.word_issues(d.words(spark, sf_dir)).select("word_id", "issues")


@query(f", {_FLAGGED} select source_id, count(*) as n_words, count(*) filter (needs_review) as n_flagged, count(confidence) as n_scored, round(count(*) filter (needs_review) / count(*), 6) as flagged_share, round(avg(confidence), 6) as mean_confidence from flagged group by 1", "words")
def b2_transcription_metrics(spark, sf_dir):
    return clean.transcription_metrics(clean.flag_words(d.words(spark, sf_dir)))


@query(f", {_FLAGGED} select 'signature' as kind, reasons as key, count(*) as n from flagged where needs_review group by 2 union all select 'reason', key, count(*) from (select unnest(string_split(reasons, '+')) as key from flagged where needs_review) group by 2", "words")
def b3_review_signatures(spark, sf_dir):
    return clean.review_signatures(clean.flag_words(d.words(spark, sf_dir)))


@query(f""", {_FLAGGED}, r as (select source_id, segment_id, word_id, reasons, row_number() over (partition by reasons order by source_id, start_us, word_id) as k from flagged where needs_review) select reasons, k::int as k, word_id, segment_id from r where k <= 10""", "words")
def b4_uncertain_samples(spark, sf_dir):
    f = clean.flag_words(d.words(spark, sf_dir)).where("needs_review")
    return f.withColumn("k", F.row_number().over(Window.partitionBy("reasons").orderBy("source_id", "start_us", "word_id"))).where("k <= 10").select("reasons", "k", "word_id", "segment_id")


@query(f""", {_ROUGH}, j as (select r.*, duration_us, s.start_us as a, s.end_us as b, count(*) over (partition by r.source_id, r.word_id) as copies, lag(r.end_us) over (partition by r.source_id order by r.start_us, r.end_us, r.word_id) as p from rough r left join dur using (source_id) left join segments s on s.source_id = r.source_id and s.segment_id = r.segment_id)
 select source_id, word_id, least(end_us, duration_us) as end_us, case when trim(word) = '' then 'empty_word' when start_us < 0 or end_us <= start_us then 'invalid_time' when end_us > duration_us + 100000 then 'past_duration' when copies > 1 then 'duplicate_id' when p > start_us then 'overlap' when confidence not between 0 and 1 then 'confidence' when a is null then 'no_segment' when start_us < a or end_us > b then 'outside_segment' end as reject_reason from j""", "words")
def s1_read_words(spark, sf_dir):
    rough, dur = _rough(spark, sf_dir)
    return clean.validate_words(rough, d.segments(spark, sf_dir), dur)


@query("""select s.source_id, s.segment_id, 'SPEAKER_' || lpad((r - 1)::varchar, 2, '0') as label from segments s join (select source_id, speaker, row_number() over (partition by source_id order by min(start_us), speaker) as r from segments group by 1, 2) using (source_id, speaker)""", "segments")
def s2_relabel_speakers(spark, sf_dir):
    return clean.relabel_speakers(d.segments(spark, sf_dir)).select("source_id", "segment_id", "label")


@query("""select segment_id, lpad((ms // 3600000)::varchar, 2, '0') || ':' || lpad((ms // 60000 % 60)::varchar, 2, '0') || ':' || lpad((ms // 1000 % 60)::varchar, 2, '0') || ',' || lpad((ms % 1000)::varchar, 3, '0') || ' ' || speaker || ': ' || text as line from (select *, (start_us + 1234567 + 500) // 1000 as ms from segments)""", "segments")
def s7_srt_lines(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    return s.select("segment_id", F.concat(numbers.stamp(F.col("start_us") + 1_234_567), F.lit(" "), "speaker", F.lit(": "), "text").alias("line"))


@query("""select source_id, segment_id, array_to_string(list_filter([case when end_us - start_us < 3000000 then 'short' end, case when end_us - start_us > 8500000 then 'long' end, case when length(text) > 400 then 'dense' end, case when lag(end_us) over (partition by source_id order by start_us) > start_us then 'overlap' end], lambda x: x is not null), '+') as issues from segments""", "segments")
def c20_caption_checks(spark, sf_dir):
    return clean.caption_checks(d.segments(spark, sf_dir), 3_000_000, 8_500_000, 400).select("source_id", "segment_id", "issues")


@query("""select s.source_id, s.segment_id, coalesce(said = trim(regexp_replace(text, '\\s+', ' ', 'g')) and ordered and lo >= start_us and hi <= end_us, false) as aligned from segments s left join (select source_id, segment_id, string_agg(word, ' ' order by start_us, word_id) as said, min(start_us) as lo, max(end_us) as hi, coalesce(bool_and(p <= start_us), true) as ordered from (select *, lag(end_us) over (partition by source_id, segment_id order by start_us, word_id) as p from words) group by 1, 2) using (source_id, segment_id)""", "words")
def j23_caption_word_alignment(spark, sf_dir):
    return clean.caption_alignment(d.words(spark, sf_dir), d.segments(spark, sf_dir))


@query("""select w.source_id, h, round(avg((confidence < 0.6)::int), 6) as flagged_share from (select *, start_us // 10000000 as h from words) w group by 1, 2""", "words")
def j21_window_difficulty(spark, sf_dir):
    w = d.words(spark, sf_dir)
    return w.groupBy("source_id", F.expr("start_us div 10000000").alias("h")).agg(F.round(F.avg((F.col("confidence") < 0.6).cast("int")), 6).alias("flagged_share"))


@query("""select source_id, speaker, sum(end_us - start_us)::bigint as speech_us, round(sum(end_us - start_us) / sum(sum(end_us - start_us)) over (partition by source_id), 6) as share from segments group by 1, 2""", "segments")
def b1_speech_seconds(spark, sf_dir):
    s = d.segments(spark, sf_dir).groupBy("source_id", "speaker").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("speech_us"))
    return s.withColumn("share", numbers.ratio(F.col("speech_us"), F.sum("speech_us").over(Window.partitionBy("source_id"))))


@query("""select w.source_id, w.word_id, string_agg(o.word_id, ',' order by o.start_us, o.word_id) as before from (select *, row_number() over (partition by source_id order by start_us, word_id) as pos from words) w left join (select *, row_number() over (partition by source_id order by start_us, word_id) as pos from words) o on o.source_id = w.source_id and o.pos between w.pos - 5 and w.pos - 1 group by 1, 2""", "words")
def w2_context_rows(spark, sf_dir):
    w = Window.partitionBy("source_id").orderBy("start_us", "word_id").rowsBetween(-5, -1)
    c = d.words(spark, sf_dir).withColumn("before", F.nullif(F.array_join(F.collect_list("word_id").over(w), ","), F.lit("")))
    return c.select("source_id", "word_id", "before")


@query("""select word_id, 'WORD_' || lpad((row_number() over (partition by source_id order by start_us, word_id))::varchar, 7, '0') as stable_id, substr(sha256(word || '|' || start_us), 1, 12) as content_id from words""", "words")
def w1_stable_ids(spark, sf_dir):
    w = Window.partitionBy("source_id").orderBy("start_us", "word_id")
    return d.words(spark, sf_dir).select("word_id", F.format_string("WORD_%07d", F.row_number().over(w)).alias("stable_id"), F.substring(F.sha2(F.concat_ws("|", "word", "start_us"), 256), 1, 12).alias("content_id"))


_TOKENS = "string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ')"


@query(f"""select phrase_id, p.source_id, p.segment_id, min(i)::int as first_at from (select source_id, segment_id, {_TOKENS} as t, unnest(range(1, len({_TOKENS}) + 1)) as i from segments) p join (select source_id, segment_id as phrase_id, {_TOKENS}[-2:] as w from segments) q on p.source_id = q.source_id and list_slice(t, i, i + len(w) - 1) = w group by 1, 2, 3""", "segments")
def j24_phrase_locate(spark, sf_dir):
    s = d.segments(spark, sf_dir)
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    phrases = s.select("source_id", F.col("segment_id").alias("phrase_id"), F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2).alias("phrase"))
    return clean.phrase_locate(phrases, s.select("source_id", "segment_id", words.alias("tokens")))


@query("""with t as (select event_id as id, user_id % 5 as source_id, user_id as moment_id, event_type as text, epoch_us(ts) as observed_us, round(value % 1 * 0.5, 2)::double as x, round((value * 7) % 1 * 0.5, 2)::double as y, 0.2::double as width, round(value % 3 / 10, 2)::double as height from events),
 v as (select *, x >= 0 and y >= 0 and x + width <= 1 and y + height <= 1 and height between 0.005 and 0.25 and width between 0.01 and 0.95 as valid from t)
 select a.id, a.valid, count(distinct b.observed_us) as instants, max(b.observed_us) - min(b.observed_us) as observed_for_us, count(distinct b.observed_us) >= 3 as persistent from v a left join v b on a.valid and b.valid and a.source_id = b.source_id and a.moment_id = b.moment_id and a.text = b.text and abs(a.observed_us - b.observed_us) <= 864000000000 and round(abs(a.x - b.x), 6) <= 0.025 and round(abs(a.y - b.y), 6) <= 0.025 and round(abs(a.width - b.width), 6) <= 0.025 and round(abs(a.height - b.height), 6) <= 0.025 group by 1, 2""")
def j22_persistent_text(spark, sf_dir):
    v = F.col("value")
    e = d.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("source_id"), F.col("user_id").alias("moment_id"), F.col("event_type").alias("text"), d.micros("ts").alias("observed_us"), F.round(v % 1 * 0.5, 2).alias("x"), F.round((v * 7) % 1 * 0.5, 2).alias("y"), F.lit(0.2).alias("width"), F.round(v % 3 / 10, 2).alias("height"))
    return clean.persistent_text(e, 864_000_000_000).select("id", "valid", "instants", "observed_for_us", "persistent")
