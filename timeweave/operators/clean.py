"""Transcript repair, flags and checks on words and segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, unit_or_null


def repair_word_times(words: DataFrame, durations: DataFrame) -> DataFrame:
    """Starts clipped to the running end of the words before, ends to the duration; the raw times and a reason are kept.

    A word that starts at or after the duration or has no positive length is rejected; so is one that the words before it
    cover. The running maximum over valid rows equals the end of the last accepted word, as a covered word can't raise it.
    """
    w = words.join(durations.select("source_id", "duration_us"), "source_id")
    ok = F.coalesce((F.col("end_us") > F.col("start_us")) & (F.col("start_us") < F.col("duration_us")) & (F.col("start_us") >= 0), F.lit(False))
    end = F.least("end_us", "duration_us")
    before = F.max(F.when(ok, end)).over(Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    start = F.greatest(F.lit(0).cast("long"), F.col("start_us"), F.coalesce(before, F.lit(0)))
    w = w.withColumn("ok", ok).withColumn("fixed_start", start).withColumn("fixed_end", end)
    reason = F.when(~F.col("ok"), "invalid").when(F.col("fixed_start") >= F.col("fixed_end"), "covered").when((F.col("fixed_start") != F.col("start_us")) | (F.col("fixed_end") != F.col("end_us")), "repaired").otherwise("ok")
    w = w.withColumn("reason", reason)
    kept = F.col("reason").isin("ok", "repaired")
    return w.select("source_id", "word_id", "start_us", "end_us", F.when(kept, F.col("fixed_start")).alias("fixed_start"), F.when(kept, F.col("fixed_end")).alias("fixed_end"), "reason")


def flag_words(words: DataFrame, threshold: float = 0.6, around: int = 5) -> DataFrame:
    """Review reasons of each word, and how many flagged words stand within `around` words of it."""
    w = Window.partitionBy("source_id").orderBy("start_us", "word_id")
    conf = unit_or_null(F.col("confidence"))
    same = F.lit(True)
    for k in (1, 2, 3):
        same = same & F.coalesce(F.lower("word") == F.lower(F.lag("word", k).over(w)), F.lit(False))
    reasons = F.array_compact(F.array(F.when(conf.isNull(), F.lit("missing_probability")), F.when(conf < threshold, F.lit("low_probability")), F.when(F.col("end_us") <= F.col("start_us"), F.lit("timestamp")), F.when(same, F.lit("repeated"))))
    flagged = words.withColumn("reasons", F.array_join(F.array_sort(reasons), "+"))
    near = F.sum((F.col("reasons") != "").cast("int")).over(w.rowsBetween(-around, around))
    return flagged.withColumn("needs_review", F.col("reasons") != "").withColumn("near_flags", near)


def word_issues(words: DataFrame) -> DataFrame:
    """Caption problems of each word, joined by +."""
    w = Window.partitionBy("source_id").orderBy("start_us", "word_id")
    issues = F.array_compact(F.array(F.when(F.coalesce(F.col("confidence") < 0.3, F.lit(True)), F.lit("uncertain")), F.when(F.col("end_us") - F.col("start_us") < 40_000, F.lit("timestamp")), F.when(F.lag("end_us").over(w) > F.col("start_us"), F.lit("overlap")), F.when(F.col("word").endswith("-"), F.lit("trailing_dash"))))
    return words.withColumn("issues", F.array_join(issues, "+"))


def transcription_metrics(flagged: DataFrame) -> DataFrame:
    """Counts and shares of one source's words; no words, no share."""
    n = F.count(F.lit(1))
    return flagged.groupBy("source_id").agg(n.alias("n_words"), F.count_if("needs_review").alias("n_flagged"), F.count("confidence").alias("n_scored"), ratio(F.count_if("needs_review"), n).alias("flagged_share"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def review_signatures(flagged: DataFrame) -> DataFrame:
    """Flagged words by their exact set of reasons, and by each reason alone."""
    own = flagged.where("needs_review")
    sets = own.groupBy(F.col("reasons").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("signature").alias("kind"), "key", "n")
    each = own.select(F.explode(F.split("reasons", r"\+")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit("reason").alias("kind"), "key", "n")
    return sets.unionByName(each)


def validate_words(words: DataFrame, segments: DataFrame, durations: DataFrame, slack_us: int = 100_000) -> DataFrame:
    """word_id, reject_reason (null: accepted) by the first rule that fails; ends past the duration within the slack are clipped."""
    ids = Window.partitionBy("source_id", "word_id")
    order = Window.partitionBy("source_id").orderBy("start_us", "end_us", "word_id")
    s = segments.select("source_id", "segment_id", F.col("start_us").alias("seg_start"), F.col("end_us").alias("seg_end"))
    w = words.join(durations.select("source_id", "duration_us"), "source_id", "left").join(s, ["source_id", "segment_id"], "left")
    w = w.withColumn("copies", F.count(F.lit(1)).over(ids)).withColumn("before", F.lag("end_us").over(order))
    reason = (
        F.when(F.col("word").isNull() | (F.trim("word") == ""), "empty_word").when(F.col("start_us").isNull() | F.col("end_us").isNull() | (F.col("start_us") < 0) | (F.col("end_us") <= F.col("start_us")), "invalid_time")
        .when(F.col("end_us") > F.col("duration_us") + slack_us, "past_duration").when(F.col("copies") > 1, "duplicate_id").when(F.col("before") > F.col("start_us"), "overlap")
        .when(F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1), "confidence").when(F.col("seg_start").isNull(), "no_segment").when((F.col("start_us") < F.col("seg_start")) | (F.col("end_us") > F.col("seg_end")), "outside_segment")
    )
    return w.select("source_id", "word_id", F.least("end_us", "duration_us").alias("end_us"), reason.alias("reject_reason"))


def relabel_speakers(turns: DataFrame) -> DataFrame:
    """SPEAKER_00... in order of first appearance in each source."""
    first = turns.groupBy("source_id", "speaker").agg(F.min("start_us").alias("first"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("first", "speaker")) - 1
    names = first.select("source_id", "speaker", F.concat(F.lit("SPEAKER_"), F.lpad(rank.cast("string"), 2, "0")).alias("label"))
    return turns.join(names, ["source_id", "speaker"])


def caption_checks(captions: DataFrame, least_us: int, most_us: int, most_chars: int) -> DataFrame:
    """Captions that are too short, too long, too dense, or overlap the one before."""
    w = Window.partitionBy("source_id").orderBy("start_us")
    length = F.col("end_us") - F.col("start_us")
    found = F.array_compact(F.array(F.when(length < least_us, F.lit("short")), F.when(length > most_us, F.lit("long")), F.when(F.length("text") > most_chars, F.lit("dense")), F.when(F.lag("end_us").over(w) > F.col("start_us"), F.lit("overlap"))))
    return captions.withColumn("issues", F.array_join(found, "+"))


def persistent_text(ocr: DataFrame, gap_us: int = 10_000_000, tolerance: float = 0.025, least: int = 3) -> DataFrame:
    """Adds valid (a plausible box), instants (distinct times at which the same text of one moment stands within the tolerance, gap_us away at most), the time from the first to the last, and whether there are `least` or more.

    Sightings meet by (source, moment, text, time bucket of gap_us), so a text seen all day meets only its neighbours in time.
    """
    box = ("x", "y", "width", "height")
    finite = reduce(lambda p, q: p & q, [F.col(c).isNotNull() & ~F.isnan(c) for c in box])
    valid = finite & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") + F.col("width") <= 1) & (F.col("y") + F.col("height") <= 1) & F.col("height").between(0.005, 0.25) & F.col("width").between(0.01, 0.95) & (F.col("observed_us") >= 0)
    seen = ocr.withColumn("valid", F.coalesce(valid, F.lit(False)))
    said = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    own = seen.where("valid").select("id", "source_id", "moment_id", said.alias("said"), "observed_us", *box, F.explode(F.sequence(F.expr(f"observed_us div {gap_us} - 1"), F.expr(f"observed_us div {gap_us} + 1"))).alias("bucket"))
    others = seen.where("valid").select(F.col("source_id").alias("s2"), F.col("moment_id").alias("m2"), said.alias("t2"), F.col("observed_us").alias("o2"), *(F.col(c).alias(f"{c}2") for c in box), F.expr(f"observed_us div {gap_us}").alias("b2"))
    same = (F.col("source_id") == F.col("s2")) & F.col("moment_id").eqNullSafe(F.col("m2")) & (F.col("said") == F.col("t2")) & (F.col("bucket") == F.col("b2"))
    near = reduce(lambda p, q: p & q, [F.round(F.abs(F.col(c) - F.col(f"{c}2")), 6) <= tolerance for c in box], F.abs(F.col("observed_us") - F.col("o2")) <= gap_us)
    per = own.join(others, same & near).groupBy("id").agg(F.countDistinct("o2").alias("instants"), (F.max("o2") - F.min("o2")).alias("observed_for_us"))
    return seen.join(per, "id", "left").withColumn("instants", F.coalesce("instants", F.lit(0))).withColumn("persistent", F.col("instants") >= least)


def phrase_locate(phrases: DataFrame, segments: DataFrame) -> DataFrame:
    """phrase_id, source_id, segment_id, first_at: where a phrase (an array of tokens) first stands as a run in a segment (tokens) of its source, counted from 1.

    They meet at the whole run: every segment is read once for each length that its source's phrases have, and equal phrases and
    runs come together once, so the join makes no row that is not a result.
    """
    p = phrases.where(F.size("phrase") > 0).select("source_id", "phrase_id", "phrase")
    lengths = p.groupBy("source_id").agg(F.collect_set(F.size("phrase")).alias("lengths"))
    runs = F.expr("transform(sequence(1, size(tokens) - n + 1), i -> struct(slice(tokens, i, n) as phrase, i as first_at))")
    t = segments.join(lengths, "source_id").withColumn("n", F.explode("lengths")).where("n <= size(tokens)").select("source_id", "segment_id", F.explode(runs).alias("r"))
    first = t.groupBy("source_id", "segment_id", "r.phrase").agg(F.min("r.first_at").alias("first_at"))
    return first.join(p, ["source_id", "phrase"]).groupBy("phrase_id", "source_id", "segment_id").agg(F.min("first_at").alias("first_at"))


def caption_alignment(words: DataFrame, segments: DataFrame) -> DataFrame:
    """Per segment whether its words, in order, are its text's tokens, lie inside it and don't overlap."""
    w = Window.partitionBy("source_id", "segment_id").orderBy("start_us", "word_id")
    per = words.withColumn("before", F.lag("end_us").over(w)).groupBy("source_id", "segment_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_us", "word_id", "word"))), lambda x: x["word"]), " ").alias("said"), F.min("start_us").alias("lo"), F.max("end_us").alias("hi"), F.coalesce(F.bool_and(F.col("before") <= F.col("start_us")), F.lit(True)).alias("ordered"))
    s = segments.join(per, ["source_id", "segment_id"], "left")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    ok = (F.col("said") == text) & F.col("ordered") & (F.col("lo") >= F.col("start_us")) & (F.col("hi") <= F.col("end_us"))
    return s.select("source_id", "segment_id", F.coalesce(ok, F.lit(False)).alias("aligned"))


