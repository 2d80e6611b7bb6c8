"""Recovery of stories that a topic's parts do not show: action, conflict and outcome of one voice, read forward from every action.

Nothing is gathered by source. Segments go to time buckets with a halo as long as a story may be, an action meets what follows it in its bucket,
and that stretch, bounded by time, is read by one fold. Cues only propose; what is missing is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sql_pattern
from .commercial import classification, folded
from .intervals import SECOND
from .story import ACTION, CONFLICT, TOPIC_SHIFT, event_terms, literal_outcome

# Ends of an event and of a trouble, words of recordings and how their outcome is told.
CLOSING = r"^(?:quando terminou|quando acabou|ao terminar)\b"
APPLAUSE = r"\b(?:aplaudindo|aplaudiram)\b"
RESOLUTION = r"^(?:no final|no fim) (?:eu )?consegui resolver(?: tudo| e deu certo)?[.!]*$"
RECORDED = r"^(?:no final|no fim) deu certo\b"
MUSIC = ("banda", "gravadora", "disco", "album", "musicos", "estudio")


def _prepared(segments: DataFrame) -> DataFrame:
    low = folded(F.col("text"))
    s = segments.withColumn("low", low)
    terms = event_terms(F.col("low"))
    return s.select("source_id", "segment_id", "start_us", "end_us", "speaker", F.coalesce("topic_ids", F.array().cast("array<string>")).alias("topics"), F.coalesce("text", F.lit("")).alias("text"), "low", F.col("low").rlike(sql_pattern(ACTION)).alias("acts"), F.col("low").rlike(sql_pattern(CONFLICT)).alias("conflicts"), F.col("low").rlike(sql_pattern(TOPIC_SHIFT)).alias("shifts"), literal_outcome(F.col("low")).alias("outcome"), terms.alias("terms"))


_ROW = ("start_us", "end_us", "segment_id", "speaker", "topics", "text", "low", "acts", "conflicts", "shifts", "outcome", "terms")


def _opening(width: int, gap_us: int, within_us: int) -> Column:
    """Of a row and the next three: how many of them open the story together."""
    rows = F.array(*(F.col(f"r{k}") for k in range(4)))
    zero = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.lit(None).cast("long").alias("to"))

    def step(a, r):
        fits = a["open"] & r["segment_id"].isNotNull() & r["speaker"].eqNullSafe(F.col("r0.speaker")) & (r["start_us"] < F.col("r0.start_us") + within_us) & ~r["shifts"]
        fits = fits & (a["to"].isNull() | ((r["start_us"] - a["to"] <= gap_us) & ~r["conflicts"]))
        fits = F.coalesce(fits, F.lit(False))
        return F.struct((a["n"] + fits.cast("int")).alias("n"), fits.alias("open"), F.when(fits, r["end_us"]).otherwise(a["to"]).alias("to"))

    return F.aggregate(rows, zero, step, lambda a: a["n"])


def _continues(r: Column, told: Column, trouble: Column) -> Column:
    """Whether an outcome takes up what the same voice has told: a shared word, the event's end, a solved trouble, a recording."""
    music = F.array(*map(F.lit, MUSIC))
    low = F.trim(r["low"])
    recorded = (F.size(F.array_intersect(told, music)) >= 2) & F.arrays_overlap(r["terms"], music) & r["low"].rlike(sql_pattern(RECORDED)) & trouble
    return F.arrays_overlap(r["terms"], told) | (r["low"].rlike(sql_pattern(CLOSING)) & r["low"].rlike(sql_pattern(APPLAUSE))) | (low.rlike(sql_pattern(RESOLUTION)) & trouble) | recorded


def _read(opening: Column, longest_us: int, gap_us: int, interruption_us: int) -> Column:
    """Reads `rows` forward from the action: n rows taken, why it stopped, places of conflict and outcome."""
    first = F.col("rows")[0]
    text = F.array().cast("array<string>")
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("stop"), F.lit(None).cast("long").alias("to"), first["topics"].alias("topics"), text.alias("told"), F.lit(False).alias("trouble"), F.lit(False).alias("acted"), F.lit(None).cast("int").alias("conflict"), F.lit(None).cast("long").alias("conflict_us"), F.lit(None).cast("int").alias("payoff"))

    def step(a, r):
        own = r["speaker"] == first["speaker"]
        jump = (a["n"] > 0) & (F.size(r["topics"]) > 0) & (F.size(a["topics"]) > 0) & ~F.arrays_overlap(r["topics"], a["topics"]) & ~F.arrays_overlap(r["terms"], a["told"])
        before = F.when(r["end_us"] - first["start_us"] > longest_us, "story_time_window_exhausted").when(r["start_us"] - a["to"] > gap_us, "story_pause_exceeds_window").when(r["shifts"], "topic_change_observed").when(jump, "cross_chunk_continuity_unresolved")
        before = before.when(r["speaker"].isNull(), "missing_speaker_evidence").when(~own & (r["end_us"] - r["start_us"] > interruption_us), "long_speaker_interruption")
        place = a["n"] + 1
        acted = a["acted"] | (own & r["acts"])
        found = own & a["conflict"].isNull() & r["conflicts"] & (r["start_us"] > F.col("opened_us"))
        conflict_us = F.when(found, r["start_us"]).otherwise(a["conflict_us"])
        told_out = F.coalesce(own & (r["start_us"] > conflict_us) & r["outcome"] & acted, F.lit(False))
        good = F.coalesce(_continues(r, a["told"], a["trouble"]), F.lit(False))
        taken = F.struct(
            place.alias("n"),
            F.when(told_out, F.when(good, "outcome").otherwise("outcome_continuity_unresolved")).alias("stop"),
            r["end_us"].alias("to"),
            F.when(F.size(r["topics"]) > 0, r["topics"]).otherwise(a["topics"]).alias("topics"),
            F.when(own, F.array_union(a["told"], r["terms"])).otherwise(a["told"]).alias("told"),
            (a["trouble"] | (own & r["conflicts"])).alias("trouble"),
            acted.alias("acted"),
            F.when(found, place).otherwise(a["conflict"]).alias("conflict"),
            conflict_us.alias("conflict_us"),
            F.when(told_out & good, place).otherwise(a["payoff"]).alias("payoff"),
        )
        halted = F.struct(a["n"], before.alias("stop"), a["to"], a["topics"], a["told"], a["trouble"], a["acted"], a["conflict"], a["conflict_us"], a["payoff"])
        return F.when(a["stop"].isNotNull(), a).when(before.isNotNull(), halted).otherwise(taken)

    return F.aggregate("rows", zero, step)


def recover_arcs(segments: DataFrame, longest_us: int = 360 * SECOND, gap_us: int = 15 * SECOND, interruption_us: int = 12 * SECOND, shortest_us: int = 8 * SECOND, share: float = 0.7, opening_us: int = 6 * SECOND, bucket_us: int = 600 * SECOND) -> DataFrame:
    """source_id, arc_no, kind, start_us, end_us, topic_id, segment_ids, setup_ids, conflict_id, development_ids, payoff_id, interruption_ids, stop_reason of each story found.

    segments: source_id, segment_id, start_us, end_us, speaker, text, topic_ids. An arc inside an earlier one of its source is left out, as is selling.
    Rows without a source or times are passed over; null texts and topics count as empty; ties of times go by id.
    """
    s = _prepared(segments.where("source_id is not null and start_us is not null and end_us is not null"))
    last = s.groupBy("source_id").agg(F.max(F.struct("start_us", "end_us", "segment_id")).alias("last"))
    b = F.floor(F.col("start_us") / bucket_us)
    # a segment is its bucket's own, and the halo of those before it that can still reach it
    reach = F.greatest(b - (longest_us + bucket_us - 1) // bucket_us, F.floor((F.col("start_us") - longest_us - opening_us) / bucket_us))
    spread = s.withColumn("own", b).withColumn("bucket", F.explode(F.sequence(reach, b)))
    w = Window.partitionBy("source_id", "bucket").orderBy("start_us", "end_us", "segment_id")
    brief = F.struct("start_us", "end_us", "segment_id", "speaker", "low", "conflicts", "shifts")
    near = spread.select("*", brief.alias("r0"), *(F.lead(brief, k).over(w).alias(f"r{k}") for k in (1, 2, 3)))
    a = near.where("own = bucket and speaker is not null").withColumn("opening", _opening(bucket_us, gap_us, opening_us))
    said = F.array_join(F.transform(F.slice(F.array(*(F.col(f"r{k}") for k in range(4))), F.lit(1), F.col("opening")), lambda r: r["low"]), " ")
    a = a.where((F.col("opening") > 0) & said.rlike(sql_pattern(ACTION))).select(F.col("source_id").alias("a_source"), F.col("bucket").alias("a_bucket"), F.struct("start_us", "end_us", "segment_id").alias("key"), "opening")
    after = F.struct("start_us", "end_us", "segment_id")
    j = a.join(spread.select("source_id", "bucket", F.struct(*_ROW).alias("r"), after.alias("at")), (F.col("a_source") == F.col("source_id")) & (F.col("a_bucket") == F.col("bucket")) & (F.col("at") >= F.col("key")) & (F.col("at.start_us") <= F.col("key.start_us") + longest_us))
    g = j.groupBy("source_id", "key", "opening").agg(F.array_sort(F.collect_list("r")).alias("rows")).join(last, "source_id")
    g = g.withColumn("opened_us", F.element_at("rows", F.col("opening"))["start_us"]).withColumn("x", _read(F.col("opening"), longest_us, gap_us, interruption_us))
    final = F.element_at("rows", -1)
    g = g.withColumn("stop", F.coalesce(F.col("x.stop"), F.when(F.struct(final["start_us"], final["end_us"], final["segment_id"]) < F.col("last"), "story_time_window_exhausted").otherwise("outcome_not_observed")))
    g = g.where("x.conflict is not null and x.n > 0").withColumn("window", F.slice("rows", F.lit(1), F.col("x.n")))
    voice, end = F.col("window")[0]["speaker"], F.element_at("window", -1)["end_us"]
    seconds = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda t, r: t + r["end_us"] - r["start_us"])
    own = F.filter("window", lambda r: r["speaker"] == voice)
    g = g.where((end - F.col("key.start_us") >= shortest_us) & (seconds(own) >= share * seconds(F.filter("window", lambda r: r["speaker"].isNotNull()))))
    g = g.where(classification(F.array_join(F.transform("window", lambda r: r["text"]), " "))["eligibility"] != "excluded")
    g = g.withColumn("end_us", end)
    earlier = Window.partitionBy("source_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("covered", F.max("end_us").over(earlier)).where("covered is null or covered < end_us")
    ids = lambda rows: F.transform(rows, lambda r: r["segment_id"])
    payoff = F.element_at("window", F.col("x.payoff"))["segment_id"]
    middle = F.filter("window", lambda r, i: (i >= F.col("opening")) & (r["speaker"] == voice) & (F.col("x.payoff").isNull() | (i + 1 != F.col("x.payoff"))))
    g = g.withColumn("development_ids", ids(middle)).withColumn("payoff_id", F.when(F.col("x.payoff").isNotNull(), payoff))
    complete = F.col("payoff_id").isNotNull() & (F.size("development_ids") > 0)
    return g.select(
        "source_id",
        (F.row_number().over(Window.partitionBy("source_id").orderBy("key")) - 1).alias("arc_no"),
        F.when(complete, "complete_story").otherwise("partial_story").alias("kind"),
        F.col("key.start_us").alias("start_us"),
        "end_us",
        F.try_element_at(F.array_sort(F.col("window")[0]["topics"]), F.lit(1)).alias("topic_id"),
        ids(F.col("window")).alias("segment_ids"),
        ids(F.slice("rows", F.lit(1), F.col("opening"))).alias("setup_ids"),
        F.element_at("window", F.col("x.conflict"))["segment_id"].alias("conflict_id"),
        "development_ids",
        "payoff_id",
        ids(F.filter("window", lambda r: r["speaker"] != voice)).alias("interruption_ids"),
        F.when(~complete, F.when(F.col("stop") == "outcome", "outcome_not_observed").otherwise(F.col("stop"))).alias("stop_reason"),
    )
