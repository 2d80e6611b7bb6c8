"""Edges of clips: each is widened to what it refers to, its story, its questions and its last sentence, checked against what lies between, and put back if a check fails.

Segments of a source have places in order of time. All proposals of a clip are places, and what a range of places holds - selling, changes of subject,
pauses - is the difference of two running counts, so no range is expanded. Unsafe widenings stay visible as the proposal; the clip then keeps its own edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sql_pattern
from .commercial import classification, folded
from .intervals import SECOND, interval_join
from .lineage import cut

# Openings that refer back or say nothing, endings that hang, a change of subject, words that were not understood.
REFERS = r"^(?:ele|ela|eles|elas|isso|aquilo|esse|essa|mas|porque|entao|ai)\b"
CONTINUES = r"^(?:ele|ela|eles|elas|isso|aquilo|esse|essa|mas|porque|entao|ai|e)\b"
PREAMBLE = r"^(?:bom[,.]|assim[,.]|quer dizer|tipo assim|tudo bem|tudo bacana|tudo certo)\b"
HANGS = r"\b(?:e|mas|porque|que|entao)[.!?]*$"
CHANGE = r"\b(?:mudando de assunto|outro assunto|agora vamos falar)\b"
UNHEARD = r"\b(?:inaudivel|ininteligivel)\b"
DONE, TRAILS = r"[.?!]$", r"(?:\.\.\.|…)$"


def edge_quality(segments: DataFrame) -> DataFrame:
    """segments with pos and, of each segment, opening and ending: reasons why a clip can't begin or end there (none: clean).

    The segment before is the last of the three before it that has ended when it begins. Ties of times go by id; positions begin at 1.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    low = folded(text)
    s = segments.withColumn("low", low).withColumn("mute", text == "").withColumn("done", text.rlike(sql_pattern(DONE))).withColumn("whole", text.rlike(sql_pattern(DONE)) & ~text.rlike(sql_pattern(TRAILS)) & ~low.rlike(sql_pattern(HANGS)))
    flags = s.select("source_id", "segment_id", "start_us", "end_us", "speaker", "mute", "done", "whole", F.col("low").rlike(sql_pattern(CONTINUES)).alias("continues"), F.col("low").rlike(sql_pattern(PREAMBLE)).alias("preamble"), F.col("low").rlike(sql_pattern(REFERS)).alias("refers"), F.col("low").rlike(sql_pattern(CHANGE)).alias("change"), F.col("low").rlike(sql_pattern(UNHEARD)).alias("unheard"), (classification(F.col("text"))["eligibility"] == "excluded").alias("ad"))
    w = Window.partitionBy("source_id").orderBy("start_us", "end_us", "segment_id")
    before = [F.lag(F.struct("end_us", "speaker", "done"), k).over(w) for k in (1, 2, 3)]
    flags = flags.withColumns({"pos": F.row_number().over(w), "gap": F.col("start_us") - F.lag("end_us").over(w), **{f"b{k}": b for k, b in enumerate(before)}})
    ended = F.coalesce(*(F.when(F.col(f"b{k}.end_us") <= F.col("start_us"), F.col(f"b{k}")) for k in range(3)))
    middle = ended["speaker"].eqNullSafe(F.col("speaker")) & (F.col("start_us") - ended["end_us"] < SECOND) & ~ended["done"]
    opening = [F.when(F.col("mute"), "missing_text"), F.when(F.col("continues"), "missing_antecedent_or_continuation"), F.when(F.col("preamble"), "generic_preamble"), F.when(ended.isNotNull() & middle, "mid_sentence")]
    ending = F.when(F.col("whole"), F.array().cast("array<string>")).otherwise(F.array(F.lit("incomplete_sentence_or_handoff")))
    return flags.withColumn("opening", F.array_compact(F.array(*opening))).withColumn("ending", ending).drop("b0", "b1", "b2")


def _counted(places: DataFrame, gap_us: int) -> DataFrame:
    """Running counts of selling, changes of subject and pauses, each place included."""
    w = Window.partitionBy("source_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w)
    return places.withColumns({"n_ad": count(F.col("ad")), "n_change": count(F.col("change")), "n_gap": count(F.col("gap") > gap_us)})


def optimize_boundaries(moments: DataFrame, segments: DataFrame, stories: DataFrame, questions: DataFrame, reach_us: int = 30 * SECOND, near_us: int = 40 * SECOND, share: float = 0.25, gap_us: int = 5 * SECOND, least_us: int = 8 * SECOND, most_us: int = 180 * SECOND) -> DataFrame:
    """source_id, moment_id, start_us, end_us, proposed_start_us, proposed_end_us, decision (expand, cut, pending), risks, blockers, clean_opening, clean_ending, segment_ids, question_ids, added_before_us, added_after_us.

    moments: source_id, moment_id, start_us, end_us, segment_ids, context (required, helpful, none, unresolved), topic_start_us, topic_end_us (null: no topic). Without known
    segments those that it overlaps are its own; without any it stays pending. segments: source_id, segment_id, start_us, end_us, text, speaker. stories: source_id, moment_id,
    story_start_us, story_end_us, supported. questions: source_id, question_id, question_start_us, question_end_us, answer_start_us, answer_end_us, complete, segment_ids. Humour is humor_bounds' matter.
    """
    places = cut(_counted(edge_quality(segments.where("source_id is not null and segment_id is not null and end_us > start_us")), gap_us))
    none = F.array().cast("array<string>")
    key = ["source_id", "moment_id"]
    named = moments.select(*key, F.explode("segment_ids").alias("segment_id")).join(places.select("source_id", "segment_id", "pos"), ["source_id", "segment_id"]).groupBy(*key).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    met = interval_join(moments.select(*key, "start_us", "end_us"), places.select("source_id", "start_us", "end_us", "pos")).groupBy(*key).agg(F.min("b_pos").alias("o1"), F.max("b_pos").alias("o2"))
    m = moments.join(named, key, "left").join(met, key, "left").withColumn("first", F.coalesce("first", "o1")).withColumn("last", F.coalesce("last", "o2")).drop("o1", "o2")

    def at(df: DataFrame, pos: Column, mark: str, *columns: str) -> DataFrame:
        p = places.select(F.col("source_id").alias("_s"), F.col("pos").alias("_p"), *(F.col(c).alias(f"{mark}_{c}") for c in columns))
        return df.join(p, (F.col("source_id") == F.col("_s")) & (pos == F.col("_p")), "left").drop("_s", "_p")

    m = at(m, F.col("first"), "f", "start_us", "refers")
    m = at(at(m, F.col("last"), "l", "end_us"), F.col("first") - 1, "b", "start_us")
    m = cut(m.withColumnsRenamed({"f_start_us": "core_start", "l_end_us": "core_end"}))
    back = (F.col("f_refers") | F.col("context").isin("required", "helpful")) & (F.col("core_start") - F.col("b_start_us") <= reach_us)
    # a supported story that holds the core and is short enough
    held = m.select(*key, "core_start", "core_end").join(stories.where("supported"), key).where((F.col("story_start_us") <= F.col("core_start")) & (F.col("core_end") <= F.col("story_end_us")) & (F.col("story_end_us") - F.col("story_start_us") <= most_us))
    held = held.select(*key, F.col("story_start_us").alias("start_us"), F.col("story_end_us").alias("end_us"))
    told = interval_join(held, places.select("source_id", "start_us", "end_us", "pos")).where("b_start_us >= start_us and b_end_us <= end_us").groupBy(*key).agg(F.min("b_pos").alias("s1"), F.max("b_pos").alias("s2"))
    # whole questions whose answer makes up a good part of the core, or that are asked in it
    ids = F.array_distinct(F.coalesce("segment_ids", none))
    q = questions.where("complete and answer_start_us is not null and question_start_us is not null").select("source_id", "question_id", "question_start_us", F.coalesce("question_end_us", "question_start_us").alias("question_end_us"), "answer_start_us", "answer_end_us", ids.alias("ids"))
    spots = q.select("source_id", "question_id", F.size("ids").alias("n"), F.explode("ids").alias("segment_id")).join(places.select("source_id", "segment_id", "pos"), ["source_id", "segment_id"]).groupBy("source_id", "question_id", "n").agg(F.min("pos").alias("q1"), F.max("pos").alias("q2"), F.count(F.lit(1)).alias("found")).where("found = n").drop("n", "found")
    # they begin within near_us of the core's start, which joins them by time
    point = q.join(spots, ["source_id", "question_id"]).withColumn("start_us", F.col("question_start_us")).withColumn("end_us", F.col("question_start_us") + 1).drop("ids")
    around = m.where("first is not null").select(*key, "core_start", "core_end", (F.col("core_start") - near_us).alias("start_us"), (F.col("core_start") + near_us + 1).alias("end_us"))
    j = interval_join(around, point)
    relevant = F.greatest(F.lit(0), F.least("core_end", "b_answer_end_us") - F.greatest("core_start", "b_answer_start_us")) >= share * F.greatest(F.col("core_end") - F.col("core_start"), F.lit(1))
    asked = (F.col("b_question_start_us") < F.col("core_end")) & (F.col("core_start") < F.col("b_question_end_us"))
    pairs = j.where(F.coalesce(relevant, F.lit(False)) | asked).groupBy(*key).agg(F.min("b_q1").alias("q1"), F.max("b_q2").alias("q2"), F.array_sort(F.collect_set("b_question_id")).alias("question_ids"))
    m = m.join(told, key, "left").join(pairs, key, "left")
    m = m.withColumn("p1", F.least(F.when(back, F.col("first") - 1).otherwise(F.col("first")), F.col("s1"), F.col("q1"))).withColumn("p2", F.greatest("last", "s2", "q2"))
    m = at(at(m, F.col("p2"), "e", "done"), F.col("p2") + 1, "n", "end_us")
    m = m.withColumn("p2", F.when(~F.col("e_done") & (F.col("n_end_us") - F.col("core_end") <= reach_us), F.col("p2") + 1).otherwise(F.col("p2")))
    m = at(at(m, F.col("p1"), "x", "start_us", "ad", "n_ad", "n_change", "n_gap"), F.col("p2"), "y", "end_us", "n_ad", "n_change", "n_gap")
    more = lambda c: F.col(f"y_{c}") > F.col(f"x_{c}")
    rules = [
        ((F.col("x_start_us") < F.col("topic_start_us")) | (F.col("y_end_us") > F.col("topic_end_us")), "topic_boundary_crossed"),
        (more("n_ad") | F.col("x_ad"), "commercial_boundary_crossed"),
        (more("n_change"), "explicit_topic_transition_crossed"),
        (more("n_gap"), "context_gap_requires_review"),
        (F.col("y_end_us") - F.col("x_start_us") > most_us, "duration_budget_exceeded"),
        ((F.col("x_start_us") > F.col("start_us")) | (F.col("y_end_us") < F.col("end_us")), "source_ids_do_not_cover_original"),
    ]
    m = m.withColumn("risks", F.array_sort(F.array_compact(F.array(*(F.when(c, w) for c, w in rules)))))
    safe = (F.size("risks") == 0) & F.col("first").isNotNull()
    m = m.withColumnsRenamed({"start_us": "own_start", "end_us": "own_end"}).withColumn("start_us", F.when(safe, F.col("x_start_us")).otherwise(F.col("own_start"))).withColumn("end_us", F.when(safe, F.col("y_end_us")).otherwise(F.col("own_end")))
    m = cut(m.select(*key, "context", "first", "own_start", "own_end", "x_start_us", "y_end_us", "start_us", "end_us", "risks", F.when(safe, F.col("question_ids")).alias("question_ids")))
    chosen = interval_join(m.select(*key, "start_us", "end_us"), places.select("source_id", "segment_id", "pos", "start_us", "end_us", "mute", "unheard", "opening", "ending")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("b_pos", "b_segment_id", "b_start_us", "b_end_us", "b_mute", "b_unheard", "b_opening", "b_ending"))).alias("rows"))
    span = questions.withColumn("a", F.col("question_start_us")).withColumn("b", F.coalesce("answer_end_us", "question_end_us")).where("a is not null and b is not null").select("source_id", "a", "b", F.coalesce("complete", F.lit(False)).alias("whole"), F.col("a").alias("start_us"), F.col("b").alias("end_us"))
    torn = interval_join(m.select(*key, "start_us", "end_us"), span).groupBy(*key).agg(F.bool_or(F.col("b_a") < F.col("start_us")).alias("asked_before"), F.bool_or((F.col("b_b") > F.col("end_us")) | ~F.col("b_whole")).alias("answered_after"))
    m = m.join(chosen, key, "left").join(torn, key, "left")

    def edge(row: Column, side: str, truncated: Column, torn_by: Column, word: str) -> Column:
        base = F.when(row.isNull(), F.array(F.lit("missing_text"))).when(row["b_unheard"], F.array(F.lit("asr_text_unresolved"))).when(row["b_mute"], F.array(F.lit("missing_text"))).when(truncated, F.array(F.lit("source_segment_truncated"))).otherwise(row[f"b_{side}"])
        return F.when(F.coalesce(torn_by, F.lit(False)), F.concat(base, F.array(F.lit(word)))).otherwise(base)

    head, tail = F.try_element_at("rows", F.lit(1)), F.try_element_at("rows", F.lit(-1))
    m = m.withColumn("opening", edge(head, "opening", head["b_start_us"] < F.col("start_us"), F.col("asked_before"), "question_before_clip")).withColumn("ending", edge(tail, "ending", tail["b_end_us"] > F.col("end_us"), F.col("answered_after"), "answer_or_payoff_unresolved"))
    # what can't be read is unknown unless a question says otherwise
    unread = lambda row: row.isNull() | row["b_unheard"] | row["b_mute"]
    clean = lambda side, row, torn_by: F.when(F.coalesce(torn_by, F.lit(False)), F.lit(False)).when(unread(row), F.lit(None)).otherwise(F.size(side) == 0)
    halves = F.coalesce(F.col("asked_before") | F.col("answered_after"), F.lit(False))
    late = [F.when(halves, "question_answer_unit_incomplete"), F.when(F.col("end_us") - F.col("start_us") < least_us, "below_hard_min_without_complete_unit_proof"), F.when(F.col("context").isin("required", "unresolved") & (F.col("start_us") >= F.col("own_start")), "context_requirement_unresolved")]
    blockers = F.when(F.col("first").isNull(), F.array(F.lit("missing_segment_evidence"))).otherwise(F.array_sort(F.array_distinct(F.concat("risks", "opening", "ending", F.array_compact(F.array(*late))))))
    m = m.withColumn("blockers", blockers)
    wider = (F.col("start_us") < F.col("own_start")) | (F.col("end_us") > F.col("own_end"))
    known = F.col("first").isNotNull()
    return m.select(
        *key, "start_us", "end_us", F.col("x_start_us").alias("proposed_start_us"), F.col("y_end_us").alias("proposed_end_us"), F.when(F.size("blockers") > 0, "pending").when(wider, "expand").otherwise("cut").alias("decision"), "risks", "blockers",
        F.when(known, clean("opening", head, F.col("asked_before"))).alias("clean_opening"), F.when(known, clean("ending", tail, F.col("answered_after"))).alias("clean_ending"), F.when(known, F.transform(F.coalesce("rows", F.array()), lambda r: r["b_segment_id"])).otherwise(none).alias("segment_ids"), F.coalesce("question_ids", none).alias("question_ids"),
        F.greatest(F.lit(0), F.col("own_start") - F.col("start_us")).alias("added_before_us"), F.greatest(F.lit(0), F.col("end_us") - F.col("own_end")).alias("added_after_us"),
    )
