"""Stories and humour in speech: arcs, their support, resumptions, what a clip must hold.

Cues only propose; nothing here approves. Text is compared folded (lower case, no accents). A topic's segments, a clip's
neighbourhood and an arc's components are bounded, so each is one array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import qa_terms, sql_pattern
from .commercial import classification, folded
from .intervals import SECOND, interval_join

# Cues of a story's parts, what leaves an outcome open, words that carry no event, cues of humour.
SETUP = r"\b(?:quando|na epoca|um dia|comecou|aconteceu)\b"
TENSION = r"\b(?:mas|so que|porem|problema|dificuldade|errado|nao deu)\b"
ACTION = r"\b(?:eu (?:subi|fui|recebi|tentei|lembrei|falei|pensei|continuei|comecei|estava|tava)|me chamaram|me encontrava|na epoca|um dia|certa vez|quando eu|quando comecei|teve uma vez|aconteceu comigo|lembro que)\b"
CONFLICT = r"\b(?:mas|so que|problema|dificuldade|nao tenho saida|alternativas|saio correndo|sair correndo|humilhado|coracao vazio|mente perturbada|acovardado)\b"
OUTCOME = r"\b(?:aplaudindo|aplaudiram|consegui|deu certo|ganhou o campeonato|mente se apazigou|coracao.{0,30}cheio|agora.{0,50}confianca|sabe do que voce e capaz)\b"
OPEN_OUTCOME = r"\b(?:nao|nunca|talvez|quem sabe|se|sera|espero|tomara|conseguir|conseguiria)\b"
UNFINISHED = r"\b(?:e|mas|que|porque|para|com|o|a|um|uma)[^a-z0-9_]*$"
TOPIC_SHIFT = r"\b(?:mudando de assunto|outro assunto|agora sobre|vamos falar de)\b"
GENERIC = ("quando", "como", "para", "porque", "depois", "antes", "agora", "ainda", "muito", "tudo", "uma", "umas", "esse", "essa", "isso", "aquele", "aquela", "tinha", "tenho", "estava", "continuei", "consegui", "certo", "problema", "final", "resultado")
RESUMPTION = r"^(?:retomando|voltando (?:ao|a)|continuando (?:o|a)|como eu (?:estava|tava) (?:falando|dizendo))\b"
LAUGHTER = r"\[(?:risos?|gargalhadas?|laugh(?:ter|s)?)\]|\((?:risos?|gargalhadas?|laugh(?:ter|s)?)\)|\b(?:kkkk+|haha(?:ha)+|plateia ri|todos riem|gargalhadas?|risadas?)\b"
PUNCHLINE = r"\b(?:so que|mas ai|e no final|ai eu falei|e ele disse|e ela disse|pior que|ate que|adivinha|sabe o que aconteceu)\b"
TEASER = r"\b(?:adivinha|sabe o que aconteceu)\b"
HANGING = r"\b(?:que|e|mas|porque|quando|se|o|a|um|uma)[^a-z0-9_]*$"
INTERRUPT = r"\b(?:pera ai|calma ai|deixa eu falar|nao terminei|espera um pouco|interromp)\b"
JOKE_SETUP = r"\b(?:uma piada|contar uma piada|um dia|quando eu|eu fui|eu estava|era uma vez)\b"
ASR_GAP = r"\[(?:inaudivel|ininteligivel|unintelligible)\]|\bnao entendi (?:a frase|o que)\b"
SUBJECT_CHANGE = r"\b(?:mudando de assunto|outro assunto|agora vamos falar)\b"


def literal_outcome(low: Column) -> Column:
    """An affirmative outcome that no doubt, question or loose end leaves open."""
    return low.rlike(sql_pattern(OUTCOME)) & ~low.rlike(sql_pattern(OPEN_OUTCOME)) & ~low.contains("?") & ~low.rlike(sql_pattern(UNFINISHED))


def event_terms(low: Column) -> Column:
    """The words of four letters or more that carry an event."""
    generic = F.array(*map(F.lit, GENERIC))
    return F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~F.array_contains(generic, w)))


def _first(rows: Column, cond) -> Column:
    return F.try_element_at(F.filter(rows, cond), F.lit(1))


def story_arcs(segments: DataFrame, qas: DataFrame, longest_us: int = 360 * SECOND, gap_us: int = 15 * SECOND, interruption_us: int = 12 * SECOND, shortest_us: int = 8 * SECOND) -> DataFrame:
    """One arc for each topic of three segments or more: kind, its parts' ids, start, end and score.

    Setup, conflict and outcome are the first of their kind in this order. They make a complete story if the setup acts, one
    voice tells all three, the outcome takes up its words, nothing changes the topic between and there is a development;
    else a question with its answer, a part of a story, an anecdote or a discussion. Selling is left out.
    segments: source_id, topic_id, segment_id, start_us, end_us, speaker, text. qas: source_id, question_start_us, answer_end_us, answer_segment_id.
    """
    low = folded(F.col("text"))
    s = segments.withColumn("low", low)
    row = F.struct("start_us", "segment_id", "end_us", "speaker", "text", F.col("low").rlike(sql_pattern(SETUP)).alias("is_setup"), F.col("low").rlike(sql_pattern(TENSION)).alias("is_tension"), literal_outcome(F.col("low")).alias("is_outcome"), F.col("low").rlike(sql_pattern(ACTION)).alias("acts"), F.col("low").rlike(sql_pattern(TOPIC_SHIFT)).alias("shifts"), event_terms(F.col("low")).alias("terms"))
    t = s.groupBy("source_id", "topic_id").agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") >= 3)
    t = t.withColumn("from_us", F.col("rows")[0]["start_us"]).withColumn("to_us", F.array_max(F.transform("rows", lambda x: x["end_us"])))
    q = qas.select("source_id", F.col("question_start_us").alias("q"), F.col("answer_end_us").alias("a"), "answer_segment_id")
    pairs = t.select("source_id", "topic_id", F.col("from_us").alias("start_us"), F.col("to_us").alias("end_us"))
    inside = interval_join(pairs, q.select("source_id", F.col("q").alias("start_us"), F.col("a").alias("end_us"), "answer_segment_id")).where("start_us <= b_start_us and b_end_us <= end_us")
    answered = inside.groupBy("source_id", "topic_id").agg(F.min_by("b_answer_segment_id", F.struct("b_start_us", "b_answer_segment_id")).alias("answer_id"))
    t = t.join(answered, ["source_id", "topic_id"], "left")
    t = t.withColumn("setup", _first(F.col("rows"), lambda x: x["is_setup"]))
    t = t.withColumn("conflict", _first(F.col("rows"), lambda x: x["is_tension"] & (x["start_us"] > F.col("setup.start_us"))))
    t = t.withColumn("payoff", _first(F.col("rows"), lambda x: x["is_outcome"] & (x["start_us"] > F.col("conflict.start_us"))))
    span = F.filter("rows", lambda x: (x["start_us"] >= F.col("setup.start_us")) & (x["start_us"] <= F.col("payoff.start_us")))
    t = t.withColumn("span", span)
    voice = F.col("setup.speaker")
    told = F.flatten(F.transform(F.filter("span", lambda x: (x["start_us"] < F.col("payoff.start_us")) & (x["speaker"] == voice)), lambda x: x["terms"]))
    close = F.forall(F.sequence(F.lit(1), F.greatest(F.size("span") - 1, F.lit(1))), lambda k: (k >= F.size("span")) | (F.try_element_at("span", k + 1)["start_us"] - F.try_element_at("span", k)["end_us"] <= gap_us))
    steady = F.forall("span", lambda x: x["speaker"].isNotNull() & ((x["speaker"] == voice) | (x["end_us"] - x["start_us"] <= interruption_us)) & ~x["shifts"])
    marked = F.col("payoff").isNotNull() & F.col("setup.acts") & voice.isNotNull() & (F.col("conflict.speaker") == voice) & (F.col("payoff.speaker") == voice) & F.arrays_overlap(F.col("payoff.terms"), told) & (F.col("payoff.end_us") - F.col("setup.start_us") <= longest_us) & close & steady
    t = t.withColumn("marked", F.coalesce(marked, F.lit(False)))
    answer = F.col("answer_id").isNotNull()
    kind = F.when(F.col("marked"), "complete_story").when(answer, "qa_arc").when(F.col("conflict").isNotNull(), "partial_story").when(F.col("setup").isNotNull(), "anecdote").otherwise("discussion_segment")
    t = t.withColumn("kind", kind)
    bare = F.col("kind").isin("discussion_segment", "qa_arc")
    t = t.withColumn("setup", F.when(~bare, F.col("setup"))).withColumn("conflict", F.when(~bare, F.col("conflict")))
    # the outcome of a story, or the answer of a question
    reply = F.when(answer, _first(F.col("rows"), lambda x: x["segment_id"] == F.col("answer_id")))
    t = t.withColumn("payoff", F.when(F.col("marked"), F.col("payoff")).otherwise(reply))
    middle = F.filter("rows", lambda x: (x["start_us"] >= F.col("setup.end_us")) & (F.col("payoff").isNull() | (x["end_us"] <= F.col("payoff.start_us"))) & x["speaker"].eqNullSafe(F.col("setup.speaker")))
    t = t.withColumn("middle", F.when(F.col("setup").isNotNull(), middle).otherwise(F.slice("rows", 1, 0)))
    hollow = F.col("marked") & (F.size("middle") == 0)
    t = t.withColumn("kind", F.when(hollow, "partial_story").otherwise(F.col("kind"))).withColumn("marked", F.col("marked") & ~hollow)
    t = t.withColumn("ending", F.element_at("rows", -1)).withColumn("start_us", F.coalesce("setup.start_us", "from_us")).where(F.col("ending.end_us") - F.col("start_us") >= shortest_us)
    t = t.withColumn("ad", classification(F.array_join(F.transform("rows", lambda x: x["text"]), " "))["eligibility"]).where("ad <> 'excluded'")
    done = F.rtrim(F.col("ending.text")).rlike(sql_pattern(r"[.?!]$"))
    between = F.size(F.filter(F.slice("rows", 2, F.greatest(F.size("rows") - 2, F.lit(0))), lambda x: F.col("payoff").isNull() | (x["start_us"] < F.col("payoff.start_us")))) > 0
    developed = F.when(answer & ~F.col("marked"), between).otherwise(F.size("middle") > 0)
    score = F.when(F.col("marked") | answer, F.round(F.least(F.lit(1.0), 0.55 + 0.1 * F.col("setup").isNotNull().cast("int") + 0.15 * developed.cast("int") + 0.15 * done.cast("int")), 6))
    return t.select("source_id", "topic_id", "kind", "start_us", F.col("ending.end_us").alias("end_us"), F.col("setup.segment_id").alias("setup_id"), F.col("conflict.segment_id").alias("conflict_id"), F.col("payoff.segment_id").alias("payoff_id"), F.array_join(F.transform("middle", lambda x: x["segment_id"]), ",").alias("middle_ids"), F.col("ending.segment_id").alias("ending_id"), score.alias("score"))


def arc_resumptions(arcs: DataFrame, segments: DataFrame, most_segments: int = 256, most_us: int = 600 * SECOND, k: int = 2) -> DataFrame:
    """arc_id, segment_id, shared: up to k later segments of the arc's voice that say so and share two terms or more.

    arcs: source_id, arc_id, speaker, terms, last_pos, last_end_us. segments: source_id, segment_id, pos, start_us, end_us, speaker, text.
    Only segments that take the thread up meet arcs, by source and voice. An overlap of neighbours ends the search.
    """
    w = Window.partitionBy("source_id").orderBy("pos")
    low = folded(F.col("text"))
    s = segments.withColumn("broken", F.when(F.col("start_us") < F.lag("end_us").over(w), F.col("pos")))
    s = s.withColumn("broken", F.coalesce(F.max("broken").over(w), F.lit(-1))).where(low.rlike(sql_pattern(RESUMPTION)) & ~low.rlike(sql_pattern(TOPIC_SHIFT)))
    s = s.select("source_id", "segment_id", "pos", "end_us", "speaker", "broken", qa_terms(F.col("text")).alias("own"))
    j = arcs.join(s, ["source_id", "speaker"]).where((F.col("pos") > F.col("last_pos")) & (F.col("pos") <= F.col("last_pos") + most_segments) & (F.col("end_us") - F.col("last_end_us") <= most_us) & (F.col("broken") <= F.col("last_pos")))
    j = j.withColumn("shared", F.array_sort(F.array_intersect("terms", "own"))).where(F.size("shared") >= 2)
    first = Window.partitionBy("source_id", "arc_id").orderBy("pos")
    return j.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("source_id", "arc_id", "segment_id", "rank", "shared")


def story_support(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """source_id, arc_id, reasons (what support is missing), conflicts (neighbours that overlap or are reversed), supported.

    arcs: source_id, arc_id, setup, development, payoff, evidence (arrays of segment ids).
    """
    keys = ("setup", "development", "payoff")
    named = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(i).alias("turn"), F.col(k).alias("ids")) for i, k in enumerate(keys)))
    parts = arcs.select("source_id", "arc_id", F.explode(named).alias("p")).select("source_id", "arc_id", "p.key", "p.turn", F.posexplode_outer("p.ids").alias("k", "segment_id"))
    s = segments.select("source_id", "segment_id", "start_us", "end_us", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("worded"), F.lit(True).alias("known"))
    j = parts.join(s, ["source_id", "segment_id"], "left")
    seen = Window.partitionBy("source_id", "arc_id", "segment_id").orderBy("turn", "k")
    order = Window.partitionBy("source_id", "arc_id").orderBy("turn", "k")
    first = F.col("known") & (F.row_number().over(seen) == 1)
    j = j.withColumn("at", F.when(first, F.struct("start_us", "end_us"))).withColumn("before", F.last(F.col("at.end_us"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    j = j.withColumn("clash", F.when(F.col("at.end_us") < F.col("at.start_us"), 1).otherwise(0) + F.when(F.col("at.start_us") < F.col("before"), 1).otherwise(0))
    per = j.groupBy("source_id", "arc_id", "key").agg(F.count("segment_id").alias("n"), F.count_if(F.col("segment_id").isNotNull() & F.col("known").isNull()).alias("lost"), F.count_if(F.col("known") & ~F.col("worded")).alias("mute"), F.sum("clash").alias("clashes"), F.min("start_us").alias("lo"), F.max("start_us").alias("hi"))
    wide = per.groupBy("source_id", "arc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "lost", "mute", "lo", "hi")))).alias("of"), F.sum("clashes").alias("conflicts"))
    e = arcs.select("source_id", "arc_id", F.explode_outer("evidence").alias("segment_id")).join(s.select("source_id", "segment_id", "known"), ["source_id", "segment_id"], "left").groupBy("source_id", "arc_id").agg((F.count("segment_id") == 0).alias("none"), F.count_if(F.col("segment_id").isNotNull() & F.col("known").isNull()).alias("dangling"))
    j = wide.join(e, ["source_id", "arc_id"])
    of = lambda k: F.col("of")[k]
    ordered = F.coalesce((of("setup")["hi"] < of("development")["lo"]) & (of("development")["hi"] < of("payoff")["lo"]), F.lit(False))
    each = [F.when(of(k)["n"] == 0, f"no_{k}").when(of(k)["lost"] > 0, f"missing_{k}_reference").when(of(k)["mute"] > 0, f"unavailable_{k}_source_text") for k in keys]
    whole = reduce(lambda a, b: a & b, [of(k)["n"] > 0 for k in keys])
    more = [F.when(F.col("none") | (F.col("dangling") > 0), "missing_arc_reference"), F.when(F.col("conflicts") > 0, "canonical_interval_conflict"), F.when(whole & ~ordered, "components_not_ordered")]
    out = j.withColumn("reasons", F.array_compact(F.array(*each, *more)))
    return out.select("source_id", "arc_id", F.array_join("reasons", ",").alias("reasons"), "conflicts", (F.size("reasons") == 0).alias("supported"))


def narrative_integrity(clips: DataFrame) -> DataFrame:
    """Adds status and blockers of clips (selected ids) over their arc: kind, setup, development, payoff, ending, evidence (arrays). A clip that meets a story must hold all of its parts; a story without an outcome is not complete."""
    parts = ("setup", "development", "payoff")
    story = F.coalesce(F.col("kind").isin("complete_story", "partial_story", "anecdote"), F.lit(False)) & F.arrays_overlap("selected", "evidence")
    lost = lambda c: F.size(F.array_except(c, "selected")) > 0
    open_end = (F.col("kind") != "complete_story") | reduce(lambda a, b: a | b, [F.size(p) == 0 for p in parts])
    found = [F.when(open_end, "story_payoff_not_grounded"), *(F.when(lost(p), f"missing_story_{p}") for p in parts), F.when((F.col("kind") == "complete_story") & lost("ending"), "missing_story_ending")]
    out = clips.withColumn("blockers", F.when(F.coalesce(story, F.lit(False)), F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>")))
    return out.withColumn("status", F.when(~F.coalesce(story, F.lit(False)), "not_applicable").when(F.size("blockers") > 0, "incomplete").otherwise("complete_candidate"))


def humor_integrity(clips: DataFrame, segments: DataFrame, after_us: int = 16 * SECOND, before_us: int = 5 * SECOND) -> DataFrame:
    """source_id, clip_id, status, classification, blockers from laughter, punch lines, setups and interruptions inside a clip, right after and right before it. clips: source_id, clip_id, start_us, end_us, hinted."""
    low = folded(F.col("text"))
    s = segments.select("source_id", "start_us", "end_us", low.alias("low"))
    rest = F.regexp_replace(F.regexp_replace("low", sql_pattern(LAUGHTER), ""), sql_pattern(PUNCHLINE), "")
    payoff = F.col("low").rlike(sql_pattern(PUNCHLINE)) & ~F.col("low").rlike(sql_pattern(ASR_GAP)) & ~F.col("low").rlike(sql_pattern(TEASER)) & (F.regexp_count(rest, F.lit("[a-z0-9_]+")) >= 2) & ~F.col("low").rlike(sql_pattern(HANGING))
    spoken = F.regexp_replace(F.regexp_replace("low", sql_pattern(LAUGHTER), ""), sql_pattern(ASR_GAP), "").rlike("[a-z0-9_]")
    s = s.select("source_id", "start_us", "end_us", F.col("low").rlike(sql_pattern(LAUGHTER)).alias("laugh"), (spoken & F.col("low").rlike(sql_pattern(PUNCHLINE))).alias("punch"), payoff.alias("payoff"), F.col("low").rlike(sql_pattern(INTERRUPT)).alias("cut"), F.col("low").rlike(sql_pattern(JOKE_SETUP)).alias("setup"), F.col("low").rlike(sql_pattern(ASR_GAP)).alias("gap"))
    wide = clips.select("source_id", "clip_id", "hinted", F.col("start_us").alias("c0"), F.col("end_us").alias("c1"), (F.col("start_us") - before_us - 1).alias("start_us"), (F.col("end_us") + after_us + 1).alias("end_us"))
    j = interval_join(wide, s, "left")
    inside = (F.col("b_end_us") > F.col("c0")) & (F.col("b_start_us") < F.col("c1"))
    after = (F.col("b_start_us") >= F.col("c1")) & (F.col("b_start_us") <= F.col("c1") + after_us)
    before = (F.col("b_start_us") >= F.col("c0") - before_us) & (F.col("b_end_us") <= F.col("c0"))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = j.groupBy("source_id", "clip_id", "hinted").agg(some(inside & F.col("b_laugh")).alias("laughs"), some(after & F.col("b_laugh")).alias("laughs_after"), some(after & F.col("b_punch")).alias("punch_after"), some(inside & F.col("b_payoff")).alias("payoffs"), some(before & F.col("b_setup")).alias("setup_before"), some(inside & F.col("b_setup")).alias("setups"), some(inside & F.col("b_cut")).alias("cuts"), F.max(F.when(inside & F.col("b_cut"), F.col("b_start_us"))).alias("last_cut"), F.max(F.when(inside & F.col("b_payoff"), F.col("b_end_us"))).alias("last_payoff"), some(inside & ((F.col("b_start_us") < F.col("c0")) | (F.col("b_end_us") > F.col("c1")))).alias("truncated"), some(inside & F.col("b_gap")).alias("gaps"))
    probable = F.col("hinted") | F.col("laughs") | F.col("laughs_after")
    h = F.col("hinted")
    rules = [(probable & F.col("laughs_after"), "reaction_after_clip"), (probable & F.col("punch_after"), "potential_punchline_after_clip"), (h & ~F.col("payoffs"), "punchline_not_grounded"), (h & F.col("setup_before") & ~F.col("setups"), "setup_begins_before_clip"), (h & F.col("cuts") & ~F.col("payoffs"), "interruption_before_payoff"), (h & (F.col("last_cut") >= F.col("last_payoff")), "interruption_after_candidate_unresolved"), (probable & F.col("truncated"), "humor_source_segment_truncated"), (h & F.col("gaps"), "asr_phrase_unresolved")]
    g = g.withColumn("blockers", F.array_compact(F.array(*(F.when(c, F.lit(x)) for c, x in rules))))
    kind = F.when(F.col("gaps"), "asr_phrase_unresolved").when(F.col("payoffs") & h, "punchline_candidate").when(F.col("laughs"), "reaction_without_joke_evidence").when(h, "unresolved_humor").otherwise("not_applicable")
    status = F.when(F.size("blockers") > 0, "incomplete").when(F.col("laughs"), "observed_reaction").when(h, "unresolved").otherwise("not_applicable")
    return g.select("source_id", "clip_id", status.alias("status"), kind.alias("classification"), F.array_join("blockers", ",").alias("blockers"))


def humor_bounds(clips: DataFrame, segments: DataFrame, most_us: int = 5 * SECOND) -> DataFrame:
    """source_id, clip_id, proposed_start_us, proposed_end_us, unsafe: a clip widened to the setup before it and the punch line or laughter after it, within most_us.

    A change of subject, a gap above most_us or a segment that reaches beyond 0 or the source's end makes it unsafe; then the clip stays as it is.
    """
    low = folded(F.col("text"))
    s = segments.select("source_id", "segment_id", "start_us", "end_us", low.rlike(sql_pattern(JOKE_SETUP)).alias("setup"), (low.rlike(sql_pattern(PUNCHLINE)) | low.rlike(sql_pattern(LAUGHTER))).alias("laugh"), low.rlike(sql_pattern(SUBJECT_CHANGE)).alias("change"))
    end = segments.groupBy("source_id").agg(F.max("end_us").alias("upper"))
    c = clips.select("source_id", "clip_id", F.col("start_us").alias("c0"), F.col("end_us").alias("c1"), (F.col("start_us") - most_us - 1).alias("start_us"), (F.col("end_us") + most_us + 1).alias("end_us"))
    row = F.struct("b_start_us", "b_end_us", "b_segment_id", "b_setup", "b_laugh", "b_change")
    g = interval_join(c, s, "left").groupBy("source_id", "clip_id", "c0", "c1").agg(F.array_sort(F.collect_list(F.when(F.col("b_segment_id").isNotNull(), row))).alias("rows")).join(end, "source_id", "left")
    setup = F.filter("rows", lambda x: x["b_setup"] & (x["b_start_us"] >= F.greatest(F.col("c0") - most_us, F.lit(0))) & (x["b_end_us"] <= F.col("c0")))
    laugh = F.filter("rows", lambda x: x["b_laugh"] & (x["b_start_us"] >= F.col("c1")) & (x["b_end_us"] <= F.least(F.col("c1") + most_us, F.col("upper"))))
    g = g.withColumn("p0", F.coalesce(F.try_element_at(setup, F.lit(-1))["b_start_us"], F.col("c0"))).withColumn("p1", F.coalesce(F.try_element_at(laugh, F.lit(-1))["b_end_us"], F.col("c1")))
    g = g.withColumn("span", F.filter("rows", lambda x: (x["b_end_us"] > F.col("p0")) & (x["b_start_us"] < F.col("p1"))))
    gaps = F.exists(F.sequence(F.lit(1), F.greatest(F.size("span") - 1, F.lit(1))), lambda k: (k < F.size("span")) & (F.try_element_at("span", k + 1)["b_start_us"] - F.try_element_at("span", k)["b_end_us"] > most_us))
    outside = F.exists("span", lambda x: x["b_change"] | (x["b_start_us"] < 0) | (x["b_end_us"] > F.col("upper")))
    g = g.withColumn("unsafe", F.coalesce(gaps | outside, F.lit(False)))
    keep = lambda p, c: F.when(F.col("unsafe"), F.col(c)).otherwise(F.col(p))
    return g.select("source_id", "clip_id", keep("p0", "c0").alias("proposed_start_us"), keep("p1", "c1").alias("proposed_end_us"), "unsafe")
