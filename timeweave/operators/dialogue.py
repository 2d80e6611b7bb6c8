"""Questions with the answers that follow them, over several turns, and what the asker's own context or a listener's short reaction hides.

Nothing is gathered by source. A question meets the 33 rows that come after it in its time bucket, whose halo is as long as a question and its search
may be, and one native fold reads them. Cues only propose a link: a turn that merely comes next is no answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FAMILIES, sql_pattern
from .commercial import folded, let
from .intervals import SECOND
from .lineage import cut
from .review import question_kind
from .story import TOPIC_SHIFT

# Words that carry no topic, cues of answers and of remarks between, limits of a search.
GENERIC = (
    "nao ele ela era deixa temos tem tinha foi sao esta estamos voces voce gente entao assim "
    "aqui agora muito mais menos tudo coisa coisas fazer faz fazeram fazeria falar fala falando "
    "dizer disse vou vamos vai pode poderia porque quando como onde qual quem deles delas "
    "nossa nosso esse essa isso isto daquele aquela mesmo tambem ainda acho queria quero "
    "sobre entre pelo pela para cada sera estava estou teve seja hoje depois antes anos ano "
    "sempre nunca alguem algo bem sim sou meu minha nome meu me e o a os as de do da dos das "
    "em um uma uns umas com por ao aos sem que se ou no na nos nas eu tu nos ne ai so ha"
).split()
REACTION = r"^(?:serio|verdade|nossa|ah|ahn|hum|hmm|opa|hein|ta|ne|entendi|certo|ok|muito bom|que legal|conte|conta para nos)[.!? ,]*$"
CLARIFY = r"^(?:como assim|em que sentido|o que quer dizer)[? .!]*$"
MEANING = r"^(?:ou seja|quer dizer|voce quer dizer|quando voce diz|o que significa)\b"
EXTEND = r"^(?:e |ou melhor|quer dizer)"
TELL = r"^e como (?:resolveu|foi|aconteceu|fez)[? .!]*$"
RESUME = r"^(?:depois|em seguida|continuando|voltando|retomando|como eu dizia|mas ai|por isso)\b"
FRAGMENT = r"^(?:em|no|na|com|e|mas|para)\b"
HAND_OFF = r"^(?:retomando|continuando|como .{1,40} dizia)\b"
#: An answer's beginning, what the question must hold, and the cue's name; a polar answer needs a yes-or-no question or one of two words at most.
POLAR = r"^(?:sim|nao)\b"
REPLIES = ((r"^(?:porque|pois)\b", r"^(?:por que|porque)\b", "causal_response_cue"), (r"^(?:quando|no dia|em [0-9]|eu comecei)\b", r"^quando\b", "temporal_response_cue"), (r"^eu (?:estava|comecei|fiz|aprendi)\b", r"\b(?:aconteceu|carreira|resolveu)\b", "experience_response_cue"))
TINY = ("ahn", "ah", "hum", "hmm", "opa", "hein", "ta", "ne")
#: Reactions that may themselves be the answer to a yes-or-no question.
YES_LIKE = ("certo", "verdade", "ta", "ok", "entendi", "serio")
ROWS, LONGEST_US, ASK_PAUSE_US, ANSWER_PAUSE_US, RESUME_US = 32, 125 * SECOND, 10 * SECOND, 20 * SECOND, 40 * SECOND
PARTS, NEAR_US, REMARK_US, REMARK_WORDS, DRIFT_US = 5, 5 * SECOND, 12 * SECOND, 30, 7 * SECOND

_NONE = "array<string>"


def topic_terms(low: Column) -> tuple[Column, Column]:
    """Of folded text: distinct words of three characters or more that carry a topic; the same with inflections of a few verbs by their family's name."""
    plain = F.array_distinct(F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC)))
    family = lambda w: reduce(lambda c, f: c.when(w.rlike(sql_pattern(f[1])), f[0]), FAMILIES, F).otherwise(w)
    return plain, F.array_distinct(F.transform(plain, family))


def _prepared(segments: DataFrame) -> DataFrame:
    """source_id and r: what the fold asks of a row."""
    text = F.trim(F.coalesce("text", F.lit("")))
    s = segments.where("source_id is not null and segment_id is not null and start_us is not null and end_us is not null")
    s = s.select("source_id", "segment_id", "start_us", "end_us", F.when(F.col("speaker") != "", F.col("speaker")).alias("speaker"), text.alias("text"), F.trim(folded(text)).alias("low"))
    s = s.withColumn("kind", question_kind(F.col("low"))).withColumn("words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))
    plain, qa = topic_terms(F.col("low"))
    is_ = lambda p: F.col("low").rlike(sql_pattern(p))
    ends = lambda *x: reduce(Column.__or__, (F.col("text").endswith(e) for e in x))
    facts = {
        "plain": plain, "qa": qa, "asks": F.col("kind").isin("direct_question", "yes_no_question"), "marked": F.col("text").contains("?"), "firm": ends(".", "!"), "done": ends(".", "?", "!"), "trails": ends("...", "…"),
        "reacts": is_(REACTION), "clarifies": is_(CLARIFY), "means": is_(MEANING), "extends": is_(EXTEND), "tells": is_(TELL), "shifts": is_(TOPIC_SHIFT), "resumes": is_(RESUME), "joins": is_(FRAGMENT), "hands": is_(HAND_OFF), "polar": is_(POLAR),
        "replies": F.array(*(is_(p) for p, *_ in REPLIES)), "tiny": F.col("low").isin(*TINY) & (F.col("end_us") - F.col("start_us") <= 2_500_000),
    }
    s = s.withColumns(facts)
    return s.select("source_id", F.struct("start_us", "end_us", "segment_id", "speaker", "low", "kind", "words", *facts).alias("r"))


def _after(s: DataFrame, bucket_us: int) -> DataFrame:
    """Rows of s (source_id, r, pair) with a pair, each with `after`: the 33 rows that come next, and `more`: whether the source goes on behind them.

    A row that is not seen comes later than every search goes: it starts more than the longest pause after the search's end.
    """
    asked = s.where("pair is not null")
    span = F.greatest(F.col("r.end_us") - F.col("r.start_us"), F.lit(0))
    reach = asked.groupBy("source_id").agg((F.max(span) + LONGEST_US + ANSWER_PAUSE_US + 1).alias("reach"))
    last = s.groupBy("source_id").agg(F.max(F.struct("r.start_us", "r.end_us", "r.segment_id")).alias("last"))
    own = F.floor(F.col("r.start_us") / bucket_us)
    wide = s.join(reach, "source_id").withColumn("own", own)
    wide = wide.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("r.start_us") - F.col("reach")) / bucket_us), "own")))
    w = Window.partitionBy("source_id", "bucket").orderBy("r.start_us", "r.end_us", "r.segment_id", F.hash("r.low", "r.speaker"))
    placed = wide.withColumn("place", F.row_number().over(w)).withColumn("block", F.expr(f"place div {ROWS + 1}"))
    q = placed.where("own = bucket and pair is not null").select("source_id", "bucket", "place", "r", "pair")
    q = q.withColumn("block", F.explode(F.expr(f"array_distinct(array((place + 1) div {ROWS + 1}, (place + {ROWS + 1}) div {ROWS + 1}))")))
    n = placed.select("source_id", "bucket", "block", F.col("place").alias("at"), F.col("r").alias("next"))
    near = (F.col("at") > F.col("place")) & (F.col("at") <= F.col("place") + ROWS + 1)
    j = q.join(n.withColumnsRenamed({k: f"n_{k}" for k in ("source_id", "bucket", "block")}), (F.col("source_id") == F.col("n_source_id")) & (F.col("bucket") == F.col("n_bucket")) & (F.col("block") == F.col("n_block")) & near, "left")
    g = j.groupBy("source_id", "bucket", "place").agg(F.first("r").alias("q"), F.first("pair").alias("pair"), F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "next")))).alias("found"))
    g = g.join(last, "source_id").withColumn("after", F.transform("found", lambda x: x["next"]))
    end = F.coalesce(F.try_element_at("after", F.lit(-1)), F.col("q"))
    return g.select("source_id", "q", "pair", "after", (F.struct(end["start_us"], end["end_us"], end["segment_id"]) < F.col("last")).alias("more"))


def _remark(a: Column, r: Column) -> Column:
    """reaction_cue, clarification_cue or null: a short remark that belongs to neither question nor answer. a: what was said, `plain`."""
    return F.when(r["reacts"], "reaction_cue").when(r["clarifies"] | (r["asks"] & r["means"] & F.arrays_overlap(r["plain"], a)), "clarification_cue")


def _cue(r: Column, prompt: Column, words: Column) -> Column:
    """How a first answer takes up the question; null if nothing shows."""
    polar = r["polar"] & ((words <= 2) | (question_kind(prompt) == "yes_no_question"))
    return reduce(lambda c, k: c.when(r["replies"][k] & prompt.rlike(sql_pattern(REPLIES[k][1])), REPLIES[k][2]), range(len(REPLIES)), F.when(polar, "polar_response_cue"))


_STATE = {
    "stop": "string", "to": "long", "asked": "string", "asked_qa": _NONE, "asked_plain": _NONE, "asked_words": "int", "question_ids": _NONE, "question_end": "long", "context": "string", "context_qa": _NONE, "context_words": "int", "answer_ids": _NONE, "answer_start": "long", "answer_end": "long", "answer_qa": _NONE, "answer_plain": _NONE,
    "speakers": _NONE, "voice": "string", "cue": "string", "last_qa": _NONE, "last_done": "boolean", "last_trails": "boolean", "remark_ids": _NONE, "pending": "boolean", "clarifier": "string",
}


def _read(q: Column, rows: Column) -> Column:
    """A question's rows read forward: a struct of _STATE at the end of rows or at the first that stops the search."""
    begun = {"to": q["end_us"], "asked": q["low"], "asked_qa": q["qa"], "asked_plain": q["plain"], "asked_words": q["words"], "question_ids": F.array(q["segment_id"]), "question_end": q["end_us"], "context": F.lit(""), "context_words": F.lit(0), "pending": F.lit(False)}
    empty = lambda t: F.array() if t == _NONE else F.lit(None)
    zero = F.struct(*(begun.get(n, empty(t)).cast(t).alias(n) for n, t in _STATE.items()))

    def step(a: Column, r: Column) -> Column:
        answered, own = F.size(a["answer_ids"]) > 0, F.coalesce(r["speaker"] == q["speaker"], F.lit(False))
        gap, length = r["start_us"] - a["to"], F.greatest(r["end_us"] - r["start_us"], F.lit(0))
        spoken = F.array_union(a["asked_plain"], a["answer_plain"])
        prompt = F.concat(a["asked"], a["context"])
        because = ~r["marked"] & r["replies"][0] & a["asked"].rlike(sql_pattern(REPLIES[0][1]))
        seen = F.struct(
            (r["asks"] & ~because).alias("asks"),
            _remark(spoken, r).alias("remark"),
            ((length <= REMARK_US) & (r["words"] <= REMARK_WORDS)).alias("short"),
            F.arrays_overlap(r["qa"], F.array_union(a["asked_qa"], a["answer_qa"])).alias("near"),
            F.arrays_overlap(r["qa"], F.array_union(a["asked_qa"], F.when(answered, a["last_qa"]).otherwise(a["context_qa"]))).alias("shared"),
            F.when(~answered & ~own, _cue(r, prompt, a["asked_words"] + a["context_words"])).alias("cue"),
        )
        return F.when(a["stop"].isNotNull(), a).otherwise(let(seen, lambda x: let(act(a, r, x, answered, own, gap), lambda what: taken(a, r, x, what))))

    def act(a: Column, r: Column, x: Column, answered: Column, own: Column, gap: Column) -> Column:
        """What a row is: a name with a star is why the search stops."""
        clear = F.when(gap > F.when(answered, ANSWER_PAUSE_US).otherwise(ASK_PAUSE_US), "*pause_exceeds_search_window").when(r["end_us"] - q["end_us"] > LONGEST_US, "*answer_search_window_exhausted").when(q["speaker"].isNull() | r["speaker"].isNull(), "*missing_speaker_evidence").when(r["shifts"], "*topic_change_observed")
        extension = r["extends"] & (F.arrays_overlap(r["qa"], a["asked_qa"]) | r["tells"])
        asker = F.when(a["clarifier"].isNotNull() & ~x["asks"] & x["near"], "context").when((F.size(a["question_ids"]) < PARTS) & (gap <= NEAR_US) & ((x["asks"] & extension) | (~x["asks"] & ~r["firm"])), "extend").when(x["remark"].isNotNull() & x["short"], "aside").when(x["asks"], "*new_question_before_answer").otherwise("*intervention_relevance_unresolved")
        clarifies = x["remark"] == "clarification_cue"
        counter = F.when(clarifies & x["short"] & (a["clarifier"].isNull() | (a["clarifier"] == r["speaker"])), "clarify").when(clarifies, "*clarification_before_answer_unresolved").otherwise("*new_question_before_answer")
        other = F.when(x["asks"], counter).when(r["tiny"], "aside").when(a["clarifier"] != r["speaker"], "*clarification_speaker_changed").when(x["shared"] | x["cue"].isNotNull(), "answer").otherwise("*answer_relevance_unresolved")
        fragment = ~a["last_done"] & r["joins"] & ~r["resumes"]
        goes_on = F.when(x["asks"], "*new_question_during_answer").when(r["start_us"] - a["answer_end"] > RESUME_US, "*pause_exceeds_resume_window").when(~(x["shared"] | fragment) | ((gap > DRIFT_US) & ~x["shared"]), "*answer_continuation_unresolved").otherwise("answer")
        third = F.when(~own & r["hands"] & x["shared"] & ~x["asks"], "answer").when(x["remark"].isNotNull() & (own | (clarifies & x["near"])) & x["short"], "hold").when(x["asks"], "*new_question_during_answer").when(~own, "*third_speaker_intervention_unresolved").otherwise("*intervention_relevance_unresolved")
        return clear.when(~answered & own, asker).when(~answered, other).when(r["speaker"] == a["voice"], goes_on).otherwise(third)

    def taken(a: Column, r: Column, x: Column, what: Column) -> Column:
        stops, answers, extends, context = what.startswith("*"), what == "answer", what == "extend", what == "context"
        more = lambda cond, name, add: F.when(cond, F.array_union(a[name], add)).otherwise(a[name])
        put = lambda cond, name, value: F.when(cond, value).otherwise(a[name])
        one = lambda name: F.array(r[name])
        new = {
            "stop": F.when(stops, F.substring(what, F.lit(2), F.length(what))), "to": put(~stops, "to", r["end_us"]),
            "asked": put(extends, "asked", F.concat(a["asked"], F.lit(" "), r["low"])), "asked_qa": more(extends, "asked_qa", r["qa"]), "asked_plain": more(extends, "asked_plain", r["plain"]), "asked_words": put(extends, "asked_words", a["asked_words"] + r["words"]), "question_ids": put(extends, "question_ids", F.concat(a["question_ids"], one("segment_id"))), "question_end": put(extends, "question_end", r["end_us"]),
            "context": put(context, "context", F.concat(a["context"], F.lit(" "), r["low"])), "context_qa": more(context, "context_qa", r["qa"]), "context_words": put(context, "context_words", a["context_words"] + r["words"]),
            "answer_ids": put(answers, "answer_ids", F.concat(a["answer_ids"], one("segment_id"))), "answer_start": put(answers, "answer_start", F.coalesce(a["answer_start"], r["start_us"])), "answer_end": put(answers, "answer_end", r["end_us"]), "answer_qa": more(answers, "answer_qa", r["qa"]), "answer_plain": more(answers, "answer_plain", r["plain"]), "speakers": more(answers, "speakers", one("speaker")), "voice": put(answers, "voice", r["speaker"]),
            "cue": put(answers & (F.size(a["answer_ids"]) == 0), "cue", x["cue"]), "last_qa": put(answers, "last_qa", r["qa"]), "last_done": put(answers, "last_done", r["done"]), "last_trails": put(answers, "last_trails", r["trails"]),
            "remark_ids": put(what.isin("context", "aside", "clarify", "hold"), "remark_ids", F.concat(a["remark_ids"], one("segment_id"))), "pending": F.when(answers, F.lit(False)).otherwise(put(what == "hold", "pending", F.lit(True))), "clarifier": put(what == "clarify", "clarifier", r["speaker"]),
        }
        return F.struct(*(new[n].cast(t).alias(n) for n, t in _STATE.items()))

    return F.aggregate(rows, zero, step)


def _outcome(asks: Column, speaker: Column, x: Column, at_end: Column) -> dict[str, Column]:
    """status, reason and complete of a question that was read. at_end: why the search could not go on behind the rows, or null."""
    answered, stop = F.size(x["answer_ids"]) > 0, F.coalesce(x["stop"], at_end)
    reason = F.when(~asks, "answer_not_expected").when(speaker.isNull(), "missing_speaker_evidence").when(stop.isNotNull(), stop).when(~answered, "no_subsequent_answer_span").when(x["pending"], "answer_resume_not_observed")
    return {"status": F.when(~asks, "not_expected").when(answered, "linked_candidate").otherwise("unresolved"), "reason": reason, "complete": answered & reason.isNull() & x["last_done"] & ~x["last_trails"]}


def read_answers(segments: DataFrame, bucket_us: int = 600 * SECOND) -> DataFrame:
    """source_id, question_id (its first segment), kind, speaker, start_us, question_ids, question_end_us, status, reason, answer_ids, answer_speakers, answer_start_us, answer_end_us, cue, remark_ids, complete of every question.

    segments: source_id, segment_id, start_us, end_us, speaker, text. status: linked_candidate, unresolved, not_expected; reason says why it is not closed. A segment that
    answers an earlier why is no question itself. Rows without a source, id or times are passed over; null texts are empty, empty speakers unknown; ties of times go by id.
    """
    s = _prepared(segments).withColumn("pair", F.when(F.col("r.kind") != "statement", F.lit(True)))
    g = _after(s, bucket_us)
    x = F.when(F.col("q.asks"), F.slice("after", 1, ROWS)).otherwise(F.slice("after", 1, 0))
    g = g.withColumn("x", _read(F.col("q"), x))
    at_end = F.when(F.size("after") > ROWS, "answer_segment_search_limit").when(F.col("more"), "pause_exceeds_search_window")
    out = _outcome(F.col("q.asks"), F.col("q.speaker"), F.col("x"), at_end)
    pairs = g.select("source_id", F.col("q.segment_id").alias("question_id"), F.col("q.kind").alias("kind"), F.col("q.speaker").alias("speaker"), F.col("q.start_us").alias("start_us"), "x.question_ids", F.col("x.question_end").alias("question_end_us"), out["status"].alias("status"), out["reason"].alias("reason"), "x.answer_ids", F.col("x.speakers").alias("answer_speakers"), F.col("x.answer_start").alias("answer_start_us"), F.col("x.answer_end").alias("answer_end_us"), "x.cue", "x.remark_ids", F.coalesce(out["complete"], F.lit(False)).alias("complete"))
    return _without_replies(cut(pairs))


def _without_replies(pairs: DataFrame) -> DataFrame:
    """Less the questions that answer the why of an earlier one which stays. Only chains of whys take more than one turn of the loop."""
    key = ["source_id", "question_id"]
    edge = pairs.where("cue = 'causal_response_cue'").select("source_id", F.col("question_id").alias("why"), F.col("answer_ids")[0].alias("question_id"))
    edges = cut(edge.join(pairs.select(*key).distinct(), key, "left_semi"))
    gone = edges.select(*key).limit(0)
    kept = gone
    while not edges.isEmpty():
        # a why that no open edge leads to is settled
        open_ = edges.select("source_id", F.col("question_id").alias("why")).distinct()
        settled = edges.join(open_, ["source_id", "why"], "left_anti")
        out = settled.join(gone.withColumnRenamed("question_id", "why"), ["source_id", "why"], "left_anti").select(*key)
        gone = cut(gone.unionByName(out).distinct())
        edges = cut(edges.join(settled.select("source_id", "why").distinct(), ["source_id", "why"], "left_anti"))
    return pairs.join(gone, key, "left_anti")


def recover_dialogue(segments: DataFrame, pairs: DataFrame, bucket_us: int = 600 * SECOND) -> DataFrame:
    """The pairs of read_answers with the open ones searched again, the asker's own context and listeners' short reactions folded in: also recovered, context_ids, reaction_ids, tried (why an attempt failed, or the search's end).

    A reaction that might itself answer a yes-or-no question leaves it open, as do rows that overlap. Answers found are proposals. Sources with repeated ids stay as they are.
    Nulls as in read_answers; a pair whose segments are not there, or not the asker's, stays as it is.
    """
    s = _prepared(segments)
    twice = s.groupBy("source_id", "r.segment_id").count().where("count > 1").select("source_id").distinct()
    open_ = pairs.where("status = 'unresolved' and size(question_ids) > 0 and speaker is not null").join(twice, "source_id", "left_anti")
    p = open_.select("source_id", F.element_at("question_ids", 1).alias("first"), F.struct("question_id", "kind", "speaker", "question_ids").alias("pair"))
    g = _after(s.join(p, (s["source_id"] == p["source_id"]) & (s["r.segment_id"] == p["first"]), "left").select(s["source_id"], "r", "pair"), bucket_us)
    ids, all_rows = F.col("pair.question_ids"), F.slice("after", 1, ROWS)
    g = g.withColumn("parts", F.concat(F.array("q"), F.filter(all_rows, lambda r: F.array_contains(ids, r["segment_id"]))))
    g = g.where((F.size("parts") == F.size(ids)) & F.forall("parts", lambda r: F.coalesce(r["speaker"] == F.col("pair.speaker"), F.lit(False))))
    at = F.coalesce(F.array_position(F.transform("after", lambda r: r["segment_id"]), F.element_at(ids, -1)), F.lit(0)).cast("int")
    end = F.element_at("parts", -1)["end_us"]
    g = g.withColumn("later", F.slice("after", at + 1, F.lit(ROWS) - at)).withColumn("sound", _sound(F.col("later"), end, F.col("q.end_us")))
    beyond = F.when(F.size("after") > ROWS, "answer_segment_search_limit").when(F.col("more"), "answer_search_window_exhausted")
    g = g.withColumn("until", F.coalesce("sound.stop", beyond)).withColumn("later", F.slice("later", F.lit(1), F.col("sound.n")))
    g = g.withColumn("asked_plain", _union("parts", "plain")).withColumn("asked_qa", _union("parts", "qa")).withColumn("f", _folded_in(F.col("later"), end)).where("size(f.context) > 0 or size(f.reactions) > 0")
    said = F.concat("parts", "f.context")
    low = F.array_join(F.transform(said, lambda r: r["low"]), " ")
    again = F.struct(F.col("q.start_us").alias("start_us"), F.coalesce(F.try_element_at("f.context", F.lit(-1))["end_us"], end).alias("end_us"), F.col("q.segment_id").alias("segment_id"), F.col("q.speaker").alias("speaker"), low.alias("low"), question_kind(low).alias("kind"), F.aggregate(said, F.lit(0), lambda t, r: t + r["words"]).alias("words"), F.array_union("asked_plain", _union("f.context", "plain")).alias("plain"), F.col("f.qa").alias("qa"))
    g = g.withColumn("again", again).withColumn("asks", F.col("again.kind").isin("direct_question", "yes_no_question"))
    n = F.size("f.context") + F.size("f.reactions")
    g = g.withColumn("x", _read(F.col("again"), F.slice("later", n + 1, F.when(F.col("asks"), ROWS).otherwise(0))))
    names = lambda rows: F.transform(rows, lambda r: r["segment_id"])
    own = _outcome(F.col("asks"), F.col("q.speaker"), F.col("x"), F.lit(None).cast("string"))
    # the question's parts and its context stand where the folded question does
    asked = F.concat(ids, names("f.context"), F.slice("x.question_ids", F.lit(2), F.lit(ROWS)))
    remarks = F.array_union(F.col("x.remark_ids"), names("f.reactions"))
    used = F.concat(asked, F.col("x.answer_ids"), remarks)
    g = g.select("*", asked.alias("new_ids"), own["status"].alias("new_status"), own["reason"].alias("found_reason"), F.coalesce(own["complete"], F.lit(False)).alias("found_complete"), F.filter(F.concat(F.array("q"), "after"), lambda r: F.array_contains(used, r["segment_id"])).alias("seen"), remarks.alias("remarks"))
    zero = F.struct(F.lit(None).cast("long").alias("to"), F.lit(False).alias("clash"))
    clash = F.aggregate("seen", zero, lambda a, r: F.struct(r["end_us"].alias("to"), (a["clash"] | F.coalesce(r["start_us"] < a["to"], F.lit(False))).alias("clash")))["clash"]
    vague = (F.col("pair.kind") == "yes_no_question") & F.exists("f.reactions", lambda r: F.btrim(r["low"], F.lit(" .!?,")).isin(*YES_LIKE) & (r["speaker"] != F.col("x.speakers")[0]))
    tried = F.when(F.col("new_status") == "linked_candidate", F.when(vague, "polar_reaction_response_ownership_ambiguous").when(clash, "source_reference_or_temporal_overlap_unresolved"))
    g = g.withColumn("fault", tried).withColumn("recovered", (F.col("new_status") == "linked_candidate") & F.col("fault").isNull())
    order = F.filter("seen", lambda r: F.array_contains("remarks", r["segment_id"]))
    found = g.select("source_id", "pair.question_id", "recovered", names("f.context").alias("context_ids"), names("f.reactions").alias("reaction_ids"), F.coalesce("fault", "found_reason", "until").alias("tried"), F.struct(F.col("new_ids").alias("question_ids"), F.element_at(F.filter("seen", lambda r: F.array_contains("new_ids", r["segment_id"])), -1)["end_us"].alias("question_end_us"), F.lit("linked_candidate").alias("status"), F.coalesce("found_reason", "until").alias("reason"), "x.answer_ids", F.col("x.speakers").alias("answer_speakers"), F.col("x.answer_start").alias("answer_start_us"), F.col("x.answer_end").alias("answer_end_us"), "x.cue", names(order).alias("remark_ids"), (F.col("found_complete") & F.col("until").isNull()).alias("complete")).alias("new"))
    j = pairs.join(found, ["source_id", "question_id"], "left").withColumn("recovered", F.coalesce("recovered", F.lit(False)))
    own_columns = ("question_ids", "question_end_us", "status", "reason", "answer_ids", "answer_speakers", "answer_start_us", "answer_end_us", "cue", "remark_ids", "complete")
    none = F.array().cast(_NONE)
    return j.select("source_id", "question_id", "kind", "speaker", "start_us", *(F.when(F.col("recovered"), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in own_columns), "recovered", F.coalesce("context_ids", none).alias("context_ids"), F.coalesce("reaction_ids", none).alias("reaction_ids"), "tried")


def _union(rows: str, name: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r[name])))


def _sound(rows: Column, end: Column, first_end: Column) -> Column:
    """n: rows up to the first that overlaps what is before it, runs backwards or ends too late, and stop: why."""
    zero = F.struct(F.lit(0).alias("n"), end.alias("to"), F.lit(None).cast("string").alias("stop"))

    def step(a: Column, r: Column) -> Column:
        why = F.when((r["end_us"] < r["start_us"]) | (r["start_us"] < a["to"]), "source_interval_unresolved").when(r["end_us"] - first_end > LONGEST_US, "answer_search_window_exhausted")
        return F.when(a["stop"].isNotNull(), a).otherwise(F.struct(F.when(why.isNull(), a["n"] + 1).otherwise(a["n"]).alias("n"), r["end_us"].alias("to"), why.alias("stop")))

    return F.aggregate(rows, zero, step)


def _folded_in(rows: Column, end: Column, most: int = 3) -> Column:
    """context and reactions at the beginning of rows, and qa: terms of the question with its context."""
    none = F.slice(rows, 1, 0)
    zero = F.struct(none.alias("context"), none.alias("reactions"), end.alias("to"), F.lit(True).alias("open"), F.col("asked_qa").alias("qa"), F.col("asked_plain").alias("plain"))

    def step(a: Column, r: Column) -> Column:
        gap, own = r["start_us"] - a["to"], r["speaker"] == F.col("q.speaker")
        fine = a["open"] & (gap >= 0) & (gap <= ASK_PAUSE_US) & r["speaker"].isNotNull() & ~r["shifts"]
        shared = F.array_intersect(r["qa"], a["qa"])
        extension = r["extends"] & ((F.size(shared) > 0) | r["tells"])
        context = F.coalesce(fine & own & (F.size(a["context"]) < most) & (gap <= NEAR_US) & (~r["asks"] | extension) & (F.size(shared) >= 2), F.lit(False))
        remark = (_remark(a["plain"], r) == "reaction_cue") & (r["end_us"] - r["start_us"] <= REMARK_US) & (r["words"] <= REMARK_WORDS)
        reaction = F.coalesce(fine & ~own & remark & (F.size(a["reactions"]) < most), F.lit(False))
        add = lambda cond, name: F.when(cond, F.concat(a[name], F.array(r))).otherwise(a[name])
        wider = lambda name: F.when(context, F.array_union(a[name], r[name])).otherwise(a[name])
        return F.struct(add(context, "context").alias("context"), add(reaction, "reactions").alias("reactions"), r["end_us"].alias("to"), (context | reaction).alias("open"), wider("qa").alias("qa"), wider("plain").alias("plain"))

    return F.aggregate(rows, zero, step)
