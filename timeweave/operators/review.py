"""Review rules: normalised records, stage states, gates, questions and hooks, selection dispositions, zoom and camera roles.

Each rule is a column of evidence columns; a missing one is null and never counts as evidence against.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.text import sql_pattern
from .commercial import COMMERCIAL_TYPES, folded, let

# Names of states and the words that stand for them.
NO_CONTEXT = ("none", "nao", "nenhum", "nenhuma", "sem contexto", "nao precisa", "nao necessario")
NEEDED = ("required", "necessario", "obrigatorio")
USEFUL = ("helpful", "util", "ajuda")
REQUIREMENTS = ("none", "helpful", "required", "unresolved")
STANDALONE = ("excellent", "good", "needs_context", "poor")
ENGLISH_MARKERS = ("the", "this", "that", "with", "which", "because", "about", "are", "was", "were", "and", "their", "they", "would", "from")
PORTUGUESE_MARKERS = ("que", "com", "porque", "sobre", "uma", "para", "das", "dos", "fala", "historia", "trecho", "momento", "contexto", "nao")
PENDING_REVIEWS = ("split_offer_across_different_voices", "near_commercial_block")
CAPACITY = ("shortlist_capacity", "topic_diversity_limit", "semantic_repetition", "diversity_or_repetition_limit")


def _in(x: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def context_requirement(explicit: Column, legacy: Column, flag: Column) -> Column:
    """none, helpful, required or unresolved: the explicit value if it is one of them, else what a flag or free text stands for; other free text is a need."""
    value = F.trim(folded(legacy))
    return F.when(_in(explicit, REQUIREMENTS), explicit).when((flag == F.lit(False)) | value.isin(*NO_CONTEXT), "none").when(flag | value.isin(*NEEDED), "required").when(value.isin(*USEFUL), "helpful").when((value != "") & ~value.isin("null", "none", "unresolved"), "required").otherwise("unresolved")


def context_reason(given: Column, legacy: Column) -> Column:
    """The given reason, else free text that is no state by itself; at most 1,500 characters, null if blank."""
    value = F.trim(folded(legacy))
    free = F.when(legacy.isNotNull() & ~value.isin("", "null", *REQUIREMENTS, "nao", "nenhum", "nenhuma"), legacy)
    reason = F.substring(F.coalesce(given, free), 1, 1500)
    return F.when(F.trim(reason) != "", reason)


def normalize_moments(moments: DataFrame) -> DataFrame:
    """Defaults of moments: complete_sentence from the text's end, standalone_class of the known ones, needs_review unless said otherwise, how far the method's confidence goes."""
    ends = F.coalesce(F.rtrim(F.coalesce("text", F.lit(""))).rlike(sql_pattern(r"[.?!]$")), F.lit(False))
    known = F.when(_in(F.col("standalone_class"), STANDALONE), F.col("standalone_class")).otherwise("needs_context")
    return moments.withColumn("complete_sentence", F.coalesce("complete_sentence", ends)).withColumn("standalone_class", known).withColumn("needs_review", F.coalesce("needs_review", F.lit(True))).withColumn("confidence_method", F.when(F.col("method").eqNullSafe(F.lit("ollama")), "subjective_llm_judgment").otherwise("lexical_heuristic"))


def stage_capability(status: Column, reason: Column, measured: Column, failed: Column, state: Column) -> Column:
    """What a stage's status is worth: frames that all failed, or a payload that was not measured, outweigh an ok."""
    taken = ~state.eqNullSafe(F.lit("not_measured"))
    return (
        F.when(_in(status, ("failed", "blocked", "cancelled")), "failed").when(_in(status, ("unavailable",)), "unavailable_dependency")
        .when((F.coalesce(failed, F.lit(0)) > 0) & (F.coalesce(measured, F.lit(0)) == 0), "failed").when(_in(status, ("skipped",)) & _in(reason, ("ocr_disabled", "disabled")), "not_measured_disabled")
        .when(_in(status, ("ok", "measured")) & taken, "measured_ok").when(_in(status, ("partial", "degraded")) & taken, "measured_partial").otherwise("unavailable_dependency")
    )


def review_state(editorial: Column, transcript: Column, visual: Column) -> Column:
    """Ready for review only if all three are known to be; approval never follows."""
    return F.when(F.coalesce(editorial & transcript & visual, F.lit(False)), "READY_FOR_REVIEW").otherwise("PARTIAL")


def final_classification(df: DataFrame) -> DataFrame:
    """Adds eligibility and decided_by: an excluded interval, an upstream exclusion, an upstream review, the speech, the text itself, the screen, in this order of precedence.

    df: in_excluded_interval, prior, prior_reason, speech, local (eligibilities), unmeasured_visual, evidence_state.
    """
    local = F.when((F.col("local") != "excluded") & F.col("unmeasured_visual"), "review").otherwise(F.col("local"))
    doubtful = F.col("evidence_state").isNotNull() & (F.col("evidence_state") != "measured_ok")
    rules = [
        (F.col("in_excluded_interval"), "excluded", "excluded_interval_preserved"), (F.col("prior") == "excluded", "excluded", "upstream_exclusion_preserved"),
        ((F.col("prior") == "review") & F.col("prior_reason").isin(*PENDING_REVIEWS), "review", "upstream_commercial_review_preserved"), (F.col("speech") == "excluded", "excluded", "canonical_speech_exclusion"),
        (F.col("prior") == "review", "review", "upstream_commercial_review_preserved"), (F.col("local") == "excluded", "excluded", "local_exclusion_added"), (doubtful, "review", "visual_evidence_state"),
    ]
    pick = lambda k, last: reduce(lambda c, r: c.when(r[0], F.lit(r[k])), rules, F).otherwise(last)
    return df.withColumn("eligibility", pick(1, local)).withColumn("decided_by", pick(2, "local_eligible"))


def quality_gate(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Adds issues (code:severity) and status: a high one fails, a medium one degrades, an info one only warns. rules: code, severity, condition; an unknown condition is no issue."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f"{code}:{severity}")) for code, severity, c in rules)))
    has = lambda s: F.exists("issues", lambda x: x.endswith(f":{s}"))
    return df.withColumn("issues", found).withColumn("status", F.when(has("high"), "P0_FAIL").when(has("medium"), "P1_DEGRADED").when(F.size("issues") > 0, "PASS_WITH_WARNINGS").otherwise("PASS"))


# ---------------------------------------------------------------- questions and hooks

# Rules for questions and hooks, in order.
ASKS = r"^(?:como|por que|porque|quem|onde|qual|quais|quando|quanto|o que|que tipo|me conta)\b"
GREETING = r"^(?:tudo (?:bem|bacana|certo)|como (?:vai|voce esta)|bom dia|boa tarde|boa noite)\b"
SELF = r"\b(?:eu me pergunto|me perguntei|pergunto a mim)\b"
RHETORICAL = r"^(?:quem (?:nunca|diria|nao)|como pode|pode uma coisa dessas)\b"
TAG = r"\b(?:ne|nao e|certo|entendeu|sabe)\s*\?[.!]*$"
OPEN_WORD = r"^(?:como|por que|quem|onde|qual|quando|quanto)\b"
ASK_WORD = r"^(?:como|por que|porque|quem|onde|qual|quais|quando|quanto|o que)\b"
YES_NO = r"^(?:voce|voces|ele|ela|isso|e verdade|tem|foi|era|pode|deve|seria)\b"
REVEAL = r"\b(?:ninguem sabe|nunca contei|vou revelar|o segredo|descobri)\b"
EMOTION = r"\b(?:chorei|morreu|perdi meu|minha maior dor|me emocionei)\b"
CLAIM = r"\b(?:nunca|jamais|ninguem|com certeza|e impossivel)\b"
STORY = r"\b(?:um dia|naquela epoca|quando comecei|aconteceu comigo)\b"
FILLER = r"^(?:bom|entao|assim|tipo|olha)[, .]*$"


def question_kind(low: Column) -> Column:
    """What a folded text asks: statement if nothing."""

    def kind(v: Column) -> Column:
        n = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
        return F.when(~(v.contains("?") | v.rlike(sql_pattern(ASKS))), "statement").when(v.rlike(sql_pattern(GREETING)), "greeting_question").when(v.rlike(sql_pattern(SELF)), "self_question").when(v.rlike(sql_pattern(RHETORICAL)) & (n <= 12), "rhetorical_question").when(v.rlike(sql_pattern(TAG)) & ~v.rlike(sql_pattern(OPEN_WORD)), "tag_question").when((n <= 2) & ~v.rlike(sql_pattern(ASK_WORD)), "banter").when(v.rlike(sql_pattern(YES_NO)), "yes_no_question").otherwise("direct_question")

    return let(F.trim(low), kind)


def classify_question(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds question_type, answer_expected, hook_type and hook_strength (null if nothing tells)."""
    v = F.trim(folded(F.col(text)))
    n = F.size(F.filter(F.split(v, r"\s+"), lambda w: w != ""))
    kind = question_kind(v)
    df = df.withColumn("question_type", kind).withColumn("answer_expected", F.col("question_type").isin("direct_question", "yes_no_question"))
    q = F.col("question_type")
    hooks = [(q.isin("greeting_question", "banter", "tag_question"), "generic_question", 0.1), (q.isin("rhetorical_question", "self_question"), "rhetorical_question", 0.25), (v.rlike(sql_pattern(REVEAL)), "reveal", 0.8), (v.rlike(sql_pattern(EMOTION)), "emotional_statement", 0.75), (v.rlike(sql_pattern(CLAIM)) & (n >= 5), "strong_claim", 0.65), (F.col("answer_expected"), "genuine_question", 0.6), (v.rlike(sql_pattern(STORY)), "story_opening", 0.6), (v.rlike(sql_pattern(FILLER)), "filler", 0.0)]
    pick = lambda k, last: reduce(lambda c, r: c.when(r[0], F.lit(r[k])), hooks, F).otherwise(last)
    return df.withColumn("hook_type", pick(1, "unresolved")).withColumn("hook_strength", pick(2, F.lit(None).cast("double")))


def selection_disposition(df: DataFrame) -> DataFrame:
    """Adds blockers (sorted) and disposition: chosen; alternative if only room was lacking; pending if a review, a required score or the score is missing; else excluded.

    df: selected, reasons, editorial_blockers (arrays), eligibility, content_type, clean_opening, clean_ending, missing (required components), score.
    """
    more = F.array_compact(F.array(F.when(_in(F.col("content_type"), COMMERCIAL_TYPES) | _in(F.col("eligibility"), ("excluded", "review")), "commercial_selection_gate"), *(F.when(F.col(x) == F.lit(False), F.lit(f"{x}:false")) for x in ("clean_opening", "clean_ending"))))
    df = df.withColumn("absolute", F.concat("editorial_blockers", more))
    room = (F.size("reasons") > 0) & F.forall("reasons", lambda r: r.isin(*CAPACITY))
    d = F.when(F.col("selected"), "chosen").when(room, "alternative").when(_in(F.col("eligibility"), ("review",)), "pending").when(F.size("absolute") > 0, "excluded").when(F.size("missing") > 0, "pending").when(F.col("score").isNull(), "pending").otherwise("excluded")
    return df.withColumn("disposition", d).withColumn("blockers", F.array_sort(F.array_distinct(F.concat("reasons", "absolute", F.transform("missing", lambda m: F.concat(F.lit("missing_required_score:"), m)))))).drop("absolute")


# ---------------------------------------------------------------- zoom, roles, boxes, captions


def zoom_diagnostics(keyframes: DataFrame, durations: DataFrame, shortest_us: int = 6_000_000, least: float = 0.015) -> DataFrame:
    """Of each source's zoom keyframes (time_us, zoom): moves, reversals within shortest_us + 1 s, pumping (reversals by moves), jitter (mean change of slope), the largest zoom, moves a minute."""
    k = keyframes.select("source_id", "time_us", "zoom").distinct()
    w = Window.partitionBy("source_id").orderBy("time_us", "zoom")
    s = k.withColumn("dt", F.col("time_us") - F.lag("time_us").over(w)).withColumn("dz", F.col("zoom") - F.lag("zoom").over(w))
    step = s.where("dt > 0").withColumn("slope", F.col("dz") / (F.col("dt") / 1e6)).withColumn("way", F.when(F.abs("dz") >= least, F.signum("dz")))
    step = step.withColumn("jerk", F.abs(F.col("slope") - F.lag("slope").over(w)))
    moved = step.where("way is not null").withColumn("back", ((F.lag("way").over(w) != F.col("way")) & (F.col("time_us") - F.lag("time_us").over(w) < shortest_us + 1_000_000)).cast("int"))
    moves = moved.groupBy("source_id").agg(F.count(F.lit(1)).alias("moves"), F.coalesce(F.sum("back"), F.lit(0)).alias("reversals"))
    jitter = step.groupBy("source_id").agg(F.round(F.coalesce(F.sum("jerk"), F.lit(0.0)) / F.greatest(F.count("slope") - 1, F.lit(1)), 6).alias("jitter"))
    largest = k.groupBy("source_id").agg(F.max("zoom").alias("largest"))
    j = durations.select("source_id", "duration_us").join(largest, "source_id", "left").join(moves, "source_id", "left").join(jitter, "source_id", "left")
    n, r = F.coalesce("moves", F.lit(0)), F.coalesce("reversals", F.lit(0))
    return j.select("source_id", F.coalesce("largest", F.lit(1.0)).alias("largest"), n.alias("moves"), r.alias("reversals"), F.round(r / F.greatest(n, F.lit(1)), 6).alias("pumping"), F.coalesce("jitter", F.lit(0.0)).alias("jitter"), ratio(n * 60_000_000, F.col("duration_us")).alias("moves_per_minute"))


def person_roles(windows: DataFrame) -> DataFrame:
    """source_id, start_us, person_id, role of everyone visible in a window (visible, active_person, overlap, reactions: an array of person ids): speaking, reacting, listening to a confirmed speaker, or undetermined."""
    each = windows.select("source_id", "start_us", "active_person", "overlap", "reactions", F.explode("visible").alias("person_id"))
    speaks = F.col("active_person").isNotNull() & ~F.col("overlap")
    own = F.col("person_id").eqNullSafe(F.col("active_person"))
    role = F.when(speaks & own, "SPEAKING").when(F.array_contains("reactions", F.col("person_id")) & ~own, "REACTING").when(speaks & ~own, "LISTENING").otherwise("VISIBLE_UNDETERMINED")
    return each.select("source_id", "start_us", "person_id", role.alias("role"))


def rects_intersect(a: tuple[Column, ...], b: tuple[Column, ...], margin: float = 0.012) -> Column:
    """Whether two boxes (x, y, width, height) come closer than the margin."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    return (ax < bx + bw + margin) & (bx < ax + aw + margin) & (ay < by + bh + margin) & (by < ay + ah + margin)


def rect_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The area that two boxes share."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    side = lambda p, n, q, m: F.greatest(F.lit(0.0), F.least(p + n, q + m) - F.greatest(p, q))
    return side(ax, aw, bx, bw) * side(ay, ah, by, bh)


def project_box(box: tuple[Column, ...], crop: tuple[Column, ...]) -> Column:
    """A box's part inside a crop in the crop's own coordinates: x, y, width, height; null outside."""
    (x, y, w, h), (cx, cy, cw, ch) = box, crop
    x0, y0, x1, y1 = F.greatest(x, cx), F.greatest(y, cy), F.least(x + w, cx + cw), F.least(y + h, cy + ch)
    return F.when((x1 > x0) & (y1 > y0), F.struct(((x0 - cx) / cw).alias("x"), ((y0 - cy) / ch).alias("y"), ((x1 - x0) / cw).alias("width"), ((y1 - y0) / ch).alias("height")))


def vertical_crop(x: Column, w: Column, width: Column, height: Column) -> Column:
    """The 9:16 crop around a box's middle: x, width, and whether it holds the box."""
    wide = F.least(F.lit(1.0), height * 9 / 16 / width)
    left = F.greatest(F.lit(0.0), F.least(1 - wide, x + w / 2 - wide / 2))
    return F.struct(left.alias("x"), wide.alias("width"), ((x >= left) & (x + w <= left + wide)).alias("fits"))


def wrap_text(text: Column, most: int = 38) -> Column:
    """One line if it fits, else two that fit (after punctuation if possible, then balanced, then the earlier break), else lines filled word by word."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    join = lambda a: F.array_join(a, " ")

    def lines(t: Column) -> Column:
        left, right = lambda i: join(F.slice(t, F.lit(1), i)), lambda i: join(F.slice(t, i + 1, F.size(t)))
        cut = lambda i: F.struct((~F.element_at(t, i).rlike(sql_pattern("[.,;:!?]$"))).alias("plain"), F.abs(F.length(left(i)) - F.length(right(i))).alias("apart"), i.alias("i"))
        fit = F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))), lambda i: (i < F.size(t)) & (F.length(left(i)) <= most) & (F.length(right(i)) <= most))
        best = F.array_min(F.transform(fit, cut))["i"]
        first = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

        def fill(s: Column, w: Column) -> Column:
            longer = F.when(s["line"] == "", w).otherwise(F.concat(s["line"], F.lit(" "), w))
            over = (s["line"] != "") & (F.length(longer) > most)
            return F.struct(F.when(over, F.concat(s["done"], s["line"], F.lit("\n"))).otherwise(s["done"]).alias("done"), F.when(over, w).otherwise(longer).alias("line"))

        filled = F.aggregate(t, first, fill, lambda s: F.concat(s["done"], s["line"]))
        return F.when(F.length(join(t)) <= most, join(t)).when(best.isNotNull(), F.concat(left(best), F.lit("\n"), right(best))).otherwise(filled)

    return F.transform(F.array(tokens), lines)[0]
