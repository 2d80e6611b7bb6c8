"""Narrative units and sequences: arcs cut into contiguous pieces of one role, what context each needs, and checks of such a package.

A unit is a run of neighbouring segments of an arc that play one role; runs are cut at pauses and after a minute at a sentence's end.
Units with the same segments are one, whichever arcs they come from. Each needs the unit before it in every arc it belongs to,
and the units of a question that it answers; a sequence is an arc with everything its units need, in source order. An
arc's evidence is bounded, so it is one array; sources are never gathered. Null texts count as empty, null flags as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sql_pattern
from .commercial import folded
from .intervals import SECOND
from .lineage import cut

# An arc's components in the order in which they name a role, cues of an explanation, marks of a whole sentence, notes for review.
COMPONENTS = (("setup", "setup"), ("payoff", "resolution"), ("climax", "turning_point"), ("development", "development"))
EXPLANATION = r"\b(?:significa|por exemplo|ou seja|isso acontece|porque)\b"
ENDS = r"[.!?]$"
TRAILS = r"(?:\.\.\.|…)$"
ALWAYS = ("human_audio_review_pending", "preview_not_approved", "rights_review_pending")
READY, BLOCKED = "PROVISIONAL_REVIEW_READY", "BLOCKED_RECORDED_COMMERCIAL"


def digest(ids: Column) -> Column:
    """Sixteen hex digits that stand for a list of ids in its order."""
    return F.substring(F.sha2(F.to_json(ids), 256), 1, 16)


def places(segments: DataFrame) -> DataFrame:
    """source_id, segment_id, pos, start_us, end_us of valid segments in the order of a source; texts stay where they are."""
    s = segments.where("segment_id is not null and start_us >= 0 and end_us > start_us and trim(coalesce(text, '')) <> ''").select("source_id", "segment_id", "start_us", "end_us")
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("source_id").orderBy("start_us", "end_us", "segment_id")))


def _role(ids: Column, low: Column) -> tuple[Column, Column]:
    """The first component that holds all ids, else what the text says."""
    held = lambda name: (F.size(F.coalesce(F.col(name), F.array().cast("array<string>"))) > 0) & (F.size(F.array_except(ids, F.coalesce(F.col(name), F.array().cast("array<string>")))) == 0)
    role = reduce(lambda c, x: c.when(held(x[0]), x[1]), COMPONENTS, F)
    named = reduce(lambda a, b: a | b, [held(x) for x, _ in COMPONENTS])
    explains = low.rlike(sql_pattern(EXPLANATION))
    return role.when(explains, "explanation").otherwise("context"), F.when(named, "recorded_component_requires_review").when(explains, "literal_explanation_cue_requires_review").otherwise("source_context_only_not_narrative_completion")


def _chunks(rows: Column, most_us: int, gap_us: int) -> Column:
    """Rows of a run with the number of their piece: a new one after a pause, or after most_us at a sentence's end."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("from"), F.lit(None).cast("long").alias("to"), F.lit(False).alias("ends"), F.array().cast("array<int>").alias("of"))

    def step(a, r):
        new = (r["start_us"] - a["to"] > gap_us) | ((a["to"] - a["from"] >= most_us) & a["ends"])
        fresh = F.coalesce(new, F.lit(False))
        n = a["n"] + fresh.cast("int")
        return F.struct(n.alias("n"), F.when(fresh | a["from"].isNull(), r["start_us"]).otherwise(a["from"]).alias("from"), r["end_us"].alias("to"), r["ends"].alias("ends"), F.concat(a["of"], F.array(n)).alias("of"))

    return F.aggregate(rows, zero, step, lambda a: a["of"])


def narrative_units(arcs: DataFrame, segments: DataFrame, candidates: DataFrame, most_us: int = 60 * SECOND, gap_us: int = 8 * SECOND, long_us: int = 90 * SECOND) -> DataFrame:
    """source_id, unit_id, arc_ids, segment_ids, start_us, end_us, literal, role, role_status, unit_type, candidate_ids, speakers, uncertain, blockers, eligibility.

    arcs: source_id, arc_id, kind, evidence, setup, payoff, climax, development (arrays of segment ids); of arcs that share a unit the smallest id
    names its role. An arc with unknown evidence gives none. segments: source_id, segment_id, start_us, end_us, text, speaker, uncertain.
    candidates: source_id, candidate_id, segment_ids, excluded, verified.
    """
    s = places(segments).join(segments.select("source_id", "segment_id", "text", "speaker", F.coalesce("uncertain", F.lit(False)).alias("uncertain")), ["source_id", "segment_id"])
    member = arcs.select("source_id", "arc_id", F.explode(F.array_distinct("evidence")).alias("segment_id"), F.size(F.array_distinct("evidence")).alias("n"), *(x for x, _ in COMPONENTS))
    row = F.struct("pos", "segment_id", "start_us", "end_us", F.rtrim("text").rlike(sql_pattern(ENDS)).alias("ends"), "role", "text", "speaker", "uncertain")
    low = folded(F.col("text"))
    known = member.join(s, ["source_id", "segment_id"]).withColumn("role", _role(F.array("segment_id"), low)[0])
    per = known.groupBy("source_id", "arc_id", "n").agg(F.array_sort(F.collect_list(row)).alias("rows")).where(F.size("rows") == F.col("n"))
    # runs of neighbours of one role: a run's number is how often a row does not go on from the one before it
    at = per.select("source_id", "arc_id", F.posexplode("rows").alias("k", "r"), "rows")
    before = F.try_element_at("rows", F.col("k"))
    fresh = F.when(F.col("k") > 0, ((F.col("r.pos") != before["pos"] + 1) | (F.col("r.role") != before["role"])).cast("int")).otherwise(0)
    w = Window.partitionBy("source_id", "arc_id").orderBy("k")
    at = at.select("source_id", "arc_id", "k", "r", F.when(F.col("k") > 0, fresh).otherwise(0).alias("fresh")).withColumn("run", F.sum("fresh").over(w))
    runs = at.groupBy("source_id", "arc_id", "run").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("rows"))
    runs = runs.withColumn("piece", _chunks(F.col("rows"), most_us, gap_us))
    pieces = runs.select("source_id", "arc_id", "run", F.explode(F.arrays_zip("rows", "piece")).alias("x")).groupBy("source_id", "arc_id", "run", F.col("x.piece").alias("piece")).agg(F.array_sort(F.collect_list("x.rows")).alias("rows"))
    of = lambda f: F.transform("rows", lambda x: x[f])
    p = pieces.select("source_id", "arc_id", of("segment_id").alias("segment_ids"), F.array_min(of("start_us")).alias("lo"), F.element_at("rows", 1)["start_us"].alias("start_us"), F.element_at("rows", -1)["end_us"].alias("end_us"), F.array_join(of("text"), " ").alias("literal"), F.array_sort(F.array_distinct(F.filter(of("speaker"), lambda x: x.isNotNull()))).alias("speakers"), F.transform(F.filter("rows", lambda x: x["uncertain"]), lambda x: x["segment_id"]).alias("uncertain"), F.rtrim(F.element_at("rows", -1)["text"]).alias("tail"))
    p = p.join(arcs.select("source_id", "arc_id", "kind", *(x for x, _ in COMPONENTS)), ["source_id", "arc_id"])
    role, status = _role(F.col("segment_ids"), folded(F.col("literal")))
    p = p.withColumn("role", role).withColumn("role_status", status).withColumn("unit_id", F.concat(F.lit("UNIT_"), digest(F.col("segment_ids"))))
    same = ["segment_ids", "start_us", "end_us", "literal", "speakers", "uncertain", "tail"]
    units = p.groupBy("source_id", "unit_id").agg(F.array_sort(F.collect_set("arc_id")).alias("arc_ids"), F.min_by(F.struct("role", "role_status", "kind"), "arc_id").alias("first"), *(F.first(x).alias(x) for x in same))
    c = candidates.select("source_id", "candidate_id", F.explode(F.array_distinct("segment_ids")).alias("segment_id"), F.coalesce("excluded", F.lit(False)).alias("excluded"), F.coalesce("verified", F.lit(False)).alias("verified"))
    met = units.select("source_id", "unit_id", F.explode("segment_ids").alias("segment_id")).join(c, ["source_id", "segment_id"])
    met = met.groupBy("source_id", "unit_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidate_ids"), F.bool_or("excluded").alias("ad"), F.bool_or(~F.col("verified")).alias("unverified"))
    u = units.join(met, ["source_id", "unit_id"], "left")
    ad, none = F.coalesce("ad", F.lit(False)), F.array().cast("array<string>")
    found = [F.when(F.size("uncertain") > 0, "source_transcript_uncertain"), F.when(ad, "recorded_commercial_exclusion"), F.when(F.col("unverified"), "commercial_review_pending"), F.when(~F.col("tail").rlike(sql_pattern(ENDS)) | F.col("tail").rlike(sql_pattern(TRAILS)), "ending_requires_context_review"), F.when(F.col("end_us") - F.col("start_us") > long_us, "long_source_unit_requires_curator_split")]
    blockers = F.array_sort(F.array_compact(F.array(*map(F.lit, ALWAYS), *found)))
    kind = F.when(F.col("first.role") == "explanation", "explanation_candidate").when(F.col("first.kind") == "discussion_segment", "discussion_context").otherwise("narrative_fragment")
    return u.select("source_id", "unit_id", "arc_ids", "segment_ids", "start_us", "end_us", "literal", "first.role", "first.role_status", kind.alias("unit_type"), F.coalesce("candidate_ids", none).alias("candidate_ids"), "speakers", "uncertain", blockers.alias("blockers"), F.when(ad, BLOCKED).otherwise(READY).alias("eligibility"))


def context_edges(units: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """source_id, unit_id, needs: the unit before in each arc, and the earlier units that hold what a link's answer refers to (links: source_id, context_ids, answer_ids)."""
    order = F.struct("start_us", "end_us", "unit_id")
    per = units.select("source_id", F.explode("arc_ids").alias("arc_id"), "unit_id", order.alias("at"))
    edges = per.withColumn("needs", F.lag("unit_id").over(Window.partitionBy("source_id", "arc_id").orderBy("at"))).where("needs is not null").select("source_id", "unit_id", "needs")
    if links is not None:
        at = units.select("source_id", "unit_id", F.explode("segment_ids").alias("segment_id"), order.alias("at"))
        numbered = links.withColumn("link", F.xxhash64("source_id", "context_ids", "answer_ids")).dropDuplicates(["source_id", "link", "context_ids", "answer_ids"])
        ends = [numbered.select("source_id", "link", "context_ids", "answer_ids", F.explode(f"{side}_ids").alias("segment_id")).join(at, ["source_id", "segment_id"]).select("source_id", "link", "context_ids", "answer_ids", F.col("unit_id").alias(side), F.col("at").alias(f"{side}_at")).distinct() for side in ("answer", "context")]
        more = ends[0].join(ends[1], ["source_id", "link", "context_ids", "answer_ids"]).where("context_at < answer_at")
        edges = edges.union(more.select("source_id", F.col("answer").alias("unit_id"), F.col("context").alias("needs")))
    return edges.distinct()


def reachable(starts: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """source_id, root, unit_id: all that each root's given units (source_id, root, unit_id) need at any remove, themselves included.

    Each round follows the edges (source_id, unit_id, needs) of what the round before has added; diamonds and cycles add nothing twice.
    """
    edges = cut(edges.select("source_id", "unit_id", "needs"))
    seen = fresh = cut(starts.select("source_id", "root", "unit_id").distinct())
    for _ in range(most_rounds):
        onward = fresh.join(edges, ["source_id", "unit_id"]).select("source_id", "root", F.col("needs").alias("unit_id")).distinct()
        fresh = cut(onward.join(seen, ["source_id", "root", "unit_id"], "left_anti"))
        if fresh.isEmpty():
            return seen
        seen = cut(seen.union(fresh))
    raise RuntimeError("the context has not settled")


def narrative_sequences(units: DataFrame, edges: DataFrame, arcs: DataFrame) -> DataFrame:
    """source_id, sequence_id, arc_id, unit_ids, required, blockers, complete, completeness: each arc that has a unit ready for review, with all that its units need, in source order.

    Arcs that come to the same units are one sequence, of the smallest id. arcs: source_id, arc_id, kind, supported.
    """
    units, edges = cut(units), cut(edges)
    per = units.select("source_id", F.explode("arc_ids").alias("arc_id"), "unit_id", (F.col("eligibility") == READY).alias("ready"))
    open_ = per.groupBy("source_id", "arc_id").agg(F.bool_or("ready").alias("ready")).where("ready").drop("ready")
    starts = per.join(open_, ["source_id", "arc_id"]).select("source_id", F.col("arc_id").alias("root"), "unit_id")
    held = reachable(starts, edges).join(units.select("source_id", "unit_id", F.struct("start_us", "end_us", "unit_id").alias("at"), "blockers"), ["source_id", "unit_id"])
    needs = edges.groupBy("source_id", "unit_id").agg(F.collect_set("needs").alias("needs"))
    held = held.join(needs, ["source_id", "unit_id"], "left")
    g = held.groupBy("source_id", F.col("root").alias("arc_id")).agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["unit_id"]).alias("unit_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("needs", F.array().cast("array<string>")))))).alias("required"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("blockers")))).alias("blockers"))
    g = g.join(arcs.select("source_id", "arc_id", "kind", F.coalesce("supported", F.lit(False)).alias("complete")), ["source_id", "arc_id"]).withColumn("sequence_id", F.concat(F.lit("SEQUENCE_"), digest(F.col("unit_ids"))))
    one = g.groupBy("source_id", "sequence_id").agg(F.min_by(F.struct("arc_id", "unit_ids", "required", "blockers", "complete", "kind"), "arc_id").alias("x")).select("source_id", "sequence_id", "x.*")
    state = F.when(F.col("complete"), "complete_supported").when(F.col("kind") == "discussion_segment", "discussion_without_narrative").otherwise("partial_supported")
    return one.withColumn("completeness", state).drop("kind")


# ---------------------------------------------------------------- checks


def _refused(rows: DataFrame, what: str, bad: Column, rule: str) -> DataFrame:
    return rows.where(F.coalesce(bad, F.lit(True))).select("source_id", F.lit(what).alias("what"), F.col("id"), F.lit(rule).alias("rule"))


def validate_package(units: DataFrame, sequences: DataFrame, segments: DataFrame, candidates: DataFrame) -> DataFrame:
    """source_id, what, id, rule: every rule that a unit or sequence of a delivered package breaks; without rows the package is valid.

    units: source_id, unit_id, segment_ids, start_us, end_us, literal, candidate_ids, needs, approved. sequences: source_id, sequence_id, unit_ids, required, complete, setup, development, payoff, approved.
    Ids, texts, bounds and order are compared with the segments (source_id, segment_id, start_us, end_us, text), candidates by id.
    """
    none = F.array().cast("array<string>")
    u = cut(units.select("source_id", F.col("unit_id").alias("id"), F.coalesce("segment_ids", none).alias("segment_ids"), "start_us", "end_us", "literal", F.coalesce("candidate_ids", none).alias("candidate_ids"), F.coalesce("needs", none).alias("needs"), F.coalesce("approved", F.lit(False)).alias("approved")))
    s = cut(places(segments).join(segments.select("source_id", "segment_id", "text"), ["source_id", "segment_id"]))
    out = [_refused(u, "unit", (F.col("start_us") < 0) | (F.col("end_us") <= F.col("start_us")), "invalid_unit_timestamp"), _refused(u, "unit", F.col("approved"), "unit_approval_unverified")]
    out.append(_refused(u.groupBy("source_id", "id").count(), "unit", F.col("count") > 1, "duplicate_unit_id"))
    twice = u.groupBy("source_id", F.col("segment_ids")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    out.append(_refused(twice, "unit", F.col("n") > 1, "duplicate_unit_source"))
    # a unit's segments in its own order, beside the segments of the source
    at = u.select("source_id", "id", F.posexplode_outer("segment_ids").alias("k", "segment_id"), "start_us", "end_us", "literal", F.size("segment_ids").alias("n"), F.size(F.array_distinct("segment_ids")).alias("kinds")).withColumnsRenamed({"start_us": "u0", "end_us": "u1"})
    j = at.join(s, ["source_id", "segment_id"], "left").groupBy("source_id", "id", "u0", "u1", "literal", "n", "kinds").agg(F.count("pos").alias("known"), F.array_sort(F.collect_list(F.struct("k", "pos", "start_us", "end_us", "text"))).alias("rows"), (F.max("pos") - F.min("pos") + 1).alias("reach"))
    j = j.withColumn("sound", (F.col("n") > 0) & (F.col("known") == F.col("n")) & (F.col("kinds") == F.col("n")))
    out.append(_refused(j, "unit", ~F.col("sound"), "invalid_segment_reference"))
    good = j.where("sound")
    text = F.array_join(F.transform("rows", lambda x: x["text"]), " ")
    sorted_ = F.transform("rows", lambda x: x["pos"])
    out += [_refused(good, "unit", F.coalesce(F.col("literal") != text, F.lit(True)), "unit_literal_source_disagreement"), _refused(good, "unit", (F.col("u0") != F.element_at("rows", 1)["start_us"]) | (F.col("u1") != F.element_at("rows", -1)["end_us"]), "unit_boundary_disagreement"), _refused(good, "unit", (F.col("reach") != F.col("n")) | (sorted_ != F.array_sort(sorted_)), "unit_implicit_distant_montage")]
    c = candidates.select("source_id", F.col("candidate_id").alias("ref")).distinct()
    lost = u.select("source_id", "id", F.explode("candidate_ids").alias("ref")).join(c, ["source_id", "ref"], "left_anti").select("source_id", "id").distinct()
    out.append(_refused(lost, "unit", F.lit(True), "unit_candidate_reference"))
    edges = u.select("source_id", "id", F.explode("needs").alias("ref"), F.struct("start_us", "end_us", "id").alias("at"))
    known = u.groupBy("source_id", F.col("id").alias("ref")).agg(F.min(F.struct("start_us", "end_us", "id")).alias("ref_at"))
    e = cut(edges.join(known, ["source_id", "ref"], "left"))
    out.append(_refused(e.where("ref_at is null or ref = id").select("source_id", "id").distinct(), "unit", F.lit(True), "unit_context_reference"))
    # every cycle has a link to a unit that does not come earlier; from there it must lead back
    back = e.where("ref_at is not null and ref <> id and ref_at >= at").select("source_id", F.struct("id", "ref").alias("root"), F.col("ref").alias("unit_id"))
    chain = reachable(back, e.where("ref_at is not null and ref <> id").select("source_id", F.col("id").alias("unit_id"), F.col("ref").alias("needs")))
    out.append(_refused(chain.where("unit_id = root.id").select("source_id", F.col("unit_id").alias("id")).distinct(), "unit", F.lit(True), "cyclic_unit_context"))
    q = cut(sequences.select("source_id", F.col("sequence_id").alias("id"), F.coalesce("unit_ids", none).alias("unit_ids"), F.coalesce("required", none).alias("required"), F.coalesce("complete", F.lit(False)).alias("complete"), *(F.coalesce(x, none).alias(x) for x in ("setup", "development", "payoff")), F.coalesce("approved", F.lit(False)).alias("approved")))
    out.append(_refused(q, "sequence", F.col("approved"), "sequence_approval_unverified"))
    parts = q.select("source_id", "id", "unit_ids", "required", F.explode_outer("unit_ids").alias("ref")).join(u.dropDuplicates(["source_id", "id"]).select("source_id", F.col("id").alias("ref"), "needs", "segment_ids"), ["source_id", "ref"], "left")
    parts = parts.groupBy("source_id", "id", "unit_ids", "required").agg(F.count("needs").alias("known"), F.array_distinct(F.flatten(F.collect_list("needs"))).alias("needs"), F.array_distinct(F.flatten(F.collect_list("segment_ids"))).alias("held"))
    parts = parts.withColumn("sound", (F.size("unit_ids") > 0) & (F.col("known") == F.size("unit_ids")) & (F.size(F.array_distinct("unit_ids")) == F.size("unit_ids")))
    out.append(_refused(parts, "sequence", ~F.col("sound"), "sequence_unit_reference"))
    fine = cut(parts.where("sound"))
    missing = (F.size(F.array_except("needs", "unit_ids")) > 0) | (F.size(F.array_except("needs", "required")) > 0) | (F.size(F.array_except("required", "needs")) > 0)
    out.append(_refused(fine, "sequence", missing, "sequence_missing_required_context"))
    three = [F.struct(F.lit(i).alias("part"), F.col(x).alias("ids")) for i, x in enumerate(("setup", "development", "payoff"))]
    done = q.where("complete").join(fine.select("source_id", "id", "held"), ["source_id", "id"]).withColumn("p", F.explode(F.array(*three)))
    inside = done.groupBy("source_id", "id").agg(F.bool_and((F.size("p.ids") > 0) & (F.size(F.array_except("p.ids", "held")) == 0)).alias("inside"))
    spans = done.select("source_id", "id", "p.part", F.explode("p.ids").alias("segment_id")).join(s, ["source_id", "segment_id"]).groupBy("source_id", "id", "part").agg(F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    ordered = spans.groupBy("source_id", "id").agg((F.max(F.when(F.col("part") == 0, F.col("hi"))) <= F.max(F.when(F.col("part") == 1, F.col("lo")))).alias("a"), (F.max(F.when(F.col("part") == 1, F.col("hi"))) <= F.max(F.when(F.col("part") == 2, F.col("lo")))).alias("b"))
    supported = inside.join(ordered, ["source_id", "id"], "left").select("source_id", "id", (F.col("inside") & F.coalesce(F.col("a") & F.col("b"), F.lit(False))).alias("ok"))
    out.append(_refused(supported, "sequence", ~F.col("ok"), "sequence_completion_unsupported"))
    again = q.groupBy("source_id", "unit_ids").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    out.append(_refused(again, "sequence", F.col("n") > 1, "duplicate_sequence_source"))
    return reduce(DataFrame.union, out).distinct()
