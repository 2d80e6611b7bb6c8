"""Audits of questions and answers, and of contracts in free JSON. Nothing is repaired silently and nothing approved: what disagrees is named."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sql_pattern, squeeze
from .commercial import folded
from .lineage import cut
from .review import classify_question

# Fields that collections must agree on, cues of questions, what a contract holds and how each field is mended.
FIELDS = ("question", "answer", "question_segment_ids", "answer_segment_ids", "question_start_us", "question_end_us", "answer_start_us", "answer_end_us", "question_speaker", "answer_speaker", "answer_expected", "question_answer_complete")
REFORMULATION = r"\b(?:quer dizer|ou melhor|reformulando|perguntando de outro jeito)\b"
OPEN_END = r"(?:\.\.\.|…|-)$|\b(?:tu|voce|voces|o|a|de|do|da|que|pra|para)\s*$"
SHORT_ASK = r"^(?:voce|voces|foi|tem|pode)\b"
SLACK_US = 10_000

_TYPES = {"question": "string", "answer": "string", "question_segment_ids": "array<string>", "answer_segment_ids": "array<string>", "question_start_us": "long", "question_end_us": "long", "answer_start_us": "long", "answer_end_us": "long", "question_speaker": "string", "answer_speaker": "string", "answer_expected": "boolean", "question_answer_complete": "boolean", "unresolved_reason": "string", "shared_terms": "int", "direct_marker": "boolean", "substantive": "boolean"}


def _long(df: DataFrame, order: int) -> DataFrame:
    """source_id, question_id, at (order, place), field, value of the audited fields that a collection has: JSON, so that null differs from absent."""
    own = [f for f in FIELDS if f in df.columns]
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v"))).alias("value")) for f in own)) if own else F.array().cast("array<struct<field:string,value:string>>")
    return df.select("source_id", "question_id", F.struct(F.lit(order).alias("order"), F.col("place").cast("long").alias("place")).alias("at"), F.explode_outer(pairs).alias("f")).select("source_id", "question_id", "at", "f.field", "f.value")


def qa_audit(collections: list[DataFrame], segments: DataFrame, exports: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """A case for each question id: source_id, question_id, recorded, conflicting_fields, categories, associated, expected, complete, reasons, shared_with, n_links, n_exports (null without exports).

    collections: tables of different columns with source_id, question_id, place and any of FIELDS, unresolved_reason, shared_terms, direct_marker, substantive; the first collection's first row
    is the record, and a field is in conflict where another row has it with another value (nulls equal). segments: source_id, segment_id, start_us, end_us, speaker, text. exports as a collection.
    links: source_id, question_id. Rows without an id are passed over; nulls in flags are unknown.
    """
    valid = [c.where("source_id is not null and question_id is not null") for c in collections]
    long = reduce(DataFrame.unionByName, [_long(c, k) for k, c in enumerate(valid)])
    first_at = long.groupBy("source_id", "question_id").agg(F.min("at").alias("first"))
    key = ["source_id", "question_id"]
    marked = long.join(first_at, key).where("field is not null")
    held = cut(marked.where("at = first").select(*key, "field", F.col("value").alias("own")))
    per = marked.join(held, [*key, "field"]).groupBy(*key, "field").agg(F.bool_or(F.col("value") != F.col("own")).alias("clash"))
    conflicts = per.where("clash").groupBy(*key).agg(F.array_sort(F.collect_set("field")).alias("conflicting_fields"))
    # the record itself, typed; columns that its collection lacks are null
    typed = [c.select(*key, F.struct(F.lit(k).alias("order"), F.col("place").cast("long").alias("place")).alias("at"), *((F.col(n) if n in c.columns else F.lit(None)).cast(t).alias(n) for n, t in _TYPES.items())) for k, c in enumerate(valid)]
    every = reduce(DataFrame.unionByName, typed)
    record = every.groupBy(*key).agg(F.min_by(F.struct(*_TYPES), "at").alias("r"), F.lit(True).alias("recorded")).select(*key, "recorded", "r.*")
    ids = record.select(*key)
    if links is not None:
        per_link = links.where("source_id is not null and question_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("n_links"))
        ids = ids.unionByName(per_link.select(*key))
    if exports is not None:
        e = exports.where("source_id is not null and question_id is not null")
        per_export = e.groupBy(*key).agg(F.count(F.lit(1)).alias("n_exports"))
        ids = ids.unionByName(per_export.select(*key))
        differs = _long(e, 0).where("field is not null").join(held, [*key, "field"]).groupBy(*key).agg(F.bool_or(F.col("value") != F.col("own")).alias("export_clash"))
    j = ids.distinct().join(record, key, "left").join(conflicts, key, "left")
    j = j.join(per_link, key, "left") if links is not None else j.withColumn("n_links", F.lit(None).cast("long"))
    j = j.join(per_export, key, "left").join(differs, key, "left") if exports is not None else j.withColumn("n_exports", F.lit(None).cast("long")).withColumn("export_clash", F.lit(None).cast("boolean"))
    j = j.withColumn("recorded", F.coalesce("recorded", F.lit(False))).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    j = classify_question(j.withColumnRenamed("answer_expected", "expected"), "question").withColumn("low", F.trim(folded(F.col("question")))).drop("answer_expected", "hook_type", "hook_strength")
    worded = F.coalesce(F.col("low") != "", F.lit(False))
    associated = (F.coalesce(F.col("answer"), F.lit("")) != "") & (F.coalesce(F.size("answer_segment_ids"), F.lit(0)) > 0)
    j = cut(j.withColumn("associated", F.when(F.col("recorded"), associated)))
    sides = reduce(DataFrame.unionByName, [_side(j, segments, s) for s in ("question", "answer")]).groupBy(*key).agg(F.flatten(F.collect_list("why")).alias("why"))
    j = j.join(sides, key, "left")
    is_, no = lambda c: F.coalesce(c, F.lit(False)), lambda c: ~F.coalesce(c, F.lit(False))
    kind, yes = F.when(worded, F.col("question_type")), is_(F.col("associated"))
    categories = [(is_(kind.isin("direct_question", "yes_no_question")), "direct_question_candidate"), (is_(kind.isin("rhetorical_question", "self_question")), "rhetorical_question_candidate"), (worded & F.col("low").rlike(sql_pattern(REFORMULATION)), "reformulation_cue"), (worded & F.col("low").rlike(sql_pattern(OPEN_END)), "truncated_phrase_cue"), (is_(F.col("expected")) & ~yes, "question_without_observed_answer_span"), (F.col("expected") == F.lit(False), "answer_not_expected")]
    reasons = [
        (~F.col("recorded"), F.lit("question_record_missing")),
        (F.col("conflicting_fields").isNotNull(), F.lit("source_record_conflict")),
        (F.col("n_exports") > 1, F.lit("duplicate_export_id")),
        (F.lit(exports is not None) & (F.col("n_links") > 0) & F.col("n_exports").isNull(), F.lit("candidate_reference_not_exported")),
        (is_(F.col("export_clash")), F.lit("export_record_conflict")),
        (worded & F.col("low").startswith("porque ") & ~F.col("low").contains("?"), F.lit("porque_without_question_mark_ambiguous")),
        (is_(kind == "banter") & F.col("low").contains("?") & F.col("low").rlike(sql_pattern(SHORT_ASK)), F.lit("short_interrogative_classified_as_banter")),
        (~worded, F.lit("question_text_unavailable")),
        (is_(F.col("expected")) & ~yes, F.coalesce("unresolved_reason", F.lit("no_observed_answer_span"))),
        (is_(F.col("question_answer_complete")), F.lit("heuristic_completeness_not_audio_verified")),
        (is_(F.col("question_answer_complete")) & ~yes, F.lit("complete_without_associated_answer")),
        (yes & is_(F.col("substantive")) & no(F.col("shared_terms") > 0) & no(F.col("direct_marker")), F.lit("substantive_turn_only_relevance")),
        (yes & (F.col("question_speaker").isNull() | F.col("answer_speaker").isNull()), F.lit("turn_ownership_unavailable")),
        (yes & (F.col("question_speaker") == F.col("answer_speaker")), F.lit("same_speaker_association")),
        (yes & (F.col("answer_start_us") < F.col("question_end_us")), F.lit("answer_precedes_question_end")),
    ]
    listed = lambda rules: F.array_compact(F.array(*(F.when(c, w) for c, w in rules)))
    # questions whose answers are the same segments
    span = Window.partitionBy("source_id", F.when(yes, F.to_json("answer_segment_ids")), yes)
    j = j.withColumn("sharers", F.when(yes, F.array_sort(F.collect_set("question_id").over(span))))
    shared = is_(F.size("sharers") > 1)
    none = F.array().cast("array<string>")
    out = F.array_sort(F.array_distinct(F.concat(listed([*reasons, (shared, F.lit("shared_answer_span"))]), F.coalesce("why", none))))
    return j.select(*key, "recorded", F.coalesce("conflicting_fields", none).alias("conflicting_fields"), listed([(c, F.lit(w)) for c, w in categories]).alias("categories"), "associated", "expected", F.col("question_answer_complete").alias("complete"), out.alias("reasons"), F.when(shared, F.col("sharers")).otherwise(none).alias("shared_with"), "n_links", F.when(F.lit(exports is not None), F.coalesce("n_exports", F.lit(0))).alias("n_exports"))


def _side(j: DataFrame, segments: DataFrame, side: str) -> DataFrame:
    """source_id, question_id, why: what a question's or an answer's segments say otherwise."""
    f = lambda x: f"{side}_{x}"
    active = j.where("recorded" if side == "question" else "associated").select("source_id", "question_id", F.coalesce(F.col(f("segment_ids")), F.array().cast("array<string>")).alias("ids"), F.col(f("start_us")).alias("t0"), F.col(f("end_us")).alias("t1"), F.col(f("speaker")).alias("voice"), F.col(side).alias("literal"))
    s = segments.groupBy("source_id", "segment_id").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("start_us", "end_us", "speaker", "text")).alias("s"))
    each = active.select("*", F.posexplode_outer("ids").alias("k", "segment_id")).join(s, ["source_id", "segment_id"], "left")
    g = each.groupBy("source_id", "question_id", "ids", "t0", "t1", "voice", "literal").agg(F.count_if(F.col("segment_id").isNotNull() & F.col("copies").isNull()).alias("lost"), F.count_if(F.col("copies") > 1).alias("vague"), F.count_if(F.col("copies") == 1).alias("found"), F.array_sort(F.collect_list(F.when(F.col("copies") == 1, F.struct("k", "s")))).alias("rows"))
    whole = (F.size("ids") > 0) & (F.col("found") == F.size("ids"))
    at = lambda i, x: F.try_element_at("rows", F.lit(i))["s"][x]
    unknown = F.col("t0").isNull() | F.col("t1").isNull() | at(1, "start_us").isNull() | at(-1, "end_us").isNull()
    off = (F.abs(F.col("t0") - at(1, "start_us")) > SLACK_US) | (F.abs(F.col("t1") - at(-1, "end_us")) > SLACK_US)
    mute = F.col("voice").isNull() | F.exists("rows", lambda r: r["s"]["speaker"].isNull())
    other = F.exists("rows", lambda r: r["s"]["speaker"] != F.col("voice"))
    observed = F.array_join(F.transform("rows", lambda r: F.coalesce(r["s"]["text"], F.lit(""))), " ")
    differs = squeeze(F.col("literal")) != squeeze(observed)
    rules = [(F.size("ids") == 0, "segment_ids_missing"), (F.col("lost") > 0, "segment_missing"), (F.col("vague") > 0, "segment_ambiguous"), (whole & unknown, "timestamp_unavailable"), (whole & F.coalesce(off, F.lit(False)), "timestamp_mismatch"), (whole & mute, "speaker_unavailable"), (whole & ~mute & other, "speaker_mismatch"), (whole & F.col("literal").isNull(), "text_unavailable"), (whole & differs, "text_mismatch")]
    return g.select("source_id", "question_id", F.array_compact(F.array(*(F.when(c, F.lit(f(w))) for c, w in rules))).alias("why"))


def qa_rates(cases: DataFrame) -> DataFrame:
    """source_id, rate, numerator, denominator, value (null without a denominator): association, heuristic completion and unresolved of the questions, exports of the linked ones (only if exports are known)."""
    yes, known = F.coalesce(F.col("associated"), F.lit(False)), F.col("recorded")
    expected = known & F.coalesce(F.col("expected"), F.lit(True))
    linked = F.col("n_links") > 0
    rates = [("association", expected & yes, expected), ("heuristic_completion", yes & F.coalesce(F.col("complete"), F.lit(False)), yes), ("unresolved", expected & ~yes, expected), ("candidate_reference_export_coverage", linked & (F.col("n_exports") > 0), linked & F.col("n_exports").isNotNull())]
    wide = cases.groupBy("source_id").agg(*(F.struct(F.lit(n).alias("rate"), F.count_if(a).alias("numerator"), F.count_if(b).alias("denominator")).alias(n) for n, a, b in rates), F.count("n_exports").alias("exports"))
    rows = wide.select("source_id", "exports", F.explode(F.array(*(n for n, *_ in rates))).alias("r")).where("exports > 0 or r.rate <> 'candidate_reference_export_coverage'")
    return rows.select("source_id", "r.*", F.round(F.try_divide(F.col("r.numerator").cast("double"), F.nullif(F.col("r.denominator"), F.lit(0)).cast("double")), 6).alias("value"))


# ---------------------------------------------------------------- contracts in free JSON

#: Of each collection: its list fields that are always there, those mended only if they are, and its object fields.
CONTRACT = {
    "topics": (("evidence_segment_ids", "speakers"), (), ()),
    "moments": (("evidence_segment_ids", "categories"), (), ("editorial",)),
    "questions_answers": ((), ("answer_segment_ids", "question_segment_ids", "evidence_segment_ids"), ()),
    "program_sections": (("topic_ids",), ("evidence_segment_ids",), ()),
}


def _kind(v: Column) -> Column:
    """What a VARIANT holds: null, object, list, string, number or bool."""
    t = F.schema_of_variant(v)
    return F.when(v.isNull() | (t == "VOID"), "null").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "list").when(t == "STRING", "string").when(t == "BOOLEAN", "bool").otherwise("number")


def sanitize_contract(df: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """Rows and diagnostics of a column of free JSON that should be an object of CONTRACT's collections and editorial_review.

    rows: key, collection, place, row (JSON of the object, damaged fields mended). diagnostics: key, path, expected, received, action. Rows that are
    no objects go, fields that are no lists become empty ones, fields that are no objects empty objects; a list of top moments becomes a review.
    A text that is no JSON, or no object, gives no rows. Missing collections are empty, and null counts as missing.
    """
    v = df.select(F.col(key).alias("key"), F.try_parse_json(F.col(json)).alias("v"))
    root = v.withColumn("kind", F.when(F.col("v").isNull(), "invalid").otherwise(_kind(F.col("v"))))
    bad_root = root.where("kind <> 'object'").select("key", F.lit("semantic").alias("path"), F.lit("object").alias("expected"), F.col("kind").alias("received"), F.lit("replaced_with_empty_contract").alias("action"))
    root = cut(root.where("kind = 'object'").select("key", "v"))
    get = lambda c, path: F.try_variant_get(c, path, "variant")
    names = F.array(*map(F.lit, CONTRACT))
    value = reduce(lambda a, n: a.when(F.col("collection") == n, get(F.col("v"), f"$.{n}")), CONTRACT, F)
    c = root.withColumn("collection", F.explode(names)).withColumn("c", value).withColumn("kind", _kind(F.col("c"))).drop("v")
    items = F.when(F.col("kind") == "list", F.col("c").cast("array<variant>"))
    each = c.select("key", "collection", F.posexplode(items).alias("k", "x")).withColumn("is", _kind(F.col("x")))
    n = each.groupBy("key", "collection").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is") == "object").alias("good"))
    c = c.select("key", "collection", "kind").join(n, ["key", "collection"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("good", F.coalesce("good", F.lit(0)))
    wrong = c.where("kind not in ('list', 'null') or good < n").select("key", F.concat(F.lit("semantic."), "collection").alias("path"), F.lit("list[object]").alias("expected"), F.col("kind").alias("received"), F.format_string("kept_%d_valid_objects", "good").alias("action"))
    # places among the valid objects
    rows = each.where("is = 'object'").withColumn("place", F.row_number().over(Window.partitionBy("key", "collection").orderBy("k")) - 1).drop("k", "is")
    fields = [(n, f, "list", need) for n, (always, ifany, _) in CONTRACT.items() for f, need in [*((a, True) for a in always), *((a, False) for a in ifany)]] + [(n, f, "object", True) for n, (_, _, objects) in CONTRACT.items() for f in objects]
    spec = F.array(*(F.struct(F.lit(n).alias("of"), F.lit(f).alias("field"), F.lit(t).alias("type"), F.lit(need).alias("always")) for n, f, t, need in fields))
    held = F.map_keys(F.col("x").cast("map<string,variant>"))
    f = rows.withColumn("s", F.explode(spec)).where("s.of = collection").withColumn("has", F.array_contains(held, F.col("s.field")))
    f = f.withColumn("fv", reduce(lambda a, n: a.when(F.col("s.field") == n, get(F.col("x"), f"$.{n}")), sorted({x[1] for x in fields}), F)).withColumn("fk", _kind(F.col("fv")))
    # an absent list that must be there becomes an empty one without a note; a null object is fine, a null list that is there is not
    fine = (F.col("fk") == F.col("s.type")) | ((F.col("s.type") == "object") & (F.col("fk") == "null")) | ~F.col("has")
    noted = f.where(~fine).select("key", F.format_string("semantic.%s[%d].%s", "collection", "place", "s.field").alias("path"), F.when(F.col("s.type") == "list", "list").otherwise("object|null").alias("expected"), F.col("fk").alias("received"), F.when(F.col("s.type") == "list", "replaced_with_empty_list").otherwise("replaced_with_empty_object").alias("action"))
    swap = F.when((F.col("fk") != F.col("s.type")) & (F.col("has") | F.col("s.always")), F.struct(F.col("s.field").alias("field"), F.when(F.col("s.type") == "list", "[]").otherwise("{}").alias("value")))
    swaps = f.groupBy("key", "collection", "place").agg(F.array_compact(F.collect_list(swap)).alias("swaps"))
    whole = F.transform(F.map_entries(F.col("x").cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("field"), F.to_json(e["value"]).alias("value")))
    r = rows.join(swaps, ["key", "collection", "place"], "left").withColumn("swaps", F.coalesce("swaps", F.array().cast("array<struct<field:string,value:string>>")))
    kept = F.filter(whole, lambda e: ~F.exists("swaps", lambda s: s["field"] == e["field"]))
    r = r.select("key", "collection", "place", _object(F.concat(kept, "swaps")).alias("row"))
    review, notes = _review(root, get)
    return r.unionByName(review), reduce(DataFrame.unionByName, [bad_root, wrong, noted, notes])


def _object(fields: Column) -> Column:
    """A JSON object of (field, value as JSON) in order of names."""
    text = F.array_join(F.transform(F.array_sort(fields), lambda e: F.concat(F.to_json(F.array(e["field"])).substr(F.lit(2), F.length(F.to_json(F.array(e["field"]))) - 2), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ",")
    return F.concat(F.lit("{"), text, F.lit("}"))


def _review(root: DataFrame, get) -> tuple[DataFrame, DataFrame]:
    """The review's top moments as rows of collection editorial_review, and what was mended."""
    v = root.withColumn("e", get(F.col("v"), "$.editorial_review")).withColumn("kind", _kind(F.col("e"))).drop("v")
    v = v.withColumn("top", F.when(F.col("kind") == "list", F.col("e")).when(F.col("kind") == "object", get(F.col("e"), "$.top_moments"))).withColumn("angles", F.when(F.col("kind") == "object", get(F.col("e"), "$.content_angles")))
    v = v.withColumn("tk", _kind(F.col("top"))).withColumn("ak", _kind(F.col("angles")))
    each = v.select("key", F.posexplode(F.when(F.col("tk") == "list", F.col("top").cast("array<variant>"))).alias("k", "x")).withColumn("good", _kind(F.col("x")) == "object")
    n = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("kept"))
    v = v.select("key", "kind", "tk", "ak").join(n, "key", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("kept", F.coalesce("kept", F.lit(0)))
    note = lambda c, path, expected, received, action: v.where(c).select("key", F.lit(path).alias("path"), F.lit(expected).alias("expected"), F.col(received).alias("received"), action.alias("action"))
    notes = [
        note("kind = 'list'", "semantic.editorial_review", "object|null", "kind", F.format_string("normalized_legacy_list_%d_rows", "kept")),
        note("kind = 'object' and (tk not in ('list', 'null') or kept < n)", "semantic.editorial_review.top_moments", "list[object]", "tk", F.format_string("kept_%d_valid_objects", "kept")),
        note("kind = 'object' and ak not in ('list', 'null')", "semantic.editorial_review.content_angles", "list", "ak", F.lit("replaced_with_empty_list")),
        note("kind not in ('list', 'object', 'null')", "semantic.editorial_review", "object|null", "kind", F.lit("omitted")),
    ]
    rows = each.where("good").select("key", F.lit("editorial_review").alias("collection"), (F.row_number().over(Window.partitionBy("key").orderBy("k")) - 1).alias("place"), _object(F.transform(F.map_entries(F.col("x").cast("map<string,variant>")), lambda e: F.struct(e["key"].alias("field"), F.to_json(e["value"]).alias("value")))).alias("row"))
    return rows, reduce(DataFrame.unionByName, notes)
