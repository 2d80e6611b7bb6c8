"""Golden cases of the audit of questions and of contracts in free JSON."""

import json

from pyspark.sql import functions as F

from timeweave.operators import questions as op

S = 1_000_000


def test_every_reason_of_an_audit(spark):
    seg = spark.createDataFrame([(1, "q1", 0, S, "A", "quem veio?"), (1, "a1", S, 2 * S, "B", "a  banda"), (1, "a2", 2 * S, 3 * S, None, "toda"), (1, "dup", 0, 1, "A", "x"), (1, "dup", 0, 1, "A", "x")], "source_id long, segment_id string, start_us long, end_us long, speaker string, text string")
    rows = [
        (1, "ok", 0, "quem veio?", "a banda", ["q1"], ["a1"], 0, S, S, 2 * S, "A", "B", True, False, None),
        (1, "same", 1, "Quem veio?", "a banda", ["q1"], ["a1"], 0, S, S - 1, 2 * S + 20_000, "A", "A", True, True, None),
        (1, "lost", 2, "porque sim", None, ["zz"], None, 0, S, None, None, "A", None, True, True, "no_turn_after"),
        (1, "vague", 3, "você foi?", "x", ["dup"], ["a1", "a2"], None, S, S, 3 * S, "A", "B", None, None, None),
        (1, "bare", 4, None, "x", None, ["a2"], 0, S, 2 * S, 3 * S, None, "B", False, None, None),
        (None, "none", 5, "x", None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    qa = spark.createDataFrame(rows, "source_id long, question_id string, place long, question string, answer string, question_segment_ids array<string>, answer_segment_ids array<string>, question_start_us long, question_end_us long, answer_start_us long, answer_end_us long, question_speaker string, answer_speaker string, answer_expected boolean, question_answer_complete boolean, unresolved_reason string")
    more = spark.createDataFrame([(1, "ok", 0, "quem foi?", None), (1, "same", 0, "Quem veio?", "A"), (1, "new", 0, "tem mais?", None)], "source_id long, question_id string, place long, question string, question_speaker string")
    exports = spark.createDataFrame([(1, "ok", 0, "a banda"), (1, "same", 0, "outra"), (1, "same", 1, "a banda"), (1, "only", 0, "y")], "source_id long, question_id string, place long, answer string")
    links = spark.createDataFrame([(1, "ok"), (1, "lost"), (1, "lost")], "source_id long, question_id string")
    got = {r.question_id: r for r in op.qa_audit([qa, more], seg, exports, links).collect()}
    assert set(got) == {"ok", "same", "lost", "vague", "bare", "new", "only"}
    assert got["ok"].conflicting_fields == ["question", "question_speaker"] and got["same"].conflicting_fields == []
    assert got["ok"].reasons == ["shared_answer_span", "source_record_conflict"] and got["ok"].shared_with == ["ok", "same"]
    assert set(got["same"].reasons) == {"answer_precedes_question_end", "answer_speaker_mismatch", "answer_timestamp_mismatch", "duplicate_export_id", "export_record_conflict", "heuristic_completeness_not_audio_verified", "question_text_mismatch", "same_speaker_association", "shared_answer_span"}
    assert set(got["lost"].reasons) == {"candidate_reference_not_exported", "complete_without_associated_answer", "heuristic_completeness_not_audio_verified", "no_turn_after", "porque_without_question_mark_ambiguous", "question_segment_missing"}
    assert set(got["vague"].reasons) >= {"question_segment_ambiguous", "answer_speaker_unavailable", "answer_text_mismatch", "short_interrogative_classified_as_banter"} and got["vague"].associated
    assert set(got["bare"].reasons) == {"answer_speaker_unavailable", "answer_text_mismatch", "question_segment_ids_missing", "question_text_unavailable", "turn_ownership_unavailable"} and got["bare"].categories == ["answer_not_expected"]
    assert got["only"].reasons == ["question_record_missing", "question_text_unavailable"] and got["only"].associated is None
    rates = {r.rate: (r.numerator, r.denominator, r.value) for r in op.qa_rates(op.qa_audit([qa, more], seg, exports, links)).collect()}
    assert rates == {"association": (3, 5, 0.6), "heuristic_completion": (1, 4, 0.25), "unresolved": (2, 5, 0.4), "candidate_reference_export_coverage": (1, 2, 0.5)}
    plain = op.qa_rates(op.qa_audit([more.limit(0)], seg))
    assert plain.count() == 0 and op.qa_audit([more], seg).where("n_exports is not null").count() == 0


def contract(spark, *texts):
    rows, notes = op.sanitize_contract(spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumn("kind", F.lit("x")).withColumn("path", F.lit("x")), "id", "text")
    return {(r.key, r.collection, r.place): json.loads(r.row) for r in rows.collect()}, sorted((r.key, r.path, r.expected, r.received, r.action) for r in notes.collect())


def test_contracts_in_free_json(spark):
    whole = {"topics": [{"id": 1, "evidence_segment_ids": ["a"], "speakers": []}], "moments": [], "questions_answers": [{"id": "q\"1", "answer": None}], "editorial_review": {"top_moments": [{"m": 1}], "content_angles": []}, "other": 5}
    hurt = {"topics": {"a": 1}, "moments": [{"evidence_segment_ids": "x", "editorial": [1], "n": {"deep": [1, {"x": None}]}}, 7, [1], {"categories": None, "editorial": None}], "questions_answers": [{"answer_segment_ids": 4}], "program_sections": None, "editorial_review": [{"m": 1}, "x"]}
    odd = {"editorial_review": {"top_moments": "x", "content_angles": 4}, "topics": "t"}
    rows, notes = contract(spark, json.dumps(whole), json.dumps(hurt), "[1]", "{broken", None, json.dumps(odd), json.dumps({"editorial_review": 3}), "{}")
    assert {k: v for k, v in rows.items() if k[0] == 0} == {(0, "topics", 0): whole["topics"][0], (0, "questions_answers", 0): whole["questions_answers"][0], (0, "editorial_review", 0): {"m": 1}}
    assert {k: v for k, v in rows.items() if k[0] == 1} == {
        (1, "moments", 0): {"evidence_segment_ids": [], "categories": [], "editorial": {}, "n": {"deep": [1, {"x": None}]}},
        (1, "moments", 1): {"evidence_segment_ids": [], "categories": [], "editorial": {}},
        (1, "questions_answers", 0): {"answer_segment_ids": []},
        (1, "editorial_review", 0): {"m": 1},
    }
    assert set(rows) == {k for k in rows if k[0] < 2}
    assert notes == [
        (1, "semantic.editorial_review", "object|null", "list", "normalized_legacy_list_1_rows"),
        (1, "semantic.moments", "list[object]", "list", "kept_2_valid_objects"),
        (1, "semantic.moments[0].editorial", "object|null", "list", "replaced_with_empty_object"),
        (1, "semantic.moments[0].evidence_segment_ids", "list", "string", "replaced_with_empty_list"),
        (1, "semantic.moments[1].categories", "list", "null", "replaced_with_empty_list"),
        (1, "semantic.questions_answers[0].answer_segment_ids", "list", "number", "replaced_with_empty_list"),
        (1, "semantic.topics", "list[object]", "object", "kept_0_valid_objects"),
        (2, "semantic", "object", "list", "replaced_with_empty_contract"),
        (3, "semantic", "object", "invalid", "replaced_with_empty_contract"),
        (4, "semantic", "object", "invalid", "replaced_with_empty_contract"),
        (5, "semantic.editorial_review.content_angles", "list", "number", "replaced_with_empty_list"),
        (5, "semantic.editorial_review.top_moments", "list[object]", "string", "kept_0_valid_objects"),
        (5, "semantic.topics", "list[object]", "string", "kept_0_valid_objects"),
        (6, "semantic.editorial_review", "object|null", "number", "omitted"),
    ]
    assert contract(spark, "{}") == ({}, [])
