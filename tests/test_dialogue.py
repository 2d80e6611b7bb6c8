"""Questions and answers over several turns, and what context and reactions hide: golden cases, and the same rows however time is cut."""

import pytest

from timeweave.operators import dialogue as op
from timeweave.plans.dialogue import talks

S = 1_000_000
SEG = "source_id long, segment_id string, start_us long, end_us long, speaker string, text string, kind string, r string"


def segments(spark, rows):
    return spark.createDataFrame([(1, f"s{k}", int(a * S), int(b * S), sp, t, "x", "y") for k, (a, b, sp, t) in enumerate(rows)], SEG)


def read(spark, rows):
    return {r.question_id: r for r in op.read_answers(segments(spark, rows)).collect()}


ASK, TELL = (0, 4, "A", "Como começou a gravação do disco?"), (5, 9, "B", "A gravação começou em casa,")


def test_an_answer_of_several_turns(spark):
    rows = [ASK, (4.5, 5, "B", "ahn"), (5, 9, "B", "A gravação começou em casa"), (9, 10, "A", "Sério?"), (10, 14, "B", "e gravamos o disco todo."), (15, 18, "C", "Retomando, o disco saiu bem."), (19, 22, "A", "Mudando de assunto")]
    r = read(spark, rows)["s0"]
    assert (r.kind, r.status, r.reason, r.complete) == ("direct_question", "linked_candidate", "topic_change_observed", False)
    assert r.answer_ids == ["s2", "s4", "s5"] and r.answer_speakers == ["B", "C"] and r.remark_ids == ["s1", "s3"]
    assert (r.answer_start_us, r.answer_end_us) == (5 * S, 18 * S)
    r = read(spark, rows[:5])["s0"]
    assert (r.reason, r.complete, r.answer_ids) == (None, True, ["s2", "s4"])


def test_parts_and_clarifications(spark):
    rows = [ASK, (4.5, 6, "A", "e como foi?"), (7, 9, "B", "Como assim?"), (10, 13, "A", "O estúdio e o disco."), (14, 18, "B", "O estúdio era pequeno.")]
    r = read(spark, rows)["s0"]
    assert r.question_ids == ["s0", "s1"] and r.question_end_us == 6 * S and r.remark_ids == ["s2", "s3"] and r.answer_ids == ["s4"] and r.complete
    rows[4] = (14, 18, "C", "O estúdio era pequeno.")
    assert read(spark, rows)["s0"].reason == "clarification_speaker_changed"


@pytest.mark.parametrize("rows, reason, ids", [
    ([ASK, (15, 19, "B", TELL[3])], "pause_exceeds_search_window", []),
    ([ASK, (5, 130, "B", TELL[3])], "answer_search_window_exhausted", []),
    ([ASK, (5, 9, "", TELL[3])], "missing_speaker_evidence", []),
    ([ASK, (5, 9, "B", "Choveu ontem.")], "answer_relevance_unresolved", []),
    ([ASK, (5, 9, "A", "Choveu ontem.")], "intervention_relevance_unresolved", []),
    ([ASK, (5, 9, "A", "Quem veio?")], "new_question_before_answer", []),
    ([ASK, (5, 9, "B", "Quem veio ontem?")], "new_question_before_answer", []),
    ([ASK], "no_subsequent_answer_span", []),
    ([ASK, TELL, (10, 11, "A", "Nossa!")], "answer_resume_not_observed", ["s1"]),
    ([ASK, TELL, (10, 14, "C", "Choveu ontem.")], "third_speaker_intervention_unresolved", ["s1"]),
    ([ASK, TELL, (10, 14, "B", "Choveu ontem.")], "answer_continuation_unresolved", ["s1"]),
    ([ASK, TELL, (10, 14, "B", "Quem veio ontem?")], "new_question_during_answer", ["s1"]),
    ([ASK, TELL, (30, 34, "B", "e o disco saiu.")], "pause_exceeds_search_window", ["s1"]),
    ([ASK, TELL, *((20 + 15 * k, 25 + 15 * k, "A", "nossa") for k in range(3)), (65, 70, "B", "o disco saiu.")], "pause_exceeds_resume_window", ["s1"]),
    ([ASK, TELL, *((10 + k, 11 + k, "B", "o disco") for k in range(40))], "answer_segment_search_limit", None),
])
def test_why_a_search_ends(spark, rows, reason, ids):
    r = read(spark, rows)["s0"]
    assert r.reason == reason
    assert r.answer_ids == ids if ids is not None else len(r.answer_ids) == 32
    assert r.status == ("linked_candidate" if r.answer_ids else "unresolved")


def test_cues_of_first_answers(spark):
    cue = lambda q, a: read(spark, [(0, 3, "A", q), (4, 8, "B", a)])["s0"].cue
    assert cue("Você foi ao mercado?", "Sim, fui.") == "polar_response_cue" and cue("Quando chegou a encomenda?", "No dia seguinte.") == "temporal_response_cue"
    assert cue("O que aconteceu na carreira?", "Eu comecei cedo.") == "experience_response_cue" and cue("Por que parou?", "Pois choveu.") == "causal_response_cue"
    assert cue("Onde mora?", "Sim, moro.") == "polar_response_cue" and cue("Onde mora seu irmão?", "Sim.") is None


def test_the_answer_to_a_why_is_no_question(spark):
    rows = [(5 * k, 5 * k + 4, "AB"[k % 2], t) for k, t in enumerate(["Por que a banda parou?", "porque choveu", "porque ventou", "porque nevou", "porque gelou"])]
    assert sorted(read(spark, rows)) == ["s0", "s2", "s4"]


def test_context_and_reactions_are_folded_in(spark):
    rows = [ASK, (4.5, 8, "A", "Falo do disco e da gravação."), (9, 12, "B", "Que legal!"), (13, 17, "B", "A gravação começou em casa.")]
    s = segments(spark, rows)
    pairs = op.read_answers(s)
    assert {r.question_id: r.status for r in pairs.collect()} == {"s0": "unresolved"}
    (r,) = op.recover_dialogue(s, pairs).collect()
    assert (r.recovered, r.status, r.reason, r.complete) == (True, "linked_candidate", None, True)
    assert r.question_ids == ["s0", "s1"] and r.question_end_us == 8 * S and r.context_ids == ["s1"] and r.reaction_ids == ["s2"] and r.remark_ids == ["s2"] and r.answer_ids == ["s3"]
    late = op.recover_dialogue(segments(spark, [*rows, (128, 131, "C", "fim")]), pairs).first()
    assert (late.recovered, late.reason, late.complete) == (True, "answer_search_window_exhausted", False)


@pytest.mark.parametrize("rows, tried", [
    ([(0, 4, "A", "Você resolveu o problema do disco?"), (5, 9, "B", "Certo."), (10, 14, "C", "Resolvi o problema do disco.")], "polar_reaction_response_ownership_ambiguous"),
    ([ASK, (5, 9, "B", "Sério?"), (10, 14, "B", "Choveu ontem.")], "answer_relevance_unresolved"),
    ([ASK, (5, 9, "B", "Sério?"), (8, 14, "B", "A gravação começou cedo.")], "no_subsequent_answer_span"),
    ([ASK, (5, 9, "B", "Sério?")], "no_subsequent_answer_span"),
    ([ASK, (5, 9, "B", "Choveu ontem.")], None),
])
def test_what_stays_open(spark, rows, tried):
    s = segments(spark, rows)
    r = op.recover_dialogue(s, op.read_answers(s)).where("question_id = 's0'").first()
    assert (r.recovered, r.status, r.tried) == (False, "unresolved", tried)


def test_repeated_ids_nulls_and_empty_tables(spark):
    rows = [ASK, (5, 9, "B", "Sério?"), (10, 14, "B", "A gravação começou cedo.")]
    s = segments(spark, rows)
    assert op.recover_dialogue(s, op.read_answers(s)).where("recovered").count() == 1
    twice = s.unionByName(s.where("segment_id = 's2'"))
    assert not op.recover_dialogue(twice, op.read_answers(twice)).where("recovered").count()
    odd = spark.createDataFrame([(None, "a", 0, 1, "A", "quem?", "", ""), (1, None, 0, 1, "A", "quem?", "", ""), (1, "b", None, 1, "A", "quem?", "", ""), (1, "c", 0, 1, None, None, None, None), (1, "d", 2, 3, None, "Quem veio ontem?", None, None)], SEG)
    (r,) = op.read_answers(odd).collect()
    assert (r.question_id, r.reason, r.answer_ids) == ("d", "missing_speaker_evidence", [])
    empty = s.limit(0)
    assert op.recover_dialogue(empty, op.read_answers(empty)).count() == 0


def test_the_same_however_time_is_cut(spark):
    s = talks(spark, "/root/testdata/sf0.01").where("source_id < 4").checkpoint()
    rows = lambda b: sorted(map(repr, op.recover_dialogue(s, op.read_answers(s, b * S), b * S).collect()))
    want = rows(600)
    assert rows(11) == want and len(want) > 50
