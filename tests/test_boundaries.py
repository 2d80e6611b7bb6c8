"""Edges of clips: each widening, each risk that undoes it, each reason that keeps a clip pending."""

import pytest

from timeweave.operators import boundaries as op

S = 1_000_000
SEG = "source_id long, segment_id string, start_us long, end_us long, speaker string, text string, pos long, low string"
MOM = "source_id long, moment_id string, start_us long, end_us long, segment_ids array<string>, context string, topic_start_us long, topic_end_us long"
QUE = "source_id long, question_id string, question_start_us long, question_end_us long, answer_start_us long, answer_end_us long, complete boolean, segment_ids array<string>"
ROWS = [(0, 9, "A", "Comprei um disco."), (10, 19, "A", "Ele tocou bem."), (20, 29, "B", "Quem gravou?"), (30, 39, "A", "A banda gravou"), (40, 49, "A", "Toda a noite."), (50, 59, "B", "Fim da história.")]


def run(spark, rows=ROWS, moment=(10, 19, ["s1"], "none", None, None), stories=(), questions=(), **settings):
    seg = spark.createDataFrame([(1, f"s{k}", int(a * S), int(b * S), sp, t, -1, "x") for k, (a, b, sp, t) in enumerate(rows)], SEG)
    a, b, ids, context, t0, t1 = moment
    us = lambda x: None if x is None else int(x * S)
    m = spark.createDataFrame([(1, "m", us(a), us(b), ids, context, us(t0), us(t1))], MOM)
    st = spark.createDataFrame([(1, "m", us(x), us(y), ok) for x, y, ok in stories], "source_id long, moment_id string, story_start_us long, story_end_us long, supported boolean")
    q = spark.createDataFrame([(1, i, us(w), us(x), us(y), us(z), c, e) for i, w, x, y, z, c, e in questions], QUE)
    (r,) = op.optimize_boundaries(m, seg, st, q, **settings).collect()
    return r


def test_widenings(spark):
    r = run(spark)  # it opens with a pronoun: the segment before comes in
    assert (r.start_us, r.end_us, r.decision, r.segment_ids, r.added_before_us) == (0, 19 * S, "expand", ["s0", "s1"], 10 * S) and r.clean_opening and r.clean_ending
    r = run(spark, moment=(30, 39, ["s3"], "none", None, None))  # it ends in the middle of a sentence
    assert (r.start_us, r.end_us, r.added_after_us) == (30 * S, 49 * S, 10 * S)
    assert run(spark, moment=(20, 29, ["s2"], "helpful", None, None)).start_us == 10 * S
    r = run(spark, moment=(20, 29, None, "none", None, None), stories=[(0, 59, True)])
    assert (r.start_us, r.end_us, r.decision) == (0, 59 * S, "expand")
    assert run(spark, moment=(20, 29, ["s2"], "none", None, None), stories=[(0, 59, False), (0, 25, True)]).decision == "cut"
    r = run(spark, moment=(40, 49, ["s4"], "none", None, None), questions=[("q", 20, 29, 30, 49, True, ["s2", "s3", "s4"])])
    assert (r.start_us, r.end_us, r.question_ids, r.decision, r.blockers) == (20 * S, 49 * S, ["q"], "expand", [])
    far = ("q", 20, 29, 30, 49, True, ["s2", "zz"])
    r = run(spark, moment=(40, 49, ["s4"], "none", None, None), questions=[far])
    assert r.question_ids == [] and set(r.blockers) == {"question_answer_unit_incomplete", "question_before_clip"} and r.clean_opening is False


@pytest.mark.parametrize("change, moment, risk", [
    ({}, (10, 19, ["s1"], "none", 10, 60), "topic_boundary_crossed"),
    ({1: (10, 19, "A", "Ele disse: compre agora na loja com desconto de 20 reais.")}, (10, 19, ["s1"], "none", None, None), "commercial_boundary_crossed"),
    ({0: (0, 9, "A", "Compre agora na loja com desconto de 20 reais.")}, (10, 19, ["s1"], "none", None, None), "commercial_boundary_crossed"),
    ({1: (10, 19, "A", "Mas mudando de assunto.")}, (10, 19, ["s1"], "none", None, None), "explicit_topic_transition_crossed"),
    ({0: (0, 4, "A", "Comprei um disco.")}, (10, 19, ["s1"], "none", None, None), "context_gap_requires_review"),
    ({}, (9, 19, ["s2"], "none", None, None), "source_ids_do_not_cover_original"),
])
def test_risks_put_the_edges_back(spark, change, moment, risk):
    rows = [change.get(k, r) for k, r in enumerate(ROWS)]
    r = run(spark, rows, moment)
    assert r.risks == [risk] and risk in r.blockers and r.decision == "pending" and (r.start_us, r.end_us) == (int(moment[0] * S), int(moment[1] * S))


def test_other_reasons(spark):
    assert run(spark, stories=[(0, 59, True)], most_us=60 * S).decision == "expand"
    long = run(spark, moment=(10, 59, ["s1", "s5"], "none", None, None), most_us=55 * S)
    assert long.risks == ["duration_budget_exceeded"] and (long.proposed_start_us, long.start_us) == (0, 10 * S)
    short = run(spark, [(0, 5, "A", "Um disco.")], (0, 5, ["s0"], "required", None, None))
    assert short.blockers == ["below_hard_min_without_complete_unit_proof", "context_requirement_unresolved"]
    none = run(spark, moment=(100, 110, ["zz"], "none", None, None))
    assert (none.decision, none.blockers, none.clean_opening, none.segment_ids, none.proposed_start_us) == ("pending", ["missing_segment_evidence"], None, [], None)
    mute = run(spark, [(0, 9, "A", None)], (0, 9, ["s0"], "none", None, None))
    assert mute.clean_opening is None and mute.clean_ending is None and mute.blockers == ["missing_text"]
    unheard = run(spark, [(0, 9, "A", "(inaudível) disse.")], (0, 9, ["s0"], "none", None, None))
    assert unheard.clean_opening is None and unheard.blockers == ["asr_text_unresolved"]


def test_edges_of_segments(spark):
    rows = [(0, 4, "A", "sem fim"), (4, 8, "A", "Continuo."), (7, 9, "B", "tudo bem, vamos que"), (9, 12, "B", "e então..."), (13, 15, "A", " ")]
    seg = spark.createDataFrame([(1, f"s{k}", int(a * S), int(b * S), sp, t, -1, "x") for k, (a, b, sp, t) in enumerate(rows)], SEG)
    got = {r.segment_id: (r.opening, r.ending == []) for r in op.edge_quality(seg.drop("pos", "low")).collect()}
    assert got == {"s0": ([], False), "s1": (["mid_sentence"], True), "s2": (["generic_preamble"], False), "s3": (["missing_antecedent_or_continuation", "mid_sentence"], False), "s4": (["missing_text"], False)}
