"""Golden cases of narrative units, closures and package checks."""

from pyspark.sql import functions as F

from timeweave.operators import narrative as op

S = 1_000_000
SEG = "source_id long, segment_id string, start_us long, end_us long, text string, speaker string, uncertain boolean, role string"
ARC = "source_id long, arc_id string, kind string, evidence array<string>, setup array<string>, payoff array<string>, climax array<string>, development array<string>, supported boolean"
CAND = "source_id long, candidate_id string, segment_ids array<string>, excluded boolean, verified boolean"


def segments(spark, rows):
    return spark.createDataFrame([(1, i, int(a * S), int(b * S), t, sp, None, "x") for i, a, b, t, sp in rows], SEG)


def arcs(spark, rows):
    return spark.createDataFrame([(1, i, "partial_story", e, p.get("setup"), p.get("payoff"), p.get("climax"), p.get("development"), None) for i, e, p in rows], ARC)


def test_units_break_at_roles_places_pauses_and_long_spans(spark):
    rows = [(f"s{k}", 10 * k, 10 * k + 9, f"text {k}.", "A") for k in range(10)]
    rows[2] = ("s2", 20, 21, "no mark", "B")  # then a pause of nine seconds
    rows[9] = ("s9", 90, 99, "isso acontece porque sim...", "A")
    s = segments(spark, rows)
    c = spark.createDataFrame([(1, "c", ["s1", "s1", "zz"], True, None)], CAND)
    a = arcs(spark, [("a", [f"s{k}" for k in (9, 8, 7, 6, 5, 4, 3, 2, 1, 0, 0)], {}), ("b", ["s0", "s2"], {"setup": ["s0"], "payoff": ["s2"]}), ("lost", ["s0", "zz"], {}), ("none", [], {})])
    got = {tuple(r.segment_ids): r for r in op.narrative_units(a, s, c).collect()}
    # a pause of nine seconds after s2; sixty seconds of s3..s9 are over before its explanation begins a run of its own
    assert set(got) == {("s0", "s1", "s2"), ("s3", "s4", "s5", "s6", "s7", "s8"), ("s9",), ("s0",), ("s2",)}
    assert got[("s9",)].role == "explanation" and "ending_requires_context_review" in got[("s9",)].blockers
    assert got[("s0",)].role == "setup" and got[("s2",)].role == "resolution" and got[("s2",)].arc_ids == ["b"]
    one = got[("s0", "s1", "s2")]
    assert one.eligibility == op.BLOCKED and one.candidate_ids == ["c"] and one.speakers == ["A", "B"] and "commercial_review_pending" in one.blockers


def test_long_runs_are_cut_only_at_a_sentence(spark):
    s = segments(spark, [(f"s{k:02}", 9 * k, 9 * k + 8, "open" if k < 8 else "done.", "A") for k in range(14)])
    got = [r.segment_ids for r in op.narrative_units(arcs(spark, [("a", [f"s{k:02}" for k in range(14)], {})]), s, spark.createDataFrame([], CAND)).orderBy("start_us").collect()]
    assert [len(x) for x in got] == [9, 5]  # over a minute after s06, but no sentence ends before s08


def test_closure_over_chains_diamonds_and_cycles(spark):
    e = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "x")] + [(f"n{k}", f"n{k + 1}") for k in range(6)]
    edges = spark.createDataFrame([(1, u, n) for u, n in e] + [(2, "a", "z")], "source_id long, unit_id string, needs string")
    starts = spark.createDataFrame([(1, "A", "a"), (1, "A", "a"), (1, "X", "x"), (1, "N", "n0"), (2, "A", "a"), (3, "O", "alone")], "source_id long, root string, unit_id string")
    got = {}
    for r in op.reachable(starts, edges).collect():
        got.setdefault((r.source_id, r.root), []).append(r.unit_id)
    assert {k: sorted(v) for k, v in got.items()} == {(1, "A"): list("abcde"), (1, "X"): ["x"], (1, "N"): [f"n{k}" for k in range(7)], (2, "A"): ["a", "z"], (3, "O"): ["alone"]}


def test_every_rule_of_a_package(spark):
    s = segments(spark, [(f"s{k}", 10 * k, 10 * k + 9, f"t{k}.", "A") for k in range(8)])
    c = spark.createDataFrame([(1, "c", ["s0"], False, True)], CAND)
    unit = lambda i, ids, lo, hi, text, cands=(), needs=(), approved=False: (1, i, ids, int(lo * S), int(hi * S), text, list(cands), list(needs), approved)
    u = [
        unit("ok", ["s0", "s1"], 0, 19, "t0. t1.", ["c"]), unit("ok2", ["s2"], 20, 29, "t2.", (), ["ok"]), unit("time", ["s3"], 39, 30, "t3."), unit("twice", ["s4", "s4"], 40, 49, "t4. t4."), unit("gap", ["s4", "s6"], 40, 69, "t4. t6."),
        unit("back", ["s5", "s4"], 50, 49, "t5. t4."), unit("text", ["s5"], 50, 59, "t6."), unit("cand", ["s6"], 60, 69, "t6.", ["zz"]), unit("self", ["s7"], 70, 79, "t7.", (), ["self", "zz"]), unit("null", None, 70, 79, None, (), (), True),
        unit("x", ["s1"], 10, 19, "t1.", (), ["z"]), unit("y", ["s1", "s2"], 10, 29, "t1. t2.", (), ["x"]), unit("z", ["s3", "s4"], 30, 49, "t3. t4.", (), ["y"]), unit("dup", ["s2"], 20, 29, "t2."), unit("dup", ["s3"], 30, 39, "t3."),
    ]
    us = spark.createDataFrame(u, "source_id long, unit_id string, segment_ids array<string>, start_us long, end_us long, literal string, candidate_ids array<string>, needs array<string>, approved boolean")
    seq = lambda i, units, required=(), complete=False, parts=((), (), ()), approved=False: (1, i, list(units), list(required), complete, *map(list, parts), approved)
    qs = [
        seq("good", ["ok", "ok2"], ["ok"], True, (["s0"], ["s1"], ["s2"])), seq("order", ["ok2", "ok"], ["ok"], True, (["s2"], ["s1"], ["s0"])), seq("outside", ["ok"], (), True, (["s0"], ["s1"], ["s2"])),
        seq("needs", ["ok2"]), seq("extra", ["ok"], ["ok2"]), seq("lost", ["zz"]), seq("none", []), seq("said", ["text"], (), False, ((), (), ()), True), seq("said2", ["text"]),
    ]
    q = spark.createDataFrame(qs, "source_id long, sequence_id string, unit_ids array<string>, required array<string>, complete boolean, setup array<string>, development array<string>, payoff array<string>, approved boolean")
    got = {(r.id, r.rule) for r in op.validate_package(us, q, s, c).collect()}
    assert got == {
        ("time", "invalid_unit_timestamp"), ("time", "unit_boundary_disagreement"), ("back", "invalid_unit_timestamp"), ("null", "unit_approval_unverified"), ("dup", "duplicate_unit_id"), ("dup", "duplicate_unit_source"), ("twice", "invalid_segment_reference"), ("null", "invalid_segment_reference"),
        ("gap", "unit_implicit_distant_montage"), ("back", "unit_implicit_distant_montage"), ("text", "unit_literal_source_disagreement"), ("cand", "unit_candidate_reference"), ("self", "unit_context_reference"), ("x", "cyclic_unit_context"),
        ("order", "sequence_completion_unsupported"), ("outside", "sequence_completion_unsupported"), ("outside", "duplicate_sequence_source"), ("needs", "sequence_missing_required_context"), ("extra", "sequence_missing_required_context"), ("lost", "sequence_unit_reference"), ("none", "sequence_unit_reference"), ("said", "sequence_approval_unverified"), ("said", "duplicate_sequence_source"), ("extra", "duplicate_sequence_source"),
    } - {("outside", "duplicate_sequence_source")}
    assert op.validate_package(us.limit(0), q.limit(0), s, c).count() == 0


def test_sequences_of_arcs_that_come_to_the_same(spark):
    s = segments(spark, [(f"s{k}", 10 * k, 10 * k + 9, f"t{k}.", "A") for k in range(4)])
    a = arcs(spark, [("a", ["s0", "s1"], {"setup": ["s0"], "payoff": ["s1"]}), ("b", ["s1"], {"payoff": ["s1"]}), ("c", ["s3"], {})])
    units = op.narrative_units(a, s, spark.createDataFrame([(1, "ad", ["s3"], True, True)], CAND))
    got = op.narrative_sequences(units, op.context_edges(units), a).collect()
    assert len(got) == 1 and got[0].arc_id == "a" and len(got[0].unit_ids) == 2 and len(got[0].required) == 1 and got[0].completeness == "partial_supported"
