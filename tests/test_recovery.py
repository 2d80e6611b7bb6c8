"""Recovered stories: golden cases, and the same rows however time is cut."""

import pytest
from pyspark.sql import functions as F

from timeweave.operators import recovery as op
from timeweave.plans.recovery import long_talks

S = 1_000_000
SEG = "source_id long, segment_id string, start_us long, end_us long, speaker string, text string, topic_ids array<string>, low string, stop string"


def segments(spark, rows):
    return spark.createDataFrame([(1, f"s{k}", int(a * S), int(b * S), sp, t, topics, "x", "y") for k, (a, b, sp, t, *rest) in enumerate(rows) for topics in [rest[0] if rest else None]], SEG)


STORY = [(0, 4, "A", "Um dia eu fui ao estúdio da banda"), (4, 9, "A", "e toquei guitarra"), (9, 13, "A", "mas tive um problema"), (13, 15, "B", "sério?"), (15, 19, "A", "esperei na porta"), (19, 23, "A", "no fim deu certo o disco da banda.")]


def one(spark, rows):
    return op.recover_arcs(segments(spark, rows)).collect()


def test_a_whole_story(spark):
    (r,) = one(spark, STORY + [(23, 30, "A", "outra coisa")])
    assert (r.kind, r.start_us, r.end_us, r.conflict_id, r.payoff_id, r.stop_reason) == ("complete_story", 0, 23 * S, "s2", "s5", None)
    assert r.setup_ids == ["s0", "s1"] and r.development_ids == ["s2", "s4"] and r.interruption_ids == ["s3"] and r.segment_ids == [f"s{k}" for k in range(6)]


@pytest.mark.parametrize("at, row, reason", [
    (4, (40, 44, "A", "esperei"), "story_pause_exceeds_window"),
    (3, (13, 26, "B", "uma resposta longa"), "long_speaker_interruption"),
    (3, (13, 15, None, "quem?"), "missing_speaker_evidence"),
    (4, (15, 19, "A", "mudando de assunto"), "topic_change_observed"),
    (5, (19, 23, "A", "consegui voar"), "outcome_continuity_unresolved"),
    (5, (19, 23, "A", "será que deu certo o disco da banda"), "outcome_not_observed"),
])
def test_why_a_story_stays_open(spark, at, row, reason):
    rows = [*STORY]
    rows[at] = row
    rows = rows[: at + 1]
    got = one(spark, rows)
    assert [(r.kind, r.payoff_id, r.stop_reason) for r in got] == [("partial_story", None, reason)]


def test_topics_and_long_stories(spark):
    jump = [(*r, ["t1"] if k < 4 else ["t2"]) for k, r in enumerate(STORY)]
    assert [r.stop_reason for r in one(spark, jump)] == ["cross_chunk_continuity_unresolved"]
    kept = [*jump[:4], (15, 19, "A", "voltei ao estúdio", ["t2"]), jump[5]]
    assert [(r.kind, r.topic_id) for r in one(spark, kept)] == [("complete_story", "t1")]
    slow = [STORY[0], STORY[2]] + [(14 + 12 * k, 25 + 12 * k, "A", f"palavra{k}") for k in range(40)]
    assert [r.stop_reason for r in one(spark, slow)] == ["story_time_window_exhausted"]


def test_what_is_left_out(spark):
    assert one(spark, [STORY[0], STORY[4]]) == []  # no conflict
    assert one(spark, [(a, b, "A" if k in (0, 2) else "B", t) for k, (a, b, _, t) in enumerate(STORY[:5])]) == []  # the voice has too small a share
    assert one(spark, [(0, 2, "A", STORY[0][3]), (2, 4, "A", "x"), (6.5, 7, "A", "mas não")]) == []  # too short
    sold = [*STORY[:4], (15, 19, "A", "compre agora na loja com desconto, parcelas em 10 vezes sem juros no pix"), STORY[5]]
    assert one(spark, sold) == []
    assert op.recover_arcs(segments(spark, STORY).limit(0)).count() == 0
    inner = one(spark, [*STORY[:5], (19, 22, "A", "eu tentei"), (22, 25, "A", "mas caiu"), (25, 29, "A", "no fim deu certo o disco da banda.")])
    assert len(inner) == 1  # the story that begins inside the first ends with it


@pytest.mark.parametrize("bucket", [37, 400, 100_000])
def test_the_same_however_time_is_cut(spark, bucket):
    s = long_talks(spark, "/root/testdata/sf0.01").where("source_id < 6")
    rows = lambda b: sorted(map(repr, op.recover_arcs(s, bucket_us=b * S).collect()))
    want = rows(600)
    assert rows(bucket) == want and len(want) > 5
