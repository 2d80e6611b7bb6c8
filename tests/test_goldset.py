"""Windows to annotate: golden cases, and the same as a plain greedy choice however many candidates a round takes."""

import random

import pytest

from timeweave.operators import goldset as op

S = 1_000_000
T, D = "source_id long, reason string, time_us long, n long", "source_id long, duration_us long, place long"


def plain(rows, duration, most, width):
    by = {}
    for _, reason, t, *_ in rows:
        if t is not None and 0 <= t < duration:
            by.setdefault(reason or "unknown", set()).add(t)
    queues = {k: sorted(v)[::2] + sorted(v)[1::2][::-1] for k, v in by.items()}
    picks = []
    while len(picks) < most and any(queues.values()):
        for k in sorted(queues):
            if queues[k] and len(picks) < most:
                t = queues[k].pop(0)
                a = max(0, min(t - width // 2, duration - width))
                b = min(duration, a + width)
                if not any(max(a, x) < min(b, y) for x, y, _ in picks):
                    picks.append((a, b, k))
    return sorted(picks)


@pytest.mark.parametrize("at_once, bucket", [(6, 7), (512, 600)])
def test_equals_a_plain_choice(spark, at_once, bucket):
    rng = random.Random(bucket + at_once)
    length = {1: 60 * S, 2: 300 * S, 3: 3 * S, 4: 40 * S}
    rows = [(s, rng.choice(["b", "a", None, "é"]), rng.randrange(-2 * S, d + 2 * S), k) for s, d in length.items() for k in range(60)]
    rows += [(4, "a", 5 * S, k) for k in range(50)]
    got = op.goldset_windows(spark.createDataFrame(rows, T), spark.createDataFrame([(s, d, 0) for s, d in length.items()], D), 12, 4 * S, at_once).collect()
    for s, d in length.items():
        mine = sorted((r.start_us, r.end_us, r.reason) for r in got if r.source_id == s)
        assert mine == plain([r for r in rows if r[0] == s], d, 12, 4 * S)
        assert {r.status for r in got if r.source_id == s} == {"READY_FOR_REVIEW" if len(mine) >= 10 else "PARTIAL"}


def test_turns_do_not_depend_on_buckets(spark):
    t = spark.createDataFrame([(1, "a", k * S, 0) for k in range(9)] + [(1, "a", 0, 1)], T)
    turns = lambda b: [r.time_us // S for r in op.interleaved(t, b * S).orderBy("turn").collect()]
    assert turns(600) == turns(2) == [0, 2, 4, 6, 8, 7, 5, 3, 1]


def test_nulls_empty_tables_and_wrong_bounds(spark):
    t = spark.createDataFrame([(1, None, None, 0), (2, "a", 5, 0), (None, "a", 5, 0), (3, "a", 5, 0)], T)
    d = spark.createDataFrame([(1, 100, 0), (2, 0, 0), (None, 9, 0)], D)
    assert op.goldset_windows(t, d).count() == 0 and op.goldset_windows(t.limit(0), d).count() == 0
    with pytest.raises(ValueError):
        op.goldset_windows(t, d, most=9)
