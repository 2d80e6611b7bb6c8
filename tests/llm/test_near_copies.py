"""Near copies that meet in crowded buckets only."""

import random

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("block", [3, 512])
def test_pairs_of_crowded_buckets_are_whole(spark, monkeypatch, block):
    """All texts lie in one crowded bucket of every band, half of each text is common to all: no pair is lost."""
    from timeweave.llm import near_copies

    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    common, rows = [word() for _ in range(60)], []
    for _ in range(15):
        base = common + [word() for _ in range(60)]
        # one word changes 5 of 116 shingles, two far from each other 10: similarity 0.917 and 0.841; three leave 0.770
        for places in ((), (70,), (80, 100), (65, 85, 110)):
            rows.append(" ".join(word() if k in places else w for k, w in enumerate(base)))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    signatures, prefix = near_copies._signatures, near_copies._by_prefix
    monkeypatch.setattr(near_copies, "_signatures", lambda d: signatures(d).withColumn("fp", F.col("same")).withColumn("bands", F.array_repeat(F.lit(7).cast("long"), near_copies.BANDS)))
    monkeypatch.setattr(near_copies, "_by_prefix", lambda *a: prefix(*a, block=block))
    got = sorted(x.doc_id for x in near_copies.drop(docs, bucket=4).collect())
    assert got == sorted([4 * k for k in range(15)] + [4 * k + 3 for k in range(15)])


def test_pairs_of_one_group_are_not_made(spark):
    """A large group and texts that share too little with it: rows follow the groups that can meet, not the square of the group."""
    from timeweave.llm import near_copies

    r = random.Random(3)
    base = [r.getrandbits(60) for _ in range(200)]
    # 120 texts of one group lack one shingle each; 20 texts of their own have 30 new ones (similarity below 0.75), one has 15 (0.86)
    texts = [(k, 0, [x for j, x in enumerate(base) if j != k]) for k in range(120)]
    texts += [(200 + k, 200 + k, [r.getrandbits(60) if j in range(k, k + n) else x for j, x in enumerate(base)]) for k, n in [*((k, 30) for k in range(20)), (50, 15)]]
    sets = spark.createDataFrame([(a, s, len(s)) for a, _, s in texts], "same long, shingles array<long>, n int")
    made, across = [], near_copies._across
    near_copies._across = lambda *a: made.append(across(*a).cache()) or made[0]
    try:
        found = {tuple(x) for x in near_copies._by_prefix(sets, spark.createDataFrame([t[:2] for t in texts], "same long, root long"), 0.8).collect()}
    finally:
        near_copies._across = across
    shared = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    links = {(a, b) for a, p, s in texts for b, q, t in texts if a < b and p != q and shared(s, t) >= 0.8}
    assert len(links) == 120 and links <= found
    assert made[0].where("x.same < 200 and y.same < 200").isEmpty()
    assert made[0].count() < 120 * 119 / 2
