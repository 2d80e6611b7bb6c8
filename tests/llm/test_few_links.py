"""Few links are joined by one task in one pass, many by rounds of joins; both give the same components."""

import numpy as np

from timeweave.llm import components


def test_few_links_make_one_pass_and_the_same_components(spark, monkeypatch):
    r = np.random.default_rng(2)
    chain = [(k, k + 1) for k in range(1_000, 1_200)]
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 400, (250, 2))] + chain[::-1] + [(-5, 7), (9, 9)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    calls = []
    star = components._star
    monkeypatch.setattr(components, "_star", lambda *a, **k: calls.append(1) or star(*a, **k))
    few = sorted((x.node, x.root) for x in components.connected_components(edges).collect())
    assert not calls
    monkeypatch.setattr(components, "FEW", 0)
    assert few == sorted((x.node, x.root) for x in components.connected_components(edges).collect()) and calls
