"""Tasks of the byte-level merges give their memory back."""

import pytest

from timeweave.llm import bpe, common

CALLS = {
    "encode": lambda d: bpe.encode_column(d, "ranks", "x"),
    "decode": lambda d: bpe.decode_column(d, "ranks", "x"),
    "digests": lambda d: bpe.digests(d, "ranks", "x", keep_ids=True),
}


@pytest.mark.parametrize("name", sorted(CALLS))
def test_memory_goes_back(spark, monkeypatch, name):
    frame = spark.createDataFrame([], "doc_id long, text string, ids array<int>")
    given, back = [], []
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, run, schema, **_: given.append(run) or self)
    monkeypatch.setattr(common, "_give_back", lambda: back.append(1))
    monkeypatch.setattr(bpe.Codec, "of", lambda *_: None)
    CALLS[name](frame)
    assert list(given[0](iter([]))) == [] and back == [1, 1]
