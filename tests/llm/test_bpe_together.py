"""Many pieces settle their prefixes together, and each comes to what it comes to alone."""

import random

import public_tokenizers
import pytest

from timeweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_pieces_are_settled_together(monkeypatch):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    r = random.Random(5)
    texts = {"".join(r.choices(["a", "th", "en", "ção", "ß", "\0", " ", "漢", "😀", "7", "\n", "er", "ing"], k=r.randint(1, 24))) for _ in range(4000)}
    texts |= {"a", "a\0", "a\0\0", "a" * 64, "\0", "é" * 64, "😀" * 64, " thhaeran", " thhaeranx"}
    texts = {t for t in texts if len(t) <= 64}
    alone = {t: codec.bpe.encode_piece(t.encode()) for t in texts}
    # before, each piece was appended byte by byte on its own
    monkeypatch.setattr(bpe.Bpe, "extend", lambda *_: pytest.fail("a piece is settled alone"))
    codec.pieces.learn(texts)
    assert dict(codec.pieces) == alone
    codec.pieces.clear()
    codec.pieces.learn(set())
    assert not codec.pieces


def test_bytes_that_no_token_holds():
    one = bpe.Bpe({bytes([b]): b for b in b"abc"} | {b"ab": 200})
    together = bpe._Together(one)
    assert together.encode([b"abc", b"ca"]) == [(200, 99), (99, 97)]
    with pytest.raises(ValueError, match="every byte"):
        together.encode([b"abx"])
