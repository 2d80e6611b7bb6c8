"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last of the prefix's encoding; that token is stored. A token
that ends a prefix is the valid one if it and the last token before it stay apart when their bytes are merged. So bytes
can be appended without encoding anew, and after an edit only the prefixes near it change.

A null text is empty: no tokens. Every row stands for itself, so repeated rows and ties give repeated rows; an empty table gives none. A
text of any length is encoded whole, piece by piece. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Encoded pieces that a worker keeps; beyond it the store starts anew. It only saves time.
KEPT_PIECES = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


class Bpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        #: finds all tokens that end at each byte, the longest first
        self.ending = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.ending.add_word(t.decode("latin-1"), r)
        self.ending.make_automaton()
        #: whether two tokens stay apart, as far as known; it only saves time
        self.known: dict[int, bool] = {}
        self.longest = max(map(len, ranks))
        #: the two tokens whose merge makes each token; one of a single byte stays itself
        self.halves = {r: self._halves(t) for t, r in ranks.items()}

    def _halves(self, token: bytes) -> tuple[int, int]:
        parts = self._merge(token, 2)
        return (self.ranks[parts[0]], self.ranks[parts[-1]]) if len(parts) == 2 else (self.ranks[token],) * 2

    def _merge(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Merges by lowest rank, leftmost first, down to `until` parts. It serves the tables and long whole tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            best, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes, side by side, leave both as they are.

        Undo the latest merge at the border, again and again. What then touches the border is what touched it before that
        merge; had the two there a token together of an earlier rank than the merge undone last, they would have been merged.
        """
        ranks, text, halves, before = self.ranks, self.bytes_of, self.halves, 1 << 60
        while True:
            if ranks.get(text[a] + text[b], before) < before:
                return False
            one_a, one_b = len(text[a]) == 1, len(text[b]) == 1
            if one_a and one_b:
                return True
            if one_b or not one_a and a > b:  # of equal ranks the left one was merged first, so b is undone first
                before, a = a, halves[a][1]
            else:
                before, b = b + 1, halves[b][0]

    def extend(self, piece: bytes, last: list[int], to: int | None = None) -> None:
        """Appends to `last`, the last tokens of piece's shorter prefixes, those of the prefixes of up to `to` bytes."""
        size, known, settled = self.size, self.known, len(last) - 1
        if len(known) > KEPT_PIECES:
            known.clear()
        to = len(piece) if to is None else to
        lo = max(0, settled + 1 - self.longest)
        for end, t in self.ending.iter(piece[lo:to].decode("latin-1")):
            if (end := end + lo) == settled:
                if (n := size[t]) <= end:
                    pair = last[end + 1 - n] << 32 | t
                    if (apart := known.get(pair)) is None:
                        apart = known[pair] = self.stay_apart(pair >> 32, t)
                    if not apart:
                        continue
                last.append(t)
                settled += 1
        if settled != to:
            raise ValueError("the ranks do not hold every byte")

    def prefixes(self, piece: bytes) -> Prefixes:
        return Prefixes(self, piece)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """As the merges would; a piece that is a token as a whole is that token."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        return self.prefixes(piece).tokens()


class Prefixes:
    """The last token of every prefix of a byte string. Bytes may be appended or replaced."""

    def __init__(self, bpe: Bpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """piece[start:end] becomes new. Returns how many prefixes were settled anew: those up to where the old and new agree again."""
        old, shift = self.last, len(new) - (end - start)
        self.piece = self.piece[:start] + new + self.piece[end:]
        self.last, agree, edited = old[: start + 1], 0, start + len(new)
        for i in range(start + 1, len(self.piece) + 1):
            self.bpe.extend(self.piece, self.last, i)
            # a run of equal last tokens, as long as the longest token, behind the edit fixes all that follow
            agree = agree + 1 if i > edited and self.last[i] == old[i - shift] else 0
            if agree >= self.bpe.longest:
                self.last += old[i - shift + 1 :]
                return i - start
        return len(self.piece) - start

    def tokens(self) -> tuple[int, ...]:
        out, i = [], len(self.piece)
        while i:
            out.append(self.last[i])
            i -= self.bpe.size[self.last[i]]
        return tuple(reversed(out))


class _Places:
    """Keys of 64 bits to numbers, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            slots, one = np.unique(at[left], return_index=True)
            one = left[one[self.keys[slots] == -1]]
            self.keys[at[one]], self.values[at[one]] = keys[one], values[one]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.last

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of the keys, -1 for those that are not there."""
        at = self._first(keys)
        out, left = self.values[at], np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.last
            out[left] = self.values[at[left]]
            left = left[(self.keys[at[left]] != keys[left]) & (self.keys[at[left]] != -1)]
        # a slot that holds nothing has the number -1
        return out


class _Together:
    """Settles the prefixes of many pieces at once, one more byte of all of them in each step."""

    def __init__(self, bpe: Bpe):
        self.bpe, ranks = bpe, bpe.ranks
        # beginnings of tokens by length: where a byte leads, the longest beginning at each one's end, the longest token there
        begun = {b"": 0}
        for n in range(1, bpe.longest + 1):
            for t in {t[:n] for t in ranks if len(t) >= n}:
                begun[t] = len(begun)
        keys = np.array([begun[t[:-1]] << 8 | t[-1] for t in begun if t], np.int64)
        self.leads = _Places(keys, np.arange(1, len(begun), dtype=np.int32), max(10, (2 * len(begun)).bit_length()))
        self.inner, self.ending = np.zeros(len(begun), np.int32), np.full(len(begun), -1, np.int32)
        most = max(ranks.values()) + 1
        self.size, self.shorter = np.zeros(most, np.int32), np.full(most, -1, np.int32)
        for t, i in begun.items():
            if t:
                k = next((begun[t[x:]] for x in range(1, len(t)) if t[x:] in begun), 0)
                self.inner[i], self.ending[i] = k, ranks.get(t, self.ending[k])
                if t in ranks:
                    self.size[ranks[t]], self.shorter[ranks[t]] = len(t), self.ending[k]
        #: pairs known to stay apart or not, each at its place, with the answer as the lowest bit; it only saves time
        self.known = np.full(1 << 20, -1, np.int64)

    def _apart(self, a: np.ndarray, t: np.ndarray) -> np.ndarray:
        """stay_apart of each two tokens."""
        pair = a.astype(np.int64) << 32 | t
        at = (a * np.int64(40503) + t) & (len(self.known) - 1)
        x = self.known[at]
        new = np.flatnonzero(x >> 1 != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            told = np.array([p << 1 | self.bpe.stay_apart(p >> 32, p & 0xFFFFFFFF) for p in asked.tolist()], np.int64)
            x[new] = told[back]
            self.known[at[new]] = x[new]
        return (x & 1).astype(bool)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece; none is empty. They are sorted: each goes on from the prefix that it shares with the one before it."""
        n, length = len(pieces), np.array([len(x) for x in pieces])
        wide = int(length.max())
        chars = np.zeros((n, wide), np.uint8)
        chars[np.arange(wide) < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        differ = chars[1:] != chars[:-1]
        same = np.zeros(n, np.int64)
        same[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), wide), np.minimum(length[1:], length[:-1]))
        # the row where each prefix of a row stands
        rows = np.arange(n, dtype=np.int32)
        row = np.maximum.accumulate(np.where(np.arange(wide + 1) > same[:, None], rows[:, None], 0), axis=0)
        last, states = np.full((n, wide + 1), -1, np.int32), np.zeros((n, wide + 1), np.int32)
        for end in range(1, wide + 1):
            own = np.flatnonzero((length >= end) & (same < end))
            state, byte = states[row[own, end - 1], end - 1].astype(np.int64), chars[own, end - 1]
            to = self.leads.find(state << 8 | byte)
            left = np.flatnonzero((to < 0) & (state > 0))
            while len(left):
                state[left] = self.inner[state[left]]
                to[left] = self.leads.find(state[left] << 8 | byte[left])
                left = left[(to[left] < 0) & (state[left] > 0)]
            states[own, end] = np.maximum(to, 0)
            token = np.where(to < 0, -1, self.ending[np.maximum(to, 0)])
            left = np.arange(len(own))
            while True:
                if (token[left] < 0).any():
                    raise ValueError("the ranks do not hold every byte")
                at = end - self.size[token[left]]
                left, at = left[at > 0], at[at > 0]
                left = left[~self._apart(last[row[own[left], at], at], token[left])]
                if not len(left):
                    break
                token[left] = self.shorter[token[left]]
            last[own, end] = token
        steps, at, left = [], length.copy(), rows
        while len(left):
            token = last[row[left, at[left]], at[left]]
            steps.append((left, token))
            at[left] -= self.size[token]
            left = left[at[left] > 0]
        many = np.bincount(np.concatenate([x for x, _ in steps]), minlength=n)
        ends = np.cumsum(many)
        ids = np.empty(int(ends[-1]), np.int32)
        for k, (x, token) in enumerate(steps):
            ids[ends[x] - 1 - k] = token
        flat, ends = ids.tolist(), ends.tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class _Pieces(dict):
    """Piece -> its ids, made when first asked for."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.together = bpe, _Together(bpe)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        return self.bpe.encode_piece(piece.encode())

    def learn(self, pieces: set[str]) -> None:
        """Encodes the unknown ones, which are sorted, some thousands at a time."""
        if len(self) > KEPT_PIECES:
            self.clear()
        ranks, new = self.bpe.ranks, []
        for text in sorted(p for p in pieces if p not in self and len(p) <= 64):
            if (whole := ranks.get(text.encode())) is not None:
                self[text] = (whole,)
            else:
                new.append(text)
        for k in range(0, len(new), 8192):
            self.update(zip(new[k : k + 8192], self.together.encode([x.encode() for x in new[k : k + 8192]]), strict=True))


_CODECS: dict = {}


class Codec:
    """Text to ids and back."""

    def __init__(self, ranks_path: str, pattern: str):
        self.bpe = Bpe(load_ranks(ranks_path))
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.bpe)

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        """One for a worker, kept between its tasks."""
        key = ranks_path, pattern
        if key not in _CODECS:
            _CODECS[key] = cls(ranks_path, pattern)
        return _CODECS[key]

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]):
        """The ids of each text."""
        split = [self.split(t) for t in texts]
        self.pieces.learn(set().union(*split))
        for pieces in split:
            yield list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids))


def encode_column(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its token ids."""

    def run(batches):
        codec = Codec.of(ranks_path, pattern)
        for b in batches:
            ids, column = b.column(0), c.texts(b.column(1))
            _, offsets = c.byte_view(column)
            for lo, hi in c.slices(offsets):
                encoded = list(codec.encode_all(column.slice(lo, hi - lo).to_pylist()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(encoded, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(c.lean(run), "doc_id long, ids array<int>")


def decode_column(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the bytes that they stand for."""

    def run(batches):
        codec = Codec.of(ranks_path, pattern)
        for b in batches:
            decoded = [codec.decode(x or ()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(c.lean(run), "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """What an encoding and its decoding come to: doc_id, n_tokens, ids_sha256, decoded_sha256; keep_ids: the ids too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids

    def run(batches):
        codec, name = Codec.of(ranks_path, pattern), {}
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids, column = b.column(0), c.texts(b.column(1))
            _, offsets = c.byte_view(column)
            name = name or {r: str(r) for r in codec.bpe.bytes_of}
            for lo, hi in c.slices(offsets):
                n, of_ids, of_text, kept = [], [], [], []
                for x in codec.encode_all(column.slice(lo, hi - lo).to_pylist()):
                    n.append(len(x))
                    of_ids.append(sha(",".join(map(name.__getitem__, x)).encode()))
                    of_text.append(sha(codec.decode(x)))
                    if keep_ids:
                        kept.append(np.array(x, np.int32))
                arrays = [ids.slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(c.lean(run), schema)
