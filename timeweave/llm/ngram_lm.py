"""Interpolated modified Kneser-Ney language model, counted in Spark and kept as sorted hash arrays.

Counting: each task counts the distinct n-grams of its texts and deals them, as packed arrays, to shards by a hash of the
n-gram. A shard adds them up, writes its arrays to the shared folder and passes on the (n-1)-grams with the number of
distinct words before each (their adjusted counts), and so on down to single words. N-grams of one context go to up to 16
shards, so that no frequent word fills one; what a context needs is added up in a second, small shuffle.

Arrays of a level: `key` (sorted 64-bit hashes of n-grams) and `count`, cut into shards by ranges of the key; `context`
(sorted), its total and how many n-grams with counts 1, 2 and 3 or more follow it. Workers memory-map them.

Probability of w after v..: (count - D) / total + gamma * probability after the shorter context; discounts D1, D2, D3+ by
the counts of counts of each level; the lowest level is interpolated with a uniform share for each word and one for the
unknown word.

Words are hashed to 56 bits where they travel. Texts that are null are empty: one end token. Training on no text gives a
model in which each token has probability 1. Documents are scored row by row: repeated rows get equal scores, ties need no order. Texts of any
length are counted and scored whole; other columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

BEGIN, END = np.uint64(0x5BD1E995A1B2C3), np.uint64(0x1B873593D4E5F6)
_LOW56 = np.uint64((1 << 56) - 1)
#: A context's n-grams are dealt to so many key ranges.
FAN = 16
#: Bytes of text for each shard of the counts: shards grow with the corpus, so that none does.
SHARD_BYTES = 4 << 20
#: Tokens that a task counts before it hands on what it has.
TASK_TOKENS = 6_000_000


# ---------------------------------------------------------------- tokens and keys


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 56-bit hash of every token: each row's words in lower case, then an end."""
    row, start, end = c.words(data, offsets)
    h = c.word_hashes(data, start, end, lower=True) & _LOW56
    n = len(offsets) - 1
    at = np.arange(len(row)) + row  # every earlier row has added one end
    out = np.full(len(row) + n, END, np.uint64)
    out[at] = h
    rows = np.full(len(out), -1, np.int64)
    rows[at] = row
    ends = np.flatnonzero(rows < 0)
    rows[ends] = np.arange(n)
    return rows, out


def histories(rows: np.ndarray, toks: np.ndarray, order: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, as `order` columns of words; begins stand before a row's first token."""
    columns = [toks]
    for k in range(1, order):
        before = np.full(len(toks), BEGIN, np.uint64)
        if len(toks) > k:
            same = rows[k:] == rows[:-k]
            before[k:][same] = toks[:-k][same]
        columns.insert(0, before)
    return columns


def context_key(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]) if columns else 1, np.uint64(len(columns) + 11), np.uint64)
    for x in columns:
        h = c.mix(h * np.uint64(0x9E3779B97F4A7C15) + x)
    return h


def ngram_key(columns: list[np.ndarray]) -> np.ndarray:
    """The upper 24 bits follow from the context and 4 bits of the word, so that a context lies in few places."""
    if len(columns) == 1:
        return c.mix(columns[0])
    context, word = context_key(columns[:-1]), columns[-1]
    place = c.mix(context + c.mix(word & np.uint64(FAN - 1)))
    own = c.mix(context ^ c.mix(word))
    return (place & ~np.uint64((1 << 40) - 1)) | (own >> np.uint64(24))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


# ---------------------------------------------------------------- packed arrays


def _planes(x: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together; zero planes pack to nothing."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel() if raw else np.empty(0, np.uint64)


def pack(ids: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Columns of ids through a sorted list of each column's distinct ones; values as they are."""
    out = []
    for x in ids:
        known, at = np.unique(x, return_inverse=True)
        out += [_planes(np.diff(known, prepend=np.uint64(0))), _planes(at)]
    out += [_planes(v) for v in values]
    z = zstandard.ZstdCompressor(level=1)
    body = [z.compress(x) for x in out]
    return np.array([len(ids), len(values), *map(len, body)], "<u4").tobytes() + b"".join(body)


def unpack(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n_ids, n_values = np.frombuffer(blob[:8], "<u4").tolist()
    sizes = np.frombuffer(blob[8 : 8 + 4 * (2 * n_ids + n_values)], "<u4").tolist()
    at, z, parts = 8 + 4 * len(sizes), zstandard.ZstdDecompressor(), []
    for n in sizes:
        parts.append(_unplanes(z.decompress(blob[at : at + n])))
        at += n
    ids = [np.cumsum(parts[2 * k], dtype=np.uint64)[parts[2 * k + 1].astype(np.int64)] for k in range(n_ids)]
    return ids, parts[2 * n_ids :]


def summed(key: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """One row for each key, sorted; its values added up."""
    if not len(key):
        return key, ids, values
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], [x[order[first]] for x in ids], [np.add.reduceat(v[order], first) for v in values]


# ---------------------------------------------------------------- counting

_ROWS = "kind string, level int, shard int, blob binary"


def _row_batch(kind: str, level: int, shard: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([level], pa.int32()), pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], names=["kind", "level", "shard", "blob"])


def _dealt(kind: str, level: int, key: np.ndarray, ids: list[np.ndarray], values: list[np.ndarray], shards: int):
    """Sorted rows, cut where the shard changes."""
    cuts = np.searchsorted(shard_of(key, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[s], cuts[s + 1]
        yield _row_batch(kind, level, int(s), pack([x[a:b] for x in ids], [v[a:b] for v in values]))


def _count_texts(order: int, shards: int):
    def run(batches):
        held: list[list[np.ndarray]] = []
        n = 0

        def out():
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            key, ids, (counts,) = summed(ngram_key(columns), columns, [np.ones(len(columns[0]), np.uint64)])
            yield from _dealt("ngrams", order, key, ids, [counts, counts], shards)

        for b in batches:
            data, offsets = c.byte_view(c.texts(b.column(0)))
            for lo, hi in c.slices(offsets):
                rows, toks = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held.append(histories(rows, toks, order))
                n += len(toks)
                if n >= TASK_TOKENS:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    return run


def _by_shard(batches):
    """(kind, shard, blobs) of a partition that is sorted by both."""
    now, blobs = None, []
    for b in batches:
        for kind, shard, blob in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if (kind, shard) != now:
                if now:
                    yield *now, blobs
                now, blobs = (kind, shard), []
            blobs.append(blob.as_py())
    if now:
        yield *now, blobs


def _joined(blobs: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = [unpack(x) for x in blobs]
    return [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)], [np.concatenate(x) for x in zip(*(p[1] for p in parts), strict=True)]


def _settle(level: int, shards: int, folder: str):
    """Adds up a level's shards; writes their arrays; hands on contexts' parts, the next level's n-grams and the counts of counts."""

    def run(batches):
        for kind, shard, blobs in _by_shard(batches):
            if kind == "contexts":
                (context,), values = _joined(blobs)
                context, _, values = summed(context, [], values)
                write_arrays(f"{folder}/{level + 1}-contexts-{shard}", *(x.astype("<u8" if k < 2 else "<u4") for k, x in enumerate((context, *values))))
                continue
            columns, values = _joined(blobs)
            key, columns, (count, raw) = summed(ngram_key(columns), columns, values)
            small = np.minimum(count, 255).astype(np.uint8)
            big = np.flatnonzero(small == 255)
            large = np.stack([key[big], count[big]]).astype("<u8")
            write_arrays(f"{folder}/{level}-ngrams-{shard}", key.astype("<u8"), small, large, raw.astype("<u8") if level == 1 else np.empty(0, "<u8"))
            facts = [len(key), int(count.sum()), *(int((count == k).sum()) for k in (1, 2, 3, 4)), int(raw.sum()), int((count >= 3).sum())]
            yield _row_batch("facts", level, shard, np.array(facts, "<u8").tobytes())
            if level > 1:
                parts = [count, (count == 1).astype(np.uint64), (count == 2).astype(np.uint64), (count >= 3).astype(np.uint64)]
                context, _, parts = summed(context_key(columns[:-1]), [], parts)
                yield from _dealt("contexts", level - 1, context, [context], parts, shards)
                # a shorter n-gram that begins a text has nothing before it; it keeps its own count
                one = np.where(columns[1] == BEGIN, count, np.uint64(1)) if level > 2 else np.ones(len(key), np.uint64)
                key, columns, values = summed(ngram_key(columns[1:]), columns[1:], [one, raw])
                yield from _dealt("ngrams", level - 1, key, columns, values, shards)

    return run


#: The arrays of a shard's files, in order.
FILES = {"ngrams": ("key", "count", "big", "raw"), "contexts": ("context", "total", "n1", "n2", "n3")}


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """One file: the arrays' sizes in bytes, then each at a multiple of eight bytes."""
    parts = [x.tobytes() for x in arrays]
    c.write_bytes(uri, np.array([len(x) for x in parts], "<u8").tobytes(), *(x + bytes(-len(x) % 8) for x in parts))


@dataclass(frozen=True)
class Level:
    n: int
    total: int
    discounts: tuple[float, float, float]


@dataclass(frozen=True)
class Model:
    """What workers need to open the arrays. folder is in the shared folder; levels[0] is that of single words."""

    folder: str
    order: int
    shards: int
    levels: tuple[Level, ...]
    tokens: int
    ones: tuple[int, int, int]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of Chen and Goodman; one half where the counts of counts give none."""
    if not n1 or not n2:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.0), float(k)) for k, x in enumerate(d, 1))


def train(docs: DataFrame, order: int = 2, shards: int | None = None, text_col: str = "text") -> Model:
    """Counts every text of docs. shards: key ranges, by default one for every SHARD_BYTES of text, and at least the session's shuffle partitions."""
    spark = docs.sparkSession
    if not shards:
        size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    folder = c.new_path(spark, "lm")
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_texts(order, shards), _ROWS)
    facts: dict[int, np.ndarray] = {}
    for level in range(order, 0, -1):
        path = c.new_path(spark, f"lm-level{level}")
        rows.repartitionById(shards, "shard").sortWithinPartitions("kind", "shard").mapInArrow(_settle(level, shards, folder), _ROWS).write.partitionBy("kind").parquet(path)
        settled = spark.read.schema(_ROWS).parquet(path)
        facts[level] = np.sum([np.frombuffer(r[0], "<u8") for r in settled.where("kind = 'facts'").select("blob").collect()] or [np.zeros(8)], axis=0).astype(np.int64)
        rows = settled.where(F.col("kind") != "facts").select("kind", "level", "shard", "blob")
    got = [facts[k] for k in range(1, order + 1)]
    levels = tuple(Level(int(f[0]), int(f[1]), discounts(*map(int, f[2:6]))) for f in got)
    return Model(folder, order, shards, levels, int(got[0][6]), (int(got[0][2]), int(got[0][3]), int(got[0][7])))


# ---------------------------------------------------------------- scoring


class Arrays:
    """A model's memory-mapped arrays, opened shard by shard as they are asked for."""

    def __init__(self, model: Model):
        self.model = model
        self.opened: dict[tuple[str, int], np.ndarray] = {}

    def array(self, name: str, shard: int, dtype: str) -> np.ndarray:
        if (name, shard) not in self.opened:
            level, what = name.split("-")
            kind = next(k for k, names in FILES.items() if what in names)
            try:
                raw = c.mapped(f"{self.model.folder}/{level}-{kind}-{shard}", np.uint8)
                sizes = raw[: 8 * len(FILES[kind])].view("<u8").astype(np.int64)
            except FileNotFoundError:  # a range of keys without any
                raw, sizes = np.empty(0, np.uint8), np.zeros(len(FILES[kind]), np.int64)
            ends = 8 * len(sizes) + np.cumsum(-(-sizes // 8) * 8)
            for own, n, end in zip(FILES[kind], sizes.tolist(), ends.tolist(), strict=True):
                at = end - -(-n // 8) * 8
                self.opened[f"{level}-{own}", shard] = raw[at : at + n]
        return self.opened[name, shard].view(dtype)

    def look_up(self, keys: np.ndarray, name: str, values: list[tuple[str, str]]) -> list[np.ndarray]:
        """The values at each of the sorted keys; zero where there is none."""
        out = [np.zeros(len(keys), np.int64) for _ in values]
        cuts = np.searchsorted(shard_of(keys, self.model.shards), np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own, a, b = self.array(name, int(s), "<u8"), cuts[s], cuts[s + 1]
            if not len(own):
                continue
            at = np.searchsorted(own, keys[a:b])
            at[at == len(own)] = 0
            hit = own[at] == keys[a:b]
            for x, (v, dtype) in zip(out, values, strict=True):
                got = self.array(v, int(s), dtype)[at].astype(np.int64)
                if v.endswith("-count") and (big := np.flatnonzero(hit & (got == 255))).size:
                    large = self.array(v.replace("-count", "-big"), int(s), "<u8").reshape(2, -1)
                    got[big] = large[1][np.searchsorted(large[0], keys[a:b][big])]
                x[a:b] = np.where(hit, got, 0)
        return out

    def counts(self, level: int, columns: list[np.ndarray], raw: bool = False) -> list[np.ndarray]:
        names = [(f"{level}-count", "u1")] + [("1-raw", "<u8")] * raw
        return self._spread(ngram_key(columns), f"{level}-key", names)

    def contexts(self, level: int, columns: list[np.ndarray]) -> list[np.ndarray]:
        return self._spread(context_key(columns), f"{level}-context", [(f"{level}-total", "<u8"), *((f"{level}-n{k}", "<u4") for k in (1, 2, 3))])

    def _spread(self, key: np.ndarray, name: str, values: list[tuple[str, str]]) -> list[np.ndarray]:
        known, at = np.unique(key, return_inverse=True)
        return [x[at] for x in self.look_up(known, name, values)]


def token_scores(arrays: Arrays, rows: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's probability of each token after what precedes it in its row; how often the token is in the training texts."""
    m = arrays.model
    columns = histories(rows, toks, m.order)
    seen, raw = arrays.counts(1, columns[-1:], raw=True)
    one = m.levels[0]
    if not one.total:
        return np.ones(len(toks)), raw
    d = np.array([0.0, *one.discounts])
    uniform = sum(x * n for x, n in zip(one.discounts, m.ones, strict=True)) / one.total / (one.n + 1)
    p = np.maximum(seen - d[np.minimum(seen, 3)], 0) / one.total + uniform
    for level in range(2, m.order + 1):
        own = columns[m.order - level :]
        (count,) = arrays.counts(level, own)
        total, n1, n2, n3 = arrays.contexts(level, own[:-1])
        d = np.array([0.0, *m.levels[level - 1].discounts])
        free = d[1] * n1 + d[2] * n2 + d[3] * n3
        known = total > 0
        p = np.where(known, (np.maximum(count - d[np.minimum(count, 3)], 0) + free * p) / np.maximum(total, 1), p)
    return p, raw


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(docs: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES of every document: log10 probabilities of the whole text by unigram counts (base) and by the model."""

    def run(batches):
        a = Arrays(model)
        base = model.tokens + model.levels[0].n + 1
        for b in batches:
            data, offsets = c.byte_view(c.texts(b.column(1)))
            for lo, hi in c.slices(offsets):
                n = hi - lo
                rows, toks = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                p, raw = token_scores(a, rows, toks)
                add = lambda x: np.bincount(rows, x, minlength=n)  # noqa: B023, E731
                n_tokens, log = add(None), add(np.log10(p))
                arrays = [b.column(0).slice(lo, n), b.column(2).slice(lo, n), n_tokens, add((raw > 0).astype(float)).astype(np.int64), np.full(n, model.tokens), add(np.log10((raw + 1) / base)), log, 10 ** (-log / n_tokens)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=[f.split()[0] for f in SCORES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out")).mapInArrow(run, SCORES)


def held_out(id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
