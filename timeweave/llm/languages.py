"""Language identification by multilingual mixture inference.

Each learned language is a smoothed distribution of hashed character n-grams (orders 2 to 4, letters lower-cased, other characters as
one boundary mark), counted over all training texts. A text is a bag of words (runs of letters and marks; runs of over 32 are cut
there), each written in one of the text's languages: expectation-maximisation estimates the languages' proportions from the words' n-gram
likelihoods. The set of languages grows from the best single one by the language that promises most, as long as the likelihood rises by more
than a penalty that grows with the logarithm of the text's words. The prediction is the language of the largest proportion (ties: first
in code-point order); the score is that proportion times the posterior of the language among single ones.

Whole texts count, of any length. A null text, and one without a letter, is `und` with score 0, as is every text where no language was
learned. Rows without a language, and without an id (they have no fold), are not learned from. Repeated rows are learned from and predicted
one by one. An empty table gives no rows. Other columns, whatever their names, are not read. More than LANGUAGES learned values are refused.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

LANGUAGES = 400
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
CHUNK = 2048
WORD = 32
#: A word's likelihood under a language counts as no smaller than its best one's over e^FLOOR.
FLOOR = 30.0
SMOOTHING = 0.5


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    path: str


# ---------------------------------------------------------------- characters and n-grams

_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 2 for letters, 1 for marks, else 0; and its lower case if that is one code point."""
    if not _TABLE:
        kind, low = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for x in range(0x34000):
            ch = chr(x)
            kind[x] = {"L": 2, "M": 1}.get(unicodedata.category(ch)[0], 0)
            if kind[x] == 2 and len(ch.lower()) == 1:
                low[x] = ord(ch.lower())
        _TABLE.append((kind, low))
    return _TABLE[0]


def letters_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each row, a zero before every row and two at the end, those outside words zero; and each one's row."""
    kind, low = characters()
    text = data.tobytes()
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    try:
        points, at = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32), lead[offsets]
    except UnicodeDecodeError:  # damaged bytes stand for one replacement character or more each
        rows = [text[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    z = np.zeros(len(points) + len(at) + 2, np.uint32)
    own = np.full(len(z), -1, np.int64)
    place = np.arange(len(points)) + row + 1
    z[place] = np.where(kind[points] > 0, low[points], 0)
    own[place] = row
    return z, own


def grams(z: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of letters and, for each order, the bucket of the n-gram around each (-1: none): one place back, on to the order's end."""
    at = np.flatnonzero(z)
    w = z.astype(np.uint64)
    a, b, d, e = w[at - 1], w[at], w[at + 1], w[np.minimum(at + 2, len(w) - 1)]
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    h = c.mix(a * k1 + b * k2 + np.uint64(1))
    out = [h]
    h = c.mix(h + d * k3 + np.uint64(2))
    out.append(h)
    out.append(c.mix(h + e * k1 + np.uint64(3)))
    buckets = [(x % np.uint64(BUCKETS)).astype(np.int64) + n * BUCKETS for n, x in enumerate(out)]
    buckets[2][d == 0] = -1
    return at, buckets


def words_of(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places `at` begins a word."""
    first = z[at - 1] == 0
    begun = np.maximum.accumulate(np.where(first, at, 0))
    return first | ((at - begun) % WORD == 0)


# ---------------------------------------------------------------- training


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def out():
        for lang, counts in total.items():
            for k in range(0, len(counts), CHUNK):
                part = counts[k : k + CHUNK]
                if len(at := np.flatnonzero(part)):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "chunk": pa.array([k // CHUNK], pa.int32()), "at": [at.astype(np.int16).tobytes()], "n": [part[at].tobytes()]})
        total.clear()

    for b in batches:
        langs = b.column(0).to_pylist()
        data, offsets = c.byte_view(c.texts(b.column(1)))
        for lo, hi in c.slices(offsets):
            z, own = letters_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            at, buckets = grams(z)
            names = sorted({langs[i] for i in range(lo, hi)})
            of = np.array([names.index(langs[i]) for i in range(lo, hi)])[own[at]] if len(at) else np.empty(0, np.int64)
            for k, name in enumerate(names):
                mine = of == k
                if mine.any():
                    own_counts = total.setdefault(name, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    for x in buckets:
                        x = x[mine]
                        own_counts += np.bincount(x[x >= 0], minlength=len(own_counts))
        if len(total) > 64:
            yield from out()
    yield from out()


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for at, n in zip(t.column("at").to_pylist(), t.column("n").to_pylist(), strict=True):
        total[np.frombuffer(at, np.int16)] += np.frombuffer(n, np.int64)
    return pa.table({"lang": t.column("lang").slice(0, 1).combine_chunks(), "chunk": t.column("chunk").slice(0, 1).combine_chunks(), "total": [int(total.sum())], "counts": [total.tobytes()]})


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """A model of the n-grams of all rows with a language; its arrays go to the shared folder, one file for each chunk of buckets."""
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    parts = rows.mapInArrow(_count, "lang string, chunk int, at binary, n binary")
    counts = c.cut(parts.groupBy("lang", "chunk").applyInArrow(_add, "lang string, chunk int, total long, counts binary"))
    order = F.expr(f"chunk div {BUCKETS // CHUNK}")
    found = counts.groupBy("lang", order.alias("k")).agg(F.sum("total").alias("n")).limit((LANGUAGES + 1) * len(ORDERS)).collect()
    names = sorted({r["lang"] for r in found})
    if len(names) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages; {lang!r} doesn't look like a language")
    totals = {(r["lang"], r["k"]): r["n"] for r in found}
    path = c.new_path(spark, "languages")
    if names:
        chunks = len(ORDERS) * BUCKETS // CHUNK

        def write(t: pa.Table) -> pa.Table:
            chunk = t.column("chunk")[0].as_py()
            own = dict(zip(t.column("lang").to_pylist(), t.column("counts").to_pylist(), strict=True))
            logs = np.empty((CHUNK, len(names)), np.float32)
            for j, name in enumerate(names):
                n = np.frombuffer(own[name], np.int64) if own.get(name) else np.zeros(CHUNK, np.int64)
                logs[:, j] = np.log((n + SMOOTHING) / (totals.get((name, chunk * CHUNK // BUCKETS), 0) + SMOOTHING * BUCKETS))
            c.write_bytes(f"{path}/{chunk}", logs.tobytes())
            return pa.table({"chunk": pa.array([chunk], pa.int32())})

        every = spark.range(chunks).select(F.col("id").cast("int").alias("chunk")).join(counts.select("chunk", "lang", "counts"), "chunk", "left")
        every.select("lang", "chunk", "counts").groupBy("chunk").applyInArrow(write, "chunk int").count()
    return Model(tuple(names), path)


# ---------------------------------------------------------------- inference

_LOADED: dict[str, np.ndarray] = {}


def _logs(model: Model) -> np.ndarray:
    if model.path not in _LOADED:
        _LOADED.clear()
        parts = [c.mapped(f"{model.path}/{k}", np.float32) for k in range(len(ORDERS) * BUCKETS // CHUNK)]
        _LOADED[model.path] = np.concatenate(parts).reshape(-1, len(model.names))
    return _LOADED[model.path]


def word_likelihoods(z: np.ndarray, own: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and log likelihoods by language of each word: of its n-grams, each order's weight one third, as they tell of the same letters."""
    at, buckets = grams(z)
    if not len(at):
        return np.empty(0, np.int64), np.empty((0, logs.shape[1]), np.float32)
    each = np.zeros((len(at), logs.shape[1]), np.float32)
    for x in buckets:
        has = x >= 0
        each[has] += logs[x[has]]
    first = np.flatnonzero(words_of(z, at))
    return own[at[first]], np.add.reduceat(each, first, axis=0) / len(ORDERS)


def proportions(p: np.ndarray, first: np.ndarray, n: np.ndarray, row: np.ndarray, allowed: np.ndarray, rounds: int = 40, close: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """EM over words with likelihoods p, rows' words side by side: each row's proportions of its allowed languages, and its log likelihood."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        joint = p * pi[row]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, first, axis=0) / n[:, None]
        done = np.abs(new - pi).max() < close
        pi = new
        if done:
            break
    return pi, np.add.reduceat(np.log((p * pi[row]).sum(axis=1)), first)


def infer(row: np.ndarray, ll: np.ndarray, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have words, their proportions, and the posterior of each language alone."""
    rows, first, n = np.unique(row, return_index=True, return_counts=True)
    logs = np.maximum(ll - ll.max(axis=1, keepdims=True), -FLOOR).astype(np.float64)
    p, single = np.exp(logs), np.add.reduceat(logs, first, axis=0)
    best = single.argmax(axis=1)
    pi = np.eye(ll.shape[1])[best]
    value = single[np.arange(len(rows)), best]
    penalty = strength * (1 + np.log1p(n))
    alone = np.exp(single - single.max(axis=1, keepdims=True))
    alone /= alone.sum(axis=1, keepdims=True)
    live = np.arange(len(rows))
    while len(live) and ll.shape[1] > 1:
        # words of live rows only
        words = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in live])
        m = n[live]
        start = np.concatenate([[0], np.cumsum(m)[:-1]])
        of = np.repeat(np.arange(len(live)), m)
        now = np.log((p[words] * pi[live][of]).sum(axis=1))
        # no share of a language can add more than this
        most = np.add.reduceat(np.maximum(logs[words] - now[:, None], 0), start, axis=0)
        most[pi[live] > 0] = -1
        add = most.argmax(axis=1)
        open_ = most[np.arange(len(live)), add] > penalty[live]
        if not open_.any():
            break
        keep = open_[of]
        words, live, add = words[keep], live[open_], add[open_]
        m = n[live]
        start = np.concatenate([[0], np.cumsum(m)[:-1]])
        of = np.repeat(np.arange(len(live)), m)
        allowed = (pi[live] > 0).astype(float)
        allowed[np.arange(len(live)), add] = 1
        new, reached = proportions(p[words], start, m, of, allowed)
        better = reached - value[live] > penalty[live]
        live = live[better]
        pi[live], value[live] = new[better], reached[better]
    return rows, pi, alone


def predict(docs: DataFrame, model: Model, held: Column, key: str = "doc_id", text: str = "text", strength: float = 3.0) -> DataFrame:
    """key, held_out, lang_pred, score, and languages: the chosen set with its proportions, largest first."""
    schema = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    names = model.names
    most = max(1 << 14, min(c.SLICE_BYTES, (32 << 20) // max(len(names), 1)))

    def run(batches):
        logs = _logs(model) if names else None
        for b in batches:
            n = b.num_rows
            lang, score, sets = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            data, offsets = c.byte_view(c.texts(b.column(2)))
            for lo, hi in c.slices(offsets, most) if names else ():
                z, own = letters_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                row, ll = word_likelihoods(z, own, logs)
                if not len(row):
                    continue
                rows, pi, alone = infer(row, ll, strength)
                lettered = np.isin(rows, own[characters()[0][z] == 2])
                top = pi.argmax(axis=1)
                for i, r in enumerate(rows):
                    if lettered[i]:
                        lang[lo + r], score[lo + r] = names[top[i]], min(1.0, pi[i, top[i]] * alone[i, top[i]])
                        sets[lo + r] = sorted(({"lang": names[j], "share": float(pi[i, j])} for j in np.flatnonzero(pi[i])), key=lambda x: (-x["share"], x["lang"]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text")).mapInArrow(run, schema)
