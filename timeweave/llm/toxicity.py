"""Toxicity by non-negative positive-unlabelled learning.

A logistic model in numpy learns from confirmed toxic texts (positive) and unlabelled text, of which a share - the class
prior - is toxic too. Its risk is prior * R+(positives) plus the negatives' risk, estimated as R-(unlabelled) - prior *
R-(positives) and held at zero or more: a step that would push it below goes the other way. A second, one-variable fit on
labelled training rows turns margins into probabilities.

Features are hashed words and pairs of neighbouring words (runs of letters and digits, A-Z lower), counted once a text with
weights only where they stand out among the positives. Labels come only from training rows. The model is fitted on bounded
samples (Limits) of whole texts, those with the smallest hashes of their ids, drawn together in one pass over the texts;
features are chosen by counts over the samples, and only then do the texts' chosen features go to the driver.

A null text is empty; an empty text has the score of a text without known features. Rows are scored one by one, repeated
rows alike. Of repeated labels of a document the largest counts; of a repeated id in a sample, the text with the smallest
hash. Rows without an id are scored, not learned from. Without any confirmed toxic row all scores are 0; an empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c


@dataclass(frozen=True)
class Limits:
    """Most rows of each kind that the model is fitted on: confirmed toxic, unlabelled (all training rows alike), and labelled for the calibration."""

    positives: int = 2_000
    unlabelled: int = 6_000
    calibration: int = 4_000


DIM = 1 << 18
_SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of each distinct hashed word and pair of a row."""
    row, start, end = c.words(data, offsets, _SEPARATOR)
    h = c.word_hashes(data, start, end, lower=True)
    pair = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.empty(0, np.int64)
    both = c.mix(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1]) if len(pair) else np.empty(0, np.uint64)
    at = (np.concatenate([h, both]) % np.uint64(DIM)).astype(np.int64)
    key = np.unique(np.concatenate([row, row[pair]]) * DIM + at)
    return key // DIM, key % DIM


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, at = features(data, offsets)
        z = np.bincount(row, self.weights[at], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -40, 40)))


def band_keys(row: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n x 3 hashes of runs of eight min-hashes of each row's features: near copies share one nearly always."""
    out = np.zeros((n, 3), np.uint64)
    own, first = np.unique(row, return_index=True)
    if len(own):
        x = at.astype(np.uint64)
        for k in range(24):
            low = np.minimum.reduceat(c.mix(x * np.uint64(2 * k + 3) + np.uint64(k + 1)), first)
            out[own, k // 8] = c.mix(out[own, k // 8] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out


def without_copies(keys: list[tuple[int, ...]]) -> list[int]:
    """Places of the first of rows that share any of their keys: near copies would lend their words weight."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, own in enumerate(keys):
        pairs = set(enumerate(own))
        if not pairs & seen:
            out.append(i)
        seen |= pairs
    return out


def telling(p: np.ndarray, u: np.ndarray, n: int, m: int, least: float = 6.0) -> np.ndarray:
    """Which features' share of n positives (counts p) is above that of m unlabelled texts (counts u) by `least` standard errors or more; in four positives at least."""
    n, m = max(n, 1), max(m, 1)
    both = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(both * (1 - both) * (1 / n + 1 / m))
    return np.flatnonzero((z >= least) & (p >= 4))


def matrix(rows: list[np.ndarray], kept: np.ndarray) -> np.ndarray:
    """Rows of features as 0 and 1 for each kept feature (sorted); others are left out."""
    x = np.zeros((len(rows), len(kept)), np.float32)
    for i, r in enumerate(rows):
        at = np.searchsorted(kept, r)
        at[at == len(kept)] = 0
        if len(kept):
            x[i, at[kept[at] == r]] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' risk times the prior, and the negatives' risk before it is held at zero; logistic loss."""
    zp, zu = xp @ w + b, xu @ w + b
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def step(w: np.ndarray, b: float, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """The gradient to follow: that of the whole risk, or, where the negatives' risk is below zero, that of its rise alone."""
    zp, zu = xp @ w + b, xu @ w + b
    gu, gp = _sigmoid(zu) / len(zu), prior * _sigmoid(zp) / len(zp)
    if risk(w, b, xp, xu, prior)[1] < 0:
        gu = -gu
    else:
        gp = -prior * _sigmoid(-zp) / len(zp) - gp
    return gu @ xu + gp @ xp, float(gu.sum() + gp.sum())


def fit_nnpu(xs_p: np.ndarray, xs_u: np.ndarray, prior: float, epochs: int = 40, batch: int = 256, rate: float = 0.05, decay: float = 1e-3, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; Adam on mini-batches of both samples."""
    rng, k = np.random.default_rng(seed), xs_p.shape[1]
    w, b = np.zeros(k), 0.0
    m, v, mb, vb, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 0
    steps = max(1, -(-len(xs_u) // batch))
    size_p = min(len(xs_p), batch)
    for _ in range(epochs):
        order_u, order_p = rng.permutation(len(xs_u)), rng.permutation(len(xs_p))
        for j in range(steps):
            xu = xs_u[order_u[j * batch : (j + 1) * batch]]
            xp = xs_p[np.take(order_p, range(j * size_p, (j + 1) * size_p), mode="wrap")]
            g, gb = step(w, b, xp, xu, prior)
            g, t = g + decay * w, t + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def fit_slope(z: np.ndarray, y: np.ndarray, many: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins and labels, each as often as `many` says; targets a little inside 0 and 1, Newton steps."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    many = np.ones(len(y)) if many is None else many.astype(float)
    n1 = (many * y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (many.sum() - n1 + 2))
    scale = np.sqrt(np.average((z - np.average(z, weights=many)) ** 2, weights=many)) or 1.0
    x, a, s = z / scale, 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + s, -40, 40)))
        d, q = many * (p - target), many * (p * (1 - p) + 1e-9)
        g = np.array([(d * x).sum() + 1e-3 * (a - 1), d.sum()])
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum()]])
        step = np.linalg.solve(h, g)
        if np.abs(step).max() > 2:
            step *= 2 / np.abs(step).max()
        a, s = a - step[0], s - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a / scale), float(s)


#: Bits that say which samples a row is in.
POSITIVE, UNLABELLED, CALIBRATION = 1, 2, 4


def _drawn(ids: DataFrame, known: DataFrame, limits: Limits) -> DataFrame:
    """doc_id, toxic, kinds: the training rows of the three samples, by the smallest hashes of ids; at most the sum of the limits."""
    first = lambda rows, n, kind: rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(n).withColumn("kind", F.lit(kind))
    labelled = ids.join(known, "doc_id")
    samples = first(labelled.where("toxic = 1"), limits.positives, POSITIVE).union(first(ids, limits.unlabelled, UNLABELLED)).union(first(labelled, limits.calibration, CALIBRATION))
    return c.cut(samples.groupBy("doc_id").agg(F.sum("kind").cast("int").alias("kinds")).join(known, "doc_id", "left").select("doc_id", "kinds", F.col("toxic").cast("int").alias("toxic")))


def _sampled(rows: DataFrame, drawn: DataFrame) -> DataFrame:
    """doc_id, kinds, toxic, keys (of near copies) and features of the drawn rows' whole texts; written once."""

    def run(batches):
        for b in batches:
            data, offsets = c.byte_view(c.texts(b.column(3)))
            for lo, hi in c.slices(offsets):
                row, at = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n, cuts = hi - lo, np.searchsorted(row, np.arange(hi - lo + 1))
                listed = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(at.astype(np.int32)))
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * n + 1, 3), pa.int32()), pa.array(band_keys(row, at, n).view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, n) for i in range(3)), keys, listed], names=["doc_id", "kinds", "toxic", "keys", "features"])

    # of rows that share an id the text with the smallest hash; the drawn ids are few, so texts are not shuffled before they are picked
    picked = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "kinds", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return c.cut(picked.mapInArrow(run, "doc_id long, kinds int, toxic int, keys array<long>, features array<int>"))


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold


def train(docs: DataFrame, labels: DataFrame, training: Column, limits: Limits = Limits()) -> Model:  # noqa: B008
    """docs: doc_id, text. labels: doc_id, toxic. training: rows to learn from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(training & F.col("doc_id").isNotNull())
    share = rows.select("doc_id").join(known, "doc_id").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not share:
        return Model(np.zeros(DIM), -40.0, 1.0, 0.0)
    sample = _sampled(rows, _drawn(rows.select("doc_id"), known, limits))
    is_kind = lambda k: F.col("kinds").bitwiseAND(k) > 0
    # in the order of a hash of ids, so that reruns agree
    ordered = lambda t: t.take(np.argsort(c.mix(t.column("doc_id").to_numpy().astype(np.uint64)), kind="stable"))
    keys = ordered(sample.where(is_kind(POSITIVE)).select("doc_id", "keys").toArrow())
    firsts = {keys.column("doc_id")[i].as_py() for i in without_copies(list(map(tuple, keys.column("keys").to_pylist())))}
    kept_ids = docs.sparkSession.createDataFrame([(i,) for i in firsts], "kept_id long")
    marked = sample.join(F.broadcast(kept_ids), F.col("doc_id") == F.col("kept_id"), "left").withColumn("positive", F.col("kept_id").isNotNull())
    m = sample.where(is_kind(UNLABELLED)).count()
    counts = marked.select("positive", is_kind(UNLABELLED).alias("unlabelled"), F.explode("features").alias("f")).groupBy("f").agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")).where("p >= 4").toArrow()
    p, u = np.zeros(DIM), np.zeros(DIM)
    f = counts.column("f").to_numpy()
    p[f], u[f] = counts.column("p").to_numpy(), counts.column("u").to_numpy()
    kept = telling(p, u, len(firsts), m)
    chosen = docs.sparkSession.sparkContext.broadcast(np.isin(np.arange(DIM), kept))  # of fixed size

    def narrow(batches):
        for b in batches:
            lists = b.column(4)
            flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), lengths)
            own = chosen.value[flat]
            cuts = np.searchsorted(row[own], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat[own]))], names=["doc_id", "kinds", "toxic", "positive", "features"])

    got = ordered(marked.select("doc_id", "kinds", "toxic", "positive", "features").mapInArrow(narrow, "doc_id long, kinds int, toxic int, positive boolean, features array<int>").toArrow())
    x = matrix([np.array(r, np.int64) for r in got.column("features").to_pylist()], kept)
    kinds, positive = got.column("kinds").to_numpy(), np.array(got.column("positive").to_pylist(), bool)
    prior = min(max(float(share), 1e-3), 0.9)
    w, b = fit_nnpu(x[positive], x[kinds & UNLABELLED > 0], prior)
    own = kinds & CALIBRATION > 0
    slope, shift = fit_slope(x[own] @ w + b, np.array(got.column("toxic").to_pylist(), float)[own])
    weights = np.zeros(DIM, np.float32)
    weights[kept] = w
    return Model(weights, float(b), slope, shift)


def score(docs: DataFrame, model: Model, held: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of fixed size: DIM weights

    def run(batches):
        m = shared.value
        for b in batches:
            data, offsets = c.byte_view(c.texts(b.column(1)))
            for lo, hi in c.slices(offsets):
                s = m.scores(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
