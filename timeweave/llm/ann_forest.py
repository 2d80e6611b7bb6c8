"""Nearest neighbours by a forest of hash prefixes.

A tree turns a vector by a random rotation and looks at two blocks of axes. A symbol names an axis of a block with its sign;
a vector's hash string names the largest axis of the first block, that of the second, the next largest of the first, and so
on. A tree is one sorted array of these strings over all vectors, cut into parts at quantiles of a sample.

A query descends to its longest prefix match in every tree at once, then all trees ascend in step: symbol by symbol up to
two symbols, there to neighbouring prefixes in the order of what they lose against the query's own, then to single symbols,
last to the root, until the prefixes hold `gather * n ** power` rows. How many a prefix holds is read off the sorted strings
of a bounded random sample, so each query knows its prefixes before it is sent to the parts of the trees that hold them. A part
answers by binary search; the matches lie side by side, with 8-bit copies of their vectors, and are scored where they
are. The best `keep` of a query over all trees are scored again in double precision on the given vectors.

Vectors of one direction (equal ones, and exact multiples) are one entry with its smallest ids, so a hot group of copies is one row;
equal queries are one search. Equal
strings may be split over parts. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
without id. Equal scores are ranked by smaller id. A row repeated with the same id and vector counts once; of an id with
several vectors each is a candidate and the best counts, as a query the one with the smallest hash does. Only vectors of one
length are compared. Other columns, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Bits of a symbol in a string; symbols of a string; axes of a block; neighbouring symbols of a block that the ascent tries.
BITS, SYMBOLS, BLOCK, TRIED = 8, 8, 32, 16


@dataclass(frozen=True)
class Forest:
    """trees; gather and power: of n vectors, gather * n ** power rows are scored for a query, and `least` a tree; rows sampled to count prefixes; rows of a part of a tree; candidates that are scored exactly."""

    trees: int = 8
    gather: float = 4.5
    power: float = 0.7
    least: int = 64
    sample: int = 32_768
    part_rows: int = 32_768
    keep: int = 32
    seed: int = 11


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; first divided by their largest component, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def rotations(dim: int, forest: Forest) -> np.ndarray:
    """trees x dim x axes; as many axes as two blocks have, or two for each dimension if that is less."""
    rng, axes = np.random.default_rng((forest.seed, dim)), 2 * min(BLOCK, dim)
    if dim >= axes:
        turns = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :axes] for _ in range(forest.trees)]
    else:
        turns = [rng.normal(size=(dim, axes)) for _ in range(forest.trees)]
    return np.stack(turns).astype(np.float32)


def _signed(y: np.ndarray) -> np.ndarray:
    """rows x 2 blocks x symbols: a symbol's value is that of its axis, with its sign."""
    n, d = len(y), y.shape[1] // 2
    z, out = y.reshape(n, 2, d), np.empty((n, 2, 2 * d), np.float32)
    out[:, :, 1::2], out[:, :, 0::2] = z, -z
    return out


def hash_strings(u: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """One string a row as a 64-bit number: eight bits a symbol, the first symbol on top."""
    y = u @ turn
    n, d = len(y), y.shape[1] // 2
    size, out, at = np.abs(y).reshape(n, 2, d), np.zeros(n, np.uint64), np.arange(n)
    for k in range(SYMBOLS):
        block = k % 2
        if k // 2 < d:
            axis = size[:, block].argmax(axis=1)
            symbol = axis * 2 + (y[at, block * d + axis] > 0)
            size[at, block, axis] = -1
            out |= symbol.astype(np.uint64) << np.uint64(64 - BITS * (k + 1))
    return out


def neighbours(u: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of two symbols in the order of what their symbols lose against the largest, and those of one symbol, as numbers with zeros below."""
    v = _signed(u @ turn)
    n, k = len(v), min(TRIED, v.shape[2])
    order = np.argsort(-v, axis=2, kind="stable")[:, :, :k]
    value = np.take_along_axis(v, order, 2)
    loss = (value[:, :, :1] - value) ** 2
    first, second = order[:, 0].astype(np.uint64) << np.uint64(56), order[:, 1].astype(np.uint64) << np.uint64(48)
    both = (first[:, :, None] | second[:, None, :]).reshape(n, -1)
    by_loss = np.argsort((loss[:, 0, :, None] + loss[:, 1, None, :]).reshape(n, -1), axis=1, kind="stable")
    return np.take_along_axis(both, by_loss, 1), first


def _last(prefix: np.ndarray, symbols: int) -> np.ndarray:
    """The largest string with this prefix."""
    return prefix | np.uint64((1 << (64 - BITS * symbols)) - 1)


class Router:
    """What the driver hands out for vectors of one length: rotations, the sample's sorted strings, where parts begin."""

    def __init__(self, sample: np.ndarray, rows: float, forest: Forest, dim: int):
        self.forest, self.rows, self.turns = forest, rows, rotations(dim, forest)
        u = unit(sample) if len(sample) else np.empty((0, dim), np.float32)
        self.sorted = [np.sort(hash_strings(u, t)) for t in self.turns]
        parts = int(min(-(-rows // forest.part_rows), max(len(sample) // 16, 1)))
        self.fences = [s[(np.arange(1, parts) * len(s)) // parts] for s in self.sorted]

    def holds(self, tree: int, prefix: np.ndarray, symbols: int) -> np.ndarray:
        """How many sampled strings have each prefix."""
        s = self.sorted[tree]
        return np.searchsorted(s, _last(prefix, symbols), "right") - np.searchsorted(s, prefix, "left")

    def parts_of(self, tree: int, strings: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The part of each string; strings equal to fences are spread over all parts that may hold them."""
        lo, hi = np.searchsorted(self.fences[tree], strings, "left"), np.searchsorted(self.fences[tree], strings, "right")
        return lo + (spread % (hi - lo + 1).astype(np.uint64)).astype(np.int64)

    def ascend(self, u: np.ndarray) -> list[tuple[int, float, list[tuple[np.ndarray, np.ndarray]]]]:
        """Of each query: symbols of the shortest prefix reached, rows expected there, and each tree's ranges of strings."""
        f = self.forest
        scale = self.rows / max(len(self.sorted[0]), 1)
        enough = max(f.gather * self.rows**f.power, f.least * f.trees)
        own = [hash_strings(u, t) for t in self.turns]
        near = [neighbours(u, t) for t in self.turns]
        # rows within the own prefix of each length, then within the first j neighbouring prefixes of two and of one symbol
        cut = lambda s, k: s & ~np.uint64((1 << (64 - BITS * k)) - 1)
        lengths = list(range(SYMBOLS, 2, -1))
        deep = np.stack([sum(self.holds(t, cut(own[t], k), k) for t in range(f.trees)) for k in lengths], axis=1) * scale
        two = np.cumsum(sum(self.holds(t, near[t][0], 2) for t in range(f.trees)), axis=1) * scale
        one = np.cumsum(sum(self.holds(t, near[t][1], 1) for t in range(f.trees)), axis=1) * scale
        out = []
        for i in range(len(u)):
            if (at := np.flatnonzero(deep[i] >= enough)).size:
                k = lengths[at[0]]
                low = [cut(s[i : i + 1], k) for s in own]
                out.append((k, float(deep[i, at[0]]), [(x, _last(x, k)) for x in low]))
            elif two[i, -1] >= enough:
                j = int(np.searchsorted(two[i], enough)) + 1
                out.append((2, float(two[i, j - 1]), [(p[i, :j], _last(p[i, :j], 2)) for p, _ in near]))
            elif one[i, -1] >= enough:
                j = int(np.searchsorted(one[i], enough)) + 1
                out.append((1, float(one[i, j - 1]), [(p[i, :j], _last(p[i, :j], 1)) for _, p in near]))
            else:  # the root: one tree holds every row
                none = np.empty(0, np.uint64)
                out.append((0, float(self.rows), [(np.zeros(1, np.uint64), _last(np.zeros(1, np.uint64), 0))] + [(none, none)] * (f.trees - 1)))
        return out


class Part:
    """A part of a tree: sorted strings, entries and 8-bit vectors with their scales."""

    def __init__(self, pieces: list[tuple[bytes, bytes, bytes]], dim: int):
        self.strings = np.concatenate([np.frombuffer(a, "<u8") for a, _, _ in pieces])
        order = np.argsort(self.strings, kind="stable")
        self.strings = self.strings[order]
        self.entries = np.concatenate([np.frombuffer(b, "<i8") for _, b, _ in pieces])[order]
        n = [len(a) // 8 for a, _, _ in pieces]
        self.small = np.concatenate([np.frombuffer(x[: m * dim], np.int8).reshape(m, dim) for (_, _, x), m in zip(pieces, n, strict=True)])[order]
        self.scale = np.concatenate([np.frombuffer(x[m * dim :], "<f4") for (_, _, x), m in zip(pieces, n, strict=True)])[order]

    def best(self, low: np.ndarray, high: np.ndarray, query: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and approximate scores of the best matches within the ranges."""
        a, b = np.searchsorted(self.strings, low, "left"), np.searchsorted(self.strings, high, "right")
        n = b - a
        total = int(n.sum())
        if not total:
            return self.entries[:0], self.scale[:0]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)
        score = np.concatenate([self.small[x].astype(np.float32) @ query for x in np.array_split(at, -(-total // 65_536))]) * self.scale[at]
        if total > keep:
            top = np.argpartition(-score, keep - 1)[:keep]
            at, score = at[top], score[top]
        return self.entries[at], score


def shrink(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit numbers, and by what to multiply each row to have it back."""
    scale = np.abs(u).max(axis=1) / 127
    return np.rint(u / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


_ROWS = "dim int, tree int, part int, kind int, a binary, b binary, c binary, h1 long, h2 long, level int, gathered double"
_KINDS = [pa.int32()] * 4 + [pa.binary()] * 3 + [pa.int64()] * 2 + [pa.int32(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[f.split()[0] for f in _ROWS.split(", ")])


def _by_dim(batches, most: int):
    """(dim, h1, h2, vectors) of up to about `most` rows of one length."""
    held: dict[int, list] = {}
    for b in batches:
        dims, h1, h2 = (b.column(i).to_numpy() for i in range(3))
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            held.setdefault(d, []).append((h1[at], h2[at], _matrix(b.column(3).take(pa.array(at)))))
            if sum(len(x[0]) for x in held[d]) >= most:
                yield d, *(np.concatenate(x) for x in zip(*held.pop(d), strict=True))
    for d, x in held.items():
        yield d, *(np.concatenate(y) for y in zip(*x, strict=True))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def _scaled(v: Column) -> Column:
    """In double precision, divided by the largest component, so that no square overflows or vanishes."""
    v = F.transform(v, lambda x: x.cast("double"))
    largest = F.array(F.array_max(F.transform(v, F.abs)))  # once a vector, not once a component
    return F.transform(largest, lambda m: F.transform(v, lambda x: x / m))[0]


def _cosine(x: Column, y: Column) -> Column:
    length = lambda v: F.sqrt(_total(F.transform(v, lambda a: a * a)))
    return _total(F.zip_with(x, y, lambda a, b: a * b)) / (length(x) * length(y))


def nearest(rows: DataFrame, is_query: Column, k: int = 5, forest: Forest = Forest(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:  # noqa: B008
    """query_id, rank, vec_id, score of the k nearest found of each query among all other rows; level, the symbols of the shortest prefix that the ascent reached; gathered, the rows that it expected there."""
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # exact multiples of a vector have the same quotients, so they are one entry, and their equal scores go by id; x + 0 has no minus zero
    way = F.transform(_scaled(F.col("v")), lambda x: x + F.lit(0.0))
    keyed = given.withColumn("way", way).select("vec_id", "v", "is_query", F.xxhash64("way").alias("h1"), F.xxhash64(F.lit(1), "way").alias("h2"))
    entries = c.cut(keyed.groupBy("h1", "h2").agg(F.first("v").alias("v")).select(F.size("v").alias("dim"), "h1", "h2", "v"))
    queries = keyed.where("is_query").groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("h1", "h2")).alias("h")).select("query_id", "h.h1", "h.h2")
    queries = c.cut(queries)
    asked = entries.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("dim", "h1", "h2", "v")

    sizes = {r["dim"]: r["count"] for r in entries.groupBy("dim").count().collect()}
    share = min(1.0, forest.sample / max(sum(sizes.values()), 1))
    drawn = entries.where((F.pmod(F.col("h2"), F.lit(1 << 20)) < share * (1 << 20))).orderBy("h2", "h1").limit(2 * forest.sample).select("dim", "v").toArrow()
    dims = drawn.column(0).to_numpy()
    of_dim = {d: drawn.column(1).filter(pa.array(dims == d)).combine_chunks() for d in sizes}
    built = {d: Router(_matrix(of_dim[d]) if len(of_dim[d]) else np.empty((0, d)), n, forest, d) for d, n in sizes.items()}
    # as many tasks as hold about eight parts each
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(len(f) + 1 for r in built.values() for f in r.fences) // 8))
    routers = spark.sparkContext.broadcast(built)  # of a bounded sample

    def plant(batches):
        for d, h1, _, x in _by_dim(batches, 65_536):
            r, u = routers.value[d], unit(x)
            small, scale = shrink(u)
            for t, turn in enumerate(r.turns):
                strings = hash_strings(u, turn)
                part = r.parts_of(t, strings, h1.view(np.uint64))
                order = np.lexsort((strings, part))
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    at = order[a:b]
                    rows.append((d, t, int(part[at[0]]), 0, strings[at].tobytes(), h1[at].tobytes(), small[at].tobytes() + scale[at].tobytes(), 0, 0, 0, 0.0))
                yield _batch(rows)

    def send(batches):
        for d, h1, h2, x in _by_dim(batches, 256):
            r, u = routers.value[d], unit(x)
            rows = []
            for i, (level, gathered, ranges) in enumerate(r.ascend(u)):
                for t, (low, high) in enumerate(ranges):
                    first, last = np.searchsorted(r.fences[t], low, "left"), np.searchsorted(r.fences[t], high, "right")
                    for p in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])).tolist() if len(low) else []:
                        own = (first <= p) & (p <= last)
                        rows.append((d, t, p, 1, low[own].tobytes(), b"", u[i].tobytes(), int(h1[i]), int(h2[i]), level, gathered))
            if rows:
                yield _batch(rows)

    def search(batches):
        now, pieces, part = None, [], None
        names = ["h1", "h2", "e", "near", "level", "gathered"]
        for b in batches:
            out = []
            for d, t, p, kind, x, y, z, h1, h2, level, gathered in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if (d, t, p) != now:
                    now, pieces, part = (d, t, p), [], None
                if not kind:
                    pieces.append((x, y, z))
                elif pieces or part:
                    part = part or Part(pieces, d)
                    pieces = []
                    low = np.frombuffer(x, "<u8")
                    e, score = part.best(low, _last(low, level), np.frombuffer(z, "<f4"), forest.keep)
                    out.append((np.full(len(e), h1), np.full(len(e), h2), e, score, np.full(len(e), level, np.int32), np.full(len(e), gathered)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*out, strict=True)], names=names)

    # a part's own rows come before the queries that visit it
    planted = entries.mapInArrow(plant, _ROWS).unionByName(asked.mapInArrow(send, _ROWS)).repartition(tasks, "dim", "tree", "part").sortWithinPartitions("dim", "tree", "part", "kind")
    found = planted.mapInArrow(search, "h1 long, h2 long, e long, near float, level int, gathered double").repartition("h1", "h2").dropDuplicates(["h1", "h2", "e"])
    by_near = Window.partitionBy("h1", "h2").orderBy(F.col("near").desc(), "e")
    found = found.withColumn("place", F.row_number().over(by_near)).where(F.col("place") <= forest.keep).drop("place", "near")

    ends = entries.select(F.col("h1").alias("e"), F.col("h2").alias("e2"), F.col("v").alias("y"))
    pairs = found.join(ends, "e").join(asked.select("h1", "h2", F.col("v").alias("x")), ["h1", "h2"])
    scored = pairs.select("h1", "h2", "level", "gathered", "e", "e2", _cosine(_scaled(F.col("x")), _scaled(F.col("y"))).alias("score"))
    # of each entry the smallest ids: one more than asked for, as the query's own may be among them
    ids = keyed.select(F.col("h1").alias("e"), F.col("h2").alias("e2"), "vec_id").distinct()
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy("e", "e2").orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place")
    named = scored.join(ids, ["e", "e2"]).groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"), F.first("level").alias("level"), F.first("gathered").alias("gathered"))
    top = named.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("place") <= k + 1).drop("place")
    own = queries.join(top, ["h1", "h2"]).where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "level", F.col("gathered").cast("long").alias("gathered"))
