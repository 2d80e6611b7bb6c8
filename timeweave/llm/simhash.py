"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of whole texts (XXH64 of 3-word shingles; a bit is 1 if over half of them set it) link at 2 or fewer
differing bits. If bits are dealt into m partitions with thresholds that sum to 2 - m + 1, a linked pair differs by no
more than the threshold in at least one partition. Correlated bits share a partition; a dynamic program gives each
partition the threshold for which the fewest candidates are expected, by statistics over all fingerprints.

Only distinct fingerprints are probed. A bucket with more than `bucket` of them is not compared pair by pair: there each
fingerprint meets others at the 64 fingerprints one bit away and at its own; two meet exactly when 2 or fewer bits differ.
A null or wordless text has the fingerprint zero, linked like any other. Repeated rows get the same component. A text of any
length has one fingerprint of all its shingles; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from .components import connected_components

BITS = 64
_LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = text.translate(_LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    start = np.concatenate([[0], end[:-1]])
    k = min(width, len(words))
    h, counts, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(words) - k + 1
    for lo in range(0, n, 65536):
        hi = min(n, lo + 65536)
        own = np.array([h(joined[s:e], seed) for s, e in zip(start[lo:hi].tolist(), (end[lo + k - 1 : hi + k - 1] - 1).tolist(), strict=True)], ">u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def majority(row: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n rows from the hashes of their shingles, which are sorted by row; zero for a row without any."""
    out = np.zeros(n, np.uint64)
    own, first, count = np.unique(row, return_index=True, return_counts=True)
    if len(own):
        counts = np.zeros((len(own), BITS), np.int64)
        for bit in range(0, BITS, 8):
            part = np.unpackbits((hashes >> np.uint64(BITS - 8 - bit)).astype(np.uint8)[:, None], axis=1)
            counts[:, bit : bit + 8] = np.add.reduceat(part, first, axis=0, dtype=np.int64)
        out[own] = np.packbits(counts * 2 > count[:, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, keep_key: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long; with keep_key also row_key, a hash of the text."""
    names = ["doc_id", "fp"] + ["row_key"] * keep_key

    def run(batches):
        for b in batches:
            ids, data = b.column(0), c.texts(b.column(1))
            raw, off = c.byte_view(data)
            fp = np.array([fingerprint(raw[off[i] : off[i + 1]].tobytes(), width) for i in range(len(data))], np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64)), *b.columns[2:]], names=names)

    key = [F.xxhash64(F.col(text_col)).alias("row_key")] * keep_key
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *key).mapInArrow(run, ", ".join(f"{x} long" for x in names))


# ---------------------------------------------------------------- partitions and thresholds


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many set both of each pair of bits: 64 x 64 sums over all, added up task by task."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            for lo in range(0, len(x), 8192):
                both += x[lo : lo + 8192].T @ x[lo : lo + 8192]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(BITS * BITS)], pa.int32()), pa.array([n, *both.ravel().astype(np.int64)], pa.int64())], names=["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    got = {r["at"]: r["n"] for r in rows}
    return got.get(-1, 0), np.array([got.get(k, 0) for k in range(BITS * BITS)], float).reshape(BITS, BITS)


def expected_within(n: int, both: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """For t = 0..most, how many of all pairs of n fingerprints are expected to differ by t bits or fewer among `bits`.

    A random pair's number of differing bits has a mean and a variance that follow from the counts of pairs of bits; they
    fix a beta-binomial distribution.
    """
    p11 = both[np.ix_(bits, bits)] / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    differ = 2 * (p11 * p00 + p10 * p01)  # both bits differ
    np.fill_diagonal(differ, 2 * p * (1 - p))
    w, mean = len(bits), 2 * float(np.sum(p * (1 - p)))
    var = float(differ.sum()) - mean**2
    q = min(max(mean / w, 1e-6), 1 - 1e-6)
    rho = min(max((var / (w * q * (1 - q)) - 1) / max(w - 1, 1), 1e-4), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    log = [0.0]  # P(0), then each next by the ratio of neighbours
    for k in range(w):
        log[0] += np.log((b + k) / (a + b + k))
    for k in range(most):
        log.append(log[-1] + np.log((w - k) / (k + 1) * (a + k) / (b + w - k - 1)))
    return np.cumsum(np.exp(log)) * n * (n - 1) / 2


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of nearly equal size: each starts with the bit least correlated to those taken, then takes the most correlated to its own."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        own = [min(left, key=lambda j: (r[j, [x for g in groups for x in g]].sum(), j))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda j: (r[j, own].sum(), -j))
            own.append(best)
            left.remove(best)
        groups.append(sorted(own))
    return groups


def allocate(costs: list[np.ndarray], total: int) -> tuple[float, list[int]] | None:
    """None if there are none, or thresholds (-1: unused, whose cost is none) with the given sum and the least total cost. costs[i][t]: of threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for s, (was, own) in best.items():
            for t in range(-1, len(cost)):
                v = was + (cost[t] if t >= 0 else 0.0)
                if s + t not in new or v < new[s + t][0]:
                    new[s + t] = (v, [*own, t])
        best = new
    return best.get(total)


def plan(n: int, both: np.ndarray, distance: int, most_partitions: int = 4) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to probe. The cost of a candidate is 1, of each probe key 1 as well."""
    found = []
    for m in range(1, most_partitions + 1):
        groups = group_bits(both, n, m)
        costs = []
        for g in groups:
            pairs = expected_within(n, both, g, distance)
            probes = np.array([1, 1 + len(g), 1 + len(g) + len(g) * (len(g) - 1) // 2][: distance + 1], float)
            costs.append((pairs + n * probes)[:2])  # a threshold of 2 or more costs more keys than any split
        if (best := allocate(costs, distance - m + 1)) is not None:
            found.append((*best, groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


# ---------------------------------------------------------------- links


def _mask(bits: list[int]) -> int:
    """Bit 0 is the most significant one, as np.unpackbits has it. Signed."""
    v = sum(1 << (BITS - 1 - b) for b in bits)
    return v - (1 << 64) if v >= 1 << 63 else v


def _flips(value: Column, bits: list[int]) -> Column:
    return F.array(value, *[value.bitwiseXOR(F.lit(_mask([b])).cast("long")) for b in bits])


def links(fps: DataFrame, distance: int = 2, bucket: int = 32) -> DataFrame:
    """u, v: links that connect all distinct fingerprints (column fp) at `distance` (2 or less) or fewer differing bits."""
    n, both = bit_statistics(fps)
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= distance
    found, crowded = [], []
    for bits, threshold in plan(n, both, distance):
        masked = F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long"))
        index = fps.select(masked.alias("key"), "fp")
        # a probe of threshold 1 also looks at the keys one bit away
        probe = fps.select(F.explode(_flips(masked, bits)).alias("key"), "fp") if threshold else index
        crowd = probe.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
        # the members of other buckets: at most `bucket` of them, so a list of them is bounded
        small = probe.join(crowd, "key", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"), F.count(F.lit(1)).alias("n")).where("n > 1")
        pairs = small.select("fps", F.posexplode("fps").alias("i", "u")).select("u", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("v"))
        found.append(pairs.where(near(F.col("u"), F.col("v"))))
        crowded.append(probe.join(crowd, "key", "left_semi").select("fp"))
    # each fingerprint of a crowded bucket meets the others at the values one bit away; at most 65 can meet at one value
    meet = reduce(DataFrame.union, crowded).distinct().select("fp", F.explode(_flips(F.col("fp"), list(range(BITS)))).alias("at"))
    stars = meet.groupBy("at").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("u", F.explode("fps").alias("v"))
    return reduce(DataFrame.union, [*found, stars.where(near(F.col("u"), F.col("v")))]).where("u <> v").distinct()


def _rooted(prints: DataFrame, value: str, distance: int, bucket: int) -> DataFrame:
    """fp, least: of every fingerprint the least value in its component."""
    distinct = c.cut(prints.groupBy("fp").agg(F.min(value).alias("least")))
    cc = connected_components(links(distinct, distance, bucket))
    # one row a fingerprint: its root, and the least value of that root
    rooted = distinct.join(cc, distinct.fp == cc.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    return rooted.drop("least").join(rooted.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, bucket: int = 32) -> DataFrame:
    """doc_id, fp, component_id: the least doc_id that is reachable over links."""
    prints = c.cut(fingerprints(docs, id_col, text_col))
    return prints.join(_rooted(prints, "doc_id", distance, bucket), "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, distance: int = 2, bucket: int = 32) -> DataFrame:
    """One document of each group stays: that with the least doc_id. Rows that share an id but not the text are documents of their own; rows equal in both are one. Rows without an id all stay."""
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    # a fingerprint's documents are those of its texts: ids and hashes of texts stand for them
    prints = fingerprints(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), keep_key=True)
    prints = c.cut(prints.select("fp", F.struct("doc_id", "row_key").alias("document")))
    kept = _rooted(prints, "document", distance, bucket).select("least.doc_id", "least.row_key").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id", "row_key").orderBy("doc_id"))
    stay = rows.join(kept.hint("merge"), ["doc_id", "row_key"], "left_semi").withColumn("place", first).where("place = 1")
    fields = [F.col(f"row.`{x}`").alias(x) for x in docs.columns]
    return stay.select(*fields).unionByName(rows.where(F.col("doc_id").isNull()).select(*fields))
