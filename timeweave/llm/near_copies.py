"""Near copies of whole texts: Jaccard similarity of their 5-word shingles of `least` or more.

Candidates come from two sources. SimHash fingerprints of the 5-word shingles are probed by the generalised pigeonhole
(`simhash.links`): copies with few edits differ in two bits or fewer. A similarity of 0.8 differs by about 10 of 64 bits,
for which no such index stays small, so MinHash adds the wider pairs: 100 minima in 20 bands of 5, by which a pair of
similarity 0.8 meets with a chance of 0.9996 and one of 0.9 nearly always. Each candidate is verified by the exact
similarity of its two sets of shingles, so no pair below the bound is a link. Words are those of op10 (runs without white
space, A-Z lower); a text of fewer than five words is one shingle.

Links by fingerprints and by crowded buckets come first: of a bucket with more than `bucket` distinct texts each meets one of
them. Then smaller buckets are compared pair by pair, and crowded ones are cut `turns` times by the texts' value in another
band: small parts are compared pair by pair, of larger ones a text of each group found so far meets one of them. Only texts that
no links connect yet are paired there, so a large group of near copies costs no pairs of its own. What is still of several groups in
a crowded bucket then meets by an exact prefix filter: of two similar texts the rarest shingles of each, a fifth of them and one,
hold a common one. So every pair of similarity 0.8 among those texts is found, at whatever size of buckets and of shingles' lists.

Texts without words are copies of each other; a null text is one. Rows that share an id but not the text are documents of
their own. Rows equal in id and text are one. Ties go to the smaller id, then to the smaller hash of the text. Rows without
an id all stay. An empty table gives no rows. Other columns, whatever their names, go along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c
from . import simhash
from .components import connected_components

WIDTH, BANDS, ROWS = 5, 20, 5
FEW_KEYS = 1_000_000
_RNG = np.random.default_rng(20240711)
_MULTIPLY = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_K = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of every shingle, in order, and a hash of each row's words in order (0: none)."""
    row, start, end = c.words(data, offsets)
    h = c.word_hashes(data, start, end, lower=True)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    same = np.zeros(n, np.uint64)
    own = np.flatnonzero(count)
    if len(own):
        place = (np.arange(len(h)) - first[row]).astype(np.uint64)
        same[own] = np.add.reduceat(c.mix(h ^ c.mix((place + np.uint64(1)) * _K)), first[own])
    # a shingle starts at every word that four others follow, and at the first word of a shorter row
    left = count[row] - (np.arange(len(h)) - first[row])
    at = np.flatnonzero((left >= WIDTH) | (left == count[row]))
    s = np.zeros(len(at), np.uint64)
    for k in range(WIDTH):
        has = left[at] > k
        s[has] = c.mix(s[has] * _K + h[at[has] + k])
    return row[at], s, same


def bands(row: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """n x BANDS hashes of each row's minima; zeros in rows without shingles."""
    out = np.zeros((n, BANDS), np.uint64)
    own, first = np.unique(row, return_index=True)
    if len(own):
        for k in range(BANDS * ROWS):
            low = np.minimum.reduceat(s * _MULTIPLY[k] + _ADD[k], first)
            out[own, k // ROWS] = c.mix(out[own, k // ROWS] * _K + low)
    return out


def _signatures(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            data, offsets = c.byte_view(c.texts(b.column(1)))
            for lo, hi in c.slices(offsets):
                row, s, same = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                keys = pa.array(bands(row, s, hi - lo).view(np.int64).ravel())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS), pa.int32()), keys)
                fp = simhash.majority(row, s, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(same.view(np.int64)), pa.array(fp.view(np.int64)), listed], names=["doc_id", "row_key", "same", "fp", "bands"])

    return docs.mapInArrow(c.lean(run), "doc_id long, row_key long, same long, fp long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """same and the sorted distinct shingles of each text."""

    def run(batches):
        for b in batches:
            data, offsets = c.byte_view(c.texts(b.column(0)))
            for lo, hi in c.slices(offsets):
                row, s, same = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                sets = [np.unique(s[x:y]).view(np.int64) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(same.view(np.int64)), pa.array(sets, pa.list_(pa.int64()))], names=["same", "shingles"])

    return docs.mapInArrow(c.lean(run), "same long, shingles array<long>")


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(f"{a} <> {b}").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """u < v: texts with equal fingerprints, or with such as differ in two bits or fewer; one text stands for a fingerprint."""
    own = nodes.where("same <> 0").select("same", "fp")
    heads = c.cut(own.groupBy("fp").agg(F.min("same").alias("head")))
    equal = _ordered(own.join(heads, "fp"), "same", "head")
    near = simhash.links(heads.select("fp"))
    ends = near.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("a")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("b")), "v")
    return equal.union(_ordered(ends, "a", "b"))


def _index(nodes: DataFrame, turns: int = 0) -> DataFrame:
    """same, root, band, key: a row for each band; with turns also cuts: the values of as many further bands."""
    cuts = [F.array(*(F.expr(f"bands[(band + {t}) % {BANDS}]") for t in range(1, turns + 1))).alias("cuts")] if turns else []
    return nodes.where("same <> 0").select("same", "root", "bands", F.posexplode("bands").alias("band", "key")).select("same", "root", "band", "key", *cuts)


def _at(index: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """The rows of the index that lie at these keys, with the keys' columns; few keys (24 MB) are sent to the index, which then is not shuffled."""
    return index.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, key)


def _sizes(index: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Buckets that hold texts of more than one group: how many, and one of them."""
    pivot = F.min(F.struct(F.xxhash64("same", F.lit(seed)).alias("h"), "same", "root"))
    sizes = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), pivot.alias("first"))
    return c.cut(sizes.where("lo < hi").select(*key, "n", F.col("first.same").alias("pivot"), F.col("first.root").alias("pivot_root")))


def _pairs(index: DataFrame, sizes: DataFrame, key: list[str], bucket: int) -> DataFrame:
    """u < v: all pairs of different groups in small buckets."""
    small = index.join(sizes.where(F.col("n") <= bucket).select(*key), key).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("same", "root"))).alias("all"))
    pairs = small.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.expr("slice(all, i + 2, size(all))")).alias("b"))
    return pairs.where("a.root <> b.root").select(F.col("a.same").alias("u"), F.col("b.same").alias("v")).distinct()


def _stars(index: DataFrame, sizes: DataFrame, key: list[str], bucket: int) -> DataFrame:
    """u, v: in crowded buckets one text of each group with the bucket's own."""
    crowd = sizes.where(F.col("n") > bucket).drop("n")
    return index.where("same = root").join(crowd, key).where("root <> pivot_root").select(F.col("same").alias("u"), F.col("pivot").alias("v")).distinct()


def _by_prefix(sets: DataFrame, texts: DataFrame, least: float, block: int = 512) -> DataFrame:
    """u < v: pairs of different groups among the texts (same, root) that hold all whose similarity is `least` or more.

    Shingles of one group alone come first in the order of rarity and need no list. A long list is cut into blocks of about `block`
    texts by hash, and each pair of blocks is a group of its own, so no task holds a list whole.
    """
    own = texts.join(sets, "same").select("same", "root", "n", F.explode("shingles").alias("s"))
    many = c.cut(own.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s", "c"))
    shared = own.join(many, "s").groupBy("same", "root", "n").agg(F.sort_array(F.collect_list(F.struct("c", "s"))).alias("all"))
    # places count from 0 over all shingles of a text, those of one group alone before the others
    alone = F.col("n") - F.size("all")
    first = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - alone).cast("int")
    lists = shared.where(first > 0).select("same", "root", "n", alone.alias("alone"), F.posexplode(F.slice("all", F.lit(1), first)).alias("at", "x"))
    lists = lists.select(F.col("x.s").alias("s"), "same", "root", "n", (F.col("alone") + F.col("at")).alias("at"))
    # a text whose first common shingle lies here meets none of more shingles than `most`: rows that no other of the list can meet are left out
    lists = c.cut(lists.withColumn("most", (F.col("n") - F.col("at")) * ((1 + least) / least) - F.col("n") + 1e-6))
    bounds = lists.groupBy("s").agg(F.min("n").alias("fewest"), F.max("most").alias("widest"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    lists = lists.join(bounds.select("s", "fewest", "widest"), "s").where("most >= fewest and n <= widest").select("s", "same", "root", "n", "at")
    # two texts whose first common shingle this is share no more than what follows it in either
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    enough = (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9) & (most * (1 + F.lit(least)) >= F.lit(least) * (F.col("x.n") + F.col("y.n")) - 1e-9)
    return _across(lists, block).where(enough).select(F.col("x.same").alias("u"), F.col("y.same").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _across(lists: DataFrame, block: int) -> DataFrame:
    """x, y (same, n, at, b): pairs of different groups (root) in each list (s). Those of one group are never made."""
    sizes = lists.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    cut = lists.join(sizes.select("s", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "s").withColumn("b", F.pmod(F.xxhash64("same", F.lit(5)), "blocks").cast("int"))
    dealt = cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    own = dealt.groupBy("s", "i", "j", "root").agg(F.collect_list(F.struct("same", "n", "at", "b")).alias("own"))
    met = own.groupBy("s", "i", "j").agg(F.sort_array(F.collect_list(F.struct("root", "own"))).alias("all")).where(F.size("all") > 1)
    rest = met.select("i", "j", "all", F.posexplode("all").alias("k", "g")).select("i", "j", "g.own", F.expr("flatten(transform(slice(all, k + 2, size(all)), z -> z.own))").alias("rest"))
    pairs = rest.select("i", "j", "rest", F.explode("own").alias("x")).select("i", "j", "x", F.explode("rest").alias("y"))
    return pairs.where((F.col("i") == F.col("j")) | (F.col("x.b") != F.col("y.b"))).select("x", "y")


def _sets_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """same, shingles and n, their number, of the texts asked for (same)."""
    ids = c.cut(nodes.join(asked.distinct(), "same").select("doc_id").distinct())
    # up to 32 MB of ids are sent to the texts, which then are not shuffled
    near = docs.join(F.broadcast(ids) if ids.count() <= 4_000_000 else ids, "doc_id", "left_semi").select("text")
    return c.cut(_sets(near).dropDuplicates(["same"]).withColumn("n", F.size("shingles")))


def _verified(sets: DataFrame, pairs: DataFrame, least: float, few: int = 4_000_000) -> DataFrame:
    """The pairs whose texts are similar enough; sets of too different sizes can't be. Where the texts v have no more than `few` shingles together (32 MB), they are sent to the others."""
    n = sets.select("same", "n")
    sized = pairs.join(n.select(F.col("same").alias("u"), F.col("n").alias("nu")), "u").join(n.select(F.col("same").alias("v"), F.col("n").alias("nv")), "v")
    asked = c.cut(sized.where(F.least("nu", "nv") >= F.lit(least) * F.greatest("nu", "nv") - 1e-9))
    ends = asked.select("v", "nv").distinct()
    b = sets.join(ends.select(F.col("v").alias("same")), "same", "left_semi").select(F.col("same").alias("v"), F.col("shingles").alias("b"))
    if (ends.agg(F.sum("nv")).first()[0] or 0) <= few:
        b = F.broadcast(b)
    both = asked.join(sets.select(F.col("same").alias("u"), F.col("shingles").alias("a")), "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("a", "b")))
    return both.where(F.col("shared") >= F.lit(least) * (F.col("nu") + F.col("nv") - F.col("shared")) - 1e-9).select("u", "v")


class _Links:
    """Links found so far, and the group of each text."""

    def __init__(self, nodes: DataFrame):
        self.nodes, self.edges, self.rooted = nodes, None, None

    def add(self, found: DataFrame) -> None:
        found = c.cut(found)
        if not found.isEmpty():
            self.edges = found if self.edges is None else self.edges.union(found)
            self.rooted = c.cut(connected_components(self.edges))

    def grouped(self) -> DataFrame:
        """The nodes with their group's root; a text without links is its own."""
        if self.rooted is None:
            return self.nodes.withColumn("root", F.col("same"))
        return self.nodes.join(self.rooted.withColumnRenamed("node", "same"), "same", "left").withColumn("root", F.coalesce("root", "same"))


def drop(docs: DataFrame, least: float = 0.8, bucket: int = 32, turns: int = 4) -> DataFrame:
    """One document of each group stays: that with the least doc_id. Rows without an id all stay."""
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"))
    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row_key"))
    nodes = _signatures(known.select("doc_id", "text", "row_key")).groupBy("same").agg(F.min(F.struct("doc_id", "row_key")).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = c.cut(nodes.select("same", "least", F.col("least.doc_id").alias("doc_id"), "fp", "bands"))
    links, key = _Links(nodes), ["band", "key"]
    # without links each text is its own group: a bucket's number and least text are all that is dealt out
    index = nodes.where("same <> 0").select("same", F.posexplode("bands").alias("band", "key"))
    sizes = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("same").alias("pivot")).where("n > 1")
    sizes = c.cut(sizes.select(*key, "n", "pivot"))
    crowd = sizes.where(F.col("n") > bucket).drop("n")
    first = _ordered(_at(index, crowd, key), "same", "pivot")
    stars = c.cut(first.union(_by_fingerprint(nodes)).distinct())
    met = _at(index, sizes.select(*key), key).select("same")
    sets = _sets_of(known, nodes, met.union(stars.select("u")).union(stars.select("v")))
    links.add(_verified(sets, stars, least))
    # small buckets as they are (turn 0), crowded ones once for each turn; only what lies in buckets of several groups is dealt out
    own = _index(links.grouped())
    several = c.cut(_at(own, sizes.select(*key), key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*key, "n"))
    each = F.when(F.col("n") <= bucket, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.lit(turns)))
    index = _at(_index(links.grouped(), turns), several, key).withColumn("turn", F.explode(each)).withColumn("cut", F.when(F.col("turn") > 0, F.try_element_at("cuts", F.col("turn"))).otherwise(0)).drop("n", "cuts")
    part = [*key, "turn", "cut"]
    sizes = _sizes(index, part, 1)
    links.add(_verified(sets, c.cut(_pairs(index, sizes, part, bucket).union(_stars(index, sizes, part, bucket)).distinct()), least))
    # crowded buckets that still hold several groups: their texts meet exactly
    if not (crowd := several.where(F.col("n") > bucket).select(*key)).isEmpty():
        index = _at(_index(links.grouped()), crowd, key)
        torn = index.groupBy(*key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(*key)
        texts = c.cut(index.join(torn, key).select("same", "root").distinct())
        if not texts.isEmpty():
            links.add(_verified(sets, c.cut(_by_prefix(sets, texts, least)), least))
    kept = links.grouped().groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.row_key")
    # the join leaves each partition sorted by both, so the first of equal rows costs no other sort or shuffle
    first = F.row_number().over(Window.partitionBy("doc_id", "row_key").orderBy("doc_id"))
    stay = rows.join(kept.distinct().hint("merge"), ["doc_id", "row_key"], "left_semi").withColumn("place", first).where("place = 1")
    fields = [F.col(f"row.`{x}`").alias(x) for x in docs.columns]
    return stay.select(*fields).unionByName(rows.where(F.col("doc_id").isNull()).select(*fields))
