"""Groups of spelling variants by a variable-length gram index.

Words one edit apart (one code point inserted, deleted or replaced) are near. To find them without comparing all words, a
dictionary of grams is built from the words: all grams of SHORT code points, and longer ones only below grams that are
frequent, so lists stay short however many words there are. Each word is decomposed into the longest dictionary gram at every
place. An edit at place i can change only grams that were read up to there (p <= i <= p + length), since a longest match never looks
beyond the point where it fails. The largest number of those over all places is the word's bound of affected grams. A near word shares all
other grams, at the same place or moved by one, so of the bound plus one rarest grams it shares one: only these short lists are merged, and
every word they give is verified. Grams inside longer ones are kept, so an edit reaches no gram to its right.

Words whose bound takes all of their grams (short ones with long frequent grams) can't ask the index, but are found in it by
all others; among themselves they meet at equal texts with one code point left out. Nothing is capped: results are exact.

A null text has no words; a null id gives no edit by rule, as its hash is null. Texts of any length count whole; repeated rows count as
often as they occur. Ties of forms go to the smallest word in code-point order. An empty table gives no rows. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

SHORT = 2
#: Most inner grams of the dictionary, and most words that are sent to all tasks.
MOST_GRAMS = 1 << 20
FEW = 50_000
#: Forms grow at least fivefold at each step, so five doublings outlast any 64-bit count.
DOUBLINGS = 5

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word: each run of letters of each text, A-Z lower, with one code point deleted wherever the rule says so."""
    runs = docs.select(F.col(key).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(f"({RUN})"))).alias("w"))
    h = F.crc32(F.concat("id", F.lit(":"), "w").cast("binary"))
    at = (F.col("h") % F.char_length("w")).cast("int")
    cut = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.char_length("w")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("w")).alias("word"))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    found = occurrences(docs, key, text).where(F.char_length("word") >= least_length)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _places(words: DataFrame, q: int) -> DataFrame:
    """gram: the q code points at every place of every word."""
    long = words.where(F.char_length("word") >= q)
    return long.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - (q - 1)), lambda p: F.substring(F.col("word"), p, F.lit(q)))).alias("gram"))


def frequent_grams(words: DataFrame, longest: int = 5, frequent: int = 4000) -> dict[str, int]:
    """The dictionary's inner grams: those of SHORT to longest - 1 code points that occur over `frequent` times, with their counts.

    The dictionary is all grams of SHORT code points and all whose gram without the last is one of these. As at most (places of
    all words) / `frequent` grams of a length are frequent, `frequent` rises where MOST_GRAMS would be passed: the set is bounded.
    """
    places = words.agg(F.sum(F.greatest(F.char_length("word") - 1, F.lit(0)))).first()[0] or 0
    least, found = max(frequent, places * max(longest - SHORT, 1) // MOST_GRAMS), {}
    for q in range(SHORT, longest):
        at = _places(words, q)
        if q > SHORT:
            inner = words.sparkSession.createDataFrame([(g,) for g in found if len(g) == q - 1], "parent string")
            at = at.join(F.broadcast(inner), F.substring("gram", 1, q - 1) == F.col("parent"), "left_semi")
        level = {r["gram"]: r["k"] for r in at.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > least).collect()}
        found |= level
        if not level:
            break
    return found


def longest_grams(word: str, inner: dict[str, int], longest: int) -> tuple[list[int], int]:
    """The length of the longest dictionary gram at each place of a word, and how many of them one edit can change at most."""
    n, lengths = len(word), []
    for p in range(n - SHORT + 1):
        q = SHORT
        while q < longest and p + q < n and word[p : p + q] in inner:
            q += 1
        lengths.append(q)
    # the gram at p is read up to p + q, so edits at p to p + q may change it
    hits = [0] * (n + 2)
    for p, q in enumerate(lengths):
        hits[p] += 1
        hits[p + q + 1] -= 1
    most = at = 0
    for h in hits:
        at += h
        most = max(most, at)
    return lengths, most


def decompose(words: DataFrame, inner: dict[str, int], longest: int = 5) -> DataFrame:
    """word, n, affected, weak, and grams (p, gram) of the words of SHORT code points or more, by how rare they may be: those that end the dictionary's paths first, by the count of the gram that they extend; then frequent ones."""
    shared = words.sparkSession.sparkContext.broadcast(inner)  # at most MOST_GRAMS

    def run(batches):
        own = shared.value
        for b in batches:
            texts, out, affected = b.column(0).to_pylist(), [], []
            for w in texts:
                lengths, most = longest_grams(w, own, longest)
                cuts = [(p, w[p : p + q]) for p, q in enumerate(lengths)]
                cuts.sort(key=lambda x: (own.get(x[1], 0), own.get(x[1][:-1], 0), x[0]))
                out.append([{"p": p, "gram": g} for p, g in cuts])
                affected.append(most)
            grams = pa.array(out, pa.list_(pa.struct([("p", pa.int32()), ("gram", pa.string())])))
            weak = [a >= len(g) for a, g in zip(affected, out, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(affected, pa.int32()), pa.array(weak, pa.bool_()), grams], ["word", "n", "affected", "weak", "grams"])

    return words.where(F.char_length("word") >= SHORT).select("word", "n").mapInArrow(run, "word string, n long, affected int, weak boolean, grams array<struct<p:int,gram:string>>")


def _one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame, longest: int = 5, frequent: int = 4000) -> DataFrame:
    """a, na, b, nb of all pairs of words (word, n; each word once) one edit apart, each pair once, a < b in length and then in order."""
    words = c.cut(words.select("word", "n"))
    parts = c.cut(decompose(words, frequent_grams(words, longest, frequent), longest))
    size = F.char_length("word")
    # a key stands for a gram, the length of a word that has it and its place there; equal keys of unequal grams are only more to verify
    key = lambda gram, length, place: F.xxhash64(gram, length.cast("int"), place.cast("int"))
    index = lambda rows: rows.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(F.transform("grams", lambda g: key(g["gram"], size, g["p"]))).alias("key"))
    asking = parts.where("not weak")
    rarest = F.slice("grams", F.lit(1), F.col("affected") + 1)

    def probes(ways: list[tuple[int, int]]) -> DataFrame:
        """Keys of the rarest grams in near words whose length and place differ by so much."""
        to = lambda d, m: F.transform(rarest, lambda g: key(g["gram"], size + d, g["p"] + m))
        return asking.select(F.col("word").alias("a"), F.col("n").alias("na"), F.explode(F.concat(*(to(d, m) for d, m in ways))).alias("key"))

    longer = F.char_length("a") < F.char_length("b")
    strong = probes([(0, 0), (1, 0), (1, 1)]).join(index(asking), "key").where((longer | (F.col("a") < F.col("b"))) & _one_edit(F.col("a"), F.col("b")))
    by_index = strong.select("a", "na", "b", "nb")
    unable = parts.where("weak")
    if n_weak := unable.count():
        # few as a rule; they can't ask, so all others ask for them
        held = index(unable)
        met = probes([(0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1)]).join(F.broadcast(held) if n_weak <= FEW else held, "key").where(_one_edit(F.col("a"), F.col("b")))
        by_index = by_index.union(met.select("a", "na", "b", "nb"))
    weak = parts.where("weak").select("word", "n").union(words.where(size < SHORT))
    # a near pair agrees once one code point is left out of the longer or of both
    short = weak.select("word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(F.col("word"), F.lit(1), i - 1), F.substring(F.col("word"), i + 1, size)))))).alias("rest"))
    left, right = short.select(F.col("word").alias("a"), F.col("n").alias("na"), "rest"), short.select(F.col("word").alias("b"), F.col("n").alias("nb"), "rest")
    by_rest = left.join(right, "rest").where((F.col("a") < F.col("b")) & _one_edit(F.col("a"), F.col("b"))).select("a", "na", "b", "nb")
    flip = lambda x, y: F.when((F.char_length("a") < F.char_length("b")) | (F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b")), F.col(x)).otherwise(F.col(y))
    both = by_index.union(by_rest)
    return both.select(flip("a", "b").alias("a"), flip("na", "nb").alias("na"), flip("b", "a").alias("b"), flip("nb", "na").alias("nb")).distinct()


def variants(words: DataFrame, ratio: int = 5, longest: int = 5, frequent: int = 4000) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word: form is its most frequent near word (ties: the smallest) if it occurs `ratio` times as often or more, root the last of the forms."""
    words = c.cut(words.select("word", "n"))
    pairs = c.cut(near_pairs(words, longest, frequent))
    ways = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    near = ways.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("top"))
    judged = words.join(near, "word", "left").withColumn("counts", -F.col("top.m") >= F.lit(ratio) * F.col("n"))
    judged = c.cut(judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("counts"), F.col("top.other")).alias("form"), F.when(F.col("counts"), -F.col("top.m")).alias("form_n")))
    step = judged.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        after = step.select(F.col("word").alias("at"), F.col("root").alias("onward"))
        step = c.cut(step.join(after, F.col("root") == F.col("at"), "left").select("word", F.coalesce("onward", "root").alias("root")))
    return judged.join(step, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
