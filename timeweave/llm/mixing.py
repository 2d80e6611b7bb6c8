"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end, then cut into blocks of equal numbers of words. The
schedule's slot i is the point i * golden ratio (mod 1, in whole numbers of a Fibonacci lattice); cumulative slot counts
map it to a source, its rank among that source's slots to a block, a second pass over the source after the first. So every
stretch of the schedule holds the sources in about their shares. A source's slots end exactly at its target: of a source
that the points favour the surplus slots are left out, those that another lacks stand at the schedule's end.

A null text has no words; documents without words are taken with zero words. The null source comes last. Repeated rows are
documents of their own; equal hashes are ordered by id and size. A very long text is cut into blocks like any other; an empty table gives
an empty mix. Other columns go along under their own names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

WORD = r"[^\x20\x09-\x0D]+"
#: Neighbouring Fibonacci numbers: their ratio is the golden ratio's. Products are decimals of 38 digits, so slots have no bound in practice.
FIBONACCI, BEFORE = 2880067194370816120, 1779979416004714189
#: Least ranges of the shuffle hash, of the schedule and of the points, and rows or slots of one; sums over one source go over ranges, not rows.
RANGES, RANGE_ROWS = 4096, 1_000_000


@dataclass(frozen=True)
class Mix:
    """weights, repeated over the sources in order; share of all words to take; most passes over a source; words of a block."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block: int = 256
    seed: str = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """Adds sums over all rows before each, in order: the rows are cut into sorted ranges, and sums go over ranges first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = c.cut(df.repartitionByRange(n, *order).withColumn("range_no", F.spark_partition_id()))
    per = ranged.groupBy("range_no").agg(*(F.sum(x).alias(f"{k}_own") for k, x in sums.items()))
    # one row a range: as many as shuffle partitions
    earlier = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("range_no", *(F.sum(f"{k}_own").over(earlier).alias(f"{k}_from") for k in sums))
    own = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda k: F.lit(0).cast(df.schema[sums[k]].dataType)
    within = ranged.select("*", *(F.coalesce(F.sum(x).over(own), zero(k)).alias(f"{k}_within") for k, x in sums.items())).join(F.broadcast(starts), "range_no")
    return within.select(*df.columns, *((F.coalesce(f"{k}_from", zero(k)) + F.col(f"{k}_within")).alias(k) for k in sums))


def targets(sized: DataFrame, mix: Mix) -> DataFrame:
    """source, s (its place), source_size, target, taken_source: one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("null_source", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long"))
    per = running(per, ["null_source", "source"], s="one")
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.col("s") % len(mix.weights) + 1).cast("int")).cast("double")
    per = per.withColumn("w", weight).withColumn("cap", mix.most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("w"))
    # filling up: in the order of cap / weight, the sources before the level's own are at their caps
    per = c.cut(running(per, ["fill", "s"], full="cap", gone="w"))
    words, weights = per.agg(F.sum("source_size"), F.sum("w")).first()
    level = per.withColumn("level", (F.lit(mix.share) * F.lit(words) - F.col("full")) / (F.lit(weights) - F.col("gone"))).where("level <= fill").agg(F.max("level")).first()[0]
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level).cast("double") * F.col("w")) if level is not None else F.col("cap").cast("double"))
    return per.select("source", "s", "source_size", "target", F.floor("target").cast("long").alias("taken_source"))


def positions(sized: DataFrame, per_source: DataFrame, mix: Mix) -> DataFrame:
    """Adds s, source_size, target and `at`, the words before a document in its source's shuffled order."""
    digits, n = 3, sized.count()
    while n > RANGE_ROWS * 16**digits:
        digits += 1
    h = F.md5(F.concat(F.lit(mix.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    docs = sized.join(per_source, sized.source.eqNullSafe(per_source.source)).select("doc_id", "size", "row_key", "s", "source_size", "target", h.alias("h"))
    docs = docs.withColumn("r", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    ranges = docs.groupBy("s", "r").agg(F.sum("size").alias("n"))
    before = ranges.select("s", "r", (F.sum("n").over(Window.partitionBy("s").orderBy("r")) - F.col("n")).alias("before"))
    own = Window.partitionBy("s", "r").orderBy("h", "doc_id", "size", "row_key")
    docs = docs.withColumn("k", F.row_number().over(own)).withColumn("within", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return docs.join(before, ["s", "r"]).withColumn("at", F.col("before") + F.col("within"))


def schedule(per_source: DataFrame, mix: Mix) -> DataFrame:
    """slot, s, block, words: the schedule. words: of the block's first words, how many the slot takes."""
    spark = per_source.sparkSession
    per = per_source.where("taken_source > 0").select("s", "source_size", "taken_source")
    per = per.withColumn("blocks", F.expr(f"(source_size + {mix.block - 1}) div {mix.block}")).withColumn("passes", F.expr("taken_source div source_size")).withColumn("rest", F.expr("taken_source % source_size"))
    per = per.withColumn("slots", F.col("passes") * F.col("blocks") + F.expr(f"(rest + {mix.block - 1}) div {mix.block}"))
    per = c.cut(running(per, ["s"], begin="slots").withColumn("to", F.col("begin") + F.col("slots")).withColumnRenamed("begin", "from"))
    total = per.agg(F.sum("slots")).first()[0] or 0
    n = max(total, 1)
    width = -(-n // max(RANGES, n // RANGE_ROWS))
    # a point's place among the slot counts laid end to end, and the source whose stretch holds it: equal cells, so no cell is hot
    place = F.expr(f"(((cast(id as decimal(19,0)) * {BEFORE}BD) % {FIBONACCI}BD) * cast({n} as decimal(18,0))) div {FIBONACCI}BD")
    points = spark.range(total).select(F.col("id").alias("slot"), place.alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    cells = per.select("s", "from", "to", F.explode(F.sequence(F.expr(f"`from` div {width}"), F.expr(f"(`to` - 1) div {width}"))).alias("cell"))
    dealt = points.join(cells, "cell").where("x >= `from` and x < `to`").select("slot", "s", F.expr(f"slot div {width}").alias("r"))
    # ranks: within a range of the schedule, after what earlier ranges hold of the source
    counted = dealt.groupBy("s", "r").agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("s", "r", (F.sum("n").over(Window.partitionBy("s").orderBy("r")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("within", F.row_number().over(Window.partitionBy("s", "r").orderBy("slot")) - 1).join(before, ["s", "r"]).select("slot", "s", (F.col("before") + F.col("within")).alias("rank"))
    have = counted.groupBy("s").agg(F.sum("n").alias("have"))
    short = per.join(have, "s", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < slots")
    tail = short.select(F.lit(total).alias("slot"), "s", F.explode(F.sequence(F.col("have"), F.col("slots") - 1)).alias("rank"))
    slots = ranked.unionByName(tail).join(per.select("s", "source_size", "blocks", "passes", "rest", "slots"), "s").where("rank < slots")
    return slots.select("slot", "s", F.expr("rank % blocks").alias("block"), F.expr(f"least({mix.block}, if(rank div blocks < passes, source_size, rest) - (rank % blocks) * {mix.block})").alias("words"))


def _taken(sized: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, source, size, row_key of every row, with source_size, target, taken. Rows that agree in all four are interchangeable."""
    per_source = c.cut(targets(sized, mix))
    at = positions(sized, per_source, mix)
    pieces = at.select("*", F.explode_outer(F.expr(f"if(size > 0, sequence(at div {mix.block}, (at + size - 1) div {mix.block}), null)")).alias("block"))
    # what the schedule takes of a piece: the part of it among the block's first words, once for each slot of the block
    slots = schedule(per_source, mix).select("s", "block", "words")
    start, end = F.greatest(F.col("at") - F.col("block") * mix.block, F.lit(0)), F.least(F.col("at") + F.col("size") - F.col("block") * mix.block, F.coalesce("words", F.lit(0)))
    joined = pieces.join(slots, ["s", "block"], "left").withColumn("part", F.greatest(F.coalesce(end - start, F.lit(0)), F.lit(0)))
    taken = joined.groupBy("s", "r", "k").agg(*(F.first(x).alias(x) for x in ("doc_id", "size", "row_key", "source_size", "target")), F.sum("part").alias("taken"))
    return taken.join(per_source.select("s", "source"), "s").select("doc_id", "source", "size", "row_key", "source_size", "target", "taken")


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """doc_id, source, size, source_size, target, taken: how many words the mix takes of each document, repeats counted."""
    sized = c.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("row_key")))
    return _taken(sized, mix).drop("row_key")


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:  # noqa: B008
    """The mix itself: each document as often as it is taken, with all its columns, whatever their names; the last pass over a source ends within a document, which keeps its first words.

    Rows that share id, source and size are told apart by a hash of all their columns, so reruns agree.
    """
    whole = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
    hashed = [F.col(f"`{f.name}`") if f.dataType.simpleString().find("map<") < 0 else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in docs.schema.fields]
    rows = docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64(*hashed).alias("row_key"))
    same = ("doc_id", "source", "size", "row_key")
    number = F.row_number().over(Window.partitionBy(*same).orderBy("row_key"))
    taken = _taken(c.cut(rows.select(*same)), mix).where("taken > 0").withColumn("number", number)
    taken = taken.select(*(F.col(x).alias(f"{x}_taken") for x in (*same, "number")), "taken")
    match = [F.col(x).eqNullSafe(F.col(f"{x}_taken")) for x in (*same, "number")]
    mixed = rows.withColumn("number", number).join(taken, match).withColumn("n_words", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), e -> least(size, taken - e * size))")))
    # the first words with what stands between them
    text = F.col("row.text")
    first = F.regexp_extract(text, r"^[\x20\x09-\x0D]*", 0)
    head = F.concat(first, F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("n_words").cast("int")), ""))
    text = F.when(F.col("n_words") < F.col("size"), head).otherwise(text)
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return mixed.select(*(new.get(x, F.col(f"row.`{x}`")).alias(x) for x in docs.columns))


#: The same in SQL, by a closed form of what the schedule takes: whole passes, then the first words of the shuffled order.
ORACLE_SQL = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as s from sized group by source),
weighted as (select *, [3.0, 1.0, 2.0][(s % 3 + 1)::int]::double as w, 2 * source_size as cap from per),
filled as (select *, (1.5 * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, s rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, s rows between unbounded preceding and 1 preceding), 0)) as lvl from weighted),
goal as (select source, source_size, least(cap::double, coalesce(max(case when lvl <= cap / w then lvl end) over () * w, cap::double)) as target from filled),
placed as (select d.doc_id, d.size, g.source_size, g.target, floor(g.target)::bigint as t,
    sum(d.size) over (partition by d.source order by md5('mix:' || coalesce(d.doc_id::varchar, '')), d.doc_id, d.size rows between unbounded preceding and current row) - d.size as pos
    from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, case when size = 0 then 0 else
    (t // source_size) * size + greatest(0, least(size, t % source_size - pos)) end::bigint as taken from placed
"""
