"""Interval algebra over half-open intervals [start_us, end_us) on each source's own clock.

Tables hold source_id, start_us, end_us (microseconds) and whatever else. Two intervals overlap if the overlap is above
zero. Joins meet on (source, time bucket), so one long source is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Default width of a time bucket.
BUCKET_US = 600 * SECOND


def overlap_us(a0, a1, b0, b1) -> Column:
    """max(0, min(ends) - max(starts))."""
    return F.greatest(F.lit(0).cast("long"), F.least(a1, b1) - F.greatest(a0, b0))


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def interval_join(a: DataFrame, b: DataFrame, how: str = "inner", width: int = BUCKET_US) -> DataFrame:
    """Pairs of one source that overlap; b's columns come with the prefix b_. how: inner or left (a's rows without pair stay).

    A pair meets in the bucket of the later of both starts only, so no pair comes twice. Empty intervals have no pair.
    """
    bb = b.select(*(F.col(x).alias(f"b_{x}") for x in b.columns)).where("b_end_us > b_start_us").withColumn("b_bucket", F.explode(_buckets(F.col("b_start_us"), F.col("b_end_us"), width)))
    aa = a.withColumn("a_bucket", F.explode_outer(F.when(F.col("end_us") > F.col("start_us"), _buckets(F.col("start_us"), F.col("end_us"), width))))
    meet = (F.col("source_id") == F.col("b_source_id")) & (F.col("a_bucket") == F.col("b_bucket"))
    near = (F.col("start_us") < F.col("b_end_us")) & (F.col("b_start_us") < F.col("end_us")) & (F.col("a_bucket") == F.floor(F.greatest("start_us", "b_start_us") / width))
    if how == "inner":
        return aa.join(bb, meet & near).drop("a_bucket", "b_bucket")
    # a row spread over buckets finds no pair in some of them: those that find none in any are added once
    found = aa.join(bb, meet & near).drop("a_bucket", "b_bucket")
    paired = found.select(*(F.col(x).alias(f"_{k}") for k, x in enumerate(a.columns))).distinct()
    none = a.join(paired, reduce(lambda p, q: p & q, [F.col(x).eqNullSafe(F.col(f"_{k}")) for k, x in enumerate(a.columns)]), "left_anti")
    return found.unionByName(none, allowMissingColumns=True)


def stab_join(points: DataFrame, intervals: DataFrame, time: str = "time_us", width: int = BUCKET_US) -> DataFrame:
    """Each point with every interval of its source that holds it: start <= t < end."""
    b = intervals.select(*(F.col(x).alias(f"b_{x}") for x in intervals.columns)).where("b_end_us > b_start_us").withColumn("b_bucket", F.explode(_buckets(F.col("b_start_us"), F.col("b_end_us"), width)))
    t = F.col(time)
    return points.join(b, (F.col("source_id") == F.col("b_source_id")) & (F.floor(t / width) == F.col("b_bucket")) & (F.col("b_start_us") <= t) & (t < F.col("b_end_us"))).drop("b_bucket")


def asof_prev(points: DataFrame, starts: DataFrame, value: str, time: str = "time_us", start: str = "start_us", or_first: bool = True) -> DataFrame:
    """Each point with `value` of the last start at or before it; before all starts, that of the first (or_first)."""
    right = starts.select("source_id", F.col(start).alias("_t"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    both = points.withColumn("_t", F.col(time)).withColumn("_side", F.lit(1)).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("source_id").orderBy("_t", "_side", "_v")
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn(value, F.coalesce(before, first) if or_first else before).where("_side = 1").drop("_t", "_v", "_side")


def nearest_join(points: DataFrame, samples: DataFrame, value: str, tolerance: int, time: str = "time_us") -> DataFrame:
    """Each point with the nearer of its two neighbouring samples (the last before, the first at or after it).

    Only these two are looked at; each must lie in the point's [lo_us, hi_us) and within the tolerance. Ties: the earlier.
    """
    right = samples.select("source_id", F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_s"), F.lit(0).alias("_side"))
    left = points.withColumn("_t", F.col(time)).withColumn("_side", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True)
    at = F.col(time)
    # a sample at the point's own time is its next one: it sorts behind the point for `previous` and before it for `next`
    down = Window.partitionBy("source_id").orderBy("_t", F.col("_side").desc(), F.col("_s.v")).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("source_id").orderBy(F.col("_t"), F.col("_side").desc(), F.col("_s.v")).rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_p", F.last("_s", ignorenulls=True).over(down)).withColumn("_n", F.first("_s", ignorenulls=True).over(up)).where("_side = 1")
    ok = lambda s: (s["t"] >= F.col("lo_us")) & (s["t"] < F.col("hi_us")) & (F.abs(s["t"] - at) <= tolerance)
    p, n = F.col("_p"), F.col("_n")
    p, n = F.when(ok(p), p), F.when(ok(n), n)
    best = F.when(p.isNull() | (n.isNotNull() & (n["t"] - at < at - p["t"])), n).otherwise(p)
    return both.withColumn("_b", best).withColumn("sample_us", F.col("_b.t")).withColumn(value, F.col("_b.v")).drop("_t", "_s", "_side", "_p", "_n", "_b")


def midpoint_assign(words: DataFrame, windows: DataFrame, width: int = BUCKET_US) -> DataFrame:
    """Each word with the half-open window that holds its midpoint."""
    return stab_join(words.withColumn("mid_us", F.expr("(start_us + end_us) div 2")), windows, "mid_us", width)


def assign_speaker(words: DataFrame, turns: DataFrame, least: float = 0.5, rival: float = 0.5) -> DataFrame:
    """word_id, speaker (null if unclear), coverage, candidates: the speaker with most overlap.

    It needs a share of the word of `least` or more, and the runner-up less than `rival` times its overlap. Ties: the earlier turn.
    """
    pairs = interval_join(words.select("source_id", "word_id", "start_us", "end_us"), turns.select("source_id", "speaker", "start_us", "end_us"))
    own = overlap_us(F.col("start_us"), F.col("end_us"), F.col("b_start_us"), F.col("b_end_us"))
    per = pairs.groupBy("source_id", "word_id", "start_us", "end_us", F.col("b_speaker").alias("s")).agg(F.sum(own).alias("us"), F.min("b_start_us").alias("first"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("us")).alias("neg"), F.col("first"), F.col("s"))))
    best = per.groupBy("source_id", "word_id", "start_us", "end_us").agg(ranked.alias("r"))
    top, second = -F.col("r")[0]["neg"], F.when(F.size("r") > 1, -F.try_element_at("r", F.lit(2))["neg"]).otherwise(F.lit(0))
    coverage = top / (F.col("end_us") - F.col("start_us"))
    best = best.withColumn("coverage", F.round(coverage, 6)).withColumn("speaker", F.when((coverage >= least) & (second < rival * top), F.col("r")[0]["s"])).withColumn("candidates", F.expr("transform(r, x -> x.s)"))
    out = words.select("source_id", "word_id").join(best.select("source_id", "word_id", "speaker", "coverage", "candidates"), ["source_id", "word_id"], "left")
    return out


# ---------------------------------------------------------------- unions, islands, gaps, grids


def _before(order: Window, key: list[str]) -> Window:
    return Window.partitionBy(*key).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, -1)


def union_duration(intervals: DataFrame, key: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """The measure of the union of each key's intervals."""
    before = F.max("end_us").over(_before(Window, list(key)))
    own = F.greatest(F.lit(0).cast("long"), F.col("end_us") - F.greatest("start_us", F.coalesce(before, F.col("start_us"))))
    return intervals.where("end_us > start_us").withColumn("own", own).groupBy(*key).agg(F.sum("own").alias("union_us"))


def merge_islands(intervals: DataFrame, gap_us: int = 0, key: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Intervals that overlap, touch or lie within the gap become one: start, end, members."""
    before = F.max("end_us").over(_before(Window, list(key)))
    flagged = intervals.where("end_us > start_us").withColumn("fresh", (before.isNull() | (F.col("start_us") > before + gap_us)).cast("int"))
    island = F.sum("fresh").over(Window.partitionBy(*key).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.withColumn("island", island).groupBy(*key, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("members")).drop("island")


def gaps(intervals: DataFrame, sources: DataFrame) -> DataFrame:
    """The complement of each source's intervals in [0, duration_us)."""
    own = intervals.join(sources.select("source_id", "duration_us"), "source_id").select("source_id", F.greatest("start_us", F.lit(0)).alias("start_us"), F.least("end_us", "duration_us").alias("end_us")).where("end_us > start_us")
    edges = own.unionByName(sources.select("source_id", F.col("duration_us").alias("start_us"), F.col("duration_us").alias("end_us")))
    before = F.coalesce(F.max("end_us").over(_before(Window, ["source_id"])), F.lit(0))
    return edges.select("source_id", before.alias("gap_start"), F.col("start_us").alias("gap_end")).where("gap_end > gap_start").select("source_id", F.col("gap_start").alias("start_us"), F.col("gap_end").alias("end_us"))


def elementary_grid(*tables: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Neighbouring pairs of all distinct boundaries of a source; with sources, clipped to [0, duration_us] and those two added."""
    ends = reduce(DataFrame.unionByName, [t.select("source_id", F.explode(F.array("start_us", "end_us")).alias("t")) for t in tables])
    if sources is not None:
        d = sources.select("source_id", "duration_us")
        ends = ends.join(d, "source_id").select("source_id", F.greatest(F.lit(0), F.least("t", "duration_us")).alias("t")).unionByName(d.select("source_id", F.explode(F.array(F.lit(0).cast("long"), "duration_us")).alias("t")))
    lead = F.lead("t").over(Window.partitionBy("source_id").orderBy("t"))
    return ends.distinct().select("source_id", F.col("t").alias("start_us"), lead.alias("end_us")).where("end_us is not null")


def overlap_intervals(turns: DataFrame) -> DataFrame:
    """Maximal intervals in which the same two or more distinct speakers are active."""
    cells = elementary_grid(turns)
    alive = stab_join(cells, turns.select("source_id", "speaker", "start_us", "end_us"), "start_us").groupBy("source_id", "start_us", "end_us").agg(F.sort_array(F.collect_set("b_speaker")).alias("speakers")).where(F.size("speakers") > 1)
    w = Window.partitionBy("source_id").orderBy("start_us")
    fresh = (F.lag("end_us").over(w).isNull() | (F.lag("end_us").over(w) != F.col("start_us")) | (F.lag("speakers").over(w) != F.col("speakers"))).cast("int")
    island = alive.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w))
    return island.groupBy("source_id", "island", "speakers").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).select("source_id", "start_us", "end_us", F.array_join("speakers", ",").alias("speakers"))


def split_long(cells: DataFrame, most_us: int) -> DataFrame:
    """Cells longer than most_us in the fewest equal parts (ends by whole division)."""
    n = F.expr(f"(end_us - start_us + {most_us - 1}) div {most_us}")
    parts = cells.withColumn("parts", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cut = lambda k: F.col("start_us") + F.expr(f"((end_us - start_us) * ({k})) div parts")
    others = [x for x in cells.columns if x not in ("start_us", "end_us")]
    return parts.select(*others, cut("k").alias("start_us"), cut("k + 1").alias("end_us"))


def camera_grid(tables: list[DataFrame], frames: DataFrame, sources: DataFrame, most_us: int = SECOND) -> DataFrame:
    """The elementary grid with the midpoints between frames as further boundaries; long cells split."""
    nxt = F.lead("time_us").over(Window.partitionBy("source_id").orderBy("time_us"))
    mids = frames.select("source_id", "time_us").distinct().select("source_id", (F.col("time_us") + nxt).alias("t")).where("t is not null").select("source_id", F.expr("t div 2").alias("start_us"), F.expr("t div 2").alias("end_us"))
    return split_long(elementary_grid(*tables, mids, sources=sources), most_us)


def speaker_islands(words: DataFrame) -> DataFrame:
    """Runs of words with one speaker in one segment: a new run where either changes."""
    w = Window.partitionBy("source_id").orderBy("start_us", "word_id")
    changed = ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | ~F.col("segment_id").eqNullSafe(F.lag("segment_id").over(w)) | (F.row_number().over(w) == 1)
    runs = words.withColumn("fresh", changed.cast("int")).withColumn("run", F.sum("fresh").over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_us", "word_id", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("source_id", "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.first("speaker").alias("speaker"), F.count(F.lit(1)).alias("n_words"), text.alias("text"))


def scene_windows(scenes: DataFrame, shots: DataFrame, sources: DataFrame, most_us: int = 3 * SECOND) -> DataFrame:
    """A tiling of [0, duration): scenes and the gaps between them (FALLBACK), cut at shots' edges, then into parts of at most most_us."""
    fallback = gaps(scenes, sources).withColumn("kind", F.lit("FALLBACK"))
    base = scenes.select("source_id", "start_us", "end_us", F.lit("SCENE").alias("kind")).unionByName(fallback)
    cells = elementary_grid(base, shots.select("source_id", "start_us", "end_us"), sources=sources)
    return split_long(stab_join(cells, base, "start_us").select("source_id", "start_us", "end_us", F.col("b_kind").alias("kind")), most_us)


def evidence_windows(turns: DataFrame, edges: DataFrame, most_us: int = 3 * SECOND, least_us: int = SECOND, policy: str = "drop") -> DataFrame:
    """Turns cut at edges, then into slices of most_us. What remains and is shorter than least_us: dropped (drop), joined and halved with the slice before it (balanced), or a slice of full length that ends with it (anchor)."""
    ids = turns.select("source_id", "turn_id", "speaker", "start_us", "end_us")
    inside = edges.select("source_id", F.col("time_us").alias("start_us"), (F.col("time_us") + 1).alias("end_us"))
    cuts = interval_join(ids, inside).where("b_start_us > start_us").groupBy("source_id", "turn_id").agg(F.collect_set("b_start_us").alias("cuts"))
    whole = ids.join(cuts, ["source_id", "turn_id"], "left").withColumn("cuts", F.array_sort(F.array_distinct(F.concat(F.array("start_us", "end_us"), F.coalesce("cuts", F.array().cast("array<bigint>"))))))
    piece = whole.select("source_id", "turn_id", "speaker", F.explode(F.expr("transform(slice(cuts, 1, size(cuts) - 1), (x, i) -> struct(x as a, cuts[i + 1] as b))")).alias("p")).select("source_id", "turn_id", "speaker", "p.a", "p.b")
    full = F.expr(f"(b - a) div {most_us}")
    rest = F.col("b") - F.col("a") - full * most_us
    regular = F.when(full > 0, F.expr(f"transform(sequence(0L, (b - a) div {most_us} - 1), k -> struct(a + k * {most_us} as s, a + (k + 1) * {most_us} as e))")).otherwise(F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"))
    tail = F.array(F.struct((F.col("b") - rest).alias("s"), F.col("b").alias("e")))
    if policy == "balanced":
        last = F.expr(f"b - ((b - a) - ((b - a) div {most_us} - 1) * {most_us}) div 2")
        two = F.array(F.struct((F.col("b") - rest - most_us).alias("s"), last.alias("e")), F.struct(last.alias("s"), F.col("b").alias("e")))
        short = F.when(full > 0, F.concat(F.slice(regular, F.lit(1), F.greatest(full.cast("int") - 1, F.lit(0))), two)).otherwise(regular)
    elif policy == "anchor":
        short = F.when(full > 0, F.concat(regular, F.array(F.struct((F.col("b") - most_us).alias("s"), F.col("b").alias("e"))))).otherwise(regular)
    else:
        short = regular
    slices = F.when(rest == 0, regular).when(rest >= least_us, F.concat(regular, tail)).otherwise(short)
    return piece.select("source_id", "turn_id", "speaker", F.explode(slices).alias("w")).select("source_id", "turn_id", "speaker", F.col("w.s").alias("start_us"), F.col("w.e").alias("end_us"))


def aba_interruptions(runs: DataFrame, most_us: int) -> DataFrame:
    """Runs (source_id, shot_id, start_us, end_us, state) between two of one other state in the same shot, and at most most_us long."""
    w = Window.partitionBy("source_id", "shot_id").orderBy("start_us")
    around = runs.withColumn("before", F.lag("state").over(w)).withColumn("after", F.lead("state").over(w))
    return around.where((F.col("before") == F.col("after")) & (F.col("state") != F.col("before")) & (F.col("end_us") - F.col("start_us") <= most_us)).select("source_id", "shot_id", "start_us", "end_us", "state", F.col("before").alias("around"))


def independent_windows(windows: DataFrame, least_us: int, key: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """A greedy subset by start: each window long enough that begins at or after the end of the last one taken.

    A window that overlaps none before it is always taken, so each island of overlapping windows is read on its own.
    """
    long = windows.where(F.col("end_us") - F.col("start_us") >= least_us).select(*key, "start_us", "end_us", "id")
    before = F.max("end_us").over(_before(Window, list(key)))
    order = Window.partitionBy(*key).orderBy("start_us", "end_us").rowsBetween(Window.unboundedPreceding, 0)
    isles = long.withColumn("fresh", (before.isNull() | (F.col("start_us") >= before)).cast("int")).withColumn("island", F.sum("fresh").over(order))
    rows = isles.groupBy(*key, "island").agg(F.array_sort(F.collect_list(F.struct("start_us", "end_us", "id"))).alias("w"))
    none = f"cast(array() as array<struct<start_us:bigint,end_us:bigint,id:{windows.schema['id'].dataType.simpleString()}>>)"
    fold = F.expr(f"aggregate(w, struct({none} as taken, cast(-9223372036854775807 as bigint) as until), (s, x) -> if(x.start_us >= s.until, struct(concat(s.taken, array(x)) as taken, x.end_us as until), s)).taken")
    return rows.select(*key, F.explode(fold).alias("x")).select(*key, "x.start_us", "x.end_us", "x.id")


def coalesce_runs(cells: DataFrame, key: list[str], state: list[str], width: int = BUCKET_US) -> DataFrame:
    """Touching cells of a key with equal state (nulls equal) become one. No cell may cross a bucket's edge.

    Runs are found bucket by bucket; only those that touch an edge meet again by key, so a long source is not sorted in one task.
    """

    def merged(rows: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("start_us", "end_us")
        same = F.coalesce(F.lag("end_us").over(w) == F.col("start_us"), F.lit(False))
        for x in state:
            same = same & F.lag(x).over(w).eqNullSafe(F.col(x))
        fresh = rows.withColumn("_fresh", (~same).cast("int"))
        run = F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))
        return fresh.withColumn("_run", run).groupBy(*by, "_run", *state).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_run")

    own = cells.select(*key, *state, "start_us", "end_us").withColumn("_bucket", F.floor(F.col("start_us") / width))
    runs = merged(own, [*key, "_bucket"])
    edge = (F.col("start_us") == F.col("_bucket") * width) | (F.col("end_us") == (F.col("_bucket") + 1) * width)
    return merged(runs.where(edge).drop("_bucket"), key).unionByName(runs.where(~edge).drop("_bucket"))


def relative_time(pieces: DataFrame, key: tuple[str, ...] = ("clip_id",)) -> DataFrame:
    """Pieces of a clip with their times on the clip's own clock: laid end to end by order of start."""
    w = Window.partitionBy(*key).orderBy("start_us").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("end_us") - F.col("start_us")
    return pieces.withColumn("clip_end_us", F.sum(length).over(w)).withColumn("clip_start_us", F.col("clip_end_us") - length)


def flag_runs(rows: DataFrame, flag: Column, least_us: int, key: tuple[str, ...] = ("source_id",)) -> DataFrame:
    """Runs of neighbouring rows for which the flag holds, if they last least_us or more."""
    w = Window.partitionBy(*key).orderBy("start_us")
    own = rows.withColumn("flag", F.coalesce(flag, F.lit(False)))
    fresh = (F.col("flag") & (~F.coalesce(F.lag("flag").over(w), F.lit(False)) | (F.lag("end_us").over(w) != F.col("start_us")))).cast("int")
    runs = own.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).where("flag")
    return runs.groupBy(*key, "run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).where(F.col("end_us") - F.col("start_us") >= least_us).drop("run")


def tiling_audit(windows: DataFrame, sources: DataFrame, most_us: int) -> DataFrame:
    """Per source what keeps its windows from tiling [0, duration): gaps, overlaps, too long windows, wrong start or end."""
    w = Window.partitionBy("source_id").orderBy("start_us", "end_us")
    step = windows.withColumn("prev", F.lag("end_us").over(w))
    per = step.groupBy("source_id").agg(F.count_if(F.col("start_us") > F.col("prev")).alias("n_gaps"), F.count_if(F.col("start_us") < F.col("prev")).alias("n_overlaps"), F.count_if(F.col("end_us") - F.col("start_us") > most_us).alias("n_long"), F.min("start_us").alias("lo"), F.max("end_us").alias("hi"))
    out = sources.select("source_id", "duration_us").join(per, "source_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    whole = F.coalesce((F.col("n_gaps") + F.col("n_overlaps") + F.col("n_long") == 0) & (F.col("lo") == 0) & (F.col("hi") == F.col("duration_us")), F.lit(False))
    return out.select("source_id", zero("n_gaps"), zero("n_overlaps"), zero("n_long"), whole.alias("tiles"))
