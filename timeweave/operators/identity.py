"""Tracks and identities: rollups, templates, similarity within a source, signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dot


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a usable vector (1 < dim <= 4096, all finite, norm above 1e-8), scaled to length one: `unit`."""
    finite = F.coalesce(F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    ok = df.where(F.size(vector).between(2, 4096) & finite).withColumn("norm", norm).where("norm > 1e-8")
    return ok.withColumn("unit", F.transform(vector, lambda x: x.cast("double") / F.col("norm")))


def gallery_match(tracks: DataFrame, gallery: DataFrame, k: int = 1) -> DataFrame:
    """The k most similar gallery templates of each track by cosine, and the margin to the next. gallery: a bounded table of templates.

    A track meets its own source's templates only: an equi-join, not all pairs of tracks.
    """
    g = gallery.select(F.col("source_id").alias("g_source"), "person_id", F.col("unit").alias("g_unit"))
    j = tracks.join(g, F.col("source_id") == F.col("g_source")).withColumn("score", F.round(dot(F.col("unit"), F.col("g_unit")), 6))
    w = Window.partitionBy("track_id").orderBy(F.col("score").desc(), "person_id")
    return j.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.round(F.col("score") - F.lead("score").over(w), 6)).where(F.col("rank") <= k).select("track_id", "person_id", "rank", "score", "margin")


def templates(tracks: DataFrame, key: list[str], n: int = 32) -> DataFrame:
    """A template of each key: coordinate medians of at most n evenly spaced vectors of the commonest length (ties: the shorter), by order of track, scaled to length one."""
    sizes = tracks.groupBy(*key, F.size("unit").alias("dim")).agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.max_by("dim", F.struct("n", -F.col("dim"))).alias("dim"))
    tracks = tracks.join(sizes, key).where(F.size("unit") == F.col("dim"))
    w = Window.partitionBy(*key).orderBy("track_id")
    r = tracks.withColumn("pos", F.row_number().over(w) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    picked = r.where(F.expr(f"of <= {n} or pos = 0 or (pos * {n}) div of <> ((pos - 1) * {n}) div of"))
    coords = picked.select(*key, F.posexplode("unit").alias("i", "x")).groupBy(*key, "i").agg(F.median("x").alias("m"))
    middle = coords.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("unit"))
    return middle.withColumn("_norm", F.sqrt(dot(F.col("unit"), F.col("unit")))).where("_norm > 1e-8").withColumn("unit", F.transform("unit", lambda x: x / F.col("_norm"))).drop("_norm")


def tracklet_rollup(observations: DataFrame, longest_us: int = 1_200_000) -> DataFrame:
    """First and last sight, visual time (steps of at most longest_us), distinct instants of each track."""
    w = Window.partitionBy("source_id", "track_id").orderBy("time_us")
    step = F.col("time_us") - F.lag("time_us").over(w)
    o = observations.withColumn("own", F.when(step <= longest_us, step).otherwise(0))
    return o.groupBy("source_id", "track_id").agg(F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"), F.sum("own").cast("long").alias("visual_us"), F.countDistinct("time_us").alias("instants"))


def lagged_correlation(a: DataFrame, b: DataFrame, lags: list[int], least: int = 8) -> DataFrame:
    """Of each source the lag (in steps) at which a's and b's values correlate best; ties: the smaller lag. a, b: source_id, step, value."""
    bb = b.select(F.col("source_id").alias("b_source"), F.col("step").alias("b_step"), F.col("value").alias("b_value"))
    shifted = a.withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    j = shifted.join(bb, (F.col("source_id") == F.col("b_source")) & (F.col("step") + F.col("lag") == F.col("b_step")))
    c = j.groupBy("source_id", "lag").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("value", "b_value"), 4).alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return c.groupBy("source_id").agg(F.max_by(F.struct("lag", "n", "r"), F.struct("r", -F.col("lag"))).alias("x")).select("source_id", "x.lag", "x.n", "x.r")


def identity_conflicts(tracks: DataFrame) -> DataFrame:
    """Pairs of tracks of one person in one source that are seen at the same time."""
    from .intervals import interval_join

    t = tracks.select("source_id", "person_id", "track_id", "start_us", "end_us")
    return interval_join(t, t).where("person_id = b_person_id and track_id < b_track_id").select("source_id", "person_id", F.col("track_id").alias("a"), F.col("b_track_id").alias("b"))


def motion_ewma(points: DataFrame, alpha: float = 0.35, gap_us: int = 1_500_000) -> DataFrame:
    """Smoothed value of each track, started anew after a gap; velocity between neighbours in one stretch."""
    w = Window.partitionBy("track_id").orderBy("time_us", "id")
    fresh = (F.lag("time_us").over(w).isNull() | (F.col("time_us") - F.lag("time_us").over(w) > gap_us)).cast("int")
    r = points.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(w))
    rows = r.groupBy("track_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("time_us", "id", "value"))).alias("p"))
    none = "cast(array() as array<struct<time_us:bigint,id:bigint,smooth:double>>)"
    fold = F.expr(f"aggregate(p, {none}, (s, x) -> concat(s, array(struct(x.time_us as time_us, x.id as id, if(size(s) = 0, x.value, {alpha}D * x.value + (1D - {alpha}D) * element_at(s, -1).smooth) as smooth))))")
    return rows.select("track_id", "stretch", F.explode(fold).alias("s")).select("track_id", "stretch", "s.time_us", "s.id", "s.smooth")


def speaker_affinity(windows: DataFrame, least: int = 2, share: float = 0.67) -> DataFrame:
    """The person of each speaker: windows with a score of .55 or more vote for it, of -.2 or less against; accepted with enough windows and share, if best alone."""
    up, down = F.col("score") >= 0.55, F.col("score") <= -0.2
    length = (F.col("end_us") - F.col("start_us")) / 1e6
    per = windows.groupBy("source_id", "speaker", "person_id").agg(F.count_if(up).alias("n_for"), F.count_if(down).alias("n_against"), F.round(F.sum(F.when(up, length * F.col("score")).when(down, length * F.col("score")).otherwise(0.0)), 4).alias("weight"))
    w = Window.partitionBy("source_id", "speaker")
    per = per.withColumn("of", F.sum("n_for").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("weight").desc(), "person_id"))).withColumn("best", F.max("weight").over(w)).withColumn("ties", F.count_if(F.col("weight") == F.col("best")).over(w))
    ok = (F.col("n_for") >= least) & (F.col("n_for") >= share * F.col("of")) & (F.col("ties") == 1) & (F.col("weight") > 0)
    return per.where("rank = 1").select("source_id", "speaker", F.when(ok, F.col("person_id")).alias("person_id"), "n_for", "n_against", "weight")


def tracking_profile(observations: DataFrame, shots: DataFrame, durations: DataFrame, bin_us: int = 60_000_000, near_us: int = 1_200_000, least: int = 3, least_us: int = 1_000_000) -> DataFrame:
    """source_id, start_us, end_us, created_per_minute, micro_per_minute, face_only, body_only, face_body, missing_rate (of embeddings; null without tracks), cuts of every bin of a source.

    A track counts in the bin of its first sample; it is micro with fewer than `least` times or less than least_us seen (gaps up to near_us). Samples after the end, and shots, count in the last bin.
    observations: source_id, track_id, time_us, face_visible, body_visible, embedded. shots: source_id, start_us. durations: source_id, duration_us.
    """
    key = ["source_id", "track_id"]
    o = observations.where("track_id is not null and time_us is not null").groupBy(*key, "time_us").agg(*(F.bool_or(F.coalesce(x, F.lit(False))).alias(x) for x in ("face_visible", "body_visible", "embedded")))
    gap = F.col("time_us") - F.lag("time_us").over(Window.partitionBy(*key).orderBy("time_us"))
    t = o.withColumn("gap", gap).groupBy(*key).agg(F.min("time_us").alias("first"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("gap") <= near_us, F.col("gap"))), F.lit(0)).alias("seen"), *(F.bool_or(x).alias(x) for x in ("face_visible", "body_visible", "embedded")))
    last = F.floor((F.greatest(F.col("duration_us"), F.lit(1)) - 1) / bin_us)
    at = lambda x: F.least(last, F.floor(F.col(x) / bin_us)).alias("bin")
    per = t.join(durations, "source_id").withColumn("micro", (F.col("n") < least) | (F.col("seen") < least_us)).select("source_id", at("first"), "micro", "face_visible", "body_visible", "embedded").groupBy("source_id", "bin")
    face, body = F.col("face_visible"), F.col("body_visible")
    per = per.agg(F.count(F.lit(1)).alias("n"), F.count_if("micro").alias("micro"), F.count_if(face & ~body).alias("face_only"), F.count_if(~face).alias("body_only"), F.count_if(face & body).alias("face_body"), F.count_if(~F.col("embedded")).alias("missing"))
    cuts = shots.where("start_us > 0").join(durations, "source_id").select("source_id", at("start_us")).groupBy("source_id", "bin").agg(F.count(F.lit(1)).alias("cuts"))
    bins = durations.select("source_id", "duration_us", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("bin"))
    j = bins.join(per, ["source_id", "bin"], "left").join(cuts, ["source_id", "bin"], "left")
    start, end = F.col("bin") * bin_us, F.least("duration_us", (F.col("bin") + 1) * bin_us)
    rate = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) * 60 / F.greatest(F.lit(1.0), (end - start) / 1e6), 6)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("source_id", start.alias("start_us"), end.alias("end_us"), rate("n").alias("created_per_minute"), rate("micro").alias("micro_per_minute"), zero("face_only"), zero("body_only"), zero("face_body"), F.round(F.try_divide(F.col("missing").cast("double"), F.col("n").cast("double")), 6).alias("missing_rate"), zero("cuts"))
