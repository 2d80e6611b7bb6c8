"""Scenes, shots, coverage and camera evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .intervals import interval_join, overlap_us, union_duration


def sample_points(scenes: DataFrame, short_us: int = 1_500_000, inset: float = 0.2) -> DataFrame:
    """Three points (start, middle, end) of a short scene, two inset points of a longer one."""
    length = F.col("end_us") - F.col("start_us")
    step = F.floor(length * inset).cast("long")
    points = F.when(length <= short_us, F.array(F.col("start_us"), F.expr("start_us + (end_us - start_us) div 2"), F.col("end_us") - 1)).otherwise(F.array(F.col("start_us") + step, F.col("end_us") - step))
    return scenes.select("source_id", "scene_id", F.explode(F.array_distinct(points)).alias("time_us"))


def shot_links(shots: DataFrame, sightings: DataFrame) -> DataFrame:
    """For each shot and person in it the previous shot of the source in which the person was seen."""
    s = sightings.join(shots.select("source_id", "shot_id", "start_us"), ["source_id", "shot_id"]).select("source_id", "shot_id", "start_us", "person_id").distinct()
    return s.withColumn("previous", F.lag("shot_id").over(Window.partitionBy("source_id", "person_id").orderBy("start_us", "shot_id"))).select("source_id", "shot_id", "person_id", "previous")


def shot_metrics(shots: DataFrame, micro_us: int = 600_000) -> DataFrame:
    """Number, median and range of durations, and micro shots of each source."""
    length = F.col("end_us") - F.col("start_us")
    return shots.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(length), 1).alias("p50"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.count_if(length < micro_us).alias("n_micro"))


def coverage(parts: dict[str, DataFrame], durations: DataFrame) -> DataFrame:
    """source_id, part, covered_us, share: the union of each part's intervals over the duration; a missing part is null, not zero."""
    out = None
    for name, df in parts.items():
        u = durations.join(union_duration(df), "source_id", "left").select("source_id", F.lit(name).alias("part"), F.col("union_us").alias("covered_us"), ratio(F.col("union_us"), F.col("duration_us")).alias("share"))
        out = u if out is None else out.unionByName(u)
    return out


def commercial_overlay(candidates: DataFrame, blocks: DataFrame) -> DataFrame:
    """excluded if a candidate overlaps an excluded block, review if a review block, else eligible; the strongest block by state and overlap."""
    j = interval_join(candidates.select("source_id", "moment_id", "start_us", "end_us"), blocks.select("source_id", "block_id", "start_us", "end_us", "state"))
    strength = F.struct((F.col("b_state") == "excluded").cast("int"), overlap_us(F.col("start_us"), F.col("end_us"), F.col("b_start_us"), F.col("b_end_us")), -F.col("b_block_id"))
    best = j.groupBy("source_id", "moment_id").agg(F.max_by(F.struct("b_block_id", "b_state"), strength).alias("x"), F.count(F.lit(1)).alias("n"))
    return candidates.select("source_id", "moment_id").join(best, ["source_id", "moment_id"], "left").select("source_id", "moment_id", F.coalesce("x.b_state", F.lit("eligible")).alias("state"), F.col("x.b_block_id").alias("block_id"), F.coalesce("n", F.lit(0)).alias("n_blocks"))


def interpolate(points: DataFrame, keyframes: DataFrame) -> DataFrame:
    """The value at each point's time on the line between the keyframes around it; beyond the ends, the end's."""
    right = keyframes.select("source_id", F.col("time_us").alias("t"), F.struct("time_us", "value").alias("kf"), F.lit(0).alias("side"))
    both = points.select("source_id", "id", F.col("time_us").alias("t"), F.lit(1).alias("side")).unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy("source_id").orderBy("t", "side", F.col("kf.value"))
    a = F.last("kf", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("kf", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("a", a).withColumn("b", b).where("side = 1")
    share = F.try_divide((F.col("t") - F.col("a.time_us")).cast("double"), F.nullif(F.col("b.time_us") - F.col("a.time_us"), F.lit(0)).cast("double"))
    return both.select("source_id", "id", F.coalesce(F.col("a.value") + share * (F.col("b.value") - F.col("a.value")), F.col("a.value"), F.col("b.value")).alias("value"))
