"""Windows of each source for people to annotate: reasons take turns, early and late times alternate, no two windows overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import SECOND
from .lineage import cut

_PICK = "array<struct<start_us:long,end_us:long,reason:string>>"


def interleaved(times: DataFrame, bucket_us: int = 600 * SECOND) -> DataFrame:
    """source_id, reason, time_us once each and turn: every second time from the first on, then those between from the last back.

    A time's place is what its reason's earlier buckets hold and its place in its own: no reason is sorted in one task.
    """
    key = ["source_id", "reason"]
    t = times.select(*key, "time_us").distinct().withColumn("bucket", F.floor(F.col("time_us") / bucket_us))
    held = t.groupBy(*key, "bucket").agg(F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy(*key)
    held = held.withColumn("n", F.sum("held").over(w)).withColumn("before", F.sum("held").over(w.orderBy("bucket")) - F.col("held"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*key, "bucket").orderBy("time_us")) - 1
    t = t.join(held, [*key, "bucket"]).withColumn("place", place)
    turn = F.when(F.col("place") % 2 == 0, F.expr("place div 2")).otherwise(F.expr("(n + 1) div 2 + n div 2 - 1 - (place - 1) div 2"))
    return t.select(*key, "time_us", turn.alias("turn"))


def _free(picks: Column, start: Column, end: Column) -> Column:
    return ~F.exists(picks, lambda p: F.greatest(p["start_us"], start) < F.least(p["end_us"], end))


def _choose(rows: Column, picks: Column, most: int) -> Column:
    """picks and the rows that still fit, in their order."""
    step = lambda a, r: F.when((F.size(a) < most) & _free(a, r["start_us"], r["end_us"]), F.concat(a, F.array(F.struct(r["start_us"].alias("start_us"), r["end_us"].alias("end_us"), r["reason"].alias("reason"))))).otherwise(a)
    return F.aggregate(rows, picks, step)


def goldset_windows(times: DataFrame, durations: DataFrame, most: int = 16, window_us: int = 4 * SECOND, at_once: int = 512, least: int = 10) -> DataFrame:
    """source_id, sample_no (from 1, by time), start_us, end_us, reason, status of at most `most` windows a source (10 to 20).

    times: source_id, reason (null: unknown), time_us; durations: source_id, duration_us. Times outside a source, sources without a positive duration and null times take no part. status is PARTIAL below
    `least` windows. The choice is greedy and exact: a round takes a source's next `at_once` candidates that overlap no chosen window, so at least one of them is
    chosen; the rounds end when no source lacks windows and has candidates left, after `most` rounds at the latest.
    """
    if not 10 <= most <= 20 or window_us <= 0 or at_once < 1:
        raise ValueError("10 to 20 windows of positive length")
    known = durations.where("duration_us > 0").groupBy("source_id").agg(F.max("duration_us").alias("duration_us"))
    inside = times.select("source_id", F.coalesce("reason", F.lit("unknown")).alias("reason"), "time_us").join(known, "source_id").where("time_us >= 0 and time_us < duration_us")
    start = F.greatest(F.least(F.col("time_us") - window_us // 2, F.col("duration_us") - window_us), F.lit(0))
    c = interleaved(inside).join(known, "source_id").withColumn("start_us", start).withColumn("end_us", F.least("duration_us", F.col("start_us") + window_us))
    left = cut(c.select("source_id", F.struct("turn", "reason", "start_us", "end_us").alias("c")))
    chosen = cut(known.select("source_id", F.array().cast(_PICK).alias("picks")))
    w = Window.partitionBy("source_id").orderBy("c")
    while True:
        left = cut(left.join(chosen, "source_id").where((F.size("picks") < most) & _free(F.col("picks"), F.col("c.start_us"), F.col("c.end_us"))).select("source_id", "c"))
        if left.isEmpty():
            break
        now = left.withColumn("place", F.row_number().over(w)).where(F.col("place") <= at_once)
        rows = cut(now.groupBy("source_id").agg(F.array_sort(F.collect_list("c")).alias("rows")))
        chosen = cut(chosen.join(rows, "source_id", "left").select("source_id", F.when(F.col("rows").isNull(), F.col("picks")).otherwise(_choose(F.col("rows"), F.col("picks"), most)).alias("picks")))
        seen = rows.select("source_id", F.element_at("rows", -1).alias("seen"))
        left = left.join(seen, "source_id").where("c > seen").select("source_id", "c")
    p = chosen.select("source_id", F.size("picks").alias("n"), F.posexplode(F.array_sort("picks")).alias("k", "p"))
    return p.select("source_id", (F.col("k") + 1).alias("sample_no"), "p.start_us", "p.end_us", "p.reason", F.when(F.col("n") < least, "PARTIAL").otherwise("READY_FOR_REVIEW").alias("status"))
