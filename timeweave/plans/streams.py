"""Streams over events, run to their end, and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import shared_dir
from ..sources import derived as d
from ..sources import io
from ..streaming import streams as op
from ..streaming import tracking
from .registry import Register

_R = Register()
QUERIES, ORACLES, query = _R.queries, _R.oracles, _R.query


def _events(spark, sf_dir):
    """The table of events as a stream; a pattern, so that the table may be one file or a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")


def _folder(spark, what):
    return f"{shared_dir(spark).rstrip('/')}/timeweave-{what}-{uuid.uuid4().hex}"


def _ts():
    return F.timestamp_micros(d.micros("ts"))


@query("""select user_id as source_id, time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as start, round(sqrt(avg(value * value)), 6) as rms, max(abs(value)) as peak, count(*) as n from events group by 1, 2""")
def st4_stream_levels(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("source_id"), _ts().alias("ts"), "value")
    out = op.run_available(op.stream_levels(e, width="6 hours"), "complete")
    return out.withColumn("rms", F.round("rms", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""with m as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts) < 3600000000 then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from m)
 select user_id as source_id, min(ts) as start, max(ts) + interval '1 hour' as end_ts, count(*) as n from g group by user_id, s""")
def st4_stream_sessions(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("source_id"), _ts().alias("ts"))
    out = op.run_available(op.stream_sessions(e, gap="1 hour"), "complete")
    return out.select("source_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_ts"), "n")


@query("""with t as (select user_id as source_id, event_id as id, epoch_us(ts) as time_us, event_type = 'error' as changed from events) select source_id, id, coalesce(time_us - max(case when changed then time_us end) over (partition by source_id order by time_us, id rows unbounded preceding) <= 3600000000, false) as burst from t""")
def st3_sampling_bursts(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), d.micros("ts").alias("time_us"), (F.col("event_type") == "error").alias("changed"))
    return op.run_available(op.stream_bursts(e, 3_600_000_000))


@query("""with p as (select * from (select user_id::varchar as run_id, event_type as stage, ts, round(value, 3) as current, row_number() over (partition by user_id, event_type, ts order by round(value, 3)) as nth from events) where nth = 1),
 u as (select *, case when current > lag(current) over w then (epoch_us(ts) - lag(epoch_us(ts)) over w) / 1e6::double / (current - lag(current) over w) end as unit from p window w as (partition by run_id, stage order by ts)), k as (select *, count(unit) over (partition by run_id, stage order by ts desc) as k from u),
 m as (select run_id, stage, median(unit) as unit from k where k <= 12 group by 1, 2), l as (select run_id, stage, arg_max(current, ts) as current from p group by 1, 2) select run_id, stage, current, round(unit * (1000 - current) / 3600, 2) as eta_hours from l left join m using (run_id, stage)""")
def st1_progress_latest(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), _ts().alias("ts"), F.round("value", 3).alias("current"), F.lit(1000.0).alias("total"), F.lit("running").alias("status"))
    out = op.run_available(op.progress_latest(e), "update")
    newest = out.groupBy("run_id", "stage").agg(F.max_by(F.struct("current", "eta_seconds"), "ts").alias("x"))
    return newest.select("run_id", "stage", "x.current", F.round(F.col("x.eta_seconds") / 3600, 2).alias("eta_hours"))


@query("select user_id::varchar as run_id, event_type as stage, count(*) as n, max(ts) as latest, round(sum(value), 3) as done from events group by 1, 2")
def s8_progress_stream(spark, sf_dir):
    path = _folder(spark, "progress")
    e = d.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("stage"), _ts().alias("ts"), F.col("value").alias("current"), F.lit(1000.0).alias("total"), F.lit("running").alias("status"))
    io.write_jsonl(e, path)
    p = op.run_available(op.progress_stream(spark, path))
    return p.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.max("ts").cast("timestamp_ntz").alias("latest"), F.round(F.sum("current"), 3).alias("done"))


@query("select doc_id, length(text) as n_chars, md5(text) as digest, source from documents")
def s4_jsonl(spark, sf_dir):
    path = _folder(spark, "jsonl")
    io.write_jsonl(d.table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path, 1000)
    good, _ = io.read_jsonl(spark, path, "doc_id long, text string, source string")
    return good.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"), "source")


@query("select doc_id, case when doc_id % 3 = 0 then null else quality end as truth, case when quality = 1 and doc_id % 3 <> 0 then 'good, \"kept\"' end as note from labels")
def s6_label_sheet(spark, sf_dir):
    path = _folder(spark, "labels")
    truth = F.when(F.col("doc_id") % 3 != 0, F.col("quality"))
    io.write_label_sheet(d.table(spark, sf_dir, "labels").select("doc_id", truth.alias("truth"), F.when(truth == 1, 'good, "kept"').alias("note")), path)
    return io.read_labels(spark, path, "doc_id long, truth int, note string").withColumn("truth", F.col("truth").cast("long"))


@query("select event_type as kind, case when event_type = 'error' then 0 else count(*) end as n, case when event_type = 'error' then 'digest_differs' end as reason from events group by 1")
def s3_read_collections(spark, sf_dir):
    root = _folder(spark, "collections")
    # one folder for each kind, with files of equal names in all of them
    d.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("event_type").alias("folder")).write.partitionBy("folder").json(root)
    kind = F.regexp_extract("path", "folder=([a-z_]+)/", 1)
    held = io.digests(spark, root).withColumn("sha256", F.when(kind == "error", F.reverse("sha256")).otherwise(F.col("sha256")))
    rows, bad = io.read_collections(spark, root, held, "event_id long, kind string")
    per = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("reason"))
    return per.unionByName(bad.select(F.regexp_extract("file", "folder=([a-z_]+)/", 1).alias("kind"), F.lit(0).cast("long").alias("n"), "reason").distinct())


_KINDS = ("click", "error", "purchase", "signup", "view")


def detections_of(e):
    """Events of six hours are a frame, frames are 0.4 s apart, 24 frames a shot; a kind keeps to its column and drifts with the value; two of three events show a face."""
    frame = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 21600000000")
    kind = sum((F.when(F.col("event_type") == k, i).otherwise(0) for i, k in enumerate(_KINDS)), F.lit(0))
    face = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.when(j == kind, 0.9).otherwise(0.0) + F.when(j == F.col("event_id") % 5, 0.1).otherwise(0.0))
    time = frame * 400_000
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), time.alias("time_us"), F.timestamp_micros(time).alias("ts"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) div 518400000000").alias("scene_id"), (0.05 + 0.18 * kind + F.col("value") % 7 * 0.004).alias("x"), (0.2 + F.col("value") % 5 * 0.01).alias("y"), F.lit(0.12).alias("w"), (0.3 + F.col("value") % 3 * 0.02).alias("h"), F.lit("body").alias("kind"), F.when(F.col("event_id") % 3 != 0, face).alias("embedding"))


@query()
def st2_track_stream(spark, sf_dir):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tracking.ROCKS)
    try:
        return op.run_available(tracking.track_stream(detections_of(_events(spark, sf_dir))))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
