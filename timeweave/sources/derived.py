"""Logical tables as projections of the given tables, for the registered queries; SQL holds the same rules for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, id, kind, speaker, start_us, end_us of events, value minutes long."""
    e = table(spark, sf_dir, "events").where("value > 0")
    start = micros("ts")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("event_type").alias("speaker"), start.alias("start_us"), (start + F.round(F.col("value") * 60e6).cast("long")).alias("end_us"), "value")


def samples(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    """source_id, id, time_us, value of events of one type."""
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("source_id"), F.col("event_id").alias("id"), micros("ts").alias("time_us"), "value")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, scene_id, start_us, end_us: from one view of a user to the next."""
    v = samples(spark, sf_dir, "view")
    nxt = F.lead("time_us").over(Window.partitionBy("source_id").orderBy("time_us", "id"))
    return v.select("source_id", F.col("id").alias("scene_id"), F.col("time_us").alias("start_us"), nxt.alias("end_us")).where("end_us > start_us")


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, duration_us: to the end of its last interval."""
    return intervals(spark, sf_dir).groupBy("source_id").agg(F.max("end_us").alias("duration_us"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, segment_id, turn, start_us, end_us, speaker, text: turns of conversations in slots of ten seconds."""
    start = F.col("turn") * 10_000_000
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_id"), F.concat_ws("-", "conv_id", "turn").alias("segment_id"), "turn", start.alias("start_us"), (start + F.least(F.lit(9_000_000).cast("long"), F.length("text") * F.lit(50_000).cast("long"))).alias("end_us"), F.col("role").alias("speaker"), "text")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, word_id, segment_id, k, word, start_us, end_us, confidence, speaker: equal slices of a segment."""
    s = segments(spark, sf_dir).withColumn("w", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).withColumn("n", F.size("w"))
    w = s.select("*", F.posexplode("w").alias("k", "word"))
    cut = lambda k: F.expr(f"start_us + ((end_us - start_us) * ({k})) div n")
    return w.select("source_id", F.concat_ws("-", "segment_id", "k").alias("word_id"), "segment_id", "k", "word", cut("k").alias("start_us"), cut("k + 1").alias("end_us"), ((F.col("k") * 37 + F.col("turn")) % 100 / 100.0).alias("confidence"), "speaker")


def scene_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, scene_id, start_us, end_us: three turns of a conversation are a scene."""
    return _cells(segments(spark, sf_dir), 3, "S", "scene_id")


def topic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, topic_id, start_us, end_us: five turns of a conversation are a topic."""
    return _cells(segments(spark, sf_dir), 5, "T", "topic_id")


def _cells(s: DataFrame, turns: int, mark: str, name: str) -> DataFrame:
    cell = F.concat("source_id", F.lit(f"-{mark}"), F.expr(f"turn div {turns}"))
    return s.groupBy("source_id", cell.alias(name)).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, speaker, start_us, end_us: turns that last three seconds longer than their text, so neighbours overlap."""
    return segments(spark, sf_dir).select("source_id", "speaker", "start_us", (F.col("end_us") + 3_000_000).alias("end_us"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, time_us, scene_id, people: a frame two seconds into each turn, with one to three people by the turn's number."""
    people = F.expr("array(array('p0'), array('p0', 'p1'), array('p1'), array('p0', 'p1', 'p2'))[cast(turn % 4 as int)]")
    return segments(spark, sf_dir).select("source_id", (F.col("start_us") + 2_000_000).alias("time_us"), F.concat("source_id", F.lit("-S"), F.expr("turn div 3")).alias("scene_id"), people.alias("people"))


def speaker_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, speaker, person_id, start_us, end_us: who is seen speaking; every seventh turn has no link."""
    return segments(spark, sf_dir).where("turn % 7 <> 6").select("source_id", "speaker", F.when(F.col("speaker") == "user", "p0").otherwise("p1").alias("person_id"), "start_us", "end_us")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, duration_us of conversations: to the end of the last turn's slot."""
    return segments(spark, sf_dir).groupBy("source_id").agg((F.max("turn") * 10_000_000 + 10_000_000).alias("duration_us"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, moment_id, start_us, end_us, score, topic, format, n_lines, evidence: orders as clip candidates."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    o = table(spark, sf_dir, "orders")
    start = F.expr("cast(datediff(o_orderdate, date'1995-01-01') as bigint) * 10000000")
    c = o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select(F.expr("o_custkey div 10").alias("source_id"), F.col("o_orderkey").alias("moment_id"), start.alias("start_us"), (start + (15 + F.col("o_orderkey") % 90) * 1_000_000).alias("end_us"), F.round(F.col("o_totalprice") % 1000 / 1000, 6).alias("score"), F.col("o_orderpriority").alias("topic"), F.col("o_orderstatus").alias("format"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))
    return c.withColumn("evidence", F.expr("sequence(start_us div 15000000, (end_us - 1) div 15000000)"))


SQL = {
    "intervals": "select user_id as source_id, event_id as id, event_type as kind, event_type as speaker, epoch_us(ts) as start_us, epoch_us(ts) + round(value * 60e6)::bigint as end_us, value from events where value > 0",
    "samples": "select user_id as source_id, event_id as id, epoch_us(ts) as time_us, value from events where event_type = 'click'",
    "scenes": "select * from (select user_id as source_id, event_id as scene_id, epoch_us(ts) as start_us, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as end_us from events where event_type = 'view') where end_us > start_us",
    "durations": "select user_id as source_id, max(epoch_us(ts) + round(value * 60e6)::bigint) as duration_us from events where value > 0 group by 1",
    "segments": "select conv_id as source_id, conv_id || '-' || turn as segment_id, turn, turn * 10000000 as start_us, turn * 10000000 + least(9000000, length(text) * 50000) as end_us, role as speaker, text from conversations",
    "words": "select source_id, segment_id || '-' || k as word_id, segment_id, k, w[k + 1] as word, start_us + ((end_us - start_us) * k) // n as start_us, start_us + ((end_us - start_us) * (k + 1)) // n as end_us, ((k * 37 + turn) % 100) / 100.0::double as confidence, speaker from (select *, len(w) as n, unnest(range(len(w))) as k from (select *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') as w from segments))",
    "scene_cells": "select source_id, source_id || '-S' || (turn // 3) as scene_id, min(start_us) as start_us, max(end_us) as end_us from segments group by 1, 2",
    "topic_cells": "select source_id, source_id || '-T' || (turn // 5) as topic_id, min(start_us) as start_us, max(end_us) as end_us from segments group by 1, 2",
    "voices": "select source_id, speaker, start_us, end_us + 3000000 as end_us from segments",
    "pictures": "select source_id, start_us + 2000000 as time_us, source_id || '-S' || (turn // 3) as scene_id, [['p0'], ['p0', 'p1'], ['p1'], ['p0', 'p1', 'p2']][(turn % 4 + 1)::int] as people from segments",
    "speaker_links": "select source_id, speaker, case when speaker = 'user' then 'p0' else 'p1' end as person_id, start_us, end_us from segments where turn % 7 <> 6",
    "spans": "select source_id, max(turn) * 10000000 + 10000000 as duration_us from segments group by 1",
    "candidates": "select o_custkey // 10 as source_id, o_orderkey as moment_id, date_diff('day', date '1995-01-01', o_orderdate::date) * 10000000 as start_us, date_diff('day', date '1995-01-01', o_orderdate::date) * 10000000 + (15 + o_orderkey % 90) * 1000000 as end_us, round(o_totalprice % 1000 / 1000, 6) as score, o_orderpriority as topic, o_orderstatus as format, coalesce(n_lines, 0) as n_lines from orders left join (select l_orderkey, count(*) as n_lines from lineitem group by 1) on o_orderkey = l_orderkey",
}


def with_tables(*names: str, body: str) -> str:
    """A query over the named logical tables, for DuckDB."""
    of_segments = {"words", "scene_cells", "topic_cells", "voices", "pictures", "speaker_links", "spans"}
    need = [n for n in SQL if n in names or n == "segments" and of_segments & set(names)]
    return "with " + ",\n".join(f"{n} as ({SQL[n]})" for n in need) + "\n" + body
