"""Streams of progress and levels: the same results as their batch twins once the watermark has passed."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import shared_dir

PROGRESS = "run_id string, stage string, ts timestamp, current double, total double, status string"


def progress_stream(spark: SparkSession, path: str) -> DataFrame:
    """An append-only folder of progress events."""
    return spark.readStream.schema(PROGRESS).json(path)


def stream_levels(df: DataFrame, late: str = "10 minutes", width: str = "10 seconds") -> DataFrame:
    """Root mean square and peak of `value` in each source's windows of `ts`; rows later than `late` don't count."""
    w = df.withWatermark("ts", late).groupBy("source_id", F.window("ts", width))
    return w.agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"), F.count(F.lit(1)).alias("n")).select("source_id", F.col("window.start").alias("start"), "rms", "peak", "n")


def stream_sessions(df: DataFrame, late: str = "10 minutes", gap: str = "30 seconds") -> DataFrame:
    """Sessions of each source: a new one after a gap."""
    s = df.withWatermark("ts", late).groupBy("source_id", F.session_window("ts", gap))
    return s.agg(F.count(F.lit(1)).alias("n")).select("source_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


_LATEST = "run_id string, stage string, ts timestamp, current double, total double, status string, eta_seconds double"


def progress_latest(df: DataFrame, keep: int = 12) -> DataFrame:
    """Each (run, stage)'s newest state with the time left by the median of its last `keep` unit times. Events without a time or older than the newest are passed over.

    A run's stages are one state, so that a call and its frames serve all of them.
    """

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {stage: (ts, math.nan if current is None else current, list(times)) for stage, ts, current, times in zip(*state.get, strict=True)} if state.exists else {}
        newest = {}
        given = list(frames)
        e = given[0] if len(given) == 1 else pd.concat(given)
        when, current = e["ts"].to_numpy().astype("datetime64[us]"), e["current"].to_numpy(float)
        order = np.lexsort((current, when))[: len(when) - np.isnat(when).sum()]
        stages = e["stage"].tolist()
        for i, ts, now in zip(order.tolist(), when[order].astype(np.int64).tolist(), current[order].tolist(), strict=True):
            last_ts, last, times = held.get(stages[i], (None, math.nan, []))
            if last_ts is not None and ts <= last_ts:
                continue
            if now > last:
                times = [*times, (ts - last_ts) / 1e6 / (now - last)][-keep:]
            held[stages[i]] = ts, now, times
            newest[stages[i]] = i
        if newest:
            rows = e.iloc[list(newest.values())]
            unit = [float(np.median(held[x][2])) if held[x][2] else math.nan for x in newest]
            eta = np.array(unit) * (rows["total"].to_numpy(float) - rows["current"].to_numpy(float))
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            yield rows[["run_id", "stage", "ts", "current", "total", "status"]].assign(eta_seconds=eta)

    return df.groupBy("run_id").applyInPandasWithState(step, _LATEST, "stages array<string>, ts array<long>, current array<double>, times array<array<double>>", "update", "NoTimeout")


def progress_latest_batch(df: DataFrame, keep: int = 12) -> DataFrame:
    """The batch twin of progress_latest."""
    w = Window.partitionBy("run_id", "stage").orderBy("ts")
    seconds = F.unix_micros("ts") / 1e6
    one = df.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "stage", "ts").orderBy("current"))).where("nth = 1").drop("nth")
    d = one.withColumn("unit", F.when(F.col("current") > F.lag("current").over(w), (seconds - F.lag(seconds).over(w)) / (F.col("current") - F.lag("current").over(w))))
    known = d.withColumn("k", F.sum(F.col("unit").isNotNull().cast("int")).over(Window.partitionBy("run_id", "stage").orderBy(F.col("ts").desc())))
    units = known.where(F.col("k") <= keep).groupBy("run_id", "stage").agg(F.median("unit").alias("unit"))
    last = d.groupBy("run_id", "stage").agg(F.max_by(F.struct("ts", "current", "total", "status"), "ts").alias("x"))
    return last.join(units, ["run_id", "stage"]).select("run_id", "stage", "x.*", (F.col("unit") * (F.col("x.total") - F.col("x.current"))).alias("eta_seconds"))


def sampling_bursts(df: DataFrame, burst_us: int = 1_500_000) -> DataFrame:
    """The batch twin of stream_bursts."""
    w = Window.partitionBy("source_id").orderBy("time_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("changed"), F.col("time_us")), ignorenulls=True).over(w)
    return df.withColumn("burst", F.coalesce(F.col("time_us") - last <= burst_us, F.lit(False)))


def stream_bursts(df: DataFrame, burst_us: int = 1_500_000) -> DataFrame:
    """Whether each row (source_id, id, time_us, changed) lies in a burst: at or up to burst_us after a row that changed. A source's state is the time of its last change; its rows come in order of time."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["time_us", "id"])
        out = []
        for r in rows.itertuples():
            last = r.time_us if r.changed else last
            out.append((key[0], r.id, last is not None and r.time_us - last <= burst_us))
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame(out, columns=["source_id", "id", "burst"])

    return df.groupBy("source_id").applyInPandasWithState(step, "source_id long, id long, burst boolean", "last long", "append", "NoTimeout")


def batch_writer(path: str, complete: bool = False) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number, replacing what an earlier try of the batch left: rows come once even if a batch is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={0 if complete else number}")

    return write


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, to its end, and returns what it wrote to the shared folder. Complete: the last result alone."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/timeweave-stream-{uuid.uuid4().hex}"
    path = f"{base}/out"
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(batch_writer(path, mode == "complete")).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch=*")
