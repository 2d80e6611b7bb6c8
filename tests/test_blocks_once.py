"""Blocks of selling look for cues once in each segment and window."""

from pyspark.sql import functions as F

from timeweave.operators import commercial


def test_cues_are_looked_for_once(spark):
    turn = F.col("id").cast("string")
    s = spark.range(6).select(F.lit("a").alias("source_id"), F.concat(F.lit("s"), turn).alias("segment_id"), (F.col("id") * 2_000_000).alias("start_us"), (F.col("id") * 2_000_000 + 1_500_000).alias("end_us"), F.lit("v").alias("speaker"), F.when(F.col("id") == 2, "compre agora").when(F.col("id") == 3, "na loja com desconto").otherwise("bom dia").alias("text"))
    found = commercial.commercial_blocks(s)
    # what is left to do reads results: before, each of the segments' readers searched them anew
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 0
    assert [(r.segment_ids, r.state) for r in found.collect()] == [("s2,s3", "excluded")]


def test_rows_are_dealt_out(spark):
    assert commercial.spread(spark.range(3), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
