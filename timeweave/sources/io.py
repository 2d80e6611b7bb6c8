"""Readers and writers: JSON lines, collections behind a manifest, bounded chunks, label sheets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A manifest's rows.
MANIFEST = "path string, sha256 string"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that don't. Nothing is inferred."""
    s = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).withColumn("row", F.from_json("value", T.StructType([*s.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return lines.where(~bad).select("row.*").drop("_bad"), lines.where(bad).select(F.col("value").alias("line"))


def write_jsonl(df: DataFrame, path: str, records_per_file: int | None = None) -> None:
    """One object a line; times keep their microseconds. Never over an existing folder."""
    w = df.write.mode("errorifexists").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    (w.option("maxRecordsPerFile", records_per_file) if records_per_file else w).json(path)


def _below(root: str):
    """A file's path below the root, from its full one."""
    name = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    return lambda path: F.expr(f"substring({path}, instr({path}, {name!r}) + {len(name)})")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256")).withColumn("path", _below(root)("path"))


def read_collections(spark: SparkSession, root: str, manifest: DataFrame, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """JSON rows, with their file, of the files whose digest is the manifest's, and what is wrong with the others: file and reason.

    Files are told apart by their whole path below the root. Digests are taken where the files are read; good files are read
    again, row by row.
    """
    found = digests(spark, root).withColumnRenamed("sha256", "found")
    j = manifest.select("path", "sha256").join(found, "path", "full_outer")
    reason = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "not_in_manifest").when(F.col("found") != F.col("sha256"), "digest_differs")
    state = j.select(F.col("path").alias("file"), reason.alias("reason"))
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(root).withColumn("file", F.input_file_name()).withColumn("file", _below(root)("file"))
    return rows.join(state.where("reason is null").select("file"), "file", "left_semi"), state.where("reason is not null")


def write_chunked(df: DataFrame, path: str, order: list[str], most: int = 500) -> None:
    """Files of at most `most` records each, ranges of the order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").option("maxRecordsPerFile", most).json(path)


def read_labels(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sheet of human labels with a header; blank is not reviewed (null)."""
    return spark.read.option("header", True).option("emptyValue", None).schema(schema).csv(path)


def write_label_sheet(df: DataFrame, path: str) -> None:
    """Never over an existing sheet."""
    df.write.mode("errorifexists").option("header", True).csv(path)
