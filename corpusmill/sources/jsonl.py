"""JSON lines: tolerant and strict scans, counts and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.scratch import drop, exists


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where(strip(F.col("value")) != "")


def read_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Objects of JSONL files or folders; a missing path, blank lines, invalid JSON and other JSON values give no row.

    A field of another type than the schema's is null, the object's other fields are kept.
    """
    there = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    rows = _lines(spark, there).where(strip(F.col("value")).startswith("{") & F.from_json("value", "map<string,string>").isNotNull())
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("row")).select("row.*")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but a missing path is a FileNotFoundError and a line that is no object fails the query."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = _lines(spark, path).withColumn("row", F.from_json("value", schema, {"mode": "FAILFAST"}))
    bad = F.when(~strip(F.col("value")).startswith("{"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).otherwise(F.lit(True))
    return rows.where(bad).select("row.*")


def count_rows(spark: SparkSession, path: str) -> int:
    return _lines(spark, path).count() if exists(spark, path) else 0


def write_lines(df: DataFrame, path: str, mode: str = "append", by: list[str] | None = None) -> None:
    """One object per line, null fields kept; ``by`` gives a folder for each value (only those written are replaced on overwrite)."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*by) if by else writer).json(path)


def truncate(spark: SparkSession, path: str) -> None:
    drop(spark, path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """The whole report, replaced in one step, on any file system of the cluster."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    target, part = fs.Path(path), fs.Path(path + ".tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = part.getFileSystem(conf).create(part, True)
    try:
        out.write(bytearray(json.dumps(report, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    over[0] = fs.Options.Rename.OVERWRITE
    full = target.getFileSystem(conf).makeQualified(target)
    fs.FileContext.getFileContext(full.toUri(), conf).rename(target.getFileSystem(conf).makeQualified(part), full, over)
