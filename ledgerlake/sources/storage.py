"""Reading and writing sorted runs, text exports and JSON events."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_run(entries: DataFrame, path: str, key: str = "key", compression: str = "zstd", files: int | None = None, rows_per_file: int | None = None) -> None:
    """Range-partitioned and sorted by key, so that Parquet's statistics and Bloom filter skip what a lookup can't need."""
    ranged = entries.repartitionByRange(files, key) if files else entries.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key).write.option("compression", compression).option(f"parquet.bloom.filter.enabled#{key}", "true")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.mode("append").parquet(path)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def written(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back; gone when the session ends.

    Where none is set, a temporary folder serves a local master; a cluster is refused one.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-"))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/core-{sc.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    on_disk = spark._jvm.org.apache.hadoop.fs.Path(path)
    on_disk.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(on_disk)
    return spark.read.schema(df.schema).parquet(path)


def missing_files(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Files of a snapshot that aren't there: a restore is refused while any is missing."""
    return expected.join(present, "file_number", "left_anti")


def to_json(events: DataFrame) -> DataFrame:
    """Tagged events as JSON text: {"type": ..., "data": {...}}."""
    data = F.struct(*(c for c in events.columns if c != "type"))
    return events.select(F.to_json(F.struct("type", data.alias("data"))).alias("line"))


def from_json(lines: DataFrame, data_schema: str) -> DataFrame:
    return lines.select(F.from_json("line", f"type string, data struct<{data_schema}>").alias("e")).select("e.type", "e.data.*")


def exposition(samples: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """Samples as metric exposition text: name{label="value",...} value."""
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{x}="'), F.col(x).cast("string"), F.lit('"')) for x in labels))
    return samples.select(F.concat(F.lit(f"{name}{{"), pairs, F.lit("} "), F.col("value").cast("string")).alias("line"))
