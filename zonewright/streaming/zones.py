"""Streams of recognized texts: the same stateless kernels, deduplication by content, and windowed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sha256_hex
from ..operators.parse import all_valid
from ..operators.scan import scan


def texts(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def scanned(stream: DataFrame, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """The zone scan of each text."""
    return scan(stream, text, keep).withColumn("valid", F.coalesce(all_valid(F.col("mrz.checks")), F.lit(False)))


def once(stream: DataFrame, text: str, time: str, within: str = "1 hour") -> DataFrame:
    """Texts not seen before within the watermark, by digest."""
    return stream.withColumn("digest", sha256_hex(F.col(text))).withWatermark(time, within).dropDuplicatesWithinWatermark(["digest"])


def rates(stream: DataFrame, time: str, window: str = "10 minutes", late: str = "10 minutes", flag: str = "valid") -> DataFrame:
    """Documents and valid ones per window of event time."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("documents"), F.count_if(flag).alias("valid"))
