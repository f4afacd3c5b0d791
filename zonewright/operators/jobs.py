"""Jobs over documents: status, summaries, counters. A document's failure is a row, not an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_status(error: Column) -> Column:
    return F.when(error.isNull(), "done").otherwise("failed")


def job_status(documents: DataFrame, job: str = "job_id", status: str = "status") -> DataFrame:
    """queued, running or done by its documents; failed if it has none of them that ended well and all have ended."""
    n = lambda s: F.count_if(F.col(status) == s)
    state = F.when(n("queued") == F.count("*"), "queued").when(n("queued") + n("running") > 0, "running").when(F.count("*") == 0, "failed").otherwise("done")
    return documents.groupBy(job).agg(F.count("*").alias("documents"), n("done").alias("done"), n("failed").alias("failed"), state.alias("job_status"))


def by_tier(documents: DataFrame, tier: str = "tier") -> DataFrame:
    return documents.groupBy(tier).agg(F.count("*").alias("n"))


def summary(documents: DataFrame) -> DataFrame:
    """How many were read from the zone, by a costlier reader, or not at all."""
    return documents.agg(F.count_if(F.col("tier") == 1).alias("tier1"), F.count_if(F.col("tier") == 2).alias("tier2"), F.count_if(F.col("tier").isNull()).alias("failed"))


def option(conf: dict[str, str], key: str, default: int) -> int:
    """A positive whole number, or the default."""
    try:
        value = int(conf.get(key, ""))
    except ValueError:
        return default
    return value if value > 0 else default
