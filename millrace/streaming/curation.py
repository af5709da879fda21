"""Validation and the quality rules on streams: both look at one row at a time, so the batch functions apply as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import contract, quality


def judged(examples: DataFrame) -> DataFrame:
    """A streaming (or batch) table of examples with validation_error and quality_filter_reason; no state is kept."""
    return contract.validate(examples).drop("record").withColumn("quality_filter_reason", quality.reason())


def counts(judged_rows: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Passed and failed rows for each window of event time; state is dropped behind the watermark."""
    passed = F.col("validation_error").isNull() & F.col("quality_filter_reason").isNull()
    return judged_rows.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))
