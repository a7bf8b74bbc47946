"""The same validation on unbounded frames: stateless projections, plus windowed counts of issues."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.operators.validation import validate


def validate_stream(stream: DataFrame, schema: Any, **options: Any) -> DataFrame:
    """A streaming frame, normalized and validated; append mode, no state."""
    return validate(stream, schema, **options)


def issue_counts(validated: DataFrame, time_col: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Issues by time window, path and code; windows close when the watermark passes them."""
    timed = validated.withColumn(time_col, F.col(time_col).cast("timestamp"))
    issues = timed.withWatermark(time_col, late).select(time_col, F.explode(F.concat("errors", "warnings")).alias("i"))
    return issues.groupBy(F.window(time_col, window), F.col("i.path").alias("path"), F.col("i.code").alias("code")).agg(F.count("*").alias("n"))


def _write(batch: DataFrame, number: int, valid_path: str, invalid_path: str) -> None:
    """One batch's rows in both folders; a repeated batch replaces its own files."""
    for flag, path in ((True, valid_path), (False, invalid_path)):
        batch.filter(F.col("valid") == flag).write.mode("overwrite").parquet(f"{path}/batch={number}")


def route(validated: DataFrame, valid_path: str, invalid_path: str, checkpoint: str) -> StreamingQuery:
    """Valid and invalid rows to two Parquet folders, batch by batch."""
    return route_each(validated, lambda batch: batch, valid_path, invalid_path, checkpoint)


def route_each(stream: DataFrame, check: Callable[[DataFrame], DataFrame], valid_path: str, invalid_path: str, checkpoint: str) -> StreamingQuery:
    """As ``route``, but each batch is validated by ``check`` as a table of its own, so that recursive schemas reach their full depth."""
    each = lambda batch, number: _write(check(batch), number, valid_path, invalid_path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
