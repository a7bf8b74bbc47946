"""Data-quality reports over validated frames: plain aggregations with map-side partial results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(validated: DataFrame) -> DataFrame:
    """One row: rows, valid, invalid, and whether all are valid."""
    return validated.agg(
        F.count("*").alias("rows"), F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("invalid_count"), F.coalesce(F.bool_and("valid"), F.lit(True)).alias("all_valid")
    )


def by_code(validated: DataFrame) -> DataFrame:
    """How often each code occurs at each path, errors and warnings."""
    issues = validated.select(F.explode(F.concat("errors", "warnings")).alias("i"))
    return issues.groupBy(F.col("i.path").alias("path"), F.col("i.code").alias("code"), F.col("i.severity").alias("severity")).agg(F.count("*").alias("n"))


def rolled_up(validated: DataFrame) -> DataFrame:
    """Issue counts by path and code, by path, and in all (null stands for all)."""
    issues = validated.select(F.explode(F.concat("errors", "warnings")).alias("i")).select("i.path", "i.code")
    return issues.rollup("path", "code").agg(F.count("*").alias("n"))


def worst(validated: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The keys with the most errors; ties by key."""
    return validated.select(key, F.size("errors").alias("n_errors")).orderBy(F.desc("n_errors"), key).limit(n)


def valid_indices(validated: DataFrame, key: str) -> DataFrame:
    """The keys of the valid rows."""
    return validated.filter("valid").select(key)


def invalid_indices(validated: DataFrame, key: str) -> DataFrame:
    """The keys of the invalid rows."""
    return validated.filter("not valid").select(key)
