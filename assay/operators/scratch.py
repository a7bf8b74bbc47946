"""Scratch tables in the folder that the cluster shares; they cut lineage, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: One local folder for each application that runs on a single machine and names none.
_LOCAL: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """A new folder's path below the one that ``spark.checkpoint.dir`` names. Where that is unset, a temporary folder if
    driver and executors are one machine; else an error, since executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _LOCAL.get(context.applicationId)
        if base is None:
            base = _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="assay-")
    return f"{base.rstrip('/')}/assay/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written once and read back."""
    path = path or folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
