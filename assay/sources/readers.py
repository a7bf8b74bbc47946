"""Reading documents: CSV by import rules, JSON lines, embedded schemas."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assay.operators.validation import validate, validate_documents
from assay.plans import ir


class ImportRuleError(ValueError):
    """A file that breaks the import rules."""


def infer_cell(s: Column) -> Column:
    """A cell as a variant: whole number of 64 bits, else number, else text; blank cells are missing."""
    whole = F.when(s.rlike(r"\A[+-]?[0-9]+\z"), s.try_cast("long"))
    number = F.when(s.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), s.try_cast("double"))
    return F.when(F.trim(s) != "", F.coalesce(whole.cast("variant"), number.cast("variant"), s.cast("variant")))


def read_csv(spark: SparkSession, path: str, schema: Any, columns: dict[str, str] | None = None, required: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    """A CSV file's rows as documents in a ``document`` column, numbered by ``row``, by the schema's import rules or the given ones.

    Headers are mapped to member names, blank cells dropped, and cells tried as whole number, number, text. A missing required
    column or too many rows raise before anything is returned."""
    schema = ir.Schema.from_json(schema)
    rules = schema.extra.get("import") or {}
    columns = columns if columns is not None else rules.get("column_mappings") or {}
    required = required if required is not None else rules.get("required_columns") or []
    max_rows = max_rows if max_rows is not None else rules.get("max_rows")
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    absent = [c for c in required if c not in raw.columns and c not in [columns.get(x, x) for x in raw.columns]]
    if absent:
        raise ImportRuleError(f"missing columns: {', '.join(absent)}")
    if max_rows is not None and raw.limit(max_rows + 1).count() > max_rows:
        raise ImportRuleError(f"more than {max_rows} rows")
    pairs = [x for c in raw.columns for x in (F.lit(columns.get(c, c)), infer_cell(F.col(f"`{c}`")))]
    document = F.to_variant_object(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()))
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return _numbered(raw.select(*split, F.monotonically_increasing_id().alias("id"), document.alias("document"))).select("row", "document")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of files (file, start, id) numbered from 0 in the order of files and lines. A split's rows have successive
    ids; the splits, one narrow row each, are counted and put in order."""
    splits = rows.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(splits, ["file", "start"]).withColumn("row", F.col("before") + F.col("id") - F.col("first"))


def import_csv(spark: SparkSession, path: str, schema: Any, **options: Any) -> DataFrame:
    """``read_csv`` and validation in one."""
    return validate_documents(read_csv(spark, path, schema, **options), schema, "document")


def read_json_lines(spark: SparkSession, path: str, schema: Any, **options: Any) -> DataFrame:
    """Lines of JSON, validated; lines that are no JSON carry INVALID_JSON."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return validate_documents(lines, schema, "value", **options)


def write_json_lines(validated: DataFrame, path: str, column: str = "normalized") -> None:
    """The normalized documents, one JSON text a line."""
    validated.select(F.to_json(column).alias("value")).write.text(path)


def write_split(validated: DataFrame, valid_path: str, invalid_path: str) -> None:
    """Valid and invalid rows to two Parquet folders; variants become JSON texts."""
    texts = [F.to_json(c).alias(c) if t == "variant" else F.col(f"`{c}`") for c, t in validated.dtypes]
    out = validated.select(*texts)
    out.filter("valid").write.parquet(valid_path)
    out.filter("not valid").write.parquet(invalid_path)


def bulk(df: DataFrame, schema: Any, most: int = 1000) -> DataFrame:
    """A request's rows validated, numbered by their place in it (``_row_index``, from 0); more than ``most`` rows raise, as a
    request's size is the caller's contract, and with it the one task that numbers them is bounded."""
    if df.limit(most + 1).count() > most:
        raise ImportRuleError(f"more than {most} rows in one request")
    placed = df.withColumn("_row_index", F.monotonically_increasing_id())
    placed = placed.withColumn("_row_index", F.row_number().over(Window.orderBy("_row_index")).cast("long") - 1)
    return validate(placed, _with_index(schema))


def bulk_split(df: DataFrame, schema: Any, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """A request's accepted rows, normalized, and its rejected ones with their errors; both by ``_row_index``."""
    done = bulk(df, schema, most)
    accepted = done.filter("valid").drop("valid", "errors", "warnings")
    return accepted, done.filter("not valid").select("_row_index", "errors")


def _with_index(schema: Any) -> ir.Schema:
    schema = ir.Schema.from_json(schema)
    root = {**schema.root, "properties": {**schema.root["properties"], "_row_index": {"type": "any", "required": False}}}
    return ir.Schema(**{**schema.__dict__, "root": root})
