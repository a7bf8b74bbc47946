"""A bounded, reproducible sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, least_by_hash, materialize, text_of


def sample(docs: DataFrame, labels: DataFrame | None, target: str, folds: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, object]]:
    """At most ``rows`` pairs (text, label), least in hash order of the id, from rows outside the held-out fold whose label
    is not null. ``labels`` None: the label is a column of ``docs``. Only ids are ranked; texts are fetched for the chosen alone.

    A null id or label is never chosen; a null text is empty. Of a repeated id's labels the greatest counts, and of its texts the
    least, found before anything is collected. Ties in hash order go to the lesser id. Empty tables give no pairs. Only the id, text
    and label columns are read."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), *([F.col(f"`{target}`").alias("label")] if labels is None else []))
    if labels is not None:
        ids = ids.select("id").distinct().join(labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{target}`").alias("label")), "id")
    ids = ids.filter(F.col("label").isNotNull() & F.col("id").isNotNull() & (fold_of("id", folds) != held_out))
    chosen = least_by_hash(materialize(ids.groupBy("id").agg(F.max("label").alias("label"))), "id", rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()  # at most ``rows``
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: r["id"])]
