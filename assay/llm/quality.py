"""A quality classifier: supervised subword embeddings (see ``subwords``), two classes.

Fitted on at most ``TRAIN_ROWS`` labelled documents outside the held-out fold; scores every whole text. A null or empty
text has no features and gets the model's prior. Without any usable label (none, or only null or held-out ones) every score is 0.5, and
``keep_good`` keeps every row. Null and repeated doc_ids are
scored like any other row; a null doc_id is in no fold (held_out is null). An empty table gives an empty result.
Only the id and the text are read, so other columns' names never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_of, give_back, text_of
from .labelled import sample
from .subwords import Features, Scorer, train

TRAIN_ROWS = 4000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    return _fitted(sample(docs, labels, target, FOLDS, HELD_OUT, rows, id_col, text_col))


def _fitted(pairs: list[tuple[str, int]]) -> Scorer:
    return train([t for t, _ in pairs], np.array([int(y) for _, y in pairs], np.int64), 2, Features())


def score(model: Scorer, docs: DataFrame, text: Column) -> Column:
    """The probability of class 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.probabilities(texts.tolist())[:, 1])

    return of(text_of(text))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold_of(f"`{id_col}`", FOLDS) == HELD_OUT).alias("held_out"), score(model, docs, F.col(f"`{text_col}`")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns; all rows where no label can be fitted on."""
    pairs = sample(docs, labels, "quality", FOLDS, HELD_OUT, TRAIN_ROWS, id_col, text_col)
    if not pairs:
        return docs
    model = _fitted(pairs)
    del pairs
    give_back()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.filter(score(model, docs, F.col("row")[text_col]) >= threshold).select("row.*")
