"""Language identification: averaged hashed subword embeddings, a linear softmax and calibrated rejection.

Fitted on at most ``TRAIN_ROWS`` documents with a language outside the held-out fold. A fifth of them is kept back to fit a
temperature, so that scores are probabilities, and the score below which a prediction is marked as rejected: the ``REJECT``
quantile of the true class's probability on those texts. Every whole text is scored. Nulls and texts without a letter are
``und`` with score 0 (and rejected). Repeated rows and null doc_ids are scored like any other; a null doc_id is in no
fold. With no labelled text at all everything is ``und``. An empty table gives an empty result; only id, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of
from .labelled import sample
from .subwords import Features, Scorer, train

TRAIN_ROWS = 3000
FOLDS, HELD_OUT = 4, 2
REJECT = 0.002
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class Model:
    def __init__(self, names: list[str], scorer: Scorer | None, temperature: float = 1.0, floor: float = 0.0):
        self.names, self.scorer, self.temperature, self.floor = names, scorer, temperature, floor

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        name, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        some = [k for k, t in enumerate(texts) if t is not None and self.names and _LETTER.search(t)]
        if some:
            p = self.scorer.probabilities([texts[k] for k in some], self.temperature)
            best = p.argmax(1)
            name[some], score[some] = np.array(self.names, object)[best], p[np.arange(len(some)), best]
        return pd.DataFrame({"lang_pred": name, "score": score, "rejected": (score < self.floor) | (name == UNKNOWN)})


def fit(pairs: list[tuple[str, str]]) -> Model:
    pairs = [(t, str(y)) for t, y in pairs if _LETTER.search(t)]
    names = sorted({y for _, y in pairs})
    if not names:
        return Model([], None)
    held = [k % 5 == 4 for k in range(len(pairs))] if len(pairs) >= 50 else [False] * len(pairs)
    used, back = [p for p, h in zip(pairs, held) if not h], [p for p, h in zip(pairs, held) if h]
    scorer = train([t for t, _ in used], np.array([names.index(y) for _, y in used]), len(names), Features(lower=True), epochs=4)
    if not back:
        return Model(names, scorer)
    z, truth = scorer.logits([t for t, _ in back]), np.array([names.index(y) for _, y in back])
    best = (np.inf, 1.0)
    for temperature in np.geomspace(0.25, 8, 26):
        e = np.exp((z - z.max(1, keepdims=True)) / temperature)
        p = (e / e.sum(1, keepdims=True))[np.arange(len(truth)), truth]
        best = min(best, (float(-np.log(np.maximum(p, 1e-12)).mean()), float(temperature)))
    e = np.exp((z - z.max(1, keepdims=True)) / best[1])
    p = (e / e.sum(1, keepdims=True))[np.arange(len(truth)), truth]
    return Model(names, scorer, best[1], float(np.quantile(p, REJECT)))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, None, lang_col, FOLDS, HELD_OUT, rows, id_col, text_col)))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield model.value.predict(texts.tolist())

    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (fold_of(f"`{id_col}`", FOLDS) == HELD_OUT).alias("held_out"), of(F.col(f"`{text_col}`").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
