"""Sequence packing as vector bin packing with the dot-product heuristic.

An example is a vector (tokens, one segment, loss-bearing tokens) and a sequence is a bin with a limit on each. The open
sequence takes, of a window of waiting examples, the one whose vector has the largest dot product with what is left of
its limits (both in shares of the limits) among those that fit. With ``cut`` an example may be divided: whole sequences are
cut off long ones first, and when nothing fits, the example with the best product is cut to what is left, so sequences come out
full. A sequence that is not full when the input ends is divided into powers of two, which need no padding.

Every task packs its own rows with bounded state, so nothing is shuffled and a lost task is simply run again; a sequence's id
carries its partition's number, so ids are unique. At most a few short sequences are left over in each task.

Nulls: a null text is empty; an empty text has the closing id alone. A null or repeated doc_id is carried along as it
is. Null counts are 0. Ties go to the example that came first, and repeated rows are examples of their own. Every example is returned:
one without tokens, and one above a limit that may not be cut, as a piece that is in no sequence (sequence_id and
offset null). A very long text is cut into sequences as it is read, and only its last piece waits. An empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import word_tokens

MAX_TOKENS = 2048
MAX_SEGMENTS = 512
#: Examples that wait at most; a longer window packs tighter and holds more memory.
WINDOW = 1024
CLOSING_ID = 1


class Packer:
    """Places (key, start, tokens, loss) pieces; hands each finished sequence to ``emit`` as a list of (key, start, length)."""

    def __init__(self, limits: tuple[int, int, int], emit: Callable[[list], None], cut: bool, window: int = WINDOW):
        self.limits, self.emit, self.cut, self.window = np.array(limits, np.float64), emit, cut, window
        self.vectors = np.zeros((window, 3))
        self.items: list = [None] * window
        self.n = 0

    def add(self, key: object, tokens: int, loss: int) -> None:
        start = 0
        if self.cut:
            whole = int(self.limits[0])
            if loss and loss > self.limits[2] * tokens / self.limits[0]:
                whole = max(1, int(self.limits[2] * tokens / loss))
            while tokens - start >= whole:
                self.emit([(key, start, whole)])
                start += whole
            loss = round(loss * (tokens - start) / tokens) if tokens else 0
            tokens -= start
            if not tokens:
                return
        if self.n == self.window:
            while self.n > self.window // 2:
                self.fill()
        self.vectors[self.n], self.items[self.n] = (tokens, 1, loss), (key, start)
        self.n += 1

    def _take(self, k: int) -> None:
        self.n -= 1
        self.vectors[k], self.items[k] = self.vectors[self.n], self.items[self.n]
        self.items[self.n] = None

    def fill(self) -> None:
        """Close one sequence."""
        left, bin_ = self.limits.copy(), []
        while self.n and left[1] >= 1 and left[0] >= 1:
            some = self.vectors[: self.n]
            score = some @ (left / self.limits / self.limits)
            score[(some > left).any(1)] = -1
            k = int(score.argmax())
            if score[k] >= 0:
                (key, start), (tokens, _, loss) = self.items[k], some[k].copy()
                bin_.append((key, start, int(tokens)))
                left -= (tokens, 1, loss)
                self._take(k)
                continue
            if not self.cut:
                break
            k = int((some @ (left / self.limits / self.limits)).argmax())
            (key, start), (tokens, _, loss) = self.items[k], some[k].copy()
            size = int(min(left[0], tokens - 1, left[2] * tokens / loss if loss else tokens - 1))
            if size < 1:
                break
            share = round(loss * size / tokens)
            bin_.append((key, start, size))
            left -= (size, 1, share)
            self.vectors[k], self.items[k] = (tokens - size, 1, loss - share), (key, start + size)
        if left[0] >= 1 and self.cut:
            self._powers(bin_)
        elif bin_:
            self.emit(bin_)

    def _powers(self, bin_: list) -> None:
        total, at = sum(x[2] for x in bin_), list(reversed(bin_))
        while total:
            size = 1 << (total.bit_length() - 1)
            total, part = total - size, []
            while size:
                key, start, length = at.pop()
                some = min(size, length)
                part.append((key, start, some))
                if some < length:
                    at.append((key, start + some, length - some))
                size -= some
            self.emit(part)

    def close(self) -> None:
        while self.n:
            self.fill()


def _ids() -> Iterator[int]:
    """Sequence ids of this task: its partition's number in the upper bits."""
    at = TaskContext.get().partitionId() << 36
    while True:
        yield at
        at += 1


def pack_examples(examples: DataFrame, id_col: str, tokens_col: str, loss_col: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_TOKENS, cut: bool = False) -> DataFrame:
    """Place examples by their counts alone. Gives id, start, length, sequence_id, offset; the last two are null for an example without
    tokens, and without ``cut`` for one above a limit."""
    kind = examples.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "sequence_id", "offset"]
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ids, kind = [], _ids(), None

        def emit(pieces: list) -> None:
            number, offset = next(ids), 0
            for key, start, length in pieces:
                rows.append((key, start, length, number, offset))
                offset += length

        packer = Packer((max_tokens, max_segments, max_loss), emit, cut)
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, tokens, loss in zip(*(x.to_pylist() for x in batch.columns)):
                if tokens > 0 and (cut or tokens <= max_tokens and loss <= max_loss):
                    packer.add(key, tokens, max(0, loss))
                else:
                    rows.append((key, 0, max(0, tokens), None, None))
            if rows:
                yield _batch(rows, names, kind)
                rows = []
        packer.close()
        if rows:
            yield _batch(rows, names, kind)

    counts = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(0).cast("long")).alias(n) for c, n in ((tokens_col, "t"), (loss_col, "l"))]
    return examples.select(F.col(f"`{id_col}`").alias("id"), *counts).mapInArrow(run, schema)


def _batch(rows: list, names: list[str], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, closing_id: int = CLOSING_ID) -> DataFrame:
    """Tokenize and pack whole texts, every token bearing loss. One row per piece:
    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end, rows, ids, key_kind = word_tokens(tokenizer), np.array([closing_id], "<u4").tobytes(), [], _ids(), None

        def emit(pieces: list) -> None:
            number, offset = next(ids), 0
            for (doc, raw, before), start, length in pieces:
                rows.append((doc, before + start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), before + len(raw) // 4, number, offset))
                offset += length

        packer = Packer((max_tokens, max_segments, max_tokens), emit, cut=True)
        for batch in batches:
            key_kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = tokens.encode(text.as_py()) + end
                total, whole = len(raw) // 4, len(raw) // 4 // max_tokens * max_tokens
                for start in range(0, whole, max_tokens):
                    part = raw[4 * start : 4 * (start + max_tokens)]
                    rows.append((doc, start, max_tokens, zlib.crc32(part), total, next(ids), 0))
                if total > whole:
                    packer.add((doc, raw[4 * whole :], whole), total - whole, total - whole)
                if len(rows) >= 20_000:
                    yield _batch(rows, names, key_kind)
                    rows = []
        packer.close()
        if rows:
            yield _batch(rows, names, key_kind)

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:])
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(F.col(f"`{text_col}`")).alias("text")).mapInArrow(run, schema)
