"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are byte strings after each run of blanks is replaced by one space. A round splits every open group by its next
digit, a run of successive bytes; a group that is down to one row is settled as unique, a group whose rows have no bytes left is a
class of equal texts, and the rest go to the next round with a digit eight times as long. So each byte of a text is
compared at most once, and rounds grow with the logarithm of the longest text. Groups are counted with partial
aggregation, so a group with a third of all rows is one row per task by the time it is shuffled. The digits that occur more than once
are written and joined back to the rows, always as a join of two exchanges (at every size alike), whose skewed side the planner splits.

Nulls: a null text is empty, so all null and empty texts are equal. A null doc_id sorts last, and ``keep_id`` is null
only if every doc_id of the group is. Repeated doc_ids: every row is returned, exactly one row of a group is kept.
An empty table gives an empty result. Names of extra columns never clash, since input columns travel in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, Scope, materialize, sized, text_of, with_row_id

FIRST_DIGIT = 64
GROWTH = 8


def _settle(rows: DataFrame, first_digit: int, growth: int) -> DataFrame:
    """rows: rid, doc_id, sha, rest (bytes). Gives rid, doc_id, sha, keep_id, keep_rid, group_size."""
    width, settled = first_digit, []
    active = rows.withColumn("gid", F.lit(0).cast("long"))
    while True:
        keyed = active.withColumn("digit", F.expr(f"substring(rest, 1, {width})")).withColumn("ended", F.length("rest") <= width)
        groups = (
            keyed.groupBy("gid", "ended", "digit")
            .agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("head"), F.min("rid").alias("next"))
            .filter("n > 1")
        )
        groups = materialize(groups).hint("merge")
        tails = keyed.withColumn("rest", F.expr(f"substring(rest, {width + 1})"))  # the digit itself travels as a key
        split = tails.join(groups, ["gid", "ended", "digit"], "left")
        is_open = F.col("n").isNotNull() & ~F.col("ended")
        step = materialize(
            split.select(
                "rid",
                "doc_id",
                "sha",
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("keep_id"),
                F.when(F.col("n").isNull(), F.col("rid")).otherwise(F.col("head.rid")).alias("keep_rid"),
                F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                F.when(is_open, F.col("next")).alias("gid"),
                F.when(is_open, F.col("rest")).alias("rest"),
            )
        )
        settled.append(step.filter("gid is null").drop("gid", "rest"))
        active = step.filter("gid is not null").select("rid", "doc_id", "sha", "gid", "rest")
        if active.isEmpty():
            break
        width *= growth
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out


def _classes(kept: DataFrame, id_col: str, text_col: str, first_digit: int, growth: int) -> DataFrame:
    """kept: rid and row, written. The classes of its rows, by rid."""
    body = F.regexp_replace(text_of(F.col("row")[text_col]), BLANKS, " ").cast("binary")
    rows = kept.select("rid", F.col("row")[id_col].alias("doc_id"), body.alias("rest"))
    return _settle(rows.select("rid", "doc_id", F.sha2("rest", 256).alias("sha"), "rest"), first_digit, growth)


def _rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    return materialize(with_row_id(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), "rid"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    out = _classes(_rows(docs, [id_col, text_col]), id_col, text_col, first_digit, growth)
    return out.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    with Scope() as scope:
        kept = _rows(docs, docs.columns)
        gone = materialize(_classes(kept, id_col, text_col, first_digit, growth).filter("rid <> keep_rid").select("rid"))
        scope.delete(docs.sparkSession, but=(docs, kept, gone))
    return kept.join(sized(gone), "rid", "left_anti").select("row.*")
