"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's shingles are runs of five words (lower-cased A-Z, cut at blanks; fewer words make one shingle, none makes none), hashed to 64
bits; the sketch is the k least distinct hashes in order. A sketch of fewer than k hashes is the whole set. Sketches of parts
merge into the sketch of the whole (the k least of both), and estimate resemblance, containment and the number of distinct shingles.

The successor query finds each document's next one in descending id order without a global window: the narrow keys are
range-partitioned, led within each partition, and the partitions' heads (one row each) close the gaps. Texts are shuffled once.

Nulls: a null text is empty, with an empty sketch; two empty sketches are alike (1), an empty and another are not (0). A null
doc_id comes last. Rows equal in doc_id and text count as one document in the order, and each gets the same result row. A
single document's next one is itself. An empty table gives an empty result. Only id and text are read, so other names never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, materialize, text_of

K = 128
WORDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hashes of a text's shingles, repeats included, as an array of longs."""
    plain = F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), BLANKS, " "))
    hashed = F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))

    def shingles(of: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(of) - words), lambda i: F.xxhash64(*[F.get(of, i + j) for j in range(words)]))

    # the word hashes are bound once by a one-element transform, so that the shingles index them and do not make them again
    all_ = F.get(F.transform(F.array(hashed), lambda of: F.when(F.size(of) >= words, shingles(of)).otherwise(F.array(F.xxhash64(F.array_join(F.transform(of, lambda x: x.cast("string")), " "))))), F.lit(0))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(all_)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text, an ascending array of distinct longs."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all of both texts, 0 to 1."""
    least = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(both / F.size(least))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash as a share of the hash range."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too, 0 to 1."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as base64 of its hashes, 8 bytes each."""
    return F.translate(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), "\r\n", "")


def merged(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group: sketches are exploded and ranked with partial aggregation of distinct hashes.

    The k least hashes of a group are found by rank over salts first, so that no group meets in one task before it is cut to k per salt."""
    hashes = sketches.select(*by, F.explode(column).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    per_salt = hashes.withColumn("r", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("h"))).filter(F.col("r") <= k)
    return per_salt.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(column))


def successors(keys: DataFrame) -> DataFrame:
    """keys: doc_id, h, n, distinct. Adds the next key in descending doc_id order as next_id, next_h; the last one's is the first."""
    order = (F.col("doc_id").desc_nulls_last(), F.col("h").asc())
    ranged = materialize(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    led = ranged.withColumn("next", F.lead(F.struct("doc_id", "h")).over(within)).withColumn("at", F.row_number().over(within))
    heads = led.filter("at = 1").select("part", F.struct("doc_id", "h").alias("head"))  # one row per partition
    parts = Window.orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead("head").over(parts), F.first("head").over(whole)).alias("after"))
    out = led.join(heads, "part").withColumn("next", F.coalesce("next", "after"))
    return materialize(out.select("doc_id", "h", "n", F.col("next.doc_id").alias("next_id"), F.col("next.h").alias("next_h")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    text = text_of(F.col(f"`{text_col}`"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = successors(rows.select("doc_id", "h", F.length("text").alias("n")).distinct())
    # one set of key columns without nulls, so that the joins and the aggregation between them share one partitioning
    place = lambda id_, h: [F.coalesce(F.col(id_).cast("string"), F.lit("")).alias("id_key"), F.col(id_).isNull().alias("none"), F.col(h).alias("h_key")]
    keys, kind = ["id_key", "none", "h_key"], rows.schema["doc_id"].dataType
    rows = rows.select("text", *place("doc_id", "h"))  # the same columns on both ways, so that texts are exchanged once
    given = order.select(*place("next_id", "next_h"), F.struct(*place("doc_id", "h")).alias("to"), F.expr("n div 3").cast("int").alias("need"))
    lent = rows.join(given, keys).select("to.*", F.expr("substring(text, 1, need)").alias("tail"), sketch(F.col("text"), k).alias("next_sketch"))
    lent = lent.groupBy(*keys).agg(F.first("tail").alias("tail"), F.first("next_sketch").alias("next_sketch"))
    met = rows.join(lent, keys)
    n = F.length("text")
    met = met.select(F.when(~F.col("none"), F.col("id_key").cast(kind)).alias("doc_id"), "text", n.cast("long").alias("n_chars"), F.concat(F.expr("substring(text, 1, length(text) - length(text) div 3)"), "tail").alias("edited"), "next_sketch")
    met = met.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k).alias("own"), sketch(F.col("edited"), k).alias("changed"), "next_sketch")
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("shingles"),
    )
