"""Near-duplicates by shared word shingles: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

The SimHash search comes first: fingerprints of the sets of shingles are spread over vantage-point tree shards with overlap, linked within two
bits by local trees, and contracted to components by stars (``simhash.near_components``); the texts of a component share a bucket. Pairs at 0.8
differ in some 10 of 64 bits, more than a tree can prune by, so further buckets come from MinHash signatures cut into ``BANDS`` bands of ``ROWS`` minima: texts that agree in all
minima of some band share one, which a pair at similarity s does with probability 1 - (1 - s ** ROWS) ** BANDS, 0.999997 at 0.8. What shares a bucket is
only a candidate; candidates are compared by the 64-bit hashes of all their shingles. Every member of a bucket is first compared with the bucket's most central member, the
one whose own buckets hold the most, so a group of copies of one text costs about a comparison a member. Texts in buckets that these links
leave in several parts (texts that share a passage, say, but are not alike) are then joined by prefixes: with a text's shingles
ordered from rare to common among those texts, two texts that are alike share one of the first fifth, and so early that what follows it
can suffice in both. So what many texts share makes no candidates, no pair is left out unless it is connected already, and of texts that are connected only the lesser
classes of a bucket are paired with the rest. Components of the links are groups, of which the row with the least id stays.

Words are cut at ASCII blanks and their ASCII letters lower-cased; a text of fewer than five words is one shingle. Texts with the same
shingles are one vertex, known by a 64-bit digest. Nulls and texts without a word are alike. Repeated or null ids: a null id stands only
for a group that has no other; of repeated ids one row stays. An empty table gives an empty result. Other columns are carried as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scope, materialize, sized, text_of, with_row_id
from .components import components
from .fingerprint import shingle_hashes
from .simhash import majority, near_components

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
SEED = 42
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else set()


def sketch(text: str) -> tuple[int, int, int, list[int]]:
    """Digest of the text's set of shingles, their number, their SimHash, and a key for each band."""
    found = shingles(text)
    hashes = np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))
    digest = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    if not found:
        return digest, 0, 0, []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 512):
        np.minimum(low, (hashes[k : k + 512, None] * _FACTORS).min(0), out=low)
    return digest, len(found), majority(hashes), [xxhash.xxh64_intdigest(band.tobytes(), b) for b, band in enumerate(low.reshape(BANDS, ROWS))]


def _sketches():
    """A column function from texts to their sketches, as signed longs."""
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    @F.pandas_udf("fp long, n long, sim long, bands array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [sketch(t) for t in texts]
        return pd.DataFrame({"fp": signed([r[0] for r in rows]), "n": np.array([r[1] for r in rows], np.int64), "sim": signed([r[2] for r in rows]), "bands": [signed(r[3]) for r in rows]})

    return of


def _sets(fps: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """The sets of hashed shingles of some texts (fp, set), written. heads: fp, rid; texts: rid, text."""
    needed = materialize(heads.join(sized(fps), "fp"))
    return materialize(texts.join(sized(needed), "rid").select("fp", F.array_distinct(shingle_hashes(F.col("text"), WORDS)).alias("set")))


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v (written, distinct) whose sets are alike, written."""
    left = sets.select(F.col("fp").alias("u"), F.col("set").alias("a")).join(sized(pairs), "u")
    both = left.join(sets.select(F.col("fp").alias("v"), F.col("set").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return materialize(both.filter(shared / (F.size("a") + F.size("b") - shared) >= F.lit(LEAST)).select("u", "v"))


def _sizes_allow(a: str, b: str) -> Column:
    """Whether sets of these sizes can be alike at all."""
    return F.least(a, b) / F.greatest(a, b) >= F.lit(LEAST)


def _by_tree(prints: DataFrame) -> DataFrame:
    """A bucket (key, fp, n) for each text that has a shingle: its component in the SimHash search."""
    some = prints.filter("n > 0").select("fp", "n", "sim")
    roots = materialize(near_components(materialize(some.select(F.col("sim").alias("fp")).distinct())))
    placed = some.join(sized(roots), F.col("sim") == F.col("vertex"), "left")
    return placed.select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "sim")).alias("key"), "fp", "n")


def _central(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members (key, fp, n) of buckets that hold several texts, and each such bucket's centre (key, fp, n); both written."""
    holders = materialize(_by_tree(prints)).unionByName(prints.select(F.explode("bands").alias("key"), "fp", "n"))
    held = materialize(holders.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"))
    members = materialize(holders.join(sized(held), "key"))
    scores = materialize(members.groupBy("fp").agg(F.sum("held").alias("score")))
    scored = members.join(sized(scores), "fp").groupBy("key").agg(F.max(F.struct("score", "fp", "n")).alias("c"))
    return members.drop("held"), materialize(scored.select("key", "c.fp", "c.n"))


def _by_prefix(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs u, v (written, distinct) of texts with different roots whose prefixes share a shingle. roots: fp, root, for all of ``sets``."""
    tokens = sets.select("fp", F.size("set").alias("n"), F.explode("set").alias("h"))
    often = materialize(tokens.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = tokens.join(sized(often), "h").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("of"))  # of one text
    # shingles of one text alone come first of all, and take their places in the prefix
    room = F.col("n") - F.ceil(F.lit(LEAST) * F.col("n") - F.lit(1e-9)).cast("int") + 1 - (F.col("n") - F.size("of"))
    first = shared.withColumn("room", room).filter("room > 0").select("fp", "n", (F.col("n") - F.size("of")).alias("own"), F.posexplode(F.slice("of", F.lit(1), F.col("room"))).alias("k", "x"))
    # the shingles from the first shared one on, which is all that two texts can have in common
    first = materialize(first.select("fp", "n", (F.col("n") - F.col("own") - F.col("k")).alias("left"), F.col("x.h").alias("h")).join(sized(roots), "fp"))
    classes = first.groupBy("h", "root").agg(F.count("*").alias("held")).groupBy("h").agg(F.max(F.struct("held", "root")).alias("most"), F.count("*").alias("parts"))
    main = materialize(classes.filter("parts > 1").select("h", F.col("most.root").alias("main")))
    open_ = materialize(first.join(sized(main), "h"))
    a, b = (open_.select("h", "main", *[F.col(c).alias(s + c) for c in ("fp", "n", "left", "root")]) for s in "ab")
    enough = F.least("aleft", "bleft") >= F.lit(LEAST / (1 + LEAST)) * (F.col("an") + F.col("bn")) - F.lit(1e-9)
    once = (F.col("broot") == F.col("main")) | (F.col("afp") > F.col("bfp"))
    pairs = a.filter("aroot <> main").join(b.drop("main"), "h").filter(once & (F.col("aroot") != F.col("broot")) & enough)
    return materialize(pairs.select(F.greatest("afp", "bfp").alias("u"), F.least("afp", "bfp").alias("v")).distinct())


def similar_components(prints: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """prints: fp, n, sim, bands, distinct and written; heads: fp, rid; texts: rid, text. Gives vertex, root for the texts that are
    linked to another."""
    members, centres = _central(prints)
    to = members.join(sized(centres.select("key", F.col("fp").alias("v"), F.col("n").alias("vn"))), "key")
    pairs = materialize(to.filter((F.col("fp") != F.col("v")) & _sizes_allow("n", "vn")).select(F.col("fp").alias("u"), "v").distinct())
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    links = _alike(pairs, _sets(materialize(ends), heads, texts))
    roots = materialize(components(links))
    placed = members.join(sized(roots), F.col("fp") == F.col("vertex"), "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed)
    several = materialize(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("held")).filter("lo <> hi and held > 2").select("key"))
    open_ = materialize(placed.join(sized(several), "key").select("fp", "root").distinct())
    sets = _sets(open_.select("fp"), heads, texts)
    rest = _alike(_by_prefix(sets, open_), sets)
    return components(links.unionByName(rest))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group, with all their columns."""
    with Scope() as scope:
        printed, gone = _gone(docs, id_col, text_col)
        scope.delete(docs.sparkSession, but=(docs, printed, gone))
    return printed.join(sized(gone), "rid", "left_anti").select("row.*")


def _gone(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The written rows by rid, and the rids of those that don't stay."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    sketched = docs.select(row, _sketches()(text_of(F.col(f"`{text_col}`"))).alias("s")).select("row", "s.*")
    printed = materialize(with_row_id(sketched, "rid"))
    head = F.min(F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), F.col("rid")))
    prints = materialize(printed.groupBy("fp").agg(head.alias("head"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")))
    texts = printed.select("rid", text_of(F.col("row")[text_col]).alias("text"))
    roots = materialize(similar_components(prints.select("fp", "n", "sim", "bands"), prints.select("fp", F.col("head.rid").alias("rid")), texts))
    rooted = prints.select("fp", "head").join(sized(roots), F.col("fp") == F.col("vertex"), "left").select("head", F.coalesce("root", "fp").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("head").alias("first")).select(F.col("first.rid").alias("rid"))
    return printed, materialize(printed.select("rid").join(keep, "rid", "left_anti"))
