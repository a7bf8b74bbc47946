"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at 3
times its source's words and the excess is shared again by weight until none is above. A source's rows fall into blocks of about
``BLOCK_ROWS`` by a hash of the row. A source is drawn by whole epochs, each of which takes every block, and then by
permuted blocks without repetition up to the target; the last block is taken in hash order and its last document in part
(its first words; equal rows share evenly, rounded up).

The tree decides which output shard gets how many draws of which source, top down: a node divides its draws' counts by source among its
two halves by one multivariate-hypergeometric draw, seeded by the node, so that every shard gets its exact quota, as if all draws had
been shuffled. Each source's draws, permuted, then fill the shards' quotas in turn, so shards' draws are disjoint. The tree's top is grown on
the driver (``TOP`` nodes at most), the subtrees where their draws are, by the same rule and seeds. Rows are shuffled within their shard by
a hash. Everything is a function of seed and rows, so reruns agree; shards and blocks grow with the table.

Sources may be many: their ranks and targets are found by small jobs over one row a source, and beyond ``GROUPS`` sources the tree
splits counts of groups of them (a group's permuted draws fall to its sources by the same law). Ranks within a source's
draws are taken by hash ranges of counted size, never by one window over a source. A source with a third of all rows is spread like any other.

Nulls: a null text has no words; a null source is a source; a null doc_id is carried along. Repeated rows are separate
rows; equal rows are interchangeable. Texts without words are never drawn and count 0. An empty table gives an empty result. Other
columns, whatever their names, travel in one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, sized, text_of, with_row_id

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_ROWS = 256
#: Words of an output shard, about; and the fewest shards.
SHARD_WORDS, LEAST_SHARDS = 1 << 22, 4
#: Nodes of the tree that the driver grows, and counts in a node, at most.
TOP, GROUPS = 1024, 1024
#: Tasks that shards are spread over at most; beyond it a task sorts several.
TASKS = 1 << 17
#: Hash ranges that ranks are counted by.
RANGES = 1024
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], most: int = MOST) -> list[float]:
    """Each source's words of the mix: all words shared by weight, none above ``most`` times its own. What ``_targets`` does, for lists."""
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        share = sum(w for w, c in zip(weights, capped) if not c)
        out = [float(most * s) if c else left * w / share for s, w, c in zip(sizes, weights, capped)]
        above = [not c and t > most * s for s, c, t in zip(sizes, capped, out)]
        if not any(above):
            return out
        capped = [a or b for a, b in zip(capped, above)]


# ---------------------------------------------------------------- the tree


def edges(total: int, shards: int, k: int) -> int:
    """Draws of the first k shards."""
    return total * k // shards


def nodes_of(counts: np.ndarray, lo: int, hi: int, total: int, shards: int, seed: int, depth: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The descendants (first shard, end, counts by source) of the node of shards lo to hi, ``depth`` splits down or at a leaf, in order."""
    if hi - lo == 1 or depth == 0:
        yield lo, hi, counts
        return
    mid = (lo + hi) // 2
    left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, edges(total, shards, mid) - edges(total, shards, lo), method="marginals")
    yield from nodes_of(left, lo, mid, total, shards, seed, depth - 1)
    yield from nodes_of(counts - left, mid, hi, total, shards, seed, depth - 1)


def split_tree(draws: list[int], shards: int, seed: int) -> np.ndarray:
    """Quotas by shard and source: row sums are even, column sums are ``draws``."""
    leaves = nodes_of(np.array(draws, np.int64), 0, shards, sum(draws), shards, seed, shards) if draws else ()
    return np.array([c for _, _, c in leaves], np.int64).reshape(shards if draws else 0, len(draws))


# ---------------------------------------------------------------- sources


def _ranked(stats: DataFrame) -> DataFrame:
    """sid: the rank of each source (written, one row each) in code point order, null last; ranges are ranked apart and then offset."""
    order = (F.col("source").isNull().asc(), F.col("source").asc())
    ranged = materialize(stats.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("at", within).join(F.broadcast(counts.select("part", before.alias("before"))), "part").withColumn("sid", F.col("before") + F.col("at") - 1)


def _targets(ranked: DataFrame, weights: tuple, most: int) -> DataFrame:
    """Adds weight and target. Sources are capped at most times their words if that is less than their share at the current level of
    words by weight; the level rises as the excess is shared again, by one small job a round, until no more are."""
    weighted = materialize(_weighted(ranked, weights))
    total, capped, last = weighted.agg(F.sum("source_size")).first()[0] or 0, F.lit(False), -1
    while True:
        free, held, n = weighted.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, most * F.col("source_size"))), F.count_if(capped)).first()
        left, share = float(total - (held or 0)), float(free or 1)
        own = (F.lit(left) * F.col("weight") / F.lit(share)).cast("double")
        if n == last:
            return weighted.withColumn("target", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(own))
        capped, last = capped | (own > most * F.col("source_size")), n


def _weighted(ranked: DataFrame, weights: tuple) -> DataFrame:
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int") + 1))


def _sources(rows: DataFrame, weights: tuple) -> DataFrame:
    """One row a source: name, sid, source_size, target, blocks, epochs, rest (words of the last, partial epoch), written."""
    stats = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    out = _targets(_ranked(stats), weights, MOST)
    want = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(0).cast("int")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("long")
    out = out.select(F.col("source").alias("name"), "sid", "source_size", "target", blocks.alias("blocks"), epochs.alias("epochs"), want.alias("want"))
    return materialize(out.withColumn("rest", F.col("want") - F.col("epochs") * F.col("source_size")).drop("want"))


def _with_block(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sized(sources), rows["source"].eqNullSafe(sources["name"])).withColumn("block", F.pmod("key", "blocks")).drop("name")


# ---------------------------------------------------------------- draws


def _before(rows: DataFrame, by: str, hash_: Column, value: Column, ties: list[str]) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``by`` that precede in the order of a hash. Sums are taken by
    ranges of the hash first, so that a window sees one range of a group."""
    placed = materialize(rows.withColumns({"order": hash_, "range": F.shiftrightunsigned(hash_, 64 - RANGES.bit_length() + 1).cast("int"), "value": value}))
    sums = placed.groupBy(by, "range").agg(F.sum("value").alias("all"))
    earlier = F.coalesce(F.sum("all").over(Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("value").over(Window.partitionBy(by, "range").orderBy("order", *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = materialize(sums.withColumn("earlier", earlier).drop("all"))
    out = placed.withColumn("within", within).join(sized(sums), [by, "range"])
    return out.withColumn("before", F.col("earlier") + F.col("within")).drop("order", "range", "value", "within", "earlier")


def _draws(by_block: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """by_block: sid, block, words. Gives sid, block, epoch, taken (words), words, for every time a block is drawn."""
    known = by_block.filter("words > 0").join(sized(sources.select("sid", "epochs", "rest")), "sid")
    whole = known.filter("epochs > 0").select("sid", "block", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), F.col("words").alias("taken"), "words")
    last = _before(known.filter("rest > 0"), "sid", F.xxhash64(F.lit(seed), F.lit("epoch"), "sid", "epochs", "block"), F.col("words"), ["block"])
    last = last.select("sid", "block", F.col("epochs").alias("epoch"), F.least("words", F.col("rest") - F.col("before")).alias("taken"), "words")
    return whole.unionByName(last.filter("taken > 0"))


def _sharded(draws: DataFrame, shards: int, seed: int, top: int) -> DataFrame:
    """Adds each draw's shard by the tree's quotas. ``draws`` is written."""
    grouped = draws.withColumn("group", F.pmod("sid", F.lit(GROUPS)).cast("int"))
    counts = {r["group"]: r["count"] for r in grouped.groupBy("group").count().collect()}  # at most GROUPS rows
    groups = sorted(counts)
    total, depth = sum(counts.values()), top.bit_length() - 1
    nodes = list(nodes_of(np.array([counts[g] for g in groups], np.int64), 0, shards, total, shards, seed, depth)) if groups else []
    ends = {g: np.cumsum([c[k] for _, _, c in nodes]) for k, g in enumerate(groups)}
    lows, highs = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes], np.int64)
    ties = ["sid", "block", "epoch"]
    ranked = _before(grouped, "group", F.xxhash64(F.lit(seed), F.lit("draw"), *ties), F.lit(1), ties)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node, inside = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            group, rank = batch["group"].to_numpy(), batch["before"].to_numpy(np.int64)
            for g in np.unique(group):
                own = group == g
                node[own] = np.searchsorted(ends[g], rank[own], "right")
                inside[own] = rank[own] - np.concatenate(([0], ends[g]))[node[own]]
            yield batch.drop(columns=["before"]).assign(lo=lows[node], hi=highs[node], rank=inside)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        lo, hi, part = int(part["lo"].iloc[0]), int(part["hi"].iloc[0]), part.sort_values(["group", "rank"])
        # all groups of the tree, so that the subtree is split as if it had been grown in one piece
        own = np.array([(part["group"] == g).sum() for g in groups], np.int64)
        leaves = list(nodes_of(own, lo, hi, total, shards, seed, shards))
        shard = [np.repeat([n[0] for n in leaves], [n[2][k] for n in leaves]) for k in range(len(groups))]
        return part.assign(shard=np.concatenate(shard).astype(np.int64))[list(columns)]

    columns = {"sid": "long", "block": "long", "epoch": "int", "taken": "long", "words": "long", "shard": "long"}
    schema = ", ".join(f"{k} {v}" for k, v in columns.items())
    ranked = ranked.select("sid", "block", "epoch", "taken", "words", "group", "before")
    placed = ranked.mapInPandas(place, "sid long, block long, epoch int, taken long, words long, group int, lo long, hi long, rank long")
    if all(h - l == 1 for l, h in zip(lows, highs)):
        return materialize(placed.select("sid", "block", "epoch", "taken", "words", F.col("lo").alias("shard")))
    return materialize(placed.groupBy("lo").applyInPandas(grow, schema))


def plan(rows: DataFrame, weights: tuple = WEIGHTS, shards: int | None = None, seed: int = SEED, top: int = TOP) -> tuple[DataFrame, DataFrame, int] | None:
    """rows: source, size, key, written. Gives the sources, the draws (sid, block, epoch, taken, words, shard), and the number of shards."""
    if rows.isEmpty():
        return None
    sources = _sources(rows, weights)
    words = rows.agg(F.sum("size")).first()[0]
    shards = shards or max(LEAST_SHARDS, -(-words // SHARD_WORDS))
    by_block = materialize(_with_block(rows, sources).groupBy("sid", "block").agg(F.sum("size").alias("words")))
    return sources, _sharded(materialize(_draws(by_block, sources, seed)), shards, seed, top), shards


def _key(id_: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_, text)


def _pieces(narrow: DataFrame, sources: DataFrame, draws: DataFrame) -> DataFrame:
    """Of written narrow rows (source, size, key), by key, the words taken of each row of the blocks that are drawn in part (at
    most one a source, of about ``BLOCK_ROWS`` keys): sid, key, epoch, shard, piece. Rows of one key share what is left for it evenly."""
    some = draws.filter("taken < words").select("sid", "block", "epoch", "shard", "taken")
    part = _with_block(narrow, sources).join(sized(some), ["sid", "block"])
    part = part.groupBy("sid", "block", "epoch", "shard", "taken", "key").agg(F.sum("size").alias("all"), F.count("*").alias("copies"))
    order = Window.partitionBy("sid", "block", "epoch").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("taken") - F.coalesce(F.sum("all").over(order), F.lit(0))
    part = part.withColumn("piece", F.ceil(F.greatest(F.lit(0), F.least("all", left)) / F.col("copies")).cast("long")).filter("piece > 0")
    return materialize(part.select("sid", "key", "epoch", "shard", "piece"))


def _drawn(rows: DataFrame, planned: tuple[DataFrame, DataFrame, int], narrow: DataFrame) -> DataFrame:
    """rows (with source, size, key) once for each time they are drawn: epoch, shard and the words taken."""
    sources, draws, _ = planned
    pieces = _pieces(narrow, sources, draws)
    whole = draws.filter("taken = words").groupBy("sid", "block").agg(F.collect_list(F.struct("epoch", "shard")).alias("times"))  # at most MOST
    placed = _with_block(rows, sources)
    columns = [*rows.columns, "epoch", "shard"]
    full = placed.join(sized(materialize(whole)), ["sid", "block"]).filter("size > 0").withColumn("time", F.explode("times"))
    full = full.select(*rows.columns, "time.epoch", "time.shard", F.col("size").alias("taken"))
    return full.unionByName(placed.join(sized(pieces), ["sid", "key"]).select(*columns, F.col("piece").alias("taken")))


def _facts(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    text = F.col(f"`{text_col}`")
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    return [F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), _key(F.col(f"`{id_col}`"), text, seed).alias("key")]


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target (its source's), taken (words that the mix takes), shards (those
    that it is drawn into, ascending and comma-joined, one for each draw)."""
    rows = materialize(with_row_id(docs.select(F.col(f"`{id_col}`").alias("doc_id"), *_facts(docs, id_col, text_col, source_col, seed)), "rid"))
    planned = plan(rows, weights, shards, seed)
    if planned is None:
        return rows.select("doc_id", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"), F.lit("").alias("shards"))
    times = _drawn(rows.select("rid", "source", "size", "key"), planned, rows.select("source", "size", "key"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("shard")), lambda x: x.cast("string")), ",")  # at most MOST + 1
    taken = times.groupBy("rid").agg(F.sum("taken").alias("taken"), listed.alias("shards"))
    placed = _with_block(rows, planned[0]).select("rid", "doc_id", "size", "source_size", "target")
    return placed.join(taken, "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed rows, all columns of ``docs``: one row for each time a row is drawn, each shard together, in its own task, and shuffled.

    ``docs`` is read twice, first for sizes and hashes alone; texts move to their shard, and before it to their block's draws where
    those are too many to broadcast."""
    facts = _facts(docs, id_col, text_col, source_col, seed)
    narrow = materialize(docs.select(*facts))
    planned = plan(narrow, weights, shards, seed)
    if planned is None:
        return docs
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *facts)
    drawn = _drawn(rows, planned, narrow)
    words = F.array_remove(F.split(text_of(F.col("row")[text_col]), r"[\x20\x09-\x0D]+"), "")
    text = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.col("taken").cast("int"))), " ")).otherwise(F.col("row")[text_col])
    drawn = drawn.select("shard", F.xxhash64(F.lit(seed), "key", "epoch").alias("order"), "row", text.alias("text"))
    tasks = min(planned[2], TASKS)
    drawn = drawn.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "order")
    return drawn.select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
